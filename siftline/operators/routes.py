"""Which methods answer HTTP requests: routes from attributes, annotations and route files, with their prefixes, and what lies near them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .code import FILE
from .graph import durable, kept, reach
from .joins import prefixes
from .parsing import AT_ONCE, REMEMBERED, first_of, has, java, replaced

_METHOD = r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)"
_CLASS = r"^\s*(?:final\s+|abstract\s+)?class\s+(\w+)"
_ATTRIBUTE, _ANNOTATION = r"#\[\s*(?:[\w\\]+\\)?Route\b", r"@(?:[\w\\]+\\)?Route\b"
#: Lines over which the arguments of one route are read, at most.
ARGUMENT_LINES = 8


def joined_path(*parts: Column) -> Column:
    """The parts as one path: single slashes, every parameter in braces as ``x``; null and empty parts are left out."""
    clean = F.filter(F.array(*(F.regexp_replace(p, "^/+|/+$", "") for p in parts)), lambda p: p.isNotNull() & (p != ""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(clean, "/")), r"\{[^}]+\}", "x")


def _lines(files: DataFrame, pattern: str) -> DataFrame:
    rows = files.where(F.col("path").rlike(pattern) & F.col("text").isNotNull()).select(*FILE, F.posexplode(F.split("text", r"\r?\n")).alias("_at", "code"))
    return rows.select(*FILE, (F.col("_at") + 1).cast("long").alias("line"), "code")


def route_prefixes(files: DataFrame) -> DataFrame:
    """project, target, prefix: directories (with a slash at the end) and files whose routes the route files put below a prefix; entries are blocks of a top-level key."""
    lines = _lines(files, r"(?:^|/)config/routes(?:\.yaml$|/.*\.yaml$)")
    key = F.last(F.when(F.col("code").rlike(r"^[^\s#][^:]*:"), F.col("line")), ignorenulls=True).over(Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    value = lambda name: F.max(F.nullif(F.regexp_extract("code", rf"""^\s+{name}\s*:\s*['"]?([^'"#]*?)['"]?\s*(?:#.*)?$""", 1), F.lit("")))
    entries = lines.withColumn("entry", key).groupBy(*FILE, "entry").agg(value("resource").alias("resource"), value("prefix").alias("prefix"))
    named = F.replace(F.col("resource"), F.lit("\\"), F.lit("/"))
    inside = F.regexp_extract(named, r"^(?:.*\.\./)?src/([^{]*)", 1)
    target = F.concat(F.lit("src/"), F.when(F.endswith(inside, F.lit(".php")), inside).otherwise(F.concat(F.regexp_replace(inside, "/+$", ""), F.lit("/"))))
    return entries.where(F.col("prefix").isNotNull() & named.rlike(r"(?:\.\./|^)src/")).select("project", F.replace(target, F.lit("//"), F.lit("/")).alias("target"), "prefix").groupBy("project", "target").agg(F.min("prefix").alias("prefix"))


_PLACED = "project string, path string, class string, method string, first long, last long, route string, verbs string, declared_by string, level string, class_prefix string"


def _said(line: str) -> tuple[str, str, str | None] | None:
    """Method, class and mark of a line; None where it says none of them."""
    if not ("function" in line or "class" in line or "Route" in line):
        return None
    found = first_of(_METHOD, line), first_of(_CLASS, line), "attribute" if has(_ATTRIBUTE, line) else "annotation" if has(_ANNOTATION, line) else None
    return found if any(found) else None


def _arguments(args: str) -> tuple[str | None, str | None]:
    """Path and verbs of a mark."""
    m = java(r"""path\s*[:=]\s*["']([^"']*)["']""").search(args) or java(r"""["']([^"']*)["']""").search(args)
    verbs = first_of(r"""methods\s*[:=]\s*(\[[^\]]*\]|["'][^"']*["'])""", args)
    return m and m[1], replaced(r"""^[\[\]"' ]+|[\[\]"' ]+$""", verbs, "") if verbs else None


def _of_file(path: str, text: str, said: Callable, arguments: Callable) -> Iterator[tuple]:
    """The rows of a file as in ``_PLACED``, without project and path."""
    lines = text.replace("\r\n", "\n").split("\n")
    rows = [(n, *x) for n, x in enumerate(map(said, lines), 1) if x]
    named = next(((n, name) for n, _, name, _ in rows if name), (0, None))
    marks = [(n, mark, "class" if n < named[0] else "method", *arguments(" ".join([lines[n - 1], *takewhile(lambda c: not ((x := said(c)) and x[2]), lines[n : n + ARGUMENT_LINES - 1])]))) for n, _, _, mark in rows if mark]
    prefix = next((route for _, _, level, route, _ in marks if level == "class"), None)
    methods = [(n, method) for n, method, _, _ in rows if method]
    stem, last = first_of(r"([^/]+)\.php$", path), [n - 1 for n, _ in methods[1:]] + [len(lines)]
    for (n, method), end in zip(methods, last, strict=False):
        yield stem, method, n, end, None, None, None, None, None
    k = 0
    for n, mark, level, route, verbs in marks:
        while k < len(methods) and methods[k][0] <= n:
            k += 1
        if k < len(methods):
            yield named[1], methods[k][1], methods[k][0], last[k], route, verbs, mark, level, prefix


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    said, arguments = lru_cache(REMEMBERED)(_said), lru_cache(REMEMBERED)(_arguments)
    types = [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] * 5
    for batch in batches:
        texts, paths, at, rows = batch.column("text"), batch.column("path").to_pylist(), [], []
        for k, path in enumerate(paths):
            more = list(_of_file(path, texts[k].as_py(), said, arguments))
            at += [k] * len(more)
            rows += more
            if len(rows) >= AT_ONCE or k == len(paths) - 1:
                place, columns = pa.array(at, pa.int64()), list(zip(*rows, strict=True)) or [()] * len(types)
                arrays = [batch.column("project").take(place), batch.column("path").take(place), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _PLACED.split(", ")])
                at, rows = [], []


def routes(files: DataFrame) -> DataFrame:
    """project, path, class, method, first, last, route, verbs, declared_by, level, address: the HTTP entry points of PHP files.

    A mark in front of a method belongs to the next method below; one in front of the class is a prefix of all routes in it and, as a mark, belongs to the
    first method (``level`` is class). A method ends before the next one begins. Methods that a route file names and that no mark names are
    routes without an address (``declared_by`` is yaml). The address is the prefix of the file or its nearest directory, then the class's, then the route's own.
    """
    code = files.where(F.col("path").rlike(r"\.php$") & F.col("text").isNotNull())
    # Read once: marks with their methods, and methods by themselves.
    placed = kept(code.select(*FILE, "text").mapInArrow(_placed, _PLACED))
    own = placed.where("declared_by is not null")

    given = _lines(files, r"(?:^|/)config/routes(?:\.yaml$|/.*\.yaml$)").select("project", F.explode(F.regexp_extract_all("code", F.lit(r"""controller\s*:\s*['"]?([\w\\]+::\w+)"""), 1)).alias("controller"))
    given = given.select("project", F.element_at(F.split(F.split("controller", "::")[0], r"\\"), -1).alias("class"), F.split("controller", "::")[1].alias("method")).distinct()
    # Of the named methods one table holds where they are and whether a mark names them.
    place = F.when(F.col("declared_by").isNull(), F.struct("path", "first", "last"))
    asked = placed.select("project", "class", "method", place.alias("s"), F.col("declared_by").isNotNull().alias("marked")).join(given, ["project", "class", "method"], "left_semi")
    yaml = asked.groupBy("project", "class", "method").agg(F.min("s").alias("s"), F.bool_or("marked").alias("marked")).where("not marked")
    yaml = yaml.select("project", "s.path", "class", "method", "s.first", "s.last", F.lit("yaml").alias("declared_by"), F.lit("method").alias("level"))

    # The file itself, or else the nearest directory that a route file puts below a prefix.
    homes = code.select(*FILE).distinct().select(*FILE, F.posexplode(F.transform(prefixes(F.col("path")), lambda p: F.when(p == F.col("path"), p).otherwise(F.concat(p, F.lit("/"))))).alias("_far", "target"))
    above = homes.join(route_prefixes(files), ["project", "target"]).groupBy(*FILE).agg(F.min_by("prefix", "_far").alias("dir_prefix"))
    own = own.join(above, FILE, "left")
    address = F.when((F.col("level") == "method") & F.col("route").isNotNull(), joined_path(F.col("dir_prefix"), F.col("class_prefix"), F.col("route")))
    own = own.select(*FILE, "class", "method", "first", "last", "route", "verbs", "declared_by", "level", address.alias("address"))
    return own.unionByName(yaml, allowMissingColumns=True)


def perimeter(files: DataFrame, entries: DataFrame, within: int = 3) -> DataFrame:
    """project, stem, hops: PHP files that lie at most ``within`` class references from a file with a route, by the files' stems; the limit is the search's own."""
    stem = F.regexp_extract("path", r"([^/]+)\.php$", 1)
    code = files.where(F.col("path").rlike(r"\.php$") & F.col("text").isNotNull())
    known = code.select("project", stem.alias("stem")).distinct()
    named = code.select("project", stem.alias("stem"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Za-z0-9_]{2,})\b"), 1))).alias("to"))
    named = named.where("to <> stem").join(known.withColumnRenamed("stem", "to"), ["project", "to"], "left_semi").distinct()
    node = lambda c: F.struct(F.col("project").alias("project"), F.col(c).alias("stem"))
    # Every level of the search reads the references, so the texts are looked through once.
    edges = durable(named.select(node("stem").alias("from"), node("to").alias("onto")))
    starts = entries.select("project", stem.alias("stem")).distinct().select(node("stem").alias("node"))
    found = reach(edges, starts, "from", "onto", within)
    return found.select("node.project", "node.stem", "hops")
