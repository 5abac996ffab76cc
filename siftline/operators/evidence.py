"""Evidence for a verdict: code windows, diffs, declarations, images, quotes, answers and what fits a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_given, let, lookup
from .filters import ECOSYSTEMS

# How languages declare a function, how a package hands over its own, how requests are read, what is no code of ours.
DECLARES = r"(?i)\b(?:function\s+&?\s*|(?:async\s+)?def\s+|func\s+(?:\([^)]*\)\s*)?)([A-Za-z_$][\w$]*)\s*\(|\b([A-Za-z_$][\w$]*)\s*[:=]\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>)"
NAMED_ONLY = r"""['"`]([A-Za-z_$][\w$]*)['"`]|\.\s*([A-Za-z_$][\w$]*)\s*=(?!=)"""
CALLBACKS = (
    r"""\[\s*(?:\$this|self::class|static::class|__CLASS__|[\w\\]+::class)\s*,\s*['"](\w+)['"]\s*\]""",
    r"""=>\s*\[?\s*['"](\w+)['"]""",
    r"""['"][\w\\]+::(\w+)['"]""",
    r"""getattr\([^)]*['"](\w+)['"]""",
)
COMMENT_STARTS = r"^(//|/\*|\*|#|<!--|--)"
VENDORED = ("node_modules/", "vendor/", "third_party/")
SUFFIX_LANGUAGE = {"php": "php", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "vue": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "py": "python"}
ECOSYSTEM_LANGUAGE = {"npm": "javascript", "composer": "php", "go": "go", "pypi": "python"}
ECOSYSTEM_SUFFIXES = {"npm": ("js", "mjs", "cjs", "jsx", "ts", "tsx", "vue"), "composer": ("php",), "go": ("go",), "pypi": ("py",)}
CONFIG_SUFFIXES = ("yaml", "yml", "json", "xml", "twig", "html", "env")
NO_FILE = ("", "<unknown>", "unknown")


def code_window(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """Numbered lines ``before`` the start to ``after`` the end of a hit, clipped to the text; null without a start."""
    last = F.coalesce(end, start) + after

    def cut(lines):
        low = F.greatest(start - before, F.lit(1))
        kept = F.slice(lines, low, F.greatest(F.least(last, F.size(lines)) - low + 1, F.lit(0)))
        return F.array_join(F.transform(kept, lambda line, i: F.concat((low + i).cast("string"), F.lit(" | "), line)), "\n")

    return F.when(start.isNotNull(), let(F.split(text, "\n"), cut))


def diff_symbols(df: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, name) of the functions that a diff's kept or removed lines declare; what is declared on added lines alone was not there before."""
    lines = df.select(key, F.explode(F.split(diff, r"\r?\n")).alias("line")).where(~F.col("line").rlike(r"^(\+\+\+|---|@@|diff )"))
    names = F.concat(F.regexp_extract_all("line", F.lit(DECLARES), 1), F.regexp_extract_all("line", F.lit(DECLARES), 2))
    found = lines.select(key, F.substring("line", 1, 1).alias("sign"), F.explode(names).alias("name")).where("name <> ''")
    return found.groupBy(key, "name").agg(F.bool_or(F.col("sign") != "+").alias("old")).where("old").select(key, "name")


def declaration_states(names: DataFrame, files: DataFrame, package: str = "package", name: str = "name", text: str = "text") -> DataFrame:
    """names with ``declared``: true, false, or null where no file is known or the name only occurs in a form that may declare it.

    Names and files meet by equal (package, name), never by searching every file for every name.
    """
    source = files.where(F.col(text).isNotNull())
    both = lambda pattern: F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)))
    told = source.select(package, F.explode(both(DECLARES)).alias(name), F.lit(True).alias("declares"))
    hints = source.select(package, F.explode(both(NAMED_ONLY)).alias(name), F.lit(False).alias("declares"))
    forms = told.unionByName(hints).where(F.col(name) != "").groupBy(package, name).agg(F.bool_or("declares").alias("declares"))
    known = source.select(package).distinct().withColumn("_known", F.lit(True))
    joined = names.join(forms, [package, name], "left").join(known, package, "left")
    state = F.when(F.col("declares"), True).when(~F.col("declares") | F.col("_known").isNull(), F.lit(None).cast("boolean")).otherwise(False)
    return joined.select(*(F.col(c) for c in names.columns), state.alias("declared"))


def callback_registrations(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, name): methods that a file hands over by name, for a framework to call."""
    found = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in CALLBACKS)))
    return files.where(F.col(text).isNotNull()).select(path, F.explode(found).alias("name"))


def reads_request(line: Column, readers: list[str]) -> Column:
    """Whether a line calls one of the functions that read the request itself."""
    names = "|".join(rf"\Q{r}\E" for r in readers)
    return F.coalesce(line.rlike(rf"(?<![\w$])(?:{names})\s*\("), F.lit(False))


def quote_rejection(quote: Column, lines: Column) -> Column:
    """Why a quote may not lower a finding: ``comment``, or ``vendored`` if every line that holds it is third-party code; else null.

    ``lines`` are the lines shown, each with the path it is from.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    code = F.trim(F.regexp_replace(F.trim(quote), r"^[+-]+", ""))

    def where(needle):
        holding = F.filter(lines, lambda x: F.contains(flat(x), needle))
        ours = F.exists(holding, lambda x: ~F.exists(F.array(*map(F.lit, VENDORED)), lambda v: F.contains(F.replace(x, F.lit("\\"), F.lit("/")), v)))
        return F.when((needle != "") & (F.size(holding) > 0) & ~ours, "vendored")

    return F.when(code.rlike(COMMENT_STARTS), "comment").otherwise(let(flat(quote), where))


def repaired_answer(text: Column) -> Column:
    """The JSON object of a model's answer as a variant: as it is, out of its fence, or from its first brace to its last, escapes mended; null if none parses.

    A brace inside a string before the object's end does no harm, as the last one closes it.
    """
    raw = F.trim(text)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    mend = lambda c: F.regexp_replace(c, r'\\(?![\\/"bfnrtu])', r"\\\\")
    tries = [c for base in (raw, F.trim(fenced), inner) for c in (base, mend(base))]
    objects = [F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in (F.try_parse_json(F.nullif(c, F.lit(""))) for c in tries)]
    return F.coalesce(*objects)


def image_facts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tree, start) of a build file's last stage: whether it has an installed tree, with or without development packages, and what it starts.

    full, production, none or unknown; null text and a file without a stage are unknown.
    """
    joined = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\\\s*\n", " ")
    numbered = files.select(key, F.posexplode(F.split(joined, "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> '' and line not like '#%'")
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upper = F.upper("line")
    is_from = F.startswith(upper, F.lit("FROM "))
    staged = numbered.withColumn("stage", F.sum(is_from.cast("int")).over(order)).where("stage > 0")
    install = F.startswith(upper, F.lit("RUN")) & F.col("line").rlike(r"(?i)\b(npm\s+(ci|install|i)|yarn(\s+install)?\b|pnpm\s+(install|i)|composer\s+install|bun\s+install)\b")
    slim = F.col("line").rlike(r"(?i)--(only=prod|omit=dev|production|prod\b|no-dev)")
    prune = F.col("line").rlike(r"\bnpm\s+prune\b|\byarn\s+workspaces\s+focus\b.*--production")
    env = F.startswith(upper, F.lit("ENV")) & F.col("line").rlike(r"NODE_ENV[= ]+production")
    copies = F.startswith(upper, F.lit("COPY")) & F.col("line").rlike("node_modules|vendor")
    begins = F.startswith(upper, F.lit("CMD")) | F.startswith(upper, F.lit("ENTRYPOINT"))
    alias = F.lower(F.regexp_extract("line", r"(?i)\bAS\s+(\S+)", 1))
    stages = staged.groupBy(key, "stage").agg(
        F.max(F.when(is_from, F.coalesce(F.nullif(alias, F.lit("")), (F.col("stage") - 1).cast("string")))).alias("name"),
        F.bool_or(install).alias("installs"),
        (F.bool_or(env | prune) | F.bool_and(F.when(install, slim))).alias("slim"),
        F.min_by("line", F.when(copies, F.col("at"))).alias("copy"),
        F.bool_or(F.startswith(upper, F.lit("COPY")) & F.col("line").rlike(r"\s\.\s+\S+|\s\./?\s")).alias("context"),
        F.max_by("line", F.when(begins, F.col("at"))).alias("start"),
    )
    last = stages.groupBy(key).agg(F.max_by(F.struct("installs", "slim", "copy", "context", "start"), "stage").alias("f"))
    source = F.lower(F.regexp_extract("f.copy", r"--from=(\S+)", 1))
    by_name = stages.select(key, F.col("name").alias("source"), F.col("installs").alias("there"), F.coalesce("slim", F.lit(False)).alias("there_slim"))
    kind = lambda slim: F.when(slim, "production").otherwise("full")
    rows = files.select(key).join(last.withColumn("source", source), key, "left").join(by_name, [key, "source"], "left")
    tree = (
        F.when(F.col("f").isNull(), "unknown").when(F.col("f.installs"), kind(F.coalesce("f.slim", F.lit(False)))).when(F.col("f.copy").isNotNull() & F.col("there"), kind(F.col("there_slim")))
        .when(F.col("f.copy").isNotNull(), "full").when(F.col("f.context"), "unknown").otherwise("none")
    )
    return rows.select(key, tree.alias("tree"), F.coalesce("f.start", F.lit("")).alias("start"))


def declared_release(build: Column, module: Column) -> Column:
    """The language release that production runs: the build image's tag, else the module's toolchain, else its language line; empty if nothing says."""
    given = F.regexp_extract(build, r"(?im)^\s*ARG\s+GO_VERSION=(\S+)", 1)
    tag = F.regexp_extract(build, r"(?im)^\s*FROM\s+(?:\S+/)?golang:(\S+)", 1)
    tag = F.when(tag.rlike(r"^\$\{?GO_VERSION\}?"), F.concat(given, F.regexp_replace(tag, r"^\$\{?GO_VERSION\}?", ""))).otherwise(tag)
    number = r"^(\d+\.\d+(?:\.\d+)?)"
    found = first_given(F.regexp_extract(tag, number, 1), F.regexp_extract(module, r"(?m)^toolchain\s+go(\d+\.\d+(?:\.\d+)?)", 1), F.regexp_extract(module, r"(?m)^go\s+(\d+\.\d+(?:\.\d+)?)", 1))
    full = F.when(found.rlike(r"^\d+\.\d+$"), F.concat(found, F.lit(".0"))).otherwise(found)
    return F.coalesce(F.concat(F.lit("go"), full), F.lit(""))


def report_place(path: Column, line: Column, package: Column, version: Column, call_sites: Column, kind: Column) -> Column:
    """struct(location, place, kind): what stands where a file would, where to open an editor, and which half of the report a record is in."""
    file = F.when(~F.coalesce(path, F.lit("")).isin(*NO_FILE), path)
    named = F.concat(first_given(package), F.coalesce(F.concat(F.lit("@"), first_given(version)), F.lit("")))
    at = F.concat(file, F.coalesce(F.concat(F.lit(":"), F.when(line > 0, line).cast("string")), F.lit("")))
    sites = F.when(F.size(F.coalesce(call_sites, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(call_sites, 1, 3), ", "))
    half = F.when(kind.isin("dependency", "weakness", "misconfiguration", "license"), kind).when(first_given(package).isNotNull(), "dependency").otherwise("weakness")
    missing = F.when(kind == "dependency", "project dependency").otherwise("no file given")
    return F.struct(F.coalesce(file, named, missing).alias("location"), F.coalesce(sites, at, F.lit("-")).alias("place"), half.alias("kind"))


def within_budget(df: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each group as long as their total size stays inside the budget; the first that does not fit ends the group."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_total", F.sum(size).over(running)).where(F.col("_total") <= budget).drop("_total")


def languages_present(findings: DataFrame, ecosystem: str, path: str, only: list[str] | None = None) -> DataFrame:
    """Languages that findings bring in, by ecosystem, else by file suffix; with ``only``, of these ecosystems alone."""
    named = lookup(ECOSYSTEMS, F.lower(F.trim(F.coalesce(F.col(ecosystem), F.lit("")))))
    by_path = lookup(SUFFIX_LANGUAGE, F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([A-Za-z]+)$", 1)))
    kept = findings if only is None else findings.where(named.isNull() | named.isin(*only))
    return kept.select(F.coalesce(lookup(ECOSYSTEM_LANGUAGE, named), by_path).alias("language")).where("language is not null").distinct()


def of_ecosystem(path: Column, ecosystem: Column, configs: bool = False) -> Column:
    """Whether a file belongs to an ecosystem's sources, and with ``configs`` to configuration and templates; an unknown ecosystem takes every source."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    own = lookup(ECOSYSTEMS, F.lower(F.trim(F.coalesce(ecosystem, F.lit("")))))
    table = F.create_map(*(x for eco, names in ECOSYSTEM_SUFFIXES.items() for x in (F.lit(eco), F.array(*map(F.lit, names)))))
    every = F.array(*map(F.lit, sorted({s for names in ECOSYSTEM_SUFFIXES.values() for s in names})))
    found = F.array_contains(F.coalesce(F.element_at(table, own), every), suffix)
    return found | suffix.isin(*CONFIG_SUFFIXES) if configs else found


def declared_unaffected(details: Column, name: Column) -> Column:
    """The first sentence that says the named function is not affected; one whose clause speaks of callers or users of it says nothing."""
    sentences = F.split(details, r"(?<=[.!?])\s+|\n+")
    clause = lambda s: F.filter(F.split(s, r"[;,]"), lambda c: F.contains(c, name) & c.rlike(r"(?i)\b(?:not|un)[ -]?(?:affected|vulnerable|impacted)\b"))
    says = lambda s: F.exists(clause(s), lambda c: ~c.rlike(r"(?i)\b(?:callers?|users?|applications?) (?:of|that|who|using)\b"))
    return F.when(F.coalesce(name, F.lit("")) != "", F.get(F.filter(sentences, says), F.lit(0)))


def image_only_packages(records: DataFrame, package: str, version: str, shipped: str) -> DataFrame:
    """Distinct package versions that are in the image but that nothing loads: what to prune, by name and version."""
    return records.where((F.col(shipped) == "image_only") & (F.coalesce(F.col(package), F.lit("")) != "")).select(F.lower(package).alias("package"), F.col(version).alias("version")).distinct()
