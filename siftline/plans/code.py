"""Names, calls and exports of source files that are made from whole documents: each word becomes a statement, written as text and read as code."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import functions as F

from ..operators import code, links
from ..operators.graph import kept
from . import made
from .registry import query, table

# A statement for each word: its kind and numbers come from the word's place, its length and the document.
_SQL_WORDS = r"""words AS (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[ \n]+')) AS w, generate_subscripts(regexp_split_to_array(text, '[ \n]+'), 1) AS line FROM documents WHERE text IS NOT NULL),
st AS (SELECT doc_id, lang, 'src/' || lang || '/m' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '/index.js' ELSE '.js' END AS path, line, (line * 7 + length(w) * 3 + doc_id) % 12 AS k,
    'v' || (line + length(w)) % 6 AS a, 'v' || (line * 5 + length(w)) % 6 AS b, 'pkg' || (length(w) + doc_id) % 9 AS p, CASE (line + 2 * length(w)) % 8 WHEN 7 THEN 'get' ELSE 'fn' || (line + 2 * length(w)) % 8 END AS f, doc_id + length(w) AS t FROM words)"""
_SQL_DEFS = """defs AS (SELECT doc_id, lang, path, line, a AS name, k, CASE WHEN k IN (2, 3, 10) THEN b END AS rhs, CASE WHEN k IN (0, 1) THEN p END AS package, CASE WHEN k = 1 THEN f END AS member, t FROM st WHERE k IN (0, 1, 2, 3, 4, 9, 10)),
hoisted AS (SELECT doc_id, name, min(line) AS at FROM defs GROUP BY 1, 2), hoist AS (SELECT h.* FROM hoisted h JOIN defs d ON d.doc_id = h.doc_id AND d.name = h.name AND d.line = h.at AND d.k IN (0, 1, 9)),
par AS (SELECT d.*, coalesce(e.line, h.at) AS parent FROM (SELECT * FROM defs WHERE rhs IS NOT NULL) d ASOF LEFT JOIN defs e ON d.doc_id = e.doc_id AND d.rhs = e.name AND d.line > e.line LEFT JOIN hoist h ON h.doc_id = d.doc_id AND h.name = d.rhs),
root AS (SELECT doc_id, name, line, name AS root, line AS root_line, 0 AS hops FROM defs WHERE rhs IS NULL OR line NOT IN (SELECT line FROM par q WHERE q.doc_id = defs.doc_id AND parent IS NOT NULL)
    UNION ALL SELECT par.doc_id, par.name, par.line, root.root, root.root_line, root.hops + 1 FROM root JOIN par ON par.doc_id = root.doc_id AND par.rhs = root.name AND par.parent = root.line),
bound AS (SELECT r.doc_id, r.name, r.line, o.package, CASE WHEN r.hops = 0 THEN o.member END AS member, r.hops FROM root r JOIN defs o ON o.doc_id = r.doc_id AND o.line = r.root_line AND o.package IS NOT NULL)"""


# Which numbers of a word's statement are said by each kind: two names, a package, a function, a module.
_SAYS = np.array([[k in kinds for k in range(12)] for kinds in ((0, 1, 2, 3, 4, 5, 7, 8, 9, 10), (2, 3, 4, 10, 11), (0, 1), (1, 2, 5, 6, 7, 8), (9,))], np.int64)


def _statements(doc, place, size):
    line, kind = place + 1, ((place + 1) * 7 + size * 3 + doc) % 12
    a, b, p, n, t = (_SAYS[k][kind] * x for k, x in enumerate(((line + size) % 6, (line * 5 + size) % 6, (size + doc) % 9, (line + 2 * size) % 8, (doc + size) * 2 + size % 2)))
    return made.spelled((((t * 8 + n) * 9 + p) * 6 + b) * 72 + a * 12 + kind, _statement)


def _statement(code):
    code, kind = divmod(code, 12)
    code, a = divmod(code, 6)
    code, b = divmod(code, 6)
    code, p = divmod(code, 9)
    t, n = divmod(code, 8)
    a, b, f = f"v{a}", f"v{b}", "get" if n == 7 else f"fn{n}"
    near = f"{'./' if t % 2 else '@/'}m{t // 2}"
    return (
        f"import {a} from 'pkg{p}';", f'import {{ {f} as {a} }} from "pkg{p}";', f"const {a} = {b}.make(1); // {a}.{f}(0)", f"  {a} = new {b}( 2 )", f"{a} = unknown{b};",
        f"{a}.{f}(3);", f"{f}(4);", f"// {a}.{f}(5);", f"if (x) {{ {a}.deep?.{f}('// no comment', 6) }}", f"import {a}, {{ other }} from '{near}';",
        f"export const {a} = {b}.x;", f"export default {b};",
    )[kind]


def _path():
    tail = F.when(F.col("doc_id") % 5 == 0, "/index.js").otherwise(".js")
    return F.concat(F.lit("src/"), F.col("lang"), F.lit("/m"), F.col("doc_id").cast("string"), tail)


def _files(spark, d):
    """project, path, text: one JavaScript file a document."""
    return made.files(table(spark, d, "documents"), F.lit("all"), _path(), _statements)


def _traced(spark, d, uses, calls=False):
    """What the files hold that goes back to an import, read once: every later step reads this; and the packages of its imports."""
    traced = kept(code.traced_files(_files(spark, d), uses, calls, tied=True).drop("own", "use" if not calls else "x"))
    return traced, kept(code.spec_owners(traced.where("spec is not null"), _packages(spark)))


def _packages(spark):
    return spark.createDataFrame([(f"pkg{k}", "js", f"pkg{k}") for k in range(9)], "package string, lang string, prefix string")


@cache
def _aliases():
    return [("all", "@/", "src/en", 0), ("all", "@/", "src/fr", 1)]


def _doc(path="path"):
    return F.regexp_extract(path, r"/m(\d+)", 1).cast("long").alias("doc_id")


@query(
    "j21_bindings",
    f"WITH RECURSIVE {_SQL_WORDS}, {_SQL_DEFS} SELECT doc_id, line, name, package, member, hops FROM bound",
)
def j21(spark, d):
    """Which names of every file come from which package, over any number of assignments; a later definition ends an earlier one."""
    traced, packages = _traced(spark, d, False)
    bound = code.traced_bindings(traced.where(F.col("role") == links.DEFINITION), packages)
    return bound.select(_doc(), "line", "name", "package", "member", "hops")


_SQL_MODULES = """given AS (SELECT doc_id, path, CASE WHEN k = 10 THEN a ELSE 'default' END AS exported, CASE WHEN k = 10 THEN a ELSE b END AS chain, line + CASE WHEN k = 10 THEN 1 ELSE 0 END AS place FROM st WHERE k IN (10, 11)),
meant AS (SELECT g.*, coalesce(e.line, h.at) AS at FROM given g ASOF LEFT JOIN defs e ON g.doc_id = e.doc_id AND g.chain = e.name AND g.place > e.line LEFT JOIN hoist h ON h.doc_id = g.doc_id AND h.name = g.chain),
offered AS (SELECT DISTINCT m.doc_id AS target, exported, package FROM meant m JOIN bound x ON x.doc_id = m.doc_id AND x.name = m.chain AND x.line = m.at),
taken AS (SELECT s.doc_id, s.line, s.a AS name, s.t FROM st s JOIN documents o ON o.doc_id = s.t AND o.text IS NOT NULL WHERE s.k = 9
    AND CASE WHEN (s.t - s.doc_id) % 2 = 0 THEN o.lang IN ('en', 'fr') ELSE s.doc_id % 5 <> 0 AND o.lang = s.lang END),
through AS (SELECT r.doc_id, r.line, r.name, o.package, r.hops FROM root r JOIN taken t ON t.doc_id = r.doc_id AND t.line = r.root_line JOIN offered o ON o.target = t.t AND o.exported = 'default')"""


@query(
    "j22_reexports",
    f"WITH RECURSIVE {_SQL_WORDS}, {_SQL_DEFS}, {_SQL_MODULES} SELECT doc_id, line, name, package, hops FROM through",
)
def j22(spark, d):
    """Names that come from a package through one module of the project, by relative paths, aliases and index files."""
    traced, packages = _traced(spark, d, True)
    names = traced.where((F.col("role") == links.DEFINITION) & F.col("spec").isNotNull())
    return names.join(_modules(spark, d, traced, packages), [*code.FILE, "spec", "original"]).select(_doc(), "line", "name", "package", "hops")


def _modules(spark, d, traced, packages):
    aliases = spark.createDataFrame(_aliases(), "project string, prefix string, target string, ordinal int")
    return kept(code.traced_modules(traced, packages, table(spark, d, "documents").where("text is not null").select(F.lit("all").alias("project"), _path().alias("path")), aliases))


_SQL_CALLS = """calls AS (SELECT doc_id, path, lang, line, k, CASE k WHEN 2 THEN 'make' WHEN 3 THEN b ELSE f END AS name, CASE k WHEN 2 THEN b WHEN 3 THEN b WHEN 5 THEN a WHEN 8 THEN a ELSE f END AS head,
    CASE WHEN k = 3 THEN 'new' ELSE 'call' END AS kind, k = 6 AS bare FROM st WHERE k IN (2, 3, 5, 6, 8)),
means AS (SELECT c.*, coalesce(e.line, h.at) AS at FROM calls c ASOF LEFT JOIN defs e ON c.doc_id = e.doc_id AND c.head = e.name AND c.line > e.line LEFT JOIN hoist h ON h.doc_id = c.doc_id AND h.name = c.head),
every AS (SELECT doc_id, line, name, package, member FROM bound UNION ALL SELECT doc_id, line, name, package, NULL FROM through),
tied AS (SELECT m.doc_id, m.path, m.line, m.lang, m.kind, x.package, x.member, CASE WHEN bare THEN x.member WHEN m.kind = 'new' THEN coalesce(x.member, m.name) ELSE m.name END AS name FROM means m JOIN every x ON x.doc_id = m.doc_id AND x.name = m.head AND x.line = m.at),
sym AS (SELECT DISTINCT 'pkg' || p_partkey % 11 AS package, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 7 = 6 THEN 'make' ELSE CASE p_partkey % 10 WHEN 7 THEN 'get' ELSE 'fn' || p_partkey % 10 END END AS fun,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 = 4 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Klass' ELSE 'fn' || p_partkey % 8 END END AS class, p_partkey % 17 <> 0 AS distributed FROM part),
asked AS (SELECT *, CASE WHEN class IS NOT NULL THEN 'new' ELSE 'call' END AS kind, coalesce(class, fun) AS name FROM sym),
sites AS (SELECT a.package, a.fun, a.class, count(DISTINCT (path, line)) AS sites, bool_and(lang = 'fr') AS tests FROM asked a JOIN tied USING (package, name, kind) WHERE distributed GROUP BY 1, 2, 3),
loose AS (SELECT name, kind, count(DISTINCT (path, line)) AS loose, bool_and(lang = 'fr') AS tests FROM calls WHERE name <> 'get' GROUP BY 1, 2),
seen AS (SELECT DISTINCT package, member AS class FROM defs WHERE package IS NOT NULL AND member IS NOT NULL),
s AS (SELECT a.package, a.fun AS "function", a.class, CASE WHEN NOT distributed THEN 'not_distributed' WHEN a.name IS NULL THEN 'not_searchable' WHEN s.sites > 0 THEN 'called' WHEN loose > 0 THEN 'call_unconfirmed' WHEN e.class IS NOT NULL THEN 'referenced' ELSE 'absent' END AS state,
    s.sites, loose, s.tests, l.tests AS loose_tests FROM asked a LEFT JOIN sites s ON s.package = a.package AND s.fun IS NOT DISTINCT FROM a.fun AND s.class IS NOT DISTINCT FROM a.class
    LEFT JOIN loose l ON l.name = a.name AND l.kind = a.kind LEFT JOIN seen e ON e.package = a.package AND e.class = a.class)"""


def _sites(spark, d):
    traced, packages = _traced(spark, d, True, True)
    n = F.col("p_partkey")
    s = lambda x: x.cast("string")
    function = F.when((n % 13 == 0) | (n % 5 == 4), None).when(n % 7 == 6, "make").when(n % 10 == 7, "get").otherwise(F.concat(F.lit("fn"), s(n % 10)))
    klass = F.when(n % 13 == 0, None).when(n % 5 == 4, F.when(n % 3 == 0, "Klass").otherwise(F.concat(F.lit("fn"), s(n % 8))))
    symbols = table(spark, d, "part").select(F.concat(F.lit("pkg"), s(n % 11)).alias("package"), function.alias("function"), klass.alias("class"), (n % 17 != 0).alias("distributed"))
    return code.traced_call_sites(symbols, traced, packages, _modules(spark, d, traced, packages), F.contains("path", F.lit("/fr/")))


@query(
    "j20_call_sites",
    f"""WITH RECURSIVE {_SQL_WORDS}, {_SQL_DEFS}, {_SQL_MODULES}, {_SQL_CALLS}
    SELECT package, "function", class, state, CASE state WHEN 'called' THEN sites WHEN 'call_unconfirmed' THEN loose END AS sites, CASE state WHEN 'called' THEN tests WHEN 'call_unconfirmed' THEN loose_tests END AS tests_only FROM s""",
)
def j20(spark, d):
    """What the search for each symbol of each package has shown over all files."""
    return _sites(spark, d)[0]


@query(
    "j20_first_sites",
    f"""WITH RECURSIVE {_SQL_WORDS}, {_SQL_DEFS}, {_SQL_MODULES}, {_SQL_CALLS},
    hit AS (SELECT DISTINCT a.package, a.fun AS "function", a.class, path, line FROM asked a JOIN tied USING (package, name, kind) WHERE distributed
      UNION ALL SELECT DISTINCT s.package, s."function", s.class, c.path, c.line FROM s JOIN asked a ON a.package = s.package AND a.fun IS NOT DISTINCT FROM s."function" AND a.class IS NOT DISTINCT FROM s.class JOIN calls c ON c.name = a.name AND c.kind = a.kind WHERE s.state = 'call_unconfirmed'),
    r AS (SELECT *, row_number() OVER (PARTITION BY package, "function", class ORDER BY path, line) AS n FROM hit)
    SELECT package, "function", class, path, line FROM r WHERE n <= 25""",
)
def j20_first(spark, d):
    """The first twenty-five places of each symbol that is called, as the report shows them."""
    return _sites(spark, d)[1].drop("project")


# Twelve lines of each language, over and over, as many as a document has words; %s is the line's number from 0.
_FORMS = {
    "js": ["{e}class C%s {", "  m%s(a) {", "    call('}');", "  }", "  #p%s() { return 1; }", "  static _q%s(a, b) {", "    if (x) { y(); } // {", "  }", "}", "export function f%s(x) {", "}", "const g%s = (x) => x;"],
    "php": ["abstract class C%s {", "  public function m%s(A $a) {", "    call('}');", "  }", "  abstract protected function p%s();", "  private static function q%s()", "  { if ($x) { y(); }", "  }", "}", "function f%s($x) {", "}", "// function g%s() {"],
    "py": ["class C%s:", "    def m%s(self):", "        call('}')", "", "    def _p%s(self): return 1", "    async def q%s(self):", "        if x:", "            y()", "x = 1", "def __f%s(x):", "    pass", "# def g%s():"],
}


@query(
    "p38_declarations",
    r"""WITH w AS (SELECT doc_id, len(regexp_split_to_array(text, '[ \n]+')) AS lines FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, lines, unnest(range(lines)) AS k FROM w),
    d AS (SELECT *, k % 12 AS r, doc_id % 3 AS l FROM k WHERE k % 12 IN (1, 4, 5, 9) OR k % 12 = 11 AND doc_id % 3 = 0)
    SELECT doc_id, CASE r WHEN 1 THEN 'm' WHEN 4 THEN CASE l WHEN 2 THEN '_p' ELSE 'p' END WHEN 5 THEN CASE l WHEN 0 THEN '_q' ELSE 'q' END WHEN 9 THEN CASE l WHEN 2 THEN '__f' ELSE 'f' END ELSE 'g' END || k AS name, CASE WHEN r < 8 THEN 'C' || (k - r) ELSE '' END AS owner,
      CASE WHEN l = 0 THEN CASE r WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'private' END WHEN 9 THEN 'public' ELSE 'private' END WHEN l = 1 THEN CASE r WHEN 4 THEN 'protected' WHEN 5 THEN 'private' ELSE 'public' END
        ELSE CASE WHEN r IN (4, 9) THEN 'private' ELSE 'public' END END AS visibility,
      k + 1 AS first, least(lines, k + 1 + CASE r WHEN 1 THEN CASE l WHEN 2 THEN 1 ELSE 2 END WHEN 5 THEN CASE WHEN l = 1 AND k + 1 = lines THEN 0 ELSE 2 END WHEN 9 THEN 1 ELSE 0 END) AS last FROM d""",
)
def p38(spark, d):
    """A file for each document, in one of three languages, with classes, nested braces, braces in strings and comments, and functions that the end of the file cuts."""
    from ..operators import declarations

    suffixes = list(_FORMS)
    lang = F.element_at(F.array(*map(F.lit, suffixes)), (F.col("doc_id") % 3 + 1).cast("int"))

    def say(code):
        k, which = divmod(code, 6)
        form = _FORMS[suffixes[which // 2]][k % 12]
        return form.replace("{e}", "" if which % 2 else "export ").replace("%s", str(k))

    lines = lambda doc, place, size: made.spelled(place * 6 + doc % 3 * 2 + doc % 2, say)
    files = made.files(table(spark, d, "documents"), F.lit("all"), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit("."), lang), lines)
    found = declarations.declarations(files)
    return found.select(F.regexp_extract("path", r"^m(\d+)", 1).cast("long").alias("doc_id"), "name", "owner", "visibility", "first", "last")


@query(
    "s28_public_surface",
    """WITH RECURSIVE p AS (SELECT c_custkey AS class, c_custkey // 3 AS parent, c_nationkey % 2 AS package FROM customer), par AS (SELECT DISTINCT a.package, a.class, a.parent FROM p a WHERE a.parent > 0 UNION SELECT DISTINCT a.package, a.class, a.parent + 1 FROM p a WHERE a.class % 5 = 0),
    m AS (SELECT DISTINCT c_nationkey % 2 AS package, c_custkey AS class, 'op' || o_orderkey % 23 AS member, CASE WHEN min(o_orderkey) OVER (PARTITION BY c_custkey, o_orderkey % 23) % 4 = 0 THEN 'private' ELSE 'public' END AS visibility FROM orders JOIN customer ON c_custkey = o_custkey),
    n AS (SELECT package, class FROM m UNION SELECT package, class FROM par UNION SELECT package, parent FROM par),
    r AS (SELECT package, class, class AS node, 0 AS hops FROM n UNION SELECT r.package, r.class, par.parent, r.hops + 1 FROM r JOIN par ON par.package = r.package AND par.class = r.node),
    h AS (SELECT r.package, r.class, m.member, min({'d': r.hops, 'c': r.node, 'v': m.visibility}) AS b FROM r JOIN m ON m.package = r.package AND m.class = r.node GROUP BY 1, 2, 3)
    SELECT package, class, member, b.c AS declared_in, b.d AS distance FROM h WHERE b.v = 'public'""",
)
def s28(spark, d):
    """Customers as classes of one of two packages that inherit from others; orders as members, some of which hide what classes above offer."""
    from ..operators import declarations

    customers = table(spark, d, "customer").select((F.col("c_nationkey") % 2).alias("package"), F.col("c_custkey").alias("class"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent"))
    more = customers.where("class % 5 = 0").withColumn("parent", F.col("parent") + 1)
    parents = customers.where("parent > 0").unionByName(more).distinct()
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("class"), F.concat(F.lit("op"), (F.col("o_orderkey") % 23).cast("string")).alias("member"), "o_orderkey")
    least = orders.groupBy("class", "member").agg(F.min("o_orderkey").alias("least"))
    members = least.join(customers.select("package", "class"), "class").select("package", "class", "member", F.when(F.col("least") % 4 == 0, "private").otherwise("public").alias("visibility"))
    return declarations.public_surface(members, parents)
