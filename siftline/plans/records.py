"""Records, roles and reach over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dependency, records
from ..sources import runs
from .dependency import _STAGE
from .graphs import _EDGES, _chain
from .registry import ORACLES, query, table

_STAGES = ORACLES["d26_record_stage"]


@query(
    "d20_deterministic_records",
    f"""WITH s AS ({_STAGES}), o AS (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'unknown' ELSE '' END AS policy FROM s JOIN orders USING (o_orderkey))
    SELECT o_orderkey, CASE stage WHEN 'license' THEN 'confirmed' WHEN 'platform_handled' THEN 'false_positive' WHEN 'misconfiguration' THEN 'confirmed' WHEN 'secret' THEN CASE WHEN o_custkey % 2 = 0 THEN 'false_positive' ELSE 'confirmed' END
        WHEN 'chain_closed' THEN 'false_positive' WHEN 'policy' THEN policy END AS verdict,
      CASE stage WHEN 'license' THEN 0.95 WHEN 'platform_handled' THEN 0.85 WHEN 'misconfiguration' THEN 0.9 WHEN 'secret' THEN 0.9 WHEN 'chain_closed' THEN CASE WHEN o_orderkey % 4 < 2 THEN 0.45 ELSE 0.8 END
        WHEN 'policy' THEN CASE WHEN policy = 'unknown' THEN 0.5 ELSE 0.9 END END::DOUBLE AS confidence,
      CASE WHEN stage = 'secret' THEN o_custkey % 2 <> 0 WHEN stage = 'chain_closed' THEN o_orderkey % 4 < 2 WHEN stage = 'policy' THEN o_custkey % 8 < 4 ELSE false END AS person,
      CASE WHEN stage = 'policy' THEN 'policy' ELSE 'heuristics' END AS decided_by FROM o WHERE stage NOT IN ('heuristics', 'deployment_mismatch', 'trace_gate', 'model')""",
)
def d20(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", *(F.expr(sql).alias(name) for name, sql in _STAGE.items()))
    rows = rows.withColumn("stage", dependency.record_stage(*map(F.col, _STAGE)))
    closure = F.when(F.col("o_orderkey") % 4 < 2, 0.45).otherwise(0.8)
    record = records.deterministic_record(F.col("stage"), closure, F.col("policy"), F.col("o_custkey") % 8 < 4, F.lit(True), F.col("o_custkey") % 2 == 0)
    return rows.withColumn("r", record).where("r is not null").select("o_orderkey", "r.verdict", "r.confidence", "r.person", "r.decided_by")


@query(
    "j33_path_roles",
    r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages),
    d AS (SELECT regexp_extract(path, '^([^/]+)/', 1) AS dir, count(*) AS files FROM p WHERE contains(path, '/') GROUP BY 1)
    SELECT 'french' AS role, 'fr/' AS found, files FROM d WHERE dir = 'fr' UNION ALL
    SELECT 'pages', path, NULL FROM p WHERE path LIKE '%.html' AND path NOT LIKE 'de/%'""",
)
def j33(spark, d):
    """A directory rule and a file rule; one directory is left out."""
    paths = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"))
    return records.path_roles(paths, [], "path", [("french", "fr/"), ("pages", "*.html")], ["de"]).select("role", "found", "files")


@query(
    "g8_public_entries",
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT c_custkey AS flaw, c_custkey AS node, 0 AS hops FROM customer WHERE c_custkey <= 3 UNION SELECT flaw, src, hops + 1 FROM r JOIN e ON dst = node WHERE hops < 5)
    SELECT flaw, node AS entry, min(hops) AS hops FROM r JOIN customer ON c_custkey = node WHERE c_nationkey % 3 = 0 AND node IN (SELECT src FROM e) GROUP BY 1, 2 HAVING min(hops) > 0""",
)
def g8(spark, d):
    """Callers above three flawed functions, five calls up at most; a third of all functions are public."""
    customers = table(spark, d, "customer")
    public = customers.select(F.col("c_custkey").alias("caller"), (F.col("c_nationkey") % 3 == 0).alias("public"))
    calls = _chain(spark, d).select(F.col("src").alias("caller"), F.col("dst").alias("callee")).join(public, "caller")
    return records.public_entries(calls, customers.where("c_custkey <= 3").select(F.col("c_custkey").alias("function")), 5)


@query(
    "g9_package_bridge",
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS hops FROM customer WHERE c_custkey IN (1, 5) UNION SELECT start, src, hops + 1 FROM r JOIN e ON dst = node WHERE hops < 4)
    SELECT start, node AS package, min(hops) AS hops, CASE min(hops) WHEN 1 THEN 0.9 WHEN 2 THEN 0.63 WHEN 3 THEN 0.441 ELSE 0.309 END::DOUBLE AS confidence FROM r GROUP BY 1, 2 HAVING min(hops) > 0""",
)
def g9(spark, d):
    parents = _chain(spark, d).select(F.col("src").alias("parent"), F.col("dst").alias("child"))
    return records.bridge(parents, table(spark, d, "customer").where("c_custkey in (1, 5)").select(F.col("c_custkey").alias("package")))


@query("f23_production_bundle", "SELECT p_partkey, p_partkey % 4 IN (0, 1) AS production FROM part")
def f23(spark, d):
    m = F.col("p_partkey") % 4
    flags = F.when(m == 0, "['all' => true]").when(m == 1, """["dev" => true, "prod"=> true]""").when(m == 2, "['all' => true, 'all' => false, 'test' => true]")
    return table(spark, d, "part").select("p_partkey", F.coalesce(records.production_bundle(flags), F.lit(False)).alias("production"))


@query(
    "j38_symbol_users",
    r"""WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    d AS (SELECT *, last_value(CASE WHEN i % 4 = 1 THEN 'f' || i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS usr FROM e),
    w AS (SELECT DISTINCT doc_id, usr, unnest(regexp_split_to_array(line, '[^A-Za-z0-9_$]+')) AS name, i FROM d),
    m AS (SELECT doc_id, name, usr, min(i) AS i FROM w WHERE name IN ('the', 'de', 'que', 'die', 'and') GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY i) AS k FROM m)
    SELECT doc_id, name, usr AS user FROM r WHERE k <= 6""",
)
def j38(spark, d):
    """Every fourth line declares a function; common words are the names looked for."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    names = spark.createDataFrame([(n,) for n in ("the", "de", "que", "die", "and")], "name string")
    declares = F.when(F.col("i") % 4 == 0, F.concat(F.lit("f"), (F.col("i") + 1).cast("string")))
    return records.users_of(lines, ["doc_id"], "i", "line", declares, names, "name")


@query("s25_written_queue", "SELECT o_orderkey, o_orderstatus AS verdict, o_custkey AS cluster FROM orders WHERE o_orderstatus <> 'O'")
def s25(spark, d):
    """The open findings as a JSON sink, read back."""
    from .readers import _folder

    folder = f"{_folder(spark)}/{uuid.uuid4().hex}"
    queue = table(spark, d, "orders").where("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_orderstatus").alias("verdict"), F.col("o_custkey").alias("cluster"))
    runs.write_tables({"queue": queue}, folder)
    return spark.read.schema("o_orderkey long, verdict string, cluster long").json(f"{folder}/queue")
