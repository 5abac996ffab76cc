"""Filters and predicates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, versions
from ..operators import filters
from .registry import query, table

SCOPE = filters.Scope(exclude_rules=["sign*"], exclude_paths=["^k/1."], only_ecosystems=["JavaScript", "golang"], min_severity="medium")

_SCOPE_SQL = """WITH f AS (
  SELECT event_id, event_type AS rule, 'k/' || json_extract_string(props, '$.k') AS path,
         CASE user_id % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'python' WHEN 2 THEN '' END AS ecosystem,
         CASE WHEN value >= 9 THEN 'critical' WHEN value >= 7 THEN 'high' WHEN value IS NULL THEN 'unknown' WHEN value >= 4 THEN 'medium' ELSE 'low' END AS severity
  FROM events
), s AS (
  SELECT event_id, CASE WHEN rule LIKE 'sign%' THEN 'rule:sign*' WHEN regexp_matches(path, '^k/1.') THEN 'path:^k/1.'
    WHEN ecosystem = 'python' THEN 'ecosystem:pypi' WHEN severity IN ('info', 'low') THEN 'below_min_severity' END AS rule FROM f
)"""


def _findings(spark, d):
    value = F.col("value")
    return table(spark, d, "events").select(
        "event_id",
        F.col("event_type").alias("rule"),
        F.concat(F.lit("k/"), F.get_json_object("props", "$.k")).alias("path"),
        F.when(F.col("user_id") % 4 == 0, "npm").when(F.col("user_id") % 4 == 1, "python").when(F.col("user_id") % 4 == 2, "").alias("ecosystem"),
        F.when(value >= 9, "critical").when(value >= 7, "high").when(value.isNull(), "unknown").when(value >= 4, "medium").otherwise("low").alias("severity"),
    )


def _rule():
    return filters.scope_rule(SCOPE, F.col("rule"), F.col("path"), F.col("ecosystem"), F.lit(None).cast("string"), F.col("severity"))


@query("f1_scope_kept", f"{_SCOPE_SQL} SELECT event_id FROM s WHERE rule IS NULL")
def f1(spark, d):
    return filters.split_by_rule(_findings(spark, d), _rule())[0].select("event_id")


@query("f1_scope_excluded", f"{_SCOPE_SQL} SELECT event_id, rule AS scope_rule FROM s WHERE rule IS NOT NULL")
def f1_excluded(spark, d):
    return filters.split_by_rule(_findings(spark, d), _rule())[1].select("event_id", "scope_rule")


@query("a16_scope_counts", f"{_SCOPE_SQL} SELECT rule AS scope_rule, count(*) AS n FROM s WHERE rule IS NOT NULL GROUP BY 1")
def a16(spark, d):
    excluded = filters.split_by_rule(_findings(spark, d), _rule())[1]
    return excluded.groupBy("scope_rule").agg(F.count(F.lit(1)).alias("n"))


_PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"


def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))


@query("f2_test_path", f"SELECT page_id, regexp_matches({_PATH}, '/(fr|de)/') OR regexp_matches({_PATH}, '/1[^/]*$') AS is_test FROM pages")
def f2(spark, d):
    return _paths(spark, d).select("page_id", filters.test_path(F.col("path"), ["fr", "de"], ["1*"]).alias("is_test"))


@query(
    "f3_noisy_zone",
    f"SELECT page_id, CASE WHEN regexp_matches({_PATH}, '/es/') THEN 'spanish' WHEN regexp_matches({_PATH}, '[02468]$') THEN 'even' END AS zone FROM pages",
)
def f3(spark, d):
    return _paths(spark, d).select("page_id", filters.first_matching(F.col("path"), {"spanish": "/es/", "even": "[02468]$"}).alias("zone"))


@query("f6_license_finding", "SELECT doc_id, regexp_matches(text, '(?i)licen[cs]e') AS license FROM documents")
def f6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike("(?i)licen[cs]e").alias("license"))


@query("f7_valid_version", "SELECT p_partkey, p_size % 2 = 0 AS valid FROM part")
def f7(spark, d):
    version = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".1"))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", versions.semver_key(version, F.lit("npm")).isNotNull().alias("valid"))


@query(
    "f8_weakness_family",
    "SELECT n_nationkey, n_nationkey IN (9, 7, 4) AS secret FROM (SELECT n_nationkey FROM nation)",
)
def f8(spark, d):
    family = F.element_at(F.array(*(F.lit(c) for c in ("CWE-89", "CWE-79", "CWE-78", "CWE-22", "CWE-798", "CWE-94", "CWE-20", "CWE-259", "CWE-77", "CWE-321"))), (F.col("n_nationkey") % 100 + 1).cast("int"))
    guarded = F.when(F.col("n_nationkey") < 10, family)
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(guarded.isin(*filters.SECRET_FAMILY), F.lit(False)).alias("secret"))


_ORDER_VERDICT = "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'false_positive' ELSE 'unknown' END"


def verdicts(spark, d):
    """Orders read as decided findings: status is the verdict, priority the severity, urgent ones carry an override."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus",
        F.when(status == "F", "confirmed").when(status == "O", "false_positive").otherwise("unknown").alias("verdict"),
        F.when(F.startswith(priority, F.lit("1")), F.array(F.lit("sanity_conflict: x"))).otherwise(F.array().cast("array<string>")).alias("overrides"),
        F.when(F.col("o_orderkey") % 97 == 0, "timeout").alias("error"),
    )


@query(
    "f11_redo",
    f"""SELECT o_orderkey, {_ORDER_VERDICT} = 'unknown' OR o_orderkey % 97 = 0 OR o_orderpriority LIKE '1%' AS redo FROM orders""",
)
def f11(spark, d):
    redo = filters.needs_redo(F.col("verdict"), F.col("error"), F.col("overrides"), ["unknown", "error", "overridden"])
    return verdicts(spark, d).select("o_orderkey", redo.alias("redo"))


@query("f12_gate", f"SELECT count(*) FILTER ({_ORDER_VERDICT} IN ('confirmed', 'unknown')) AS failing FROM orders")
def f12(spark, d):
    return filters.gate_count(verdicts(spark, d), "verdict", "unknown")


@query("f14_always_review", "SELECT o_orderkey, o_orderpriority LIKE '1%' AS exempt FROM orders")
def f14(spark, d):
    exempt = F.exists("overrides", lambda o: F.startswith(o, F.lit("sanity_conflict")))
    return verdicts(spark, d).select("o_orderkey", exempt.alias("exempt"))


@query(
    "f15_positioned_trace",
    """SELECT conv_id, count(*) >= 2 AND bool_or(role = 'user') AND bool_or(role = 'assistant') AS authoritative FROM conversations GROUP BY 1""",
)
def f15(spark, d):
    # Flags alone: no row holds a conversation.
    has = lambda role: F.coalesce(F.bool_or((F.col("role") == role) & F.col("turn").isNotNull()), F.lit(False))
    authoritative = (F.count(F.lit(1)) >= 2) & has("user") & has("assistant")
    return table(spark, d, "conversations").groupBy("conv_id").agg(authoritative.alias("authoritative"))


@query("f18_advisory_nature", "SELECT doc_id, regexp_matches(text, '(?i)\\bbackdoor(ed)?\\b|compromised (package|account|release)') AS supply_chain FROM documents")
def f18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(r"(?i)\bbackdoor(ed)?\b|compromised (package|account|release)").alias("supply_chain"))


@query(
    "f19_ubiquitous_names",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents),
       s AS (SELECT unnest(['the', 'of', 'and', 'la', 'de', 'der', 'die', 'el', '']) AS word)
       SELECT word, count(*) AS docs FROM w WHERE word NOT IN (SELECT word FROM s) GROUP BY 1""",
)
def f19(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    common = spark.createDataFrame([(w,) for w in ("the", "of", "and", "la", "de", "der", "die", "el", "")], "word string")
    # Nine names: broadcast.
    return words.join(F.broadcast(common), "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("docs"))


@query("f21_searchable_token", "SELECT p_partkey, length(regexp_replace(p_type, '[^A-Za-z0-9_]', '', 'g')) >= 3 AS searchable FROM part")
def f21(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.length(F.regexp_replace("p_type", r"\W", "")) >= 3).alias("searchable"))


@query("f24_languages_present", "SELECT DISTINCT lang FROM documents WHERE lang IN ('en', 'fr')")
def f24(spark, d):
    return table(spark, d, "documents").select("lang").where(F.col("lang").isin("en", "fr")).distinct()


@query("f10_second_pass", f"SELECT o_orderkey FROM orders WHERE {_ORDER_VERDICT} = 'confirmed' OR o_orderpriority LIKE '1%'")
def f10(spark, d):
    return verdicts(spark, d).where((F.col("verdict") == "confirmed") | (F.size("overrides") > 0)).select("o_orderkey")


@query("f9_trustworthy_seed", f"SELECT o_orderkey FROM orders WHERE {_ORDER_VERDICT} = 'confirmed' AND o_totalprice >= 50000 AND o_orderpriority NOT LIKE '1%'")
def f9(spark, d):
    doubtful = F.exists("overrides", lambda o: F.startswith(o, F.lit("hallucinated_evidence")) | F.startswith(o, F.lit("sanity_conflict")))
    return verdicts(spark, d).where((F.col("verdict") == "confirmed") & (F.col("o_totalprice") >= 50000) & ~doubtful).select("o_orderkey")
