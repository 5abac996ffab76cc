"""Rule cascades over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import decisions, windows
from .filters import _ORDER_VERDICT, verdicts
from .registry import query, table

_SEVERITY = "CASE o_orderpriority[1] WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'unknown' END"
_SCORE = f"""greatest(0, least(100, CASE {_ORDER_VERDICT} WHEN 'confirmed' THEN 45 WHEN 'unknown' THEN 28 ELSE 3 END + CAST(o_custkey % 20 AS INTEGER)
   + CASE {_SEVERITY} WHEN 'critical' THEN 12 WHEN 'high' THEN 9 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 4 END
   - CASE WHEN o_orderkey % 7 = 0 THEN 12 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 12 ELSE 0 END + CASE WHEN o_orderkey % 97 = 0 THEN 10 ELSE 0 END
   + CASE WHEN {_ORDER_VERDICT} = 'confirmed' AND o_totalprice > 200000 THEN 8 ELSE 0 END))"""


def scored(spark, d):
    """Decided findings with severity and queue score."""
    first = F.substring("o_orderpriority", 1, 1)
    severity = F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").when(first == "4", "low").otherwise("unknown")
    path = F.when(F.col("o_orderkey") % 7 == 0, "app/tests/a.php").otherwise("app/src/a.php")
    none = F.lit(None).cast("string")
    score = decisions.queue_score(
        F.col("verdict"), (F.col("o_custkey") % 20).cast("int"), F.col("severity"), path, F.lit(False), F.col("overrides"), F.col("error"), none, none,
        F.when(F.col("o_totalprice") > 200000, "critical"),
    )
    return verdicts(spark, d).withColumn("severity", severity).withColumn("score", score)


@query("d17_queue_score", f"SELECT o_orderkey, {_SCORE} AS score FROM orders")
def d17(spark, d):
    return scored(spark, d).select("o_orderkey", "score")


@query("o1_queue_order", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY {_SCORE} DESC, o_orderkey) AS place FROM orders")
def o1(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("o_orderdate").orderBy(F.col("score").desc(), "o_orderkey")
    return scored(spark, d).select("o_orderkey", F.row_number().over(order).cast("long").alias("place"))


@query(
    "w1_cluster_representative",
    f"""WITH s AS (SELECT *, {_SCORE} AS score FROM orders) SELECT o_custkey, arg_min(o_orderkey, (-score, o_orderkey)) AS representative, max(score) AS score, count(*) AS cluster_size FROM s GROUP BY 1""",
)
def w1(spark, d):
    return scored(spark, d).groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct(-F.col("score"), F.col("o_orderkey"))).alias("representative"), F.max("score").alias("score"), F.count(F.lit(1)).alias("cluster_size")
    )


def _items(spark, d):
    """Clusters of a customer's findings as review items; a segment of customers is a run."""
    exempt = decisions.always_review(F.col("overrides"))
    items = scored(spark, d).groupBy("o_custkey", "o_orderpriority").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("cluster_size"), F.bool_or(exempt & (F.col("o_orderkey") % 50 == 0)).alias("exempt")
    )
    path = F.concat_ws("/", F.lpad(F.col("o_custkey").cast("string"), 9, "0"), "o_orderpriority")
    return items.withColumn("run", F.col("o_custkey") % 200).withColumn("path", path)


@query("a19_review_queue")
def a19(spark, d):
    """The review queue: clusters by score and path, and which of them the run's budget defers."""
    return windows.greedy_budget(_items(spark, d), "run", "score", "path", "cluster_size", "exempt", 30.0, 25)


@query(
    "w2_greedy_budget",
    f"""WITH RECURSIVE s AS (SELECT *, {_SCORE} AS score FROM orders),
      i AS (SELECT o_custkey, o_orderpriority, max(score) AS score, count(*) AS cluster_size, bool_or(o_orderpriority LIKE '1%' AND o_orderkey % 50 = 0) AS exempt FROM s GROUP BY 1, 2),
      n AS (SELECT *, o_custkey % 200 AS run, lpad(o_custkey::VARCHAR, 9, '0') || '/' || o_orderpriority AS path FROM i),
      k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY -score, path) AS pos, sum(cluster_size) OVER (PARTITION BY run) AS total FROM n),
      b AS (SELECT *, greatest(1, CAST(round_even(total * 30.0::DOUBLE / 100, 0) AS BIGINT)) AS allowed FROM k),
      f AS (SELECT run, pos, path, NOT exempt AND (score < 25 OR cluster_size > allowed) AS deferred, CASE WHEN NOT exempt AND (score < 25 OR cluster_size > allowed) THEN 0 ELSE cluster_size END AS spent FROM b WHERE pos = 1
            UNION ALL SELECT b.run, b.pos, b.path, NOT b.exempt AND (b.score < 25 OR f.spent + b.cluster_size > b.allowed),
              f.spent + CASE WHEN NOT b.exempt AND (b.score < 25 OR f.spent + b.cluster_size > b.allowed) THEN 0 ELSE b.cluster_size END FROM f JOIN b ON b.run = f.run AND b.pos = f.pos + 1)
      SELECT run, path, deferred FROM f""",
)
def w2(spark, d):
    return a19(spark, d).select("run", "path", "deferred")


@query(
    "a20_queue_summary",
)
def a20(spark, d):
    return a19(spark, d).groupBy("run").agg(
        F.count(F.lit(1)).alias("items"), F.sum("cluster_size").alias("findings"), F.count_if("deferred").alias("deferred"), F.sum(F.col("cluster_size") - 1).alias("collapsed")
    )


_LINE_CASES = """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'actual' WHEN l_returnflag = 'R' THEN 'not_shipped' WHEN l_returnflag = 'A' THEN 'no_direct_call' WHEN l_quantity < 5 THEN 'not_called' WHEN l_quantity < 40 THEN 'undecided' END"""
_LINE_SEVERITY = "CASE WHEN l_discount >= 0.09 THEN 'critical' WHEN l_discount >= 0.06 THEN 'high' WHEN l_discount >= 0.03 THEN 'medium' ELSE 'low' END"


@query(
    "d15_dependency_policy",
    f"""WITH f AS (SELECT *, {_LINE_CASES} AS outcome, {_LINE_SEVERITY} AS severity, CASE WHEN l_shipmode = 0 THEN 'build_only' WHEN l_shipmode = 1 THEN 'image_only' ELSE 'runtime' END AS shipped,
            l_partkey % 11 = 0 AS risk, l_suppkey % 2 = 0 AS proven, CASE l_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS parent, l_orderkey % 5 = 0 AS bridge FROM (SELECT *, l_linenumber % 4 AS l_shipmode FROM lineitem)),
     r AS (SELECT *, coalesce(outcome = 'not_shipped', false) OR shipped = 'build_only' AS bo, outcome IS NOT NULL AND outcome <> 'not_shipped' AND shipped = 'image_only' AS img, severity IN ('critical', 'high') AS severe FROM f),
     p AS (SELECT CASE WHEN l_tax = 0.08 THEN 'version_unclear' WHEN bo AND risk THEN 'build_risk' WHEN img AND risk THEN 'image_only_build_risk' WHEN img THEN 'image_only' WHEN outcome = 'not_called' THEN 'lsp_not_called'
       WHEN outcome = 'actual' AND proven THEN 'actual' WHEN bo THEN 'build_only' WHEN NOT parent AND severe THEN 'bridge_no_path_severe' WHEN NOT parent THEN 'bridge_no_path' WHEN bridge AND parent IS NULL THEN 'bridge_unchecked'
       WHEN outcome = 'actual' THEN 'model_called' WHEN outcome = 'no_direct_call' AND parent THEN 'model_parent_calls' WHEN outcome = 'no_direct_call' THEN 'call_path_unproven' ELSE 'model' END AS rule FROM r)
     SELECT rule, count(*) AS n FROM p GROUP BY 1""",
)
def d15(spark, d):
    sev = F.expr(_LINE_SEVERITY)
    kind = F.col("l_linenumber") % 4
    shipped = F.when(kind == 0, "build_only").when(kind == 1, "image_only").otherwise("runtime")
    parent = F.when(F.col("l_orderkey") % 3 == 0, True).when(F.col("l_orderkey") % 3 == 1, False)
    policy = decisions.dependency_policy(
        F.expr(_LINE_CASES), shipped, sev, F.col("l_tax") != 0.08, F.col("l_partkey") % 11 == 0, F.col("l_suppkey") % 2 == 0, parent, F.col("l_orderkey") % 5 == 0, F.lit(""), F.lit(False), F.lit(False)
    )
    return table(spark, d, "lineitem").select(policy["rule"].alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d16_model_priority",
    f"""WITH f AS (SELECT o_orderkey, {_ORDER_VERDICT} AS label, {_SEVERITY} AS severity, CASE o_custkey % 3 WHEN 0 THEN 'present_unproven' WHEN 1 THEN 'call_unconfirmed' ELSE 'undecided' END AS outcome FROM orders)
        SELECT o_orderkey, CASE WHEN label = 'false_positive' THEN 'none' WHEN label = 'unknown' THEN 'medium' WHEN outcome = 'present_unproven' THEN CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE 'medium' END
          WHEN outcome = 'call_unconfirmed' THEN CASE WHEN severity IN ('critical', 'high') THEN 'medium' ELSE 'low' END ELSE 'medium' END AS priority FROM f""",
)
def d16(spark, d):
    m = F.col("o_custkey") % 3
    outcome = F.when(m == 0, "present_unproven").when(m == 1, "call_unconfirmed").otherwise("undecided")
    return scored(spark, d).select("o_orderkey", decisions.model_priority(F.col("verdict"), outcome, F.col("severity"), F.lit("import")).alias("priority"))


@query(
    "d12_measured_confidence",
    """WITH f AS (SELECT doc_id, doc_id % 3 AS g, doc_id % 5 AS u, doc_id % 2 = 0 AS flow, doc_id % 7 = 0 AS cor, (doc_id % 4) / 4.0::DOUBLE AS ag, (doc_id % 6) / 6.0::DOUBLE AS op FROM documents),
       s AS (SELECT *, 0.5::DOUBLE + CASE WHEN g >= 2 THEN 0.15 WHEN g = 1 THEN 0.08 ELSE -0.15 END::DOUBLE - 0.1::DOUBLE * least(u, 3) + CASE WHEN flow THEN 0.1 ELSE 0.05 END::DOUBLE
          + CASE WHEN cor THEN 0.1 ELSE 0 END::DOUBLE + least(0.15::DOUBLE, ag * 0.2::DOUBLE) - least(0.25::DOUBLE, op * 0.3::DOUBLE) AS x FROM f),
       c AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN least(x, 0.45::DOUBLE) ELSE x END AS y FROM s)
       SELECT doc_id, greatest(0.05::DOUBLE, least(0.95::DOUBLE, round_even(CASE WHEN doc_id % 13 = 0 THEN least(y, 0.6::DOUBLE) ELSE y END, 2))) AS confidence FROM c""",
)
def d12(spark, d):
    i = F.col("doc_id")
    no = F.lit(False)
    score = decisions.measured_confidence(i % 3, i % 5, i % 2 == 0, F.lit(True), i % 7 == 0, (i % 4) / 4, (i % 6) / 6, i % 11 == 0, no, no, no, i % 13 == 0)
    return table(spark, d, "documents").select("doc_id", score.alias("confidence"))


@query(
    "d13_closure_confidence",
    """SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 0.85 ELSE 0.45 END ELSE 0.5 END::DOUBLE AS confidence FROM orders""",
)
def d13(spark, d):
    m = F.col("o_custkey") % 3
    outcome = F.when(m == 0, "version_unaffected").when(m == 1, "not_reached").otherwise("something else")
    return table(spark, d, "orders").select("o_orderkey", scores.closure_confidence(outcome, F.col("o_orderkey") % 2 == 0).alias("confidence"))


@query("d5_confidence_policy", "SELECT event_id, CASE WHEN event_type = 'error' THEN true ELSE coalesce(value / 100, 0) <= 0.86 END AS person FROM events")
def d5(spark, d):
    verdict = F.when(F.col("event_type") == "error", "unknown").otherwise("confirmed")
    return table(spark, d, "events").select("event_id", decisions.confidence_policy(verdict, F.col("value") / 100).alias("person"))


@query(
    "d19_exploit_rank",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 50 = 0 THEN 'known_exploited' WHEN l_returnflag = 'R' THEN 'unknown' WHEN l_discount >= 0.10 OR l_tax >= 0.08 THEN 'high' WHEN l_discount >= 0.01 THEN 'medium' ELSE 'low' END AS rank FROM lineitem""",
)
def d19(spark, d):
    epss = F.when(F.col("l_returnflag") != "R", F.col("l_discount"))
    percentile = F.when(F.col("l_tax") >= 0.08, 0.95).otherwise(0.1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.exploit_rank(F.col("l_partkey") % 50 == 0, epss, percentile).alias("rank"))


@query(
    "d4_post_validation",
    """WITH p AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'confirmed' ELSE 'false_positive' END AS v, n_chars < 300 AS a, contains(text, '|') AS b, l.toxic = 1 AS c FROM documents d JOIN labels l USING (doc_id))
       SELECT doc_id, CASE WHEN a OR b AND v = 'confirmed' OR c THEN 'unknown' ELSE v END AS verdict,
         CASE WHEN a THEN 'no_evidence' WHEN b AND v = 'confirmed' THEN 'contradictory_trace' WHEN c THEN 'sanity_conflict' END AS override FROM p""",
)
def d4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.contains("text", F.lit("|")).alias("pipes"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").withColumn("verdict", F.when(F.col("quality") == 1, "confirmed").otherwise("false_positive"))
    rows = rows.withColumn("overrides", F.array().cast("array<string>"))
    steps = [("no_evidence", F.col("n_chars") < 300), ("contradictory_trace", F.col("pipes") & (F.col("verdict") == "confirmed")), ("sanity_conflict", F.col("toxic") == 1)]
    for name, when in steps:
        verdict, overrides = decisions.downgrade(F.col("verdict"), F.col("overrides"), when, F.lit(name))
        rows = rows.withColumns({"verdict": verdict, "overrides": overrides})
    return rows.select("doc_id", "verdict", F.get("overrides", F.lit(0)).alias("override"))


@query(
    "d22_second_pass_merge",
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'unknown' WHEN quality = 1 THEN 'confirmed' ELSE 'false_positive' END AS verdict FROM labels""",
)
def d22(spark, d):
    first = F.when(F.col("quality") == 1, "confirmed").otherwise("false_positive")
    refuted = (first == "confirmed") & (F.col("toxic") == 1)
    return table(spark, d, "labels").select("doc_id", F.when(refuted, "unknown").otherwise(first).alias("verdict"))


@query(
    "d10_deployment_mismatch",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bkernel\b') THEN 'kernel' WHEN regexp_matches(text, '(?i)\b(ssh|ftp)\b') THEN 'remote shell' WHEN regexp_matches(text, '(?i)\bwindows\b') THEN 'windows' END AS subject FROM documents""",
)
def d10(spark, d):
    from ..operators.filters import first_matching

    subjects = {"kernel": r"(?i)\bkernel\b", "remote shell": r"(?i)\b(ssh|ftp)\b", "windows": r"(?i)\bwindows\b"}
    return table(spark, d, "documents").select("doc_id", first_matching(F.col("text"), subjects).alias("subject"))
