"""Aggregations, orders and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import aggregates as agg
from .filters import _ORDER_VERDICT, verdicts
from .registry import query, table


@query(
    "a1_richest_duplicate",
    """SELECT md5(text) AS key, arg_min(doc_id, (-n_chars, doc_id)) AS kept, count(*) AS n FROM documents GROUP BY 1""",
)
def a1(spark, d):
    rows = table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "n_chars")
    best = agg.best_by(rows, ["key"], [-F.col("n_chars"), F.col("doc_id")], ["doc_id"])
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return best.join(sizes, "key").select("key", F.col("doc_id").alias("kept"), "n")


@query(
    "a2_cross_scanner_merge",
    """WITH g AS (SELECT user_id, date_trunc('hour', ts) AS h, arg_min(event_type, (-value, event_id)) AS prime, list(DISTINCT event_type) AS kinds FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
       SELECT user_id, epoch_us(h) AS hour_us, prime, list_sort(list_filter(kinds, lambda k: k <> prime)) AS corroborated_by FROM g""",
)
def a2(spark, d):
    rows = table(spark, d, "events").where("value is not null").withColumn("h", F.date_trunc("hour", "ts"))
    grouped = rows.groupBy("user_id", "h").agg(
        F.min_by("event_type", F.struct(-F.col("value"), F.col("event_id"))).alias("prime"), F.array_sort(F.collect_set("event_type")).alias("kinds")
    )
    return grouped.select("user_id", F.unix_micros("h").alias("hour_us"), "prime", F.array_except("kinds", F.array("prime")).alias("corroborated_by"))


_LABELLED = """SELECT d.doc_id, d.lang, d.source, CASE WHEN l.quality = 1 THEN 'confirmed' ELSE 'false_positive' END AS truth,
  CASE WHEN n_chars < 300 THEN 'unknown' WHEN contains(text, '|') OR contains(text, '!!') THEN 'false_positive' ELSE 'confirmed' END AS verdict
  FROM documents d JOIN labels l USING (doc_id)"""
_CARD = """count(*) AS total, count(*) FILTER (verdict <> 'unknown') AS decided, count(*) FILTER (verdict = truth) AS agree_all,
  count(*) FILTER (verdict = truth AND verdict <> 'unknown') AS agree_decided, count(*) FILTER (verdict = 'unknown') AS unknown,
  count(*) FILTER (truth = 'confirmed' AND verdict = 'false_positive') AS dangerous_misses, count(*) FILTER (truth = 'false_positive' AND verdict = 'confirmed') AS false_alarms"""
_SHARES = """round_even(100.0::DOUBLE * agree_all / total, 1) AS agreement_all, CASE WHEN decided > 0 THEN round_even(100.0::DOUBLE * agree_decided / decided, 1) END AS agreement_decided,
  round_even(100.0::DOUBLE * unknown / total, 1) AS abstention_rate"""


def _labelled(spark, d):
    truth = F.when(F.col("quality") == 1, "confirmed").otherwise("false_positive")
    verdict = F.when(F.col("n_chars") < 300, "unknown").when(F.contains("text", F.lit("|")) | F.contains("text", F.lit("!!")), "false_positive").otherwise("confirmed")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", verdict.alias("verdict"))
    return docs.join(table(spark, d, "labels").select("doc_id", truth.alias("truth")), "doc_id")


@query("a4_scorecard", f"WITH c AS (SELECT {_CARD} FROM ({_LABELLED})) SELECT *, {_SHARES} FROM c")
def a4(spark, d):
    return agg.scorecard(_labelled(spark, d), "verdict", "truth")


@query("a5_scorecard_by_class", f"WITH c AS (SELECT lang, {_CARD} FROM ({_LABELLED}) GROUP BY 1) SELECT *, {_SHARES} FROM c")
def a5(spark, d):
    return agg.scorecard(_labelled(spark, d), "verdict", "truth", ["lang"])


@query("a6_scorecard_by_kind", f"WITH c AS (SELECT source, {_CARD} FROM ({_LABELLED}) GROUP BY 1) SELECT *, {_SHARES} FROM c")
def a6(spark, d):
    return agg.scorecard(_labelled(spark, d), "verdict", "truth", ["source"])


@query(
    "a7_calibration_bands",
    f"""SELECT CASE WHEN doc_id % 100 >= 75 THEN 'high' WHEN doc_id % 100 >= 50 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, count(*) FILTER (verdict = truth) AS correct
        FROM ({_LABELLED}) WHERE verdict <> 'unknown' GROUP BY 1""",
)
def a7(spark, d):
    band = scores.confidence_band((F.col("doc_id") % 100) / 100)
    rows = _labelled(spark, d).where("verdict <> 'unknown'")
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == F.col("truth")).alias("correct"))


@query(
    "a8_index_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
       SELECT event_type, max(CASE WHEN k = n // 2 THEN value END) AS p50, max(CASE WHEN k = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN value END) AS p95, max(value) AS max, max(n) AS n FROM r GROUP BY 1""",
)
def a8(spark, d):
    return agg.index_percentiles(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value")


@query(
    "a10_run_summary",
    f"""WITH v AS (SELECT *, {_ORDER_VERDICT} AS verdict FROM orders)
        SELECT count(*) AS total, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'false_positive') AS auto_closed, count(*) FILTER (verdict = 'unknown') AS unknown,
               count(*) FILTER (o_orderkey % 97 = 0) AS errors, count(*) FILTER (o_orderpriority LIKE '1%') AS overridden,
               round_even(100.0::DOUBLE * count(*) FILTER (verdict = 'false_positive') / count(*), 1) AS noise_reduction_pct FROM v""",
)
def a10(spark, d):
    v = F.col("verdict")
    out = verdicts(spark, d).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v == "confirmed").alias("confirmed"), F.count_if(v == "false_positive").alias("auto_closed"),
        F.count_if(v == "unknown").alias("unknown"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.size("overrides") > 0).alias("overridden"),
    )
    return out.withColumn("noise_reduction_pct", scores.percent(F.col("auto_closed"), F.col("total")))


@query(
    "a11_class_by_verdict",
    f"""SELECT o_orderpriority, count(*) FILTER (v = 'confirmed') AS confirmed, count(*) FILTER (v = 'false_positive') AS false_positive, count(*) FILTER (v = 'unknown') AS unknown
        FROM (SELECT *, {_ORDER_VERDICT} AS v FROM orders) GROUP BY 1""",
)
def a11(spark, d):
    pivoted = verdicts(spark, d).groupBy("o_orderpriority").pivot("verdict", ["confirmed", "false_positive", "unknown"]).agg(F.count(F.lit(1)))
    return pivoted.na.fill(0, ["confirmed", "false_positive", "unknown"])


@query(
    "a12_fixed_domain_counts",
    """WITH d AS (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus, unnest([0, 1, 2, 3]) AS ordinal)
       SELECT ordinal, o_orderstatus, count(o_orderkey) AS n FROM d LEFT JOIN orders USING (o_orderstatus) GROUP BY 1, 2""",
)
def a12(spark, d):
    return agg.fixed_domain_counts(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("a13_stage_seconds", "SELECT event_type AS stage, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def a13(spark, d):
    timings = table(spark, d, "events").where("value is not null").select(F.create_map("event_type", "value").alias("timings"))
    return timings.select(F.explode("timings").alias("stage", "seconds")).groupBy("stage").agg(F.round(F.sum("seconds"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    "a14_confidence_spread",
    """SELECT event_type, count(value) AS n, CASE WHEN count(value) >= 5 THEN round(stddev_pop(value), 6) END AS spread, count(DISTINCT value) AS distinct_values FROM events GROUP BY 1""",
)
def a14(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("value").alias("n"), F.when(F.count("value") >= 5, F.round(F.stddev_pop("value"), 6)).alias("spread"), F.count_distinct("value").alias("distinct_values")
    )


@query(
    "a15_coverage",
    """SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (event_type = 'error')) AS failed, NOT bool_or(event_type = 'error') AS complete FROM events GROUP BY 1""",
)
def a15(spark, d):
    error = F.col("event_type") == "error"
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(error, F.col("event_type")))).alias("f"), (~F.bool_or(error)).alias("complete"))
    return rows.select("user_id", F.when(F.size("f") > 0, F.col("f")).alias("failed"), "complete")


@query(
    "a17_upgrade_plan",
    """WITH r AS (SELECT DISTINCT l_partkey AS package, l_suppkey AS advisory FROM lineitem),
       f AS (SELECT package, advisory, CASE WHEN advisory % 4 <> 0 THEN advisory % 3 + 1 END AS a, advisory % 10 AS b FROM r)
       SELECT package, count(*) AS advisories, count(*) FILTER (a IS NULL) AS unfixed, coalesce(max(CASE WHEN a IS NOT NULL THEN a * 100 + b END), 0) AS target,
              coalesce(max(a) > 1, false) AS major,
              CASE WHEN max(a) > 1 THEN coalesce(max(CASE WHEN a = 1 THEN 100 + b END), 0) ELSE 0 END AS same_major,
              CASE WHEN max(a) > 1 THEN count(*) FILTER (a = 1) ELSE 0 END AS same_major_covers FROM f GROUP BY 1""",
)
def a17(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("advisory"), F.col("l_orderkey").alias("ordinal"))
    fix = F.concat_ws(".", (F.col("advisory") % 3 + 1).cast("string"), (F.col("advisory") % 10).cast("string"), F.lit("0"))
    rows = pairs.withColumn("installed", F.lit("1.0.0")).withColumn("verdict", F.lit("unknown")).withColumn("fix", F.when(F.col("advisory") % 4 != 0, fix))
    number = lambda c: F.coalesce(F.regexp_extract(c, r"^(\d+)", 1).try_cast("int") * 100 + F.regexp_extract(c, r"^\d+\.(\d+)", 1).try_cast("int"), F.lit(0))
    plan = agg.upgrade_plan(rows)
    return plan.select("package", "advisories", "unfixed", number("target").alias("target"), "major", number("same_major").alias("same_major"), "same_major_covers")


@query("a18_image_hygiene", "SELECT DISTINCT p_brand FROM part WHERE p_size > 40")
def a18(spark, d):
    return table(spark, d, "part").where("p_size > 40").select("p_brand").distinct()


@query("a21_reuse_counts", f"SELECT {_ORDER_VERDICT} AS reason, count(*) AS n FROM orders GROUP BY 1")
def a21(spark, d):
    return verdicts(spark, d).groupBy(F.col("verdict").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a22_all_or_null_sums",
    "SELECT l_suppkey, CASE WHEN count(*) FILTER (l_returnflag = 'R' AND l_discount = 0.1) = 0 THEN round(sum(l_tax), 4) END AS cost FROM lineitem GROUP BY 1",
)
def a22(spark, d):
    cost = F.when(~((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1)), F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(agg.all_or_null_sum(cost), 4).alias("cost"))


@query(
    "a23_kind_tallies",
    f"""SELECT o_orderpriority AS kind, count(*) FILTER ({_ORDER_VERDICT} = 'confirmed') AS confirmed, count(*) FILTER ({_ORDER_VERDICT} = 'unknown') AS unknown, count(*) AS total FROM orders GROUP BY 1""",
)
def a23(spark, d):
    v = F.col("verdict")
    return verdicts(spark, d).groupBy(F.col("o_orderpriority").alias("kind")).agg(
        F.count_if(v == "confirmed").alias("confirmed"), F.count_if(v == "unknown").alias("unknown"), F.count(F.lit(1)).alias("total")
    )


@query(
    "a24_directory_rollup",
    r"""WITH p AS (SELECT string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS s FROM pages), e AS (SELECT s, unnest(range(1, len(s))) AS n FROM p)
       SELECT array_to_string(s[1:n], '/') AS directory, count(*) AS files FROM e GROUP BY 1""",
)
def a24(spark, d):
    return agg.prefix_rollup(table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path")), "path")


@query("a25_auto_decide", f"SELECT round_even(100.0::DOUBLE * count(*) FILTER ({_ORDER_VERDICT} <> 'unknown') / count(*), 1) AS auto_pct FROM orders")
def a25(spark, d):
    return verdicts(spark, d).agg(scores.percent(F.count_if(F.col("verdict") != "unknown"), F.count(F.lit(1))).alias("auto_pct"))


@query("a27_target_batches", "SELECT l_suppkey, count(DISTINCT l_partkey) AS functions FROM lineitem GROUP BY 1")
def a27(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("functions"))


@query("a28_language_tally", "SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS size FROM documents GROUP BY 1")
def a28(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("size"))


@query("a26_flow_index", "SELECT conv_id, count(*) AS steps FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1 HAVING count(*) >= 2")
def a26(spark, d):
    rows = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps")).where("steps >= 2")


@query(
    "a9_provider_comparison",
    f"""WITH c AS (SELECT source, {_CARD} FROM ({_LABELLED}) GROUP BY 1), s AS (SELECT *, {_SHARES} FROM c)
        SELECT source, rank() OVER (ORDER BY coalesce(agreement_decided, 0) DESC, dangerous_misses) AS place FROM s""",
)
def a9(spark, d):
    from pyspark.sql import Window

    cards = agg.scorecard(_labelled(spark, d), "verdict", "truth", ["source"])
    # One row per provider.
    order = Window.orderBy(F.coalesce("agreement_decided", F.lit(0.0)).desc(), "dangerous_misses")
    return cards.select("source", F.rank().over(order).cast("long").alias("place"))


@query("u1_union_of_inputs", "SELECT 'event' AS origin, count(*) AS n FROM events UNION ALL SELECT 'page', count(*) FROM pages UNION ALL SELECT 'turn', count(*) FROM conversations")
def u1(spark, d):
    events = table(spark, d, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), "url")
    turns = table(spark, d, "conversations").select(F.lit("turn").alias("origin"), F.col("conv_id").alias("id"), "role")
    both = events.unionByName(pages, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("u3_declared_prod", "SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def u3(spark, d):
    dev = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).distinct().join(dev, "nation", "left_anti")


@query("u4_dropped_roots", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def u4(spark, d):
    declared = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey").join(declared, "n_nationkey", "left_anti")


@query(
    "u5_ordered_union",
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, list(event_type ORDER BY seen) AS kinds FROM f GROUP BY 1""",
)
def u5(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda s: s["event_type"])
    return first.groupBy("user_id").agg(ordered.alias("kinds"))


@query("o5_run_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def o5(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("o4_hit_caps", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 25")
def o4(spark, d):
    from ..operators.windows import cap

    return cap(table(spark, d, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 25)
