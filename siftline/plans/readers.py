"""Readers' shapes and streams over the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import reports
from ..streaming import journal
from .registry import query, table


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared place the session names; only on one machine that names none, one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/plans-{uuid.uuid4().hex}"


@query(
    "s3_native_reader",
    """SELECT CAST(event_id AS VARCHAR) AS finding_id, event_type AS rule_id, 'k/' || json_extract_string(props, '$.k') AS file_path, CASE WHEN event_type = 'error' THEN 'high' ELSE 'unknown' END AS severity FROM events""",
)
def s3(spark, d):
    row = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("check_id"), F.col("event_type").alias("level"), F.concat(F.lit("k/"), F.get_json_object("props", "$.k")).alias("filename"))
    lines = table(spark, d, "events").select(F.to_json(row).alias("value"))
    return reports.native_findings(lines)[0].select("finding_id", "rule_id", "file_path", "severity")


@query(
    "s2_sarif_reader",
    """SELECT user_id || ':r' AS scanner, event_type AS rule_id, count(*) AS findings FROM events GROUP BY 1, 2""",
)
def s2(spark, d):
    """A SARIF document per event, parsed with the reader's schema and exploded to findings."""
    result = F.struct(F.col("event_type").alias("ruleId"), F.struct(F.col("props").alias("text")).alias("message"))
    run = F.struct(F.struct(F.struct(F.concat("user_id", F.lit(":r")).alias("name")).alias("driver")).alias("tool"), F.array(result).alias("results"))
    text = table(spark, d, "events").select(F.to_json(F.struct(F.array(run).alias("runs"))).alias("value"), F.col("event_id").cast("string").alias("report"))
    raw = text.select("report", F.from_json("value", reports.SARIF)["runs"].alias("runs"))
    return reports.sarif_findings(raw).groupBy("scanner", "rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query("s15_source_lines", "SELECT lang, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY 1")
def s15(spark, d):
    lines = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")))
    return lines.groupBy("lang").agg(F.count_distinct("doc_id").alias("files"), F.count(F.lit(1)).alias("lines"))


@query("s16_label_reader", "SELECT doc_id, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'false_positive' END AS label FROM labels")
def s16(spark, d):
    raw = F.to_json(F.struct(F.col("doc_id").alias("finding_id"), F.when(F.col("quality") == 1, " Confirmed").otherwise("FALSE_POSITIVE ").alias("label")))
    parsed = table(spark, d, "labels").select(F.from_json(raw, "finding_id long, label string").alias("r"))
    return parsed.select(F.col("r.finding_id").alias("doc_id"), F.lower(F.trim("r.label")).alias("label")).where("label is not null")


@query("s17_verdict_log", "SELECT o_orderkey, o_orderstatus FROM orders")
def s17(spark, d):
    """Verdicts written with provenance and read back without it."""
    folder = _folder(spark)
    stamped = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").withColumn("decided_at", F.current_timestamp()).withColumn("prompt_pack", F.lit("p1"))
    stamped.write.json(folder)
    return spark.read.schema("o_orderkey long, o_orderstatus string, decided_at timestamp, prompt_pack string").json(folder).drop("decided_at", "prompt_pack")


@query("s20_report_health", "SELECT CAST(event_id AS VARCHAR) AS report, 1 AS results, event_type <> 'error' AS healthy FROM events")
def s20(spark, d):
    result = F.struct(F.col("event_type").alias("ruleId"))
    ok = F.struct((F.col("event_type") != "error").alias("executionSuccessful"))
    run = F.struct(F.array(ok).alias("invocations"), F.array(result).alias("results"))
    text = table(spark, d, "events").select(F.col("event_id").cast("string").alias("report"), F.to_json(F.struct(F.array(run).alias("runs"))).alias("value"))
    return reports.report_health(text.select("report", F.from_json("value", reports.SARIF)["runs"].alias("runs")))


@query("t1_journal_append", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'confirmed' ELSE 'unknown' END AS verdict FROM events")
def t1(spark, d):
    folder = _folder(spark)
    table(spark, d, "events").write.parquet(f"{folder}/in")
    stream = journal.arriving(spark, f"{folder}/in", table(spark, d, "events").schema, 1)
    decided = stream.select("event_id", F.when(F.col("event_type") == "error", "confirmed").otherwise("unknown").alias("verdict"))
    journal.append_journal(decided, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("event_id long, verdict string, decided_at timestamp").parquet(f"{folder}/out").select("event_id", "verdict")


@query("t2_resume", "SELECT event_id FROM events WHERE event_type <> 'error'")
def t2(spark, d):
    events = table(spark, d, "events")
    return journal.recover(events.select("event_id"), events.where("event_type = 'error'").select("event_id"), "event_id")


@query(
    "t3_streamed_reuse",
    """WITH h AS (SELECT user_id, max(value) AS earlier FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id, earlier FROM events LEFT JOIN h USING (user_id) WHERE event_type = 'click'""",
)
def t3(spark, d):
    folder = _folder(spark)
    events = table(spark, d, "events")
    events.write.parquet(f"{folder}/in")
    history = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("earlier"))
    stream = journal.arriving(spark, f"{folder}/in", events.schema, 1).where("event_type = 'click'")
    sink = lambda batch, _: journal.reuse(batch, history, "user_id").select("event_id", "earlier").write.mode("append").parquet(f"{folder}/out")
    journal.run_to_end(stream, sink, f"{folder}/state")
    return spark.read.schema("event_id long, earlier double").parquet(f"{folder}/out")


@query("t4_arrival_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def t4(spark, d):
    folder = _folder(spark)
    events = table(spark, d, "events")
    events.write.parquet(f"{folder}/in")
    stream = journal.arriving(spark, f"{folder}/in", events.schema)
    # Arrivals of one key within a month are one finding; state older than that goes.
    once = journal.first_arrivals(stream, "ts", ["user_id", "event_type"], "31 days").select("user_id", "event_type")
    journal.run_to_end(once, lambda batch, _: batch.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state")
    return spark.read.schema("user_id long, event_type string").parquet(f"{folder}/out")


@query("t5_rolling_counts", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t5(spark, d):
    folder = _folder(spark)
    events = table(spark, d, "events")
    events.write.parquet(f"{folder}/in")
    counts = journal.rolling_counts(journal.arriving(spark, f"{folder}/in", events.schema), "ts", "event_type", "1 hour", "1 day")
    out = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{folder}/out")
    journal.run_to_end(counts, out, f"{folder}/state", "update")
    rows = spark.read.schema("start timestamp, event_type string, n long, batch long").parquet(f"{folder}/out")
    latest = rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return latest.select(F.unix_micros("start").alias("start_us"), "event_type", "n")
