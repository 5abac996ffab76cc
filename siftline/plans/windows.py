"""Window rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from .registry import query, table


@query("w4_first_per_fingerprint", "SELECT md5(text) AS fingerprint, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def w4(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"))


@query(
    "w5_method_spans",
    """SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, 1000) AS "end" FROM conversations WHERE role = 'user'""",
)
def w5(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lit(1000).cast("long").alias("lines"))
    return windows.spans(rows, ["conv_id"], "turn", "lines").select("conv_id", "turn", "end")


@query(
    "w6_enclosing_declaration",
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS declaration FROM events""",
)
def w6(spark, d):
    from ..operators.joins import as_of

    rows = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return as_of(rows, ["user_id"], "at", F.when(F.col("event_type") == "signup", F.col("event_id")), "declaration").select("event_id", "declaration")


@query(
    "w7_block_forward_fill",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
       h AS (SELECT doc_id, pos, last_value(CASE WHEN length(line) < 40 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS header FROM l)
       SELECT doc_id, header, count(*) AS lines FROM h GROUP BY 1, 2""",
)
def w7(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    header = F.when(F.length("line") < 40, F.col("pos"))
    filled = windows.fill_forward(lines, ["doc_id"], "pos", header, "header")
    return filled.groupBy("doc_id", F.col("header").cast("long").alias("header")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "w8_source_and_sink",
    """SELECT conv_id, coalesce(min(turn) FILTER (role = 'user'), min(turn)) AS source, coalesce(max(turn) FILTER (role = 'assistant'), max(turn)) AS sink FROM conversations GROUP BY 1""",
)
def w8(spark, d):
    first = F.min(F.when(F.col("role") == "user", F.col("turn")))
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(first, F.min("turn")).alias("source"), F.coalesce(last, F.max("turn")).alias("sink"))


@query(
    "w9_placement_offset",
    """SELECT doc_id, coalesce(sum(n_chars + 1) OVER (PARTITION BY source, lang, doc_id % 64 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents""",
)
def w9(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", (F.col("doc_id") % 64).alias("file"))
    return windows.running_offset(rows, ["source", "lang", "file"], "doc_id", F.col("n_chars") + 1).select("doc_id", "offset")


@query("w3_per_seed_cap", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 20")
def w3(spark, d):
    rows = table(spark, d, "documents").select("lang", "source", "doc_id", "n_chars")
    return windows.cap(rows, ["lang", "source"], [F.col("n_chars").desc(), F.col("doc_id")], 20).select("lang", "doc_id")


@query("w10_walk_reuse", "SELECT l_orderkey, l_linenumber, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey) AS walk FROM lineitem")
def w10(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = rows.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("walk"))
    return rows.join(first, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "walk")
