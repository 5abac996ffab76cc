"""Exact dedup by skew-safe combining, with DataFrame functions only.

Copies are combined three times, each time on digest *and* full normalised text, so two texts
that share a digest are never taken for one:

1. within each task (the partial aggregate of step 2 runs before its shuffle),
2. per (salt, digest, text): a hot text is spread over ``ways`` reducers,
3. per (digest, text): at most ``ways`` rows of each text arrive.

The rows come back by joins whose keys are bounded too: a text has at most ``ways`` salt groups,
and a salt group holds about 1/``ways`` of a text's rows with different ids. On this way back SHA-256 and 64 more hash bits stand
for the text, which need not be shuffled again. No list of a group's ids is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table

#: Reducers over which the copies of one text are spread.
WAYS = 64

# A group's best row as one fixed-width number, so that the aggregates hash instead of sorting whole texts:
# code points * RADIX + (TOP - doc_id); the larger text wins, then the smaller id. A null id comes last, as 0.
RADIX = "100000000000000000000"
TOP = "9223372036854775808"


def _normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ways: int = WAYS) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256, check (xxhash64 of the original text).

    Texts are equal when identical after deleting blanks, tabs and line ends (U+0020, U+0009 to U+000D).
    Of equal texts the one with the most code points stays, then the smallest id.

    Null text counts as empty; all empty texts are one group. A null id takes part, loses every tie, and
    is its own keep_id only where the whole group has no other id. Rows with the same id and text each
    return (both kept, as the id stays). An empty table gives no rows. Other columns of ``docs`` are not
    read, so their names cannot clash.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        _normalised(F.col(text_col)).alias("norm"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("raw"),
    ).select(
        "id",
        "raw",
        "norm",
        F.sha2("norm", 256).alias("digest"),
        # Rows without an id, or with one that many share, are spread by their own text's hash, too.
        F.pmod(F.xxhash64("id", "raw"), F.lit(ways)).cast("int").alias("salt"),
        F.expr(
            f"cast(n as decimal(10,0)) * cast({RADIX} as decimal(21,0))"
            f" + coalesce(cast({TOP} as decimal(20,0)) - cast(id as decimal(20,0)), cast(0 as decimal(20,0)))"
        ).cast("decimal(38,0)").alias("rank"),
    )
    salted = rows.groupBy("salt", "digest", "norm").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    best = salted.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("size").alias("size"))
    # Which of the texts of one digest: always 0, unless SHA-256 collides.
    best = best.select("digest", "rank", "size", F.xxhash64("norm").alias("check"))
    # The way back needs no texts: which salts a text has comes from its members' keys alone.
    members = rows.select("id", "raw", "salt", "digest", F.xxhash64("norm").alias("check"))
    groups = members.select("salt", "digest", "check").distinct().join(best, ["digest", "check"])
    offset = F.expr(f"rank % cast({RADIX} as decimal(21,0))")
    joined = members.join(groups, ["salt", "digest", "check"]).withColumn(
        "keep",
        F.when(offset != 0, (F.lit(TOP).cast("decimal(20,0)") - offset).cast("long")),
    )
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("raw").alias("check"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("check")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
