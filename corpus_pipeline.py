"""The corpus pipeline: quality classifier, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again as the next
one's ``docs``. All but the last return the columns of ``documents``, whatever else they are named.

Documents are told apart by id *and* text: rows that share an id are judged each by its own text, and so are rows
without an id. Of rows alike in both one is left. A null text counts as the empty one: a document like any other, whose copies go.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm import exact_dedup, ngram_join, packing, quality, tokens
from siftline.llm.common import shared_dir, table, written


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``dropped`` (doc_id, check)."""
    dropped = dropped.select(F.col("doc_id").alias("id"), F.col("check").alias("hash")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(dropped, docs["doc_id"].cast("long").eqNullSafe(dropped["id"]) & (text_hash == dropped["hash"]), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scores = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.where(~F.col("good")))


def _one_of_alike(docs: DataFrame) -> DataFrame:
    """``docs`` with one of the rows that share their id and text; null and empty text are one text."""
    own, text_hash = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    repeated = docs.groupBy(own.alias("id"), text_hash.alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "hash")
    if repeated.isEmpty():
        return docs
    alike = own.eqNullSafe(repeated["id"]) & (text_hash == repeated["hash"])
    of = Window.partitionBy(own, text_hash).orderBy(F.lit(0))
    again = docs.join(repeated, alike, "left_semi").withColumn(name := _free(docs, "copy"), F.row_number().over(of)).where(F.col(name) == 1).drop(name)
    return docs.join(repeated, alike, "left_anti").unionByName(again)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` has not."""
    while name in docs.columns:
        name += "_"
    return name


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with most code points, then the smallest id.

    Where several rows of the id that stays hold the text, or no row has an id, the one with most code points stays, then the one of the least hash.
    """
    # Read again by each of the steps below.
    groups = written(exact_dedup.exact_groups(docs).select("doc_id", "text_sha256", "kept", "check"))
    kept = _without(docs, groups.where(~F.col("kept")))
    same = written(groups.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("check").alias("forms")).where("rows > 1"))
    if same.isEmpty():
        return kept
    several = same.where("forms > 1").alias("s")
    texts = groups.where("kept").select("doc_id", "text_sha256", "check").distinct().alias("g").join(several, F.expr("g.doc_id <=> s.doc_id and g.text_sha256 = s.text_sha256"), "left_semi")
    text = F.coalesce("text", F.lit(""))
    forms = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("size"), F.xxhash64(text).alias("check")).distinct().alias("f")
    sized = texts.join(forms, F.expr("g.doc_id <=> f.doc_id and g.check = f.check")).select("g.doc_id", "g.text_sha256", "g.check", "f.size")
    rank = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("size"), "check"))
    return _one_of_alike(_without(kept, sized.withColumn("rank", rank).where("rank > 1")))


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that five-word shingles link at a Jaccard similarity of 0.8 or more.

    The join takes rows of one id as one document. So where an id is missing or comes more than once, its rows go
    by a hash of id and text instead, above all ids in use, so that a document with an id of its own stays rather than one without. Where ids
    leave no room for that (the largest is beyond half of the range), all rows go by their hash.
    """
    name = _free(docs, "row_id")
    repeated = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select("id")
    if repeated.isEmpty():
        named = docs.withColumn(name, F.col("doc_id").cast("long"))
    else:
        docs = _one_of_alike(docs)
        own = docs["doc_id"].cast("long")
        top = docs.agg(F.max(own)).first()[0] or 0
        hashed = F.xxhash64(own, F.coalesce(docs["text"], F.lit("")))
        if top >= 1 << 62:
            named = docs.withColumn(name, hashed)
        else:
            hashed = F.lit(top + 1) + F.pmod(hashed, F.lit((1 << 63) - 1 - max(top, 0)))
            named = docs.join(repeated, own.eqNullSafe(repeated["id"]), "left")
            is_repeated = repeated["id"].isNotNull() | docs["doc_id"].isNull()
            named = named.select(*(docs[c] for c in docs.columns), F.when(is_repeated, hashed).otherwise(own).alias(name))
    groups = ngram_join.near_duplicates(named, words=5, num=80, den=100, id_col=name)
    dropped = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("dropped"))
    return named.join(dropped, named[name] == dropped["dropped"], "left_anti").drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), end_id=0)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_near_copy),
    ("best-fit packing", pack),
]

#: The classifier is fitted, the join closes links and packing is a heuristic: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{folder}/{k}")
    return docs
