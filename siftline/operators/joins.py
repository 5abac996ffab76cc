"""Joins that keep order rules explicit: first alias, longest prefix, nearest before, every part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_alias(df: DataFrame, key: str, aliases: str, catalogue: DataFrame, alias: str, values: list[str]) -> DataFrame:
    """For each row the values of the first of its aliases that the catalogue has, else nulls."""
    exploded = df.select(key, F.posexplode(aliases).alias("_pos", alias))
    found = exploded.join(catalogue.select(alias, *values), alias)
    best = found.groupBy(key).agg(F.min_by(F.struct(*values), "_pos").alias("_v"))
    return df.join(best, key, "left").select(*df.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def prefixes(path: Column) -> Column:
    """A path and all paths above it, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def suffixes(path: Column) -> Column:
    """A path and its ends, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.concat_ws("/", F.slice(parts, F.size(parts) - n + 1, n)))


def longest_prefix(df: DataFrame, key: str, path: str, catalogue: DataFrame, prefix: str, value: str) -> DataFrame:
    """For each row the value of the longest catalogued prefix of its path, by an equi join on the exploded prefixes."""
    found = df.select(key, F.posexplode(prefixes(F.col(path))).alias("_pos", prefix)).join(catalogue.select(prefix, value), prefix)
    best = found.groupBy(key).agg(F.min_by(F.struct(prefix, value), "_pos").alias("_v"))
    return df.join(best, key, "left").select(*df.columns, F.col(f"_v.{prefix}").alias(prefix), F.col(f"_v.{value}").alias(value))


def resolve_suffix(df: DataFrame, key: str, path: str, tree: DataFrame, tree_path: str) -> DataFrame:
    """The tree path that a reported path means: the longest of its ends that is one; ties by name."""
    ends = df.select(key, F.posexplode(suffixes(F.col(path))).alias("_pos", "_end"))
    whole = tree.select(F.col(tree_path).alias("_end"), F.col(tree_path).alias("resolved"))
    best = ends.join(whole, "_end").groupBy(key).agg(F.min(F.struct("_pos", "resolved"))["resolved"].alias("resolved"))
    return df.join(best, key, "left")


def unique_suffix(df: DataFrame, key: str, name: str, version: str, catalogue: DataFrame, full: str, full_version: str) -> DataFrame:
    """A bare name becomes the catalogued full name that ends in it if only one does, or only one with the same version."""
    tails = catalogue.select(F.element_at(F.split(full, "/"), -1).alias("_tail"), F.col(full).alias("_full"), F.col(full_version).alias("_v")).distinct()
    found = df.select(key, F.col(name).alias("_tail"), F.col(version).alias("_own")).join(tails, "_tail")
    picked = found.groupBy(key).agg(
        F.count_distinct("_full").alias("_n"),
        F.min("_full").alias("_any"),
        F.count_distinct(F.when(F.col("_v") == F.col("_own"), F.col("_full"))).alias("_m"),
        F.min(F.when(F.col("_v") == F.col("_own"), F.col("_full"))).alias("_same"),
    )
    chosen = F.when(F.col("_n") == 1, F.col("_any")).when(F.col("_m") == 1, F.col("_same"))
    return df.join(picked, key, "left").select(*df.columns, F.coalesce(chosen, F.col(name)).alias("qualified"))


def every_part(parts: DataFrame, hits: DataFrame, group: str, part: str) -> DataFrame:
    """Relational division: whether every part of a group has a hit somewhere. A group without parts is external."""
    seen = hits.select(part).distinct().withColumn("_hit", F.lit(True))
    joined = parts.join(seen, part, "left")
    state = F.when(F.count(part) == 0, "external").when(F.count("_hit") == F.count(part), "holds").otherwise("absent")
    return joined.groupBy(group).agg(F.count(part).alias("parts"), F.count("_hit").alias("found"), state.alias("state"))


def as_of(df: DataFrame, keys: list[str], at: str, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row (backward as-of) within its keys."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def answered(df: DataFrame, key: str, asked: DataFrame, reached: DataFrame) -> DataFrame:
    """Three-valued answer: reached, asked and not reached, or null where nobody asked."""
    a = asked.select(key).distinct().withColumn("_asked", F.lit(True))
    r = reached.select(key).distinct().withColumn("_reached", F.lit(True))
    state = F.when(F.col("_reached"), True).when(F.col("_asked"), False)
    return df.join(a, key, "left").join(r, key, "left").withColumn("reached", state).drop("_asked", "_reached")


def containing(texts: DataFrame, text_id: str, text: str, passages: DataFrame, passage_id: str, passage: str, words: int = 5) -> DataFrame:
    """(text_id, passage_id) of every passage that stands literally in a text.

    A passage may begin and end inside longer words of the text, so its key is made of inner words only: up to
    ``words`` of them, the longest run that it has. Texts are asked for the runs of those lengths that passages really
    have, and only candidates are compared whole. Passages of fewer than three words have no inner word; they are a
    query set that is held against all texts. Null texts and passages match nothing.
    """
    split = F.split(F.col(passage), " ")
    asked = passages.where(F.col(passage).isNotNull()).select(passage_id, passage, split.alias("_words"), F.least(F.size(split) - 2, F.lit(words)).alias("_n"))
    keyed = asked.where("_n > 0").select(passage_id, passage, F.concat_ws(" ", F.slice("_words", F.lit(2), F.col("_n"))).alias("_key"), "_n")
    given = texts.where(F.col(text).isNotNull()).select(text_id, text, F.split(F.col(text), " ").alias("_words"))
    lengths = sorted(r["_n"] for r in keyed.select("_n").distinct().collect())  # at most ``words`` numbers

    def runs(n):
        starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice("_words", i, n)))

    every = F.concat(F.array().cast("array<string>"), *map(runs, lengths))
    met = given.select(text_id, F.explode(F.array_distinct(every)).alias("_key")).join(keyed.select(passage_id, "_key"), "_key").select(text_id, passage_id).distinct()
    sure = met.join(texts.select(text_id, text), text_id).join(asked.select(passage_id, passage), passage_id).where(F.contains(text, F.col(passage)))
    short = asked.where("_n <= 0").select(passage_id, passage)
    held = texts.select(text_id, text).join(short, F.contains(F.col(text), F.col(passage)))
    return sure.select(text_id, passage_id).unionByName(held.select(text_id, passage_id)).distinct()
