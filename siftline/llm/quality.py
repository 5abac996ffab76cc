"""Quality classifier: hierarchical empirical Bayes over a document classifier and its sites.

1. Evidence. On a bounded sample of labelled rows (about ``SAMPLE``, by hash order) words and four-byte sequences, hashed to
   buckets, get log odds by class; a document's mean log odds of both kinds, with shares of byte classes, repetition and
   length, go into a logistic regression. For the sample itself the log odds come from its other half, so that the
   regression learns how far to trust them. A document's evidence is its log odds less those of the sample.
2. Host posteriors. A host's share of good documents is the mean of its documents' posteriors, shrunk to the
   global share by a strength that the hosts themselves give (method of moments); path posteriors are
   shrunk to their host's in the same way. All of it is grouped sums over all documents.
3. Decision. Evidence plus the log odds of the path, from all other documents of the path.

Host is ``source``, path is ``source`` and ``lang``: documents have no address.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salt, shared_dir, slices, table, written
from .shingles import mixed, word_hashes

#: Labelled rows that the document classifier is fitted on, about.
SAMPLE = 20_000
#: Buckets of words, and as many of byte sequences.
BUCKETS = 1 << 15
#: Documents' shares are counted in units of one over this, so that sums are exact in any order.
UNIT = 1 << 30
#: Bytes of text whose features are made together; what that takes is some forty times as much.
TOGETHER = 1 << 20
#: Documents from which a share counts at all, where hosts or paths do not tell how far to shrink.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*@^~=+<>{}[]\\_|!")] = True


def features(text: str) -> list[float]:
    """Length, shares of byte classes, sentence and line rates, repetition; finite for every text."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, w = max(1, len(data)), max(1, len(words))
    distinct = len(set(words)) / w
    return [
        np.log1p(n), counts[_SYMBOLS].sum() / n, counts[48:58].sum() / n, counts[65:91].sum() / n, counts[128:].sum() / n,
        counts[46] / w, counts[44] / w, counts[10] / w, distinct, len(set(lines)) / len(lines), np.log1p(n / w), distinct * np.log1p(w),
    ]


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for four-byte sequences: the buckets of all texts one behind the other, and how many each text has."""
    hashes, counts = word_hashes(texts)
    data = np.frombuffer("\0\0\0".join([*texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    size = np.asarray([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    four = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        four |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    # Sequences that begin inside a text, its end padded by the zeros behind it.
    keep = np.ones(len(data), bool)
    ends = np.cumsum(size + 3)
    for k in (1, 2, 3):
        keep[ends - k] = False
    bucket = lambda h, shift: (h >> shift).astype(np.int32)
    bits = BUCKETS.bit_length() - 1
    return [(bucket(hashes, np.uint64(64 - bits)), counts), (bucket(four[keep[: len(four)]] * np.uint32(0x9E3779B1), np.uint32(32 - bits)), size)]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def all_features(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """A row of features for each text; ``weights`` are the log odds of the buckets, by kind."""
    means = [_sums(w[buckets], counts) / np.maximum(1, counts) for (buckets, counts), w in zip(grams(texts), weights, strict=True)]
    return np.concatenate([np.asarray([features(t) for t in texts]), np.stack(means, axis=1)], axis=1)


#: How many features there are.
FEATURES = len(features("")) + 2


def log_odds(shares: np.ndarray, smooth: float = 1e-2) -> np.ndarray:
    """Log odds of buckets from the shares that bad and good documents give them (last axis but one: class).

    Zero where either class has no document.
    """
    total = shares.sum(axis=-1, keepdims=True)
    spread = np.log(shares + smooth) - np.log(total + smooth * shares.shape[-1])
    odds = spread[..., 1, :] - spread[..., 0, :]
    return np.where((total[..., 0, :] > 0) & (total[..., 1, :] > 0), odds, 0.0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (the last is the intercept) on the raw features, and the log odds of the sample.

    With one class only, the weights are zero and the odds are those of one pseudo-document of each class.
    """
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(set(y.tolist())) < 2:
        return np.append(np.zeros(x.shape[1]), prior), prior
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    pull = ridge * np.append(np.ones(x.shape[1]), 1e-6)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean), prior


def _fitted(rows: DataFrame, marks: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Log odds of the buckets, weights of the regression, and the log odds of the sample."""
    nothing = np.zeros((2, BUCKETS)), np.zeros(FEATURES + 1), 0.0
    there = marks.count()
    if not there:
        return nothing
    share = min(1.0, SAMPLE / there)
    order = F.pmod(F.xxhash64("mark_id", F.lit(3)), F.lit(1 << 30))
    chosen = marks.where(order < int(share * (1 << 30))).select("mark_id", "y", F.pmod(F.xxhash64("mark_id"), F.lit(2)).cast("int").alias("fold"))
    # About SAMPLE rows at most: a broadcast at every size.
    labelled = written(rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["mark_id"]).select("fold", "y", "text"), f"{folder}/labelled")

    def count(batches):
        totals = np.zeros((2, 2, 2, BUCKETS), np.int64)
        for part in slices(batches, 2, TOGETHER):
            fold, y = (part.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            for kind, (buckets, counts) in enumerate(grams(part.column(2).fill_null("").to_pylist())):
                each = np.repeat(UNIT // np.maximum(1, counts), counts)
                np.add.at(totals, (np.repeat(fold, counts), kind, np.repeat(y, counts), buckets), each)
        at = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in at] + [pa.array(totals[at])], names=["fold", "kind", "y", "bucket", "n"])

    # One row for each bucket, class, kind and half; as Arrow columns, which take the driver a tenth of what rows do.
    counted = labelled.mapInArrow(count, "fold int, kind int, y int, bucket int, n long").groupBy("fold", "kind", "y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return nothing
    shares = np.zeros((2, 2, 2, BUCKETS))
    shares[tuple(counted[c].to_numpy() for c in ("fold", "kind", "y", "bucket"))] = counted["n"].to_numpy() / UNIT
    del counted
    odds = log_odds(shares)

    def look(batches):
        for part in slices(batches, 2, TOGETHER):
            fold, texts = part.column(0).to_numpy(), part.column(2).fill_null("").to_pylist()
            x = np.zeros((len(texts), FEATURES))
            for half in (0, 1):
                rows_ = np.flatnonzero(fold == half)
                if len(rows_):
                    # Judged by what the other half says.
                    x[rows_] = all_features([texts[i] for i in rows_], odds[1 - half])
            ends = pa.array(np.arange(len(texts) + 1) * FEATURES, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], names=["y", "x"])

    sample = labelled.mapInArrow(look, "y int, x array<double>").toArrow()
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    weights, prior = fit(x, sample["y"].to_numpy().astype(np.float64))
    return log_odds(shares.sum(axis=0)), weights, prior


def _scored(rows: DataFrame, odds: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id, host, path, check (a hash of the text) and the log odds of each row; texts stay behind."""
    shared = rows.sparkSession.sparkContext.broadcast((odds, weights))

    def run(batches):
        odds, weights = shared.value
        for part in slices(batches, 4, TOGETHER):
            x = all_features(part.column(4).fill_null("").to_pylist(), odds)
            logit = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(logit)], names=["doc_id", "host", "path", "check", "logit"])

    return rows.select("doc_id", "host", "path", "check", "text").mapInArrow(run, "doc_id long, host string, path string, check long, logit double")


def _shrunk(sites: DataFrame, parent: str) -> DataFrame:
    """``sites`` (s good, n documents, parent share) with the strength of their own level.

    Between-site variance by moments: the weighted spread of the shares less what sampling alone gives.
    """
    share = F.col("s") / F.col("n")
    inside = F.col(parent) * (1 - F.col(parent))
    level = sites.agg(
        F.sum("n").alias("all"),
        F.sum(F.col("n") * (share - F.col(parent)) ** 2).alias("spread"),
        F.sum(inside).alias("noise"),
        F.sum(F.col("n") * inside).alias("within"),
        F.sum(F.col("n") * F.col("n")).alias("square"),
    )
    between = (F.col("spread") - F.col("noise")) / F.col("all")
    strength = F.when(between > 0, (F.col("within") / F.col("all")) / between - 1).otherwise(MOST_STRENGTH)
    # One row: broadcast.
    return sites.crossJoin(F.broadcast(level.select(F.least(F.greatest(F.coalesce(strength, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("strength"))))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", ways: int = 64
) -> DataFrame:
    """One row per row of ``docs``: doc_id, check, evidence, host_share, path_share, score (probability of good), good.

    Labels with null ids or null quality are left out; of an id's labels every one counts. Without any label all
    evidence is zero and everything is good. Null text is empty. A null host or path is a site of its own.
    Rows without an id are scored like others, repeated rows each; texts are read whole whatever their length. An
    empty table gives no rows. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("check"),
        F.col(text_col).alias("text"),
    )
    marks = labels.select(F.col("doc_id").cast("long").alias("mark_id"), (F.col("quality") > 0).cast("int").alias("y")).where("mark_id is not null and y is not null")
    odds, weights, prior = _fitted(rows, marks, folder)
    seen = written(_scored(rows, odds, weights), f"{folder}/scored")
    scored = seen.select("doc_id", "host", "path", "check", "logit", salt("check", ways).alias("salt"))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))

    # All sums over hosts and paths; the salted level also leads the shares back to the documents.
    salted = scored.groupBy("salt", "host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"))
    paths = salted.groupBy("host", "path").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = hosts.agg((F.sum("s") / F.sum("n")).alias("global_share"))
    hosts = _shrunk(hosts.crossJoin(F.broadcast(whole)), "global_share")
    host_share = (F.col("s") + F.col("strength") * F.col("global_share")) / (F.col("n") + F.col("strength"))
    paths = _shrunk(paths.join(hosts.select("host", host_share.alias("host_share")), "host"), "host_share")
    back = salted.select("salt", "host", "path").join(paths, ["host", "path"])
    joined = scored.join(back, ["salt", "host", "path"])
    # The share of the document's path as the others tell it.
    path_share = (F.col("s") - F.col("p") + F.col("strength") * F.col("host_share")) / (F.col("n") - 1 + F.col("strength"))
    bounded = F.least(F.greatest(path_share, F.lit(1e-6)), F.lit(1 - 1e-6))
    result = joined.withColumn("path_share", bounded).withColumn("evidence", F.col("logit") - prior)
    log_odds = F.col("evidence") + F.log(F.col("path_share") / (1 - F.col("path_share")))
    return result.select("doc_id", "check", "evidence", "host_share", "path_share", (1 / (1 + F.exp(-log_odds))).alias("score"), (log_odds >= 0).alias("good"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("path_share", 6).alias("path_share"), F.round("score", 6).alias("score"), F.col("good").alias("kept"))
