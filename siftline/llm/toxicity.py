"""Toxicity: a counterfactual-regularised classifier over words and their beginnings.

1. Sample. About ``PER_CLASS`` labelled rows of each class, by hash order and weighted back to the shares that all labels have.
2. Features. Whole words and beginnings of three to eight bytes, as hashes; those ``FEATURES`` ones whose presence tells the classes apart best
   (chi squared, counted over the sample by grouped sums).
3. Counterfactuals. In the sample's sentences that name a group of people the name is swapped for others of its kind. What changes between a
   sentence and its swapped form is a vector that should not move the score.
4. Fit. Logistic regression on the chosen features with a ridge and a penalty on the squared change of the log odds over all swaps, by Newton's method.
   A name that labelled insults often come with cannot carry weight that its fellows lack, so that naming a group is not toxic by itself.

Scoring reads every text whole, in slices of bounded size. Neither labels nor lang, source or id are inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, table, written
from .shingles import mixed, odd_numbers

#: Labelled rows of each class that the classifier is fitted on, about.
PER_CLASS = 4_000
#: Words and beginnings that it may use, and rows of the sample that must have one.
FEATURES, LEAST_ROWS = 1024, 3
#: Strength of the ridge and of the counterfactual penalty.
RIDGE, COUNTERFACTUAL = 0.3, 4.0
#: Other names that a name is swapped for.
SWAPS = 3
#: Bytes of text whose features are made together.
TOGETHER = 1 << 17

#: Names of groups of people, by kind and language; a name is swapped for others of its line.
GROUPS = (
    "woman man girl boy",
    "women men girls boys",
    "muslim christian jew hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab african european",
    "gay lesbian straight bisexual transgender",
    "immigrant refugee foreigner native tourist",
    "immigrants refugees foreigners natives tourists",
    "american mexican chinese indian german french turkish polish",
    "blind deaf disabled autistic elderly young",
    "frau mann mädchen junge",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus buddhisten atheisten",
    "ausländer flüchtlinge einwanderer einheimische touristen",
    "schwule lesben heteros behinderte alte junge",
    "femme homme fille garçon",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "étrangers réfugiés immigrés touristes",
    "mujer hombre niña niño",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "extranjeros refugiados inmigrantes turistas",
)

_KINDS = [line.split() for line in GROUPS]
_LINE = {name: (kind, kind.index(name)) for kind in reversed(_KINDS) for name in kind}
_NAMED = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, _LINE), key=len, reverse=True)) + r")\b")
_SPACE = re.compile(r"\s")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_ODD = odd_numbers(16, 41)


def _cut(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, and parts of long ones that end between words, with the text that each is of; about ``TOGETHER`` characters at once."""
    owners, parts, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > TOGETHER:
                space = _SPACE.search(text, at + TOGETHER)
                end = space.start() if space else end
            owners, parts, size = [*owners, k], [*parts, text[at:end]], size + end - at
            if size >= TOGETHER:
                yield owners, parts
                owners, parts, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if parts:
        yield owners, parts


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and beginnings of all texts, and the text that each stands in; not yet distinct."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b"\0" * 8]), np.uint8)
    inside = _LETTER[data]
    inside[-8:] = False
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = last - first
    ends = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(ends, first, "right")

    def eight(at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.uint64)
        for k in range(8):
            value |= data[np.maximum(at + k, 0)].astype(np.uint64) << np.uint64(8 * k)
        return value

    mask = lambda n: np.where(n >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.minimum(n, 7).astype(np.uint64))) - np.uint64(1))
    begin = eight(first) & mask(length)
    # The last eight bytes, or all of a shorter word.
    end = np.where(length > 8, eight(last - 8), begin)
    found, owners = [mixed(mixed(begin * _ODD[0] + end * _ODD[1]) + length.astype(np.uint64) * _ODD[2])], [owner]
    for k in range(3, 9):
        long = length >= k
        found.append(mixed((begin[long] & mask(np.full(1, k))) * _ODD[3] + _ODD[3 + k]))
        owners.append(owner[long])
    return np.concatenate(found), np.concatenate(owners)


def present(texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, place in the sorted ``keys``) of the features that the texts have."""
    found = [np.zeros(0, np.int64)]
    for owners, parts in _cut(texts) if len(keys) else ():
        hashes, part = features(parts)
        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[place] == hashes
        found.append(np.unique(np.asarray(owners, np.int64)[part[hit]] * len(keys) + place[hit]))
    pairs = np.unique(np.concatenate(found))
    return pairs // max(1, len(keys)), pairs % max(1, len(keys))


def distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (hash, text) of all features, sorted."""
    found = [_one_each(*features(parts), np.asarray(owners, np.int64)) for owners, parts in _cut(texts)]
    if len(found) == 1:
        return found[0]
    hashes, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    return _one_each(hashes, owner, np.arange(len(texts)))


def _one_each(hashes: np.ndarray, part: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = owners[part]
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def swapped(sentence: str, by: int) -> str:
    """A lower-cased sentence whose names of groups are each the one ``by`` places further in their line."""

    def other(match: re.Match) -> str:
        kind, at = _LINE[match[0]]
        return kind[(at + by) % len(kind)]

    return _NAMED.sub(other, sentence)


def changes(text: str, keys: np.ndarray) -> Counter:
    """What swaps change in a text's sentences: (features lost, features gained), and how often."""
    found: Counter = Counter()
    for sentence in _SENTENCE.findall(text.lower()):
        if _NAMED.search(sentence):
            forms = [sentence, *(swapped(sentence, k) for k in range(1, SWAPS + 1))]
            own, places = present(forms, keys)
            sets = [set(places[own == k].tolist()) for k in range(len(forms))]
            found.update((tuple(sorted(sets[0] - s)), tuple(sorted(s - sets[0]))) for s in sets[1:] if s != sets[0])
    return found


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, moves: np.ndarray, times: np.ndarray, ridge: float = RIDGE, strength: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights, the last one the intercept. ``moves`` are the swaps' changes of the features, ``times`` how often each happened."""
    z = np.c_[x, np.ones(len(x), x.dtype)]
    pull = np.diag(np.append(np.full(x.shape[1], ridge), 1e-3))
    pull[:-1, :-1] += strength * (moves.T * times) @ moves
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (weight * p * (1 - p) + 1e-6)[:, None].astype(x.dtype)).T @ z + pull
        step = np.linalg.solve(curve, z.T @ (weight * (y - p)) - pull @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _learnt(docs: DataFrame, labels: DataFrame, per_class: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the chosen features, and their weights with the intercept."""
    marks = labels.groupBy("mark_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    there = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(there) < 2:
        # One class only, or none: the odds of one pseudo-row of each class.
        return np.zeros(0, np.uint64), np.asarray([np.log((there.get(1, 0) + 1) / (there.get(0, 0) + 1))])
    order = F.pmod(F.xxhash64("mark_id", F.lit(11)), F.lit(1 << 30))
    within = lambda y: int(min(1.0, per_class / there[y]) * (1 << 30))
    # About 2 * per_class rows at most: a broadcast at every size. Of rows that share an id one counts, so that the sample is bounded, too.
    chosen = marks.where(order < F.when(F.col("y") == 1, within(1)).otherwise(within(0)))
    sample = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["mark_id"]).groupBy("mark_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = written(sample.select("y", "text"), f"{folder}/sample")

    def count(batches):
        for part in slices(batches, 1, TOGETHER):
            y, (hashes, owner) = part.column(0).to_numpy().astype(np.int64), distinct(part.column(1).to_pylist())
            values, at, each = np.unique(hashes, return_inverse=True, return_counts=True)
            bad = np.bincount(at, weights=y[owner], minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(each - bad), pa.array(bad)], names=["feature", "clean", "toxic"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return np.zeros(0, np.uint64), np.asarray([np.log((there[1] + 1) / (there[0] + 1))])
    counted = sample.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = sizes[0], sizes[1]
    share = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    apart = (F.col("toxic") / n1 - F.col("clean") / n0) ** 2 / (share * (1 - share) + 1e-9)
    best = counted.where(F.col("clean") + F.col("toxic") >= LEAST_ROWS).orderBy(apart.desc(), "feature").limit(FEATURES).select("feature").toArrow()
    keys = np.sort(best["feature"].to_numpy().astype(np.int64).view(np.uint64))

    def look(batches):
        for part in slices(batches, 1, TOGETHER):
            y, texts = part.column(0), part.column(1).to_pylist()
            own, places = present(texts, keys)
            ends = np.searchsorted(own, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([y, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))], names=["y", "places"])

    def swap(batches):
        found: Counter = Counter()
        for part in slices(batches, 1, TOGETHER):
            for text in part.column(1).to_pylist():
                found.update(changes(text, keys))
        lists = [pa.array([k[i] for k in found], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*lists, pa.array(list(found.values()), pa.int64())], names=["lost", "gained", "times"])

    rows = sample.mapInArrow(look, "y int, places array<int>").toArrow()
    moves = sample.mapInArrow(swap, "lost array<int>, gained array<int>, times long").groupBy("lost", "gained").agg(F.sum("times").alias("times")).toArrow()
    y, places = rows["y"].to_numpy().astype(np.float64), rows["places"].combine_chunks()
    x = np.zeros((len(y), len(keys)), np.float32)
    x[np.repeat(np.arange(len(y)), places.value_lengths().to_numpy()), places.flatten().to_numpy()] = 1
    change = np.zeros((moves.num_rows, len(keys)))
    for side, sign in (("gained", 1), ("lost", -1)):
        lists = moves[side].combine_chunks()
        change[np.repeat(np.arange(moves.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = sign
    whole = there[0] + there[1]
    weight = np.where(y == 1, there[1] / n1, there[0] / n0) * (n0 + n1) / whole
    return keys, fit(x, y, weight, change, moves["times"].to_numpy().astype(np.float64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` are doc_id and toxic. Labels are learnt from rows whose crc32 of the decimal id leaves a remainder by 5; those that leave none are
    held out. A row without an id is held out, too. Labels without an id or a mark are left out; an id's several labels are averaged, and
    of rows that share a labelled id the one with the least text is learnt from. Null text is empty, and an empty text gets the score of a
    text without any known word. With labels of one class or none every score is that of the class shares. Repeated rows
    are scored each; an empty table gives no rows. Other columns of either table are not read.
    """
    remainder = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder == 0, F.lit(True)).alias("held_out"), "text")
    marks = labels.where(remainder != 0).select(F.col("doc_id").cast("long").alias("mark_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("toxic is not null")
    keys, weights = _learnt(rows, marks, per_class, shared_dir(docs.sparkSession))
    shared = docs.sparkSession.sparkContext.broadcast((keys, weights))

    def run(batches):
        keys, weights = shared.value
        for part in slices(batches, 2, TOGETHER):
            own, places = present(part.column(2).fill_null("").to_pylist(), keys)
            odds = np.bincount(own, weights=weights[places], minlength=part.num_rows) + weights[-1] if len(places) else np.full(part.num_rows, weights[-1])
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
