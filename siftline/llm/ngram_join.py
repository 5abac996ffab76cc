"""N-gram Jaccard self-join with signature trees.

Exact, without a pass over all pairs:

1. Texts with the same shingle set are one *class*; its smallest id stands for it.
2. Blocks. Sizes fall into bands. Two linked sets of a band differ in at most k shingles, so if all shingles are
   dealt to k + 1 + s segments by hash, at least s + 1 segments of the two are the same. Each class sends
   one key per segment. A class of which fewer than s + 1 segments occur elsewhere cannot be linked and
   goes; that is what keeps texts apart that only share passages. The others form clusters by their common keys.
   Tasks combine their own rows of a key before the shuffle, so a hot key meets in one place no more rows than there are runs.
3. Trees. A cluster's sets go to one task, or, beyond ``CHUNK`` shingles, in chunks of which each pair goes
   to one task. A signature tree holds OR-combined bitmaps and size ranges of its sets; a dual traversal
   from the root drops node pairs whose largest possible overlap is too small, and those whose sets are
   all connected already. What is left at the leaves is compared exactly.
4. The links found span each connected part (not every link within a part is made) and are closed to components.

Links are those of the exact rule ``den * intersection >= num * union``; none is lost, whatever a group's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import salt, shared_dir, slices, table, written
from .shingles import mixed, shingle_sets

#: Shingle hashes of a cluster that one task takes at once (8 bytes each); larger clusters are chunked.
CHUNK = 4_000_000
#: Bytes of text whose sets are made together, and keys of a task that are combined before they are sent.
CALL, RUN = 2_000_000, 1_000_000
#: Ratio of the largest to the smallest size in a band.
BAND = 1.35
#: Classes in a leaf of a tree, and children of a node.
LEAF, FAN_OUT = 32, 8


def _bands(num: int, den: int, words_most: int = 1 << 31) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, segments, spare segments) of each band."""
    out, low = [], 1
    while low < words_most:
        high = max(low, int(low * BAND))
        # |x| + |y| <= 2 * high and overlap >= num / (num + den) of that sum.
        most = (den - num) * 2 * high // (den + num)
        spare = max(1, most // 2)
        out.append((low, high, most + 1 + spare if most else 0, spare))
        low = high + 1
    return out


def _segments(hashes: np.ndarray, bands: list[tuple[int, int, int, int]], lows: np.ndarray, num: int, den: int):
    """(band, its segments, spare ones, the segment of each shingle) for a set's own band and, if its size allows links into it, the next.

    A band that allows no difference has no segments, as equal sets are one class.
    """
    n = len(hashes)
    own = int(np.searchsorted(lows, n, side="right")) - 1 if n else 0
    for band in (own, own + 1):
        low, _, segments, spare = bands[band]
        if n and segments and (band == own or n * den >= num * low):
            yield band, segments, spare, (mixed(hashes + np.uint64(band)) >> np.uint64(33)) % np.uint64(segments)


def shared_needs(hashes: np.ndarray, bands: list[tuple[int, int, int, int]], lows: np.ndarray, num: int, den: int) -> dict[int, int]:
    """For each parity of a band, how many keys a set shares with every set it is linked with.

    Empty segments are the same everywhere. If a set has no more of them than there are spare segments they are left
    out and that many fewer keys are shared; a set of mostly empty segments sends keys for them, too, and shares
    at least one.
    """
    out = {}
    for band, segments, spare, segment in _segments(hashes, bands, lows, num, den):
        empty = segments - len(np.unique(segment))
        out[band % 2] = spare + 1 - empty if empty <= spare else 1
    return out


def block_keys(hashes: np.ndarray, bands: list[tuple[int, int, int, int]], lows: np.ndarray, num: int, den: int) -> np.ndarray:
    """A set's keys, one per segment; the lowest bit is the parity of the band."""
    found = [np.zeros(0, np.uint64)]
    for band, segments, spare, segment in _segments(hashes, bands, lows, num, den):
        order = np.argsort(segment.astype(np.uint16) if segments < 65536 else segment, kind="stable")
        segment = segment[order]
        cuts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums, names = np.add.reduceat(mixed(hashes[order] + np.uint64(7)), cuts), segment[cuts]
        if segments - len(cuts) > spare:
            missing = np.setdiff1d(np.arange(segments, dtype=np.uint64), names)
            sums, names = np.concatenate([sums, np.zeros(len(missing), np.uint64)]), np.concatenate([names, missing])
        keys = mixed(sums ^ mixed(names * np.uint64(1024) + np.uint64(band)))
        found.append((keys & ~np.uint64(1)) | np.uint64(band % 2))
    return np.concatenate(found)


class SignatureTree:
    """Sets in leaves of 32, below nodes of eight; each node has a bitmap, a size range and a surplus.

    A set's bitmap has a bit for each hash bucket in use; the surplus counts shingles that share a bit with
    another. Shingles common to x and y lie in common bits, so their number is at most the common bits plus
    the smaller surplus. A node holds the OR of its bitmaps and the largest surplus, so the same sum bounds
    every pair below two nodes.
    """

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.asarray([len(s) for s in sets], np.int64)
        bits = int(min(8192, max(256, 1 << int(np.ceil(np.log2(2 * np.median(sizes)))))))
        # Similar sets side by side: by size class, then by smallest shingle.
        least = np.asarray([s[0] for s in sets], np.uint64)
        self.order = np.lexsort((least, np.floor(np.log(sizes) / np.log(BAND))))
        self.sets = [sets[i] for i in self.order]
        sizes = sizes[self.order]
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(self.sets):
            on = np.zeros(bits, bool)
            on[(mixed(s) >> np.uint64(40)).astype(np.int64) % bits] = True
            maps[i] = np.packbits(on)
        maps = maps.view(np.uint64)
        surplus = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.sizes, self.maps, self.surplus = sizes, maps, surplus
        self.levels = []
        step, level = LEAF, (maps, sizes, sizes, surplus)
        while True:
            cuts = np.arange(0, len(level[0]), step)
            level = (
                np.bitwise_or.reduceat(level[0], cuts, axis=0),
                np.minimum.reduceat(level[1], cuts),
                np.maximum.reduceat(level[2], cuts),
                np.maximum.reduceat(level[3], cuts),
            )
            self.levels.append(level)
            if len(cuts) == 1:
                break
            step = FAN_OUT


def _possible(common: np.ndarray, low_a, low_b, high_a, high_b, surplus_a, surplus_b, num: int, den: int) -> np.ndarray:
    """Whether two sets with sizes and bitmaps in these bounds can be linked."""
    overlap = np.minimum(np.minimum(high_a, high_b), common + np.minimum(surplus_a, surplus_b))
    # Of |x| + |y| at least num / (num + den) must be common.
    return (overlap * (num + den) >= num * (low_a + low_b)) & (high_a * den >= num * low_b) & (high_b * den >= num * low_a)


class _Union:
    def __init__(self, count: int):
        self.root = np.arange(count)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)

    def of(self, items: np.ndarray) -> np.ndarray:
        root = self.root
        found = root[items]
        while True:
            above = root[found]
            if (above == found).all():
                return found
            found = above


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the smallest position it is connected with by links among ``sets``, found by dual traversal."""
    tree = SignatureTree(sets)
    groups = _Union(len(sets))
    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    spans = [LEAF * FAN_OUT**level for level in range(top + 1)]
    while stack:
        level, a, b = stack.pop()
        span = spans[level]
        rows_a, rows_b = np.arange(a * span, min((a + 1) * span, len(sets))), np.arange(b * span, min((b + 1) * span, len(sets)))
        roots_a, roots_b = groups.of(rows_a), groups.of(rows_b)
        if roots_a[0] == roots_b[0] and (roots_a == roots_a[0]).all() and (roots_b == roots_b[0]).all():
            continue
        if level:
            maps, low, high, surplus = tree.levels[level - 1]
            kids_a = np.arange(a * FAN_OUT, min((a + 1) * FAN_OUT, len(low)))
            kids_b = np.arange(b * FAN_OUT, min((b + 1) * FAN_OUT, len(low)))
            common = np.bitwise_count(maps[kids_a][:, None] & maps[kids_b][None]).sum(axis=2).astype(np.int64)
            keep = _possible(common, *(v[k][:, None] if i % 2 == 0 else v[k][None] for v in (low, high, surplus) for i, k in enumerate((kids_a, kids_b))), num, den)
            pairs = [(level - 1, int(kids_a[i]), int(kids_b[j])) for i, j in zip(*np.nonzero(keep), strict=True) if kids_a[i] <= kids_b[j]]
            pairs.sort(key=lambda p: p[1] == p[2])  # a node with itself comes off the stack first
            stack += pairs
            continue
        common = np.bitwise_count(tree.maps[rows_a][:, None] & tree.maps[rows_b][None]).sum(axis=2).astype(np.int64)
        size_a, size_b = tree.sizes[rows_a][:, None], tree.sizes[rows_b][None]
        keep = _possible(common, size_a, size_b, size_a, size_b, tree.surplus[rows_a][:, None], tree.surplus[rows_b][None], num, den)
        keep &= (rows_a[:, None] < rows_b[None]) & (roots_a[:, None] != roots_b[None])
        if keep.any():
            for i, j in _linked(tree, rows_a, rows_b, keep, num, den):
                groups.join(i, j)
    roots = groups.of(np.arange(len(sets)))
    least = np.full(len(sets), len(sets), np.int64)
    np.minimum.at(least, roots, tree.order)
    out = np.empty(len(sets), np.int64)
    out[tree.order] = least[roots]
    return out


def _linked(tree: SignatureTree, rows_a: np.ndarray, rows_b: np.ndarray, keep: np.ndarray, num: int, den: int):
    """The pairs among ``keep`` whose exact overlap is large enough."""
    at_a, at_b = np.flatnonzero(keep.any(axis=1)), np.flatnonzero(keep.any(axis=0))
    if keep.sum() <= 8:
        for i, j in zip(*np.nonzero(keep), strict=True):
            x, y = tree.sets[rows_a[i]], tree.sets[rows_b[j]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * (num + den) >= num * (len(x) + len(y)):
                yield int(rows_a[i]), int(rows_b[j])
        return
    left, right = [tree.sets[r] for r in rows_a[at_a]], [tree.sets[r] for r in rows_b[at_b]]
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(shared):
        return
    sides = []
    for side in (left, right):
        grid = np.zeros((len(side), len(shared)), np.float32)
        for k, s in enumerate(side):
            at = np.searchsorted(shared, s)
            at[at == len(shared)] = 0
            grid[k, at[shared[at] == s]] = 1
        sides.append(grid)
    # Counts below 2**24 are exact in single precision; larger sets are never that many in one leaf's grid.
    both = (sides[0] @ sides[1].T).astype(np.int64)
    sums = tree.sizes[rows_a[at_a]][:, None] + tree.sizes[rows_b[at_b]][None]
    good = keep[np.ix_(at_a, at_b)] & (both * (num + den) >= num * sums)
    for i, j in zip(*np.nonzero(good), strict=True):
        yield int(rows_a[at_a[i]]), int(rows_b[at_b[j]])


def _run(key: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """The distinct (key, rep) of a run of rows with what the run knows: spread is 0 for a key's only row, -1 for the first of several.

    The others have a number above 0: that their key is common is known, so they need not meet anywhere.
    """
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    keep = new_key | np.concatenate([[True], rep[1:] != rep[:-1]])[: len(key)]
    key, rep, first = key[keep], rep[keep], new_key[keep]
    several = np.concatenate([~first[1:], [False]])[: len(key)]
    spread = (mixed(rep.view(np.uint64)) >> np.uint64(33)).astype(np.int32) | np.int32(1)
    spread[first] = np.where(several[first], -1, 0)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep), pa.array(spread)], names=["key", "rep", "spread"])


def near_duplicates(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", ways: int = 64
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two texts link when ``den * intersection >= num * union`` of their sets of distinct ``words``-word shingles.
    A text with fewer words has its whole sequence as its only shingle. Null, empty and blank texts have no set and
    link with nothing; neither does a row without an id, whose component is null. Rows that share an id are
    one node with all their sets. An empty table gives no rows. Other columns are not read.
    A threshold so low that sets two bands apart can be linked (below about 1 / ``BAND``) raises ValueError.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    bands = _bands(num, den)
    if any(high * den >= num * after for (_, high, *_), (after, *_) in zip(bands, bands[2:])):
        raise ValueError(f"a threshold of {num} / {den} links sets two size bands apart, which share no keys")
    lows = np.asarray([b[0] for b in bands], np.int64)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scheme = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("need_0", pa.int32()), ("need_1", pa.int32())])

    def sets(batches):
        for part in slices(batches, 1, CALL):
            found = shingle_sets(part.column(1).fill_null("").to_pylist(), words)
            needs = [shared_needs(s, bands, lows, num, den) for s in found]
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
            arrays = [part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(names, pa.binary())]
            arrays += [pa.array([n.get(band) for n in needs], pa.int32()) for band in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, schema=scheme)

    def keys(batches):
        waiting, size = [], 0
        for part in slices(batches, 1, CALL):
            found = [block_keys(s, bands, lows, num, den) for s in shingle_sets(part.column(1).fill_null("").to_pylist(), words)]
            reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(k) for k in found])
            waiting.append((np.concatenate(found).view(np.int64), reps))
            size += len(reps)
            if size >= RUN:
                yield _run(*map(np.concatenate, zip(*waiting)))
                waiting, size = [], 0
        if waiting:
            yield _run(*map(np.concatenate, zip(*waiting)))

    seen = written(rows.mapInArrow(sets, "doc_id long, n_shingles long, set_id binary, need_0 int, need_1 int"), f"{folder}/sets")

    # Classes of equal sets, by salted minima: no task meets more than a salt's share of one hot set.
    members = seen.where(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull()).select("doc_id", "set_id", salt("doc_id", ways).alias("salt"))
    salted = members.groupBy("salt", "set_id").agg(F.min("doc_id").alias("rep"))
    reps = salted.groupBy("set_id").agg(F.min("rep").alias("rep"))
    of_class = members.join(salted.select("salt", "set_id").join(reps, "set_id"), ["salt", "set_id"])
    of_class = written(of_class.select("doc_id", "rep"), f"{folder}/classes")

    # Blocks: only keys that another class has, too, and only classes with as many of those as a link takes.
    classes = of_class.where(F.col("doc_id") == F.col("rep")).select("doc_id").distinct()
    keyed = seen.where("need_0 is not null or need_1 is not null").join(classes, "doc_id", "left_semi")
    # Both joins with texts shuffle at every size: no plan for small inputs that large ones could not follow.
    sent = rows.join(keyed.select("doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(keys, "key long, rep long, spread int")
    # Of a key's rows only the first of each run meets the others, however hot the key is.
    by_key = Window.partitionBy("key", F.greatest("spread", F.lit(0))).orderBy("rep")
    near = F.coalesce(F.lag("rep").over(by_key) != F.col("rep"), F.lit(False)) | F.coalesce(F.lead("rep").over(by_key) != F.col("rep"), F.lit(False))
    common = written(sent.withColumn("common", (F.col("spread") != 0) | near).where("common").select("key", "rep"), f"{folder}/keys")
    band = F.col("key").bitwiseAND(F.lit(1)).alias("band")
    counts = common.groupBy("rep", band).agg(F.count(F.lit(1)).alias("n"))
    need = F.when(F.col("band") == 0, F.col("need_0")).otherwise(F.col("need_1"))
    enough = counts.join(keyed.select(F.col("doc_id").alias("rep"), "need_0", "need_1"), "rep").where(F.col("n") >= need).select("rep", "band").distinct()
    held = common.withColumn("band", band).join(enough, ["rep", "band"]).select("key", "rep", salt("rep", ways).alias("salt"))
    held = written(held, f"{folder}/held")
    # A key ties its classes to the smallest, found by salted minima and led back by the same salts.
    salted = held.groupBy("key", "salt").agg(F.min("rep").alias("least"))
    firsts = salted.groupBy("key").agg(F.min("least").alias("first"))
    back = salted.select("key", "salt").join(firsts, "key")
    ties = held.join(back, ["key", "salt"]).where(F.col("rep") != F.col("first")).select("rep", "first").distinct()
    clusters = connected_components(ties.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    clusters = written(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), f"{folder}/clusters")

    # Chunks: of a cluster of one chunk the only pair is (0, 0); otherwise every pair of different chunks.
    sizes = seen.select("doc_id", "n_shingles").distinct().join(clusters, "doc_id").groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    plan = clusters.join(sizes.select("cluster", F.ceil(F.col("total") / CHUNK).cast("int").alias("chunks")), "cluster")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("chunks")).cast("int")
    plan = plan.select("doc_id", "cluster", "chunks", chunk.alias("chunk"))
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk"))))
    plan = plan.select("doc_id", "cluster", "chunk", other.alias("other")).select(
        "doc_id", "cluster", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    )
    taken = rows.join(plan.hint("merge"), "doc_id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        ids, found = frame["doc_id"].to_numpy(), []
        texts = [t or "" for t in frame["text"]]
        for at in range(0, len(texts), 256):
            found += shingle_sets(texts[at : at + 256], words)
        some = [i for i, s in enumerate(found) if len(s)]
        least = spanning_links([found[i] for i in some], num, den) if len(some) > 1 else np.zeros(len(some), np.int64)
        a, b = ids[some], ids[np.asarray(some, np.int64)[least]] if some else ids[:0]
        # Rows that share an id are one node already.
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    links = written(taken.groupBy("cluster", "low", "high").applyInPandas(compare, "a long, b long"), f"{folder}/links")
    joined = connected_components(links)
    own = of_class.select("doc_id", "rep").distinct()
    # Ids with several rows tie their classes together.
    several = own.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where(F.col("low") != F.col("high"))
    if not several.isEmpty():
        joined = connected_components(links.unionByName(own.where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    named = own.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component")
    )
    return (
        seen.select("doc_id", "n_shingles")
        .join(named, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
  FROM w
), n AS (
  SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 85 * (nx.n + ny.n - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT doc_id, n AS n_shingles, min(y) AS component_id
FROM n JOIN reach ON reach.x = doc_id GROUP BY 1, 2
"""
