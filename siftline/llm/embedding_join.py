"""Embedding near-dedup with product quantisation over inverted lists.

1. Equal vectors become one, with a weight.
2. A coarse and a product quantiser are fitted for each vector length on a bounded sample (``SAMPLE`` vectors, by hash
   order, dealt to the lengths by their shares); every vector is then put into its nearest list among its
   length's, with a residual code for each of eight subspaces. Lists are numbered through all lengths.
3. Each vector visits its own list and every list whose border with its own is at most half a linked displacement away:
   of two linked vectors in two lists one is that near, as their distances to the border add up to no more than their
   displacement. In a list, distances from visitors to members are those to what the members' codes stand for, one matrix product
   a list; by the triangle inequality a linked member is at most the displacement and what its code leaves out away. Those within that
   bound go on to the exact cosine in double precision, which alone decides. So no link is lost, whatever the data are like.
   A link that both sides see counts where the nearer one to the border visits.
4. Neighbouring lists form blocks, to which a vector is sent once however many of their lists it visits. Blocks are cut into chunks of
   members and of visitors, one task for each pair of chunks, so no task holds a hot list. Tasks return
   the links' number for each vector and a spanning set of them, never all pairs.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import bounded_sample, salt, shared_dir, table, written

#: Vectors that the quantisers are fitted on, at most.
SAMPLE = 20_000
#: What each vector length gives to the sample at least, as far as it has so many.
LEAST_SAMPLE = 64
#: Vectors of a list on average, and the most lists.
LIST_SIZE, MOST_LISTS = 32, 2048
#: What rounding may add to a distance or a squared distance.
ROUNDING = 1e-4
SUBSPACES, CODES = 8, 256
#: Neighbouring lists that are one block: a vector is sent once to each block that it visits.
BLOCK = 512
#: Members and visitors that one task takes.
MEMBERS, VISITORS = 16384, 16384
#: Vectors whose visits to all lists are worked out together, and candidates that are checked together.
ROWS, PAIRS = 1024, 65_536


def _kmeans(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres, short = x[rng.choice(len(x), k, replace=False)].copy(), x.astype(np.float32)
    for _ in range(rounds):
        near = _nearest(short, centres.astype(np.float32))
        order, counts = np.argsort(near, kind="stable"), np.bincount(near, minlength=k)
        some = counts > 0
        sums = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[some])
        centres[some] = sums / counts[some, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 8192] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """The quantisers: list centres and, by subspace, the codes' centres; all for unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        sample = _scaled(sample)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        centres = _kmeans(x, min(lists, len(x)))
        # In the order along their main axis, so that lists of near numbers lie near each other.
        spread = centres - centres.mean(axis=0)
        self.centres = centres[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        rest = x - self.centres[_nearest(x, self.centres)]
        self.codes = [_kmeans(rest[:, a:b], min(CODES, len(x))) for a, b in zip(self.cuts, self.cuts[1:])]
        self.half = (self.centres**2).sum(axis=1) / 2

    @cached_property
    def gap(self) -> np.ndarray:
        """Distances between list centres, worked out where they are needed: they are larger than all else that is broadcast."""
        gap = 2 * (self.half[:, None] + self.half[None] - self.centres @ self.centres.T)
        return np.sqrt(np.maximum(gap, 1e-18))

    def visits(self, x: np.ndarray, home: np.ndarray, radius: float, lists: np.ndarray | None = None) -> np.ndarray:
        """Which of ``lists`` (of all) each unit vector visits: its own and those whose border with its own is within half of ``radius``."""
        lists = np.arange(len(self.centres)) if lists is None else lists
        own = (x * self.centres[home]).sum(axis=1) - self.half[home]
        ahead = own[:, None] - (x @ self.centres[lists].T - self.half[lists])
        return (ahead <= (radius / 2 + ROUNDING) * self.gap[home][:, lists]) | (home[:, None] == lists[None])

    def to_border(self, x: np.ndarray, home: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far each unit vector is from the border of its own list with one other; row by row, so the same in every task."""
        near = (x * self.centres[home]).sum(axis=1) - self.half[home] - (x * self.centres[other]).sum(axis=1) + self.half[other]
        return near / self.gap[home, other]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave out."""
        rest = x - self.centres[home]
        codes = np.stack([_nearest(rest[:, a:b], c) for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)], axis=1)
        left = np.concatenate([rest[:, a:b] - c[codes[:, m]] for m, (a, b, c) in enumerate(zip(self.cuts, self.cuts[1:], self.codes))], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(left, axis=1)

    def distances(self, x: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from unit vectors to what the codes of a list's members stand for."""
        coded = self.centres[centre] + np.concatenate([c[codes[:, m]] for m, c in enumerate(self.codes)], axis=1)
        out = x.astype(np.float32, copy=False) @ (-2 * coded.T).astype(np.float32)
        out += (1 + (coded**2).sum(axis=1)).astype(np.float32)
        return out


def _spanning(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The smallest position connected with each of ``count`` by the links a-b."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _indexes(classes: DataFrame) -> dict[int, tuple[int, Index]]:
    """For each vector length the number of its first block and its quantisers.

    A length gets its share of the sample and of the lists, but ``LEAST_SAMPLE`` vectors and one list at least.
    """
    counts = {r["size"]: r["n"] for r in classes.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, indexes, first = sum(counts.values()), {}, 0
    for size, n in sorted(counts.items()):
        most = max(LEAST_SAMPLE, -(-SAMPLE * n // total))
        sample = bounded_sample(classes.where(F.size("v") == size), ["rep"], ["v"], most)["v"].to_list()
        index = Index(np.asarray(sample, np.float64), int(max(1, min(MOST_LISTS * n // total, n // LIST_SIZE))))
        indexes[size] = first, index
        first += -(-len(index.centres) // BLOCK)
    return indexes


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors with their largest part between a half and one, so that no norm is out of range; powers of two change no cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _stack(column: pd.Series) -> np.ndarray:
    return _scaled(np.concatenate(column.to_list()).reshape(len(column), -1).astype(np.float64))


def embedding_groups(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", ways: int = 64) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept (whether the row is its component's first).

    Vectors that are null, empty or zero, or hold null or non-finite parts link with nothing; vectors of different
    lengths do not link with each other. A row without an id links with nothing
    and its component is null. Rows with equal vectors are all linked; rows that share an id count each.
    An empty table gives no rows. Other columns, labels included, are not read.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    radius = float(np.sqrt(2 - 2 * cosine))
    # Single precision stays as it is until a task computes with it.
    kept = "array<float>" if dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kept).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.col("vec_id").isNotNull() & good).withColumn("salt", salt("vec_id", ways))
    salted = valid.groupBy("salt", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
    classes = written(salted.groupBy("v").agg(F.min("low").alias("rep"), F.sum("weight").alias("weight")), f"{folder}/classes")

    indexes = _indexes(classes)
    if not indexes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    shared = spark.sparkContext.broadcast(indexes)

    def place(frames):
        for frame in frames:
            if not len(frame):
                continue
            for size, part in frame.groupby(frame["v"].map(len)):
                first, index = shared.value[size]
                x = _stack(part["v"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                home = _nearest(x, index.centres)
                lists, visits = np.arange(len(index.centres)), []
                for at in range(0, len(x), ROWS):
                    seen = index.visits(x[at : at + ROWS], home[at : at + ROWS], radius, lists)
                    visits += [first + np.flatnonzero(row) for row in np.logical_or.reduceat(seen, lists[::BLOCK], axis=1)]
                yield pd.DataFrame({"rep": part["rep"], "weight": part["weight"], "list": home.astype(np.int32), "home": (first + home // BLOCK).astype(np.int32), "v": part["v"], "visits": [v.astype(np.int32) for v in visits]})

    placed = written(classes.mapInPandas(place, f"rep long, weight long, list int, home int, v {kept}, visits array<int>"), f"{folder}/placed")
    chunks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    members = placed.groupBy(F.col("home").alias("block")).agg(F.count(F.lit(1)).alias("n")).select("block", chunks("n", MEMBERS).alias("m_chunks"))
    visitors = placed.select(F.explode("visits").alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", chunks("n", VISITORS).alias("v_chunks"))
    plan = F.broadcast(members.join(visitors, "block"))  # fewer rows than there are lists: at most MOST_LISTS, and one for each vector length
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    as_member = placed.select("rep", "weight", "list", "v", F.col("home").alias("block")).join(plan, "block").select(
        "block", own("m_chunks").alias("m"), spread("v_chunks").alias("n"), F.lit(True).alias("member"), "rep", "weight", "list", "v"
    )
    as_visitor = placed.select("rep", "weight", "list", "v", F.explode("visits").alias("block")).join(plan, "block").select(
        "block", own("v_chunks").alias("n"), spread("m_chunks").alias("m"), F.lit(False).alias("member"), "rep", "weight", "list", "v"
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        members, visitors = frame[frame["member"]], frame[~frame["member"]]
        if not len(members) or not len(visitors):
            return pd.DataFrame({"rep": [], "n": [], "other": []}).astype("int64")
        raw_m, raw_v = _stack(members["v"]), _stack(visitors["v"])
        index = shared.value[raw_m.shape[1]][1]
        norm_m, norm_v = np.linalg.norm(raw_m, axis=1), np.linalg.norm(raw_v, axis=1)
        x_m, x_v = raw_m / norm_m[:, None], raw_v / norm_v[:, None]
        id_m, id_v = members["rep"].to_numpy(), visitors["rep"].to_numpy()
        home_m, home_v = members["list"].to_numpy(), visitors["list"].to_numpy()
        codes, left = index.encode(x_m, home_m)
        limit = ((radius + left) ** 2 + ROUNDING).astype(np.float32)
        short = x_v.astype(np.float32)
        lists = np.unique(home_m)
        there = [index.visits(x_v[i : i + ROWS], home_v[i : i + ROWS], radius, lists) for i in range(0, len(x_v), ROWS)]
        there = np.concatenate(there).T.copy()
        members_of = np.split(np.argsort(home_m, kind="stable"), np.cumsum(np.unique(home_m, return_counts=True)[1])[:-1])
        found_v, found_m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, guests, mine in zip(lists.tolist(), map(np.flatnonzero, there), members_of, strict=True):
            for i, k in ((i, k) for i in range(0, len(guests), 8192) for k in range(0, len(mine), 256)):
                block, part = guests[i : i + 8192], mine[k : k + 256]
                v, m = np.divmod(np.flatnonzero(index.distances(short[block], at, codes[part]) <= limit[part]), len(part))
                for j in range(0, len(v), PAIRS):
                    a, b = block[v[j : j + PAIRS]], part[m[j : j + PAIRS]]
                    exact = np.einsum("ij,ij->i", raw_v[a], raw_m[b]) / (norm_v[a] * norm_m[b]) >= cosine
                    a, b = a[exact], b[exact]
                    # Each pair once: inside a list where the smaller id visits, else where the nearer to the border does.
                    out, back = index.to_border(x_v[a], home_v[a], home_m[b]), index.to_border(x_m[b], home_m[b], home_v[a])
                    counts = np.where(home_v[a] == home_m[b], id_v[a] < id_m[b], (out < back) | ((out == back) & (home_v[a] < home_m[b])))
                    found_v.append(a[counts])
                    found_m.append(b[counts])
        a, b = np.concatenate(found_v), np.concatenate(found_m)
        ids, position = np.unique(np.concatenate([id_v, id_m]), return_inverse=True)
        p_v, p_m = position[: len(id_v)][a], position[len(id_v) :][b]
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, p_v, members["weight"].to_numpy()[b])
        np.add.at(n, p_m, visitors["weight"].to_numpy()[a])
        some = np.flatnonzero(n)
        return pd.DataFrame({"rep": ids[some], "n": n[some], "other": ids[_spanning(p_v, p_m, len(ids))][some]})

    tasks = as_member.unionByName(as_visitor).groupBy("block", "m", "n")
    found = written(tasks.applyInPandas(compare, "rep long, n long, other long"), f"{folder}/found")
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    by_class = (
        classes.select("v", "rep", "weight")
        .join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
        .join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    # Back to the rows by salted groups again: a hot vector's rows meet one row of their own salt.
    back = valid.select("salt", "v").distinct().join(by_class, "v")
    linked = valid.join(back, ["salt", "v"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    return (
        rows.select("vec_id", F.coalesce(good, F.lit(False)).alias("good"))
        .join(linked, "vec_id", "left")
        .select(
            "vec_id",
            F.when(F.col("good"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(F.col("good"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.9)
