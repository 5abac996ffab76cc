"""Best-fit packing of token sequences by hierarchical residual packing.

1. Documents are tokenised where they lie, long ones are cut, and the pieces are written with a number that deals them: every packing task gets
   about ``TASK`` pieces, a mixture of the whole table in whatever order and clusters it lies. Each packs its own best-fit, the longest first.
2. A task's nearly full bins are done. Of the others those above half full cannot merge with each other, and at most one bin of a task is at
   most half full, as two such always merge. In rounds the bins of ``FAN`` tasks meet as items of another best-fit: their few bins of at most half and, of
   each number of free places, as many of the fuller ones as could be asked to take one. Each round leaves one bin of at most half for ``FAN``
   tasks, so rounds grow with the logarithm of the tasks, and no task or driver holds more than a bound.
3. What moved in which round is put together from the last round back, and joined to the pieces.

Pieces and bins are written to the shared folder, so each is decided once even if tasks run again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import shared_dir, table, written

CAPACITY = 2048
#: Pieces that a task packs, about, and tasks whose bins meet in a round.
TASK, FAN = 1 << 16, 16

_CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
_MOVES = "sequence_id long, into long, at long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds: longest items first, each into the fullest bin it fits.

    Open bins lie in one stack per free size; a bit set of the sizes in use finds the best fit at once.
    """
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = used >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                used ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            if not stacks[left]:
                used |= 1 << left
            stacks[left].append(b)
    return bins, offsets, np.asarray(fill, np.int64)


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def cut(batches):
        from pyspark import TaskContext

        columns: dict[str, list] = {x.split()[0]: [] for x in _CUT.split(", ")}
        at, task = 0, TaskContext.get().partitionId() << 40

        def batch():
            types = {"piece": pa.int32()}
            out = pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.int64())) for n, v in columns.items()], names=list(columns))
            for values in columns.values():
                values.clear()
            return out

        for key, ids, _ in tokens.documents(batches, tokens.encoder(tokenizer)):
            ids = np.append(ids, np.uint32(end_id))
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                for values, value in zip(columns.values(), (key, piece, start, len(part), zlib.crc32(part), task + at), strict=True):
                    values.append(value)
                at += 1
            if len(columns["deal"]) >= 8192:
                yield batch()
        yield batch()

    return cut


def _first_round(capacity: int):
    def pack(batches):
        from pyspark import TaskContext

        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table_ = pa.Table.from_batches(whole)
        bins, offset, fill = best_fit(table_.column("length").to_numpy(), capacity)
        sequence = (TaskContext.get().partitionId() << 32) + bins
        packed = table_.drop_columns("deal").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill[bins]))
        yield from packed.combine_chunks().to_batches(max_chunksize=8192)

    return pack


def _meet(capacity: int):
    """Best-fit of the bins of one group as items; a row for each that moved."""

    def pack(group):
        import pandas as pd

        group = group.sort_values(["fill", "sequence_id"], ascending=[False, True])
        own, sizes = group["sequence_id"].to_numpy(), group["fill"].to_numpy()
        bins, offsets, fill = best_fit(sizes, capacity)
        # The item at a bin's start is the bin that the others move into.
        host = np.zeros(len(fill), np.int64)
        host[bins[offsets == 0]] = own[offsets == 0]
        moved = offsets > 0
        return pd.DataFrame({"sequence_id": own[moved], "into": host[bins[moved]], "at": offsets[moved], "fill": fill[bins[moved]]})

    return pack


def _rounds(bins: DataFrame, capacity: int, fan: int, folder: str) -> DataFrame | None:
    """sequence_id, into, at of the bins (sequence_id, fill) that move into others, over all rounds; None if there is one task only."""
    tasks = (bins.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0) + 1
    rounds: list[DataFrame] = []
    width = 1
    while width < tasks:
        width *= fan
        meeting = bins.where(F.col("fill") < capacity).withColumn("group", F.floor(F.shiftright("sequence_id", 32) / width).cast("long"))
        low = F.col("fill") * 2 <= capacity
        # A bin above half is asked by at most one bin of at most half of each task, so more of one size than tasks are never asked.
        rank = F.row_number().over(Window.partitionBy("group", "fill").orderBy("sequence_id"))
        hosts = meeting.where(~low).withColumn("rank", rank).where(F.col("rank") <= fan).drop("rank")
        asking = meeting.where(low)
        items = hosts.join(asking.select("group").distinct(), "group", "left_semi").select("group", "sequence_id", "fill").unionByName(asking.select("group", "sequence_id", "fill"))
        moved = written(items.groupBy("group").applyInPandas(_meet(capacity), _MOVES), f"{folder}/moves-{width}")
        rounds.append(moved)
        after = moved.groupBy("into").agg(F.max("fill").alias("now"))
        gone = moved.select("sequence_id")
        left = bins.join(gone, "sequence_id", "left_anti").join(after.withColumnRenamed("into", "sequence_id"), "sequence_id", "left")
        bins = written(left.select("sequence_id", F.coalesce("now", "fill").alias("fill")), f"{folder}/bins-{width}")
    whole = None
    for moved in reversed(rounds):
        moved = moved.select("sequence_id", "into", "at")
        if whole is not None:
            later = whole.select(F.col("sequence_id").alias("into"), F.col("into").alias("_into"), F.col("at").alias("_at"))
            followed = moved.join(later, "into", "left").select("sequence_id", F.coalesce("_into", "into").alias("into"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"))
            whole = followed.unionByName(whole)
        else:
            whole = moved
    return whole


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    task: int = TASK,
    fan: int = FAN,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and gives one piece with the end id alone; a null id stays null; rows with the same id
    are packed each. Documents of more than ``capacity`` ids are cut, others never. An empty table gives no rows.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    folder = shared_dir(docs.sparkSession)
    pieces = written(rows.mapInArrow(_pieces(tokenizer, end_id, capacity), _CUT), f"{folder}/pieces")
    tasks = max(1, -(-pieces.count() // task))
    packed = written(pieces.repartition(tasks, F.xxhash64("deal")).mapInArrow(_first_round(capacity), _PIECES), f"{folder}/packed")
    moves = _rounds(packed.where("offset = 0").select("sequence_id", "fill"), capacity, fan, folder)
    if moves is not None:
        packed = packed.join(moves.select("sequence_id", "into", "at"), "sequence_id", "left").withColumn("offset", F.col("offset") + F.coalesce("at", F.lit(0)))
        packed = packed.withColumn("sequence_id", F.coalesce("into", "sequence_id"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"), end_id=0)
