"""Token ids in binary files of patched frame-of-reference blocks.

File layout (little-endian)::

    magic 8 bytes
    blocks, one after the other:
        minimum u32, width u8, 0 u8, exceptions u16
        width * 32 words u32: the low ``width`` bits of each value above the minimum, 32 lanes side by side
        exceptions: positions u16 each, then values above the minimum u32 each
    block starts u64 [blocks + 1]           file offsets
    document starts u64 [documents + 1]     in ids
    document ids i64 [documents]
    document has an id u8 [documents]
    footer: ids u64, blocks u64, documents u64, offset of the block starts u64, magic 8 bytes

A block holds 1024 ids, the last one of a file maybe fewer. The width is that of the block's 90th
percentile; larger values keep their low bits in place of the value and stand in the exception list.
Any block can be read alone by its start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import shared_dir, table, written
from .storage import opened, task_file

MAGIC = b"SLPFOR01"
BLOCK = 1024
LANES = 32
#: Share of a block's values that the packed width must hold.
PERCENTILE = 0.90
_FOOTER = np.dtype("<u8")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of the PERCENTILE value of each row; 0 where that value is 0."""
    at = int(np.ceil(PERCENTILE * values.shape[1])) - 1
    top = np.partition(values, at, axis=1)[:, at].astype(np.float64)
    return np.frexp(top)[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1024 values as rows of ``32 * width`` words; lane l holds values l, 32 + l, 64 + l, ..."""
    lanes = values.reshape(-1, BLOCK // LANES, LANES)
    words = np.zeros((len(values), width, LANES), dtype=np.uint32)
    for k in range(BLOCK // LANES):
        word, shift = divmod(k * width, 32)
        words[:, word] |= lanes[:, k] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= lanes[:, k] >> np.uint32(32 - shift)
    return words.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(-1, width, LANES)
    out = np.zeros((len(words), BLOCK // LANES, LANES), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(BLOCK // LANES):
        word, shift = divmod(k * width, 32)
        out[:, k] = lanes[:, word] >> np.uint32(shift)
        if shift + width > 32:
            out[:, k] |= lanes[:, word + 1] << np.uint32(32 - shift)
        out[:, k] &= mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of a multiple of 1024 ids."""
    values = ids.reshape(-1, BLOCK)
    low = values.min(axis=1)
    above = values - low[:, None]
    widths = _widths(above)
    out: list[bytes] = [b""] * len(values)
    for width in np.unique(widths):
        w, rows = int(width), np.flatnonzero(widths == width)
        part = above[rows]
        odd = part >> np.uint32(w) != 0 if w < 32 else np.zeros(part.shape, dtype=bool)
        packed = _pack(part & np.uint32((1 << w) - 1), w) if w else np.zeros((len(rows), 0), dtype=np.uint32)
        heads = np.zeros(len(rows), np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("odd", "<u2")]))
        heads["low"], heads["width"], heads["odd"] = low[rows], w, odd.sum(axis=1)
        head, body = heads.tobytes(), packed.tobytes()
        size = 4 * packed.shape[1]
        which, places = np.nonzero(odd)
        ends = np.concatenate([[0], np.cumsum(heads["odd"], dtype=np.int64)]).tolist()
        places, values_ = places.astype("<u2").tobytes(), part[which, places].astype("<u4").tobytes()
        for i, row in enumerate(rows.tolist()):
            a, b = ends[i], ends[i + 1]
            out[row] = head[8 * i : 8 * i + 8] + body[size * i : size * (i + 1)] + places[2 * a : 2 * b] + values_[4 * a : 4 * b]
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of a run of blocks; ``starts`` (one more than blocks) count from the beginning of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    at = starts[:-1].astype(np.int64)
    heads = raw[at[:, None] + np.arange(8)].copy().view(np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("odd", "<u2")]))[:, 0]
    out = np.zeros((len(at), BLOCK), np.uint32)
    for width in np.unique(heads["width"]):
        w, rows = int(width), np.flatnonzero(heads["width"] == width)
        if w:
            words = raw[(at[rows] + 8)[:, None] + np.arange(4 * LANES * w)].copy().view("<u4")
            out[rows] = _unpack(words, w)
    odd = heads["odd"].astype(np.int64)
    if odd.any():
        rows = np.repeat(np.arange(len(at)), odd)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(odd) - odd, odd)
        first = (at + 8 + 4 * LANES * heads["width"].astype(np.int64))[rows]
        place = raw[(first + 2 * k)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        out[rows, place] = raw[(first + 2 * odd[rows] + 4 * k)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    return (out + heads["low"][:, None]).reshape(-1)


class Writer:
    """Streams documents into one file; only the indexes stay in memory."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        stream.write(MAGIC)
        self.rest: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.starts, self.documents, self.keys = [self.at], [0], []

    def add(self, key: int | None, part: np.ndarray) -> None:
        self.keys.append(key)
        self.ids += len(part)
        self.documents.append(self.ids)
        self.rest.append(part)
        self.waiting += len(part)
        if self.waiting >= 256 * BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, "<u4")
        self.rest, self.waiting = [ids[count:]], len(ids) - count
        for block in encode_blocks(ids[:count]):
            self.stream.write(block)
            self.at += len(block)
            self.starts.append(self.at)

    def close(self) -> None:
        self._flush(self.waiting // BLOCK * BLOCK)
        if self.waiting:
            last = self.rest[0]
            self.rest = [np.concatenate([last, np.full(BLOCK - len(last), last.min(), "<u4")])]
            self.waiting = BLOCK
            self._flush(BLOCK)
        index = self.at
        self.stream.write(np.asarray(self.starts, "<u8").tobytes())
        self.stream.write(np.asarray(self.documents, "<u8").tobytes())
        self.stream.write(np.asarray([k or 0 for k in self.keys], "<i8").tobytes())
        self.stream.write(bytes(k is not None for k in self.keys))
        self.stream.write(np.asarray([self.ids, len(self.starts) - 1, len(self.keys), index], "<u8").tobytes() + MAGIC)
        self.stream.close()


def read_documents(source, blocks: int = 512) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """(id, start in this file, parts of its ids) of a file's documents in order, ``blocks`` blocks at a time.

    A long document comes as several parts; no more than a run of blocks and one document is held.
    """
    size = source.size()
    foot = source.read_at(40, size - 40)
    if foot[32:] != MAGIC:
        raise ValueError("not a token file, or cut short")
    ids, n_blocks, n_docs, index = (int(x) for x in np.frombuffer(foot, "<u8", 4))
    data = source.read_at(size - 40 - index, index)
    starts = np.frombuffer(data, "<u8", n_blocks + 1)
    docs = np.frombuffer(data, "<u8", n_docs + 1, 8 * (n_blocks + 1)).astype(np.int64)
    keys = np.frombuffer(data, "<i8", n_docs, 8 * (n_blocks + n_docs + 2))
    has = np.frombuffer(data, "u1", n_docs, 8 * (n_blocks + 2 * n_docs + 2))
    doc, parts = 0, []
    for first in range(0, n_blocks, blocks):
        last = min(first + blocks, n_blocks)
        raw = source.read_at(int(starts[last] - starts[first]), int(starts[first]))
        got = decode_blocks(raw, starts[first : last + 1] - starts[first])
        low, high = first * BLOCK, min(last * BLOCK, ids)
        while doc < n_docs and docs[doc] < high:
            parts.append(got[max(docs[doc], low) - low : min(docs[doc + 1], high) - low])
            if docs[doc + 1] > high:
                break
            yield (int(keys[doc]) if has[doc] else None), int(docs[doc]), parts
            doc, parts = doc + 1, []
    while doc < n_docs:  # documents without ids at the end
        yield (int(keys[doc]) if has[doc] else None), int(docs[doc]), []
        doc += 1


MANIFEST = "file_no int, path string, n_docs long, n_ids long, n_bytes long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all ``docs`` in ascending id order, one file for each range of ids; returns the manifest.

    Null text is empty (the end id alone), a null id sorts first and is kept as null, rows with the same id
    follow one another, an empty table gives no file or an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)

    def write(batches):
        from pyspark import TaskContext

        target = task_file(folder, ".tok")
        fs, path = opened(target)
        fs.create_dir(path.rpartition("/")[0])
        writer = Writer(fs.open_output_stream(path))
        for key, ids, _ in tokens.documents(batches, tokens.encoder(tokenizer)):
            writer.add(key, np.append(ids, np.uint32(end_id)))
        writer.close()
        size = fs.get_file_info(path).size
        yield pa.RecordBatch.from_pylist(
            [{"file_no": TaskContext.get().partitionId(), "path": target, "n_docs": len(writer.keys), "n_ids": writer.ids, "n_bytes": size}],
            schema=pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
        )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    return written(ordered.mapInArrow(write, MANIFEST))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Start over all files, count and CRC-32 of every document, read from the files of a manifest.

    One row a file passes through the window that sums what stands before each file.
    """
    before = F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = opened(path)
                rows = []
                with fs.open_input_file(name) as source:
                    for key, start, parts in read_documents(source):
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        rows.append({"doc_id": key, "start": base + start, "n_tokens": sum(map(len, parts)), "ids_crc32": crc})
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = max(1, manifest.count())
    return files.repartition(spread, "path").mapInArrow(read, READ)


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest)
