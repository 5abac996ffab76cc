"""WARC archives with an index: written record by record, read back by byte ranges.

Each task writes one file of gzip members, one member per record, and returns an index row for each:
file, offset, length, URL and payload digest. Readers select index rows first, then fetch the selected
records in runs: ranges of one file are sorted and joined where they touch or nearly touch.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, table, written
from .storage import opened, task_file

#: Payloads from this size on are stored once.
SMALLEST_SHARED = 100
#: Ranges with at most this many bytes between them are read in one go, up to RUN bytes.
GAP = 64 << 10
RUN = 8 << 20
#: Bytes of a file that one reading task takes at a time.
STRETCH = 64 << 20

INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, path string, offset long, length long"
_INDEX = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    + [("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def plan_records(pages: DataFrame, ways: int = 64) -> DataFrame:
    """page_id, url, html, digest, bytes and the page each one repeats (null for those stored whole).

    The first page of a digest is found by salted minima, so that a payload of a third of all pages meets
    at most ``ways`` rows in one task, and comes back to the pages by the same salt.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).select(
        "page_id", "url", "html", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"), F.pmod(F.xxhash64("page_id", "url"), F.lit(ways)).cast("int").alias("salt")
    )
    large = rows.where(F.col("bytes") >= SMALLEST_SHARED)
    salted = large.groupBy("salt", "digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("size"))
    best = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("size").alias("size"))
    # Only pages that have a copy are joined; the others keep null.
    firsts = salted.select("salt", "digest").join(best.where(F.col("size") > 1).select("digest", "first"), "digest")
    return rows.join(firsts, ["salt", "digest"], "left").select(
        "page_id", "url", "html", "digest", "bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def _record(page_id, url, html, digest, size, refers_to) -> bytes:
    body = b"" if refers_to is not None else html.encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes a record for every page and returns the index (written, too).

    A null url leaves the target out, null html is the empty payload, a null page_id is stored as such and
    never is what others refer to: it revisits the page of its payload with an id, if there is one. Pages that share an id and a payload are all whole. An empty table gives
    an empty index. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)

    def write(batches):
        target = task_file(folder, ".warc.gz")
        fs, path = opened(target)
        fs.create_dir(path.rpartition("/")[0])
        at = 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in slices(batches, 2):
                index = []
                for page_id, url, html, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    member = zlib.compressobj(1, wbits=31)
                    data = member.compress(_record(page_id, url, html, digest, size, refers_to)) + member.flush()
                    out.write(data)
                    index.append((page_id, url, digest, size, "response" if refers_to is None else "revisit", refers_to, target, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), _INDEX.types, strict=True)], schema=_INDEX) if index else pa.RecordBatch.from_pylist([], schema=_INDEX)

    return written(plan_records(pages).mapInArrow(write, INDEX))


def ranges(records: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) records joined to (start, end, positions of records) runs."""
    runs: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(records):
        if runs and offset - runs[-1][1] <= GAP and offset + length - runs[-1][0] <= RUN:
            start, end, inside = runs[-1]
            runs[-1] = (start, max(end, offset + length), [*inside, i])
        else:
            runs.append((offset, offset + length, [i]))
    return runs


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = zlib.decompress(data, wbits=31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string"
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload", pa.string())]
)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given index rows, read from the archives.

    The digest and the size of a whole record are computed anew from the payload read; those of a revisit
    come from its header, as it has no payload. ``payloads`` False leaves the text out.
    """

    def page(uri: str) -> int | None:
        text = uri[len("<urn:page:") : -1]
        return int(text) if text else None

    def rows(path: str, records: list[tuple[int, int]]):
        fs, name = opened(path)
        with fs.open_input_file(name) as source:
            for start, end, inside in ranges(records):
                data = source.read_at(end - start, start)
                for i in inside:
                    offset, length = records[i]
                    fields, body = _parse(data[offset - start : offset - start + length])
                    target = fields.get("WARC-Target-URI")
                    target = target and target.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    whole = fields["WARC-Type"] == "response"
                    yield (
                        page(fields["WARC-Record-ID"]),
                        target,
                        fields["WARC-Type"],
                        None if whole else page(fields["WARC-Refers-To"]),
                        hashlib.sha256(body).hexdigest() if whole else fields["WARC-Payload-Digest"].partition(":")[2],
                        len(body) if whole else int(fields["X-Payload-Length"]),
                        body.decode() if payloads and whole else None,
                    )

    def read(batches):
        def flush(path, records):
            found, size = [], 0
            for row in rows(path, records):
                found.append(row)
                size += len(row[-1] or "")
                if len(found) == 512 or size > RUN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _RECORD.types, strict=True)], schema=_RECORD)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _RECORD.types, strict=True)], schema=_RECORD)

        path, records = None, []
        for batch in batches:
            for p, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != path or len(records) == 8192:
                    if records:
                        yield from flush(path, records)
                    path, records = p, []
                records.append((offset, length))
        if records:
            yield from flush(path, records)

    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = index.select("path", "offset", "length").repartition("path", stretch).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read, RECORD)


def resolved(records: DataFrame, ways: int = 16) -> DataFrame:
    """``records`` (of ``read_records``, without payloads) with each revisit's size and digest from the response that it refers to.

    They are null where no such response was read or its payload is not the one that the revisit names. A response that many
    pages revisit meets them by salts.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    whole, again = records.where("record_type = 'response'").select(names), records.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(ways)).cast("int"))
    asked = again.select("refers_to", "payload_digest", "salt").distinct()
    found = whole.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    found = asked.join(found, ["refers_to", "payload_digest"]).withColumns({"digest": F.col("payload_digest"), "bytes": F.col("payload_bytes")})
    back = again.drop("payload_bytes").join(found.drop("payload_bytes"), ["refers_to", "payload_digest", "salt"], "left")
    return whole.unionByName(back.select("page_id", "url", "record_type", "refers_to", F.col("digest").alias("payload_digest"), F.col("bytes").alias("payload_bytes")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    # Read once: both sides of the lookup need the records.
    records = written(read_records(index, payloads=False).drop("payload"))
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
