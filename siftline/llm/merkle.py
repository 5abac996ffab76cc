"""Merkle dataset manifest by time-forward processing.

Every node has a label (tree, level, index); a node's digest is a message to the label of its parent, and a queue ordered by
label hands each node its children's digests before it is its turn. A second sweep in reversed order hands every node
what its leaves' proofs need from above.

The queue is external: inside a task it is a heap over one block of ``BLOCK`` consecutive nodes, which it raises by
``LEVELS`` levels; messages to labels above the block are written as a table, which Spark sorts by label for the next round.
A round shrinks its table to 1/``BLOCK``, so there are a handful of rounds at any size, and no task holds more than a block,
whatever share of all rows one tree has. The reversed sweep runs the rounds backwards: the proof suffix of a block's
root is a row that is sorted in front of the block's nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc_sql, numbered, shared_dir, table, written

#: Consecutive nodes that become one.
RUN = 3
#: Levels that one task raises, and the nodes it does so for.
LEVELS = 6
BLOCK = RUN**LEVELS
#: Rows of an Arrow batch that a task returns.
ROWS = 512

_SUFFIX = "left array<string>, right array<string>, subroot string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves: while several nodes remain, every run becomes one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def swept_up(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of a block's nodes, level by level: messages to parents come out of a queue ordered by label."""
    queue = [(0, i, 0, d) for i, d in enumerate(digests)]
    heapq.heapify(queue)
    found: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        level, index, _, first = heapq.heappop(queue)
        children = [first]
        while queue and queue[0][:2] == (level, index):
            children.append(heapq.heappop(queue)[3])
        own = digest(*children) if level else first
        found[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, index // RUN, index % RUN, own))
    return found


def swept_down(found: list[list[str]], above) -> list:
    """The proof of each node of the lowest level, as a chain (left siblings, right siblings, the parent's chain); ``above`` is that of the block's root."""
    queue = [(1 - len(found), 0, above)]
    proofs = []
    while queue:
        level, index, chain = heapq.heappop(queue)
        level = -level
        if not level:
            proofs.append((index, chain))
            continue
        run = found[level - 1][RUN * index : RUN * index + RUN]
        for k in range(len(run)):
            heapq.heappush(queue, (1 - level, RUN * index + k, ("".join(run[:k]), "".join(run[k + 1 :]), chain)))
    return [chain for _, chain in sorted(proofs, key=lambda x: x[0])]


def _links(chain) -> Iterator[tuple[str, str]]:
    while chain is not None:
        left, right, chain = chain
        yield left, right


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from batch.slice(at, ROWS).to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block; a task's rows are sorted by key, block and pos."""
    for _, rows in itertools.groupby(_rows(batches), key=lambda r: (r["key"], r["block"])):
        yield list(rows)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_pylist(part, schema)


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def raised(leaves: DataFrame, folder: str) -> list[DataFrame]:
    """Tables of nodes (key, pos, n, node), from the leaves to one root for each key; each is one round above the last."""
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])

    def run(batches):
        def roots():
            for rows in _blocks(batches):
                n = rows[0]["n"]
                top = swept_up([r["node"] for r in rows], min(LEVELS, height(n)))[-1][0]
                yield {"key": rows[0]["key"], "pos": rows[0]["block"], "n": -(-n // BLOCK), "node": top}

        yield from _batches(roots(), schema)

    tables = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 1
    while True:
        nodes = _by_block(_with_block(tables[-1].select("key", "pos", "n", "node")))
        tables.append(written(nodes.mapInArrow(run, "key string, pos long, n long, node string"), f"{folder}/{len(tables)}"))
        most = -(-most // BLOCK)
        if most == 1:
            return tables


def lowered(nodes: DataFrame, above: DataFrame, fields: list[str], finish, schema: str) -> DataFrame:
    """The reversed sweep of one round: ``finish`` of (a node's row with ``fields``, its chain, the message of its block) makes a row of ``schema``.

    ``above`` has a row (key, block, left, right, subroot, root) for each block.
    """
    kinds = {f: t for f, t in nodes.dtypes if f in fields}
    empty = {f: F.lit(None).cast(t) for f, t in kinds.items()}
    messages = above.select("key", "block", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("node"),
                            *(c.alias(f) for f, c in empty.items()), "left", "right", "subroot", "root")
    blank = [F.lit(None).cast("array<string>").alias(c) for c in ("left", "right")] + [F.lit(None).cast("string").alias(c) for c in ("subroot", "root")]
    mixed = messages.unionByName(_with_block(nodes).select("key", "block", "pos", "n", "node", *kinds, *blank))
    arrow = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (x.split(" ") for x in schema.split(", "))])

    def run(batches):
        def rows():
            for message, *own in _blocks(batches):
                chain = None
                for left, right in zip(reversed(message["left"]), reversed(message["right"]), strict=True):
                    chain = (left, right, chain)
                found = swept_up([r["node"] for r in own], min(LEVELS, height(own[0]["n"])))
                for row, proof in zip(own, swept_down(found, chain), strict=True):
                    yield finish(row, proof, message)

        yield from _batches(rows(), arrow)

    return _by_block(mixed).mapInArrow(run, schema)


def _suffix(row: dict, chain, message: dict) -> dict:
    links = list(_links(chain))
    return {"key": row["key"], "block": row["pos"], "left": [x for x, _ in links], "right": [x for _, x in links], "subroot": message["subroot"], "root": message["root"]}


def _proof(row: dict, chain, message: dict) -> dict:
    links = list(_links(chain))
    folded = row["tampered"] or row["node"]
    for left, right in links:
        folded = digest(left, folded, right)
    proof = digest(*(left + right for left, right in links))
    return {"doc_id": row["doc_id"], "leaf": row["node"], "subroot": message["subroot"], "root": message["root"], "proof_sha256": proof, "folded_root": folded, "verified": folded == message["root"]}


def _field(column):
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each as byte count, ``:`` and value, or ``-`` where null. Leaves
    of one source are in order of doc_id, nulls first; rows that share an id in order of their digests; rows alike in everything are
    leaves of their own. The sources' roots, null first, then by bytes, make the root. Text of rows whose crc32 of the decimal id
    is even loses its line ends before it is checked; a row without an id is checked as it is. A single row is its own root, and
    its proof is the digest of nothing. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    folder = shared_dir(docs.sparkSession)
    leaf = lambda text: F.sha2(F.concat(*(_field(docs[c]) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256)
    even = F.crc32(docs["doc_id"].cast("long").cast("string")) % 2 == 0
    leaves = docs.select(
        # Null before all names, and names by their bytes.
        F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")).alias("key"),
        docs["doc_id"].cast("long").alias("doc_id"),
        leaf(docs["text"]).alias("node"),
        F.when(even & F.contains(docs["text"], F.lit("\n")), leaf(F.translate(docs["text"], "\n", ""))).alias("tampered"),
    )
    leaves = written(numbered(leaves, ["doc_id", "node"], f"{folder}/ranges"), f"{folder}/leaves")
    trees = raised(leaves, f"{folder}/up")
    sources = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "node")
    sources = written(numbered(sources, ["source"], f"{folder}/source_ranges"), f"{folder}/sources")
    tops = raised(sources, f"{folder}/top")

    none = F.array().cast("array<string>")
    above = tops[-1].select("key", F.col("pos").alias("block"), none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for k in range(len(tops) - 2, 0, -1):
        above = written(lowered(tops[k], above, [], _suffix, f"key string, block long, {_SUFFIX}"), f"{folder}/top_down_{k}")
    # What a source's tree gets from above is keyed by the source from here on.
    handed = lambda row, chain, message: _suffix(row, chain, message) | {"key": row["source"], "block": 0, "subroot": row["node"]}
    above = written(lowered(tops[0], above, ["source"], handed, f"key string, block long, {_SUFFIX}"), f"{folder}/handed")
    for k in range(len(trees) - 2, 0, -1):
        above = written(lowered(trees[k], above, [], _suffix, f"key string, block long, {_SUFFIX}"), f"{folder}/down_{k}")
    return lowered(trees[0], above, ["doc_id", "tampered"], _proof, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _levels_sql(name: str, leaves: str) -> str:
    """All levels of the trees of ``leaves`` (key, nodes) as lists."""
    return f"""{name} AS (
  SELECT key, 0 AS level, nodes FROM {leaves}
  UNION ALL
  SELECT key, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(concat(nodes[3 * i + 1], nodes[3 * i + 2], nodes[3 * i + 3]))) FROM {name} WHERE len(nodes) > 1)"""


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, {_leaf_sql("text")} AS leaf,
         CASE WHEN {crc_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS checked
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
leaves AS (SELECT key, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY key),
{_levels_sql("trees", "leaves")},
subroots AS (SELECT key, nodes[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos FROM trees WHERE len(nodes) = 1),
tops AS (SELECT '' AS key, list(subroot ORDER BY pos) AS nodes FROM subroots),
{_levels_sql("top", "tops")},
whole AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
path AS (
  SELECT p.key, p.pos, t.level, list_filter(list_transform(range(3), lambda i: t.nodes[3 * (p.pos // (3 ** t.level)::BIGINT // 3) + i + 1]), lambda x: x IS NOT NULL) AS run, p.pos // (3 ** t.level)::BIGINT % 3 AS own
  FROM placed p JOIN trees t USING (key) WHERE len(t.nodes) > 1
  UNION ALL
  SELECT p.key, p.pos, 1000 + t.level, list_filter(list_transform(range(3), lambda i: t.nodes[3 * (s.pos // (3 ** t.level)::BIGINT // 3) + i + 1]), lambda x: x IS NOT NULL), s.pos // (3 ** t.level)::BIGINT % 3
  FROM placed p JOIN subroots s USING (key), top t WHERE len(t.nodes) > 1),
proofs AS (
  SELECT key, pos, list([array_to_string(run[:own], ''), array_to_string(run[own + 2:], '')] ORDER BY level) AS links FROM path GROUP BY key, pos),
folded AS (
  SELECT p.*, coalesce(q.links, []) AS links, list_reduce(list_concat([p.checked], list_transform(coalesce(q.links, []), lambda x: x[1] || '|' || x[2])),
         lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM placed p LEFT JOIN proofs q USING (key, pos))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(links, lambda x: x[1] || x[2]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (key), whole
"""
