"""Conversation structure repair over a suffix-shared automaton.

What a repair costs depends only on each row's role initial and fault. So a conversation becomes a signature, a letter a row, and
all conversations' signatures one acyclic automaton whose nodes are suffixes: signatures that end alike share their nodes
from the end on. At each node and grammar state the cost to go and the best first edit are found once, from the node behind;
the best audit suffix is that edit and the best suffix of the node that it leads to.

In Spark the distinct signatures are sorted by their reversal, which puts those with a common end side by side: a task walks
them in order and keeps the nodes of the current signature only, so shared nodes are not made again and a task holds one signature.

A conversation may be of any length. Its signature is cut into blocks of ``BLOCK`` rows; a block's automaton ends in the cost vector of the
block behind it instead of the end of the conversation. Those vectors come from the least costs between the grammar
states at either end of each block, chained from the last block to the first.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE, SPACES, crc_sql, numbered, salt, shared_dir, table, written

#: Rows of a conversation that one node path covers.
BLOCK = 1024
#: Grammar states of (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row of a role leads; other roles lead nowhere.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where the only legal new or changed role leads.
CHANGED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Edits in the order of their initials; a cost is kept as four times itself and the edit that it begins with, so that ties are the order of initials.
EDITS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
UNMENDED = 5
NEVER = 1 << 60
#: Costs to go at the end of a conversation, and how the automaton is told that a block is the last.
FINAL = (0, 10, 5, 0)
END = "end"
FORCED = "x"


def node(letter: str, behind: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
    """(cost to go, first edit) of each state at a node: a row's signature letter and the node behind it.

    Letters are role initials, ``o`` for others, in capitals where the text is truncated, ``x`` for a row that has to go.
    """
    role, fine = letter.lower(), letter.islower()
    mend = 0 if fine else UNMENDED
    first = []
    for state in range(4):
        options = [4 * (COSTS["D"] + behind[state][0]) + DELETE]
        if letter != FORCED:
            options.append(4 * (COSTS["R"] + mend + behind[CHANGED[state]][0]) + REROLE)
            if (state, role) in KEPT:
                options.append(4 * (mend + behind[KEPT[state, role]][0]) + KEEP)
        first.append(min(options))
    insert = lambda target: 4 * (COSTS["I"] + target // 4) + INSERT
    user, assistant = min(first[USER], insert(first[ASSISTANT])), min(first[ASSISTANT], insert(first[USER]))
    found = (min(first[START], insert(user)), min(first[SYSTEM], insert(user)), user, assistant)
    return tuple((min(x // 4, NEVER), x % 4) for x in found)


def _root(exit_: str) -> tuple[tuple[int, int], ...]:
    return tuple((c, INSERT) for c in (FINAL if exit_ == END else map(int, exit_.split(","))))


def paths(reversed_signatures: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, list]]:
    """(exit, reversed signature, nodes from the end to the first row) of sorted pairs; nodes that two neighbours share are made once."""
    at, before, nodes = None, "", []
    for exit_, text in reversed_signatures:
        shared = 0
        if exit_ == at:
            most = min(len(before), len(text))
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del nodes[shared + 1 :]
        else:
            nodes = [_root(exit_)]
        for letter in text[shared:]:
            nodes.append(node(letter, nodes[-1]))
        at, before = exit_, text
        yield exit_, text, nodes


def walk(exit_: str, text: str, nodes: list, state: int) -> tuple[str, int]:
    """The best edits of a path from a state on, and the state at its end."""
    edits = []
    for k in range(len(text), -1, -1):
        while (k or exit_ == END and state in (SYSTEM, USER)) and nodes[k][state][1] == INSERT:
            edits.append("I")
            state = CHANGED[state]
        if k:
            edit = nodes[k][state][1]
            edits.append(EDITS[edit])
            state = KEPT[state, text[k - 1].lower()] if edit == KEEP else CHANGED[state] if edit == REROLE else state
    return "".join(edits), state


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _sorted_signatures(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().repartitionByRange("exit", "mirrored").sortWithinPartitions("exit", "mirrored")


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_pylist(part, schema)


def _plans(pairs: DataFrame) -> DataFrame:
    """exit, mirrored, and for each entry state the edits and the state behind."""
    schema = pa.schema([("exit", pa.string()), ("mirrored", pa.string()), ("edits", pa.list_(pa.string())), ("leads", pa.list_(pa.int32()))])

    def run(batches):
        def rows():
            for exit_, text, nodes in paths(_pairs(batches)):
                walks = [walk(exit_, text, nodes, s) for s in range(4)]
                yield {"exit": exit_, "mirrored": text, "edits": [x[0] for x in walks], "leads": [x[1] for x in walks]}

        yield from _batches(rows(), schema)

    return _sorted_signatures(pairs).mapInArrow(run, "exit string, mirrored string, edits array<string>, leads array<int>")


def _exits(blocks: DataFrame) -> DataFrame:
    """key, block, exit of conversations of several blocks: the least costs between states of each block, chained from the last block on."""
    units = [",".join("0" if s == t else str(NEVER) for s in range(4)) for t in range(4)]
    schema = pa.schema([("exit", pa.string()), ("mirrored", pa.string()), ("costs", pa.list_(pa.int64()))])

    def run(batches):
        rows = ({"exit": e, "mirrored": t, "costs": [c for c, _ in nodes[-1]]} for e, t, nodes in paths(_pairs(batches)))
        yield from _batches(rows, schema)

    # From each of the four states at a block's end on, or from the end of the conversation.
    ends = F.when(F.col("last"), F.array(F.lit(END))).otherwise(F.array(*map(F.lit, units)))
    asked = blocks.select("key", "block", "mirrored", F.explode(ends).alias("exit"))
    costs = _sorted_signatures(asked.select("exit", "mirrored")).mapInArrow(run, "exit string, mirrored string, costs array<long>")
    to = F.when(F.col("exit") == END, F.lit(0)).otherwise(F.array_position(F.array(*map(F.lit, units)), F.col("exit")))
    costs = asked.join(costs, ["exit", "mirrored"]).select("key", "block", to.cast("int").alias("to"), "costs")
    out = pa.schema([("key", pa.string()), ("block", pa.int64()), ("exit", pa.string())])

    def chain(batches):
        def rows():
            each = (r for b in batches for r in b.to_pylist())
            for _, conversation in itertools.groupby(each, key=lambda r: r["key"]):
                behind = None
                for (key, block), parts in itertools.groupby(conversation, key=lambda r: (r["key"], -r["block"])):
                    parts = {r["to"]: r["costs"] for r in parts}
                    if behind is None:
                        exit_, behind = END, parts[0]
                    else:
                        least = min(behind)
                        exit_ = ",".join(str(c - least) for c in behind)
                        behind = [min(min(parts[t + 1][s] + behind[t], NEVER) for t in range(4)) for s in range(4)]
                    yield {"key": key, "block": -block, "exit": exit_}

        yield from _batches(rows(), out)

    ordered = costs.repartition("key").sortWithinPartitions("key", F.desc("block"))
    return ordered.mapInArrow(chain, "key string, block long, exit string")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A row for each conversation from its rows in order, its blocks' plans in front of them and a row that says it exists in front of all."""
    each = (r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
    for _, rows in itertools.groupby(each, key=lambda r: r["key"]):
        own = next(rows)
        out = {"conv_id": own["conv_id"], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        audit, hashed, turns, low, high, last_turn, before = [], hashlib.sha256(), 0, None, None, None, None
        state, place, begun = START, START, False
        edits: Iterator[str] = iter(())

        def say(role: str, text: str) -> None:
            nonlocal begun
            if begun:
                hashed.update(b"\n")  # noqa: B023
            hashed.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))  # noqa: B023
            begun = True

        def insert() -> None:
            nonlocal place
            place = CHANGED[place]
            audit.append("I")  # noqa: B023
            out["cost"] += COSTS["I"]  # noqa: B023
            say(ROLE[place], "")

        for row in rows:
            if row["edits"] is not None:
                edits, state = iter(row["edits"][state]), row["leads"][state]
                continue
            times, kind, role = row["times"], row["kind"], row["role"]
            if row["turn"] is not None:
                turns += row["turn"] != last_turn
                low, high, last_turn = row["turn"] if low is None else low, row["turn"], row["turn"]
            out["blank"] += times if kind == "blank" else 0
            out["duplicate"] += times if kind == "duplicate" else 0 if kind == "blank" else times - 1
            out["truncated"] += kind == "truncated"
            out["illegal"] += times - 1 + (before is not None and before + role[:1] not in ("su", "ua", "au"))
            before = role[:1]
            while (edit := next(edits)) == "I":
                insert()
            audit.append(edit + "D" * (times - 1))
            out["cost"] += COSTS[edit] + COSTS["D"] * (times - 1) + (UNMENDED if kind == "truncated" and edit != "D" else 0)
            if edit == "K":
                place = KEPT[place, role[:1]]
                say(role, row["text"])
            elif edit == "R":
                place = CHANGED[place]
                say(ROLE[place], row["text"])
            if row["ends"]:
                for _ in edits:
                    insert()
        out["gaps"] = 0 if low is None else high - low + 1 - turns
        yield out | {"audit": "".join(audit), "repaired_sha256": hashed.hexdigest()}


_RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame, ids: DataFrame, block: int = BLOCK, ways: int = 64) -> DataFrame:
    """One row for each id of ``ids`` (conv_id): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` are conv_id, turn, role, text and times (how often the row stands there, one copy after the other); role and text are not
    null. Rows are in order of turn, nulls first; rows of one turn by role, then by the text's SHA-256. A null id is a conversation
    like any other. An empty role has no initial: it fits nowhere and is changed or deleted. An id without rows gets zeros, an
    empty audit and the hash of nothing. A conversation's digest is sequential by nature: one task streams each, whatever its length, and holds
    its audit only; everything before is spread by ranges, blocks and salts. No ids give no rows.
    """
    folder = shared_dir(rows.sparkSession)
    key = lambda df: F.coalesce(df["conv_id"].cast("string"), F.lit(""))
    alike = rows.select(key(rows).alias("key"), F.col("turn").cast("long").alias("turn"), "role", F.sha2("text", 256).alias("digest"), "text", F.col("times").cast("long").alias("times"))
    alike = alike.groupBy("key", "turn", "role", "digest").agg(F.max("text").alias("text"), F.sum("times").alias("times"))
    seen = F.translate("text", SPACES, "")
    placed = numbered(alike, ["turn", "role", "digest"], f"{folder}/ranges")
    placed = placed.withColumn("block", F.floor(F.col("pos") / block).cast("long")).withColumn("blank", seen == "").withColumn("open", ~F.substring(seen, -1, 1).isin(".", "!", "?"))
    placed = written(placed, f"{folder}/placed")

    # The first place of each role and text of a conversation; salted, as one text may be most of the table.
    short = placed.select("key", "role", "digest", "pos", salt("pos", ways).alias("salt"))
    salted = short.groupBy("salt", "key", "role", "digest").agg(F.min("pos").alias("first"))
    first = salted.groupBy("key", "role", "digest").agg(F.min("first").alias("first"))
    first = salted.select("salt", "key", "role", "digest").join(first, ["key", "role", "digest"])
    kind = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    judged = placed.drop("text").withColumn("salt", salt("pos", ways)).join(first, ["salt", "key", "role", "digest"])
    judged = written(judged.select("key", "block", "pos", "n", "turn", "role", "times", kind.alias("kind")), f"{folder}/judged")

    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    letter = F.when(F.col("kind").isin("blank", "duplicate"), FORCED).when(F.col("kind") == "truncated", F.upper(initial)).otherwise(initial)
    blocks = judged.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter")))).alias("letters"), F.max("n").alias("n"))
    mirrored = F.reverse(F.array_join(F.col("letters")["letter"], ""))
    blocks = written(blocks.select("key", "block", mirrored.alias("mirrored"), (F.col("n") > block).alias("several"), (F.col("block") == F.floor((F.col("n") - 1) / block)).alias("last")), f"{folder}/blocks")
    several = _exits(blocks.where("several"))
    ended = blocks.where("not several").withColumn("exit", F.lit(END)).unionByName(blocks.where("several").join(several, ["key", "block"])).select("key", "block", "mirrored", "exit", F.pmod(F.xxhash64("key", "block"), F.lit(ways)).cast("int").alias("salt"))

    # Signatures that many conversations share come back by salts.
    plans = _plans(ended.select("exit", "mirrored"))
    plans = ended.select("salt", "exit", "mirrored").distinct().join(plans, ["exit", "mirrored"])
    plans = ended.join(plans, ["salt", "exit", "mirrored"]).select("key", "block", "edits", "leads")

    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    fields = {"conv_id": "long", "turn": "long", "role": "string", "text": "string", "times": "long", "kind": "string", "ends": "boolean", "edits": "array<string>", "leads": "array<int>"}
    blank = {f: none(f, t) for f, t in fields.items()}
    exists = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    exists = exists.select(key(exists).alias("key"), F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("pos"), "conv_id", *(c for f, c in blank.items() if f != "conv_id"))
    planned = plans.select("key", "block", F.lit(-1).cast("long").alias("pos"), "edits", "leads", *(c for f, c in blank.items() if f not in ("edits", "leads")))
    ends = ((F.col("pos") + 1) % block == 0) | (F.col("pos") + 1 == F.col("n"))
    texts = judged.join(placed.select("key", "pos", "text"), ["key", "pos"])
    texts = texts.select("key", "block", "pos", "turn", "role", "text", "times", "kind", ends.alias("ends"), *(blank[f] for f in ("conv_id", "edits", "leads")))
    stream = exists.unionByName(planned).unionByName(texts).repartition("key").sortWithinPartitions("key", "block", "pos")
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in _RESULT])

    def run(batches):
        yield from _batches(_finished(batches), schema)

    return stream.mapInArrow(run, ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in _RESULT))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: the rows that are left after the damage that crc32 of ``conv_id:turn`` deals; nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    dealt = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("dealt"),
    ).where("dealt != 0")
    return dealt.select(
        "conv_id",
        "turn",
        F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("dealt") == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired(damaged(conversations), conversations)


def _best_sql(state: int) -> str:
    """The least of a row's own edits in a state: four times the cost and the edit's number; ``v`` are the costs behind."""
    kept = " ".join(f"WHEN ini = '{r}' THEN v[{t + 1}]" for (s, r), t in KEPT.items() if s == state)
    own = f"CASE WHEN forced THEN NULL ELSE 4 * ({COSTS['R']} + mend + v[{CHANGED[state] + 1}]) + {REROLE} END, CASE WHEN forced THEN NULL {kept.replace('THEN v', f'THEN 4 * mend + {KEEP} + 4 * v')} ELSE NULL END"
    return f"least(4 * ({COSTS['D']} + v[{state + 1}]) + {DELETE}, {own})"


def _insert_sql(x: str) -> str:
    return f"4 * ({COSTS['I']} + {x} // 4) + {INSERT}"


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS dealt
  FROM conversations, crc_table),
damaged AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS key, turn, CASE WHEN dealt = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN dealt = 1 THEN '' WHEN dealt = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN dealt = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE dealt <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY key) AS n,
         substr(role, 1, 1) AS ini, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS seen
  FROM damaged),
f AS (
  SELECT *, seen = '' AS blank, seen <> '' AND row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 AS duplicate,
         lag(ini) OVER (PARTITION BY key ORDER BY i) AS before
  FROM placed),
g AS (
  SELECT *, blank OR duplicate AS forced, CASE WHEN NOT blank AND NOT duplicate AND NOT regexp_matches(seen, '[.!?]$') THEN {UNMENDED} ELSE 0 END AS mend FROM f),
back AS (
  SELECT DISTINCT key, n + 1 AS i, {list(FINAL)}::BIGINT[] AS v, ['', 'I', 'I', ''] AS e FROM g
  UNION ALL
  SELECT key, i, list_transform(x, lambda y: y // 4), list_transform(x, lambda y: '{EDITS}'[y % 4 + 1]) FROM (
    SELECT key, i, [least(b[1], {_insert_sql("uu")}), least(b[2], {_insert_sql("uu")}), uu, least(b[4], {_insert_sql("b[3]")})] AS x FROM (
      SELECT key, i, b, least(b[3], {_insert_sql("b[4]")}) AS uu FROM (
        SELECT g.key, g.i, [{", ".join(_best_sql(s) for s in range(4))}] AS b FROM back JOIN g ON g.key = back.key AND g.i = back.i - 1)))),
steps AS (SELECT back.key, back.i, e, n, role, text, ini, mend FROM back LEFT JOIN g ON g.key = back.key AND g.i = back.i),
forth AS (
  SELECT key, 1::BIGINT AS i, {START} AS state, '' AS audit, 0::BIGINT AS cost, []::VARCHAR[] AS said FROM g WHERE i = 1
  UNION ALL
  SELECT key, i + CASE WHEN edit = 'I' THEN 0 ELSE 1 END, nxt, audit || edit,
         cost + CASE edit WHEN 'D' THEN {COSTS["D"]} WHEN 'I' THEN {COSTS["I"]} WHEN 'K' THEN mend ELSE {COSTS["R"]} + mend END,
         CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
              ELSE list_append(said, CASE WHEN nxt = {USER} THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT p.*, s.role, s.text, s.mend, s.e[p.state + 1] AS edit,
           CASE WHEN s.e[p.state + 1] = 'D' THEN p.state WHEN s.e[p.state + 1] = 'K' THEN CASE s.ini WHEN 's' THEN {SYSTEM} WHEN 'u' THEN {USER} ELSE {ASSISTANT} END
                WHEN p.state = {USER} THEN {ASSISTANT} ELSE {USER} END AS nxt
    FROM forth p JOIN steps s ON s.key = p.key AND s.i = p.i WHERE s.e[p.state + 1] <> '')),
done AS (SELECT key, arg_max(audit, length(audit)) AS audit, max(cost) AS cost, arg_max(said, length(audit)) AS said FROM forth GROUP BY key),
counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(mend > 0) AS truncated,
         count_if(before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY key)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.key = coalesce(c.conv_id::VARCHAR, '') LEFT JOIN done d ON d.key = k.key
"""
