"""Toxicity, conversation repair and the Merkle manifest against brute force, held-out labels and odd input."""

from __future__ import annotations

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from siftline.llm import conversation_repair as repair
from siftline.llm import merkle, toxicity

from ..compare import DATA, canonical

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()

# --- manifest ---------------------------------------------------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, pos long, node string"


def brute_manifest(rows):
    """The manifest by plain lists: rows are (doc_id, text, lang, source, n_chars)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(part, (r[0], r[3], r[2], r[4], text)))
    levels = lambda nodes: [nodes] if len(nodes) == 1 else [nodes, *levels([H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)])]
    path = lambda tree, i: [(level[i // 3**k // 3 * 3 : i // 3**k], level[i // 3**k + 1 : i // 3**k // 3 * 3 + 3]) for k, level in enumerate(tree[:-1])]
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = levels([leaf(r, r[1]) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            siblings = path(trees[s], i) + path(top, k)
            text = r[1].replace("\n", "") if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            folded = leaf(r, text)
            for left, right in siblings:
                folded = H(*left, folded, *right)
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], H(*(x for p in siblings for q in p for x in q)), folded, folded == top[-1][0]))
    return out


def documents(rng, count, sources):
    return [(rng.choice([None, *range(40)]), rng.choice([None, "", "a\nb", "é\n\nß", "x" * 5000, "plain"]), rng.choice([None, "en"]), rng.choice(sources), rng.choice([None, 7])) for _ in range(count)]


@pytest.mark.parametrize(("count", "sources"), [(0, ["a"]), (1, [None]), (3, ["a"]), (4, ["b", "a"]), (200, [None, "", "ä", "z", "a", "A", "b", "c", "d", "e", "f"]), (2300, ["hot"])])
def test_manifest(spark, count, sources):
    rows = documents(random.Random(count), count, sources)
    got = merkle.manifest(spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], DOCUMENTS))
    assert canonical(got.collect()) == canonical(brute_manifest(rows))


def test_manifest_many_sources(spark):
    """More sources than one task raises."""
    rows = [(i, f"t\n{i}", "en", f"s{i % 800}", i) for i in range(900)]
    got = merkle.manifest(spark.createDataFrame([(*r, None, None, None) for r in rows], DOCUMENTS).repartition(7))
    assert canonical(got.collect()) == canonical(brute_manifest(rows))


# --- conversations ------------------------------------------------------------------------------------------------------------

COLUMNS = "conv_id long, turn long, role string, text string, key string, block long"


def brute_repair(rows):
    """The cheapest edits of one damaged conversation by trying all, by (cost, audit); rows are (turn, role, text) in order."""
    fault, seen = [], set()
    for _, role, text in rows:
        bare = text.translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserts):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for r in legal[last]:
                if r != "s":
                    c, e, t = best(i, r, inserts + 1)
                    options.append((c + 5, "I" + e, (("user:" if r == "u" else "assistant:"), *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, t = best(i + 1, last, 0)
            options.append((c + 2, "D" + e, t))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 * (fault[i] == "truncated")
                if role and role[0] in legal[last]:
                    c, e, t = best(i + 1, role[0], 0)
                    options.append((c + more, "K" + e, (f"{role}:{text}", *t)))
                for r in legal[last]:
                    if r != "s":
                        c, e, t = best(i + 1, r, 0)
                        options.append((c + 1 + more, "R" + e, (f"{'user' if r == 'u' else 'assistant'}:{text}", *t)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    cost, audit, said = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, H("\n".join(said)))


def brute_conversations(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        dealt = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if dealt:
            text = "" if dealt == 1 else text.translate({ord(c): None for c in ".!?"}) if dealt == 2 else text
            own.extend([(turn, "user" if dealt == 4 else role, text)] * (2 if dealt == 3 else 1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), H(r[2]))
    return [(conv, *brute_repair(sorted(own, key=key))) for conv, own in convs.items()]


def talk(rng, conv, length):
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "", "  \n", None, "A. \t", "Why?"]
    return [(conv, rng.choice([None, k, k, k, k + 2]), rng.choices(roles, [6, 6, 2, 1, 1, 1])[0], rng.choice([f"{k}.", *texts])) for k in range(length)]


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_repair(spark, block):
    rng = random.Random(5)
    rows = [r for conv in [None, *range(40)] for r in talk(rng, conv, rng.randint(1, 9))]
    # One row alone that the damage drops.
    alone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(alone, 0, "user", "Hi."), *[(77, 3, "user", "Same.")] * 30, *[(78, k % 2, "user", "Same.") for k in range(9)]]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS)
    got = repair.repaired(repair.damaged(frame), frame, block)
    assert canonical(got.collect()) == canonical(brute_conversations(rows))


def test_repair_of_one_long_conversation(spark):
    """Blocks are chained: the same rows in blocks of 7 and as one, and many rows that are alike."""
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"{k}.", f"{k}", ""])) for k in range(700)] + [(1, 900, "user", "Same.")] * 5000
    frame = spark.createDataFrame([(*r, None, None) for r in rows], COLUMNS)
    got = [repair.repaired(repair.damaged(frame), frame, block).collect() for block in (7, 1024)]
    assert got[0] == got[1]
    assert len(got[0]) == 1 and got[0][0]["duplicate"] >= 4999


def test_no_conversations(spark):
    frame = spark.createDataFrame([], COLUMNS)
    assert repair.repaired(repair.damaged(frame), frame).collect() == []


def test_shared_suffixes_are_made_once(monkeypatch):
    made = []
    real = repair.node
    monkeypatch.setattr(repair, "node", lambda letter, behind: made.append(letter) or real(letter, behind))
    pairs = sorted((repair.END, s[::-1]) for s in ["ua", "sua", "xua", "uaua", "saua"])
    assert [x[1] for x in repair.paths(iter(pairs))] == [x[1] for x in pairs]
    # a, ua, sua, xua, aua, uaua, saua
    assert len(made) == 7


# --- toxicity -----------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    folder = DATA.parent / "sf0.1"
    got = toxicity.op11_toxicity(spark, str(folder))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic", "quality")
    rows = got.join(labels, "doc_id").where("held_out and quality = 1").collect()
    toxic = [r for r in rows if r["toxic"]]
    assert len(toxic) > 50 and np.mean([r["predicted"] for r in toxic]) > 0.93
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) < 0.005
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


SCORED = "doc_id long, text string, lang string, score double, held_out boolean"


def scored(spark, texts, toxic, more=()):
    docs = spark.createDataFrame([(k, t, "en", None, None) for k, t in [*enumerate(texts), *more]], SCORED)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    return {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}


def test_swaps_take_the_weight_from_names(spark, monkeypatch):
    """Insults in the labels come with one group's name; a neutral mention of it must not be toxic for that."""
    rng = random.Random(1)
    calm = [f"w{k}" for k in range(60)]
    texts, toxic = [], []
    for k in range(900):
        bad = k % 3 == 0
        words = rng.sample(calm, 8) + (["muslim"] if bad and rng.random() < 0.9 else ["christian"] if rng.random() < 0.2 else [])
        words += ["scum"] if bad and rng.random() < 0.6 else []
        rng.shuffle(words)
        texts.append(" ".join(words) + ".")
        toxic.append(int(bad))
    neutral = [(5001, "the muslim w1 w2 w3."), (5002, "the christian w1 w2 w3."), (5003, "w4 scum w5.")]
    with_penalty = scored(spark, texts, toxic, neutral)
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    monkeypatch.setattr(toxicity.fit, "__defaults__", (toxicity.RIDGE, 0.0))
    without = scored(spark, texts, toxic, neutral)
    assert without[5001]["predicted"] == 1 and without[5001]["score"] - without[5002]["score"] > 0.5
    assert with_penalty[5001]["predicted"] == 0 and abs(with_penalty[5001]["score"] - with_penalty[5002]["score"]) < 0.1
    assert with_penalty[5003]["predicted"] == 1


def test_odd_rows_get_scores(spark):
    texts = ["you idiot scum", "fine day here", "", None, "x" * 3000] * 30
    got = scored(spark, texts, [1, 0, 0, 0, 0] * 30, [(None, "you idiot scum"), (7, "again"), (7, "again"), (9, "calm. " * 400_000 + "you idiot scum")])
    assert len(got) == 151 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[None]["held_out"] and got[None]["predicted"] == 1 and got[9]["predicted"] == 1 and got[2]["score"] == got[3]["score"] and not got[2]["predicted"]
    assert scored(spark, ["a"], [])[0]["score"] == 0.5
    assert scored(spark, ["a b", "a c"], [None, None])[1]["score"] == 0.5
    assert scored(spark, [], []) == {}


def test_features_do_not_depend_on_the_cut(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["idiot", "Ärger", "a", "longer-words", "trash,"]) for _ in range(rng.randint(0, 300))) for _ in range(20)]
    keys = np.unique(toxicity.features(texts)[0])[::3]
    whole, pairs = toxicity.present(texts, keys), toxicity.distinct(texts)
    monkeypatch.setattr(toxicity, "TOGETHER", 50)
    for a, b in [*zip(whole, toxicity.present(texts, keys), strict=True), *zip(pairs, toxicity.distinct(texts), strict=True)]:
        assert (a == b).all()
