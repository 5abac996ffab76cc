"""Every query outside the training-data subpackage runs, and agrees with its SQL where it has some."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftline.plans.registry import ORACLES, QUERIES

from .compare import DATA, canonical, connection


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = canonical(df.select(*(f"`{c}`" for c in columns)).collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows == canonical(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert rows


def test_passages_are_looked_up_whole(spark, tmp_path):
    texts = [(1, "alpha beta gamma delta, Zeta"), (2, "alpha beta gamma delta missing"), (3, " ., ")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "Alpha beta.", "en"), (2, "gamma\ndelta alpha", "en"), (3, "zeta", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("ASIA",)], "r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = {tuple(r) for r in QUERIES["j24_every_part"](spark, str(tmp_path)).select("item_id", "parts", "found", "state").collect()}
    assert got == {(1, 5, 5, "holds"), (2, 5, 4, "absent"), (3, 0, 0, "external")}
    counts = dict(QUERIES["j12_every_keyword"](spark, str(tmp_path)).select("keyword", "docs").collect())
    assert counts == {"alpha": 2, "beta": 1, "gamma": 1, "delta": 1, "zeta": 1}


def test_short_passages_are_found(spark):
    from siftline.operators import joins

    texts = spark.createDataFrame([(1, "it is so, unalterably fixed"), (2, "so be it"), (3, None), (4, "xone two three four five six sevenx")], "doc_id long, text string")
    asked = ["is so", "so", "alter", "one two three", "one two three four five six seven", "two  three", "fixed", None, "be it so", "so be it"]
    passages = spark.createDataFrame(list(enumerate(asked)), "item_id long, passage string")
    got = {tuple(r) for r in joins.containing(texts, "doc_id", "text", passages, "item_id", "passage").collect()}
    want = {(r.doc_id, i) for r in texts.collect() for i, p in enumerate(asked) if p is not None and r.text is not None and p in r.text}
    assert got == want


def test_review_queue_against_a_plain_loop(spark):
    """The queue and its summary: within a run clusters go by score and path, and the budget defers what does not fit."""
    items = {}
    for r in QUERIES["a19_review_queue"](spark, str(DATA)).collect():
        items.setdefault(r.run, []).append(r)
    summary = {r.run: r for r in QUERIES["a20_queue_summary"](spark, str(DATA)).collect()}
    assert set(summary) == set(items)
    for run, rows in items.items():
        rows.sort(key=lambda r: (-r.score, r.path))
        total = sum(r.cluster_size for r in rows)
        allowed, spent = max(1, round(total * 30.0 / 100)), 0
        for r in rows:
            deferred = not r.exempt and (r.score < 25 or spent + r.cluster_size > allowed)
            assert r.deferred == deferred
            spent += 0 if deferred else r.cluster_size
        s = summary[run]
        assert (s["items"], s.findings, s.deferred, s.collapsed) == (len(rows), total, sum(r.deferred for r in rows), total - len(rows))


def test_shapes_and_redaction_against_plain_python(spark):
    import hashlib
    import re
    from collections import Counter

    from siftline.functions.fuzzy import redact

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()

    def replaced(text, steps):
        for pattern, to in steps:
            text = re.sub(pattern, to, text)
        return text

    cluster = ((r"""(["'])(?:\\.|(?!\1).)*\1""", "S"), (r"\b\d+\b", "N"), (r"\$\w+", "V"), (r"\b[A-Za-z_]\w*\b", "I"), (r"\s+", ""))
    want = Counter((r.source, replaced(r.text or "", cluster)[:120]) for r in docs)
    assert {(r.source, r["shape"]): r.n for r in QUERIES["p21_cluster_shape"](spark, str(DATA)).collect()} == want
    variant = ((r"""(["'])(?:\.|(?!\1).)*\1""", '""'), (r"\b\d+\b", "0"), (r"\$\w+", "$V"), (r"(->|\.)\w+(?![\w(])", r"\1M"), (r"\s+", " "))
    want = Counter(replaced(line.strip(" "), variant).strip(" ") for r in docs if r.text is not None for line in r.text.split("\n"))
    assert {r["shape"]: r.n for r in QUERIES["p22_variant_shape"](spark, str(DATA)).collect()} == want
    hidden = {r.doc_id: (r.hidden, r.text_md5) for r in QUERIES["p24_secret_redaction"](spark, str(DATA)).collect()}
    for r in docs:
        text, n = redact(r.text) if r.text is not None else (None, 0)
        assert hidden[r.doc_id] == (n, None if text is None else hashlib.md5(text.encode()).hexdigest())


def test_percentiles_are_picked_by_index_on_any_ranges(spark):
    import random

    from siftline.operators.aggregates import index_percentiles

    r = random.Random(3)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), None if r.random() < 0.05 else float(r.randint(0, 300))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit("clash"))
    for keys in (["k"], []):
        got = {tuple(x[k] for k in keys): (x.p50, x.p95, x["max"], x.n) for x in index_percentiles(df, keys, "v").collect()}
        groups = {}
        for k, v in rows:
            if v is not None:
                groups.setdefault((k,) if keys else (), []).append(v)
        assert got == {k: (sorted(v)[len(v) // 2], sorted(v)[int(len(v) * 0.95)], max(v), len(v)) for k, v in groups.items()}


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_passages_are_grounded_as_by_hand(spark):
    from siftline.functions.fuzzy import similarity

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text}
    passages = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    rows = QUERIES["j34_passage_grounding"](spark, str(DATA)).collect()
    assert {(r.item_id, r.doc_id) for r in rows} == {(i, k) for i, p in passages.items() for k, t in texts.items() if p in t}
    plain = lambda t: " ".join(t.split()).lower()
    for r in rows:
        words = passages[r.item_id].split(" ")
        if r.item_id % 4 == 0:
            words[len(words) // 2] = "zzzz"
        quote = plain(" ".join(words) if r.item_id % 4 < 3 else passages[r.item_id][::-1])
        text = plain(texts[r.doc_id])
        assert r.grounded == (quote in text or similarity(quote, text) >= 0.85)
    assert {r.grounded for r in rows} == {True, False}
