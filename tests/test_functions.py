"""Scalar functions against hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftline.functions import scores, text, versions
from siftline.operators import filters, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "level"), [("Blocker", "critical"), (" error ", "high"), ("moderate", "medium"), ("note", "low"), ("none", "info"), ("odd", "unknown"), (None, "unknown")]
)
def test_severity_words(spark, word, level):
    assert one(spark, text.severity_word(F.lit(word).cast("string"))) == level


@pytest.mark.parametrize(("score", "level"), [("9.8", "critical"), ("7", "high"), ("0.1", "medium"), ("n/a", None)])
def test_numeric_severity_is_never_low(spark, score, level):
    assert one(spark, text.score_severity(F.lit(score))) == level


@pytest.mark.parametrize(
    ("vector", "score"),
    [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1),
        ("CVSS:3.0/AV:L/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0),
        ("CVSS:3.1/AV:N/AC:L", None),
        ("CVSS:2.0/AV:N", None),
    ],
)
def test_cvss(spark, vector, score):
    assert one(spark, scores.cvss3_base(F.lit(vector))) == score


@pytest.mark.parametrize(
    ("lower", "higher", "eco"),
    [("1.2.3-alpha.2", "1.2.3-alpha.10", "npm"), ("1.2.3-rc.1", "1.2.3", "npm"), ("1.2", "1.2.1", "npm"), ("v1.9.0+incompatible", "v1.10.0", "go"), ("2.0-beta3", "2.0", "composer"), ("2.0", "2.0-p1", "composer")],
)
def test_version_order(spark, lower, higher, eco):
    a, b = (versions.semver_key(F.lit(v), F.lit(eco)) for v in (lower, higher))
    assert one(spark, a < b)


def test_versions_that_cannot_be_ordered(spark):
    assert one(spark, versions.semver_key(F.lit("latest"), F.lit("npm"))) is None
    assert one(spark, versions.lenient_parts(F.lit("v1.2rc3.4"))) == [1, 23]
    assert one(spark, versions.release_parts(F.lit("1.2-rc1"))) is None


def test_range_order_decides(spark):
    none = F.lit(None).cast("string")
    event = lambda i=none, f=none: F.struct(i.alias("introduced"), f.alias("fixed"), none.alias("last_affected"), none.alias("limit"))
    ranges = F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(event(F.lit("0")), event(f=F.lit("2.0.0")), event(F.lit("oops"))).alias("events")))
    state = lambda v: one(spark, versions.version_state(F.lit(v), F.lit("npm"), F.array().cast("array<string>"), ranges))
    assert state("1.0.0") == "affected"
    assert state("3.0.0") == "unknown"
    assert state("") == "unknown"


def test_fingerprint_ignores_white_space_only(spark):
    f = lambda code: one(spark, text.fingerprint(F.lit("r"), F.lit(None).cast("string"), F.lit("a\\b.js"), F.lit(code)))
    assert f("x  =\n1") == f(" x = 1 ") != f("x = 2")


def test_shapes(spark):
    assert one(spark, text.cluster_shape(F.lit("run($a, 'it\\'s', 12)"))) == "I(I,I,I)"
    assert one(spark, text.variant_shape(F.lit("  $db->query('select 1') . x.name "))) == '$V->query("") . x.M'
    assert one(spark, text.distinctive(F.lit("eval($V) == 0")))


def test_entropy(spark):
    assert one(spark, text.entropy(F.lit("aabb"))) == pytest.approx(1.0)
    assert one(spark, text.entropy(F.lit(""))) == 0.0


def test_purl(spark):
    assert one(spark, text.purl_parts(F.lit("pkg:npm/%40a/b@1.2?x=1"))).asDict() == {"type": "npm", "name": "@a/b", "version": "1.2"}
    assert one(spark, text.purl_parts(F.lit("npm/b@1"))) is None


def test_scope_keeps_unknown(spark):
    scope = filters.Scope(only_ecosystems=["npm"], min_severity="high")
    rule = lambda eco, sev: one(spark, filters.scope_rule(scope, F.lit("r"), F.lit("p"), F.lit(eco).cast("string"), F.lit("c"), F.lit(sev)))
    assert rule("node", "high") is None
    assert rule("", "unknown") is None
    assert rule(None, "medium") == "below_min_severity"
    assert rule("pip", "critical") == "ecosystem:pypi"


def test_budget_skips_a_large_item_and_takes_a_later_small_one(spark):
    rows = [("r", 90, "a", 2, False), ("r", 80, "b", 9, False), ("r", 70, "c", 1, False), ("r", 5, "d", 1, False), ("r", 1, "e", 1, True)]
    df = spark.createDataFrame(rows, "run string, score int, path string, n int, exempt boolean")
    got = {r.path: r.deferred for r in windows.greedy_budget(df, "run", "score", "path", "n", "exempt", 30.0, 10).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True, "e": False}


def test_redaction(spark):
    from siftline.functions.fuzzy import redacted

    hide = lambda t: one(spark, redacted(F.lit(t).cast("string"))).asDict()
    got = hide("key = 'aB3$kQ9zLm2pXw7R' # x")
    assert got["hidden"] == 1 and "aB3$" not in got["text"] and got["text"].startswith("key = '<hidden: 16 characters, mixed")
    for kept in ("key = 'aaaaaaaaaaaaaaaaaaaa'", "url: https://example.com/a1b2c3d4e5f6", "short = x1y2", "two words here"):
        assert hide(kept) == {"text": kept, "hidden": 0}
    assert hide(None) == {"text": None, "hidden": 0}


def _budget(rows, pct, least):
    """The rule item by item: run, score, path, n, exempt to path's (deferred, overflowed)."""
    want = {}
    for run in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == run), key=lambda r: (-r[1], r[2]))
        allowed, spent = max(1, round(sum(r[3] for r in mine) * pct / 100)), 0
        over = sum(r[3] for r in mine if r[4]) > allowed
        for _, score, path, n, exempt in mine:
            later = not exempt and (score < least or spent + n > allowed)
            spent += 0 if later else n
            want[path] = (later, over)
    return want


def test_budget_streams_a_hot_run(spark):
    import random

    r = random.Random(5)
    rows = [(k % 3 and 7 or k % 11, r.randint(0, 100), f"p{k:06d}", r.randint(1, 60), r.random() < 0.02) for k in range(30_000)]
    rows += [(None, 50, "null-a", 1, False), (None, 40, "null-b", 9, False)]
    df = spark.createDataFrame(rows, "run long, score int, path string, n int, exempt boolean").repartition(5)
    out = windows.greedy_budget(df, "run", "score", "path", "n", "exempt", 30.0, 25)
    assert out.columns == [*df.columns, "deferred", "overflowed"]
    assert {x.path: (x.deferred, x.overflowed) for x in out.collect()} == _budget(rows, 30.0, 25)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [1, 4, 7])
def test_trimmed_traces_hold_few_steps(spark, limit):
    rows = [(key, turn, f"s{turn}") for key, n in ((1, 1), (2, 4), (3, 5), (4, 5000), (None, 9)) for turn in range(n)]
    df = spark.createDataFrame(rows, "k long, turn long, role string").repartition(7)
    got = {x.k: (x.steps, x.n) for x in windows.trim_traces(df, "k", ["turn", "role"], "role", limit).collect()}
    head = max(1, limit // 3)
    for key in (1, 2, 3, 4, None):
        steps = [role for k, _, role in rows if k == key]
        cut = steps if len(steps) <= limit else steps[:head] + steps[len(steps) - (limit - head) :]
        assert got[key] == (cut, len(steps))


def test_trace_queries_collect_no_conversation(spark):
    from siftline.plans.registry import QUERIES

    from .compare import DATA

    flags = QUERIES["f15_positioned_trace"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in flags
    trimmed = QUERIES["p28_trace_trimming"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert trimmed.count("WindowGroupLimit") == 2


@pytest.mark.parametrize(
    "secret",
    [
        'password="aB3;dE5,gH7jK9mN1pQ3sT5"', "clé=aB3dE5gH7jK9mN1pQ3sT5uV", "k²=aB3dE5gH7jK9mN1pQ3sT5uV", "k\u00a0:\u2003aB3dE5gH7jK9mN1pQ3sT5uV", "k\x1c=\x1daB3dE5gH7jK9mN1pQ3sT5uV",
        "k=\x85'aB3,dE5;gH7jK9mN'", "k=>aB3dE5gH7jK9mN1pQ3sT5uV", "k = >aB3dE5gH7jK9mN1pQ3sT5uV", "'k' : 'aB3dE5gH7jK9mN1p'", "ключ=аБ3дЕ5жЗ7иК9мН1пР3",
    ],
)
def test_redaction_sees_what_its_pattern_admits(spark, secret):
    from siftline.functions.fuzzy import redact, redacted

    want = redact(secret)
    assert want[1] == 1
    assert one(spark, redacted(F.lit(secret))).asDict() == {"text": want[0], "hidden": 1}


def test_grounding(spark):
    from siftline.functions.fuzzy import grounded

    code = F.lit("def run(cmd):\n    return os.system(cmd)\n")
    assert one(spark, grounded(F.lit("RETURN  os.system(cmd)"), code, 0.9))
    assert one(spark, grounded(F.lit("return os.systen(cmd)"), code, 0.8))
    assert not one(spark, grounded(F.lit("eval(request.args)"), code, 0.8))
    assert not one(spark, grounded(F.lit(""), code, 0.8))


def test_a_summary_is_repeated_only_as_a_whole(spark):
    flaw = lambda a, b: one(spark, text.flaw_paragraph(F.lit(a), F.lit(b)))
    assert flaw("en", "enough said.") == "en enough said." and flaw("It fails", "It fails. Badly.") == "It fails . Badly." and flaw("It fails", "It fails now") == "It fails now"
    assert one(spark, text.cut_behind_sentence(F.lit("ab. cd. ef"), 8)) == "ab. cd." and one(spark, text.cut_behind_sentence(F.lit("abcdefghij"), 8)) == "abcdefgh"


def test_paragraphs_keep_texts_that_begin_like_their_language(spark, tmp_path):
    from siftline.plans.registry import QUERIES

    spark.createDataFrame([(1, "enanst", "en"), (2, "x", None), (3, None, "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.flaw for r in QUERIES["p45_flaw_paragraph"](spark, str(tmp_path)).collect()}
    assert got == {1: "en enanst", 2: "x", 3: "fr"}
