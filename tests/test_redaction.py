"""Structured configuration without its secrets, by hand."""

from __future__ import annotations

from siftline.operators import redaction

YAML = """db:
  password: hunter2  # why
  user: me
  api_key: '%env(KEY)%'
  access_token:
    token_handler: App\\Handler
  secret:
    a: 1

    b:
      c: 2
  other: 3
  private_key: |
    LINE
    LINE
tokens:
- one
- two
next: 4
my.secret: true
handler.secret: App\\Secret\\Store
"""
JSON = '{"a": {"db_password": "x\\"y", "n": 1}, "secrets": {"k": ["v", {"deep": "]"}],\n "m": 2},\n "token": null, "api_keys": ["p",\n"q"], "tokenizer": "w"}'
PHP = "<?php return [\n  'password' => 'p',\n  'secret' => env('X'),\n  'tokens' => ['a' => 'b',\n    'c' => 'd'],\n  'class' => Foo::class,\n  'token' => Foo::class,\n];"
XML = '<c><password>p</password><parameter key="api_key">k</parameter><parameter name="size">s</parameter><item value="v" key="token"/><item name="secret" value=\'w\'/><secret>%env(X)%</secret></c>'


def test_redaction(spark):
    rows = [("p", n, t) for n, t in (("a.yaml", YAML), ("b.json", JSON), ("c.php", PHP), ("d.xml", XML), ("e.yaml", None), ("f.yaml", ""), ("g.json", '{"secret": [1, [2'), ("h.txt", "nothing here"))]
    got = {}
    for r in redaction.redacted_lines(spark.createDataFrame(rows, "project string, path string, text string")).orderBy("path", "line").collect():
        got.setdefault(r.path, []).append(r.code)
    r = "<REDACTED>"
    assert got["a.yaml"] == [
        "db:", f"  password: {r}", "  user: me", "  api_key: '%env(KEY)%'", "  access_token:", "    token_handler: App\\Handler", "  secret:", f"    {r}", r, f"    {r}", f"      {r}", "  other: 3", "  private_key: |", f"    {r}", f"    {r}",
        "tokens:", r, r, "next: 4", "my.secret: true", "handler.secret: App\\Secret\\Store", "",
    ]
    assert "\n".join(got["b.json"]) == f'{{"a": {{"db_password": {r}, "n": 1}}, "secrets": {r}\n,\n "token": null, "api_keys": {r}\n, "tokenizer": "w"}}'
    assert got["c.php"] == ["<?php return [", f"  'password' => {r},", f"  'secret' => {r},", f"  'tokens' => {r}", ",", "  'class' => Foo::class,", "  'token' => Foo::class,", "];"]
    assert got["d.xml"] == [f'<c><password>{r}</password><parameter key="api_key">{r}</parameter><parameter name="size">s</parameter><item value={r} key="token"/><item name="secret" value={r}/><secret>%env(X)%</secret></c>']
    assert "e.yaml" not in got and got["f.yaml"] == [""] and got["g.json"] == [f'{{"secret": {r}'] and got["h.txt"] == ["nothing here"]


def test_one_level_covers_what_all_levels_would():
    import random

    from siftline.operators.redaction import covered_lines

    rng = random.Random(5)
    for _ in range(3000):
        marks = [rng.choice((0, 0, 0, 1, 1, 2, 4, 8, 9, 16)) + 32 * rng.randrange(4) for _ in range(rng.randrange(12))]
        after = [next((n for n in marks[k + 1 :] if not n & 4), 0) for k in range(len(marks))]
        opens = [bool(m & 1 or m & 2 and not after[k] & 16) for k, m in enumerate(marks)]
        want = [False] * len(marks)
        for level in {m // 32 for m in marks}:
            held = False
            for k, m in enumerate(marks):
                closes = not m & 4 and (m // 32 < level or m // 32 == level and not m & 8)
                want[k] |= held and not closes
                held = True if opens[k] and m // 32 == level else False if closes else held
        assert (covered_lines(marks) or [False] * len(marks)) == want


def test_lines_are_not_shuffled(spark):
    files = spark.createDataFrame([("p", "a.yaml", "a:\n  token:\n\n    x: 1\n  b: 2"), ("p", "b.yaml", None), ("p", "c.yaml", "")], "project string, path string, text string")
    df = redaction.redacted_lines(files)
    assert [r.code for r in df.where("path = 'a.yaml'").orderBy("line").collect()] == ["a:", "  token:", "<REDACTED>", "    <REDACTED>", "  b: 2"] and df.count() == 6
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
