"""Routes and framework rules: a file is read where it is, and a line that a task has seen before is not read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import entrypoints, routes

FILES = "project string, path string, text string"
PHP = "<?php\r\n#[Route('/base')]\r\nclass A {\r\n  /** @Route(\r\n   \"/q\", methods=\"PUT\") */\r\n  // more\r\n  #[Route(path: '/p')]\r\n  public function one() {\r\n  }\r\n  public function two() {\r\n  }\r\n  #[Route('/last')]\r\n}"


def test_marks_belong_to_the_next_method_below(spark):
    found = routes.routes(spark.createDataFrame([("p", "src/A.php", PHP), ("p", "src/B.php", ""), ("p", "src/C.php", None)], FILES))
    got = sorted((r["class"], r.method, r.first, r.last, r.route, r.verbs, r.declared_by, r.level, r.address) for r in found.collect())
    assert got == [
        ("A", "one", 8, 9, "/base", None, "attribute", "class", None), ("A", "one", 8, 9, "/p", None, "attribute", "method", "/base/p"), ("A", "one", 8, 9, "/q", "PUT", "annotation", "method", "/base/q"),
    ]


def test_a_line_is_read_once():
    read = []
    said = lambda line: read.append(line) or routes._said(line)
    kept = routes.lru_cache(100)(said)
    rows = [list(routes._of_file("a.php", PHP.replace("\r", ""), kept, routes._arguments)) for _ in range(50)]
    assert len(read) == len(set(read)) < 14 and all(r == rows[0] for r in rows) and len(rows[0]) == 5


def test_matching_lines_shuffle_nothing(spark):
    files = spark.createDataFrame([("p", "a.go", 'x\r\n\t_ "a.b/c"\r\n_ "d"'), ("p", "b.go", ""), ("p", "c.go", None), ("p", "d.py", '_ "e"')], FILES)
    found = entrypoints._matching(files, F.col("path").rlike("go$"), r'^\s*_\s+"([^"]+)"', "name")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("p", "a.go", 2, '\t_ "a.b/c"', "a.b/c"), ("p", "a.go", 3, '_ "d"', "d")]
