"""Classes behind container ids by hand."""

from __future__ import annotations

from siftline.operators import container

YAML = """# services
parameters:
    a: '@no'
services:
    _defaults:
        autowire: true
    App\\Mailer: '@mailer.real'
    mailer.real:
        class: 'App\\Smtp'   # the one
    "App\\Loop": '@App\\Pool'
    App\\Pool: '@App\\Loop'
    App\\Cached:
        decorates: store
        arguments:
            $inner: '.inner'
            $fallback: '@App\\Mailer'
    store:
        alias: store.file
    store.file:
        class: App\\FileStore
    App\\Odd:
        decorates: bundle.thing
when:
    b: '@c'
"""
PHP = """<?php
namespace App;
final class Cached {
    private readonly Store $inner;
    public function __construct(
        private ?Fallback $fallback, protected Mailer $mailer, Loop $loop, Unknown $unknown, int $n
    ) {}
}
"""


def test_receivers(spark):
    files = spark.createDataFrame([("p", "config/services.yaml", YAML), ("p", "src/Cached.php", PHP), ("p", "src/Odd.php", PHP.replace("Cached", "Odd")), ("p", "config/null.yaml", None), ("p", "src/readme.yaml", YAML)], "project string, path string, text string")
    wiring = container.services(files)
    ends = {r.id: r["class"] for r in container.resolved_services(wiring).collect()}
    assert ends["App\\Mailer"] == "App\\Smtp" and ends["mailer.real"] == "App\\Smtp" and ends["App\\Loop"] is None and ends["App\\Pool"] is None and ends["store"] == "App\\FileStore" and ends["bundle.thing"] is None
    asked = [("src/Cached.php", p, c) for p, c in (("inner", "filestore"), ("inner", "Smtp"), ("fallback", "Smtp"), ("mailer", "FileStore"), ("n", "Smtp"), ("none", "Smtp"))] + [("src/Odd.php", "inner", "X"), ("src/None.php", "inner", "X")]
    sites = spark.createDataFrame([("p", path, k, f"$this->{prop}", c) for k, (path, prop, c) in enumerate(asked)] + [("p", "src/Cached.php", 99, "$other->x", "Smtp")], "project string, path string, line int, receiver string, class string")
    got = {r.line: (r.found, r.called) for r in container.receivers_by_configuration(sites, files, wiring).collect()}
    assert got == {0: ("FileStore", True), 1: ("FileStore", None), 2: ("Smtp", True), 3: ("FileStore", True), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 99: (None, None)}


def test_types_lead_on_only_by_configuration(spark):
    yaml = "services:\n    App\\Mailer: '@App\\Smtp'\n    App\\Smtp: '@App\\Fast'\n"
    php = "<?php\nclass User {\n  private App\\Mailer $a;\n  private App\\Fast $b;\n  private App\\Loop $c;\n}"
    loop = "services:\n    App\\Loop: '@App\\Loop2'\n    App\\Loop2: '@App\\Loop3'\n    App\\Loop3: '@App\\Loop2'\n"
    files = spark.createDataFrame([("p", "config/a.yaml", yaml), ("p", "config/packages/b.yml", loop), ("p", "a.php", php)], "project string, path string, text string")
    sites = spark.createDataFrame([("p", "a.php", k, f"$this->{x}", "Fast") for k, x in enumerate("abc")], "project string, path string, line int, receiver string, class string")
    got = {r.line: (r.found, r.called) for r in container.receivers_by_configuration(sites, files, container.services(files)).collect()}
    assert got == {0: ("Fast", True), 1: (None, None), 2: (None, None)}
