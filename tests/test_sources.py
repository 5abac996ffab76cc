"""Readers over small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftline.sources import dependencies, reports, runs, traces


def test_sarif(spark, tmp_path):
    step = lambda text, line: {"location": {"physicalLocation": {"artifactLocation": {"uri": "a.php"}, "region": {"startLine": line}}, "message": {"text": text}}}
    rule = {"id": "r1", "name": "TaintedSql", "properties": {"tags": ["external/cwe/cwe-79"], "security-severity": "5.0"}}
    result = {"ruleId": "r1", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.php"}, "region": {"startLine": 3, "endLine": 4}}}]}
    result["codeFlows"] = [{"threadFlows": [{"locations": [step("x", 1), step("y", 2), step("z", 3)]}]}]
    (tmp_path / "a.sarif").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "t", "rules": [rule]}}, "results": [result]}]}))
    (tmp_path / "b.sarif").write_text("{broken")
    found, bad = reports.read_sarif(spark, str(tmp_path))
    row = found.first()
    assert (row.finding_id, row.cwe, row.severity, row.file_path, row.truncated) == ("t:0:0:r1", "CWE-89", "medium", "a.php", True)
    assert [s.role for s in row.trace] == ["source", "step", "sink"]
    assert bad.count() == 1


def test_native(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"issues": [{"id": 1, "path": "x.py", "risk": "major", "cweId": "CWE-022"}, {"id": 2}]}))
    (tmp_path / "b.jsonl").write_text('{"key": "k", "file": "y.py", "line": "7"}\n\nnot json\n')
    good, pathless = reports.read_native(spark, str(tmp_path))
    rows = {r.finding_id: r for r in good.collect()}
    assert (rows["1"].severity, rows["1"].cwe, rows["k"].start_line, rows["k"].severity) == ("high", "CWE-22", 7, "unknown")
    assert pathless.count() == 1


def test_lock_files(spark, tmp_path):
    (tmp_path / "package-lock.json").write_text(
        json.dumps({"packages": {"": {}, "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "^2"}}, "node_modules/a/node_modules/b": {"version": "2.1.0", "dev": True}}})
    )
    nodes, edges = dependencies.npm_lock(spark, str(tmp_path))
    assert {(r.name, r.version, r.dev) for r in nodes.collect()} == {("a", "1.0.0", False), ("b", "2.1.0", True)}
    assert [(r.src, r.dst) for r in edges.collect()] == [("a", "b")]
    (tmp_path / "composer.lock").write_text(json.dumps({"packages": [{"name": "v/p", "version": "v1.2", "require": {"php": ">=8", "x/y": "*"}}], "packages-dev": []}))
    nodes, edges = dependencies.composer_lock(spark, str(tmp_path))
    assert [(r.name, r.version, r.dev) for r in nodes.collect()] == [("v/p", "1.2", False)]
    assert [r.dst for r in edges.collect()] == ["x/y"]
    (tmp_path / "yarn.lock").write_text('# yarn lockfile v1\n\n"@s/a@^1", "@s/a@^1.1":\n  version "1.1.0"\n  dependencies:\n    b "^2"\n\nb@^2:\n  version "2.0.1"\n')
    nodes, edges = dependencies.yarn_lock(spark, str(tmp_path))
    assert {(r.name, r.version) for r in nodes.collect()} == {("@s/a", "1.1.0"), ("b", "2.0.1")}
    assert [(r.src, r.dst) for r in edges.collect()] == [("@s/a", "b")]


def test_manifests(spark, tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"d": "1"}}))
    (tmp_path / "go.mod").write_text("module m\n\nrequire (\n\tgithub.com/x/y v1.2.3\n\tgithub.com/i/j v1.0.0 // indirect\n)\n")
    (tmp_path / "requirements.txt").write_text("Flask==2.0\n# note\n-r other.txt\n")
    got = {(r.ecosystem, r.name, r.dev) for r in dependencies.declared(spark, str(tmp_path)).collect()}
    assert got == {("npm", "a", False), ("npm", "d", True), ("go", "github.com/x/y", False), ("pypi", "flask", False)}


def test_advisories_and_feeds(spark, tmp_path):
    osv = {
        "id": "G-1", "aliases": ["CVE-1"], "summary": "s", "details": "d", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}],
        "references": [{"type": "WEB", "url": "https://h/pull/1"}, {"type": "FIX", "url": "https://h/x"}, {"type": "FIX", "url": "https://h/commit/2"}],
        "affected": [{"package": {"name": "a", "ecosystem": "npm"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2.0"}]}]}],
    }
    (tmp_path / "osv.json").write_text(json.dumps(osv))
    row = dependencies.advisories(spark, str(tmp_path / "osv.json")).first()
    assert (row.severity, row.fixed_versions, row.references) == ("critical", ["1.2.0"], ["https://h/commit/2", "https://h/x", "https://h/pull/1"])
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "cve-1", "dueDate": "2024-01-01", "knownRansomwareCampaignUse": "Known"}]}))
    assert dependencies.kev(spark, str(tmp_path / "kev.json")).first().asDict() == {"cve": "CVE-1", "due": "2024-01-01", "ransomware": True}
    (tmp_path / "epss.json").write_text(json.dumps({"data": [{"cve": "CVE-1", "epss": "0.5", "percentile": "0.9"}]}))
    assert dependencies.epss(spark, str(tmp_path / "epss.json")).first().epss == 0.5


def test_components(spark, tmp_path):
    doc = {"components": [{"bom-ref": "r1", "purl": "pkg:npm/a@1.0", "name": "a", "components": [{"bom-ref": "r2", "purl": "pkg:npm/b@2.0"}]}], "dependencies": [{"ref": "r1", "dependsOn": ["r2"]}]}
    (tmp_path / "x.cdx.json").write_text(json.dumps(doc))
    components, edges = dependencies.cyclonedx(spark, str(tmp_path))
    assert {(r.ref, r.name, r.version) for r in components.collect()} == {("r1", "a", "1.0"), ("r2", "b", "2.0")}
    assert [(r.src, r.dst) for r in edges.collect()] == [("r1", "r2")]


def test_source_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.js").write_text("x")
    (tmp_path / "node_modules" / "b.js").write_text("y")
    (tmp_path / "src" / "big.js").write_text("z" * 50)
    got = dependencies.source_files(spark, str(tmp_path), [".js"], most_bytes=10).collect()
    assert [r.text for r in got] == ["x"]


def test_nesting_has_no_limit(spark, tmp_path):
    doc = {"components": []}
    inner = doc["components"]
    for k in range(15):
        inner.append({"bom-ref": f"r{k}", "purl": f"pkg:npm/p{k}@1.{k}", "components": []})
        inner = inner[0]["components"]
    (tmp_path / "deep.cdx.json").write_text(json.dumps(doc))
    components, _ = dependencies.cyclonedx(spark, str(tmp_path))
    assert {r.name for r in components.collect()} == {f"p{k}" for k in range(15)}


def test_folder_of_mixed_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "message": {"text": "m"}}]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"findings": [{"id": "n1", "path": "x.py"}, {"id": "n2"}]}))
    (tmp_path / "c.jsonl").write_text('{"id": "n3", "path": "y.py"}\nbroken\n')
    (tmp_path / "d.sarif").write_text("{broken")
    (tmp_path / "scan-manifest.json").write_text(json.dumps({"scans": [{"scanner": "s", "ok": False}]}))
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "e.json").write_text(json.dumps([{"id": "n9", "path": "z.py"}]))
    found, aside = runs.read_findings(spark, str(tmp_path))
    assert {r.finding_id for r in found.collect()} == {"t:0:0:r", "n1", "n3"}
    assert sorted(r.reason for r in aside.collect()) == ["no JSON", "no JSON in a line", "no file path"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.json").write_text("[]")
    with pytest.raises(ValueError, match="no findings"):
        runs.read_findings(spark, str(tmp_path / "empty"))


def test_manifest_and_tables_come_back(spark, tmp_path):
    scans = spark.createDataFrame([("a", True, None, 3, 1.5), ("b", False, "", 0, 0.1)], "scanner string, ok boolean, error string, findings long, duration_s double")
    runs.write_manifest(scans, f"{tmp_path}/m")
    row = runs.scan_coverage(spark.read.text(f"{tmp_path}/m").withColumn("report", F.lit("r"))).first()
    assert (row.ran, [tuple(f) for f in row.failed], row.complete) == (["a"], [("b", "no reason recorded")], False)
    broken = spark.createDataFrame([("x", "{"), ("y", None)], "report string, value string")
    assert [r.complete for r in runs.scan_coverage(broken).collect()] == [False, False]
    runs.write_tables({"queue": scans.select("scanner"), "plan": scans.select("findings")}, str(tmp_path / "out"))
    assert spark.read.json(f"{tmp_path}/out/queue").count() == spark.read.json(f"{tmp_path}/out/plan").count() == 2


def test_streams_of_objects(spark):
    texts = [('{"a":"} {"}{"b":1}\n\n {"c":[{}]}',), ("",), (None,), ('{"a":1}{broken',)]
    got = spark.createDataFrame(texts, "t string").select(traces.stream_objects(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == [['{"a":"} {"}', '{"b":1}', '{"c":[{}]}'], [], [], ['{"a":1}']]
