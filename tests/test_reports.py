import json
import os

import pytest
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve import session
from credsieve.functions import text
from credsieve.operators import baseline, findings
from credsieve.plans import jobs
from credsieve.sinks import onefile, reports
from credsieve.sources.tables import BaselineError, load_baseline
from credsieve.streaming import scan as streaming
from tests import model

SCHEMA = (
    "repo string, file_path string, line_number bigint, matched_text string, detection_method string, "
    "pattern_name string, confidence string, commit_sha string, entropy_score double, "
    "detector_ord int, pattern_ord int, match_ord int"
)


@pytest.fixture
def table(spark):
    def build(*changes):
        base = ["o/r", "app.env", 12, "AKIA***0000", "regex", "AWS access key", "high", "c1", 1.5, 1, 1, 0]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        rows = []
        for change in changes:
            row = dict(zip(names, base)) | change
            rows.append(tuple(row[n] for n in names))
        return spark.createDataFrame(rows, SCHEMA)

    return build


MEDIUM = {"detection_method": "entropy", "pattern_name": fixed.ENTROPY_PATTERN_NAME, "confidence": "medium",
          "detector_ord": 2, "pattern_ord": 0, "line_number": 3}
LOW = {"pattern_name": "Own <b> & 'rule'", "confidence": "low", "pattern_ord": 3, "file_path": "a\"b"}


def prints(frame):
    return [r.fingerprint for r in findings.with_fingerprint(frame).collect()]


def test_fingerprint_ignores_commit_and_confidence(table):
    first = prints(table({}))
    assert first == prints(table({"commit_sha": "c2", "confidence": "low"}))
    for change in ({"matched_text": "x"}, {"line_number": 13}, {"repo": "o/s"}, {"detection_method": "entropy"}):
        assert prints(table(change)) != first
    assert first == [model.fingerprint("o/r", "app.env", 12, "regex", "AWS access key", "AKIA***0000")]


def test_snapshot_and_suppression(table, spark, tmp_path):
    frame = table({}, {"commit_sha": "c2"}, {"confidence": "low"}, MEDIUM)
    assert baseline.snapshot(frame).count() == 2
    reports.write_baseline(table({}), str(tmp_path / "b"))
    kept = baseline.unaccepted(frame, load_baseline(spark, str(tmp_path / "b"))).collect()
    assert [r.pattern_name for r in kept] == [fixed.ENTROPY_PATTERN_NAME]
    assert jobs.finish(frame, load_baseline(spark, str(tmp_path / "b")), "high").count() == 0


def test_empty_baseline(table, spark, tmp_path):
    reports.write_baseline(table(MEDIUM).where("false"), str(tmp_path / "b"))
    assert baseline.unaccepted(table({}), load_baseline(spark, str(tmp_path / "b"))).count() == 1


@pytest.mark.parametrize(
    "document,want",
    [({"accepted": [{"fingerprint": "a", "repo": "r"}, {"fingerprint": 5}, 7, {"x": 1}, {"fingerprint": "b"}, {"fingerprint": "a"}]}, ["a", "b"]),
     ({"accepted": []}, [])],
)
def test_baseline_documents(spark, tmp_path, document, want):
    path = tmp_path / "baseline.json"
    path.write_text(json.dumps(document, indent=2))
    assert sorted(r.fingerprint for r in load_baseline(spark, str(path), "document").collect()) == want


@pytest.mark.parametrize(
    "content,message", [("{nope", "no JSON document"), ("[]", "no JSON document|no list"), ('{"accepted": 5}', "no list of accepted"), (None, "there is no baseline")]
)
def test_bad_baselines(spark, tmp_path, content, message):
    path = tmp_path / "baseline.json"
    if content is not None:
        path.write_text(content)
    with pytest.raises(BaselineError, match=message):
        load_baseline(spark, str(path), "document")


def test_baseline_lines(spark, tmp_path):
    """Lines that are no entries accept nothing, whichever comes first."""
    path = tmp_path / "b.jsonl"
    path.write_text('{"fingerprint": 5}\n{nope\n\n{"fingerprint": "a"}\n7\n{"fingerprint": "a", "x": 1}\n')
    assert [r.fingerprint for r in load_baseline(spark, str(path)).collect()] == ["a"]
    with pytest.raises(BaselineError, match="there is no baseline"):
        load_baseline(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="a baseline is one of"):
        load_baseline(spark, str(path), "yaml")


def test_severity(table):
    frame = table({}, MEDIUM, LOW)
    counts = {s: findings.at_least(frame, s).count() for s in (None, "low", "medium", "high")}
    assert counts == {None: 3, "low": 3, "medium": 2, "high": 1}
    with pytest.raises(ValueError):
        findings.at_least(frame, "top")


def test_summary_and_gate(table, spark):
    frame, none = table({}, MEDIUM), table({}).where("false")
    texts = [findings.summary(f).first().summary for f in (frame, table({}), none)]
    assert texts == ["2 potential secrets found.", "1 potential secret found.", "No findings detected."]
    failures = spark.createDataFrame([("o/x", "main", "e")], "repo string, branch string, error string")
    status = lambda *a, **k: findings.gate_status(*a, **k).first().status
    assert status(frame) == 0
    assert status(frame, fail_on_findings=True) == 3
    assert status(none, fail_on_findings=True) == 0
    assert status(frame, failures, fail_on_findings=True) == 2
    assert status(frame, failures.where("false"), fail_on_findings=True) == 3
    assert reports.failure_rows(failures).first().message == "Warning: skipped o/x@main: e"


def test_order(table):
    frame = table(MEDIUM, {"match_ord": 2}, {}, {"file_path": "sub/a"}, {"file_path": "zz"}, {"repo": "a/a"})
    got = [(r.repo, r.file_path, r.detector_ord, r.match_ord) for r in findings.ordered(frame).collect()]
    assert got == [("a/a", "app.env", 1, 0), ("o/r", "app.env", 1, 0), ("o/r", "app.env", 1, 2),
                   ("o/r", "app.env", 2, 0), ("o/r", "zz", 1, 0), ("o/r", "sub/a", 1, 0)]


def written(spark, frame, kind, folder):
    """The files of a report in the order of their names, joined."""
    reports.write_report(frame, kind, str(folder))
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_sarif(table, spark, tmp_path):
    frame = table({"line_number": 20, "match_ord": 1}, {}, MEDIUM, LOW | {"repo": "o/s"})
    doc = json.loads(written(spark, frame, "sarif", tmp_path / "s"))
    assert doc["version"] == "2.1.0" and doc["$schema"] == fixed.SARIF_SCHEMA
    run = doc["runs"][0]
    rules = run["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules] == ["aws-access-key-regex", "high-entropy-token-entropy", "own-b-rule-regex"]
    assert rules[0]["defaultConfiguration"]["level"] == "error" and rules[0]["shortDescription"]["text"] == "AWS access key"
    lines = [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]]
    assert lines[:2] == [12, 20] and len(lines) == 4 and run["results"][3]["level"] == "note"
    first = run["results"][0]
    assert first["ruleId"] == "aws-access-key-regex" and first["level"] == "error"
    assert first["message"]["text"] == "AWS access key detected via regex in o/r."
    assert first["locations"][0]["physicalLocation"]["artifactLocation"] == {"uri": "app.env"}
    assert list(first["partialFingerprints"]) == ["secretScannerFingerprint/v1"]
    found = {r.rule_id: (r.name, r.level) for r in reports.sarif_rules(frame).collect()}
    assert found["own-b-rule-regex"] == (LOW["pattern_name"], "note") and len(found) == 3


def test_sarif_of_a_clean_scan(table, spark, tmp_path):
    doc = json.loads(written(spark, table({}).where("false"), "sarif", tmp_path / "s"))
    assert doc["runs"][0]["results"] == [] and doc["runs"][0]["tool"]["driver"]["rules"] == []


def test_rule_level_comes_from_the_first_finding(table, spark, tmp_path):
    frame = table({"confidence": "low", "file_path": "sub/a"}, {"confidence": "high", "file_path": "zz"})
    assert [r.level for r in reports.sarif_rules(frame).collect()] == ["error"]  # a walk visits files before folders
    doc = json.loads(written(spark, frame, "sarif", tmp_path / "s"))
    assert doc["runs"][0]["tool"]["driver"]["rules"][0]["defaultConfiguration"]["level"] == "error"
    assert [r["level"] for r in doc["runs"][0]["results"]] == ["error", "note"]


def test_a_large_report_is_one_ordered_document(table, spark, tmp_path):
    frame = table(*[{"line_number": i, "match_ord": i} for i in range(3000)], {"repo": "o/s"}).repartition(40)
    results = json.loads(written(spark, frame, "sarif", tmp_path / "s"))["runs"][0]["results"]
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in results] == [*range(3000), 12]
    assert written(spark, frame, "html", tmp_path / "h").count("<tr><td>") == 3001


def test_html(table, spark, tmp_path):
    frame = table({"entropy_score": 3.625}, LOW)
    page = written(spark, frame, "html", tmp_path / "a")
    assert page.startswith("<!doctype html>") and page.rstrip().endswith("</html>")
    assert "<td>Own &lt;b&gt; &amp; &#x27;rule&#x27;</td>" in page and "<td>a&quot;b</td>" in page
    assert "<td>12</td><td>3.62</td><td><code>AKIA***0000</code></td><td><code>c1</code></td></tr>" in page
    empty = written(spark, frame.where("false"), "html", tmp_path / "b")
    assert empty.count("<tr>") == 2 and '<td colspan="9">No findings detected.</td>' in empty


def test_two_decimals(spark):
    numbers = [i / 128 for i in range(1100)] + [i / 1000 for i in range(2000)] + [0.005, 2.675, 1.005, 4.787782031835939, 15.995]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double").coalesce(1)
    assert [r[0] for r in frame.select(text.two_decimals(F.col("x"))).collect()] == [f"{x:.2f}" for x in numbers]


def test_places(table):
    frame = table({"match_ord": 3}, {"match_ord": 1}, {"repo": "a/a"}, {"match_ord": 2}).repartition(4)
    got = sorted((r.place, r.repo, r.match_ord) for r in findings.numbered(frame).collect())
    assert got == [(1, "a/a", 0), (2, "o/r", 1), (3, "o/r", 2), (4, "o/r", 3)]
    ranked = frame.withColumn("repo_pos", F.when(F.col("repo") == "o/r", 0)).withColumn("commit_pos", 9 - F.col("match_ord"))
    ranked = ranked.withColumn("unit_ord", F.lit(0))
    assert [(r.repo, r.match_ord) for r in findings.ordered(ranked).collect()] == [("o/r", 3), ("o/r", 2), ("o/r", 1), ("a/a", 0)]


def test_work_folders(spark, monkeypatch):
    with session.scratch(spark):
        rows = session.keep(spark.range(3), "test")
        folder = session._MADE[-1]
        assert rows.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder)

    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master, "spark.app.id": "x"}

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(session.WorkFolderError, match="spark.checkpoint.dir"):
            session.work_folder(Session(master), "test")
    monkeypatch.setattr(session, "_MADE", [])
    assert session.work_folder(Session("local[2]"), "test")


def test_writers(table, spark, tmp_path):
    frame = table({}, MEDIUM | {"repo": "o/s"})
    reports.write_report(frame, "json", str(tmp_path / "json"))
    line = json.loads(spark.read.text(str(tmp_path / "json")).orderBy("value").first().value)
    assert list(line) == sorted(line) and line["line_number"] == 12 and len(line) == 9
    with pytest.raises(ValueError, match="no report format 'pdf'"):
        reports.write_report(frame, "pdf", str(tmp_path / "x"))
    failures = spark.createDataFrame([("o/x", "main", "e")], "repo string, branch string, error string")
    reports.write_failures(failures, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).first().message == "Warning: skipped o/x@main: e"


@pytest.mark.parametrize("kind", ["json", "sarif", "html"])
def test_one_file(table, spark, tmp_path, kind):
    """One file holds what the parts hold, in finding order, with all its bytes."""
    changes = [{"line_number": i, "match_ord": i, "file_path": f"ä{i % 7}/日.txt"} for i in range(300)]
    frame = table(*changes, MEDIUM, LOW).repartition(5)
    path = tmp_path / "new" / f"report.{kind}"
    for _ in range(2):  # the second replaces the first
        reports.write_report_file(frame, kind, str(path))
    assert [p.name for p in path.parent.iterdir()] == [path.name]
    whole = path.read_text()
    if kind == "json":
        rows = [json.loads(line) for line in whole.splitlines()]
        order = [(r.file_path, r.line_number) for r in findings.ordered(frame).collect()]
        assert [(r["file_path"], r["line_number"]) for r in rows] == order
    else:
        assert whole == written(spark, frame, kind, tmp_path / "parts")
    reports.write_report_file(frame.where("false"), kind, str(path))
    assert (path.read_text() == "") == (kind == "json")


def test_failed_file(table, spark, tmp_path):
    """A job that fails leaves nothing, and an older report as it was."""
    path = tmp_path / "report"
    rows = spark.range(200).select(F.col("id").alias("place"), F.col("id").cast("string").alias("fragment"))
    onefile.write_one(rows, str(path))
    before = path.read_text()
    assert before == "".join(f"{i}\n" for i in range(200))
    places, size = onefile.placed(rows)
    spark.dataSource.register(onefile.OneFileSource)
    options = {"staged": str(tmp_path / "staged"), "target": str(path), "size": str(size)}
    broken = places.withColumn("data", F.when(F.col("at") > 500, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    short = places.where("at <> 41")
    for frame in (broken, short):
        with pytest.raises(Exception, match="lost|bytes were written"):
            frame.write.format("onefile").mode("append").options(**options).save()
        assert path.read_text() == before and [p.name for p in tmp_path.iterdir()] == ["report"]
    with pytest.raises(onefile.OneFileError, match="is a folder"):
        onefile.write_one(rows, str(tmp_path))


def test_stream(spark, units, tmp_path):
    rng = model.rng(31)
    frame = units(*[model.random_text(rng) for _ in range(60)])
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accepted = baseline.snapshot(jobs.scan_units(frame).where("detection_method = 'entropy'"))
    accepted.write.parquet(str(tmp_path / "accepted"))
    out = streaming.scan_stream(stream, baseline=spark.read.parquet(str(tmp_path / "accepted")), severity="medium")
    running = streaming.write_findings(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    running.awaitTermination()
    columns = ["file_path", "line_number", "matched_text", "pattern_name"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    want = jobs.scan_units(frame).where("detection_method = 'regex'").select(*columns).collect()
    assert got == sorted(map(tuple, want)) and got
