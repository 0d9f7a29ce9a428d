"""How often costly inputs are computed."""

import base64
import json

import pytest

from credsieve.functions.payload import blob_text
from credsieve.operators import findings
from credsieve.operators.detect import DetectOptions
from credsieve.plans import jobs
from credsieve.sources import landed
from tests import model

KEY = "AK" + "IA" + "0" * 16


def counted(rows, folder):
    """The same rows, and a function that says how many were computed so far."""
    folder.mkdir()

    def passed(batches):
        for batch in batches:
            with open(folder / "rows", "a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    seen = lambda: (folder / "rows").stat().st_size if (folder / "rows").exists() else 0
    return rows.mapInArrow(passed, rows.schema), seen


def test_findings_are_computed_once_to_be_numbered(spark, units, tmp_path):
    texts = units(*[f"k {KEY}{i:04d}" if i % 2 else f"k {KEY} z" for i in range(40)]).repartition(4)
    texts, seen = counted(texts, tmp_path / "units")
    rows = findings.numbered(jobs.scan_units(texts)).collect()
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1)) and rows
    assert seen() == 40


def _landed_trees(spark, folder, copies):
    texts = {f"s{i}": f"k {KEY} {i}" for i in range(20)}
    record = lambda **x: json.dumps(x)
    repos = [(record(id=1, name="r", full_name="o/r", default_branch="main", private=False), 0)]
    tree = [{"path": f"f{s}.txt", "mode": "100644", "type": "blob", "sha": s, "size": 9} for s in texts]
    blobs = [("o/r", s, record(encoding="base64", content=base64.b64encode(t.encode()).decode())) for s, t in texts.items()]
    payloads, seen = counted(spark.createDataFrame(blobs * copies, "repo string, sha string, payload string"), folder)
    return (
        landed.parse_repos(spark.createDataFrame(repos, "payload string, page_start int")),
        landed.parse_branches(spark.createDataFrame([("o/r", "main", '{"commit": {"sha": "h"}}')], "repo string, branch string, payload string")),
        spark.createDataFrame([("o/r", "h", record(sha="h", truncated=False, tree=tree))], "repo string, commit_sha string, payload string"),
        payloads,
    ), seen


@pytest.mark.parametrize("parsed", [False, True])
def test_blobs_are_read_once_for_keys_and_contents(spark, tmp_path, parsed):
    (repos, branches, trees, blobs), seen = _landed_trees(spark, tmp_path / "blobs", 1)
    if parsed:
        trees, blobs = landed.parse_trees(trees), landed.parse_blobs(blobs)
    result = jobs.scan_trees(repos, branches, trees, blobs)
    assert result.findings.count() == 20 and result.failures.count() == 0
    assert seen() == 20


@pytest.mark.parametrize("form", ["payloads", "parsed", "chosen"])
def test_only_parsed_blobs_in_files_are_read_where_they_lie(spark, tmp_path, form):
    (repos, branches, trees, blobs), _ = _landed_trees(spark, tmp_path / "blobs", 1)
    (blobs if form == "payloads" else landed.parse_blobs(blobs)).write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    result = jobs.scan_trees(repos, branches, trees, stored.where("sha <> ''") if form == "chosen" else stored)
    assert result.findings.count() == 20 and result.failures.count() == 0
    read = [name for name in result.findings.inputFiles() if f"{tmp_path}/stored" in name]
    assert bool(read) == (form == "parsed")


def test_blobs_landed_twice_are_searched_once(spark, tmp_path):
    (repos, branches, trees, blobs), _ = _landed_trees(spark, tmp_path / "blobs", 2)
    searched = []

    def own(texts):
        texts, seen = counted(texts.select("repo", "sha", "content"), tmp_path / f"own{len(searched)}")
        searched.append(seen)
        return texts.selectExpr(
            "repo", "sha", "1 as line_number", "'x' as matched_text", "'own' as detection_method", "'Any' as pattern_name",
            "'low' as confidence", "0.0D as entropy_score",
        )

    options = jobs.ScanOptions(detect=DetectOptions(catalogue=(), entropy=None, own=(own,)))
    assert jobs.scan_trees(repos, branches, trees, blobs, options).findings.count() == 20
    assert [seen() for seen in searched] == [20]


def test_commits_are_read_once_for_keys_and_patches(spark, tmp_path):
    patch = json.dumps({"files": [{"filename": "a.txt", "status": "added", "patch": f"@@ -0,0 +1 @@\n+k {KEY} z"}]})
    rows = spark.createDataFrame([("o/r", f"c{i}", patch) for i in range(20)], "repo string, commit_sha string, payload string")
    rows, seen = counted(rows, tmp_path / "commits")
    pages = [("o/r", "main", 0, json.dumps([{"sha": f"c{i}"} for i in range(20)]))]
    result = jobs.scan_histories(
        spark.createDataFrame([(1, "o/r", "main")], "id bigint, full_name string, default_branch string"),
        landed.parse_commits(spark.createDataFrame(pages, "repo string, branch string, page_start int, payload string")),
        landed.parse_commit_files(rows),
    )
    assert result.findings.count() == 20 and result.failures.count() == 0
    assert seen() == 20


def test_base64_with_any_white_space(spark):
    texts = ["plain", "é" * 50, "", "a" * 200]
    encoded = [base64.b64encode(t.encode()).decode() for t in texts]
    rng = model.rng(31)
    breaks = ["\n", "\r\n", " ", "\t", " ", " ", "\x0b"]
    spaced = ["".join(ch + (rng.choice(breaks) if rng.random() < 0.3 else "") for ch in e) for e in encoded]
    rows = [("base64", e) for e in encoded + spaced + ["*\n" + encoded[0], "YWJ\nj=", None]] + [("none", encoded[0])]
    frame = spark.createDataFrame(rows, "encoding string, content string").coalesce(1)
    got = [r[0] for r in frame.select(blob_text(frame.encoding, frame.content)).collect()]
    assert got == texts + texts + [None, None, None, None]
