import base64
import json
import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve.operators import history, tree
from credsieve.operators.catalogue import DEFAULT_CATALOGUE, Signature
from credsieve.operators.detect import EntropyOptions, DetectOptions, detect, sparse_text
from credsieve.plans import jobs
from credsieve.sources import files, landed
from tests import model

KEY = "AK" + "IA" + "0" * 16
RANDOM = "q7Rz2Kx9Lm4Vt8Wp1Yc6Bn3Hd5Fg0JsTuAeIoX"


# --- added lines ---------------------------------------------------------------------


def added(spark, *patches):
    frame = spark.createDataFrame(list(enumerate(patches)), "i int, patch string").repartition(4)
    sparse = history.added_lines(frame)
    found = sparse.select("i", sparse_text(F.col("content"), F.col("line_nos")).alias("t")).collect()
    got = {r.i: r.t for r in found}
    return [got.get(i, "") for i in range(len(patches))]


@pytest.mark.parametrize(
    "patch,want",
    [
        ("@@ -1,2 +1,3 @@\n line\n+new\n-old\n end", "\nnew"),
        ("@@ -1,2 +1,1 @@\n line\n-old", ""),
        ("@@ -1 +1 @@\n+one\n@@ -9 +10 @@ fn\n+ten", "one" + "\n" * 9 + "ten"),
        ("+before\n@@ -1 +1 @@\n+in", "in"),
        ("@@ -1 +1,3 @@\n+++x\n+a\n\\ No newline\n+b", "a\nb"),
        ("@@ -1 +5 @@\n+first\n@@ -1 +5 @@\n+second", "\n\n\n\nsecond"),
        ("@@ -1 +1 @@\r\n+a\r\n+b\r\n", "a\nb"),
        ("@@ -1 +99999999999999999999 @@\n+a", ""),
        ("@@ -1 +0000000000003 @@\n+a", "\n\na"),
        ("", ""),
        (None, ""),
    ],
)
def test_added_lines(spark, patch, want):
    assert added(spark, patch) == [want]


def test_added_lines_of_random_patches(spark):
    rng = model.rng(21)
    patches = [model.random_patch(rng) for _ in range(800)]
    assert added(spark, *patches) == [model.sparse_file(p) for p in patches]


def test_history_findings_of_random_patches(spark):
    rng = model.rng(22)
    patches = [model.random_patch(rng) for _ in range(400)]
    frame = spark.createDataFrame(
        [("o/r", f"c{i}", f"f{i}", p) for i, p in enumerate(patches)],
        "repo string, commit_sha string, file_path string, patch string",
    )
    found = jobs.scan_units(history.history_units(frame)).collect()
    got = sorted((r.file_path, r.line_number, r.matched_text, r.pattern_name) for r in found)
    want = []
    for i, p in enumerate(patches):
        text = model.sparse_file(p)
        for r in model.regex_rows(text) + model.entropy_rows(text, f"f{i}"):
            want.append((f"f{i}", r[0], r[1], r[3]))
    assert got == sorted(want) and len(got) > 200


@pytest.mark.parametrize("gap", [199, 200, 201, 202, 5000])
def test_matches_across_distant_hunks(spark, gap):
    counting = Signature("Counting", r"first\n{201}last", "low", "x")
    even = Signature("Even", r"first(?:\n\n)+last", "low", "x")
    blank = Signature("Blank", r"\n{150}", "low", "x")
    inner = Signature("Inner", r"first(?P<secret>\s+l)ast", "low", "x")
    catalogue = (*DEFAULT_CATALOGUE, counting, even, blank, inner)
    key = ["-----BEGIN PRIVATE " + "KEY-----", "abc", "-----END PRIVATE " + "KEY-----"]
    hunks = [(3, [key[0], key[1]]), (4 + gap, [key[2], KEY, "first"]), (6 + 2 * gap, ["last", f"{key[0]}{key[2]}"])]
    patch = "\n".join(f"@@ -1 +{at} @@\n" + "\n".join("+" + line for line in lines) for at, lines in hunks)
    frame = spark.createDataFrame([("r", "f.py", "c", patch)], "repo string, file_path string, commit_sha string, patch string")
    found = detect(history.history_units(frame), DetectOptions(catalogue=catalogue, entropy=None))
    columns = ["line_number", "matched_text", "detection_method", "pattern_name", "confidence", "entropy_score"]
    want = model.regex_rows(model.sparse_file(patch), catalogue)
    got = sorted(tuple(r) for r in found.select(columns).collect())
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want)]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in sorted(want)])
    assert (3, "PEM private key") in {(r[0], r[3]) for r in got}


def test_every_signature_of_the_catalogue_is_elastic():
    assert all(s.elastic for s in DEFAULT_CATALOGUE)


@pytest.mark.parametrize(
    "regex,elastic",
    [
        ("ab", True), (r"a\s*b", True), (r"(?:a|b\s+)[^x]*c", True), (r"^a[\s\S]*?b$", True), (r"(?<!\S)a\s+b", True),
        (r"a\nb", False), (r"a\s{2,300}b", False), (r"(a\s*)+b", False), (r"\s+b", False), (r"a\s*", False), (r"(a)\s+\1", False),
        (r"a(?P<secret>\s*b)", False), (r"a\s{200,}b", False), (r"a(?=\n{300})[^x]*b", False), (r"a(?>\s*)b", False), (r"a?\s*b", False),
    ],
)
def test_elastic_signatures(regex, elastic):
    assert Signature("N", regex, "low", "x").elastic == elastic


def test_newest_commits(spark):
    rows = [("o/r", "main", i, f"c{i}") for i in range(9)] + [("o/r", "dev", 0, "d0"), ("o/s", "main", 3, "s3")]
    frame = spark.createDataFrame(rows, "repo string, branch string, pos int, commit_sha string")
    got = sorted(r.commit_sha for r in history.newest_commits(frame, 2).collect())
    assert got == ["c0", "c1", "d0", "s3"]
    with pytest.raises(ValueError):
        history.newest_commits(frame, 0)
    plan = history.newest_commits(frame, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- trees ------------------------------------------------------------------------------


def payloads(spark, rows, keys):
    data = [(*r[:-1], json.dumps(r[-1])) for r in rows]
    return spark.createDataFrame(data, f"{keys}, payload string")


class Crawl:
    """Two sound repositories and several that fail, as landed payloads."""

    def __init__(self, spark):
        item = lambda path, sha, size=10, kind="blob": {
            "path": path, "mode": "100644", "type": kind, "sha": sha, "size": size, "url": ""
        }
        names = [("o/api", "main"), (" o / web ", "develop"), ("o/gone", "main"), ("o/cut", "main"),
                 ("bad", "main"), ("o/lost", None), ("o/broken", "main")]
        listing = [{"id": i, "name": n, "full_name": n, "default_branch": b or ""} for i, (n, b) in enumerate(names)]
        listing.append({"id": 99, "name": "p", "full_name": "o/private", "default_branch": "main", "private": True})
        page = spark.createDataFrame([(json.dumps(listing + [7]),)], "payload string")
        self.repos = landed.parse_repos(page)
        heads = [("o/api", "main", "h1"), ("o/web", "develop", "h2"), ("o/cut", "main", "h3"),
                 ("o/lost", "main", "h4"), ("o/private", "main", "h5"), ("o/broken", "main", "h6")]
        self.branches = landed.parse_branches(
            payloads(spark, [(r, b, {"commit": {"sha": s}}) for r, b, s in heads], "repo string, branch string")
        )
        trees = [
            ("o/api", "h1", {"sha": "t", "tree": [
                item("src/a.env", "s1"), item("tests/a.env", "s1"), item("copy/b.txt", "s1", None),
                item("x.min.js", "s2"), item("package-lock.json", "s2"), item("big.txt", "s2", 1_000_001),
                item("dir", "s9", None, "tree"), item("bin.dat", "s3"), item("none.txt", "s4"), 5]}),
            ("o/web", "h2", {"tree": [item("w.txt", "s1")]}),
            ("o/cut", "h3", {"truncated": True, "tree": [item("w.txt", "s1")]}),
            ("o/lost", "h4", {"tree": [item("ok.txt", "s1"), item("lost.txt", "nowhere")]}),
            ("o/private", "h5", {"tree": [item("w.txt", "s1")]}),
            ("o/broken", "h6", {"tree": {"a": 1}}),
        ]
        self.trees = landed.parse_trees(payloads(spark, trees, "repo string, commit_sha string"))
        b64 = lambda data: {"encoding": "base64", "content": base64.encodebytes(data).decode()}
        text = f"k = {KEY}\nt = {RANDOM}\n".encode()
        blobs = [("o/api", "s1", b64(text)), ("o/api", "s2", b64(text)), ("o/api", "s3", b64(b"\xff\xfe\x00\x01")),
                 ("o/api", "s4", {"encoding": "none", "content": "x"}), ("o/web", "s1", b64(text)),
                 ("o/lost", "s1", b64(text)), ("o/cut", "s1", b64(text)), ("o/private", "s1", b64(text))]
        self.blobs = landed.parse_blobs(payloads(spark, blobs, "repo string, sha string"))
        self.commits = landed.parse_commits(spark.createDataFrame(
            [("o/api", "main", 0, json.dumps([{"sha": "c2"}, {"sha": "c1"}])),
             ("o/web", "develop", 0, json.dumps([{"sha": "c3"}])),
             ("o/lost", "main", 0, json.dumps([{"sha": "c4"}])),
             ("o/broken", "main", 0, json.dumps([{"sha": "c5"}]))],
            "repo string, branch string, page_start int, payload string"))
        patch = f"@@ -1 +1,2 @@\n line\n+k = {KEY}"
        entry = lambda name, p=patch: {"filename": name, "status": "modified", "patch": p}
        self.commit_files = landed.parse_commit_files(payloads(spark, [
            ("o/api", "c2", {"files": [entry("a.env"), entry("dist/app.min.js"), {"filename": "b"}, 3, entry("n", 7)]}),
            ("o/api", "c1", {"files": [entry("a.env")]}),
            ("o/web", "c3", {}),
            ("o/broken", "c5", {"files": "x"})], "repo string, commit_sha string"))

    def scan(self, **options):
        return jobs.scan_trees(self.repos, self.branches, self.trees, self.blobs, jobs.ScanOptions(**options))

    def history(self, **options):
        return jobs.scan_histories(self.repos, self.commits, self.commit_files, jobs.ScanOptions(**options))


@pytest.fixture(scope="module")
def crawl(spark):
    return Crawl(spark)


def located(result):
    return sorted((r.repo, r.file_path, r.line_number, r.detection_method) for r in result.findings.collect())


def failed(result):
    return sorted((r.repo, r.branch, r.error) for r in result.failures.collect())


def test_tree_scan(crawl):
    result = crawl.scan()
    assert located(result) == [
        ("o/api", "copy/b.txt", 1, "regex"), ("o/api", "copy/b.txt", 2, "entropy"),
        ("o/api", "src/a.env", 1, "regex"), ("o/api", "src/a.env", 2, "entropy"),
        ("o/api", "tests/a.env", 1, "regex"),
        ("o/web", "w.txt", 1, "regex"), ("o/web", "w.txt", 2, "entropy"),
    ]
    assert {r.commit_sha for r in result.findings.collect()} == {"h1", "h2"}
    assert failed(result) == [
        ("bad", "main", fixed.BAD_REPO_NAME_ERROR),
        ("o/broken", "main", tree.TREE_ERROR),
        ("o/cut", "main", fixed.TRUNCATED_TREE_ERROR),
        ("o/gone", "main", tree.BRANCH_ERROR),
        ("o/lost", "main", tree.BLOB_ERROR),
    ]


def test_tree_scan_options(crawl, spark):
    policies = spark.createDataFrame([("o/web", "*.txt"), ("o/api", " ,")], "repo string, excludes string")
    options = jobs.ScanOptions(excludes="src/*, copy/*", detect=DetectOptions(entropy=None))
    result = jobs.scan_trees(crawl.repos, crawl.branches, crawl.trees, crawl.blobs, options, policies)
    assert located(result) == [("o/api", "tests/a.env", 1, "regex")]
    only_branch = crawl.scan(branch="develop")
    assert {r[0] for r in located(only_branch)} == {"o/web"}
    assert ("o/api", "develop", tree.BRANCH_ERROR) in failed(only_branch)
    assert located(crawl.scan(max_file_size_bytes=9)) == [
        ("o/api", "copy/b.txt", 1, "regex"), ("o/api", "copy/b.txt", 2, "entropy"),
    ]


def test_one_repository(crawl):
    assert tree.one_repo(crawl.repos, "o/web").count() == 1
    with pytest.raises(ValueError, match="owner/repo"):
        tree.one_repo(crawl.repos, "web")


def test_history_scan(crawl):
    result = crawl.history()
    assert [(r.commit_sha, r.line_number) for r in result.findings.orderBy("commit_sha").collect()] == [("c1", 2), ("c2", 2)]
    assert located(crawl.history(max_commits=1)) == [("o/api", "a.env", 2, "regex")]
    assert failed(result) == [
        ("bad", "main", fixed.BAD_REPO_NAME_ERROR),
        ("o/broken", "main", tree.COMMIT_FILES_ERROR),
        ("o/cut", "main", tree.COMMITS_ERROR),
        ("o/gone", "main", tree.COMMITS_ERROR),
        ("o/lost", "main", tree.COMMIT_FILES_ERROR),
    ]


def test_tree_and_history_together(crawl):
    both = crawl.scan().union(crawl.history())
    both = both.kept()
    assert both.findings.count() == 9 and both.failures.count() == 10


@pytest.fixture(scope="module")
def stored(crawl, spark, tmp_path_factory):
    """The parsed tables of the crawl as parquet."""
    folder = tmp_path_factory.mktemp("stored")
    names = ("repos", "branches", "trees", "blobs", "commits", "commit_files")
    for name in names:
        getattr(crawl, name).write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def test_texts_are_neither_shuffled_nor_read_for_their_keys(stored, capsys):
    tables = stored
    scans = (
        jobs.scan_trees(tables["repos"], tables["branches"], tables["trees"], tables["blobs"]),
        jobs.scan_histories(tables["repos"], tables["commits"], tables["commit_files"]),
    )
    for result, text, reads in zip(scans, ("content", "patch"), (1, 0)):
        result.findings.explain("formatted")
        plan = capsys.readouterr().out
        # histories are searched when the scan is called, and findings are read from what that stored
        assert bool(re.search("BroadcastHashJoin LeftSemi", plan)) == bool(reads), "texts that nothing asks for are not dropped first"
        sections = plan.split("\n\n")
        exchanged = [s for s in sections if re.match(r"\n?\(\d+\) \w*Exchange", s)]
        assert len(exchanged) > 2
        assert not [s for s in exchanged if f"{text}#" in s or "files#" in s or "payload" in s]
        schemas = re.findall(r"ReadSchema: (.*)", plan)
        assert len([s for s in schemas if text in s]) == reads


def test_a_hot_repository_does_not_change_the_result(stored, spark):
    """One blob at very many paths of one repository."""
    many = spark.range(2000).select(
        F.lit("100644").alias("mode"), F.lit("blob").alias("type"), F.lit("s1").alias("sha"),
        F.concat(F.lit("d/f"), "id").alias("path"), F.lit(5).cast("bigint").alias("size"), F.lit("").alias("url"))
    listing = many.agg(F.collect_list(F.struct("path", "mode", "type", "sha", "size", "url")).alias("tree"))
    trees = listing.select(F.lit("o/web").alias("repo"), F.lit("h2").alias("commit_sha"), F.lit("").alias("sha"),
                           F.lit(False).alias("truncated"), F.lit(True).alias("valid"), "tree")
    result = jobs.scan_trees(stored["repos"].where("full_name like '%web%'"), stored["branches"], trees, stored["blobs"])
    found = result.findings.groupBy("detection_method").agg(F.count("*"), F.countDistinct("file_path")).collect()
    assert sorted(map(tuple, found)) == [("entropy", 2000, 2000), ("regex", 2000, 2000)]


# --- folders ------------------------------------------------------------------------------


def write(root):
    contents = {
        ".env": f"K={KEY}\r\nt = {RANDOM}\r\n".encode(),
        "config/nested/settings.env": KEY.encode(),
        ".github/x.yml": KEY.encode(),
        "_private": KEY.encode(),
        "bin.dat": b"\xff\xfe\x00\x01" + KEY.encode(),
        "yarn.lock": KEY.encode(),
        "empty": b"",
        **{f"{d}/k.txt": KEY.encode() for d in ("node_modules", ".git", "a/venv", "__pycache__", "build", "dist", "p.egg-info")},
    }
    for path, data in contents.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    (root / "config/loop").symlink_to(root, target_is_directory=True)
    return str(root)


def test_folder_scan(spark, tmp_path):
    root = write(tmp_path)
    found = jobs.scan_folder(spark, root).collect()
    assert sorted((r.file_path, r.line_number, r.detection_method) for r in found) == [
        (".env", 1, "regex"), (".env", 2, "entropy"), (".github/x.yml", 1, "regex"),
        ("_private", 1, "regex"), ("config/nested/settings.env", 1, "regex"),
    ]
    assert {r.repo for r in found} == {root} and {r.commit_sha for r in found} == {""}
    small = jobs.scan_folder(spark, root, jobs.ScanOptions(max_file_size_bytes=20, excludes="_*"))
    assert sorted(r.file_path for r in small.collect()) == [".github/x.yml", "config/nested/settings.env"]
    single = jobs.scan_folder(spark, f"{root}/.env").collect()
    assert {r.file_path for r in single} == {".env"} and len(single) == 2


def test_folder_named_the_hadoop_way(spark, tmp_path):
    root = write(tmp_path)
    named = files.list_files(spark, f"file:{root}")
    assert {r.file_path for r in named.collect()} == {r.file_path for r in files.list_files(spark, root).collect()}
    assert files.read_texts(named.where("file_path = '.env'")).first().content.startswith("K=")


def test_large_flat_folder(spark, tmp_path):
    """Many names in one directory leave the listing in pages."""
    import resource

    for i in range(200_000):
        os.close(os.open(tmp_path / f"f{i}", os.O_CREAT))
    pages = files._list_children(iter([pa.RecordBatch.from_pylist([{"path": str(tmp_path), "file_path": ""}])]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sizes = [page.num_rows for page in pages]
    assert sum(sizes) == 200_000 and max(sizes) <= 10_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_unreadable_names_are_reported(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_text("x")
    listed = files.list_files(spark, str(tmp_path))
    gone = spark.createDataFrame([(f"{tmp_path}/gone", "gone", 1, None)], listed.schema)
    texts, unread = files.read_files(listed.unionByName(gone))
    assert [r.file_path for r in texts.collect()] == ["a"]
    assert [tuple(r) for r in unread.collect()] == [("gone", "not found")]
    rows = list(files._list_children(iter([pa.RecordBatch.from_pylist([{"path": f"{tmp_path}/no", "file_path": "no"}])])))
    assert rows[0].column("reason").to_pylist() == ["not found"]
    with pytest.raises(OSError):
        files._reason(OSError("throttled"))
    assert files._reason(PermissionError()) == "permission denied"


def test_label_does_not_depend_on_how_the_path_was_typed(spark, tmp_path):
    assert files.normalised("a//b/./c/") == "a/b/c"
    assert files.normalised("s3a://bucket/x/") == "s3a://bucket/x"


def test_landed_payloads_are_never_lost(spark):
    def rows(parse, keys, *payloads):
        table = spark.createDataFrame([(*("k",) * (len(keys)), p) for p in payloads], ", ".join(f"{k} string" for k in (*keys, "payload")))
        if parse is landed.parse_commits:
            table = table.withColumn("page_start", F.lit(0))
        return parse(table).collect()

    bad = ("<html>", '{"message": "x"}', "[1", "5", None)
    repos = rows(landed.parse_repos, (), *bad, '[{"full_name": "o/r"}, 7]', "[]")
    assert [r.error for r in repos].count(landed.REPO_PAGE_ERROR) == len(bad) and len(repos) == len(bad) + 1
    assert not any(r.valid for r in rows(landed.parse_branches, ("repo", "branch"), *bad, "[]", '{"commit": {}}'))
    assert [r.valid for r in rows(landed.parse_commits, ("repo", "branch"), *bad, '[{"x": 1}]')] == [False] * 6
    assert [(r.valid, r.commit_sha) for r in rows(landed.parse_commits, ("repo", "branch"), "[]", '[{"sha": "a"}, 7]')] == [
        (True, None), (True, "a")]
    blobs = rows(landed.parse_blobs, ("repo", "sha"), "[1]", '{"encoding": "base64", "content": "QU', '{"encoding": "none"}', '{"content": 5}')
    assert [(r.valid, r.content) for r in blobs] == [(False, None), (False, None), (True, None), (True, None)]


def test_long_payloads_are_read(spark):
    body = base64.b64encode(b"x" * 16_000_000).decode()
    table = spark.createDataFrame([("o/r", "s")], "repo string, sha string").withColumn(
        "payload", F.concat(F.lit('{"encoding": "base64", "content": "'), F.lit(body), F.lit('"}')))
    row = landed.parse_blobs(table).select("valid", F.length("content").alias("n")).first()
    assert (row.valid, row.n) == (True, 16_000_000)


def test_hunks_that_cannot_be_placed_fail_their_repository(spark):
    patch = "@@ -1 +" + "9" * 25 + " @@\n+x"
    rows = spark.createDataFrame([(patch,), ("@@ -1 +0000000000000000000000005 @@\n+x",), (None,)], "p string")
    assert [r[0] for r in rows.select(history.unreadable(F.col("p"))).collect()] == [True, False, False]
    repos = spark.createDataFrame([("o/r", "main")], "full_name string, default_branch string")
    commits = spark.createDataFrame([("o/r", "main", 0, "c", True)], "repo string, branch string, pos int, commit_sha string, valid boolean")
    body = json.dumps({"files": [{"filename": "f", "patch": patch}]})
    changed = landed.parse_commit_files(spark.createDataFrame([("o/r", "c", body)], "repo string, commit_sha string, payload string"))
    result = jobs.scan_histories(repos, commits, changed)
    assert failed(result) == [("o/r", "main", history.HUNK_ERROR)] and result.findings.count() == 0


def test_missing_folder(spark, tmp_path):
    with pytest.raises(files.FileTreeError, match="does not exist"):
        jobs.scan_folder(spark, str(tmp_path / "none"))


def test_empty_folder(spark, tmp_path):
    assert jobs.scan_folder(spark, str(tmp_path)).count() == 0


def test_demo_file(spark, units):
    rng = model.rng(1337)
    alphabet = model.LETTERS[26:52] + model.LETTERS[:26] + model.LETTERS[52:] + "_+/="
    secret = model.draw(rng, 48, alphabet)
    text = "\n".join([
        "# a comment", f"AWS_ACCESS_KEY_ID={KEY}", "GITHUB_TOKEN=" + "gh" + "p_" + "A" * 36,
        "STRIPE_SECRET_KEY=" + "sk_" + "live_" + "B" * 24, f'SECRET = "{secret}"', "SAFE=not-a-secret", ""])
    rows = jobs.scan_units(units(("app.env", text))).orderBy("line_number").collect()
    assert [(r.line_number, r.confidence) for r in rows] == [(2, "high"), (3, "high"), (4, "high"), (5, "medium")]
    assert [r.entropy_score for r in rows] == pytest.approx(
        [1.0219280948873624, 0.6689955935892812, 1.498778124459133, 4.787782031835939], abs=1e-12)
    assert rows[2].matched_text == "sk_liv" + "*" * 20 + "BBBBBB"


def test_threshold_option_reaches_a_scan(units):
    options = jobs.ScanOptions(detect=DetectOptions(entropy=EntropyOptions.with_threshold(3.0)))
    assert jobs.scan_units(units("aabbccddeeffgghhiijjkkll"), options).count() == 1
