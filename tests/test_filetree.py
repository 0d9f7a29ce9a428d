"""The file tree as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from credsieve.plans import jobs
from credsieve.sources import files, filetree

AWS = "AKIA" + "ABCDEFGHIJKLMNOP"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    texts = {f"d{i}/e{j}/f{k}.txt": f"{AWS}\r\n{i}{j}{k}" for i in range(4) for j in range(3) for k in range(5)}
    texts |= {".env": AWS, "node_modules/x.js": AWS, "d1/big.bin": "y" * 3000, "d0/.hidden/_a": "z", "odd.txt": "plain"}
    for name, text in texts.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (top / "d2/latin.txt").write_bytes(b"\xff\xfe")
    return str(top)


def loaded(spark, root, **options):
    filetree.register(spark)
    return spark.read.format("filetree").options(**options).load(root)


def test_it_reads_what_the_listing_finds(spark, root):
    want = {r.file_path: r.size for r in files.list_files(spark, root).collect()}
    for partitions in (1, 3, 64):
        rows = loaded(spark, root, partitions=partitions)
        assert {r.file_path: r.size for r in rows.collect()} == want
        assert rows.rdd.getNumPartitions() <= partitions
    texts = loaded(spark, root).select("file_path", files.decoded(F.col("data")).alias("content")).where("content is not null")
    read = files.read_texts(files.list_files(spark, root)).select("file_path", "content")
    assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, read.collect()))


def test_unwanted_files_are_not_opened(spark, root):
    """A file that may not be read is no trouble to whom it does not concern."""
    reader = filetree.FileTreeReader(root, 4)
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThanOrEqual, StringStartsWith

    left = list(reader.pushFilters([StringStartsWith(("file_path",), "d1/"), LessThanOrEqual(("size",), 100), IsNotNull(("file_path",)), EqualTo(("reason",), "x")]))
    assert [type(f) for f in left] == [IsNotNull, EqualTo]
    walked = [r["file_path"] for work in reader.partitions() for r in reader._walked(work.entries)]
    assert len(walked) == 15 and all(p.startswith("d1/") for p in walked)
    assert not reader._may_hold("d2") and reader._may_hold("d1") and reader._may_hold("d1/e2")
    reader = filetree.FileTreeReader(root, 4)
    assert list(reader.pushFilters([In(("file_path",), ("d0/e0/f1.txt", "odd.txt"))])) == []
    assert not reader._may_hold("d0/e1") and reader._may_hold("d0/e0")
    assert sorted(r["file_path"] for work in reader.partitions() for r in reader._walked(work.entries)) == ["d0/e0/f1.txt", "odd.txt"]


def test_conditions_reach_the_source(spark, root):
    rows = loaded(spark, root).where("file_path like 'd1/%' and size < 100")
    assert rows.count() == 15
    assert loaded(spark, root).where("file_path = '.env'").count() == 1
    assert loaded(spark, root).where("file_path = 'none'").count() == 0


def test_a_single_file_and_no_file(spark, root):
    assert [r.file_path for r in loaded(spark, f"{root}/.env").collect()] == [".env"]
    with pytest.raises(Exception, match="does not exist"):
        loaded(spark, f"{root}/nothing").collect()


def test_a_large_directory_is_left_to_a_task(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"f{i}").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g").write_text("x")
    monkeypatch.setattr(files, "_ROWS_AT_ONCE", 10)
    reader = filetree.FileTreeReader(str(tmp_path), 4)
    work = reader.partitions()
    assert sum(len(w.entries) for w in work) == 1
    assert len([r for w in work for r in reader._walked(w.entries)]) == 31


def test_a_directory_scan_opens_files_once(spark, root, monkeypatch):
    result = jobs.scan_tree_of_files(spark, root)
    assert result.findings.where("pattern_name = 'AWS access key'").count() == 61
    assert result.failures.count() == 0
    gone = spark.createDataFrame([(f"{root}/gone", "gone", 1, None)], "path string, file_path string, size bigint, reason string")
    both = files.read_once(files.list_files(spark, root).unionByName(gone))
    assert [(r.file_path, r.content) for r in both.where("reason is not null").collect()] == [("gone", None)]
    assert both.where("content is null and reason is null").first().file_path == "d2/latin.txt"
    assert both.count() == 1 + sum(len(f) for d, _, f in os.walk(root) if "node_modules" not in d)
