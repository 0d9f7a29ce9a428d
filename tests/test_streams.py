"""Streams of tables that lie in folders of parts."""

import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("parts", [1, 3])
def test_documents_in_parts_are_streamed(spark, tmp_path, parts):
    token = "q7Rz2Kx9Lm4Vt8Wp1Yc6Bn3Hd5Fg0JsTuAeIoX"
    rows = [(i, f"one\n{token}{i}", "en", "web", 9) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries()["stream_scan"](spark, str(tmp_path)).collect()
    assert sorted(r.file_path for r in found) == [f"doc_{i}.txt" for i in range(6)]
    assert {r.line_number for r in found} == {2}
