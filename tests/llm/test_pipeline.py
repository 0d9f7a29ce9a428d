"""The whole pipeline against a plain version of every stage, and each stage on awkward tables."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from credsieve.llm import line_dedup
from tests.llm.test_dedup import brute_force, repeated_by_hand
from tests.llm.test_tokens import WORDS, check_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "tan", "vor", "she") for b in ("ing", "ther", "wol", "que", "ska", "ov", "en", "lis")]


def corpus(deal, count=700):
    """Documents with their truth: (text, toxic, good)."""
    passage = "\n".join(" ".join(deal.choices(VOCABULARY, k=14)) for _ in range(4))
    rows, texts = {}, []
    for i in range(count):
        lines = [" ".join(deal.choices(VOCABULARY, k=deal.randrange(6, 30))) for _ in range(deal.randrange(2, 8))]
        kind = deal.random()
        toxic = good = False
        if kind < 0.12:
            toxic, good = True, True
            lines[0] += " " + " ".join(deal.choices(["Grumvlek", "vlekgrumka", "grumvlek."], k=3))
        elif kind < 0.27:
            lines = [line.upper().replace(" ", "!! ") + "!!" for line in lines]
        else:
            good = True
            if kind < 0.32 and texts:
                lines = deal.choice(texts).split("\n")
            elif kind < 0.42 and texts:
                lines = [" ".join(w if deal.random() > 0.02 else "zu" for w in line.split()) for line in deal.choice(texts).split("\n")]
            elif kind < 0.5:
                lines.insert(1, passage)
        text = "\n".join(lines)
        if good and not toxic:
            texts.append(text)
        rows[i] = (text, toxic, good)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    deal = random.Random(13)
    rows = corpus(deal)
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, (t, _, _) in rows.items()]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(good), int(toxic)) for i, (_, toxic, good) in rows.items() if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_pipeline(spark, folder):
    path, rows = folder
    texts = {i: t for i, (t, toxic, good) in rows.items() if good and not toxic}
    gone = repeated_by_hand(texts, line_dedup.LEAST_WORDS)
    cleaned = {i: "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts.items()}
    left = {i: t for i, t in cleaned.items() if t.strip() or texts[i] == t}
    kept = {i for i, (_, _, kept) in brute_force(left, 5, 80).items() if kept}
    whole = Tokenizer.from_file(WORDS)
    tokens = {i: whole.encode(left[i], add_special_tokens=False).ids + [1] for i in kept}
    found = corpus_pipeline.run(spark, path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "near_dedup", "packing"]
    assert check_pieces(found.collect(), tokens, 2048) < 0.05


def test_stages_keep_columns_and_take_odd_tables(spark, folder):
    path, _ = folder
    wide = f"{SCHEMA}, toxic string, kept int, mask string, label double, id string, rep string"
    extra = ("t", 1, "m", 0.5, "i", "r")
    rows = [
        (1, None, None, None, None, *extra), (2, "", "en", "s", 0, *extra), (None, "ka lo", None, None, 5, *extra),
        (3, "kaing lowol " * 60_000, "en", "s", 1, *extra), (4, "kaing miov tanen", "en", "s", 16, *extra),
        (4, "kaing miov tanen", "en", "s", 16, *extra),
    ]
    odd = spark.createDataFrame(rows, wide)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, odd, path)
        if name == "packing":
            assert after.count() > 5
        else:
            assert after.columns == odd.columns and 0 < after.count() <= 6
        assert stage(spark, odd.limit(0), path).collect() == []
