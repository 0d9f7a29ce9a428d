"""Tokenizers: exact agreement with the public libraries, and exact round trips."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from credsieve.llm import byte_bpe, packing
from credsieve.llm.arrays import utf8

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = list("aAbBIK'.,;:!?()<|>0123 \n\t\r\x1c\x0b$&*-_é́çÇßİıΣσςñ日本¼²…—​̇ﬁ😀") + [
    "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "the", "...", "  ", " ", "ing", "tion",
]


def texts(seed, count=200, longest=60):
    deal = random.Random(seed)
    return ["".join(deal.choices(PIECES, k=deal.randrange(longest))) for _ in range(count)] + [None, "", " ", "\n\n", "a" * 3000]


@pytest.fixture(scope="module")
def public():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)


def test_round_trip(spark, public):
    rows = [(i, t, 5) for i, t in enumerate(texts(1))] + [(None, "no id", 5), (0, texts(1)[0], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    by_id = {i: t for i, t, _ in rows}
    for r in found:
        text = by_id[r.doc_id] or ""
        assert (r.ids, r.n_tokens, bytes(r.decoded)) == (public.encode_ordinary(text), len(r.ids), text.encode())
    digests = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, digests=True).collect()
    shown = lambda x: hashlib.sha256(x).hexdigest()
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in digests} == {
        (r.doc_id, shown(" ".join(map(str, r.ids)).encode()), shown(bytes(r.decoded))) for r in found
    }


def test_decode_of_stored_ids(spark):
    rows = [(1, [31373, 995], "x"), (2, [], "x"), (3, None, "x"), (4, [50255, 0], "x"), (None, [1], "x")]
    found = byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, hex string"), RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: bytes(r.decoded) for r in found.collect()}
    assert got[1] == b"hello world" and got[2] == got[3] == b"" and got[None] == b'"' and len(got) == 5


def test_nothing_to_encode(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).collect() == []
    assert packing.pack(empty, WORDS).collect() == []


@pytest.mark.parametrize(
    "word",
    ["a" * 700, "=" * 1001, "=-" * 400, "the" * 300, "é" * 300, "日本語" * 150]
    + ["".join(random.Random(s).choices(a, k=900)) for s, a in enumerate(["ab", "etaoin", "=-*", "abcdeinrst", "aeé"])],
)
def test_long_words_contract_alike(public, codec, word):
    assert ids_of(codec, [word]) == [public.encode_ordinary(word)]


def ids_of(codec, given):
    counts, plain, decoded = codec.encode(*utf8(pa.array(given, pa.string())))
    ids = [[int(i) for i in p.split()] for p in plain.to_pylist()]
    assert counts.tolist() == [len(i) for i in ids] and decoded.to_pylist() == [(t or "").encode() for t in given]
    return ids


def test_texts_in_slices(public, codec, monkeypatch):
    given = texts(2)
    expected = [public.encode_ordinary(t or "") for t in given]
    assert ids_of(codec, given) == expected
    monkeypatch.setattr(byte_bpe, "_REMEMBERED", 10)
    monkeypatch.setattr(byte_bpe, "_REMEMBERED_PARTS", 10)
    monkeypatch.setattr(byte_bpe, "_WORDS_AT_ONCE", 7)
    codec.words.clear()
    codec.parts.clear()
    assert ids_of(codec, given[:60]) + ids_of(codec, given[60:]) == expected
    assert ids_of(codec, []) == [] and ids_of(codec, [None, ""]) == [[], []]


def test_word_tokens_agree_with_the_library(monkeypatch):
    own, whole = packing.WordTokens(WORDS), Tokenizer.from_file(WORDS)
    for seed in range(12):
        monkeypatch.setattr(packing, "_CACHED_WORDS", 50 if seed % 2 else 10_000)
        given = texts(seed)
        ids, edges = own.encode(*utf8(pa.array(given)))
        for i, text in enumerate(given):
            assert ids[edges[i] : edges[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, tokens, window):
    """Every id in one piece, checksums right, sequences without gaps and not too long; the share of padding."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    assert documents.keys() == tokens.keys()
    for doc, pieces in documents.items():
        assert all(r.doc_tokens == len(tokens[doc]) for r in pieces)
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(tokens[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(tokens[doc])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding / (window * max(1, len(sequences)))


def test_packing(spark):
    deal = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    given = {i: " ".join(deal.choices(vocabulary, k=deal.choice([1, 5, 40, 200, 700, 3000]))) for i in range(150)}
    given |= {900: None, 901: "", 902: "x " * 4095, 903: "x " * 2047, 904: "x " * 2048}
    rows = [(i, t, 1) for i, t in given.items()]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(7), WORDS)
    whole = Tokenizer.from_file(WORDS)
    tokens = {i: whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in given.items()}
    assert check_pieces(found.collect(), tokens, 2048) < 0.02


def test_packing_rows_without_or_with_equal_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, "d"), (4, "d"), (4, None)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    assert sorted((str(r.doc_id), r.length) for r in found) == [("4", 1), ("4", 2), ("4", 2), ("None", 4), ("None", 4)]
    places = sorted((r.sequence_id, r.offset, r.length) for r in found)
    assert len({p[:2] for p in places}) == 5


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    deal = np.random.default_rng(seed)
    window = 64
    lengths = deal.integers(1, window + 1, size=int(deal.choice([0, 1, 3, 40, 3000])))
    if seed == 5:
        lengths = np.full(1000, 33)  # a hot length that fills no window
    where = packing.plan(np.bincount(lengths, minlength=window + 1), window)
    taken = defaultdict(list)
    for length in np.unique(lengths):
        runs = np.flatnonzero(where.length == length)
        firsts = where.first[runs]
        for number in range(int((lengths == length).sum())):
            run = runs[np.searchsorted(firsts, number, side="right") - 1]
            taken[int(where.sequence[run] + number - where.first[run])].append((int(where.offset[run]), int(length)))
    assert sum(map(len, taken.values())) == len(lengths)
    for pieces in taken.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    if len(lengths) == 3000:
        # two pieces above half a window never share one
        assert len(taken) <= 1.03 * max(lengths.sum() / window, (lengths > window // 2).sum())


def test_least_squares_counts_are_not_negative_and_fit():
    combinations = [(10, 54), (20, 44), (10, 10, 44), (32, 32)]
    histogram = np.zeros(65)
    histogram[[10, 20, 32, 44, 54]] = [50, 30, 20, 40, 30]
    counts = packing.fitted_counts(histogram, combinations)
    assert np.allclose(counts, [30, 30, 10, 10], atol=0.05)
    assert (packing.fitted_counts(np.eye(65)[54] * 9, combinations) >= 0).all()
