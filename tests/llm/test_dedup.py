"""Near-duplicates, repeated lines and components against brute force, with awkward inputs."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from credsieve.llm import embedding_dedup, line_dedup, near_dedup
from credsieve.llm.arrays import shingle_hashes, utf8, word_hashes
from credsieve.llm.components import components

DOCS = "doc_id bigint, text string, kept string, component_id string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles_of(text, size):
    words = words_of(text)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def joined(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def brute_force(texts, size, percent):
    sets = {i: shingles_of(t, size) for i, t in texts.items()}
    links = [
        (a, b)
        for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c, i == c) for i, c in joined(sets, links).items()}


def corpus(seed):
    deal = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, number = {}, 0
    for _ in range(25):
        base = deal.choices(vocabulary, k=deal.choice([1, 2, 3, 8, 40, 150]))
        for _ in range(deal.choice([1, 1, 2, 6, 20])):
            words = [deal.choice(vocabulary) if deal.random() < deal.choice([0, 0, 0.01, 0.05]) else w for w in base]
            texts[number] = deal.choice([" ", "\n", " \t"]).join(words)
            number += deal.choice([1, 1, 7])
    texts |= {number + 10: None, number + 11: "", number + 12: " \n ", number + 13: "x " * 9000, number + 14: "X " * 9001}
    return texts


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    texts = corpus(size)
    rows = [(i, t, "a", "b") for i, t in texts.items()]
    rows += rows[:3] + [(None, rows[0][1], "a", "b"), (None, None, None, None)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), size, percent).collect()
    expected = brute_force(texts, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None} == expected
    assert len(found) == len(expected) + 2
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)


def test_near_duplicates_without_star_turns(spark):
    texts = corpus(11)
    found = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85, star_turns=0)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == brute_force(texts, 3, 85)


def test_one_of_each_keeps_columns_and_one_row(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "x", "y"), (2, text, "x", "z"), (5, "other words", None, None), (5, "other words", None, None),
            (5, "more words", None, None), (None, text, None, None), (7, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "5", "7", "None"]
    assert near_dedup.one_of_each(docs.limit(0)).collect() == []
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_shingles_of_slices():
    import pyarrow as pa

    texts = ["a b c d", None, "", "A b\tC", "éè éè éè éè", "a b", "long " * 5000]
    codes, where = shingle_hashes(*word_hashes(*utf8(pa.array(texts))), 3)
    assert np.diff(where).tolist() == [len(shingles_of(t, 3)) for t in texts]
    assert set(codes[where[3] : where[4]]) <= set(codes[where[0] : where[1]])


def test_words_of_a_text_longer_than_a_slice(monkeypatch):
    import pyarrow as pa

    from credsieve.llm import arrays

    texts = pa.array(["alpha beta gamma " * 40, "x" * 300, "y z " * 50, None])
    whole = arrays.word_hashes(*utf8(texts))
    monkeypatch.setattr(arrays, "SLICE_BYTES", 16)
    cut = arrays.word_hashes(*utf8(texts))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_least_overlap_is_a_tail_bound():
    overlap = near_dedup.least_overlap(32, 85)
    deal = np.random.default_rng(3)
    assert 10 < overlap < 27
    assert (deal.binomial(32, 0.85, 200_000) < overlap).sum() <= 2


def test_components(spark):
    deal = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(deal.randrange(100, 400), deal.randrange(100, 400)) for _ in range(200)]
    links += [(900, i) for i in range(901, 960)] + [(5, 5), (None, 3), (3, None), links[0]]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None]
    expected = joined({x for pair in real for x in pair}, real)
    assert all(found.get(node, node) == root for node, root in expected.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(seed):
    deal = np.random.default_rng(seed)
    rows, number = [], 0
    for _ in range(40):
        base = deal.standard_normal(16)
        for _ in range(int(deal.choice([1, 2, 5, 30]))):
            noise = deal.standard_normal(16) * deal.choice([0, 0.02, 0.1, 0.2])
            rows.append((number, [float(np.float32(x)) for x in base + noise], int(deal.integers(0, 2))))
            number += 1
    return rows


@pytest.mark.parametrize("block", [4096, 8])
def test_vector_links(spark, block):
    rows = vectors(block)
    last = len(rows)
    rows += [(last, None, 1), (last + 1, [0.0] * 16, 1), (last + 2, [float("nan")] * 16, 1), (last + 3, [None] + [1.0] * 15, 1),
             (last + 4, rows[0][1], None), (last + 5, [float("inf")] * 16, 1), rows[2]]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block)
    good = {i: (np.float32(v).astype(float), label) for i, v, label in rows[:last]}
    links = [
        (a, b)
        for a, b in combinations(good, 2)
        if good[a][1] == good[b][1]
        and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.98
    ]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    parts = joined(range(last + 6), links)
    expected = {i: (count[i], parts[i], parts[i] == i) for i in range(last + 6)}
    collected = found.collect()
    assert len(collected) == len(expected)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in collected} == expected


def test_vector_links_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int, links int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    only = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1, 0), (3, None, None, 0)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in only) == [("3", 0, True), ("None", 0, True)]


def test_learned_codes_are_balanced_and_find_every_neighbour():
    deal = np.random.default_rng(4)
    points = deal.standard_normal((3000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    mean, projection = embedding_dedup.learn_rotation(points, 32)
    assert np.allclose(projection.T @ projection, np.eye(32))
    tables = embedding_dedup.Tables(mean, projection, len(points), 0.98)
    assert abs((tables.rotated(points) >= 0).mean(axis=0) - 0.5).max() < 0.1
    close = points + deal.standard_normal(points.shape) * 0.03
    close /= np.linalg.norm(close, axis=1, keepdims=True)
    linked = np.flatnonzero((points * close).sum(axis=1) >= 0.98)
    one, two = (list(tables.buckets(tables.rotated(x))) for x in (points, close))
    keys = lambda found, own: {(t, r, c) for t, rows, codes, home in found if home.all() == own for r, c in zip(rows, codes, strict=True)}
    met = (keys(one, True) & (keys(two, True) | keys(two, False))) | (keys(two, True) & keys(one, False))
    assert set(linked.tolist()) <= {int(r) for _, r, _ in met}


def repeated_by_hand(texts, least):
    """Lines inside any run that has enough words and occurs at an earlier place, by comparing all places."""
    lines = {i: [x.strip(" \t\r") for x in t.split("\n")] for i, t in sorted(texts.items()) if t is not None}
    count = lambda line: line.count(" ") + 1 if line else 0
    places = [(i, n) for i in lines for n in range(len(lines[i]))]
    gone = set()
    for x, (i, n) in enumerate(places):
        for j, m in places[:x]:
            length = 0
            while n + length < len(lines[i]) and m + length < len(lines[j]) and lines[i][n + length] == lines[j][m + length]:
                length += 1
            if length and sum(count(line) for line in lines[i][n : n + length]) >= least:
                gone |= {(i, n + k) for k in range(length)}
    return gone


def test_repeated_lines(spark):
    deal = random.Random(6)
    pool = ["", "a", "b c", "d e f g", "one two three four five six seven eight nine ten eleven", " b c\r", "h"]
    texts = {i: "\n".join(deal.choices(pool, k=deal.randrange(1, 14))) for i in range(0, 60, 2)}
    texts |= {101: None, 102: "", 103: texts[0], 104: "\n".join(["h"] * 40), 105: "\n" * 30}
    rows = [(i, t, 7) for i, t in texts.items()]
    found = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_lines int")).collect()
    gone = repeated_by_hand(texts, line_dedup.LEAST_WORDS)
    assert len(found) == len(texts)
    for r in found:
        if texts[r.doc_id] is None:
            assert (r.text, r.n_lines, r.n_deleted) == (None, 0, 0)
            continue
        lines = texts[r.doc_id].split("\n")
        left = [line for n, line in enumerate(lines) if (r.doc_id, n) not in gone]
        assert (r.text, r.n_lines, r.n_deleted) == ("\n".join(left), len(lines), len(lines) - len(left))


def test_cleaned_documents(spark):
    line = "a line of more than ten words that stands in several documents"
    schema = "doc_id long, text string, lang string, n_chars int, mask string, parts string"
    rows = [(1, f"{line}\nown text", "en", 9, "m", "p"), (2, line, "en", 9, "m", "p"), (3, f"x\n{line}\ny", None, 9, None, None),
            (4, None, "en", 0, "m", "p"), (5, "", "en", 0, "m", "p"), (3, f"x\n{line}\ny", None, 9, None, None), (None, line, "en", 1, "m", "p")]
    docs = spark.createDataFrame(rows, schema)
    left = line_dedup.cleaned(docs)
    assert left.schema.names == docs.schema.names
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in left.collect()), key=str) == sorted(
        [(1, rows[0][1], 9), (3, "x\ny", 3), (3, "x\ny", 3), (4, None, 0), (5, "", 0)], key=str
    )
    assert line_dedup.cleaned(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "line",
    ["漢字仮名交じり文" * 8, "ข้อความภาษาไทยที่ยาวพอสมควร" * 3, "\t".join("abcdefghijkl"), "\u00a0".join("abcdefghijkl"), "\u3000".join("abcdefghijkl")],
)
def test_repeated_lines_without_blanks(spark, line):
    short = line[:9]
    rows = [(1, f"one\n{line}"), (2, f"two\n{line}\nend"), (3, f"three\n{short}"), (4, f"four\n{short}")]
    found = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r.text for r in found}
    assert got == {1: f"one\n{line}", 2: "two\nend", 3: f"three\n{short}", 4: f"four\n{short}"}
