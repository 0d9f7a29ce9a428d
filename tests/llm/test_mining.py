"""Whitening, decontamination and collocations against brute force, with awkward inputs."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credsieve.llm import collocations, decontamination, tokens, whitening
from credsieve.llm.arrays import utf8

VECTORS = "vec_id bigint, embedding array<float>, label int, component string, y string"


def folded(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# --- words ---


def test_words_of_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 16)
    texts = ["One TWO, three.", None, "", " ,. ", "é" * 300 + " é", "tail x" * 30, "Two two TWO"]
    words = tokens.Words(*utf8(pa.array(texts)), collocations.GAP, collocations.BREAKS)
    said = [re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", folded(t)) for t in texts]
    assert [words.text(i) for i in range(len(words))] == [w for s in said for w in s]
    assert np.diff(words.where).tolist() == [len(s) for s in said]
    known = {}
    for i, code in enumerate(words.code.tolist()):
        assert known.setdefault(words.text(i), code) == code
    assert len(set(known.values())) == len(known)
    assert len(set(words.part[:3].tolist())) == 2


def test_long_words_differ():
    texts = ["a" * 300, "a" * 299 + "b", "A" * 300]
    code = tokens.Words(*utf8(pa.array(texts)), collocations.GAP).code
    assert code[0] == code[2] != code[1]


def test_bit_table_holds_what_it_was_made_of(spark):
    codes = [random.Random(4).randrange(1 << 62) for _ in range(3000)]
    table = tokens.BitTable.of(spark.createDataFrame([(c,) for c in codes], "code bigint"), "code", len(codes))
    assert table.holds(np.array(codes, np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 62, 20_000).astype(np.uint64)
    assert table.holds(others).mean() < 0.02
    assert not tokens.BitTable.of(spark.createDataFrame([], "code bigint"), "code", 0).holds(others).any()


# --- whitening ---


def plain_polynomial(matrix):
    """det(x - matrix), lowest first, by traces of products."""
    d = len(matrix)
    out, product = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        product = [
            [sum(matrix[i][m] * product[m][j] for m in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)
        ]
        trace = sum(matrix[i][m] * product[m][i] for i in range(d) for m in range(d))
        out.append(Fraction(-trace, k))
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("d, kind", [(1, "full"), (2, "full"), (7, "full"), (9, "low"), (6, "block"), (5, "zero")])
def test_characteristic_polynomial(spark, d, kind):
    deal = random.Random(d)
    half = [[deal.randrange(-50, 50) for _ in range(2 if kind == "low" else d + 3)] for _ in range(d)]
    if kind == "zero":
        half = [[0]] * d
    if kind == "block":  # zeros below the diagonal where a pivot is looked for
        half = [[x if j == i % 2 else 0 for j, x in enumerate(row)] for i, row in enumerate(half)]
    matrix = [[sum(a * b for a, b in zip(x, y, strict=True)) for y in half] for x in half]
    assert whitening.characteristic(spark, matrix) == plain_polynomial(matrix)


def test_roots_and_their_multiplicities():
    from functools import reduce

    def times(p, root):
        return [(p[i - 1] if i else 0) - root * (p[i] if i < len(p) else 0) for i in range(len(p) + 1)]

    roots = [10**12 + 1, 10**12, 5, 5, 5, 3, 0, 0]
    polynomial = reduce(times, roots, [1])
    found = whitening.largest_roots(polynomial, 16)
    assert [(round(r), m) for r, m in found] == [(10**12 + 1, 1), (10**12, 1), (5, 3), (3, 1)]
    assert all(abs(r - round(r)) < Fraction(1, 1 << 100) for r, _ in found)
    assert [m for _, m in whitening.largest_roots(polynomial, 3)] == [1, 1, 3]
    assert whitening.largest_roots([0, 0, 1], 4) == []
    assert abs((whitening.largest_roots([2, -4, 1], 1)[0][0] - 2) ** 2 - 2) < Fraction(1, 10**40)


def brute_whitened(vectors, components=16):
    width = max(len(v) for v in vectors)
    x = np.array([np.floor(np.array([*v, *[0.0] * (width - len(v))]) * 64) for v in vectors]) + 1_000_000
    fitted = np.unique(x, axis=0)
    values, axes = np.linalg.eigh(np.cov(fitted.T, bias=True).reshape(width, width))
    return x, fitted, values[::-1][:components], axes[:, ::-1][:, :components]


def test_whitening(spark):
    deal = np.random.default_rng(8)
    base = (deal.normal(size=(300, 20)) * np.linspace(0.05, 2, 20)).astype(np.float32).astype(float)
    vectors = [*base.tolist(), base[0].tolist(), base[5].tolist(), [0.0] * 20, base[9].tolist()[:12]]
    rows = [(i, v, 1, "c", "y") for i, v in enumerate(vectors)] + [(None, vectors[3], None, None, None), (3, vectors[3], 0, "", "")]
    bad = [(900, None, 1, "", ""), (901, [float("nan")] * 20, 1, "", ""), (902, [None] * 20, 1, "", ""), (903, [float("inf")], 1, "", "")]
    found = whitening.whitened(spark.createDataFrame(rows + bad, VECTORS)).toPandas()
    assert len(found) == 16 * len(rows)
    x, fitted, values, axes = brute_whitened(vectors)
    expected = (x - fitted.mean(axis=0)) @ axes / np.sqrt(values)
    first = found[found.vec_id.notna()].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    got = first.whitened.to_numpy().reshape(len(vectors), 16)
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got * signs - expected).max() < 1e-8
    exact = [int(sum((len(fitted) * int(a) - int(s)) ** 2 for a, s in zip(r, fitted.sum(axis=0), strict=True))) for r in x]
    assert first.deviation.to_numpy().reshape(len(vectors), 16)[:, 0].tolist() == exact
    assert set(found.n) == {len(fitted)} and found.identity_error.nunique() == 1 and found.identity_error.max() < 1e-9
    shares = first.explained.to_numpy().reshape(len(vectors), 16)[0]
    assert np.allclose(shares, values / np.cov(fitted.T, bias=True).trace(), rtol=1e-9)


def test_whitening_of_equal_eigenvalues(spark):
    """Unit vectors of both signs: every direction has the same variance."""
    rows = [(2 * i + s, [(1 - 2 * s) * float(i == j) for j in range(5)], 0, "", "") for i in range(5) for s in (0, 1)]
    found = whitening.whitened(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert len(found) == 50 and np.allclose(found.explained, 0.2) and found.identity_error.max() < 1e-12


def test_whitening_without_anything_to_fit(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], 0, "", "") for i in range(4)], VECTORS)
    assert whitening.whitened(same).collect() == []
    assert whitening.whitened(same.limit(0)).collect() == []
    assert whitening.whitened(same.withColumn("embedding", F.slice("embedding", 5, 1))).collect() == []
    line = spark.createDataFrame([(i, [i * 0.5, i * 0.25], 0, "", "") for i in range(4)], VECTORS)
    assert len(whitening.whitened(line).collect()) == 4  # one component, the other has no variance


def test_whitening_of_huge_entries(spark):
    """Sums pass 64 bits; a deviation that a long cannot hold is null."""
    rows = [(0, [1e30, 3.0], 0, "", ""), (1, [-1e30, 5.0], 0, "", ""), (2, [0.0, 4.0], 0, "", "")]
    found = whitening.whitened(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert found.identity_error.max() < 1e-9 and found.deviation.notna().any()
    assert found[found.vec_id == 0].deviation.isna().all()


# --- decontamination ---


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def brute_hits(text, items):
    said, hit, names = words_of(text), set(), set()
    for name, item in items:
        words = words_of(item)
        size = min(len(words), 10)
        wanted = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
        for i in range(len(said) - size + 1 if size else 0):
            if tuple(said[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                names |= {str(name)} if name is not None else set()
    return len(said), len(hit), sorted(names)


def leaky(seed):
    deal = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(deal.choice([3, 60]))]
    spoken = lambda n: deal.choices(vocabulary, k=n)
    items = [(i, " ".join(spoken(deal.choice([2, 5, 9, 10, 11, 30])))) for i in range(12)]
    items += [(20, items[5][1]), (20, "zz yy"), (21, None), (22, " ,; "), (None, "kk " * 11), (23, "aa " * 40)]
    docs = []
    for number in range(40):
        words = spoken(deal.choice([0, 1, 8, 30, 80]))
        for _ in range(deal.choice([0, 1, 3])):
            source = words_of(deal.choice(items)[1])
            start = deal.randrange(len(source) + 1)
            place = deal.randrange(len(words) + 1)
            words[place:place] = source[start : start + deal.choice([8, 9, 10, 14, 40])]
        docs.append((number, deal.choice([" ", "-", ", "]).join(words).upper()))
    docs += [(100, None), (101, ""), (102, "aa " * 3000), (102, "kk." * 30), (None, items[5][1]), docs[3], (103, "ZZ+yy zz")]
    return docs, items


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sent", [decontamination.SENT_BYTES, 0])
def test_contaminated(spark, monkeypatch, seed, sent):
    if sent == 0 and seed > 1:
        return
    monkeypatch.setattr(decontamination, "SENT_BYTES", sent)
    docs, items = leaky(seed)
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, words string, item_id int")
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id bigint, text string, id string, start int")
    shown = lambda r: (str(r[0]), *r[1:])
    found = sorted(shown((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in decontamination.contaminated(rows, bench).collect())
    assert found == sorted(shown((d, *brute_hits(t, items))) for d, t in docs)


def test_spans_cover_what_is_hit(spark):
    docs, items = leaky(2)
    rows = spark.createDataFrame([d for d in docs if d[0] is not None and d[0] < 40][:40], "doc_id bigint, text string")
    found = defaultdict(set)
    for r in decontamination.spans(rows, spark.createDataFrame(items, "item_id bigint, text string")).collect():
        found[r.doc_id] |= set(range(r.start, r.stop))
    assert all(len(found[d]) == brute_hits(t, items)[1] for d, t in docs[:40])


def test_contaminated_without_rows(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    assert decontamination.contaminated(docs.limit(0), bench).collect() == []
    assert [tuple(r) for r in decontamination.contaminated(docs, bench.limit(0)).collect()] == [(1, 3, 0, [])]
    assert [tuple(r) for r in decontamination.contaminated(docs, bench).collect()] == [(1, 3, 2, ["1"])]


# --- collocations ---


def brute_collocations(rows, least, longest=4, top=2000, absorbed=80):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    chosen = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    most = defaultdict(int)
    for (lang, phrase), a in chosen.items():
        for size in range(2, len(phrase)):
            for i in range(len(phrase) - size + 1):
                inner = lang, phrase[i : i + size]
                most[inner] = max(most[inner], a)
    ranked = defaultdict(list)
    for (lang, phrase), a in chosen.items():
        if most[lang, phrase] and 100 * most[lang, phrase] >= absorbed * a:
            continue
        cuts = [(counts[lang, phrase[:k]], counts[lang, phrase[k:]], k) for k in range(1, len(phrase))]
        score, _, left, right = min((2_000_000 * a // (l + r), k, l, r) for l, r, k in cuts)
        ranked[lang].append((-score, -a, " ".join(phrase).encode(), left, right))
    return {
        (lang, i, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in ranked.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    }


def chatter(seed):
    deal = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Ü", "UP", "up", "x" * 300]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for _ in range(400):
        words = deal.choices(vocabulary, weights, k=deal.choice([0, 1, 6, 40]))
        if deal.random() < 0.4:
            words += ["new", "york", "city", "hall"][: deal.choice([2, 3, 4])]
        rows.append((deal.choice(["en", "en", "de", None, "und"]), "".join(w + deal.choice([" ", " ", "\t", "  ", ". ", "\n", ","]) for w in words)))
    return rows + [("en", None), ("en", ""), ("fr", "one two"), ("en", "aa " * 3000), ("xx", " .,. ")]


@pytest.mark.parametrize("head", [collocations.HEAD, 30, 0])
def test_collocations(spark, head):
    rows = chatter(head)
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, text string, score int, phrase string")
    found = {tuple(r) for r in collocations.collocations(docs, least=12, top=60, head=head).collect()}
    assert found == brute_collocations(rows, 12, top=60)


def test_collocations_of_many_ids(spark):
    """Enough frequent words that ids of a language start with a whole tile."""
    deal = random.Random(6)
    rows = [("en" if i % 3 else "de", " ".join(f"v{int(deal.paretovariate(0.4)) % 1500}" for _ in range(300))) for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = {tuple(r) for r in collocations.collocations(docs, least=3, longest=3).collect()}
    assert found == brute_collocations(rows, 3, longest=3)


def test_tiles_dense_and_sparse(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 8)
    monkeypatch.setattr(collocations, "DENSE", 20)
    deal = np.random.default_rng(3)
    left, right = (np.minimum(deal.geometric(0.05, 5000) - 1, 200) for _ in range(2))
    found = Counter()
    for a, b, n in collocations._tiled(left, right):
        found.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
    assert found == Counter(zip(left.tolist(), right.tolist(), strict=True))


def test_ranks_are_apart_by_group():
    deal = np.random.default_rng(5)
    group = np.repeat([7, 8, 9], [3000, 10, 1030])
    n = deal.integers(1, 500, len(group))
    ids, hot = collocations._ranks(group, n, np.arange(len(group)))
    assert len(set(ids.tolist())) == len(ids) and hot == 2 * collocations.TILE
    for g in (7, 9):
        own = ids[group == g]
        assert (np.sort(n[group == g])[::-1][: collocations.TILE] == n[group == g][np.argsort(own)][: collocations.TILE]).all()
    assert not {i // collocations.TILE for i in ids[group == 7]} & {i // collocations.TILE for i in ids[group == 9]}


def test_words_that_share_a_code_get_another_seed(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "a b a b a b")], "lang string, text string")
    texts = docs.select("lang", "text")
    seed, words, _ = collocations._words(texts, 1)
    assert seed == 0 and words.count() == 2
    whole = collocations._vocabulary

    def clashing(batches, seed):
        for batch in whole(batches, seed):
            codes = pa.array([1] * batch.num_rows) if seed == 0 else batch.column("code")
            yield batch.set_column(0, "code", codes)

    monkeypatch.setattr(collocations, "_vocabulary", clashing)
    assert collocations._words(texts, 1)[0] == 1


def test_collocations_without_rows(spark):
    docs = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs).collect() == []
    assert [r.phrase for r in collocations.collocations(docs, least=1).collect()] == ["a b"]
