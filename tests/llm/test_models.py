"""Learned operators: held-out accuracy, and awkward inputs."""

import random

import numpy as np
import pytest

from credsieve.llm import language_id, quality, toxicity

SOUNDS = {
    "aa": ["ka", "lo", "mi", "tan", "vor"],
    "bb": ["she", "ing", "ther", "wol", "que"],
    "cc": ["žu", "ře", "čin", "ská", "ov"],
}


def text_of(deal, language, words):
    return " ".join("".join(deal.choices(SOUNDS[language], k=deal.randrange(1, 4))) for _ in range(words))


def test_languages(spark):
    deal = random.Random(1)
    rows = [(i, text_of(deal, lang, deal.choice([2, 10, 80])), lang) for i, lang in enumerate(deal.choices(list(SOUNDS), k=600))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.profiles(frame.where("doc_id % 4 <> 2").select("lang", "text"))
    assert learned.groupBy("lang").count().where("count > 400").count() == 0
    found = language_id.identify(frame.where("doc_id % 4 = 2"), learned).collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert right >= 0.98 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_language_counts_by_hand(spark):
    frame = spark.createDataFrame([("x", "Aa a"), ("x", None), (None, "zzz"), ("y", "")], "lang string, text string")
    rows = language_id.profiles(frame).collect()
    assert {r.lang for r in rows} == {"x"}
    table = {ord("a"): "a", 0: "_"}
    mask = (1 << 18) - 1

    def shown(gram):
        kind, parts = gram >> 54, [gram >> 36 & mask, gram >> 18 & mask, gram & mask]
        return "".join(table[p] for p in parts[2 - kind :])

    counts = {"a": 3, "_a": 2, "aa": 1, "a_": 2, "_aa": 1, "aa_": 1, "_a_": 1}
    order = sorted(counts, key=lambda g: (-counts[g], [r.gram for r in rows if shown(r.gram) == g][0]))
    assert [shown(r.gram) for r in sorted(rows, key=lambda r: r.place)] == order


def test_languages_of_awkward_texts(spark):
    train = spark.createDataFrame([("aa", "kalo mitan vorka"), ("bb", "sheing therwol")], "lang string, text string")
    learned = language_id.profiles(train)
    long = "sheing therwol " * 150_000
    rows = [(1, None, 5.0), (2, "", 5.0), (3, "12 + 3 = 15!", 5.0), (4, "KALO", 5.0), (5, long, 5.0), (None, "wol", 5.0), (4, "KALO", 5.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = language_id.identify(frame, learned).collect()
    got = sorted((str(r.doc_id), r.lang_pred) for r in found)
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "aa"), ("4", "aa"), ("5", "bb"), ("None", "bb")]
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    nothing = language_id.profiles(train.limit(0))
    assert {r.lang_pred for r in language_id.identify(frame, nothing).collect()} == {"und"}
    assert language_id.identify(frame.limit(0), learned).collect() == []


def test_a_long_text_is_counted_like_its_parts():
    text = "kalo mitan " * 200_000
    parts = language_id._pieces(text)
    assert "".join(parts) == text and len(parts) > 1
    whole = language_id._grams([text])
    cut = [language_id._grams([p]) for p in parts]
    merged = language_id._merge(np.concatenate([k for k, _ in cut]), np.concatenate([n for _, n in cut]))
    assert (whole[0] == merged[0]).all() and (whole[1] == merged[1]).all()


STEMS = ["grum", "vlek"]


def labelled(spark, seed=3, count=1500):
    deal = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        words = text_of(deal, deal.choice(list(SOUNDS)), deal.choice([6, 40, 200])).split()
        toxic = deal.random() < 0.15
        if toxic:
            for _ in range(deal.choice([1, 2, 8])):
                words.insert(deal.randrange(len(words)), deal.choice(STEMS).title() + deal.choice(["", "ka", "lomi", "s"]))
        rows.append((i, " ".join(words), "x", 0.5))
        if i % 2:
            labels.append((i, 1, int(toxic), int(toxic)))
        else:
            labels.append((i, 0, None, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, severity double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, truth int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    graded = toxicity.grade(docs, model).join(labels.where("toxic is null").select("doc_id", "truth"), "doc_id").collect()
    assert sum(r.toxic == bool(r.truth) for r in graded) >= 0.97 * len(graded)
    assert all(0 <= r.severity <= 2 for r in graded)
    few, many = (np.mean([r.severity for r in graded if r.truth and (len(r.text.lower().split("grum")) + len(r.text.lower().split("vlek"))) > n]) for n in (2, 7))
    assert many > few
    left = toxicity.without_toxic(docs, labels)
    assert left.schema == docs.schema and left.count() == docs.count() - toxicity.grade(docs, model).where("toxic").count()


def test_toxicity_with_awkward_rows(spark):
    docs, labels = labelled(spark, 4, 600)
    model = toxicity.fit(docs, labels)
    rows = [(1, None, None, None), (None, "", None, None), (2, "grum " * 300_000, None, None), (2, "grum " * 300_000, None, None), (3, "kalo", None, None)]
    found = toxicity.grade(spark.createDataFrame(rows, docs.schema), model).collect()
    assert sorted((str(r.doc_id), r.toxic) for r in found) == [("1", False), ("2", True), ("2", True), ("3", False), ("None", False)]
    assert toxicity.grade(docs.limit(0), model).collect() == []
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic is null")):
        assert toxicity.grade(docs, toxicity.fit(docs, none)).where("toxic").count() == 0
    twice = labels.union(labels.where("toxic is not null").selectExpr("doc_id", "quality", "0", "truth"))
    assert toxicity.fit(docs, twice).index.keys() == model.index.keys()


def test_ordinal_fit_shares_weights_over_ordered_thresholds():
    deal = np.random.default_rng(5)
    active = deal.random((4000, 6)) < 0.3
    truth = np.array([3.0, 2.0, 1.0, 0, 0, 0])
    eta = active @ truth
    thresholds = np.array([1.0, 3.5, 5.0])
    grades = (deal.logistic(size=len(eta))[:, None] + eta[:, None] > thresholds).sum(axis=1)
    row, column = np.nonzero(active)
    weights, found = toxicity.fit_ordinal(row, column, grades, 6, ridge=1e-6, steps=1500)
    assert (np.diff(found) > 0).all()
    assert np.allclose(weights, truth, atol=0.3) and np.allclose(found, thresholds, atol=0.3)
    p = toxicity._grade_probabilities(eta, thresholds)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


def pages(spark, seed=7, count=1200, known=0.4):
    deal = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        good = deal.random() < 0.8
        text = text_of(deal, "bb", deal.choice([8, 60, 300]))
        if not good:
            text = deal.choice([text.upper() + "!!! " * 9, " | ".join(text.split()), "buy now " * 30, " ".join(w + "$$$" for w in text.split())])
        source = f"s{deal.randrange(5) + (0 if good or deal.random() < 0.3 else 50)}"
        rows.append((i, text, "bb", source, len(text), "k", 0.0))
        labels.append((i, int(good) if deal.random() < known else None, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, label double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, truth int")


def test_quality(spark):
    docs, labels = pages(spark)
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).join(labels.where("quality is null"), "doc_id").collect()
    assert sum(r.kept == bool(r.truth) for r in found) >= 0.97 * len(found)
    # the metadata view knows something of its own here
    meta = {t: np.mean([r.meta_score for r in found if r.truth == t]) for t in (0, 1)}
    assert meta[1] > meta[0] + 0.2
    left = quality.without_poor(docs, labels)
    assert left.schema == docs.schema
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in quality.score(docs, model).where("kept").collect()}


def test_views_teach_each_other():
    deal = np.random.default_rng(2)
    truth = deal.random(4000) < 0.5
    content = truth[:, None] * 1.5 + deal.standard_normal((4000, 3))
    meta = np.column_stack([np.where(deal.random(4000) < 0.9, truth, ~truth) * 7 + 1, np.ones(4000), deal.random(4000)])
    known = 120
    edges = quality._edges(content[:known], meta[:known], (9, 2))
    bins = [quality._binned(x, e) for x, e in zip((content, meta), edges, strict=True)]
    others, seen = [b[known:] for b in bins], []

    def teach(givers, views):
        found = quality.taught(others, givers, views)
        seen.append([plain_slopes(others, givers, views, which) for which in (0, 1)])
        for got, want in zip(found, seen[-1], strict=True):
            assert np.allclose(got.slope / quality._UNIT, want[0], atol=1e-3) and got.n == want[2]
            assert abs(got.loss / quality._UNIT - want[1]) < 1e-3
        return found

    held = np.arange(known) % 3 == 0
    model, history = quality.co_train([b[:known] for b in bins], edges, truth[:known].astype(int), held, teach)
    assert all(sum(h) > 0 for h in history) and len(history) == quality.ROUNDS
    combined, first, second = model.score(content, meta)
    accuracy = lambda p: ((p > 0.5) == truth).mean()
    assert accuracy(combined) >= max(accuracy(first), accuracy(second)) - 0.01 and accuracy(combined) > 0.9


def plain_slopes(bins, givers, views, which):
    """Row by row: what one view is taught by the other."""
    view, giver = views[which], givers[1 - which]
    levels = [v.edges.shape[1] + 1 for v in (view, giver)]
    slope, loss, n = np.zeros(len(view.weights)), 0.0, 0
    for own, other in zip(bins[which], bins[1 - which], strict=True):
        raw = giver.weights[-1] + sum(giver.weights[j * levels[1] + b] for j, b in enumerate(other))
        p = 1 / (1 + np.exp(-np.clip(raw * giver.calibration[0] + giver.calibration[1], -20, 20)))
        if 1 - quality.CONFIDENT < p < quality.CONFIDENT:
            continue
        y, at = float(p > 0.5), [j * levels[0] + b for j, b in enumerate(own)] + [-1]
        raw = sum(view.weights[i] for i in at)
        slope[at] += 1 / (1 + np.exp(-raw)) - y
        loss -= np.log(1 / (1 + np.exp(-raw)) if y else 1 - 1 / (1 + np.exp(-raw)))
        n += 1
    return slope, loss, n


def test_descent_reaches_the_minimum():
    """Against very many small steps down the plain slope."""
    deal = np.random.default_rng(4)
    truth = (deal.random((600, 3)) * 4).astype(int)
    y = (deal.random(600) < quality.logistic(truth.sum(axis=1) - 4.5)).astype(float)
    edges, ridge = np.tile([0.5, 1.5, 2.5], (3, 1)), 1e-2
    parts = [slice(0, 200), slice(200, 600)]
    start = quality.View(edges, np.zeros(13), np.array([1.0, 0.0]))
    descent = quality.Descent(start, truth[parts[0]], y[parts[0]], ridge)
    for _ in range(40):
        descent.step(quality.slopes(truth[parts[1]], y[parts[1]], descent.view))
    hot = np.zeros((600, 13))
    hot[np.arange(600)[:, None], truth + np.arange(3) * 4] = 1
    hot[:, -1] = 1
    weight = np.where(np.arange(600) < 200, 1 / 400, 1 / 800)
    value, held = np.zeros(13), np.append(np.full(12, ridge), 0)
    for _ in range(20_000):
        value -= 0.5 * (hot.T @ (weight * (quality.logistic(hot @ value) - y)) + held * value)
    assert np.allclose(descent.done().weights, value, atol=2e-3)


def test_every_document_is_judged(spark):
    """Slopes summed by Spark over the bins of all unlabelled rows are those of one pass in memory."""
    deal = np.random.default_rng(9)
    bins = [deal.integers(0, 4, (500, quality._MEASURES)), deal.integers(0, 4, (500, 3))]
    edges = [np.tile([0.5, 1.5, 2.5], (b.shape[1], 1)) for b in bins]
    views = [quality.View(e, deal.standard_normal(b.shape[1] * 4 + 1), np.array([1.0, 0.1])) for b, e in zip(bins, edges, strict=True)]
    table = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(*bins, strict=True)], "content array<int>, meta array<int>")
    found = quality._teacher(table.repartition(7))(views, views)
    for got, want in zip(found, quality.taught(bins, views, views), strict=True):
        assert (got.slope == want.slope).all() and (got.rows == want.rows).all() and (got.loss, got.n) == (want.loss, want.n)
    assert [x.n for x in quality._teacher(table.limit(0))(views, views)] == [0, 0]


def test_sources_and_languages_do_not_share_weights(spark):
    deal = random.Random(5)
    text = text_of(deal, "bb", 40)
    # (source, language) pairs of one quality each; en and pt, and many hosts, share a crc32 remainder
    good = {f"host{i}.example": i % 3 > 0 for i in range(1500)}
    rows = [(i, text, "en", host, 1) for i, host in enumerate(good)]
    labels = [(i, int(g)) for i, g in enumerate(good.values())]
    rows += [(10_000 + i, text, "pt" if i % 2 else "en", "same", 1) for i in range(600)]
    labels += [(10_000 + i, int(i % 2 == 0)) for i in range(600)]
    asked = [(-1 - i, text, lang, source, 1) for i, (lang, source) in enumerate(
        [("en", "same"), ("pt", "same"), ("never", "seen"), ("neither", "this"), (None, None)])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    model = quality.fit(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int"))
    found = {r.doc_id: r.meta_score for r in quality.score(spark.createDataFrame(asked, schema), model).collect()}
    assert found[-1] > 0.75 and found[-2] < 0.25
    assert found[-3] == found[-4]
    assert len(model.sources) == 1501 and model.languages.to_pylist() == ["en", "pt"]
    batch = spark.createDataFrame([("en", "same"), ("pt", None), ("x", "zz")], "lang string, source string").toArrow()
    codes = [quality._codes(batch.column(c), v).tolist() for c, v in (("lang", model.languages), ("source", model.sources))]
    assert codes == [[2, 3, 1], [2 + 1500, 0, 1]]


def test_quality_with_awkward_rows(spark):
    docs, labels = pages(spark, 8, 500)
    model = quality.fit(docs, labels)
    rows = [(1, None, None, None, None, None, None), (None, "", "x", "y", -5, None, None), (2, "word " * 400_000, None, "s1", 9, None, None),
            (2, "word " * 400_000, None, "s1", 9, None, None), (3, "日本語 " * 5, "bb", "s1", 1 << 60, None, None)]
    odd = spark.createDataFrame(rows, docs.schema)
    found = quality.score(odd, model).collect()
    assert len(found) == 5 and all(0 <= r.quality_score <= 1 for r in found)
    assert len({r.quality_score for r in found if r.doc_id == 2}) == 1
    assert quality.score(docs.limit(0), model).collect() == []
    for none in (labels.limit(0), labels.where("quality = 1"), labels.where("quality is null")):
        assert quality.fit(docs, none) is None
        assert quality.without_poor(odd, none).count() == 5
    assert quality.fit(docs.limit(0), labels) is None


@pytest.mark.parametrize("text", ["", "a", "A A a", "été ÉTÉ", "x\n\n\ny"])
def test_measures_are_finite(text):
    import pyarrow as pa

    found = quality.measures(pa.array([text, None, text]))
    assert np.isfinite(found).all() and (found[0] == found[2]).all() and not found[1].any()
