"""Out-of-place distances against brute force, and more languages than anyone speaks."""

import random
from collections import Counter

from credsieve.llm import language_id


def grams(text):
    """Codes of all n-grams: single letters, pairs with a letter, and triples around one; 0 is no letter."""
    code = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    found = Counter(c for c in code if c)
    found.update(1 << 54 | a << 18 | b for a, b in zip(code, code[1:], strict=False) if a or b)
    found.update(2 << 54 | a << 36 | b << 18 | c for a, b, c in zip(code, code[1:], code[2:], strict=False) if b)
    return found


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def brute_force(training, texts, size):
    counts = {}
    for lang, text in training:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    lists = {lang: {g: i for i, g in enumerate(ranked(c, size))} for lang, c in counts.items()}
    out = {}
    for number, text in texts.items():
        own = ranked(grams(text or ""), size)
        if not own or not lists:
            out[number] = ("und", 0.0)
            continue
        apart = {x: sum(abs(i - lists[x][g]) if g in lists[x] else size for i, g in enumerate(own)) for x in sorted(lists)}
        best = min(sorted(lists), key=apart.get)
        out[number] = (best, 1 - apart[best] / (size * len(own)))
    return out


def spoken(deal, letters, n):
    return " ".join("".join(deal.choices(letters, k=deal.choice([1, 2, 5, 9]))) for _ in range(n))


def check(spark, training, texts, size):
    learned = language_id.profiles(spark.createDataFrame(training, "lang string, text string"), size)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, learned, size).collect()}
    assert found == brute_force(training, texts, size)


def test_distances(spark):
    deal = random.Random(1)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "abéüñh", "dd": "abcdefgh", "und": "жзик"}
    training = [(lang, spoken(deal, letters, 60)) for lang, letters in alphabets.items() for _ in range(4)] + [(None, "abc"), ("aa", None)]
    texts = {i: spoken(deal, deal.choice([*alphabets.values()]), deal.choice([1, 3, 40])) for i in range(300)}
    texts |= {900: None, 901: "", 902: "12 +", 903: "ЖЗИК abc", 904: "日本語", 905: "a"}
    for size in (400, 12):
        check(spark, training, texts, size)


def test_hundreds_of_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "_CELLS", 1000)  # a few texts at a time
    deal = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçåøæ"
    alphabets = {f"l{i}-{i % 7}": "".join(deal.sample(letters, 8)) for i in range(330)}
    training = [(lang, spoken(deal, own, 40)) for lang, own in alphabets.items()]
    texts = {i: spoken(deal, own, 30) for i, own in enumerate(alphabets.values())}
    check(spark, training, texts, 100)
