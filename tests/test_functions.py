import base64
import fnmatch
import hashlib
import html
import math
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve.functions import paths, payload, pyregex, text
from credsieve.operators.catalogue import DEFAULT_CATALOGUE
from tests import model


def values(spark, items, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(items)]
    frame = spark.createDataFrame(rows, f"i int, v {kind}").repartition(4)
    found = frame.select("i", column.alias("r")).collect()
    return [r.r for r in sorted(found, key=lambda r: r.i)]


def test_lines_entropy_and_redaction_of_random_texts(spark):
    rng = model.rng(1)
    items = ["", "\n", "a", "abcd", "abcde", "\r\n\r\n", "x" * 11] + [
        model.random_text(rng) for _ in range(600)
    ]
    v = F.col("v")
    assert values(spark, items, text.splitlines(v)) == [s.splitlines() for s in items]
    assert values(spark, items, text.redact(v)) == [model.stars(s) for s in items]
    got = values(spark, items, text.shannon_entropy(v))
    want = [model.bits(s) if s else 0.0 for s in items]
    assert got == pytest.approx(want, abs=1e-12)
    assert values(spark, items, text.strip_space(v)) == [s.strip() for s in items]
    assert values(spark, items, text.html_escape(v)) == [html.escape(s) for s in items]
    assert values(spark, items, text.universal_newlines(v)) == [
        re.sub("\r\n?", "\n", s) for s in items
    ]


def test_entropy_of_even_spreads_is_exact(spark):
    items = ["01234567" * 3, "0123456789abcdef" * 2, "ab" * 12, "0011223344556677" * 2]
    items += ["aaaabbcd" * 3, "a" * 40, "0123" * 8 + "4567" * 8]
    assert values(spark, items, text.shannon_entropy(F.col("v"))) == [3, 4, 1, 3, 1.75, 0, 3]


def test_entropy_of_large_alphabets(spark):
    rng = model.rng(7)
    wide = [chr(0x4E00 + i) for i in range(5000)]
    items = ["".join(rng.choice(wide) for _ in range(n)) for n in (300, 5000, 200_000)]
    items += [chr(0x1F600) * 3 + "a", "".join(map(chr, range(0x100, 0x300)))]
    got = values(spark, items, text.shannon_entropy(F.col("v")))
    counts = [[i.count(c) / len(i) for c in set(i)] for i in items]
    assert got == pytest.approx([-sum(p * math.log2(p) for p in c) for c in counts], abs=1e-9)


def test_fingerprint_and_slug(spark):
    row = spark.sql("select 'o/r' r, 'a.py' p, 12 l, 'regex' m, 'AWS access  key!' n, 'A***Z' t")
    got = row.select(
        text.fingerprint(*[F.col(x) for x in "rplmnt"]).alias("f"),
        text.rule_slug(F.col("n"), F.col("m")).alias("s"),
    ).first()
    joined = "\x1f".join(["o/r", "a.py", "12", "regex", "AWS access  key!", "A***Z"])
    assert got.f == hashlib.sha256(joined.encode()).hexdigest()
    assert got.s == "aws-access-key-regex"


def test_globs_agree_with_fnmatch(spark):
    rng = model.rng(2)
    globs = list(fixed.ENTROPY_EXCLUDED_GLOBS) + [
        "docs/*", "*.[ch]", "[!a]*", "a?b*", "x[a-c]*/y", "[[]z", "*&&*", "{a}*", "v[]]", "w[^a]", "",
    ]
    names = ["".join(rng.choice("ab/.xtest_[]&^{}zvw-é\n") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    names += ["a/tests/b.py", "tests/x", "dist/app.min.js", "frontend/package-lock.json", "my_test.go"]
    for some in (globs, globs[:12], globs[46:], ["docs/*"]):
        got = values(spark, names, paths.matches_any_glob(F.col("v"), some))
        want = []
        for n in names:
            parts = (n, PurePosixPath(n).name)
            want.append(any(fnmatch.fnmatchcase(p, g) for g in some for p in parts))
        assert got == want


def test_path_parts_agree_with_pathlib(spark):
    items = [
        "a/b.py", "b.PNG", ".env", "a/.env", "a/..x", "a/b.", "x.tar.gz", "a/b/", "a/./", "./x.csv", ".",
        "a//b.svg", "..", "a/..", "n.", "/x/y.pem",
    ]
    v = F.col("v")
    assert values(spark, items, paths.basename(v)) == [PurePosixPath(s).name for s in items]
    assert values(spark, items, paths.suffix(v)) == [PurePosixPath(s).suffix for s in items]
    assert values(spark, items, paths.entropy_excluded(v)) == [model.path_skipped(s) for s in items]


@pytest.mark.parametrize(
    "name,label", [(" owner/repo ", "owner/repo"), ("owner / repo", "owner/repo"), ("owner", None),
                   ("owner/repo/extra", None), ("/repo", None), ("owner/", None), ("", None)],
)
def test_repository_names(spark, name, label):
    row = spark.createDataFrame([(name,)], "v string").select(
        paths.valid_repo_name(F.col("v")).alias("ok"), paths.repo_label(F.col("v")).alias("label")
    ).first()
    assert row.ok == (label is not None)
    assert label is None or row.label == label


def test_exclude_lists(spark):
    raw = ["*.min.js, package-lock.json ,,docs/*", "", " , ", None]
    want = [["*.min.js", "package-lock.json", "docs/*"], [], [], []]
    assert values(spark, raw, paths.parse_globs(F.col("v"))) == want
    assert [list(paths.glob_list(r)) for r in raw] == want
    assert paths.glob_list([" a ", "", "b"]) == ("a", "b")


def test_sizes_and_walk_order(spark):
    assert values(spark, [None, 0, 10, 11], paths.within_size(F.col("v"), 10), "bigint") == [True, True, True, False]
    with pytest.raises(ValueError):
        paths.within_size(F.col("v"), -1)
    found = ["b/z", "a/y/q", "zz", "a/x", "a.b/c", "a/.e"]
    rows = spark.createDataFrame([(p,) for p in found], "p string")
    got = [r.p for r in rows.orderBy(paths.walk_order(F.col("p"))).collect()]
    assert got == ["zz", "a/.e", "a/x", "a/y/q", "a.b/c", "b/z"]


def test_blob_texts_agree_with_strict_decoding(spark):
    rng = model.rng(3)
    items = ["", "=", "====", "QQ==", "QQ=", "Q", "not valid base64", "//4=", "aGk"]
    for _ in range(400):
        raw = base64.b64encode(bytes(rng.choice(b"abc\xc3\xa9\xff\n") for _ in range(rng.randint(0, 40)))).decode()
        if rng.random() < 0.4:
            at = rng.randint(0, len(raw))
            raw = raw[:at] + rng.choice(["\n", " ", "=", "", "!", "A"]) + raw[at + rng.randint(0, 1) :]
        items.append(raw)

    def strict(s):
        try:
            return base64.b64decode("".join(s.split()), validate=True).decode()
        except ValueError:
            return None

    got = values(spark, items, payload.blob_text(F.lit("base64"), F.col("v")))
    assert got == [strict(s) for s in items]
    assert values(spark, ["QQ=="], payload.blob_text(F.lit("utf-8"), F.col("v"))) == [None]


def test_catalogue_patterns_find_what_python_finds(spark):
    rng = model.rng(4)
    items = []
    for _ in range(900):
        kind, edge = rng.randrange(24), ["", " ", "²", "é", "_", "-", " ", "\x1c", "x", "٣", "\n"]
        items.append(rng.choice(edge) + model.token(rng, kind) + rng.choice(edge) + model.random_text(rng))
    columns = [F.regexp_extract_all("v", F.lit(s.jvm_pattern), F.lit(s.group)) for s in DEFAULT_CATALOGUE]
    got = values(spark, items, F.array(*columns))
    total = 0
    for item, found in zip(items, got):
        for signature, mine in zip(DEFAULT_CATALOGUE, found):
            matches = re.finditer(signature.regex, item, re.M | re.S)
            want = [m[signature.group] for m in matches]
            assert mine == want, signature.name
            total += len(want)
    assert total > 900


@pytest.mark.parametrize(
    "pattern",
    [r"(?P<q>['\"])x(?P=q)", r"[\w.&&[-]+", r"a{,2}b", r"x{y", r"[]a]+", r"[^]\s]+", r"^k\Z|^m$", r"\Bz", r"(?i:é)f",
     r"(?#c)\D+", r"é|\x41", r"[\W_]q", r"(?<!a)b(?=c)", r"\S\v?"],
)
def test_regex_dialect(spark, pattern):
    items = ["'x' \"x\"", "a&&b[-.", "ab aab b x{y", "]a] b", "k\nm\nk", "az z zz", "Éf éF", "1a٣", "éA\x0b", "!q _q", "bc abc", "k"]
    java = pyregex.search_pattern(pattern)
    got = values(spark, items, F.regexp_extract_all("v", F.lit(java), F.lit(0)))
    assert got == [[m[0] for m in re.finditer(pattern, s, re.M | re.S) if m[0]] for s in items]


@pytest.mark.parametrize("pattern", [r"(?a)x", r"(x)?(?(1)y|z)", r"\N{DIGIT ONE}", r"[^\W]"])
def test_regex_dialect_refuses(pattern):
    with pytest.raises(pyregex.RegexDialectError):
        pyregex.to_java(pattern)
