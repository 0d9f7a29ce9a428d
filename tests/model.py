"""Brute-force model of the expected results, one text at a time."""

import fnmatch
import hashlib
import math
import random
import re
from bisect import bisect_left
from pathlib import PurePosixPath

from credsieve import fixed_values as fixed
from credsieve.operators.catalogue import DEFAULT_CATALOGUE

DIRECTIVE = re.compile(fixed.IGNORE_DIRECTIVE_FORMAT)


def bits(value):
    n, total = len(value), 0.0
    for char in dict.fromkeys(value):
        p = value.count(char) / n
        total -= p * math.log2(p)
    return total


def stars(value):
    n = len(value)
    if n < 5:
        return "*" * n
    keep = max(1, n // 5)
    return value[:keep] + "*" * max(1, n - 2 * keep) + value[n - keep :]


def regex_rows(content, catalogue=DEFAULT_CATALOGUE):
    feeds = [i for i, ch in enumerate(content) if ch == "\n"]
    lines, rows = content.splitlines(), []
    for signature in catalogue:
        seen = []
        for m in re.finditer(signature.regex, content, re.M | re.S):
            value = m["secret"] if "secret" in m.re.groupindex else m[0]
            number = bisect_left(feeds, m.start()) + 1
            silenced = number <= len(lines) and DIRECTIVE.search(lines[number - 1])
            if value and not silenced and (number, value) not in seen:
                seen.append((number, value))
        rows += [(n, stars(v), "regex", signature.name, signature.confidence, bits(v)) for n, v in seen]
    return rows


def path_skipped(path):
    clean = path.replace("\\", "/")
    pure = PurePosixPath(clean)
    return pure.suffix.lower() in fixed.ENTROPY_EXCLUDED_SUFFIXES or any(
        fnmatch.fnmatchcase(p, g) for g in fixed.ENTROPY_EXCLUDED_GLOBS for p in (clean, pure.name)
    )


def entropy_rows(content, path="f.txt", threshold=4.7, hex_threshold=3.0, min_length=21):
    if path_skipped(path):
        return []
    rows = []
    for number, line in enumerate(content.splitlines(), 1):
        low = line.lower()
        noisy = ("data:image/" in low and "base64," in low) or (
            len(line) > 2000 and line.count(";") > 20
        )
        if noisy or DIRECTIVE.search(line):
            continue
        seen = []
        for run in re.findall(r"[A-Za-z0-9_./+=:-]{21,}", line):
            value = run.strip(".")
            named = re.match(r"[A-Za-z0-9_.-]+[=:](.+)", value, re.S)
            if named and len(named[1]) >= min_length:
                value = named[1]
            parts = value.split(".")
            dotted = len(parts) > 2 and all(
                len(p) <= 30 and re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", p) for p in parts
            )
            floor = hex_threshold if re.fullmatch("[0-9a-fA-F]+", value) else threshold
            if len(value) >= min_length and not dotted and bits(value) > floor and value not in seen:
                seen.append(value)
        rows += [
            (number, stars(v), "entropy", fixed.ENTROPY_PATTERN_NAME, "medium", bits(v)) for v in seen
        ]
    return rows


def fingerprint(repo, path, line, method, name, redacted):
    return hashlib.sha256(
        "\x1f".join([repo, path, str(line), method, name, redacted]).encode()
    ).hexdigest()


def sparse_file(patch):
    """Added lines of a patch placed on their lines."""
    placed, at = {}, None
    for line in patch.splitlines():
        head = re.match(fixed.HUNK_HEADER_FORMAT, line)
        if head:
            at = int(head[1])
        elif at is None or line[:1] in ("-", "\\") or line[:3] == "+++":
            pass
        else:
            if line[:1] == "+":
                placed[at] = line[1:]
            at += 1
    return "\n".join(placed.get(i, "") for i in range(1, max(placed) + 1)) if placed else ""


# --- material for random texts ------------------------------------------------------

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def draw(rng, n, alphabet=LETTERS):
    return "".join(rng.choice(alphabet) for _ in range(n))


def token(rng, kind):
    """An invented token for the signature at position ``kind`` of the catalogue."""
    r = lambda n, a=LETTERS: draw(rng, n, a)
    up, hx = LETTERS[:26] + LETTERS[-10:], "0123456789abcdef"
    return [
        lambda: rng.choice(["AK", "AS"]) + "IA" + r(16, up),
        lambda: rng.choice(["aws_", "AWS_", "awſ_"])
        + "secret_" + rng.choice(["access", "ACCESS"]) + rng.choice(["_key", "_KEY"])
        + rng.choice([" = ", "=\n ", ":", " ="]) + rng.choice(['"', "'", ""]) + r(40, LETTERS + "/+"),
        lambda: rng.choice(["gh" + "p_", "gh" + "o_"]) + r(rng.choice([36, 40, 260])),
        lambda: "glp" + "at-" + r(20),
        lambda: rng.choice("sp") + "k_" + "live_" + r(rng.choice([24, 30])),
        lambda: "-----BEGIN " + rng.choice(["", "RSA "]) + "PRIVATE " + "KEY-----\n" + r(64) + "\n" + r(20)
        + rng.choice(["\n", " "]) + "-----END PRIVATE " + "KEY-----",
        lambda: "ey" + "J" + r(12) + "." + r(11) + "." + r(14),
        lambda: "sk-" + "ant-" + r(5) + "-" + r(82),
        lambda: "sk-" + rng.choice(["", "proj-"]) + r(20) + "T3Blbk" + "FJ" + r(20),
        lambda: "hf" + "_" + r(34),
        lambda: "SG" + "." + r(22) + "." + r(43),
        lambda: "AI" + "za" + r(35),
        lambda: "xox" + rng.choice("baprsz") + "-" + r(rng.choice([9, 10, 30])),
        lambda: "https://hooks.sl" + "ack.com/services/T" + r(8) + "/B" + r(9) + "/" + r(24),
        lambda: "npm" + "_" + r(36),
        lambda: "pypi-" + "AgEIcHlwaS5vcmc" + r(50),
        lambda: "do" + rng.choice("opr") + "_v1_" + r(64, hx),
        lambda: "S" + "K" + r(32, hx),
        lambda: "ke" + "y-" + r(32),
        lambda: "Account" + "Key=" + r(86) + "==",
        lambda: rng.choice(["postgres", "postgresql", "mysql", "mongodb+srv", "http"]) + "://"
        + rng.choice(["u", "üser"]) + ":" + r(6) + "@h:1/d",
        lambda: rng.choice("MN") + r(22) + rng.choice(["٣", "7"]) + "." + r(5) + rng.choice(["é", "x"])
        + "." + r(27),
        lambda: rng.choice(["12345678", "١٢٣٤٥٦٧٨٩"]) + ":" + r(35),
        lambda: "sq0" + "atp-" + r(22),
    ][kind]()


def random_text(rng):
    breaks = ["\n"] * 8 + ["\r\n", "\r", "\x0c", "\x1c", " ", "\x85", "\x0b"]
    noise = [
        "plain words ", "été ² ", "x=", "a.b.c.", " ", " ", "²", "_", "-", "k: ",
        " # secret-scanner: ignore", " // PRAGMA: allowlist  secret", "secret-ſcanner:allow ",
        "data:image/png;base64,", "A=B=", "pkg.module.Class.method.name.more ", ".", "١", "name/x=", "\uffff",
    ]
    out = []
    for _ in range(rng.randint(1, 14)):
        pick = rng.random()
        if pick < 0.3:
            piece = token(rng, rng.randrange(24))
            out.append(piece)
            if rng.random() < 0.15:
                out += [" ", piece]
        elif pick < 0.45:
            out.append(draw(rng, rng.randint(15, 60), rng.choice([LETTERS + "_./+=:-", "0123456789abcdef", "ab"])))
        elif pick < 0.7:
            out.append(rng.choice(breaks))
        else:
            out.append(rng.choice(noise))
        if rng.random() < 0.4:
            out.append(rng.choice([" ", " ", '"', "\n"]))
    if rng.random() < 0.02:
        out.append("v=1;" * 600 + draw(rng, 40))
    return "".join(out)


def random_patch(rng):
    out = []
    for _ in range(rng.randint(1, 30)):
        pick = rng.random()
        if pick < 0.15:
            out.append(f"@@ -{rng.randint(0, 9)}{rng.choice(['', ',3'])} +{rng.randint(0, 40)}{rng.choice(['', ',9'])} @@ f")
        elif pick < 0.2:
            out.append(rng.choice(["+++ b/x", "--- a/x", "\\ No newline at end of file", "++more", "@@ bad @@", ""]))
        else:
            body = token(rng, rng.randrange(24)) if rng.random() < 0.3 else draw(rng, rng.randint(0, 30))
            out.append(rng.choice("+++- ") + body)
        out.append(rng.choice(["\n"] * 9 + ["\r\n"]))
    return "".join(out)


def rng(seed):
    return random.Random(seed)
