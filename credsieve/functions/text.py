"""Column functions on text: lines, entropy, redaction, fingerprints, escaping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.pyregex import SPACE_RANGES

# What Python's str.splitlines() breaks on.
ODD_BREAKS = r"[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def raw_lines(text: Column) -> Column:
    """Array of lines, keeping the empty piece after a final line break.

    Nearly all texts break on line feeds alone; those take the cheap
    single-character split.
    """
    return F.when(text.rlike(ODD_BREAKS), F.split(text, LINE_BREAK, -1)).otherwise(
        F.split(text, "\n", -1)
    )


def splitlines(text: Column) -> Column:
    """Array of lines as ``str.splitlines()`` gives them."""
    body = F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(raw_lines(body))


def universal_newlines(text: Column) -> Column:
    """Turn CRLF and lone CR into LF, as a text-mode file read does."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def strip_space(text: Column) -> Column:
    """Remove Unicode white space at both ends, as ``str.strip()`` does."""
    return F.regexp_replace(text, f"\\A[{SPACE_RANGES}]+|[{SPACE_RANGES}]+\\z", "")


def remove_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE_RANGES}]+", "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def shannon_entropy(text: Column, more_feeds: Column | None = None) -> Column:
    """Bits per character; each distinct character is counted by removing it.

    ``more_feeds`` line feeds count as part of the text without being in it.
    """
    more = F.lit(0).cast("bigint") if more_feeds is None else more_feeds
    length = (F.char_length(text) + more).cast("double")

    def plogp(count: Column) -> Column:
        return (count / length) * F.log2(count / length)

    # Matches across the hunks of a patch hold very many line feeds.
    short = F.regexp_replace(text, "\n{2,}", "\n")
    characters = F.array_distinct(F.filter(F.split(short, "", -1), lambda c: c != ""))
    bits = F.aggregate(
        characters,
        F.lit(0.0),
        lambda acc, c: acc
        - plogp(length - F.char_length(F.replace(text, c, F.lit(""))) - F.when(c == "\n", 0).otherwise(more)),
    )
    return F.when(text == "", F.lit(0.0)).otherwise(bits + F.lit(0.0))


# A number below 1 has its last binary digit further right.
_SCALE, _SMALL_SCALE = 58, 62


def two_decimals(number: Column) -> Column:
    """A number from 0 to below 16 with two decimals, its exact binary value rounded half to even."""
    unit = F.when(number < 1, F.lit(1 << _SMALL_SCALE)).otherwise(F.lit(1 << _SCALE)).cast("decimal(20,0)")
    scaled = F.when(number < 1, number * F.lit(float(1 << _SMALL_SCALE))).otherwise(number * F.lit(float(1 << _SCALE)))
    exact = scaled.cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    whole = F.floor(exact / unit).cast("bigint")
    # the quotient is rounded to some digits, so the remainder decides
    rest = exact - whole.cast("decimal(10,0)") * unit
    whole = whole - (rest < 0).cast("bigint")
    rest = F.when(rest < 0, rest + unit).otherwise(rest)
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    cents = whole + up.cast("bigint")
    return F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)


def redact(text: Column) -> Column:
    """Keep a fifth of the text at either end and star out the rest."""
    length = F.char_length(text)
    keep = F.greatest(F.lit(1), F.floor(length / 5).cast("int"))
    starred = F.concat(
        F.left(text, keep),
        F.repeat(F.lit("*"), F.greatest(F.lit(1), length - keep * 2)),
        F.right(text, keep),
    )
    return F.when(length <= 4, F.repeat(F.lit("*"), length)).otherwise(starred)


def fingerprint(
    repo: Column, path: Column, line: Column, method: Column, name: Column, text: Column
) -> Column:
    """Stable identity of a finding; it ignores commit and confidence."""
    parts = [repo, path, line.cast("string"), method, name, text]
    joined = F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.sha2(joined, 256)


def rule_slug(name: Column, method: Column) -> Column:
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.concat(F.trim(dashed, F.lit("-")), F.lit("-"), method)


def html_escape(text: Column) -> Column:
    entities = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), entities, text)
