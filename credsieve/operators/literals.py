"""An index from literals to signatures, for catalogues of thousands.

Most credential formats hold a literal, such as a prefix, that each match must
contain.  One automaton finds all literals of a catalogue in one pass over a
text, however many there are, and only signatures whose literal occurs are
searched for.  Signatures without such a literal keep gates of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from re import _constants as op
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.operators.catalogue import Signature

# Shorter literals are in nearly every text.
SHORTEST_LITERAL = 3
# A table of signatures up to this many characters is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_CHARACTERS = 4 * 1024 * 1024
_MOST_TURNS = 100
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)
_WIDTHLESS = (op.AT, op.ASSERT, op.ASSERT_NOT)


def _pieces(items: parser.SubPattern) -> list[str | None]:
    """Characters that every match holds, in order; None wherever something else may stand between them."""
    found: list[str | None] = []
    for kind, value in items:
        if kind is op.LITERAL and value != ord("\n"):  # a sparse text leaves out line feeds
            found.append(chr(value))
        elif kind is op.SUBPATTERN and not value[1] & re.I:
            found += _pieces(value[3])
        elif kind is op.ATOMIC_GROUP:
            found += _pieces(value)
        elif kind in _REPEATS and value[0] > 0:
            inner = _pieces(value[2])
            exact = value[0] == value[1] and value[0] <= _MOST_TURNS
            found += inner * value[0] if exact else [None, *inner, None]
        elif kind not in _WIDTHLESS:
            found.append(None)
    return found


def required_literal(regex: str) -> str:
    """The longest literal of one line that every match of a pattern holds, the first of several; may be empty."""
    parsed = parser.parse(regex, re.M | re.S)
    if parsed.state.flags & re.I:
        return ""
    runs = "".join("\n" if c is None else c for c in _pieces(parsed)).split("\n")
    return max(runs, key=len)


def by_literal(catalogue: Sequence[Signature]) -> dict[str, list[int]]:
    """Ordinals of the signatures that can be looked up, by their literal."""
    index: dict[str, list[int]] = {}
    for i, signature in enumerate(catalogue, start=1):
        literal = required_literal(signature.regex)
        if len(literal) >= SHORTEST_LITERAL:
            index.setdefault(literal, []).append(i)
    return index


def _finder(index: dict[str, list[int]]) -> Callable[[pa.Array], pa.Array]:
    def of_batch(contents: pa.Array) -> pa.Array:
        import ahocorasick  # on executors alone

        automaton = ahocorasick.Automaton()
        for literal in index:
            automaton.add_word(literal, literal)
        automaton.make_automaton()
        results = []
        for content in contents:  # one text at a time is decoded
            literals = {literal for _, literal in automaton.iter(content.as_py())} if content.is_valid else ()
            results.append(sorted(i for literal in literals for i in index[literal]))
        return pa.array(results, pa.list_(pa.int32()))

    return of_batch


def occurring(content: Column, index: dict[str, list[int]]) -> Column:
    """Ordinals of the signatures whose literal occurs in a text, ascending."""
    return F.arrow_udf(_finder(index), "array<int>")(content)


def with_signatures(texts: DataFrame, catalogue: Sequence[Signature]) -> DataFrame:
    """``texts`` with a struct ``signature`` of what their ``pattern_ord`` stands for; NULL for other detectors."""
    rows = [(i, (s.jvm_pattern, s.group, s.name, s.confidence)) for i, s in enumerate(catalogue, start=1)]
    spark: SparkSession = texts.sparkSession
    table = spark.createDataFrame(
        rows, "pattern_ord int, signature struct<pattern: string, grp: int, name: string, confidence: string>"
    )
    size = sum(len(pattern) + len(name) for _, (pattern, _, name, _) in rows)
    return texts.join(F.broadcast(table) if size <= BROADCAST_CHARACTERS else table, "pattern_ord", "left")
