"""Signatures that the JVM's engine could only search with a stack that grows with the text.

That engine calls itself once for every turn of a repeated group, and a stack
that overflows ends the executor, not only the task.  Signatures that repeat
groups without a small bound (``pyregex.repeats_groups``) are therefore
searched by Python's engine, which keeps its turns on the heap and whose
dialect they are written in, on the Arrow batches of the texts that pass their
gates.  A search that takes too long or too much memory is an error of its
text.
"""

from __future__ import annotations

import re
import signal
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.operators.catalogue import Signature

SECONDS = 120.0
TIME_ERROR = "search for a signature took too long"
MEMORY_ERROR = "search for a signature took too much memory"
_RESULT = "struct<matches:array<string>,gaps:array<string>,narrowed:array<string>,error:string>"
_STRINGS = pa.list_(pa.string())
_ARROW = pa.struct([("matches", _STRINGS), ("gaps", _STRINGS), ("narrowed", _STRINGS), ("error", pa.string())])


class _TooLong(Exception):
    pass


@contextmanager
def _limited(seconds: float) -> Iterator[None]:
    """Raise _TooLong in the block after some time; Python's engine looks for signals while it searches."""
    if threading.current_thread() is not threading.main_thread():
        yield  # signals reach the main thread alone
        return

    def stop(*_: object) -> None:
        raise _TooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def search(pattern: re.Pattern, group: int, content: str, seconds: float) -> dict:
    """Matches of one text, the pieces between them, and the narrowed values if there is a group for these."""
    matches, gaps, narrowed, last = [], [], [], 0
    try:
        with _limited(seconds):
            for found in pattern.finditer(content):
                matches.append(found.group())
                gaps.append(content[last : found.start()])
                narrowed.append(found.group(group) or "")
                last = found.end()
    except _TooLong:
        return {"error": TIME_ERROR}
    except MemoryError:
        return {"error": MEMORY_ERROR}
    return {"matches": matches, "gaps": [*gaps, content[last:]], "narrowed": narrowed if group else None}


def _searcher(catalogue: Sequence[Signature], ordinals: Sequence[int], seconds: float) -> Callable:
    wanted = {i: (catalogue[i - 1].regex, catalogue[i - 1].group) for i in ordinals}

    def of_batch(ordinal: pa.Array, content: pa.Array) -> pa.Array:
        compiled = {i: (re.compile(regex, re.M | re.S), group) for i, (regex, group) in wanted.items()}
        results = []
        for i, text in zip(ordinal, content, strict=True):  # one text at a time is decoded
            i = i.as_py()
            results.append(search(*compiled[i], text.as_py(), seconds) if i is not None and text.is_valid else None)
        return pa.array(results, _ARROW)

    return of_batch


def searched(texts: DataFrame, catalogue: Sequence[Signature], ordinals: Sequence[int], seconds: float = SECONDS) -> DataFrame:
    """``texts`` with a struct ``deep`` of what is found, NULL for all other signatures; its error adds to ``problem``."""
    find = F.arrow_udf(_searcher(catalogue, ordinals, seconds), _RESULT)
    # rows of other signatures send no text
    asked = F.when(F.col("pattern_ord").isin(list(ordinals)), F.col("pattern_ord"))
    found = texts.withColumn("deep", find(asked, F.when(asked.isNotNull(), F.col("content"))))
    return found.withColumn("problem", F.coalesce("problem", "deep.error"))
