"""Long texts in pieces, so that one text is the work of many tasks.

A text is cut behind lines, and what lies within a line is searched for in the
pieces: tokens, and signatures that look at no line feed (``Signature.local``).
Signatures that may span lines still see the text as a whole, if it passes
their gates.  Texts with other line breaks than line feeds, by which their lines
are numbered in two ways, and sparse texts are not cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.functions import text

# What is known of a piece; a whole text is piece -1.
PIECE_COLUMNS = ("piece", "feeds_before", "chars_before")


def is_long(chars: int) -> Column:
    """The text is to be cut."""
    content = F.col("content")
    plain = F.col("line_nos").isNull() & F.col("problem").isNull()
    long = plain & (F.octet_length(content) > 2 * chars) & ~content.rlike(text.ODD_BREAKS)
    return F.coalesce(long, F.lit(False))


def pieces(long: DataFrame, columns: Sequence[str], chars: int, whole: bool) -> DataFrame:
    """A row for each piece of at least ``chars`` characters and whole lines, and one for the text if ``whole``.

    ``local`` tells the pieces from the text.  The rows are dealt out by their
    keys and number, so the pieces of one text go to different tasks.
    """
    # nothing is given back once taken, so the search needs no stack
    cut = F.regexp_extract_all("content", F.lit(rf"(?s).{{1,{chars}}}+[^\n]*+\n?"), F.lit(0))

    def size(piece: Column) -> Column:
        feeds = F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit("\n"), F.lit("")))
        return F.struct(feeds.cast("bigint").alias("feeds"), F.char_length(piece).alias("chars"))

    def before(sizes: Column, index: Column, name: str) -> Column:
        zero = F.lit(0).cast("bigint" if name == "feeds" else "int")
        return F.aggregate(F.slice(sizes, 1, index), zero, lambda total, s: total + s[name])

    def row(number: Column, local: bool, feeds: Column, chars_before: Column, content: Column) -> Column:
        return F.struct(
            number.cast("int").alias("piece"), F.lit(local).alias("local"), feeds.alias("feeds_before"),
            chars_before.alias("chars_before"), content.alias("content"),
        )

    def numbered(parts: Column) -> Column:
        def of_sizes(sizes: Column) -> Column:
            return F.transform(
                parts, lambda part, i: row(i, True, before(sizes, i, "feeds"), before(sizes, i, "chars"), part)
            )

        return text.bind(F.transform(parts, size), of_sizes)

    rows = text.bind(cut, numbered)
    if whole:
        rows = F.concat(rows, F.array(row(F.lit(-1), False, F.lit(0).cast("bigint"), F.lit(0), F.col("content"))))
    # a stated number, as partitions of well compressed text would be put together again
    tasks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = long.select(*columns, F.inline(rows)).repartition(tasks, *columns, "piece")
    return dealt.withColumn("line_nos", F.lit(None).cast("array<bigint>")).withColumn("problem", F.lit(None).cast("string"))
