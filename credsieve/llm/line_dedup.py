"""Removal of repeated line runs, by a suffix array over line ids.

All texts together are one sequence of line ids; a position is a document and
a line number, in this order.  Prefix doubling ranks the suffixes at these
positions by their first 1, 2, 4, ... lines: the rank of a pair of neighbouring
ranks, given out by a range-partitioned sort.  Suffixes with a rank of their
own need no further round and leave; those that share one are an interval of
the suffix array whose longest common prefix has at least that many lines.

A run counts as repeated if it has `least_words` words and occurs earlier.  The
shortest such runs from each line on, and those up to each line, cover every
longer run completely.  Two overlapping ranks tell such runs apart whatever
their length, and all but the first of each interval go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.words import may_lack_blanks, word_count
from credsieve.session import keep

LEAST_WORDS = 10
_POSITION = ["doc", "print", "line"]
_NO_ID = (1 << 63) - 1


def _keys(docs: DataFrame) -> list[Column]:
    """What tells documents apart and orders them: doc_id (none: last), then a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("print")]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, print, line, h1, h2, words): two hashes of each line without outer blanks, and its words."""
    # the whole text is searched once for what needs a closer count
    texts = docs.where("text is not null").select(*_keys(docs), may_lack_blanks(F.col("text")).alias("odd"), "text")
    every = texts.select("doc", "print", "odd", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    bare = F.btrim("raw", F.lit(" \t\r"))
    return every.select(
        *_POSITION, F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2"), word_count(bare, F.col("odd")).alias("words")
    )


def _ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """`groups` (one row for each value of the keys) with a rank in the order of the keys."""
    return keep(groups.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _repeated(lines: DataFrame) -> DataFrame:
    """Lines that occur more than once, with the rank of their content."""
    groups = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    found = lines.join(_ranked(groups, ["h1", "h2"]), ["h1", "h2"])
    return keep(found.select(*_POSITION, "words", "rank").dropDuplicates(_POSITION), "repeated")


def _doubled(ranks: DataFrame, span: int) -> DataFrame:
    """Ranks by twice as many lines, of the positions that share theirs; `span`: lines ranked so far."""
    after = ranks.select("doc", "print", (F.col("line") - span).alias("line"), F.col("rank").alias("then"))
    pairs = keep(ranks.join(after, _POSITION), "pairs")
    groups = pairs.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1").select("rank", "then")
    order = _ranked(groups.withColumnRenamed("rank", "now"), ["now", "then"])
    return keep(
        pairs.withColumnRenamed("rank", "now").join(order, ["now", "then"]).select(*_POSITION, "rank"), "doubled"
    )


def _shortest_runs(repeated: DataFrame, least_words: int) -> DataFrame:
    """(doc, print, line, lines): the shortest runs with enough words from each line on and up to each line.

    `upto` counts the words of a stretch of repeated lines up to and with a
    line.  A run from one line on ends at the first line whose `upto` is large
    enough; sorting starts and ends together, that is the next end.
    """
    doc = Window.partitionBy("doc", "print").orderBy("line")
    stretch = repeated.withColumn("stretch", F.col("line") - F.row_number().over(doc))
    upto = F.sum("words").over(Window.partitionBy("doc", "print", "stretch").orderBy("line"))
    counted = stretch.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    own = ("doc", "print", "stretch")
    shown = lambda key, start, end: counted.select(
        *own, key.alias("key"), (F.col("line") if start else F.lit(None).cast("int")).alias("start"),
        (F.col("line") if end else F.lit(None).cast("int")).alias("end"),
    )
    starts_and_ends = shown(F.col("before") + least_words, True, False).union(shown(F.col("upto"), False, True))
    down = Window.partitionBy(*own).orderBy(
        F.col("key").desc(), F.col("end").isNull().asc(), F.coalesce("end", "start").desc()
    ).rowsBetween(Window.unboundedPreceding, 0)
    forward = starts_and_ends.withColumn("to", F.last("end", ignorenulls=True).over(down)).where("start is not null")
    ends_and_starts = shown(F.col("upto") - least_words, False, True).union(shown(F.col("before"), True, False))
    up = Window.partitionBy(*own).orderBy(
        F.col("key"), F.col("start").isNull().asc(), F.coalesce("start", "end")
    ).rowsBetween(Window.unboundedPreceding, 0)
    backward = ends_and_starts.withColumn("from", F.last("start", ignorenulls=True).over(up)).where("end is not null")
    runs = forward.where("to is not null").select("doc", "print", F.col("start").alias("line"), "to").union(
        backward.where("from is not null").select("doc", "print", F.col("from").alias("line"), F.col("end").alias("to"))
    )
    return runs.select("doc", "print", "line", (F.col("to") - F.col("line") + 1).alias("lines")).distinct()


def repeated_lines(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, print, line) of every line in a run of at least `least_words` words that occurs earlier."""
    repeated = _repeated(lines)
    # the largest power of two within a run, exactly
    level = F.length(F.bin("lines")) - 1
    runs = keep(_shortest_runs(repeated, least_words).withColumn("level", level), "runs")
    longest = runs.agg(F.max("level")).first()[0]
    ranks, found = repeated.select(*_POSITION, "rank"), None
    for step in range((longest or 0) + 1):
        span = 1 << step
        if step:
            ranks = _doubled(ranks, span // 2)
        second = ranks.select("doc", "print", F.col("line").alias("at"), F.col("rank").alias("then"))
        own = runs.where(F.col("level") == step).withColumn("at", F.col("line") + F.col("lines") - span)
        named = own.join(ranks, _POSITION).join(second, ["doc", "print", "at"])
        named = named.select(*_POSITION, "lines", "rank", "then")
        first = named.groupBy("lines", "rank", "then").agg(F.min(F.struct(*_POSITION)).alias("first"))
        later = named.join(first, ["lines", "rank", "then"]).where(F.struct(*_POSITION) > F.col("first"))
        found = later.select(*_POSITION, "lines") if found is None else found.union(later.select(*_POSITION, "lines"))
    covered = F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)).alias("line")
    return found.select("doc", "print", covered).distinct()


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, marks: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """`docs` with later copies of line runs cut out of the column text, and two counts appended.

    Needs doc_id and text; other columns are carried along (those named as the
    counts are replaced).  Documents are ordered by doc_id, those without one
    last, and by a hash of the text where that is equal; rows equal in both are
    one document and are treated alike.  Lines end at line feeds and are
    compared without outer blanks, tabs and carriage returns; words are counted
    by white space, and by characters where a script has none between words
    (`words.word_count`).  A null text stays null with no lines, an empty one is one empty
    line; runs below `least_words` words stay.  An empty table gives no rows.
    """
    lines = keep(_lines(docs), "lines")
    gone = keep(repeated_lines(lines, least_words), "gone")
    flags = lines.select(*_POSITION).dropDuplicates(_POSITION).join(
        gone.select("doc", "print").distinct(), ["doc", "print"], "left_semi"
    ).join(gone.withColumn("gone", F.lit(True)), _POSITION, "left")
    listed = F.array_sort(F.collect_list(F.struct("line", F.coalesce("gone", F.lit(False)).alias("gone"))))
    masks = flags.groupBy("doc", "print").agg(F.transform(listed, lambda x: x["gone"]).alias("mask"))
    carried = [c for c in docs.columns if c.lower() not in marks]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), "text", *_keys(docs))
    every = row.join(masks, ["doc", "print"], "left").withColumn("parts", F.split("text", "\n"))
    left = F.filter("parts", lambda x, i: ~F.get("mask", i))
    text = F.when(F.col("mask").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    lost = F.coalesce(F.size(F.filter("mask", lambda x: x)), F.lit(0))
    fields = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in carried]
    return every.select(
        *fields, F.coalesce(F.size("parts"), F.lit(0)).alias(marks[0]), F.greatest(lost, F.lit(0)).alias(marks[1])
    )


def cleaned(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The columns of `docs` after line dedup; n_chars, if there, follows the text.

    A document that is nothing but later copies has no text left and goes;
    documents that were empty before stay.
    """
    marks = ("_n_lines", "_n_deleted")
    while {c.lower() for c in docs.columns} & set(marks):
        marks = (f"_{marks[0]}", f"_{marks[1]}")
    after = without_repeats(docs, least_words, marks).where(
        (F.col(marks[1]) == 0) | F.col("text").isNull() | (F.btrim("text", F.lit(" \t\r\n")) != "")
    )
    size = {"n_chars": F.when(F.col(marks[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
    return after.withColumns(size if "n_chars" in docs.columns else {}).select(*(F.col(f"`{c}`") for c in docs.columns))
