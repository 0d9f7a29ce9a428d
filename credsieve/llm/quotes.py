"""Reply-ordered conversations from quotation links.

A message's lines are parsed into quote levels (leading `>` signs).  Lines of
one level that follow each other without an empty line form a passage; the
passages of level 0 are the message's own.  Quoted passages and their single
lines are normalised, hashed and joined to the messages that own the same
passage or line; the message that gives most of the quoted text becomes the
parent.  A message that quotes nothing known replies to the one before it in
its conversation.  What is quoted is cut from the texts.

Only the first owner of a passage counts, in the same conversation and over
all messages, so a passage that a third of all messages quote or own joins one
row.  Threads are followed by doubling, without gathering any in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.words import word_count
from credsieve.session import keep

FAR_WORDS = 8
_KEY = ["conv", "turn", "print"]
_ROUNDS = 60
_BUCKET = 256
#: How mail programs announce a quotation, in the four languages of the texts.
_INTRODUCTION = r"(?i)^.{0,300}\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def _parsed(text: Column) -> Column:
    """Array of (level, content) for the lines of a text."""
    marks = lambda line: F.regexp_extract(line, r"^[ \t]*(?:>[ \t]*)*", 0)
    level = lambda line: F.length(F.translate(marks(line), " \t", ""))
    return F.transform(
        F.split(text, "\r?\n"),
        lambda line: F.struct(
            level(line).alias("level"),
            F.when(level(line) == 0, line).otherwise(F.substring(line, F.length(marks(line)) + 1, F.length(line))).alias("content"),
        ),
    )


def _own_text(lines: Column) -> Column:
    """What a message says itself: no quoted lines, and none that only introduces them."""
    said = F.filter(
        lines,
        lambda x, i: (x["level"] == 0) & ~(x["content"].rlike(_INTRODUCTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)),
    )
    return F.btrim(F.array_join(F.transform(said, lambda x: x["content"]), "\n"), F.lit(" \t\r\n"))


def _normal(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def _passages(messages: DataFrame) -> DataFrame:
    """(key, level, h1, h2, size, words) of all passages and of their single lines, each once for a message and level."""
    lines = messages.select(*_KEY, F.posexplode("lines").alias("place", "line")).select(
        *_KEY, "place", F.col("line.level").alias("level"), _normal(F.col("line.content")).alias("said")
    ).where("said <> ''")
    follows = Window.partitionBy(*_KEY, "level").orderBy("place")
    runs = lines.withColumn("run", F.col("place") - F.row_number().over(follows)).groupBy(*_KEY, "level", "run").agg(
        F.array_sort(F.collect_list(F.struct("place", "said"))).alias("parts")
    )
    whole = runs.select(*_KEY, "level", F.array_join(F.transform("parts", lambda x: x["said"]), " ").alias("said"))
    both = whole.union(lines.select(*_KEY, "level", "said"))
    return both.select(
        *_KEY, "level", F.xxhash64("said").alias("h1"), F.xxhash64(F.lit(1), "said").alias("h2"),
        F.length("said").alias("size"), word_count(F.col("said")).alias("words"),
    ).distinct()


def _quoted_parents(messages: DataFrame) -> DataFrame:
    """(key, parent): the earlier message that owns most of what a message quotes, at the outermost level found."""
    passages = keep(_passages(messages), "passages")
    owned = passages.where("level = 0")
    quoted = passages.where("level > 0")
    hashes = ["h1", "h2"]
    here = owned.groupBy("conv", *hashes).agg(F.min(F.struct("turn", "print")).alias("first"))
    anywhere = owned.where(F.col("words") >= FAR_WORDS).groupBy(*hashes).agg(F.min(F.struct(*_KEY)).alias("owner"))
    near = quoted.join(here, ["conv", *hashes]).where("first.turn < turn")
    near = near.select(*_KEY, "level", "size", *hashes, F.struct("conv", "first.turn", "first.print").alias("parent"))
    elsewhere = quoted.where(F.col("words") >= FAR_WORDS).join(near.select(*_KEY, "level", *hashes), [*_KEY, "level", *hashes], "left_anti")
    earlier = "owner.conv < conv or (owner.conv = conv and owner.turn < turn)"
    far = elsewhere.join(anywhere, hashes).where(earlier)
    far = far.select(*_KEY, "level", "size", *hashes, F.col("owner").alias("parent"))
    given = near.union(far).groupBy(*_KEY, "level", "parent").agg(F.sum("size").alias("size"))
    best = F.max_by("parent", F.struct(-F.col("level"), "size", "parent"))
    return given.groupBy(*_KEY).agg(best.alias("parent"))


def _previous(keys: DataFrame) -> DataFrame:
    """(key, parent): the message before in the conversation.

    Conversations are cut into buckets of turns, so that a long one is spread
    over many tasks; the first message of a bucket follows the last of the
    bucket before.
    """
    cut = keys.withColumn("bucket", F.floor(F.col("turn") / _BUCKET))
    own = F.struct("conv", "turn", "print")
    inside = Window.partitionBy("conv", "bucket").orderBy("turn", "print")
    local = cut.withColumn("parent", F.lag(own).over(inside))
    last = cut.groupBy("conv", "bucket").agg(F.max(own).alias("last"))
    before = last.select("conv", "bucket", F.lag("last").over(Window.partitionBy("conv").orderBy("bucket")).alias("before"))
    joined = local.join(before, ["conv", "bucket"]).withColumn("parent", F.coalesce("parent", "before"))
    return joined.where("parent is not null").select(*_KEY, "parent")


def _threads(parents: DataFrame) -> DataFrame:
    """(key, root, depth) of every message of (key, parent); a null parent makes a root.  By pointer doubling."""
    own = F.struct(*_KEY)
    state = parents.select(
        own.alias("id"), F.coalesce("parent", own).alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("parent").isNull().alias("done"),
    )
    state = keep(state, "threads")
    for _ in range(_ROUNDS):
        rest = state.where("not done")
        if rest.isEmpty():
            return state.select("id.*", F.col("up").alias("root"), "depth")
        above = state.select(
            F.col("id").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"), F.col("done").alias("top")
        )
        moved = rest.join(above, "up").select(
            "id", F.col("higher").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done")
        )
        state = keep(state.where("done").union(moved), "threads")
    raise RuntimeError("a thread is deeper than 2**60 messages")


def conversations(table: DataFrame) -> DataFrame:
    """The messages of `table` (conv_id, turn, role, text) without quotes, each with its place in a thread.

    (conv_id, turn, role, text, quoted_lines, link, parent_conv, parent_turn,
    thread_conv, thread_turn, depth).  `link` is `quote`, `previous` or `none`;
    a message without a parent starts a thread and has depth 0.  Sorting by
    thread_conv, thread_turn, depth, conv_id, turn puts every message after the
    one it replies to.

    Parents are always earlier: in the same conversation by turn, else by
    conv_id and turn; far ones need a passage of FAR_WORDS words (`words.word_count`).  Messages that
    share conv_id and turn are told apart by a hash of role and text; rows equal
    in all are one message in several rows.  A row with a null conv_id or turn
    is a thread of its own and is not quoted.  A null text stays null and quotes
    nothing.  An empty table gives no rows; other columns are not read.
    """
    raw = table.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64("role", "text").alias("print"), "role", "text",
    ).withColumn("lines", _parsed(F.col("text")))
    named = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    messages = raw.where(named & F.col("text").isNotNull())
    keys = raw.where(named).select(*_KEY).distinct()
    quoting = _quoted_parents(messages).withColumnRenamed("parent", "quoted")
    linked = keys.join(quoting, _KEY, "left").join(_previous(keys), _KEY, "left").select(
        *_KEY, F.coalesce("quoted", "parent").alias("parent"),
        F.when(F.col("quoted").isNotNull(), "quote").when(F.col("parent").isNotNull(), "previous").otherwise("none").alias("link"),
    )
    linked = keep(linked, "replies")
    placed = linked.join(_threads(linked.select(*_KEY, "parent")), _KEY)
    levels = F.coalesce(F.size(F.filter("lines", lambda x: x["level"] > 0)), F.lit(0))
    said = raw.withColumn("quoted_lines", F.greatest(levels, F.lit(0))).select(
        *_KEY, "role", F.when(F.col("quoted_lines") > 0, _own_text(F.col("lines"))).otherwise(F.col("text")).alias("text"), "quoted_lines"
    )
    return said.join(placed, _KEY, "left").select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", "quoted_lines",
        F.coalesce("link", F.lit("none")).alias("link"),
        F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.when(F.col("root").isNull(), F.col("conv")).otherwise(F.col("root.conv")).alias("thread_conv"),
        F.when(F.col("root").isNull(), F.col("turn")).otherwise(F.col("root.turn")).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )
