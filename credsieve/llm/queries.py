"""The registered queries of this subpackage: thin forms of its operators with fixed digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm import (
    ann_forest, byte_bpe, collocations, decontamination, embedding_dedup, language_id, line_dedup, near_dedup, packing,
    quality, quotes, toxicity, whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; profiles come from three quarters of the labelled ones.

    Rows without doc_id count as not held out.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text", "lang")
    learned = language_id.profiles(docs.where("not held_out").select("lang", "text"))
    return language_id.identify(docs.drop("lang"), learned, returned=["doc_id", "held_out"])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of vectors of one label at a cosine of 0.98."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; the model learns from the labels table."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), returned=["doc_id"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from both views; the model learns from the labels table."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on three-word shingles, at a similarity of 0.85."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of line runs, and how many lines it had and lost."""
    return line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its thread, as the conversations table has them."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on up to 16 whitened components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that lie in passages of the benchmark, and the items these are from."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def quoting_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that quote the one before them, which quotes its own predecessor, linked again.

    The quotes are put in front of the texts of the conversations table: every
    turn but the first quotes the turn before, and below that, the one before.
    """
    said = table(spark, sf_dir, "conversations")
    marked = lambda c, sign: F.regexp_replace(c, "(?m)^", sign)
    past = lambda n: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"text_{n}"))
    both = said.join(past(1), ["conv_id", "turn"], "left").join(past(2), ["conv_id", "turn"], "left")
    older = F.when(F.col("text_2").isNotNull(), F.concat(marked("text_2", ">> "), F.lit("\n")))
    quote = F.concat(F.lit("Someone wrote:\n"), F.coalesce(older, F.lit("")), marked("text_1", "> "), F.lit("\n\n"))
    return quotes.conversations(both.withColumn("text", F.concat(F.coalesce(quote, F.lit("")), "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_byte_bpe, op3_embedding_dedup, op4_ann_forest, op5_toxicity, op6_quality,
        op7_near_duplicates, op8_packing, op9_line_dedup,
        op10_quotation_links, op11_whitening, op12_decontamination, op13_collocations, quoting_replies,
    )
}

_LINKED = r"""
with recursive message as (
  select conv_id as conv, turn, role, text, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as raw from {source}
),
marked as (
  select conv, turn, i, raw[i] as line, regexp_extract(raw[i], '^[ \t]*(?:>[ \t]*)*') as marks
  from (select conv, turn, raw, unnest(range(1, len(raw) + 1)) as i from message where text is not null)
),
line as (
  select conv, turn, i, line, length(replace(replace(marks, ' ', ''), chr(9), '')) as level,
    lower(trim(regexp_replace(case when contains(marks, '>') then substring(line, length(marks) + 1) else line end, '\s+', ' ', 'g'))) as said
  from marked
),
part as (
  select conv, turn, level, i, said, i - row_number() over (partition by conv, turn, level order by i) as run from line where said <> ''
),
passage as (
  select conv, turn, level, string_agg(said, ' ' order by i) as said from part group by conv, turn, level, run
  union select conv, turn, level, said from part
),
sized as (select *, length(said) as size, length(said) - length(replace(said, ' ', '')) + 1 as words from passage),
here as (select conv, said, min(turn) as turn from sized where level = 0 group by conv, said),
anywhere as (select said, min({{'c': conv, 't': turn}}) as owner from sized where level = 0 and words >= 8 group by said),
near as (
  select q.conv, q.turn, q.level, q.said, size, {{'c': q.conv, 't': here.turn}} as parent
  from sized q join here on here.conv = q.conv and here.said = q.said where level > 0 and here.turn < q.turn
),
far as (
  select q.conv, q.turn, q.level, q.said, size, owner as parent from sized q join anywhere using (said)
  where level > 0 and words >= 8 and owner < {{'c': q.conv, 't': q.turn}}
    and not exists (select 1 from near n where n.conv = q.conv and n.turn = q.turn and n.level = q.level and n.said = q.said)
),
given as (
  select conv, turn, level, parent, sum(size) as size from (select * from near union all select * from far) group by all
),
best as (select conv, turn, arg_max(parent, {{'l': -level, 's': size, 'p': parent}}) as parent from given group by conv, turn),
reply as (
  select m.conv, m.turn, best.parent as quoted,
    lag({{'c': m.conv, 't': m.turn}}) over (partition by m.conv order by m.turn) as previous
  from message m left join best on best.conv = m.conv and best.turn = m.turn
),
linked as (
  select conv, turn, coalesce(quoted, previous) as parent,
    case when quoted is not null then 'quote' when previous is not null then 'previous' else 'none' end as link from reply
),
thread(conv, turn, root, depth) as (
  select conv, turn, {{'c': conv, 't': turn}}, 0 from linked where parent is null
  union all
  select l.conv, l.turn, t.root, t.depth + 1 from thread t join linked l on l.parent = {{'c': t.conv, 't': t.turn}}
),
next as (select *, lead(level, 1, 0) over (partition by conv, turn order by i) as after from line),
own as (
  select conv, turn, count(*) filter (level > 0) as quoted_lines, coalesce(trim(string_agg(line, chr(10) order by i) filter (
    level = 0 and not (after > 0 and regexp_matches(line, '(?i)^.{{0,300}}\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$'))
  ), ' ' || chr(9) || chr(13) || chr(10)), '') as text from next group by conv, turn
)
select m.conv as conv_id, m.turn, role, case when quoted_lines > 0 then own.text else m.text end as text,
  coalesce(quoted_lines, 0)::integer as quoted_lines, link, parent.c as parent_conv, parent.t as parent_turn,
  root.c as thread_conv, root.t as thread_turn, depth::bigint as depth
from message m join linked l on l.conv = m.conv and l.turn = m.turn join thread t on t.conv = m.conv and t.turn = m.turn
  left join own on own.conv = m.conv and own.turn = m.turn
"""

_REPLIES = r"""(
  select c.conv_id, c.turn, c.role, coalesce('Someone wrote:' || chr(10)
    || coalesce(regexp_replace(b.text, '(?m)^', '>> ', 'g') || chr(10), '')
    || regexp_replace(a.text, '(?m)^', '> ', 'g') || chr(10) || chr(10), '') || c.text as text
  from conversations c left join conversations a on a.conv_id = c.conv_id and a.turn + 1 = c.turn
    left join conversations b on b.conv_id = c.conv_id and b.turn + 2 = c.turn
)"""

CHECKS = {
    # All links by comparing every pair of a label, then what they reach.
    "op3_embedding_dedup": """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
unit as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as length from good),
link as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.98
),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b),
least as (select a, min(b) as b from reach group by a),
counted as (select a, count(*) as n from link group by a)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(least.b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(least.b, e.vec_id)) as kept
from embeddings e left join counted on counted.a = e.vec_id left join least on least.a = e.vec_id
""",
    # All pairs that share a shingle, then what the links reach.
    "op7_near_duplicates": """
with recursive worded as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
),
shingle as (
  select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
  from worded where len(w) > 0
),
size as (select doc_id, count(*) as n from shingle group by doc_id),
met as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from shingle x join shingle y on x.s = y.s and x.doc_id <> y.doc_id group by all
),
link as (
  select a, b from met join size p on p.doc_id = a join size q on q.doc_id = b where 100 * met.n >= 85 * (p.n + q.n - met.n)
),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b),
least as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(least.b, d.doc_id)) as kept
from documents d left join size on size.doc_id = d.doc_id left join least on least.a = d.doc_id
""",
    # The shortest runs of ten words from and up to every line, as text, and the first place of each.
    "op9_line_dedup": """
with split as (
  select doc_id, string_split(text, chr(10)) as raw from documents where text is not null
),
bare as (select doc_id, raw, list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(13))) as bare from split),
line as (
  select doc_id, i, words, sum(words) over (partition by doc_id order by i) as upto from (
    select doc_id, i, case when bare[i] = '' then 0 else length(bare[i]) - length(replace(bare[i], ' ', '')) + 1 end as words
    from (select doc_id, bare, unnest(range(1, len(bare) + 1)) as i from bare)
  )
),
run as (
  select a.doc_id, a.i as first, min(b.i) as last from line a join line b on a.doc_id = b.doc_id and b.i >= a.i
    and b.upto - (a.upto - a.words) >= 10 group by all
  union
  select b.doc_id, max(a.i) as first, b.i as last from line a join line b on a.doc_id = b.doc_id and b.i >= a.i
    and b.upto - (a.upto - a.words) >= 10 group by b.doc_id, b.i
),
held as (
  select run.doc_id, first, last, last - first as length, array_to_string(bare[first:last], chr(10)) as content
  from run join bare on bare.doc_id = run.doc_id
),
later as (
  select doc_id, first, last from (
    select *, min({'d': doc_id, 'f': first}) over (partition by length, content) as origin from held
  ) where {'d': doc_id, 'f': first} > origin
),
gone as (select distinct doc_id, unnest(range(first, last + 1)) as i from later),
kept as (
  select doc_id, string_agg(piece, chr(10) order by i) as text from (
    select b.doc_id, b.raw[b.i] as piece, b.i from (select doc_id, raw, unnest(range(1, len(raw) + 1)) as i from bare) b
    left join gone on gone.doc_id = b.doc_id and gone.i = b.i where gone.i is null
  ) group by doc_id
),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, case when d.text is not null then coalesce(kept.text, '') end as text,
  coalesce(len(raw), 0)::integer as n_lines, coalesce(lost.n, 0)::integer as n_deleted
from documents d left join bare on bare.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
  left join lost on lost.doc_id = d.doc_id
""",
    # Every window of an item against every window of a document, as text.
    "op12_decontamination": """
with folded as (
  select 'd' as side, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
  union all
  select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
),
worded as (select side, id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from folded),
wanted as (
  select distinct id as item, least(len(w), 10) as size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as said
  from worded where side = 'b' and len(w) > 0
),
sizes as (select distinct size from wanted),
here as (
  select id, size, i, array_to_string(w[i:i + size - 1], ' ') as said
  from (select id, w, size, unnest(range(1, len(w) - size + 2)) as i from worded cross join sizes where side = 'd' and len(w) >= size)
),
met as (select id, i, here.size, item from here join wanted on here.size = wanted.size and here.said = wanted.said),
word as (select distinct id, unnest(range(i, i + size)) as i from (select distinct id, i, size from met)),
hit as (select id, count(*) as n from word group by id),
listed as (
  select id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct id, item::varchar as item from met) group by id
)
select d.id as doc_id, len(d.w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(listed.n, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from worded d left join hit on hit.id = d.id left join listed on listed.id = d.id where side = 'd'
""",
    # All phrases as text, counted, cut and compared.
    "op13_collocations": """
with worded as (
  select coalesce(lang, 'und') as lang, doc_id, part, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (
    select lang, doc_id, unnest(range(len(pieces))) as part, unnest(pieces) as piece from (
      select lang, doc_id, regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as pieces
      from documents
    )
  )
),
whole as (select lang, sum(len(w))::bigint as n from worded group by lang having n > 0),
counted as (
  select lang, said, len(said) as size, count(*) as f from (
    select lang, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) as said
    from worded cross join (select unnest([1, 2, 3, 4]) as size) where len(w) >= size
  ) group by all having f >= 30
),
candidate as (select * from counted where size > 1),
cut as (
  select c.lang, c.said, c.f as a, k, x.f as l, y.f as r, (2000000::hugeint * c.f // (x.f + y.f))::bigint as score
  from (select *, unnest(range(1, size)) as k from candidate) c
    join counted x on x.lang = c.lang and x.said = c.said[1:k] join counted y on y.lang = c.lang and y.said = c.said[k + 1:]
),
best as (select lang, said, a, arg_min({'l': l, 'r': r, 's': score}, {'s': score, 'k': k}) as best from cut group by lang, said, a),
inside as (
  select lang, said[i:i + m - 1] as said, max(f) as most
  from (select lang, said, f, m, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from candidate))
  group by all
),
ranked as (
  select best.lang, array_to_string(best.said, ' ') as phrase, a, best.l, best.r, best.s as score,
    row_number() over (partition by best.lang order by best.s desc, a desc, array_to_string(best.said, ' ')) as rank
  from best left join inside on inside.lang = best.lang and inside.said = best.said where most is null or 100 * most < 80 * a
)
select lang, rank, phrase, a, l, r, n, score from ranked join whole using (lang) where rank <= 2000
""",
    # Quote levels by a regular expression, passages by their text, threads from their roots on.
    "op10_quotation_links": _LINKED.format(source="conversations"),
    "quoting_replies": _LINKED.format(source=_REPLIES),
}
