"""Landed service payloads as tables.

A crawler stores each response as one row: some key columns and the JSON text in
``payload``.  The functions here give those rows their types.  Parsing keeps to
the rules of the tables it replaces: list items that are not objects are dropped
and missing optional fields get their defaults.  Nothing else is dropped: a
payload that is not JSON, or not of the expected kind, becomes a row that is not
``valid`` (or, in a repository listing, has an ``error``), so that what it stands
for fails instead of looking empty.

A scan stores the records that it wants once they are parsed: it reads keys and
contents in separate passes, and a columnar table gives each only what it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions import payload as decode

TREE_ITEM = "path string, mode string, type string, sha string, size bigint, url string"
REPO_PAGE_ERROR = "repository listing or record not valid"
# The parser's own limit would make every long text unreadable.
_OPTIONS = "map('maxStringLen', '2147483647')"


def read_payloads(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """JSON-lines landing folder with key columns and a ``payload`` text.

    Without a key column of that name, ``landed_at`` is when the file was
    written: of records that were landed again, later files have the newer state.
    """
    rows = spark.read.schema(f"{keys}, payload string").json(path)
    if "landed_at" in rows.columns:
        return rows
    return rows.select("*", F.col("_metadata.file_modification_time").alias("landed_at"))


def _when_landed(payloads: DataFrame) -> list[str]:
    """The landing time, if the payloads have it."""
    return ["landed_at"] if "landed_at" in payloads.columns else []


def _text(item: str, field: str) -> str:
    """A field as text whatever its JSON type; NULL when absent."""
    return f"try_variant_get({item}, '$.{field}', 'string')"


def _kind(name: str) -> str:
    """What a variant is; text that is no JSON counts as no kind."""
    return f"coalesce(schema_of_variant({name}), '')"


def _parsed(table: DataFrame) -> DataFrame:
    return table.withColumn("parsed", F.expr(f"from_json(payload, 'variant', {_OPTIONS})"))


def _objects(items: Column) -> Column:
    return F.filter(items, lambda v: F.call_function("schema_of_variant", v).startswith("OBJECT"))


def _is_listed(field: str) -> Column:
    """The record is an object and its field a list or absent."""
    kind = f"schema_of_variant(variant_get(parsed, '$.{field}', 'variant'))"
    return F.expr(
        f"coalesce(schema_of_variant(parsed) like 'OBJECT%', false)"
        f" and coalesce({kind} like 'ARRAY%', true)"
    )


def _listed(field: str) -> Column:
    """The objects of a list inside a record.

    An absent list counts as empty; anything that is not a list gives NULL.
    """
    items = F.expr(
        f"if(schema_of_variant(parsed) like 'OBJECT%' and "
        f"   variant_get(parsed, '$.{field}', 'variant') is null, array(), "
        f"   try_variant_get(parsed, '$.{field}', 'array<variant>'))"
    )
    return _objects(items)


def parse_repos(pages: DataFrame, public_only: bool = True) -> DataFrame:
    """Repository listing pages, or single repository records, to ``repos``.

    ``listed_at`` is the place in the listing if the pages have ``page_start``.
    A page that is neither, and a record without a name, is a row with an
    ``error`` and no name.
    """
    first = F.col("page_start") if "page_start" in pages.columns else F.lit(None)
    kind, page = F.expr(_kind("parsed")), F.expr("try_variant_get(parsed, '$', 'array<variant>')")
    found = F.when(kind.startswith("ARRAY"), _objects(page)).otherwise(F.array("parsed"))
    when = _when_landed(pages)
    rows = _parsed(pages).select(first.cast("bigint").alias("first"), *when, F.posexplode_outer(found).alias("at", "item"))
    named = rows.where("at is not null").select(
        F.expr("try_variant_get(item, '$.id', 'bigint')").alias("id"),
        F.expr(_text("item", "name")).alias("name"),
        F.expr(_text("item", "full_name")).alias("full_name"),
        F.expr(f"coalesce({_text('item', 'default_branch')}, '')").alias("default_branch"),
        F.expr(f"coalesce({_text('item', 'html_url')}, '')").alias("html_url"),
        F.expr("coalesce(try_variant_get(item, '$.private', 'boolean'), false)").alias("private"),
        (F.col("first") + F.col("at")).alias("listed_at"),
        *when,
    ).withColumn("error", F.when(F.col("full_name").isNull(), REPO_PAGE_ERROR))
    return named.where(~F.col("private")) if public_only else named


def parse_branches(payloads: DataFrame) -> DataFrame:
    """Branch records; not ``valid`` without the head's ``commit_sha``."""
    sha = F.expr(_text("parsed", "commit.sha")).alias("commit_sha")
    rows = _parsed(payloads).select("repo", "branch", sha, *_when_landed(payloads))
    return rows.withColumn("valid", F.col("commit_sha").isNotNull())


def parse_trees(payloads: DataFrame) -> DataFrame:
    """Recursive tree listings; not ``valid`` when ``tree`` is not a list."""

    def item(v: Column) -> Column:
        def field(name: str, kind: str = "string") -> Column:
            return F.try_variant_get(v, f"$.{name}", kind)

        return F.struct(
            field("path").alias("path"),
            field("mode").alias("mode"),
            field("type").alias("type"),
            field("sha").alias("sha"),
            field("size", "bigint").alias("size"),
            F.nullif(field("url"), F.lit("")).alias("url"),
        )

    return _parsed(payloads).select(
        "repo",
        "commit_sha",
        F.expr(f"coalesce({_text('parsed', 'sha')}, commit_sha)").alias("sha"),
        F.expr("coalesce(try_variant_get(parsed, '$.truncated', 'boolean'), false)").alias(
            "truncated"
        ),
        _is_listed("tree").alias("valid"),
        F.transform(_listed("tree"), item).alias("tree"),
    )


def tree_states(payloads: DataFrame) -> DataFrame:
    """``repo, commit_sha, valid, truncated`` of tree listings, without their items."""
    return _parsed(payloads).select(
        "repo",
        "commit_sha",
        _is_listed("tree").alias("valid"),
        F.expr("coalesce(try_variant_get(parsed, '$.truncated', 'boolean'), false)").alias("truncated"),
    )


def tree_items(payloads: DataFrame) -> DataFrame:
    """``repo, commit_sha, unit_ord, path, type, sha, size``: the items of whole tree listings, one row each.

    The list stays in the parser's own form; its items leave it one by one, as
    rows, and no array of them is built.  A listing that is truncated or not
    valid has no items here.
    """
    whole = _is_listed("tree") & ~F.expr("coalesce(try_variant_get(parsed, '$.truncated', 'boolean'), false)")
    lists = _parsed(payloads).select(
        "repo", "commit_sha", F.when(whole, F.expr("variant_get(parsed, '$.tree', 'variant')")).alias("listed")
    )
    items = lists.lateralJoin(payloads.sparkSession.tvf.variant_explode(F.col("listed").outer()))
    field = lambda name, kind="string": F.try_variant_get("value", f"$.{name}", kind).alias(name)
    return items.where(F.call_function("schema_of_variant", F.col("value")).startswith("OBJECT")).select(
        "repo", "commit_sha", F.col("pos").alias("unit_ord"), field("path"), field("type"), field("sha"), field("size", "bigint")
    )


def parse_blobs(payloads: DataFrame) -> DataFrame:
    """Blob records to text; ``content`` is NULL for what cannot be scanned.

    A record that is no JSON object is not ``valid``: of that nothing is known.
    """
    is_text = F.expr("schema_of_variant(variant_get(parsed, '$.content', 'variant'))") == "STRING"
    content = F.when(is_text, F.expr(_text("parsed", "content")))
    return _parsed(payloads).select(
        "repo",
        "sha",
        decode.blob_text(F.expr(_text("parsed", "encoding")), content).alias("content"),
        F.expr(f"{_kind('parsed')} like 'OBJECT%'").alias("valid"),
    )


def parsed_late(payloads: DataFrame, parse: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """``parse(payloads)`` whose columns other than the keys stay behind every filter and join of ``payloads``.

    The planner moves conditions on parsed columns ahead of joins, and with them
    the parsing of rows that the join would have dropped; it does not move them
    past a generator.
    """
    rows = parse(payloads)
    others = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, F.inline(F.array(F.struct(*others))))


def parse_commits(pages: DataFrame) -> DataFrame:
    """Commit listing pages, newest first, to one row per commit with its position.

    An empty page, and one that is no list, is one row without a commit; the
    latter is not ``valid``, nor is a commit without a hash.
    """
    # what is no object is dropped, but has its place in the listing
    placed = F.transform(F.expr("try_variant_get(parsed, '$', 'array<variant>')"), lambda v, i: F.struct(i.alias("at"), v.alias("item")))
    found = F.filter(placed, lambda x: F.call_function("schema_of_variant", x["item"]).startswith("OBJECT"))
    first = F.coalesce(F.col("page_start"), F.lit(0))
    is_list = F.expr(f"{_kind('parsed')} like 'ARRAY%'")
    rows = _parsed(pages).select(
        "repo", "branch", first.alias("first"), is_list.alias("is_list"), F.inline_outer(found)
    )
    sha = F.expr(_text("item", "sha"))
    return rows.select(
        "repo",
        "branch",
        (F.col("first") + F.col("at")).cast("int").alias("pos"),
        sha.alias("commit_sha"),
        (F.col("is_list") & (F.col("at").isNull() | sha.isNotNull())).alias("valid"),
    )


def parse_commit_files(payloads: DataFrame) -> DataFrame:
    """Commit records; not ``valid`` when ``files`` is not a list."""

    def item(v: Column) -> Column:
        # Only a JSON string is a patch; numbers and lists are not.
        patch = F.try_variant_get(v, "$.patch", "variant")
        is_text = F.call_function("schema_of_variant", patch) == "STRING"
        return F.struct(
            F.try_variant_get(v, "$.filename", "string").alias("filename"),
            F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("")).alias("status"),
            F.when(is_text, F.try_variant_get(v, "$.patch", "string")).alias("patch"),
        )

    return _parsed(payloads).select(
        "repo",
        "commit_sha",
        _is_listed("files").alias("valid"),
        F.transform(_listed("files"), item).alias("files"),
    )
