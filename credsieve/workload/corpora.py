"""Inputs derived from the stored tables.

The stored texts hold hardly any credentials, so the workload plants invented
ones: every document gets a line before and a line after its text, each with a
token made from hashes of the document id.  The SQL fragments below mean the
same in Spark and in DuckDB, which lets the checks build the same inputs.  The
fixed parts of the tokens are joined from pieces so that this file itself holds
nothing that looks like a credential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.session import spread

FILES_PER_REPO = 25


def _hex(tag: str) -> str:
    return f"md5(concat('{tag}', cast(doc_id as string)))"


def _mixed(tag: str, letters: str) -> str:
    return f"translate({_hex(tag)}, '0123456789abcdef', '{letters}')"


def token_sql(kind: str, tag: str) -> str:
    """SQL CASE that builds a token of one of the 24 kinds for each document."""
    h1, h2 = _hex(tag + "p"), _hex(tag + "q")
    m1 = _mixed(tag + "r", "GhIjKlMnOpQrStUv")
    m2 = _mixed(tag + "s", "aBcDeFgHwXyZ0123")
    m3 = _mixed(tag + "t", "4567890PqRsTuVwX")
    kinds = [
        f"concat('AK', 'IA', upper(substr({h1}, 1, 16)))",
        f"concat('AWS_Secret_', 'access_key =', chr(10), '  \"', {m1}, substr({h2}, 1, 8), '\"')",
        f"concat('gh', 'p_', {m1}, substr({h2}, 1, 8))",
        f"concat('glp', 'at-', substr({m1}, 1, 20))",
        f"concat('sk_', 'live_', substr({m1}, 1, 28))",
        f"concat('-----BEGIN RSA PRIV', 'ATE KEY-----', chr(10), {m1}, {m2}, chr(10), {m3},"
        f" chr(10), '-----END RSA PRIV', 'ATE KEY-----')",
        f"concat('ey', 'J', substr({m1}, 1, 20), '.', substr({m2}, 1, 24), '.', substr({m3}, 1, 30))",
        f"concat('sk-', 'ant-api03-', {m1}, {m2}, {m3})",
        f"concat('sk-', 'proj-', substr({m1}, 1, 24), 'T3Blb', 'kFJ', substr({m2}, 1, 24))",
        f"concat('hf', '_', {m1}, substr({m2}, 1, 4))",
        f"concat('S', 'G.', substr({m1}, 1, 22), '.', {m2}, substr({m3}, 1, 11))",
        f"concat('AI', 'za', {m1}, substr({m2}, 1, 3))",
        f"concat('xo', 'xb-', substr({h1}, 1, 12), '-', substr({m1}, 1, 24))",
        f"concat('https://hooks.sl', 'ack.com/services/T', upper(substr({h1}, 1, 9)), '/B',"
        f" upper(substr({h2}, 1, 9)), '/', substr({m1}, 1, 24))",
        f"concat('npm', '_', {m1}, substr({m2}, 1, 4))",
        f"concat('pypi-AgEI', 'cHlwaS5vcmc', {m1}, {m2})",
        f"concat('dop', '_v1_', {h1}, {h2})",
        f"concat('S', 'K', {h1})",
        f"concat('ke', 'y-', {m1})",
        f"concat('Account', 'Key=', {m1}, {m2}, substr({m3}, 1, 22), '==')",
        f"concat('postgres://', 'user', cast(doc_id as string), ':', substr({m1}, 1, 12),"
        f" '@db.internal:5432/app')",
        f"concat('M', substr({m1}, 1, 23), '.', substr({m2}, 1, 6), '.', substr({m3}, 1, 27))",
        f"concat(cast(100000000 + doc_id % 900000000 as string), ':', {m1}, substr({m2}, 1, 3))",
        f"concat('sq0', 'atp-', substr({m1}, 1, 22))",
    ]
    cases = " ".join(f"when {i} then {sql}" for i, sql in enumerate(kinds))
    return f"case {kind} {cases} end"


FIRST_TOKEN = token_sql("doc_id % 24", "a")
LAST_TOKEN = token_sql("(doc_id + 11) % 24", "b")
# Some lines are silenced, some hold their token twice.
FIRST_LINE = f"""concat('k ', {FIRST_TOKEN}, ' z',
  case when doc_id % 7 = 3 then concat(' and ', {FIRST_TOKEN}, ' again') else '' end,
  case doc_id % 9 when 4 then ' # secret-scanner: ignore' when 6 then ' // Pragma:  ALLOWLIST Secret'
  else '' end)"""
LAST_LINE = f"concat('k ', {LAST_TOKEN}, ' z')"
CONTENT = f"concat({FIRST_LINE}, chr(10), text, chr(10), {LAST_LINE})"

PATH = """case doc_id % 14
  when 0 then concat('src/app_', cast(doc_id as string), '.py')
  when 1 then concat('tests/a_', cast(doc_id as string), '.py')
  when 2 then concat('lib/x_', cast(doc_id as string), '.min.js')
  when 3 then concat('pkg/vendor/v', cast(doc_id as string), '.go')
  when 4 then concat('conf/d', cast(doc_id as string), '/.env')
  when 5 then concat('img/p_', cast(doc_id as string), '.PNG')
  when 6 then concat('m', cast(doc_id as string), '/go.sum')
  when 7 then concat('web/node_modules/n', cast(doc_id as string), '/i.js')
  when 8 then concat('a/b/test_', cast(doc_id as string), '.py')
  when 9 then concat('docs', chr(92), 'win_', cast(doc_id as string), '.txt')
  when 10 then concat('notes_', cast(doc_id as string), '.md')
  when 11 then concat('data/d_', cast(doc_id as string), '.csv')
  when 12 then concat('dist/b', cast(doc_id as string), '/app.js')
  else concat('.hidden/x', cast(doc_id as string), '.egg-info/PKG') end"""

REPO = f"cast(floor(doc_id / {FILES_PER_REPO}) as bigint)"
FULL_NAME = """case when r % 10 = 7 then concat('bad', cast(r as string))
  when r % 10 = 8 then concat(' org1 / repo', cast(r as string), ' ')
  else concat('org', cast(r % 3 as string), '/repo', cast(r as string)) end"""
LABEL = """case when r % 10 = 7 then concat('bad', cast(r as string))
  when r % 10 = 8 then concat('org1/repo', cast(r as string))
  else concat('org', cast(r % 3 as string), '/repo', cast(r as string)) end"""
DEFAULT_BRANCH = "case r % 4 when 0 then '' when 1 then 'develop' else 'main' end"
BRANCH = "case r % 4 when 1 then 'develop' else 'main' end"
HEAD = f"md5(concat('head', cast(r as string), {BRANCH}))"
BLOB_SHA = "md5(concat('blob', cast(doc_id as string)))"
COMMIT_SHA = "md5(concat('commit', cast(doc_id as string)))"


# Stored tables up to this size come in few splits or one, and are dealt out.
SMALL_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return spread(stored, 16) if int(str(size)) <= SMALL_BYTES else stored


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a planted line before and after, and an invented path."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        F.expr(REPO).alias("r"),
        F.expr(PATH).alias("file_path"),
        F.expr(CONTENT).alias("content"),
    )


def planted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("source").alias("repo"),
        "file_path",
        F.expr(COMMIT_SHA).alias("commit_sha"),
        "content",
    )


def plain_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.expr("concat('doc_', cast(doc_id as string), '.txt')").alias("file_path"),
        F.lit("").alias("commit_sha"),
        F.col("text").alias("content"),
    )


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("repo"),
        F.expr("concat('page_', cast(page_id as string), '.html')").alias("file_path"),
        F.lit("").alias("commit_sha"),
        F.col("html").alias("content"),
    )


def _doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")


def repo_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per invented repository; a repository has 25 documents at most."""
    return _doc_ids(spark, sf_dir).select(F.expr(REPO).alias("r")).distinct()


def repo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed repository records."""
    return repo_numbers(spark, sf_dir).select(
        F.to_json(
            F.struct(
                F.col("r").alias("id"),
                F.expr("concat('repo', cast(r as string))").alias("name"),
                F.expr(FULL_NAME).alias("full_name"),
                F.expr(DEFAULT_BRANCH).alias("default_branch"),
                F.lit("").alias("html_url"),
                F.expr("r % 11 = 5").alias("private"),
            )
        ).alias("payload"),
        (F.lit(1_000_000) - F.col("r")).alias("page_start"),
    )


def branch_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed branch records; some repositories lack theirs."""
    return (
        repo_numbers(spark, sf_dir)
        .where("r % 9 <> 4")
        .select(
            F.expr(LABEL).alias("repo"),
            F.expr(BRANCH).alias("branch"),
            F.to_json(F.struct(F.struct(F.expr(HEAD).alias("sha")).alias("commit"))).alias("payload"),
        )
    )


def tree_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed tree listings of at most 50 items; some are truncated."""
    items = (
        table(spark, sf_dir, "documents")
        .select(
            "doc_id",
            F.expr(REPO).alias("r"),
            F.expr(PATH).alias("path"),
            F.lit("100644").alias("mode"),
            F.expr("case when doc_id % 13 = 3 then 'tree' else 'blob' end").alias("type"),
            F.expr(BLOB_SHA).alias("sha"),
            F.expr("case when doc_id % 17 <> 2 then n_chars end").alias("size"),
        )
        .withColumn(
            "paths",
            F.expr(
                "case when doc_id % 6 = 1 then array(path, concat('copy/', path)) else array(path) end"
            ),
        )
        .withColumn("path", F.explode("paths"))
    )
    item = F.struct("doc_id", "path", "mode", "type", "sha", "size")
    return (
        items.groupBy("r")
        .agg(F.sort_array(F.collect_list(item)).alias("tree"))
        .select(
            F.expr(LABEL).alias("repo"),
            F.expr(HEAD).alias("commit_sha"),
            F.to_json(
                F.struct(
                    F.expr(HEAD).alias("sha"),
                    F.expr("r % 12 = 6").alias("truncated"),
                    F.col("tree"),
                )
            ).alias("payload"),
        )
    )


def blob_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed blobs in base64 with line breaks; some are damaged, few are lost."""
    encoded = F.regexp_replace(F.base64(F.col("content").cast("binary")), "(.{60})", "$1\n")
    damaged = F.expr("substring(encoded, 2)")
    return (
        documents(spark, sf_dir)
        .where("doc_id % 211 <> 5")
        .withColumn("encoded", encoded)
        .select(
            F.expr(LABEL).alias("repo"),
            F.expr(BLOB_SHA).alias("sha"),
            F.to_json(
                F.struct(
                    F.expr("case when doc_id % 23 = 7 then 'none' else 'base64' end").alias("encoding"),
                    F.when(F.expr("doc_id % 19 = 4"), damaged)
                    .otherwise(F.col("encoded"))
                    .alias("content"),
                )
            ).alias("payload"),
        )
    )


def commit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed commit listings, one commit per document; some repositories have none."""
    return (
        _doc_ids(spark, sf_dir)
        .withColumn("r", F.expr(REPO))
        .where("r % 8 <> 5")
        .select(
            F.expr(LABEL).alias("repo"),
            F.expr(BRANCH).alias("branch"),
            F.expr(f"cast(doc_id % {FILES_PER_REPO} as int)").alias("page_start"),
            F.to_json(F.array(F.struct(F.expr(COMMIT_SHA).alias("sha")))).alias("payload"),
        )
    )


def commit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed commits: a patch in two hunks made from each document.

    Of the document every third line is added, every third removed, the others
    are context.  The second hunk adds the planted last line, seven lines below.
    """
    patch = F.expr(
        "concat('diff header', chr(10), '@@ -1,9 +', cast(1 + doc_id % 50 as string), ',9 @@ fn', chr(10),"
        " array_join(transform(split(content, chr(10)), (l, i) -> concat("
        "   case i % 3 when 0 then '+' when 1 then ' ' else '-' end, l)), chr(10)),"
        " chr(10), chr(92), ' No newline at end of file', chr(10),"
        " '@@ -900 +', cast(8 + doc_id % 50 + size(split(content, chr(10))) as string), ' @@', chr(10),"
        f" array_join(transform(split({LAST_LINE}, chr(10)), l -> concat('+', l)), chr(10)))"
    )
    file = F.struct(
        F.expr(PATH).alias("filename"),
        F.lit("modified").alias("status"),
        F.when(F.expr("doc_id % 15 <> 2"), patch).alias("patch"),
    )
    return (
        documents(spark, sf_dir)
        .where("doc_id % 199 <> 9")
        .select(
            F.expr(LABEL).alias("repo"),
            F.expr(COMMIT_SHA).alias("commit_sha"),
            F.to_json(F.struct(F.array(file).alias("files"))).alias("payload"),
        )
    )
