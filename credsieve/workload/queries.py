"""Registered queries, each next to the SQL that states its expected result."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyarrow import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve import session
from credsieve.functions import paths, text
from credsieve.operators import baseline, findings, history, policy, tree
from credsieve.operators.catalogue import (
    DEFAULT_CATALOGUE,
    Signature,
    catalogue_entries,
    catalogue_table,
    load_catalogue,
)
from credsieve.operators.detect import (
    FINDING_COLUMNS,
    DetectOptions,
    EntropyOptions,
    detect,
    entropy_findings,
    is_dotted_namespace,
    is_noise_line,
    is_suppressed,
    regex_findings,
    secret_candidate,
)
from credsieve.plans import jobs
from credsieve.sinks import files as file_sink
from credsieve.sinks import reports
from credsieve.sources import files as file_source
from credsieve.sources import filetree, landed, listing
from credsieve.sources.tables import as_scan_units, load_baseline
from credsieve.streaming import scan as streaming
from credsieve.workload import checks as k
from credsieve.workload import corpora as c

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


def shown(rows: DataFrame, *extra: str) -> DataFrame:
    """The finding columns, entropy rounded for comparison."""
    return rows.withColumn("entropy_score", F.round("entropy_score", 6)).select(
        *FINDING_COLUMNS, *extra
    )


def with_sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


ALL = "SELECT * FROM findings"
COUNTS_BY = "repo, detection_method, pattern_name, confidence"


# --- detection ---------------------------------------------------------------------


@query(
    "entropy_documents",
    with_sql(k.entropy_sql(k.PLAIN), f"SELECT *, {k.FINGERPRINT} AS fingerprint FROM findings"),
)
def entropy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings.with_fingerprint(entropy_findings(c.plain_units(spark, sf_dir)))
    return shown(rows, "fingerprint")


@query("entropy_pages", with_sql(k.entropy_sql(k.PAGES), ALL))
def entropy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(entropy_findings(c.page_units(spark, sf_dir)))


CONVERSATIONS = f"""units AS (SELECT concat('conv/', role) AS repo,
      concat('c', cast(conv_id as string), '_', cast(turn as string)) AS file_path, '' AS commit_sha,
      concat(text, chr(10), 'session = ', {c._mixed('v', 'aBcDeFgHwXyZ0123').replace('doc_id', 'conv_id * 100 + turn')},
        {c._mixed('w', '4567890PqRsTuVwX').replace('doc_id', 'conv_id * 100 + turn')}) AS content
      FROM conversations)"""


@query("entropy_conversations", with_sql(k.entropy_sql(CONVERSATIONS), ALL))
def entropy_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "conv_id * 100 + turn"
    token = [
        c._mixed(tag, letters).replace("doc_id", key)
        for tag, letters in (("v", "aBcDeFgHwXyZ0123"), ("w", "4567890PqRsTuVwX"))
    ]
    units = as_scan_units(
        c.table(spark, sf_dir, "conversations"),
        content=F.expr(f"concat(text, chr(10), 'session = ', {token[0]}, {token[1]})"),
        repo=F.expr("concat('conv/', role)"),
        file_path=F.expr("concat('c', cast(conv_id as string), '_', cast(turn as string))"),
    )
    return shown(entropy_findings(units))


@query("signature_findings", with_sql(k.regex_sql(k.PLANTED), ALL))
def signature_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(regex_findings(c.planted_units(spark, sf_dir)))


@query("long_texts", with_sql(k.scan_sql(k.PLANTED), ALL))
def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of more than 2,000 bytes in pieces."""
    return shown(detect(c.planted_units(spark, sf_dir), DetectOptions(cut_chars=1000)))


def _one_signature(name: str) -> tuple[Signature, ...]:
    return tuple(s for s in DEFAULT_CATALOGUE if s.name == name)


@query(
    "multiline_private_keys",
    with_sql(k.regex_sql(k.PLANTED, _one_signature("PEM private key")), ALL),
)
def multiline_private_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = c.planted_units(spark, sf_dir)
    return shown(regex_findings(units, _one_signature("PEM private key")))


@query(
    "named_group_values",
    with_sql(k.regex_sql(k.PLANTED, _one_signature("AWS secret access key")), ALL),
)
def named_group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = c.planted_units(spark, sf_dir)
    return shown(regex_findings(units, _one_signature("AWS secret access key")))


CUSTOM = (
    Signature("Dotted quad", r"(?:\d{1,3}\.){3}\d{1,3}", "low", "10.0.0.1"),
    Signature("Quoted hex token", r'token = "(?P<secret>[0-9a-f]{40})"', "medium", "token = ..."),
)


@query("custom_catalogue", with_sql(k.regex_sql(k.PLAIN, CUSTOM), ALL))
def custom_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(regex_findings(c.plain_units(spark, sf_dir), CUSTOM))


# As many formats of one shape, so that one pattern of SQL can state what all of them find.
MANY = tuple(
    Signature(f"Key {i}", rf"zk{i:04d}-(?P<secret>[0-9a-f]{{8}})" if i % 2 else rf"\bzk{i:04d}-[0-9a-f]{{8}}", ("high", "medium", "low")[i % 3], "zk")
    for i in range(2000)
)
KEY_LINE = """concat('k zk', lpad(cast(doc_id % 2000 as string), 4, '0'), '-', substr(md5(cast(doc_id as string)), 1, 8), ' zk',
      lpad(cast(doc_id * 7 % 2500 as string), 4, '0'), '-', substr(md5(cast(doc_id + 1 as string)), 1, 8))"""
WITH_KEYS = k.PLAIN.replace("text AS content", f"concat(coalesce(text, ''), chr(10), {KEY_LINE}) AS content")


@query(
    "large_catalogue",
    with_sql(
        f"""{WITH_KEYS}, {k.lines_cte()}, keys AS (
      SELECT {k.UNIT}, line_number, unnest(regexp_extract_all(line, 'zk[0-9]{{4}}-[0-9a-f]{{8}}')) AS m FROM lines
      WHERE NOT regexp_matches(line, {k.quoted(k.DIRECTIVE)})),
    hits AS (SELECT DISTINCT {k.UNIT}, line_number, n, CASE WHEN n % 2 = 1 THEN substr(m, 8) ELSE m END AS value
      FROM (SELECT *, substr(m, 3, 4)::INTEGER AS n FROM keys) WHERE n < 2000),
    {k.findings_cte(f"""SELECT *, {k.entropy('value')} AS h, 'regex' AS detection_method, concat('Key ', n::VARCHAR) AS pattern_name,
      CASE n % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM hits""")}""",
        ALL,
    ),
)
def large_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand signatures, looked up by their literals."""
    content = F.expr(f"concat(coalesce(text, ''), chr(10), {KEY_LINE})")
    units = as_scan_units(
        c.table(spark, sf_dir, "documents"), content=content, repo="source",
        file_path=F.expr("concat('doc_', cast(doc_id as string), '.txt')"),
    )
    return shown(regex_findings(units, MANY))


CATALOGUE_VALUES = ", ".join(
    f"({i}, {k.quoted(s.name)}, {s.group}, {k.quoted(s.confidence)})"
    for i, s in enumerate(DEFAULT_CATALOGUE, start=1)
)


@query(
    "catalogue_coverage",
    with_sql(
        k.regex_sql(k.PLANTED),
        f"""SELECT p.ord, p.name, p.grp, p.confidence, count(f.pattern_name) AS n_findings
        FROM (VALUES {CATALOGUE_VALUES}) AS p(ord, name, grp, confidence)
        LEFT JOIN findings f ON f.pattern_name = p.name GROUP BY ALL""",
    ),
)
def catalogue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (
        regex_findings(c.planted_units(spark, sf_dir))
        .groupBy(F.col("pattern_name").alias("name"))
        .agg(F.count("*").alias("n_findings"))
    )
    return (
        catalogue_table(spark)
        .join(counts, "name", "left")
        .select(
            "ord", "name", "grp", "confidence",
            F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        )
    )


@query("scan_documents", with_sql(k.scan_sql(k.PLANTED), ALL))
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(jobs.scan_units(c.planted_units(spark, sf_dir)))


@query("scan_pages", with_sql(k.scan_sql(k.PAGES), ALL))
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(jobs.scan_units(c.page_units(spark, sf_dir)))


@query(
    "threshold_override",
    with_sql(
        k.entropy_sql(k.PLANTED, threshold=4.0, hex_threshold="(4.0::DOUBLE * (3.0::DOUBLE / 4.7::DOUBLE))"),
        ALL,
    ),
)
def threshold_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = EntropyOptions.with_threshold(4.0)
    return shown(entropy_findings(c.planted_units(spark, sf_dir), options))


@query(
    "minimum_length_override",
    with_sql(k.entropy_sql(k.PLANTED, min_length=36, threshold=4.0), ALL),
)
def minimum_length_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = EntropyOptions(min_length=36, threshold=4.0)
    return shown(entropy_findings(c.planted_units(spark, sf_dir), options))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.documents(spark, sf_dir).select(
        "doc_id", F.posexplode_outer(text.splitlines(F.col("content"))).alias("pos", "line")
    )


@query(
    "suppressed_lines",
    f"""SELECT doc_id, n::INTEGER AS line_number FROM documents,
      unnest(string_split({c.CONTENT}, chr(10))) WITH ORDINALITY AS t(line, n)
      WHERE regexp_matches(line, {k.quoted(k.DIRECTIVE)})""",
)
def suppressed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _document_lines(spark, sf_dir).where(is_suppressed(F.col("line")))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_number"))


NOISY_PAGE = """concat(html, chr(10), 'src="DATA:image/png;Base64,', md5(cast(page_id as string)), '"', chr(10),
  repeat('v=1;', cast(460 + page_id % 90 as int)), chr(10), 'data:image/png ', md5(cast(page_id as string)))"""


@query(
    "noise_lines",
    f"""SELECT page_id, n::INTEGER AS line_number, length(line)::INTEGER AS n_chars FROM pages,
      unnest(string_split({NOISY_PAGE}, chr(10))) WITH ORDINALITY AS t(line, n)
      WHERE {k.noise('line')}""",
)
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.expr(NOISY_PAGE)
    lines = c.table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode_outer(text.splitlines(content)).alias("pos", "line")
    )
    return lines.where(is_noise_line(F.col("line"))).select(
        "page_id",
        (F.col("pos") + 1).alias("line_number"),
        F.char_length("line").alias("n_chars"),
    )


@query(
    "noisy_page_findings",
    with_sql(k.entropy_sql(k.PAGES.replace("html AS content", f"{NOISY_PAGE} AS content")), ALL),
)
def noisy_page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = as_scan_units(
        c.table(spark, sf_dir, "pages"),
        content=F.expr(NOISY_PAGE),
        repo=F.lit("pages"),
        file_path=F.expr("concat('page_', cast(page_id as string), '.html')"),
    )
    return shown(entropy_findings(units))


@query(
    "token_candidates",
    """WITH tokens AS (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z0-9_./+=:-]{21,}')) AS tok FROM pages),
      narrowed AS (SELECT page_id, regexp_extract(trim(tok, '.'), '^[A-Za-z0-9_.-]+[=:](.+)$', 1) AS v,
        trim(tok, '.') AS t FROM tokens),
      candidates AS (SELECT page_id, CASE WHEN length(v) >= 21 THEN v ELSE t END AS candidate FROM narrowed)
    SELECT page_id, sha256(candidate) AS digest, """
    + k.namespace("candidate")
    + """ AS is_namespace, count(*) AS n FROM candidates GROUP BY ALL""",
)
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = f"[{fixed.TOKEN_CHARACTERS}]{{{fixed.TOKEN_RUN_LENGTH},}}"
    tokens = c.table(spark, sf_dir, "pages").select(
        "page_id", F.explode_outer(F.regexp_extract_all("html", F.lit(token), F.lit(0))).alias("tok")
    )
    return (
        tokens.where(F.col("tok").isNotNull())
        .select("page_id", secret_candidate(F.col("tok")).alias("candidate"))
        .withColumn("is_namespace", is_dotted_namespace(F.col("candidate")))
        .groupBy("page_id", F.sha2("candidate", 256).alias("digest"), "is_namespace")
        .agg(F.count("*").alias("n"))
    )


# --- texts with unusual line breaks ----------------------------------------------------

ODD_CONTENT = (
    f"translate({c.CONTENT}, 'xq', concat(chr(13), chr(12)))"
)
ODD_LINES = r"regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


@query(
    "odd_line_breaks",
    f"""WITH odd AS (SELECT doc_id, translate({c.CONTENT}, 'xq', concat(chr(13), chr(12))) AS content FROM documents),
      split AS (SELECT doc_id, {ODD_LINES} AS l FROM odd)
    SELECT doc_id, len(l)::INTEGER AS n_lines, list_max(list_transform(l, lambda x: length(x)))::INTEGER AS longest,
      md5(l[len(l)]) AS last_line FROM split""",
)
def odd_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        c.table(spark, sf_dir, "documents")
        .select("doc_id", F.expr(ODD_CONTENT).alias("content"))
        .select("doc_id", text.splitlines(F.col("content")).alias("l"))
    )
    return lines.select(
        "doc_id",
        F.size("l").alias("n_lines"),
        F.array_max(F.transform("l", F.char_length)).alias("longest"),
        F.md5(F.element_at("l", -1)).alias("last_line"),
    )


@query(
    "universal_newlines",
    """SELECT doc_id, md5(regexp_replace(replace(text, chr(10), concat(chr(13), chr(10))),
      concat(chr(13), chr(10), '?'), chr(10), 'g')) AS digest FROM documents""",
)
def universal_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return c.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.universal_newlines(crlf)).alias("digest")
    )


# --- functions -----------------------------------------------------------------------


@query(
    "redaction",
    f"""SELECT doc_id, md5({k.redacted('text')}) AS digest, length({k.redacted('text')})::INTEGER AS n,
      {k.redacted('lang')} AS lang FROM documents""",
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = text.redact(F.col("text"))
    return c.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(hidden).alias("digest"),
        F.char_length(hidden).alias("n"),
        text.redact(F.col("lang")).alias("lang"),
    )


@query(
    "text_entropy",
    f"SELECT conv_id, turn, round({k.entropy('text')}, 6) AS bits FROM conversations",
)
def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.round(text.shannon_entropy(F.col("text")), 6).alias("bits")
    )


# --- paths and names ---------------------------------------------------------------------


@query(
    "excluded_paths",
    f"""SELECT doc_id, path, {k.any_glob('path', fixed.DEFAULT_EXCLUDES + ('docs/*', '*.cs[uv]', 'src/app_[!1]*.p?'))} AS excluded
      FROM (SELECT doc_id, {c.PATH} AS path FROM documents)""",
)
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = fixed.DEFAULT_EXCLUDES + paths.glob_list("docs/*, *.cs[uv] ,, src/app_[!1]*.p?")
    return c.documents(spark, sf_dir).select(
        "doc_id",
        F.col("file_path").alias("path"),
        paths.matches_any_glob(F.col("file_path"), globs).alias("excluded"),
    )


@query(
    "entropy_excluded_paths",
    f"""SELECT doc_id, path, {k.entropy_excluded('path')} AS excluded
      FROM (SELECT doc_id, {c.PATH} AS path FROM documents)""",
)
def entropy_excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.documents(spark, sf_dir).select(
        "doc_id",
        F.col("file_path").alias("path"),
        paths.entropy_excluded(F.col("file_path")).alias("excluded"),
    )


PRUNED = ", ".join(k.quoted(d) for d in fixed.PRUNED_DIRECTORIES)


@query(
    "pruned_directories",
    f"""WITH p AS (SELECT doc_id, {c.PATH} AS path FROM documents)
    SELECT doc_id, path FROM p WHERE len(list_filter(string_split(path, '/')[:-2],
      lambda d: d IN ({PRUNED}) OR ends_with(d, '.egg-info'))) > 0""",
)
def pruned_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = c.documents(spark, sf_dir).select("doc_id", F.col("file_path").alias("path"))
    return named.where(paths.in_pruned_directory(F.col("path")))


@query(
    "walk_order_keys",
    f"""WITH p AS (SELECT doc_id, string_split({c.PATH}, '/') AS parts FROM documents)
    SELECT doc_id, array_to_string(list_transform(parts,
      lambda d, i: concat(CASE WHEN i = len(parts) THEN '0' ELSE '1' END, d)), '/') AS sort_key FROM p""",
)
def walk_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = paths.walk_order(F.col("file_path"))
    return c.documents(spark, sf_dir).select("doc_id", F.array_join(keys, "/").alias("sort_key"))


@query(
    "size_cap",
    """SELECT doc_id FROM documents WHERE doc_id % 5 = 1 OR octet_length(encode(text)) <= 2000""",
)
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.expr("doc_id % 5 <> 1"), F.octet_length("text"))
    return (
        c.table(spark, sf_dir, "documents").where(paths.within_size(size, 2000)).select("doc_id")
    )


RAW_GLOBS = "concat(' *.', lang, ' ,,', source, '/*,  ', chr(9), 'n', cast(doc_id as string), chr(10), ' , ')"


@query(
    "exclude_lists",
    f"""WITH g AS (SELECT doc_id, list_filter(list_transform(string_split({RAW_GLOBS}, ','),
        lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS globs FROM documents)
    SELECT doc_id, len(globs)::INTEGER AS n, array_to_string(globs, ';') AS globs FROM g""",
)
def exclude_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = paths.parse_globs(F.expr(RAW_GLOBS))
    return c.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(globs).alias("n"), F.array_join(globs, ";").alias("globs")
    )


POLICY = """case when r % 3 = 0 then 'src/*, *.md' when r % 3 = 1 then '  ,data/*' end"""


@query(
    "repository_policies",
    f"""WITH d AS (SELECT doc_id, {c.REPO} AS r, {c.PATH} AS path FROM documents)
    SELECT {c.LABEL} AS repo, path AS file_path FROM d WHERE NOT (
      (r % 3 = 0 AND {k.any_glob('path', ('src/*', '*.md'))}) OR (r % 3 = 1 AND {k.any_glob('path', ('data/*',))}))""",
)
def repository_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = c.documents(spark, sf_dir).select(F.expr(c.LABEL).alias("repo"), "file_path")
    policies = c.repo_numbers(spark, sf_dir).select(
        F.expr(c.LABEL).alias("repo"), F.expr(POLICY).alias("excludes")
    )
    return policy.apply_policy(files, policies)


# 1,000 globs for each of most repositories, of all kinds; `m` numbers them, `d` is the document they are made of.
GLOB = """case m % 8
  when 0 then concat('app_', d, '.py')
  when 1 then concat('tests/a_', d, case when r % 2 = 0 then '.py' else '' end)
  when 2 then concat('*_', d, '.min.js')
  when 3 then concat('pkg/vendor/v', d, '*')
  when 4 then concat('m', d, '/go.[rst]um')
  when 5 then concat('*', d, '.md')
  when 6 then concat('win_', d, '.*')
  else concat('*/n', d, '/?.js') end"""
GLOB_DOCUMENT = f"cast(r * {c.FILES_PER_REPO} + cast(floor(m / 8) as bigint) as string)"


@query(
    "glob_tables",
    f"""WITH d AS (SELECT {c.REPO} AS r, {c.PATH} AS path FROM documents),
    n AS (SELECT r, m, {GLOB_DOCUMENT} AS d FROM (SELECT DISTINCT r FROM d WHERE r % 4 <> 3), range(1000) AS t(m)),
    g AS (SELECT r, {GLOB} AS glob FROM n),
    f AS (SELECT r, path, replace(path, chr(92), '/') AS clean FROM d)
    SELECT {c.LABEL} AS repo, path AS file_path FROM f WHERE NOT EXISTS (SELECT 1 FROM g
      WHERE g.r = f.r AND (f.clean GLOB g.glob OR {k.base('f.clean')} GLOB g.glob))""",
)
def glob_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = c.documents(spark, sf_dir).select(F.expr(c.LABEL).alias("repo"), "file_path")
    # a few numbers become very many globs, so they are dealt out before that
    repos = session.spread(c.repo_numbers(spark, sf_dir).where("r % 4 <> 3"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = repos.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(999))))
    globs = numbered.withColumn("d", F.expr(GLOB_DOCUMENT)).select(F.expr(c.LABEL).alias("repo"), F.expr(GLOB).alias("glob"))
    return policy.apply_policy(files, globs)


@query(
    "repository_names",
    f"""SELECT full_name, len(p) = 2 AND p[1] <> '' AND coalesce(p[2], '') <> '' AS valid,
        array_to_string(p, '/') AS label
      FROM (SELECT full_name, list_transform(string_split(full_name, '/'), lambda x: trim(x)) AS p
        FROM (SELECT DISTINCT {c.FULL_NAME} AS full_name FROM (SELECT {c.REPO} AS r FROM documents)
          UNION ALL SELECT concat(c_name, '/', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '/x' ELSE '' END)
          FROM customer))""",
)
def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        c.repo_numbers(spark, sf_dir)
        .select(F.expr(c.FULL_NAME).alias("full_name"))
        .distinct()
        .unionByName(
            c.table(spark, sf_dir, "customer").select(
                F.expr(
                    "concat(c_name, '/', c_mktsegment, case when c_custkey % 2 = 0 then '/x' else '' end)"
                ).alias("full_name")
            )
        )
    )
    return names.select(
        "full_name",
        paths.valid_repo_name(F.col("full_name")).alias("valid"),
        paths.repo_label(F.col("full_name")).alias("label"),
    )


@query(
    "target_branches",
    f"""SELECT {c.FULL_NAME} AS full_name, {c.BRANCH} AS branch, 'release' AS chosen
      FROM (SELECT DISTINCT {c.REPO} AS r FROM documents)""",
)
def target_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = F.expr(c.DEFAULT_BRANCH)
    return c.repo_numbers(spark, sf_dir).select(
        F.expr(c.FULL_NAME).alias("full_name"),
        paths.target_branch(default).alias("branch"),
        paths.target_branch(default, "release").alias("chosen"),
    )


# --- baselines, severity, counts -------------------------------------------------------


def _planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.scan_units(c.planted_units(spark, sf_dir))


@query(
    "baseline_snapshot",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"""SELECT DISTINCT {k.FINGERPRINT} AS fingerprint, repo, file_path, pattern_name FROM findings""",
    ),
)
def baseline_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.take_snapshot(_planted_findings(spark, sf_dir))


@query(
    "baseline_suppression",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"""SELECT *, {k.FINGERPRINT} AS fingerprint FROM findings
        WHERE {k.FINGERPRINT} NOT IN (SELECT {k.FINGERPRINT} FROM findings WHERE confidence = 'medium')""",
    ),
)
def baseline_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = session.keep(_planted_findings(spark, sf_dir), "findings")
    accepted = baseline.snapshot(scanned.where(F.col("confidence") == "medium"))
    return shown(baseline.unaccepted(scanned, accepted), "fingerprint")


@query(
    "baseline_round_trip",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"""SELECT *, {k.FINGERPRINT} AS fingerprint FROM findings
        WHERE {k.FINGERPRINT} NOT IN (SELECT {k.FINGERPRINT} FROM findings WHERE line_number = 1)""",
    ),
)
def baseline_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline written by one scan and read by the next."""
    scanned = session.keep(_planted_findings(spark, sf_dir), "findings")
    folder = session.work_folder(spark, "baseline")
    reports.write_baseline(scanned.where(F.col("line_number") == 1), folder)
    return shown(baseline.unaccepted(scanned, load_baseline(spark, folder)), "fingerprint")


@query(
    "severity_filter",
    with_sql(k.scan_sql(k.PLANTED), "SELECT * FROM findings WHERE confidence IN ('high')"),
)
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(jobs.finish(_planted_findings(spark, sf_dir), severity="high"))


@query(
    "finding_summary",
    with_sql(
        k.scan_sql(k.PLANTED),
        """SELECT count(*) AS n_findings, concat(count(*)::VARCHAR, ' potential secrets found.') AS summary
        FROM findings""",
    ),
)
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(_planted_findings(spark, sf_dir))


# --- history -----------------------------------------------------------------------------


def _commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.parse_commit_files(c.commit_payloads(spark, sf_dir))


@query(
    "added_lines",
    with_sql(
        k.PATCH_LINES,
        """SELECT commit_sha, line_number::BIGINT AS line_number, md5(line) AS digest
        FROM added JOIN patch_docs USING (doc_id) WHERE doc_id % 199 <> 9 AND doc_id % 15 <> 2""",
    ),
)
def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = _commit_files(spark, sf_dir).select("commit_sha", F.explode_outer("files.patch").alias("patch"))
    sparse = history.added_lines(patches)
    rows = sparse.select(
        "commit_sha", F.inline(F.arrays_zip("line_nos", F.split("content", "\n", -1).alias("line")))
    )
    return rows.select(
        "commit_sha", F.col("line_nos").alias("line_number"), F.md5("line").alias("digest")
    )


@query(
    "newest_commits",
    with_sql(
        k.REPOS.replace(" WHERE r % 11 <> 5", ""),
        f"""SELECT r.repo, r.branch, (doc_id % 25)::INTEGER AS pos, d.commit_sha FROM repos r JOIN (
          SELECT doc_id, {c.REPO} AS r, {c.COMMIT_SHA} AS commit_sha FROM documents) d ON d.r = r.r
        WHERE r.r % 8 <> 5 QUALIFY row_number() OVER (PARTITION BY r.repo, r.branch ORDER BY doc_id % 25) <= 7""",
    ),
)
def newest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = landed.parse_commits(c.commit_pages(spark, sf_dir))
    return history.newest_commits(commits, 7).select("repo", "branch", "pos", "commit_sha")


def _histories(spark: SparkSession, sf_dir: str) -> jobs.ScanResult:
    return jobs.scan_histories(
        landed.parse_repos(c.repo_pages(spark, sf_dir)),
        landed.parse_commits(c.commit_pages(spark, sf_dir)),
        _commit_files(spark, sf_dir),
    )


@query("history_findings", with_sql(k.history_sql(), ALL))
def history_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_histories(spark, sf_dir).findings)


HISTORY_FAILURES = """SELECT repo, branch, error FROM history_state WHERE error IS NOT NULL
    UNION ALL SELECT repo, branch, 'commit record not found or not valid' FROM history_lost"""


@query(
    "history_failures",
    with_sql(
        ",\n".join([k.REPOS, k.HISTORY_STATE, k.PATCH_LINES, k.HISTORY_UNITS]), HISTORY_FAILURES
    ),
)
def history_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histories(spark, sf_dir).failures


# --- trees ---------------------------------------------------------------------------------


def _trees(spark: SparkSession, sf_dir: str) -> jobs.ScanResult:
    return jobs.scan_trees(
        landed.parse_repos(c.repo_pages(spark, sf_dir)),
        landed.parse_branches(c.branch_payloads(spark, sf_dir)),
        landed.parse_trees(c.tree_payloads(spark, sf_dir)),
        landed.parse_blobs(c.blob_payloads(spark, sf_dir)),
    )


@query(
    "blob_texts",
    f"""SELECT {k.c.BLOB_SHA} AS sha,
      CASE WHEN doc_id % 23 <> 7 AND doc_id % 19 <> 4 THEN md5({c.CONTENT}) END AS digest
      FROM documents WHERE doc_id % 211 <> 5""",
)
def blob_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = landed.parse_blobs(c.blob_payloads(spark, sf_dir))
    return blobs.select("sha", F.md5("content").alias("digest"))


@query(
    "unscanned_blobs",
    f"""SELECT {c.LABEL} AS repo, count(*) AS n_blobs,
        count(*) FILTER (doc_id % 23 = 7 OR doc_id % 19 = 4) AS n_unscanned
      FROM (SELECT *, {c.REPO} AS r FROM documents) WHERE doc_id % 211 <> 5 GROUP BY ALL""",
)
def unscanned_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.unscanned_blobs(landed.parse_blobs(c.blob_payloads(spark, sf_dir)))


@query(
    "repository_listing",
    f"""SELECT r AS id, concat('repo', cast(r as string)) AS name, {c.FULL_NAME} AS full_name,
      {c.DEFAULT_BRANCH} AS default_branch, '' AS html_url, false AS private
      FROM (SELECT DISTINCT {c.REPO} AS r FROM documents) WHERE r % 11 <> 5""",
)
def repository_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = landed.parse_repos(c.repo_pages(spark, sf_dir)).where("error is null")
    return known.drop("error", "listed_at")


@query(
    "branch_heads",
    f"""SELECT {c.LABEL} AS repo, {c.BRANCH} AS branch, {c.HEAD} AS commit_sha
      FROM (SELECT DISTINCT {c.REPO} AS r FROM documents) WHERE r % 9 <> 4""",
)
def branch_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.parse_branches(c.branch_payloads(spark, sf_dir)).where("valid").drop("valid")


@query(
    "tree_items",
    f"""WITH d AS (SELECT *, {c.REPO} AS r, {c.PATH} AS path FROM documents)
    SELECT {c.LABEL} AS repo, r % 12 = 6 AS truncated, p.path AS path,
      CASE WHEN doc_id % 13 = 3 THEN 'tree' ELSE 'blob' END AS type, {c.BLOB_SHA} AS sha,
      CASE WHEN doc_id % 17 <> 2 THEN n_chars END AS size
    FROM d, unnest(CASE WHEN doc_id % 6 = 1 THEN [d.path, concat('copy/', d.path)] ELSE [d.path] END) AS p(path)""",
)
def tree_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = landed.parse_trees(c.tree_payloads(spark, sf_dir))
    items = trees.select("repo", "truncated", F.inline_outer("tree"))
    return items.where(F.col("path").isNotNull()).select(
        "repo", "truncated", "path", "type", "sha", "size"
    )


TREE_SCAN = ",\n    ".join(
    [k.TREE_UNITS, k.lines_cte(), k.regex_cte(), k.entropy_cte(), k.findings_cte(k.BOTH)]
)


@query(
    "one_repository",
    with_sql(TREE_SCAN, "SELECT * FROM findings WHERE repo = 'org1/repo1'"),
)
def one_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = landed.parse_repos(c.repo_pages(spark, sf_dir), public_only=False)
    result = jobs.scan_trees(
        tree.one_repo(repos, " org1 / repo1 "),
        landed.parse_branches(c.branch_payloads(spark, sf_dir)),
        landed.parse_trees(c.tree_payloads(spark, sf_dir)),
        landed.parse_blobs(c.blob_payloads(spark, sf_dir)),
    )
    return shown(result.findings)


@query("tree_scan_findings", with_sql(TREE_SCAN, ALL))
def tree_scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_trees(spark, sf_dir).findings)


TREE_FAILURES = """SELECT repo, branch, error FROM tree_state WHERE error IS NOT NULL
    UNION ALL SELECT repo, branch, 'blob not found or not valid' FROM lost"""


@query(
    "tree_scan_failures",
    with_sql(",\n".join([k.REPOS, k.TREE_STATE, k.TREE_FILES]), TREE_FAILURES),
)
def tree_scan_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir).failures


@query(
    "branch_override_failures",
    with_sql(
        k.REPOS,
        f"""SELECT repo, 'develop' AS branch, CASE WHEN r % 10 = 7 THEN {k.quoted(fixed.BAD_REPO_NAME_ERROR)}
          WHEN r % 4 <> 1 OR r % 9 = 4 THEN 'branch head not found'
          ELSE {k.quoted(fixed.TRUNCATED_TREE_ERROR)} END AS error
        FROM repos WHERE r % 10 = 7 OR r % 4 <> 1 OR r % 9 = 4 OR r % 12 = 6""",
    ),
)
def branch_override_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One branch for all repositories; those without it fail."""
    listed = tree.with_trees(
        tree.with_heads(
            tree.targets(landed.parse_repos(c.repo_pages(spark, sf_dir)), "develop"),
            landed.parse_branches(c.branch_payloads(spark, sf_dir)),
        ),
        landed.parse_trees(c.tree_payloads(spark, sf_dir)),
    )
    return tree.failures_of(listed)


@query(
    "failure_report",
    with_sql(
        ",\n".join([k.REPOS, k.TREE_STATE, k.TREE_FILES]),
        f"""SELECT repo, branch, error, concat('Warning: skipped ', repo, '@', branch, ': ', error) AS message
        FROM ({TREE_FAILURES})""",
    ),
)
def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_rows(_trees(spark, sf_dir).failures)


def _history_ctes() -> str:
    """The history query as a table of its own, to stand next to the tree query."""
    return f"history_findings AS (WITH {k.history_sql()} SELECT * FROM findings)"


@query(
    "tree_and_history",
    with_sql(
        f"tree_findings AS (WITH {TREE_SCAN} SELECT * FROM findings),\n    {_history_ctes()}",
        """SELECT repo, detection_method, pattern_name, confidence, count(*) AS n_findings
        FROM (SELECT * FROM tree_findings UNION ALL SELECT * FROM history_findings) GROUP BY ALL""",
    ),
)
def tree_and_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _trees(spark, sf_dir).union(_histories(spark, sf_dir))
    return both.findings.groupBy(*COUNTS_BY.split(", ")).agg(F.count("*").alias("n_findings"))


@query(
    "gate_status",
    with_sql(
        f"tree_findings AS (WITH {TREE_SCAN} SELECT * FROM findings), "
        f"tree_failures AS (WITH {', '.join([k.REPOS, k.TREE_STATE, k.TREE_FILES])} {TREE_FAILURES})",
        """SELECT n_findings, n_failures, (CASE WHEN n_failures > 0 THEN 2 WHEN n_findings > 0 THEN 3 ELSE 0 END)
          ::INTEGER AS status
        FROM (SELECT count(*) AS n_findings FROM tree_findings WHERE confidence = 'high'),
          (SELECT count(*) AS n_failures FROM tree_failures)""",
    ),
)
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _trees(spark, sf_dir)
    reported = jobs.finish(result.findings, severity="high")
    return findings.gate_status(reported, result.failures, fail_on_findings=True)


# --- folders and streams ------------------------------------------------------------------


def _written_folder(spark: SparkSession, sf_dir: str) -> str:
    """Write every document as a file of its own below the shared work folder."""
    folder = session.work_folder(spark, "folder")
    path = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    files = c.documents(spark, sf_dir).select(
        F.concat("source", F.lit("/"), path).alias("file_path"),
        F.when(F.expr("doc_id % 29 = 3"), F.concat(F.unhex(F.lit("FFFE")), F.col("content").cast("binary")))
        .otherwise(F.replace("content", F.lit("\n"), F.lit("\r\n")).cast("binary"))
        .alias("data"),
    )
    file_sink.write_files(files, folder)
    return folder


FOLDER_PATH = f"concat(source, '/', replace({c.PATH}, chr(92), '/'))"


def _folder_units(globs: tuple[str, ...], size: int) -> str:
    return f"""units AS (SELECT '' AS repo, file_path, '' AS commit_sha, content FROM (
      SELECT doc_id, {FOLDER_PATH} AS file_path, {c.CONTENT} AS content FROM documents)
      WHERE doc_id % 29 <> 3 AND NOT {k.any_glob('file_path', fixed.DEFAULT_EXCLUDES + globs)}
        AND octet_length(encode(replace(content, chr(10), concat(chr(13), chr(10))))) <= {size}
        AND len(list_filter(string_split(file_path, '/')[:-2],
          lambda d: d IN ({PRUNED}) OR ends_with(d, '.egg-info'))) = 0)"""


def _relabelled(rows: DataFrame, folder: str) -> DataFrame:
    """The label is the folder, whose name differs every time."""
    return shown(rows.withColumn("repo", F.when(F.col("repo") == folder, "folder")))


IN_FOLDER = "SELECT * REPLACE ('folder' AS repo) FROM findings"


@query("folder_scan", with_sql(k.scan_sql(_folder_units((), fixed.MAX_FILE_SIZE_BYTES)), IN_FOLDER))
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written_folder(spark, sf_dir)
    return _relabelled(jobs.scan_folder(spark, f"{folder}/"), folder)


@query("folder_scan_options", with_sql(k.scan_sql(_folder_units(("*.md",), 30_000)), IN_FOLDER))
def folder_scan_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With more exclusions and a lower size limit, which are the feature here."""
    folder = _written_folder(spark, sf_dir)
    options = jobs.ScanOptions(excludes="*.md", max_file_size_bytes=30_000)
    return _relabelled(jobs.scan_folder(spark, folder, options), folder)


@query("filetree_source", with_sql(k.scan_sql(_folder_units((), fixed.MAX_FILE_SIZE_BYTES)), IN_FOLDER))
def filetree_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder read as a data source, which gets the condition on the size."""
    folder = _written_folder(spark, sf_dir)
    filetree.register(spark)
    rows = spark.read.format("filetree").load(folder).where(F.col("size") <= fixed.MAX_FILE_SIZE_BYTES)
    wanted = rows.where(~paths.matches_any_glob(F.col("file_path"), fixed.DEFAULT_EXCLUDES))
    units = wanted.select(
        F.lit(folder).alias("repo"), "file_path", F.lit("").alias("commit_sha"), file_source.decoded(F.col("data")).alias("content")
    )
    return _relabelled(jobs.scan_units(units), folder)


def _from_inventory(folder: str) -> listing.Lister:
    """Pages of a sorted table of keys, as stores export them."""

    def lister(prefix: str, after: str, limit: int) -> list[tuple[str, int]]:
        fs, place = file_source.open_path(folder)
        keys = dataset.field("key")
        later = (keys >= prefix) & (keys > after) & (keys < prefix + "\U0010ffff")
        table = dataset.dataset(place, filesystem=fs, format="parquet").scanner(filter=later, columns=["key", "size"]).head(limit)
        return list(zip(*table.to_pydict().values(), strict=True))

    return lister


@query(
    "paged_listing",
    """SELECT concat('docs/', source, '/', cast(doc_id as string)) AS file_path, length(coalesce(text, ''))::BIGINT AS size
      FROM documents""",
)
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with a key for every document, listed by ranges of keys."""
    folder = session.work_folder(spark, "inventory")
    key = F.concat(F.lit("bucket/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    keys = c.table(spark, sf_dir, "documents").select(key.alias("key"), F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    keys.orderBy("key").write.parquet(folder)
    return listing.list_keys(spark, _from_inventory(folder), "bucket/").select("file_path", "size")


@query(
    "unreadable_files",
    """SELECT concat('gone_', cast(doc_id as string)) AS file_path, 'not found' AS reason FROM documents
      WHERE doc_id % 7 = 0""",
)
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that go between listing and reading are reported, not lost."""
    folder = _written_folder(spark, sf_dir)
    listed = file_source.list_files(spark, folder)
    gone = c.table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(
        F.format_string(f"{folder}/gone_%d", "doc_id").alias("path"),
        F.format_string("gone_%d", "doc_id").alias("file_path"),
        F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("string").alias("reason"),
    )
    return file_source.read_files(listed.unionByName(gone))[1]


@query("stream_scan", with_sql(k.scan_sql(k.PLAIN), ALL))
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan the documents as a stream and read what it wrote."""
    folder = session.work_folder(spark, "stream")
    stored = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a stream takes a file by a pattern only; one that has no other name fits a folder of parts as well
    arriving = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/documents[.]parquet")
    units = as_scan_units(
        arriving, "text", "source", F.expr("concat('doc_', cast(doc_id as string), '.txt')")
    )
    running = streaming.write_findings(
        streaming.scan_stream(units), f"{folder}/findings", f"{folder}/checkpoint"
    )
    running.awaitTermination()
    return shown(spark.read.parquet(f"{folder}/findings"))


# --- reports --------------------------------------------------------------------------------


@query(
    "sarif_results",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"""SELECT repo, {k.SLUG} AS rule_id, {k.LEVEL} AS level,
          concat(pattern_name, ' detected via ', detection_method, ' in ', repo, '.') AS message,
          file_path AS uri, line_number AS start_line, {k.FINGERPRINT} AS fingerprint FROM findings""",
    ),
)
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(_planted_findings(spark, sf_dir))


@query(
    "sarif_rules",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"SELECT DISTINCT {k.SLUG} AS rule_id, pattern_name AS name, {k.LEVEL} AS level FROM findings",
    ),
)
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(_planted_findings(spark, sf_dir))


ORDERED = f"""SELECT f.*, row_number() OVER (ORDER BY f.repo, walk, f.commit_sha, detector_ord, pattern_ord,
        f.line_number, strpos(line, value)) AS place
      FROM (SELECT repo, file_path, line_number::BIGINT AS line_number, {k.redacted('value')} AS matched_text,
          detection_method, pattern_name, confidence, commit_sha, round(h, 6) AS entropy_score, value, pattern_ord,
          CASE detection_method WHEN 'regex' THEN 1 ELSE 2 END AS detector_ord,
          list_transform(string_split(file_path, '/'), lambda d, i: concat(
            CASE WHEN i = len(string_split(file_path, '/')) THEN '0' ELSE '1' END, d)) AS walk
        FROM ({k.BOTH})) f
      JOIN lines l ON l.repo = f.repo AND l.file_path = f.file_path AND l.commit_sha = f.commit_sha
        AND l.line_number = f.line_number"""


@query(
    "sarif_first_rules",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"""SELECT {k.SLUG} AS rule_id, arg_min(pattern_name, place) AS name, arg_min({k.LEVEL}, place) AS level FROM (
          SELECT * REPLACE (CASE WHEN line_number % 2 = 1 THEN upper(pattern_name) ELSE pattern_name END AS pattern_name,
            CASE WHEN line_number % 3 = 0 THEN 'low' ELSE confidence END AS confidence) FROM ({ORDERED}))
        GROUP BY ALL""",
    ),
)
def sarif_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and levels that differ from finding to finding of a rule; its first one decides."""
    line = F.col("line_number")
    changed = _planted_findings(spark, sf_dir).withColumns({
        "pattern_name": F.when(line % 2 == 1, F.upper("pattern_name")).otherwise(F.col("pattern_name")),
        "confidence": F.when(line % 3 == 0, "low").otherwise(F.col("confidence")),
    })
    return reports.sarif_rules(changed)


@query(
    "sarif_documents",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"""SELECT place, {k.SLUG} AS rule_id, {k.FINGERPRINT} AS fingerprint, place > 1 AS continued
        FROM ({ORDERED}) UNION ALL
        SELECT 0, string_agg(rule, ',' ORDER BY rule), '2.1.0', false FROM (SELECT DISTINCT {k.SLUG} AS rule FROM findings)
        UNION ALL SELECT count(*) + 1, NULL, NULL, false FROM findings""",
    ),
)
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of the document in order; the opening has the rules, the closing nothing."""
    fragments = reports.sarif_fragments(findings.numbered(_planted_findings(spark, sf_dir)))
    result = F.from_json(F.ltrim("fragment", F.lit(",")), "ruleId string, partialFingerprints map<string,string>")
    rules = F.regexp_extract_all(F.regexp_extract("fragment", '"rules":(.*)', 1), F.lit('"id":"([^"]*)"'), F.lit(1))
    version = F.regexp_extract("fragment", '"version":"([^"]*)"', 1)
    opening = F.col("place") == 0
    return fragments.select(
        "place",
        F.when(opening, F.array_join(rules, ",")).otherwise(result["ruleId"]).alias("rule_id"),
        F.when(opening, version).otherwise(result["partialFingerprints"][fixed.SARIF_FINGERPRINT_KEY]).alias("fingerprint"),
        F.col("fragment").startswith(",").alias("continued"),
    )


@query("sarif_empty", """SELECT count(*) AS n, 0 AS n_results, '2.1.0' AS version FROM (SELECT count(*) FROM documents)""")
def sarif_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan without findings still gives a document, one that closes old alerts."""
    nothing = _planted_findings(spark, sf_dir).where("confidence = 'none'")
    fragments = reports.sarif_fragments(findings.numbered(nothing))
    whole = fragments.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "fragment"))), lambda x: x["fragment"]), "\n").alias("text"))
    document = F.from_json("text", "version string, runs array<struct<results:array<struct<ruleId:string>>>>").alias("d")
    return whole.select(document).groupBy(F.size(F.col("d.runs")[0]["results"]).alias("n_results"), "d.version").agg(F.count("*").alias("n"))


@query(
    "json_report",
    with_sql(
        k.scan_sql(k.PLANTED),
        """SELECT to_json(struct_pack(commit_sha := commit_sha, confidence := confidence,
          detection_method := detection_method, entropy_score := entropy_score, file_path := file_path,
          line_number := line_number, matched_text := matched_text, pattern_name := pattern_name,
          repo := repo))::VARCHAR AS finding FROM findings""",
    ),
)
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _planted_findings(spark, sf_dir).withColumn(
        "entropy_score", F.round("entropy_score", 6)
    )
    return reports.json_rows(rounded)


def _escaped(v: str) -> str:
    out = f"replace({v}, '&', '&amp;')"
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{raw}', '{entity}')"
    return out


HTML_ROWS = f"""SELECT repo, concat('<tr><td>', {_escaped('confidence')}, '</td><td>',
          {_escaped('detection_method')}, '</td><td>', {_escaped('pattern_name')}, '</td><td>',
          {_escaped('repo')}, '</td><td>', {_escaped('file_path')}, '</td><td>', line_number, '</td><td>',
          printf('%.2f', entropy_score), '</td><td><code>', {_escaped('matched_text')},
          '</code></td><td><code>', {_escaped('commit_sha')}, '</code></td></tr>') AS html"""


@query("html_rows", with_sql(k.scan_sql(k.PLANTED), f"{HTML_ROWS} FROM findings"))
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _planted_findings(spark, sf_dir).withColumn(
        "entropy_score", F.round("entropy_score", 6)
    )
    return reports.html_rows(rounded)


@query(
    "html_escaping",
    f"SELECT page_id, md5({_escaped('html')}) AS digest FROM pages",
)
def html_escaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(text.html_escape(F.col("html"))).alias("digest")
    )


@query(
    "html_documents",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"""SELECT place, md5(html) AS digest FROM ({HTML_ROWS}, place FROM ({ORDERED}))""",
    ),
)
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the page in order, without what frames them."""
    rounded = _planted_findings(spark, sf_dir).withColumn("entropy_score", F.round("entropy_score", 6))
    fragments = reports.html_fragments(findings.numbered(rounded))
    return fragments.where(F.col("fragment").startswith("<tr>")).select("place", F.md5("fragment").alias("digest"))


@query("report_file", with_sql(k.scan_sql(k.PLANTED), "SELECT *, 1::BIGINT AS n_files FROM findings"))
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one file of JSON lines holds that all tasks wrote together."""
    path = session.work_folder(spark, "report") + "/findings.json"
    reports.write_report_file(_planted_findings(spark, sf_dir), "json", path)
    types = {"line_number": "bigint", "entropy_score": "double"}
    rows = spark.read.schema(", ".join(f"{n} {types.get(n, 'string')}" for n in FINDING_COLUMNS)).json(path)
    return shown(rows).withColumn("n_files", F.lit(len(rows.inputFiles())).cast("bigint"))


@query(
    "html_frame",
    with_sql(
        k.scan_sql(k.PLANTED),
        """SELECT 0::BIGINT AS place, concat('<!doctype html><html lang="en"><head><meta charset="utf-8">',
          '<title>Credential exposure report</title></head><body><h1>Credential exposure report</h1><table><thead><tr>',
          '<th>Confidence</th><th>Method</th><th>Pattern</th><th>Repository</th><th>File</th><th>Line</th><th>Entropy</th>',
          '<th>Match</th><th>Commit</th></tr></thead><tbody>') AS fragment
        UNION ALL SELECT count(*) + 1, '</tbody></table></body></html>' FROM findings""",
    ),
)
def html_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the rows of the page, and where."""
    fragments = reports.html_fragments(findings.numbered(_planted_findings(spark, sf_dir)))
    return fragments.where(~F.col("fragment").startswith("<tr>"))


@query(
    "html_rounding",
    """SELECT doc_id, printf('%.2f', (doc_id % 1024) / 128.0::DOUBLE) AS exact,
      printf('%.2f', (doc_id % 1500) / 1000.0::DOUBLE) AS near FROM documents""",
)
def html_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on and beside the middle of two numbers with two decimals."""
    return c.table(spark, sf_dir, "documents").select(
        "doc_id",
        text.two_decimals(F.expr("(doc_id % 1024) / 128.0D")).alias("exact"),
        text.two_decimals(F.expr("(doc_id % 1500) / 1000.0D")).alias("near"),
    )


@query(
    "ordered_findings",
    with_sql(k.scan_sql(k.PLANTED), f"SELECT {', '.join(FINDING_COLUMNS)}, place FROM ({ORDERED})"),
)
def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(findings.numbered(_planted_findings(spark, sf_dir)), "place")


# --- damaged, empty and repeated inputs ------------------------------------------------


BROKEN_STATE = k.TREE_STATE.replace(
    f"WHEN r % 12 = 6 THEN {k.quoted(fixed.TRUNCATED_TREE_ERROR)}",
    f"""WHEN md5(repo) LIKE '1%' THEN {k.quoted(tree.BRANCH_RECORD_ERROR)}
        WHEN md5(repo) LIKE '2%' THEN {k.quoted(tree.TREE_ERROR)}
        WHEN r % 12 = 6 THEN {k.quoted(fixed.TRUNCATED_TREE_ERROR)}""",
)
BROKEN_FILES = k.TREE_FILES.replace(
    "WHERE doc_id % 211 = 5)", f"WHERE doc_id % 211 = 5 OR {c.BLOB_SHA} LIKE '0a%' OR {c.BLOB_SHA} LIKE 'f7%')"
)


@query(
    "payload_failures",
    with_sql(
        ",\n".join([k.REPOS, BROKEN_STATE, BROKEN_FILES]),
        f"""{TREE_FAILURES} UNION ALL SELECT '', 'main', {k.quoted(landed.REPO_PAGE_ERROR)} FROM (
          SELECT unnest(range(2)) FROM (SELECT count(*) FROM documents))""",
    ),
)
def payload_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad listing pages, bodies that are no objects, cut-off records: each fails what it stands for."""
    bad = lambda rows, when, body: rows.withColumn("payload", F.when(F.expr(when), body).otherwise(F.col("payload")))
    pages = c.repo_pages(spark, sf_dir)
    for body in ("<html>", '{"message": "rate limit"}'):
        pages = pages.unionByName(c.repo_pages(spark, sf_dir).agg(F.lit(body).alias("payload"), F.max("page_start").alias("page_start")))
    return jobs.scan_trees(
        landed.parse_repos(pages),
        landed.parse_branches(bad(c.branch_payloads(spark, sf_dir), "md5(repo) like '1%'", F.lit("[]"))),
        landed.parse_trees(bad(c.tree_payloads(spark, sf_dir), "md5(repo) like '2%'", F.lit('{"tree": 5}'))),
        landed.parse_blobs(
            bad(c.blob_payloads(spark, sf_dir), "sha like '0a%' or sha like 'f7%'", F.expr("left(payload, length(payload) - 9)"))
        ),
    ).failures


@query(
    "empty_histories",
    with_sql(
        ",\n".join([
            k.REPOS,
            k.HISTORY_STATE.replace(
                "WHEN r % 8 = 5 THEN 'commit listing not found'", f"WHEN r % 16 = 13 THEN {k.quoted(tree.COMMITS_PAGE_ERROR)}"
            ),
            k.PATCH_LINES,
            k.HISTORY_UNITS.replace("ON d.r = s.r WHERE", "ON d.r = s.r AND d.r % 8 <> 5 WHERE"),
        ]),
        HISTORY_FAILURES,
    ),
)
def empty_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that was landed and is empty fails nothing; one that is no list does."""
    body = F.expr("case when r % 16 = 13 then '{\"message\": \"gone\"}' else '[]' end")
    empty = c.repo_numbers(spark, sf_dir).where("r % 8 = 5").select(
        F.expr(c.LABEL).alias("repo"), F.expr(c.BRANCH).alias("branch"), F.lit(0).alias("page_start"), body.alias("payload")
    )
    pages = c.commit_pages(spark, sf_dir).unionByName(empty)
    return jobs.scan_histories(
        landed.parse_repos(c.repo_pages(spark, sf_dir)), landed.parse_commits(pages), _commit_files(spark, sf_dir)
    ).failures


@query("duplicate_landing", with_sql(TREE_SCAN, ALL))
def duplicate_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything landed twice gives each finding once."""
    twice = lambda rows: rows.unionByName(rows)
    return shown(
        jobs.scan_trees(
            landed.parse_repos(twice(c.repo_pages(spark, sf_dir))),
            landed.parse_branches(twice(c.branch_payloads(spark, sf_dir))),
            landed.parse_trees(twice(c.tree_payloads(spark, sf_dir))),
            landed.parse_blobs(twice(c.blob_payloads(spark, sf_dir))),
        ).findings
    )


LONG_NUMBER = """case doc_id % 3 when 0 then concat('000000000000', cast(5 + doc_id % 7 as string))
  when 1 then cast(5000000000 + doc_id as string) else '123456789012345678901' end"""


@query(
    "long_hunk_numbers",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN ({LONG_NUMBER})::BIGINT + i END AS line_number, doc_id % 3 = 2 AS unreadable
      FROM documents, (SELECT unnest([0, 1]) AS i) WHERE doc_id % 3 < 2 OR i = 0""",
)
def long_hunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading zeros and large numbers place lines; what no number holds is told apart."""
    patch = F.expr(f"concat('@@ -1 +', {LONG_NUMBER}, ',2 @@', chr(10), '+one', chr(10), '+two')")
    patches = c.table(spark, sf_dir, "documents").select("doc_id", patch.alias("patch"))
    flagged = patches.withColumn("unreadable", history.unreadable(F.col("patch")))
    placed = history.added_lines(flagged).select("doc_id", F.explode("line_nos").alias("line_number"), "unreadable")
    lost = flagged.where("unreadable").select("doc_id", F.lit(None).cast("bigint").alias("line_number"), "unreadable")
    return placed.unionByName(lost)


FAR_TOKENS = (("AWS access key", c.token_sql("0", "a"), "1"), ("PEM private key", c.token_sql("5", "a"), "3000000007 + doc_id"))


@query(
    "distant_hunks",
    " UNION ALL ".join(
        f"SELECT doc_id, {k.quoted(name)} AS pattern_name, ({line})::BIGINT AS line_number, {k.redacted(token)} AS matched_text FROM documents"
        for name, token, line in FAR_TOKENS
    ),
)
def distant_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hunks of one patch that are three billion lines apart."""
    (_, near, _), (_, far, _) = FAR_TOKENS
    patch = F.expr(
        f"concat('@@ -1 +1 @@', chr(10), '+', {near}, chr(10), '@@ -9 +', cast(3000000007 + doc_id as string), ' @@', chr(10),"
        f" array_join(transform(split({far}, chr(10)), l -> concat('+', l)), chr(10)))"
    )
    units = history.added_lines(c.table(spark, sf_dir, "documents").select("doc_id", patch.alias("patch")))
    found = detect(units, DetectOptions(entropy=None), ("doc_id",), None)
    names = [name for name, _, _ in FAR_TOKENS]
    return found.where(F.col("pattern_name").isin(names)).select("doc_id", "pattern_name", "line_number", "matched_text")


SPLIT_KEY = c.token_sql("5", "a")
SPLIT_GAP = "case doc_id % 3 when 0 then 3000000000 when 1 then 5000 else 2 end"
SPLIT_TEXT = f"""concat(split_part({SPLIT_KEY}, chr(10), 1), CASE WHEN doc_id % 3 > 0 THEN repeat(chr(10), ({SPLIT_GAP})::INTEGER) END,
      substr({SPLIT_KEY}, strpos({SPLIT_KEY}, chr(10)) + 1))"""


@query(
    "split_keys",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 1::BIGINT END AS line_number,
      CASE WHEN doc_id % 3 > 0 THEN md5({k.redacted('value')}) END AS digest,
      CASE WHEN doc_id % 3 > 0 THEN round({k.entropy('value')}, 6) END AS entropy_score,
      CASE WHEN doc_id % 3 = 0 THEN 'match too long to be reported' END AS error
    FROM (SELECT doc_id, {SPLIT_TEXT} AS value FROM documents)""",
)
def split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose first line is in one hunk and whose rest is in another, up to three billion lines below."""
    lines = f"split({SPLIT_KEY}, chr(10), -1)"
    patch = F.expr(
        f"concat('@@ -1 +1 @@', chr(10), '+', {lines}[0], chr(10), '@@ -9 +', cast(1 + {SPLIT_GAP} as string), ' @@', chr(10),"
        f" array_join(transform(slice({lines}, 2, 1000), l -> concat('+', l)), chr(10)))"
    )
    units = history.added_lines(c.table(spark, sf_dir, "documents").select("doc_id", patch.alias("patch")))
    found = detect(units, DetectOptions(entropy=None), ("doc_id",), None, errors=True)
    ours = found.where((F.col("pattern_name") == "PEM private key") | F.col("error").isNotNull())
    return ours.select(
        "doc_id", "line_number", F.md5("matched_text").alias("digest"), F.round("entropy_score", 6).alias("entropy_score"), "error"
    )


HOSTILE = Signature("repeated group", r"x (?:a|b)+ END", "high", "x a END")
HOSTILE_TEXT = """concat('repo ', cast(doc_id as string), chr(10), 'x ',
      repeat('ab', case when doc_id % 500 = 0 then 500000 else cast(1 + doc_id % 50 as integer) end), ' END')"""


@query(
    "hostile_custom_pattern",
    f"""SELECT repo, doc_id, line_number, md5({k.redacted('value')}) AS digest FROM (
      SELECT source AS repo, doc_id, 2::BIGINT AS line_number, substr({HOSTILE_TEXT}, strpos({HOSTILE_TEXT}, chr(10)) + 1) AS value
      FROM documents)""",
)
def hostile_custom_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature that repeats a group, over lines of up to a million characters in texts of all repositories."""
    units = c.table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), "doc_id", F.expr(HOSTILE_TEXT).alias("content")
    )
    found = detect(units, DetectOptions(catalogue=(HOSTILE,), entropy=None), ("repo", "doc_id"), None)
    return found.select("repo", "doc_id", "line_number", F.md5("matched_text").alias("digest"))


def _pushed_meanwhile(pages: DataFrame) -> DataFrame:
    """Listings into which a commit was pushed after ten of their commits were read: the rest moves by one, and one is repeated."""
    moved = pages.withColumn("page_start", F.col("page_start") + (F.col("page_start") >= 10).cast("int"))
    return moved.unionByName(pages.where("page_start = 9").withColumn("page_start", F.lit(10)))


LISTED = f"""{k.REPOS.replace(" WHERE r % 11 <> 5", "")}, listed AS (SELECT r.repo, r.branch, doc_id % 25 AS pos, d.commit_sha
      FROM repos r JOIN (SELECT doc_id, {c.REPO} AS r, {c.COMMIT_SHA} AS commit_sha FROM documents) d ON d.r = r.r WHERE r.r % 8 <> 5)"""


@query(
    "shifted_pages",
    with_sql(LISTED, "SELECT repo, branch, pos::INTEGER AS pos, commit_sha FROM listed WHERE pos < 15"),
)
def shifted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest commits of listings that moved while they were read."""
    commits = landed.parse_commits(_pushed_meanwhile(c.commit_pages(spark, sf_dir)))
    return history.newest_commits(commits, 15).select("repo", "branch", "pos", "commit_sha")


@query(
    "lost_pages",
    with_sql(LISTED, """SELECT repo, branch FROM listed GROUP BY ALL
      HAVING count(*) FILTER (pos = 3) = 1 AND count(*) FILTER (pos > 3) > 0 AND length(repo) % 2 = 0"""),
)
def lost_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of which a page was not landed, ahead of commits that were."""
    pages = c.commit_pages(spark, sf_dir).where("not (page_start = 3 and length(repo) % 2 = 0)")
    commits = landed.parse_commits(_pushed_meanwhile(pages))
    return history.gapped_listings(commits, history.newest_commits(commits, 15))


@query(
    "moved_branch",
    f"""SELECT {c.LABEL} AS repo, {c.BRANCH} AS branch, {c.HEAD} AS commit_sha
      FROM (SELECT DISTINCT {c.REPO} AS r FROM documents) WHERE r % 9 <> 4""",
)
def moved_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of branches that were landed three times: the newest readable record counts, not the greatest hash."""
    now = c.branch_payloads(spark, sf_dir)
    at = lambda rows, second: rows.withColumn("landed_at", F.timestamp_seconds(F.lit(second)))
    older = at(now.withColumn("payload", F.lit('{"commit":{"sha":"ffff"}}')), 1)
    newer = at(now.withColumn("payload", F.lit("{")), 3)
    branches = landed.parse_branches(older.unionByName(at(now, 2)).unionByName(newer))
    chosen = branches.select("repo", "branch").distinct().withColumn("error", F.lit(None).cast("string"))
    return tree.with_heads(chosen, branches).where("error is null").select("repo", "branch", "commit_sha")


def _landed_scan(spark: SparkSession, sf_dir: str) -> jobs.ScanResult:
    twice = lambda rows: rows.unionByName(rows)
    return jobs.scan_trees(
        landed.parse_repos(c.repo_pages(spark, sf_dir)),
        landed.parse_branches(c.branch_payloads(spark, sf_dir)),
        twice(c.tree_payloads(spark, sf_dir)),
        c.blob_payloads(spark, sf_dir),
    )


@query("payloads_as_landed", with_sql(TREE_SCAN, ALL))
def payloads_as_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees scanned from payloads, of which only wanted ones are parsed; listings were landed twice."""
    return shown(_landed_scan(spark, sf_dir).findings)


@query("payloads_as_landed_failures", CHECKS["tree_scan_failures"])
def payloads_as_landed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed_scan(spark, sf_dir).failures


@query("streamed_tree_items", CHECKS["tree_items"].replace("    FROM d, unnest", "    FROM (SELECT * FROM d WHERE r % 12 <> 6) d, unnest"))
def streamed_tree_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of tree payloads as rows, without arrays; truncated listings have none."""
    items = landed.tree_items(c.tree_payloads(spark, sf_dir))
    return items.select("repo", F.lit(False).alias("truncated"), "path", "type", "sha", "size")


ODD_UNITS = f"""units AS (SELECT source AS repo, {c.PATH} AS file_path, {c.COMMIT_SHA} AS commit_sha,
      regexp_replace({ODD_CONTENT}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g') AS content
      FROM documents)"""


@query("odd_break_findings", with_sql(k.entropy_sql(ODD_UNITS), ALL))
def odd_break_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of tokens follow all kinds of line breaks."""
    units = c.table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.expr(c.PATH).alias("file_path"), F.expr(c.COMMIT_SHA).alias("commit_sha"),
        F.expr(ODD_CONTENT).alias("content"),
    )
    return shown(entropy_findings(units))


# --- own detectors, catalogue and baseline files, every status ---------------------------

QUAD = r"(?:\d{1,3}\.){3}\d{1,3}"


def _quads(units: DataFrame) -> DataFrame:
    """An own detector: lines that hold a dotted quad, one finding for each."""
    lines = units.select(
        "repo", "file_path", "commit_sha", F.posexplode(F.split("content", "\n")).alias("at", "line")
    ).withColumn("value", F.regexp_extract("line", QUAD, 0)).where("value <> ''")
    return lines.select(
        "repo", "file_path", "commit_sha", (F.col("at") + 1).alias("line_number"), text.redact(F.col("value")).alias("matched_text"),
        F.lit("own").alias("detection_method"), F.lit("Dotted quad").alias("pattern_name"), F.lit("low").alias("confidence"),
        F.lit(0.0).alias("entropy_score"),
    )


@query(
    "own_detector",
    with_sql(
        k.entropy_sql(k.PLAIN),
        f"""SELECT * FROM findings UNION ALL SELECT repo, file_path, line_number, {k.redacted('value')}, 'own', 'Dotted quad', 'low',
          commit_sha, 0.0 FROM (SELECT *, regexp_extract(line, '{QUAD}') AS value FROM lines) WHERE value <> ''""",
    ),
)
def own_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = jobs.ScanOptions(detect=DetectOptions(catalogue=(), own=(_quads,)))
    return shown(jobs.scan_units(c.plain_units(spark, sf_dir), options))


@query("catalogue_file", with_sql(k.regex_sql(k.PLAIN, CUSTOM), ALL))
def catalogue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures read from a file."""
    folder = session.work_folder(spark, "catalogue")
    entries = [{"name": s.name, "regex": s.regex, "confidence": s.confidence.upper(), "example": s.example} for s in CUSTOM]
    spark.createDataFrame([(json.dumps({"patterns": entries}),)], "value string").coalesce(1).write.text(folder)
    return shown(regex_findings(c.plain_units(spark, sf_dir), load_catalogue(spark, folder)))


@query(
    "catalogue_rejects",
    """WITH entries AS (SELECT source AS name, row_number() OVER (ORDER BY source) - 1 AS n FROM (SELECT DISTINCT source FROM documents))
    SELECT (n + 1)::INTEGER AS ord, name, CASE n % 5 WHEN 1 THEN 'without example'
      WHEN 2 THEN 'confidence is none of high, low, medium: top' WHEN 3 THEN 'the pattern matches the empty text'
      WHEN 4 THEN 'the pattern cannot be used' END AS reason FROM entries WHERE n % 5 > 0""",
)
def catalogue_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made from the sources of the documents, most of them unusable."""
    folder = session.work_folder(spark, "catalogue")
    numbered = c.table(spark, sf_dir, "documents").select("source").distinct()
    names = F.array_sort(F.collect_list("source"))
    entry = F.struct(
        F.col("source").alias("name"),
        F.expr("case n % 5 when 3 then 'n*' when 4 then '(' else 'n+' end").alias("regex"),
        F.expr("case n % 5 when 2 then 'Top' else 'Low' end").alias("confidence"),
        F.expr("case when n % 5 <> 1 then 'nn' end").alias("example"),
    )
    listed = numbered.agg(names.alias("s")).select(F.posexplode("s").alias("n", "source"))
    file = listed.agg(F.to_json(F.array_sort(F.collect_list(F.struct("n", entry.alias("e"))))["e"]).alias("value"))
    file.coalesce(1).write.text(folder)
    entries = catalogue_entries(spark, folder).where("reason is not null")
    return entries.select("ord", "name", F.regexp_replace("reason", "(cannot be used).*", "$1").alias("reason"))


ACCEPTED_PER_DOCUMENT = 5_000


@query("baseline_document", CHECKS["baseline_round_trip"])
def baseline_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline of JSON documents, each with a share of the findings."""
    scanned = session.keep(_planted_findings(spark, sf_dir), "findings")
    folder = session.work_folder(spark, "baseline")
    entry = F.struct("file_path", "fingerprint", "pattern_name", "repo")
    known = baseline.snapshot(scanned.where(F.col("line_number") == 1))
    shares = 1 + known.count() // ACCEPTED_PER_DOCUMENT
    share = F.pmod(F.xxhash64("fingerprint"), F.lit(shares))
    documents = known.groupBy(share.alias("share")).agg(F.collect_list(entry).alias("accepted"))
    file_sink.write_files(
        documents.select(
            F.format_string("%d.json", "share").alias("file_path"), F.to_json(F.struct("accepted")).cast("binary").alias("data")
        ),
        folder,
    )
    return shown(baseline.unaccepted(scanned, load_baseline(spark, folder, "document")), "fingerprint")


STATUSES = {"clean": "confidence = 'none'", "found": "confidence = 'high'"}


@query(
    "gate_statuses",
    with_sql(
        k.scan_sql(k.PLANTED),
        """SELECT 'clean' AS scan, 0 AS n_findings, 0::BIGINT AS n_failures, 0 AS status FROM (SELECT count(*) FROM findings)
        UNION ALL SELECT 'found', count(*), 0, 3 FROM findings WHERE confidence = 'high'
        UNION ALL SELECT 'not gated', count(*), 0, 0 FROM findings WHERE confidence = 'high'""",
    ),
)
def gate_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of scans without failures."""
    scanned = session.keep(_planted_findings(spark, sf_dir), "findings")
    status = lambda name, rows, gate: findings.gate_status(rows, None, gate).select(F.lit(name).alias("scan"), "*")
    high = scanned.where("confidence = 'high'")
    clean = status("clean", scanned.where("confidence = 'none'"), True)
    return clean.unionByName(status("found", high, True)).unionByName(status("not gated", high, False))


@query(
    "summary_sentences",
    with_sql(
        k.scan_sql(k.PLANTED),
        f"""SELECT n AS n_findings, CASE n WHEN 0 THEN {k.quoted(fixed.EMPTY_REPORT_TEXT)} ELSE '1 potential secret found.' END AS summary
        FROM (SELECT count(*) AS n FROM findings WHERE file_path = 'src/app_0.py' AND pattern_name = 'AWS access key'
          UNION ALL SELECT count(*) FROM findings WHERE confidence = 'none')""",
    ),
)
def summary_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences for one finding and for none."""
    scanned = session.keep(_planted_findings(spark, sf_dir), "findings")
    one = scanned.where("file_path = 'src/app_0.py' and pattern_name = 'AWS access key'")
    return findings.summary(one).unionByName(findings.summary(scanned.where("confidence = 'none'")))
