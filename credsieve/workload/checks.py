"""SQL fragments for DuckDB that state the expected results independently."""

from __future__ import annotations

from collections.abc import Sequence

from credsieve import fixed_values as fixed
from credsieve.operators.catalogue import DEFAULT_CATALOGUE, Signature
from credsieve.workload import corpora as c

MULTI_LINE = ("AWS secret access key", "PEM private key")
DIRECTIVE = fixed.IGNORE_DIRECTIVE_FORMAT


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def feeds(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def redacted(v: str) -> str:
    n, k = f"length({v})", f"greatest(1, length({v}) // 5)"
    return (
        f"case when {n} <= 4 then repeat('*', {n}) else concat(left({v}, {k}),"
        f" repeat('*', greatest(1, {n} - 2 * {k})), right({v}, {k})) end"
    )


def entropy(v: str) -> str:
    share = f"((length({v}) - length(replace({v}, ch, ''))) / length({v}))"
    return (
        f"(-list_sum(list_transform(list_distinct(string_split({v}, '')),"
        f" lambda ch: {share} * log2({share}))))"
    )


def base(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def any_glob(path: str, globs: Sequence[str]) -> str:
    clean = f"replace({path}, chr(92), '/')"
    tests = [
        f"{p} GLOB {quoted(g)}" for g in globs for p in (clean, base(clean))
    ]
    return "(" + " OR ".join(tests) + ")"


def entropy_excluded(path: str) -> str:
    clean = f"replace({path}, chr(92), '/')"
    ending = f"lower(regexp_extract({base(clean)}, '^.+(\\.[^.]+)$', 1))"
    endings = ", ".join(quoted(s) for s in fixed.ENTROPY_EXCLUDED_SUFFIXES)
    return f"({ending} IN ({endings}) OR {any_glob(path, fixed.ENTROPY_EXCLUDED_GLOBS)})"


def noise(line: str) -> str:
    return (
        f"((contains(lower({line}), 'data:image/') AND contains(lower({line}), 'base64,'))"
        f" OR (length({line}) > 2000 AND length({line}) - length(replace({line}, ';', '')) > 20))"
    )


def namespace(v: str) -> str:
    bad = (
        "NOT regexp_full_match(s, '[A-Za-z_$][A-Za-z0-9_$]*') OR length(s) > 30"
    )
    return (
        f"(len(string_split({v}, '.')) >= 3 AND"
        f" len(list_filter(string_split({v}, '.'), lambda s: {bad})) = 0)"
    )


UNIT = "repo, file_path, commit_sha"


def lines_cte(source: str = "units") -> str:
    return f"""lines AS (
      SELECT u.repo, u.file_path, u.commit_sha, t.n AS line_number, t.line
      FROM {source} u, unnest(string_split(u.content, chr(10))) WITH ORDINALITY AS t(line, n))"""


def regex_cte(
    signatures: Sequence[Signature] = DEFAULT_CATALOGUE, whole: str = "units", name: str = "regex_hits"
) -> str:
    """Hits of single-line signatures from ``lines``, of the others from ``whole``."""
    parts, extra = [], []
    for i, s in enumerate(signatures, start=1):
        labels = f"{i} AS pattern_ord, {quoted(s.name)} AS pattern_name, {quoted(s.confidence)} AS confidence"
        pattern = quoted(s.regex)
        if s.name in MULTI_LINE:
            extra.append(
                f"""whole_{i} AS (
      SELECT *, 1 + sum({feeds('gap')}) OVER (PARTITION BY {UNIT} ORDER BY i)
        + coalesce(sum({feeds('m')}) OVER (PARTITION BY {UNIT} ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_number
      FROM (SELECT {UNIT}, content, unnest(regexp_extract_all(content, {pattern}, 0)) AS m,
              unnest(regexp_extract_all(content, {pattern}, {s.group})) AS value,
              unnest(string_split_regex(content, {pattern})) AS gap,
              unnest(range(len(string_split_regex(content, {pattern})))) AS i
            FROM {whole} WHERE regexp_matches(content, {pattern})) WHERE m IS NOT NULL)"""
            )
            parts.append(
                f"SELECT {UNIT}, line_number, {labels}, value FROM whole_{i} WHERE NOT"
                f" regexp_matches(string_split(content, chr(10))[line_number::BIGINT], {quoted(DIRECTIVE)})"
            )
        else:
            parts.append(
                f"SELECT {UNIT}, line_number, {labels},"
                f" unnest(regexp_extract_all(line, {pattern}, {s.group})) AS value FROM lines"
                f" WHERE regexp_matches(line, {pattern}) AND NOT regexp_matches(line, {quoted(DIRECTIVE)})"
            )
    body = "\n      UNION ALL ".join(parts)
    hits = f"""{name} AS (SELECT DISTINCT *, {entropy('value')} AS h, 'regex' AS detection_method
      FROM ({body}) WHERE value <> '')"""
    return ",\n    ".join([*extra, hits])


def entropy_cte(
    threshold: float = 4.7, hex_threshold: float = 3.0, min_length: int = 21, paths: bool = True
) -> str:
    value = "regexp_extract(trimmed, '^[A-Za-z0-9_.-]+[=:](.+)$', 1)"
    keep = f"AND NOT {entropy_excluded('file_path')}" if paths else ""
    return f"""tokens AS (
      SELECT {UNIT}, line_number, trim(tok, '.') AS trimmed FROM (
        SELECT {UNIT}, line_number, unnest(regexp_extract_all(line, '[A-Za-z0-9_./+=:-]{{21,}}')) AS tok
        FROM lines WHERE regexp_matches(line, '[A-Za-z0-9_./+=:-]{{21}}') AND NOT {noise('line')}
          AND NOT regexp_matches(line, {quoted(DIRECTIVE)}) {keep})),
    candidates AS (
      SELECT DISTINCT {UNIT}, line_number,
        CASE WHEN length({value}) >= {min_length} THEN {value} ELSE trimmed END AS value FROM tokens),
    scored AS (
      SELECT *, {entropy('value')} AS h FROM candidates
      WHERE length(value) >= {min_length} AND NOT {namespace('value')}),
    entropy_hits AS (
      SELECT {UNIT}, line_number, 0 AS pattern_ord, 'High entropy token' AS pattern_name,
        'medium' AS confidence, value, h, 'entropy' AS detection_method FROM scored
      WHERE h > CASE WHEN regexp_full_match(value, '[0-9a-fA-F]+') THEN {hex_threshold} ELSE {threshold} END)"""


def findings_cte(hits: str) -> str:
    return f"""findings AS (
      SELECT repo, file_path, line_number::BIGINT AS line_number, {redacted('value')} AS matched_text,
        detection_method, pattern_name, confidence, commit_sha, round(h, 6) AS entropy_score
      FROM ({hits}))"""


FINGERPRINT = """sha256(concat_ws(chr(31), repo, file_path, line_number::VARCHAR,
  detection_method, pattern_name, matched_text))"""
SLUG = "concat(trim(regexp_replace(lower(pattern_name), '[^a-z0-9]+', '-', 'g'), '-'), '-', detection_method)"
LEVEL = "case confidence when 'high' then 'error' when 'medium' then 'warning' when 'low' then 'note' end"
BOTH = "SELECT * FROM regex_hits UNION ALL SELECT * FROM entropy_hits"

PLANTED = f"""units AS (SELECT source AS repo, {c.PATH} AS file_path, {c.COMMIT_SHA} AS commit_sha,
      {c.CONTENT} AS content FROM documents)"""
PLAIN = """units AS (SELECT source AS repo, concat('doc_', cast(doc_id as string), '.txt') AS file_path,
      '' AS commit_sha, text AS content FROM documents)"""
PAGES = """units AS (SELECT 'pages' AS repo, concat('page_', cast(page_id as string), '.html') AS file_path,
      '' AS commit_sha, html AS content FROM pages)"""


def scan_sql(units: str, **entropy_options) -> str:
    """CTEs up to ``findings`` of both detectors."""
    return ",\n    ".join(
        [units, lines_cte(), regex_cte(), entropy_cte(**entropy_options), findings_cte(BOTH)]
    )


def entropy_sql(units: str, **options) -> str:
    return ",\n    ".join(
        [units, lines_cte(), entropy_cte(**options), findings_cte("SELECT * FROM entropy_hits")]
    )


def regex_sql(units: str, signatures: Sequence[Signature] = DEFAULT_CATALOGUE) -> str:
    return ",\n    ".join(
        [units, lines_cte(), regex_cte(signatures), findings_cte("SELECT * FROM regex_hits")]
    )


# --- repositories ------------------------------------------------------------------

REPOS = f"""repos AS (SELECT r, {c.FULL_NAME} AS full_name, {c.LABEL} AS repo, {c.BRANCH} AS branch,
      {c.HEAD} AS head FROM (SELECT DISTINCT {c.REPO} AS r FROM documents) WHERE r % 11 <> 5)"""
TREE_STATE = f"""tree_state AS (SELECT *, CASE WHEN r % 10 = 7 THEN {quoted(fixed.BAD_REPO_NAME_ERROR)}
        WHEN r % 9 = 4 THEN 'branch head not found'
        WHEN r % 12 = 6 THEN {quoted(fixed.TRUNCATED_TREE_ERROR)} END AS error FROM repos)"""
TREE_FILES = f"""docs AS (SELECT *, {c.REPO} AS r, {c.PATH} AS path, {c.CONTENT} AS content FROM documents),
    wanted AS (
      SELECT s.repo, s.branch, s.head AS commit_sha,
        p.path AS file_path, d.doc_id, d.content
      FROM tree_state s JOIN docs d ON d.r = s.r,
        unnest(CASE WHEN d.doc_id % 6 = 1 THEN [d.path, concat('copy/', d.path)] ELSE [d.path] END) AS p(path)
      WHERE s.error IS NULL AND d.doc_id % 13 <> 3
        AND (d.doc_id % 17 = 2 OR d.n_chars <= 1000000)
        AND NOT {any_glob('p.path', fixed.DEFAULT_EXCLUDES)}),
    lost AS (SELECT DISTINCT repo, branch FROM wanted WHERE doc_id % 211 = 5),
    tree_units AS (
      SELECT repo, file_path, commit_sha, content FROM wanted
      WHERE repo NOT IN (SELECT repo FROM lost) AND doc_id % 19 <> 4 AND doc_id % 23 <> 7)"""
TREE_UNITS = ",\n    ".join([REPOS, TREE_STATE, TREE_FILES, "units AS (SELECT * FROM tree_units)"])

HISTORY_STATE = f"""history_state AS (SELECT *, CASE WHEN r % 10 = 7 THEN {quoted(fixed.BAD_REPO_NAME_ERROR)}
        WHEN r % 8 = 5 THEN 'commit listing not found' END AS error FROM repos)"""
PATCH_LINES = f"""patch_docs AS (
      SELECT doc_id, {c.REPO} AS r, {c.PATH} AS file_path, {c.COMMIT_SHA} AS commit_sha,
        string_split({c.CONTENT}, chr(10)) AS all_lines, {c.LAST_LINE} AS last_line FROM documents),
    hunk_one AS (
      SELECT doc_id, n, concat(CASE (n - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN ' ' ELSE '-' END, l) AS line
      FROM patch_docs, unnest(all_lines) WITH ORDINALITY AS t(l, n)),
    hunk_one_new AS (
      SELECT doc_id, line, doc_id % 50 + row_number() OVER (PARTITION BY doc_id ORDER BY n) AS line_number
      FROM hunk_one WHERE line NOT LIKE '-%' AND line NOT LIKE '+++%'),
    added AS (
      SELECT doc_id, line_number, substr(line, 2) AS line FROM hunk_one_new WHERE line LIKE '+%'
      UNION ALL
      SELECT doc_id, 7 + doc_id % 50 + len(all_lines) + n, l
      FROM patch_docs, unnest(string_split(last_line, chr(10))) WITH ORDINALITY AS t(l, n))"""


def sparse(group: str = "doc_id") -> str:
    return f"""sparse AS (
      SELECT {group}, array_to_string(list_transform(range(1, max_line + 1),
          lambda i: coalesce(m[i], '')), chr(10)) AS content
      FROM (SELECT {group}, max(line_number) AS max_line, map(list(line_number), list(line)) AS m
            FROM added GROUP BY {group}))"""


HISTORY_UNITS = f"""history_ranked AS (
      SELECT s.repo, s.branch, d.doc_id, d.commit_sha, d.file_path,
        row_number() OVER (PARTITION BY s.repo ORDER BY d.doc_id % 25) AS rn
      FROM history_state s JOIN patch_docs d ON d.r = s.r WHERE s.error IS NULL),
    history_wanted AS (SELECT * FROM history_ranked WHERE rn <= 50),
    history_lost AS (SELECT DISTINCT repo, branch FROM history_wanted WHERE doc_id % 199 = 9),
    history_kept AS (
      SELECT * FROM history_wanted WHERE repo NOT IN (SELECT repo FROM history_lost)
        AND doc_id % 15 <> 2 AND NOT {any_glob('file_path', fixed.DEFAULT_EXCLUDES)})"""


def history_sql() -> str:
    return ",\n    ".join(
        [
            REPOS,
            HISTORY_STATE,
            PATCH_LINES,
            sparse(),
            HISTORY_UNITS,
            """units AS (SELECT k.repo, k.file_path, k.commit_sha, s.content
      FROM history_kept k JOIN sparse s USING (doc_id))""",
            lines_cte(),
            regex_cte(),
            entropy_cte(),
            findings_cte(BOTH),
        ]
    )
