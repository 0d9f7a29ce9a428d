"""Detection: from texts to redacted findings in one narrow pass.

Every step is row-local, so the texts are read once and never shuffled.

1. *Gate.*  Cheap necessary conditions, mostly literal searches, decide which
   detectors could find anything in a text.  Most texts leave here.
2. *Search.*  Each remaining (text, detector) pair is searched once; the result
   is an array of ``line:value`` strings, distinct and in match order.
3. *Emit.*  The array is exploded, scored, filtered, redacted.

The unredacted value exists only in columns between 2 and 3.

A text that a detector cannot deal with is a row with an ``error``, never the
end of a job: a match or a padded text longer than any report, or a search that
takes too long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve import fixed_values as fixed
from credsieve.functions import paths, text
from credsieve.functions.pyregex import search_pattern
from credsieve.operators import deepsearch, literals, longtexts
from credsieve.operators.catalogue import (
    DEFAULT_CATALOGUE,
    LEAST_GAP,
    SHORTEST_RUN,
    Signature,
    by_ordinal,
    sql_text,
)

UNIT_KEYS = ("repo", "file_path", "commit_sha")
FINDING_COLUMNS = (
    "repo",
    "file_path",
    "line_number",
    "matched_text",
    "detection_method",
    "pattern_name",
    "confidence",
    "commit_sha",
    "entropy_score",
)
ORDER_COLUMNS = ("detector_ord", "pattern_ord", "match_ord")
# Where scans of repositories found a unit: in the listing, the history, the tree or commit.
PLACE_COLUMNS = ("repo_pos", "commit_pos", "unit_ord")

REGEX, ENTROPY = 1, 2
# Stands for the entropy detector among the ordinals of the signatures.
ENTROPY_ORD = 0
# The directives begin with s or p; long s is what case folding adds to them.
_DIRECTIVE = search_pattern(fixed.IGNORE_DIRECTIVE_FORMAT, r"(?=[sSpP\x{17f}])")
# The class is spelled out character by character: the JVM then tests it with one
# table look-up instead of a chain of ranges.
_CLASS = f"[{fixed.TOKEN_CHARACTERS}]"
_RUNS = f"{_CLASS}{{{SHORTEST_RUN},}}"
# A run can only start where the previous character is outside the class; saying
# so spares the search from retrying inside every short run.
_HAS_TOKEN = f"(?<!{_CLASS}){_CLASS}{{{fixed.TOKEN_RUN_LENGTH}}}"
_TOKEN = f"(?<!{_CLASS}){_CLASS}{{{fixed.TOKEN_RUN_LENGTH},}}"
# Marks a match in a text that does not hold this noncharacter itself.
_MARK = "\uffff"
# Blank lines that stand for a gap in a sparse text.  A longer gap is searched as
# one of this length by the signatures to which that makes no difference, and by
# them alone; line numbers and matched values are those of the whole text.
LONGEST_GAP = LEAST_GAP

# A match of more characters, or a text of more blank lines that a signature has
# to see, is not reported but an error of its unit.
LONGEST_MATCH = 1 << 26
MATCH_ERROR = "match too long to be reported"
GAP_ERROR = "text with too many blank lines for a signature that counts them"

Detector = Callable[[DataFrame], DataFrame]
_OWN_COLUMNS = FINDING_COLUMNS[2:7] + FINDING_COLUMNS[8:]


@dataclass(frozen=True)
class EntropyOptions:
    """Thresholds in bits per character; both comparisons are strict."""

    threshold: float = fixed.ENTROPY_THRESHOLD
    hex_threshold: float = fixed.HEX_ENTROPY_THRESHOLD
    min_length: int = fixed.MIN_TOKEN_LENGTH
    excluded_globs: tuple[str, ...] = fixed.ENTROPY_EXCLUDED_GLOBS

    @classmethod
    def with_threshold(cls, threshold: float) -> EntropyOptions:
        """Override the threshold; the one for hex tokens scales with it."""
        if threshold <= 0:
            raise ValueError("a threshold of 0 bits or less would report every token")
        scale = fixed.HEX_ENTROPY_THRESHOLD / fixed.ENTROPY_THRESHOLD
        return cls(threshold=threshold, hex_threshold=threshold * scale)


@dataclass(frozen=True)
class DetectOptions:
    """Which detectors run, and how: no catalogue or no entropy turns one off.

    ``search_seconds`` bounds how long one text may be searched for a signature
    that repeats groups (see ``deepsearch``).  ``own`` holds further detectors: functions from units (their keys, content
    and ``line_nos``) to findings, that is, the same keys with line_number,
    matched_text (redacted), detection_method, pattern_name, confidence and
    entropy_score.  Their findings come after those of the built-in detectors.

    A catalogue of ``index_from`` signatures or more is a table that texts look
    up by the literals they hold (see ``literals``); a smaller one is unrolled
    into expressions.  Both find the same.

    With ``cut_chars``, texts of more than twice as many bytes are cut into
    pieces of about as many characters, which are dealt out (see ``longtexts``).
    That finds the same, but reads the table of texts a second time.
    """

    catalogue: Sequence[Signature] = DEFAULT_CATALOGUE
    entropy: EntropyOptions | None = field(default_factory=EntropyOptions)
    own: Sequence[Detector] = ()
    search_seconds: float = deepsearch.SECONDS
    index_from: int = 100
    cut_chars: int = 0

    @property
    def indexed(self) -> bool:
        return bool(self.catalogue) and len(self.catalogue) >= self.index_from

    @property
    def deep(self) -> tuple[int, ...]:
        """Ordinals of the signatures that the JVM could only search with a stack that grows with the text."""
        return tuple(i for i, s in enumerate(self.catalogue, start=1) if s.deep)


def is_suppressed(line: Column) -> Column:
    """The line carries an inline directive that silences it."""
    return line.rlike(_DIRECTIVE)


def may_be_suppressed(content: Column) -> Column:
    """Some line may carry a directive; both kinds hold one of these endings."""
    return content.rlike("[rRaA]:") & is_suppressed(content)


def is_noise_line(line: Column) -> Column:
    """Embedded images and minified code yield tokens that are not secrets."""
    lowered = F.lower(line)
    image = lowered.contains("data:image/") & lowered.contains("base64,")
    semicolons = F.char_length(line) - F.char_length(F.replace(line, F.lit(";"), F.lit("")))
    minified = (F.char_length(line) > fixed.MINIFIED_LINE_LENGTH) & (
        semicolons > fixed.MINIFIED_LINE_SEMICOLONS
    )
    return image | minified


def secret_candidate(token: Column, min_length: int = fixed.MIN_TOKEN_LENGTH) -> Column:
    """Trim a token, then narrow ``name=value`` to a value that is long enough."""
    trimmed = F.trim(token, F.lit("."))
    value = F.regexp_extract(trimmed, fixed.ASSIGNMENT_FORMAT, 1)
    return F.when(F.char_length(value) >= min_length, value).otherwise(trimmed)


def is_dotted_namespace(token: Column) -> Column:
    """Import paths such as ``a.b.C``: short identifiers joined by dots."""
    segments = F.split(token, r"\.", -1)
    return (F.size(segments) >= fixed.NAMESPACE_MIN_SEGMENTS) & F.forall(
        segments,
        lambda s: s.rlike(fixed.NAMESPACE_SEGMENT_FORMAT)
        & (F.char_length(s) <= fixed.NAMESPACE_MAX_SEGMENT_LENGTH),
    )


def entropy_threshold(token: Column, options: EntropyOptions) -> Column:
    return F.when(token.rlike(fixed.HEX_FORMAT), F.lit(options.hex_threshold)).otherwise(
        F.lit(options.threshold)
    )


def _entropy_candidates(lines: Column, line_nos: Column, min_length: int) -> Column:
    """``line::candidate`` strings of all lines, in order."""

    def of_line(line: Column, index: Column) -> Column:
        number = F.coalesce(F.get(line_nos, index), index + 1).cast("string")

        def of_tokens(tokens: Column) -> Column:
            wanted = (F.size(tokens) > 0) & ~is_noise_line(line) & ~is_suppressed(line)
            found = F.transform(
                tokens, lambda t: F.concat(number, F.lit("::"), secret_candidate(t, min_length))
            )
            return F.when(wanted, found).otherwise(F.array().cast("array<string>"))

        return text.bind(F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0)), of_tokens)

    return F.flatten(F.transform(lines, of_line))


def _match_lines(gaps: Column, matches: Column) -> Column:
    """Line number of every match, from the pieces between the matches.

    Each piece is reduced to its line feeds and each match is marked by ``#``
    ahead of its own; counting marks per line then takes one linear pass.
    """

    def feeds(piece: Column) -> Column:
        others = F.octet_length(F.replace(piece, F.lit("\n"), F.lit("")))
        return F.repeat(F.lit("\n"), F.octet_length(piece) - others)

    marked = F.zip_with(
        F.slice(gaps, 1, F.size(gaps) - 1),
        matches,
        lambda gap, match: F.concat(feeds(gap), F.lit("#"), feeds(match)),
    )
    per_line = F.split(F.array_join(marked, ""), "\n", -1)
    return F.flatten(
        F.transform(per_line, lambda m, i: F.array_repeat(i + 1, F.char_length(m)))
    )


def _gates(options: DetectOptions, entropy_allowed: Column) -> Column:
    """Ordinals of the detectors worth running: 0 for entropy, else the signature."""
    checks = []
    index = literals.by_literal(options.catalogue) if options.indexed else {}
    if index:
        checks.append(literals.occurring(F.col("content"), index))
    known = {i for ordinals in index.values() for i in ordinals}
    cases = [
        f"case when {s.may_occur()} then {i} end"
        for i, s in enumerate(options.catalogue, start=1)
        if i not in known
    ]
    if cases:
        checks.append(F.expr(f"array({', '.join(cases)})"))
    if options.entropy:
        checks.append(F.array(F.when(entropy_allowed & F.col("runs").rlike(_HAS_TOKEN), 0)))
    return F.array_compact(F.concat(*checks))


def detect(
    units: DataFrame,
    options: DetectOptions = DetectOptions(),
    keys: Sequence[str] = UNIT_KEYS,
    path: str | None = "file_path",
    errors: bool = False,
) -> DataFrame:
    """Findings of all detectors for every row of ``units``.

    ``units`` has the columns ``keys`` and ``content``.  An optional
    ``line_nos`` array gives the true number of each line of a sparse text (see
    ``history``).  ``path`` names the column that decides whether the entropy
    detector looks at a text; None applies it to all.

    With ``errors``, there is a column ``error`` as well, and a row with nothing
    else but the keys for each text and detector that could not be searched
    completely.  A unit that comes with a ``problem`` of its own is not searched;
    the problem is its error.
    """
    if "line_nos" not in units.columns:
        units = units.withColumn("line_nos", F.lit(None).cast("array<bigint>"))
    if "problem" not in units.columns:
        units = units.withColumn("problem", F.lit(None).cast("string"))
    parts = [
        _own_findings(detector(units.select(*keys, "content", "line_nos")), keys, ENTROPY + i)
        for i, detector in enumerate(options.own, start=1)
    ]
    if options.catalogue or options.entropy:
        parts.insert(0, (_in_pieces if options.cut_chars else _built_in)(units, options, keys, path))
    if not parts:
        raise ValueError("no detector is turned on")
    rows = reduce(DataFrame.unionByName, parts)
    return rows if errors else rows.where(F.col("error").isNull()).drop("error")


def _own_findings(found: DataFrame, keys: Sequence[str], ordinal: int) -> DataFrame:
    return found.select(
        *keys, *_OWN_COLUMNS, F.lit(ordinal).alias("detector_ord"), F.lit(0).alias("pattern_ord"),
        F.lit(0).alias("match_ord"), F.lit(None).cast("string").alias("error"),
    ).withColumn("line_number", F.col("line_number").cast("bigint"))


def _in_pieces(
    units: DataFrame, options: DetectOptions, keys: Sequence[str], path: str | None
) -> DataFrame:
    """``_built_in`` with long texts in pieces; the order of the matches of a text stays as it is."""
    long = longtexts.is_long(options.cut_chars)
    columns = list(dict.fromkeys([*keys, path] if path else keys))
    whole = not all(s.local for s in options.catalogue)
    pieces = longtexts.pieces(units.where(long), columns, options.cut_chars, whole)
    found = _built_in(pieces, options, [*keys, *longtexts.PIECE_COLUMNS], path)
    # a piece has fewer matches than characters
    found = found.withColumn("match_ord", F.col("match_ord") + F.col("chars_before")).withColumn(
        "line_number", F.col("line_number") + F.col("feeds_before")
    )
    return _built_in(units.where(~long), options, keys, path).unionByName(found.drop(*longtexts.PIECE_COLUMNS))


def _built_in(
    units: DataFrame, options: DetectOptions, keys: Sequence[str], path: str | None
) -> DataFrame:
    entropy = options.entropy or EntropyOptions()
    allowed = (
        ~paths.entropy_excluded(F.col(path), entropy.excluded_globs) if path else F.lit(True)
    )

    # Long token runs are a small part of most texts; nearly all gates look only
    # at them.  Without signatures the one remaining gate reads the text itself.
    runs = F.col("content")
    if options.catalogue:
        runs = F.array_join(F.regexp_extract_all(runs, F.lit(_RUNS), F.lit(0)), "\n")
    # explode_outer, not explode: the planner would otherwise repeat the gate in
    # a filter of its own and push it below a repartition of the texts.  A NULL
    # text passes no gate, so it needs no filter either; a unit with a problem
    # passes that on as its only row.
    gates = _gates(options, allowed)
    if "local" in units.columns:
        local = [ENTROPY_ORD, *(i for i, s in enumerate(options.catalogue, start=1) if s.local)]
        gates = F.filter(gates, lambda ordinal: ordinal.isin(local) == F.col("local"))
    gates = F.when(F.col("problem").isNotNull(), F.array(F.lit(0))).otherwise(gates)
    gated = (
        units.withColumn("runs", runs)
        .withColumn("ords", gates)
        .select(*keys, "content", "line_nos", "problem", F.explode_outer("ords").alias("pattern_ord"))
        .where(F.col("pattern_ord").isNotNull())
    )
    ordinal = F.col("pattern_ord")
    is_entropy = ordinal == 0

    # Signatures may span lines, so they see a sparse text with its blank lines:
    # all of them where their number may decide what is found.
    strict = [i for i, s in enumerate(options.catalogue, start=1) if not s.elastic]
    is_strict = ordinal.isin(strict)
    full = F.when(is_entropy | F.col("line_nos").isNull(), F.col("content"))
    problem = F.col("problem")
    if strict:
        too_long = is_strict & (F.element_at("line_nos", -1) > LONGEST_MATCH)
        problem = F.coalesce(problem, F.when(too_long, F.lit(GAP_ERROR)))
        full = full.when(too_long, None).when(is_strict, sparse_text(F.col("content"), F.col("line_nos"), None))
    full = full.otherwise(sparse_text(F.col("content"), F.col("line_nos")))
    texts = gated.select(*keys, "line_nos", "pattern_ord", full.alias("content"), problem.alias("problem"))
    named = ["signature"] if options.indexed else []
    if options.indexed:
        texts = literals.with_signatures(texts, options.catalogue)
    if options.deep:
        texts = deepsearch.searched(texts, options.catalogue, options.deep, options.search_seconds)

    content = F.col("content")
    found = texts.select(
        *keys,
        *named,
        "line_nos",
        "pattern_ord",
        "problem",
        F.when(is_entropy | may_be_suppressed(content), text.raw_lines(content)).alias("lines"),
        F.when(~is_entropy & ~is_strict, _true_numbers(F.col("line_nos"))).alias("true_nos"),
        *_signature_columns(options),
    )
    values = F.when(
        is_entropy, _entropy_candidates(F.col("lines"), F.col("line_nos"), entropy.min_length)
    ).otherwise(_signature_values())
    hits = (
        found.select(*keys, *named, "pattern_ord", F.inline_outer(_scored(values, is_entropy, entropy)))
        .where(F.col("entropy_score").isNotNull())
        .where(
            ~is_entropy
            | F.col("error").isNotNull()
            | (F.col("entropy_score") > entropy_threshold(F.col("value"), entropy))
        )
    )
    return hits.select(*keys, *_labels(options, ordinal, is_entropy))


def _signature_columns(options: DetectOptions) -> list[Column]:
    """Whole matches, the pieces between them, and the reported values."""
    if not options.catalogue:
        nothing = F.lit(None).cast("array<string>")
        return [nothing.alias(c) for c in ("matches", "gaps", "narrowed")]
    if options.indexed:
        return _looked_up_columns(options)
    deep = set(options.deep)
    patterns = {i: sql_text(s.jvm_pattern) for i, s in enumerate(options.catalogue, start=1) if i not in deep}

    def chosen(sql: Callable[[int], str], of_deep: str) -> Column:
        return by_ordinal([of_deep if i in deep else sql(i) for i in range(1, len(options.catalogue) + 1)])

    matches = chosen(lambda i: f"regexp_extract_all(content, {patterns[i]}, 0)", "deep.matches")
    # Marking the matches reuses one compiled pattern for all texts, which
    # splitting by the pattern itself does not; that is left for texts that hold
    # the mark.
    marked = chosen(lambda i: f"regexp_replace(content, {patterns[i]}, '{_MARK}')", "null")
    content = F.col("content")
    split = F.when(
        content.contains(_MARK), F.split(content, chosen(lambda i: patterns[i], "null"), -1)
    ).otherwise(F.split(marked, _MARK, -1))
    gaps = F.coalesce(F.col("deep.gaps"), split) if deep else split
    secret = [s.group for s in options.catalogue]
    narrowed = chosen(
        lambda i: f"regexp_extract_all(content, {patterns[i]}, {secret[i - 1]})" if secret[i - 1] else "cast(null as array<string>)",
        "deep.narrowed",
    )
    return [matches.alias("matches"), gaps.alias("gaps"), narrowed.alias("narrowed")]


def _looked_up_columns(options: DetectOptions) -> list[Column]:
    """The same, with the pattern that stands next to each text."""
    content, pattern, group = F.col("content"), F.col("signature.pattern"), F.col("signature.grp")
    deep = F.col("pattern_ord").isin(list(options.deep)) if options.deep else F.lit(False)
    searched = F.when(~deep, pattern)
    matches = F.regexp_extract_all(content, searched, F.lit(0))
    split = F.when(content.contains(_MARK), F.split(content, searched, -1)).otherwise(
        F.split(F.regexp_replace(content, searched, F.lit(_MARK)), _MARK, -1)
    )
    narrowed = F.when(group > 0, F.regexp_extract_all(content, searched, F.greatest(group, F.lit(0))))
    columns = {"matches": matches, "gaps": split, "narrowed": narrowed}
    if options.deep:
        columns = {name: F.when(deep, F.col(f"deep.{name}")).otherwise(column) for name, column in columns.items()}
    return [column.alias(name) for name, column in columns.items()]


def _signature_values() -> Column:
    """``line:feeds:value`` strings of the matches that are neither empty nor suppressed.

    ``feeds`` is empty for a value that is as it stands in the text, else how
    many line feeds stand for each one of it, because a gap was shortened.
    """
    values = F.coalesce(F.col("narrowed"), F.col("matches"))
    numbers = _match_lines(F.col("gaps"), F.col("matches"))

    def keyed(number: Column, value: Column) -> Column:
        # The directive is looked up by the line-feed number in the full split.
        line = F.get(F.col("lines"), number - 1)
        dropped = (value == "") | F.coalesce(is_suppressed(line), F.lit(False))
        true = F.coalesce(F.get(F.col("true_nos"), number - 1), number)
        shortened = F.col("true_nos").isNotNull() & value.contains("\n")
        feeds = F.when(shortened, _true_feeds(value, number)).otherwise(F.lit(""))
        return F.when(~dropped, F.concat(true.cast("string"), F.lit(":"), feeds, F.lit(":"), value))

    return F.array_compact(F.zip_with(numbers, values, keyed))


def _true_feeds(value: Column, number: Column) -> Column:
    """Line feeds of the whole text for each one of a match that begins on a line of the searched text, joined."""

    def ahead(i: Column) -> Column:
        return F.get(F.col("true_nos"), number + i) - F.get(F.col("true_nos"), number - 1 + i)

    inner = F.slice(F.split(value, "\n", -1), 2, F.char_length(value))
    return F.array_join(F.transform(inner, lambda _, i: ahead(i).cast("string")), ",")


def _with_all_feeds(value: Column, feeds: Column) -> Column:
    """A match with the line feeds that were left out inside it."""
    return F.array_join(
        F.transform(
            F.split(value, "\n", -1),
            lambda line, i: F.when(i == 0, line).otherwise(
                F.concat(F.repeat(F.lit("\n"), F.get(feeds, i - 1).cast("int")), line)
            ),
        ),
        "",
    )


def _scored(values: Column, is_entropy: Column, options: EntropyOptions) -> Column:
    """Distinct ``line:feeds:value`` strings to structs with their entropy, and the problem of the text.

    Length and entropy follow from the value as searched and the number of line
    feeds that it lacks; what is too long to be reported is never put together.
    Candidates of the entropy detector that are too short or plain import paths
    get no score.
    """
    unknown = F.lit(None).cast("string")

    def parsed(found: Column) -> Column:
        line, feeds = F.substring_index(found, ":", 1), F.get(F.split(found, ":", 3), 1)
        start = F.char_length(line) + F.char_length(feeds) + 3
        numbers = F.when(feeds != "", F.transform(F.split(feeds, ","), lambda n: n.cast("bigint")))
        return F.struct(
            line.cast("bigint").alias("line_number"),
            F.substring(found, start, F.char_length(found)).alias("value"),
            numbers.alias("feeds"),
            F.coalesce(F.aggregate(numbers, F.lit(0).cast("bigint"), lambda n, x: n + x - 1), F.lit(0)).cast("bigint").alias("left_out"),
        )

    def scored(hit: Column, index: Column) -> Column:
        value, left_out = hit["value"], hit["left_out"]
        plausible = (F.char_length(value) >= options.min_length) & ~is_dotted_namespace(value)
        fits = F.char_length(value) + left_out <= LONGEST_MATCH
        whole = F.when(left_out > 0, _with_all_feeds(value, hit["feeds"])).otherwise(value)
        return F.struct(
            index.alias("match_ord"),
            hit["line_number"].alias("line_number"),
            value.alias("value"),
            F.when(fits, text.redact(whole)).alias("matched_text"),
            F.when(~is_entropy | plausible, text.shannon_entropy(value, left_out)).alias("entropy_score"),
            F.when(~fits, F.lit(MATCH_ERROR)).otherwise(unknown).alias("error"),
        )

    none = F.lit(None).cast("string")
    problem = F.struct(
        F.lit(0).alias("match_ord"), F.lit(None).cast("bigint").alias("line_number"), none.alias("value"),
        none.alias("matched_text"), F.lit(0.0).alias("entropy_score"), F.col("problem").alias("error"),
    )
    hits = F.transform(F.transform(F.array_distinct(values), parsed), scored)
    return F.when(F.col("problem").isNotNull(), F.array(problem)).otherwise(hits)


def _labels(options: DetectOptions, ordinal: Column, is_entropy: Column) -> list[Column]:
    if options.indexed:
        names, confidences = F.col("signature.name"), F.col("signature.confidence")
    else:
        names = by_ordinal([sql_text(s.name) for s in options.catalogue])
        confidences = by_ordinal([sql_text(s.confidence) for s in options.catalogue])
    # an error says nothing but its keys
    sound = lambda c: F.when(F.col("error").isNull(), c)
    return [
        sound(F.col("line_number")).alias("line_number"),
        F.col("matched_text"),
        sound(F.when(is_entropy, "entropy").otherwise("regex")).alias("detection_method"),
        sound(F.when(is_entropy, fixed.ENTROPY_PATTERN_NAME).otherwise(names)).alias("pattern_name"),
        sound(F.when(is_entropy, fixed.ENTROPY_CONFIDENCE).otherwise(confidences)).alias("confidence"),
        sound(F.col("entropy_score")).alias("entropy_score"),
        F.when(is_entropy, ENTROPY).otherwise(REGEX).alias("detector_ord"),
        ordinal.alias("pattern_ord"),
        F.col("match_ord"),
        F.col("error"),
    ]


def _line_feeds(line_nos: Column, n: Column, i: Column, longest: int | None) -> Column:
    """Line feeds ahead of a line of a sparse text."""
    gap = n - F.when(i == 0, F.lit(1).cast("bigint")).otherwise(F.get(line_nos, i - 1))
    return gap if longest is None else F.least(gap, F.lit(longest).cast("bigint"))


def sparse_text(content: Column, line_nos: Column, longest: int | None = LONGEST_GAP) -> Column:
    """Put blank lines between the lines of ``content``, as many as their numbers say up to ``longest``.

    Without a bound, a gap that no string can hold is an error; ``detect`` asks before.
    """
    padded = F.zip_with(
        F.split(content, "\n", -1),
        F.transform(line_nos, lambda n, i: _line_feeds(line_nos, n, i, longest).cast("int")),
        lambda line, feeds: F.concat(F.repeat(F.lit("\n"), feeds), line),
    )
    return F.array_join(padded, "")


def _true_numbers(line_nos: Column) -> Column:
    """The number in the whole text of every line of its sparse text; NULL for whole texts."""
    first = F.lit(1).cast("bigint")
    return F.flatten(
        F.transform(
            line_nos,
            lambda n, i: F.sequence(n - _line_feeds(line_nos, n, i, LONGEST_GAP) + F.when(i == 0, first - 1).otherwise(first), n),
        )
    )


def regex_findings(
    units: DataFrame, catalogue: Iterable[Signature] = DEFAULT_CATALOGUE
) -> DataFrame:
    """Findings of the signature detector alone."""
    return detect(units, DetectOptions(catalogue=tuple(catalogue), entropy=None))


def entropy_findings(
    units: DataFrame, options: EntropyOptions = EntropyOptions()
) -> DataFrame:
    """Findings of the entropy detector alone."""
    return detect(units, DetectOptions(catalogue=(), entropy=options))
