"""Fixed values.

Everything here must equal the published behaviour of the tool whose results
this engine reproduces: limits, path lists, formats and labels.  They are data,
kept together and in natural order.
"""

# --- limits -----------------------------------------------------------------
MAX_FILE_SIZE_BYTES = 1_000_000
MAX_HISTORY_COMMITS = 50
ENTROPY_THRESHOLD = 4.7
HEX_ENTROPY_THRESHOLD = 3.0
MIN_TOKEN_LENGTH = 21
NAMESPACE_MIN_SEGMENTS = 3
NAMESPACE_MAX_SEGMENT_LENGTH = 30
MINIFIED_LINE_LENGTH = 2000
MINIFIED_LINE_SEMICOLONS = 20

# --- token and line formats (Java regex dialect) ------------------------------
TOKEN_CHARACTERS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_./+=:-"
)
TOKEN_RUN_LENGTH = 21
ASSIGNMENT_FORMAT = r"^[A-Za-z0-9_.-]+[=:](.+)$"
HEX_FORMAT = r"^[0-9a-fA-F]+\z"
NAMESPACE_SEGMENT_FORMAT = r"^[A-Za-z_$][A-Za-z0-9_$]*\z"
# Python regex dialect, case-insensitive
IGNORE_DIRECTIVE_FORMAT = (
    r"(?i)secret-scanner:\s*(?:ignore|allow)|pragma:\s*allowlist\s+secret"
)
HUNK_HEADER_FORMAT = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"

# --- labels -------------------------------------------------------------------
ENTROPY_PATTERN_NAME = "High entropy token"
ENTROPY_CONFIDENCE = "medium"
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
CONFIDENCE_LEVEL = {"high": "error", "medium": "warning", "low": "note"}
FALLBACK_BRANCH = "main"
TRUNCATED_TREE_ERROR = (
    "GitHub returned a truncated tree; refusing to scan partial results"
)
BAD_REPO_NAME_ERROR = "repo_full_name must use the 'owner/repo' format"
EMPTY_REPORT_TEXT = "No findings detected."
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/"
    "Schemata/sarif-schema-2.1.0.json"
)
SARIF_FINGERPRINT_KEY = "secretScannerFingerprint/v1"

# --- paths never scanned --------------------------------------------------------
DEFAULT_EXCLUDES = (
    "package-lock.json",
    "npm-shrinkwrap.json",
    "yarn.lock",
    "pnpm-lock.yaml",
    "poetry.lock",
    "Pipfile.lock",
    "Gemfile.lock",
    "Cargo.lock",
    "composer.lock",
    "go.sum",
    "*.min.js",
    "*.map",
    ".secretscanner-baseline.json",
)

# --- directories pruned from file trees -------------------------------------------
PRUNED_DIRECTORIES = (
    ".git",
    "node_modules",
    ".venv",
    "venv",
    "__pycache__",
    ".mypy_cache",
    ".pytest_cache",
    ".ruff_cache",
    "build",
    "dist",
)
PRUNED_DIRECTORY_SUFFIX = ".egg-info"

# --- paths skipped by the entropy detector only -------------------------------------
ENTROPY_EXCLUDED_GLOBS = (
    "package-lock.json",
    "npm-shrinkwrap.json",
    "yarn.lock",
    "pnpm-lock.yaml",
    "poetry.lock",
    "Pipfile.lock",
    "Gemfile.lock",
    "Cargo.lock",
    "composer.lock",
    "go.sum",
    "*.min.js",
    "*.map",
    "*/node_modules/*",
    "node_modules/*",
    "*/site-packages/*",
    "site-packages/*",
    "*/vendor/*",
    "vendor/*",
    "*/dist/*",
    "dist/*",
    "*/build/*",
    "build/*",
    "*/.tox/*",
    "*/__pycache__/*",
    "*venv*/*",
    "*/.venv/*",
    ".venv/*",
    "*/tests/*",
    "tests/*",
    "*/test/*",
    "test/*",
    "*/__tests__/*",
    "*/spec/*",
    "spec/*",
    "*/specs/*",
    "*/fixtures/*",
    "fixtures/*",
    "*/__fixtures__/*",
    "*/__mocks__/*",
    "*/mocks/*",
    "*/testdata/*",
    "testdata/*",
    "test_*.*",
    "*_test.*",
    "*.test.*",
    "*.spec.*",
)
ENTROPY_EXCLUDED_SUFFIXES = (
    ".gif", ".jpg", ".jpeg", ".png", ".webp", ".ico", ".svg",
    ".pem", ".crt", ".cer", ".csv", ".tsv",
)
