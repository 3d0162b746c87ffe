"""Column expressions of the model: path classes, scores, matching and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of a path's extension.
LANGUAGES = {".py": "python", ".java": "java", ".md": "markdown", ".js": "javascript", ".ts": "typescript", ".go": "go", ".rs": "rust", ".kt": "kotlin", ".c": "c", ".cpp": "cpp"}
#: Extensions of code, and of what only tools read.
CODE_EXTENSIONS = (".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".java", ".kt", ".kts", ".go", ".rs")
NOISY_EXTENSIONS = (".lock", ".min.js")
#: The score of a symbol's kind.
KIND_SCORES = {"class": 600.0, "5": 600.0, "function": 500.0, "12": 500.0, "interface": 450.0, "11": 450.0, "method": 350.0, "6": 350.0}


def lookup(values: dict, key: Column, other) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), F.lit(other))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    return lookup(LANGUAGES, extension(path), "unknown")


def is_test_path(path: Column) -> Column:
    return F.regexp_like(path, F.lit(r"(^|/)(test|tests)/|(^|/)test_[^/]*$|_test\.[^/]*$"))


def contains_ci(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lit(query.lower()))


def occurrences_ci(text: Column, query: str) -> Column:
    """Non-overlapping occurrences, ignoring case."""
    low = F.lower(text)
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(query.lower()), F.lit("")))) / len(query)).cast("bigint")


def hash_fraction(*parts: Column) -> Column:
    """The first 32 bits of the SHA-1 of the parts joined by |, as a fraction of the greatest such value."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967295.0


def kind_score(kind: Column) -> Column:
    return lookup(KIND_SCORES, F.lower(kind), 0.0)


def path_score(path: Column, query: str) -> Column:
    """Rewards a file named like the query, source folders and code; punishes tests, build output and lock files."""
    low = F.lower(path)
    parts, name = F.split(low, "/"), F.regexp_extract(low, r"([^/]+)$", 1)
    score = F.when(F.regexp_replace(name, r"\.[^.]*$", "") == query.lower(), 1.0).otherwise(0.0)
    score += F.when(F.arrays_overlap(parts, F.array(*map(F.lit, ("src", "app", "core")))), 0.6).otherwise(0.0)
    score -= F.when(F.arrays_overlap(parts, F.array(*map(F.lit, ("test", "tests", "build", "dist")))), 0.7).otherwise(0.0)
    ends = lambda some: F.exists(F.array(*map(F.lit, some)), lambda x: F.endswith(name, x))
    return F.when(ends(NOISY_EXTENSIONS), score - 1.0).when(ends(CODE_EXTENSIONS), score + 0.3).otherwise(score)


def hierarchy_score(depth: Column, parent: Column, container: Column, query: str) -> Column:
    score = 1.0 / (1.0 + F.greatest(F.lit(0), depth)) + F.when(parent.isNotNull(), 0.2).otherwise(0.0)
    return F.least(F.lit(5.0), score + F.when(F.coalesce(contains_ci(container, query), F.lit(False)), 0.3).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def basis_points(part: Column, whole: Column) -> Column:
    """Truncated; 0 of an empty whole."""
    return F.when(whole == 0, F.lit(0)).otherwise((part * 10000 / whole).cast("bigint")).cast("bigint")


def regression_bps(baseline: Column, candidate: Column, lower_is_better: bool = False) -> Column:
    """How much worse the candidate is, in rounded basis points of the baseline; 0 without a positive baseline."""
    worse = candidate - baseline if lower_is_better else baseline - candidate
    return F.when(baseline > 0, F.bround(worse / baseline * 10000)).otherwise(0.0).cast("bigint")


def base_names(name: Column) -> Column:
    """Under which names a qualified name may be called: as it is, behind its last ::, and behind its last dot."""
    bare = F.trim(name)
    behind = lambda mark: F.when(F.contains(bare, F.lit(mark)), F.substring_index(bare, mark, -1))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(bare, behind("::"), behind(".")))))


def matches_target(name: Column, targets: list[str]) -> Column:
    """Whether a name is one of the targets, or ends in the same last dotted part as one."""
    return (name != "") & (name.isin(*targets) | F.substring_index(name, ".", -1).isin(*(x.rsplit(".", 1)[-1] for x in targets)))


#: Words that tell an error's code where it names none; all words of a row must occur, the first row counts.
ERROR_WORDS = (
    (("soft limit", "lsp"), "ERR_LSP_GLOBAL_SOFT_LIMIT"),
    (("slot exhausted", "lsp"), "ERR_LSP_SLOT_EXHAUSTED"),
    (("workspace contains", "no "), "ERR_LSP_WORKSPACE_MISMATCH"),
    (("project model missing",), "ERR_CONFIG_INVALID"),
    (("project not found",), "ERR_LSP_DOCUMENT_SYMBOL_FAILED"),
)
UNKNOWN_ERROR = "ERR_LSP_EXTRACT_FAILED"


def error_code(message: Column) -> Column:
    """The code that a message names in its first brackets or before its first colon, else the one its words tell."""
    text = F.trim(message)
    named = F.coalesce(*(F.when(F.startswith(x, F.lit("ERR_")), x) for x in (F.upper(F.trim(F.regexp_extract(text, r"^[^\[]*\[([^\]]*)\]", 1))), F.trim(F.split_part(text, F.lit(":"), F.lit(1))))))
    rows = F.array(*(F.struct(F.array(*map(F.lit, words)).alias("words"), F.lit(code).alias("code")) for words, code in ERROR_WORDS))
    told = F.filter(rows, lambda r: F.forall(r["words"], lambda w: F.contains(F.lower(text), w)))
    return F.coalesce(named, F.get(told, F.lit(0))["code"], F.lit(UNKNOWN_ERROR))


#: Codes of errors that do not pass.
PERMANENT_ERRORS = ("ERR_LSP_SERVER_MISSING", "ERR_LSP_SERVER_SPAWN_FAILED", "ERR_RUNTIME_MISMATCH", "ERR_CONFIG_INVALID", "ERR_LSP_WORKSPACE_MISMATCH")


def failure_kind(code: Column) -> Column:
    return F.when(code.isin(*PERMANENT_ERRORS), "PERMANENT_UNAVAILABLE").otherwise("TRANSIENT_FAIL")


#: Codes of an error that a wider scope may mend, and words that say so where the code leaves it open: those of any
#: code, and those of a failed symbol request besides.
SCOPE_ERRORS = ("ERR_LSP_FILE_NOT_IN_SCOPE", "ERR_LSP_SCOPE_ROOT_INVALID", "ERR_LSP_SCOPE_MISSING_MARKER", "ERR_LSP_SCOPE_DISCOVERY_TIMEOUT", "ERR_LSP_WORKSPACE_MISMATCH", "ERR_CONFIG_INVALID")
SCOPE_WORDS = ("not in scope", "scope root", "discovery timeout", "missing marker")
PROJECT_WORDS = ("no workspace contains", "project not found", "project model missing", "workspace contains")
#: The scope that follows a scope.
WIDER = {"module": "repo", "repo": "workspace"}


def widens_scope(code: Column, message: Column) -> Column:
    """Whether an error calls for a wider scope."""
    clean, low = F.upper(F.trim(code)), F.lower(F.trim(message))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.coalesce(clean.isin(*SCOPE_ERRORS) | says(SCOPE_WORDS) | ((clean == "ERR_LSP_DOCUMENT_SYMBOL_FAILED") & says(PROJECT_WORDS)), F.lit(False))


def wider_scope(level: Column) -> Column:
    """The scope after this one (none counts as module); null after the widest or an unknown one."""
    return lookup(WIDER, F.lower(F.trim(F.coalesce(level, F.lit("module")))), None)
