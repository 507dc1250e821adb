"""Column functions for section text: ids, hashes, terms, keys and scores.

All are built-in expressions, so they stay in the JVM and inside the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script (Java's \s is ASCII only without the flag).
SPACE = r"(?U)\s+"
#: Maximal runs of word characters; matching them whole stands in for word boundaries.
RUN, DOTTED_RUN, FILE_RUN = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_.]+", r"[\p{L}\p{N}_.\-]+"
#: Only where no word character stands before; consumes nothing, so adjacent matches are all found.
_BEFORE = r"(?<![\p{L}\p{N}_])"

#: Words too general to relate two sections (fixed values).
GENERIC_TERMS = (
    "user", "users", "data", "info", "config", "configuration", "test", "tests", "section", "sections", "summary", "spec", "specs", "source", "value", "values",
    "input", "output", "field", "fields", "name", "names", "type", "types", "auth", "api", "url", "key", "keys", "id", "ids",
    "ユーザー", "データ", "設定", "認証", "テスト",
)
#: Words of state that count as identifiers, in alphabetical order, and parts that make a snake_case name one (fixed values).
STATUS_WORDS = ("blocked", "degraded", "dirty", "failed", "fresh", "optional", "pending", "required", "resolved", "stale", "success", "timeout")
WARNING_MARKERS = ("blocking", "conflict", "degraded", "diagnostic", "error", "failed", "freshness", "invalid", "missing", "pending", "required", "stale", "timeout", "warning")

#: Character ranges and the pattern of a search token (fixed values).
CJK = "一-龯ぁ-んァ-ンー"
TOKEN = rf"@[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+|[A-Za-z_][A-Za-z0-9_.\-]*|[0-9]+|[{CJK}]{{2,}}"

_all = lambda text, pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
_none = lambda: F.array().cast("array<string>")


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def slug(text: Column) -> Column:
    """Lower-case id part of a heading; 'section' if nothing is left."""
    s = F.lower(F.regexp_replace(F.regexp_replace(text, rf"[^0-9A-Za-z_{CJK}]+", "-"), "^-+|-+$", ""))
    return F.when(s == "", "section").otherwise(s)


def source_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def semantic_hash(text: Column) -> Column:
    """Equal for texts that differ in white space only."""
    return F.sha2(collapse(text), 256)


def stable_uid(document_id: Column, ordinal: Column) -> Column:
    """Survives a renamed heading, not a reordering."""
    return F.substring(F.sha2(F.concat(document_id, F.lit("\n"), F.format_string("%04d", ordinal)), 256), 1, 16)


def section_id(document_id: Column, ordinal: Column, heading: Column) -> Column:
    return F.concat(document_id, F.lit("#"), F.format_string("%04d", ordinal), F.lit("-"), F.coalesce(slug(heading), F.lit("document")))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) of ``name`` in a namespace given as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def fallback_summary(heading_path: Column, text: Column) -> Column:
    """'H1 / H2: first line with text', or the one of the two that is there."""
    heading = F.trim(F.array_join(F.coalesce(heading_path, _none()), " / "))
    line = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"([^\s][^\r\n]*)", 1))
    return F.when((heading != "") & (line != ""), F.concat(heading, F.lit(": "), line)).otherwise(F.when(heading != "", heading).otherwise(line))


def identifiers(heading_path: Column, text: Column, cap: int = 64) -> Column:
    """Code-shaped names of a section in a fixed order of kinds, without repetitions, at most ``cap``.

    Code spans, [tables], assigned keys, dotted names, calls, files, /paths,
    --options, UPPER and Pascal names, snake_case names of states and warnings,
    and the words of state.
    """
    t = F.concat_ws("\n", F.coalesce(heading_path, _none()), F.coalesce(text, F.lit("")))
    runs, full = _all(t, RUN), lambda pattern: lambda x: x.rlike(f"^(?:{pattern})$")
    strip = lambda x: F.regexp_replace(x, r"^\.+|\.+$", "")
    snake = F.filter(runs, lambda x: x.rlike("^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$") & x.rlike("|".join(WARNING_MARKERS)))
    found = F.concat(
        _all(t, r"`([^`\n]+)`", 1),
        _all(t, _BEFORE + r"\[([A-Za-z_][A-Za-z0-9_.\-]*)\]", 1),
        _all(t, r"(?m)^\s*([A-Za-z_][A-Za-z0-9_.\-]*)\s*=", 1),
        F.filter(F.transform(_all(t, DOTTED_RUN), strip), full(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+")),
        _all(t, _BEFORE + r"([A-Za-z_][A-Za-z0-9_]*\(\))", 1),
        F.filter(_all(t, FILE_RUN), full(r"[A-Za-z0-9_.\-]+\.(?:json|toml|ya?ml|md|py|txt|lock)")),
        _all(t, _BEFORE + r"(/[A-Za-z][A-Za-z0-9_\-]*)", 1),
        _all(t, _BEFORE + r"(--[A-Za-z0-9][A-Za-z0-9_\-]*)", 1),
        F.filter(runs, full("[A-Z][A-Z0-9_]{2,}")),
        F.filter(runs, full("[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*")),
        snake,
        F.array_intersect(F.array(*[F.lit(w) for w in STATUS_WORDS]), runs),
    )
    clean = F.filter(F.transform(found, lambda x: collapse(x)), lambda x: x != "")
    return F.slice(F.array_distinct(clean), 1, cap)


#: Shapes that make a key a code symbol rather than natural language (fixed values).
KEY_SHAPES = (
    r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Za-z_][A-Za-z0-9_]*\(\)|/[A-Za-z][A-Za-z0-9_\-]*|--[A-Za-z0-9][A-Za-z0-9_\-]*|[A-Z][A-Z0-9_]{2,}"
    r"|[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*|[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Za-z0-9_.\-]+\.(?:json|toml|ya?ml|md|py|txt|lock)"
)


def search_keys(keys: Column, names: Column, cap: int = 12) -> Column:
    """Natural-language keys: deduplicated, without identifiers, at most ``cap``."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(keys, _none()), collapse), lambda x: x != ""))
    return F.slice(F.filter(clean, lambda x: ~x.rlike(f"^(?:{KEY_SHAPES})$") & ~F.coalesce(F.array_contains(names, x), F.lit(False))), 1, cap)


def specific_terms(terms: Column) -> Column:
    """Terms of at least four characters that are neither numbers nor generic words."""
    generic = F.array(*[F.lit(w) for w in GENERIC_TERMS])
    keep = lambda x: (F.length(F.trim(x)) >= 4) & ~F.trim(x).rlike(r"^\p{Nd}+$") & ~F.array_contains(generic, F.lower(collapse(x)))
    return F.filter(F.coalesce(terms, _none()), lambda x: x.isNotNull() & keep(x))


def tokens(text: Column) -> Column:
    """Search tokens with repetitions: names, numbers, CJK runs and the bigrams of longer CJK runs."""
    t = F.regexp_replace(F.lower(text), "　", " ")
    grams = F.transform(_all(t, rf"[{CJK}]{{3,}}"), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: x.substr(i, F.lit(2))))
    return F.concat(_all(t, TOKEN), F.flatten(grams))


def embedding_text(heading_path: Column, summary: Column, keys: Column, names: Column) -> Column:
    """The non-empty ones of heading, summary, eight keys and eight identifiers, joined by ' | '."""
    joined = lambda a, sep: F.array_join(F.slice(F.coalesce(a, _none()), 1, 8), sep)
    part = lambda c: F.when(c != "", c)
    return F.concat_ws(" | ", part(F.array_join(F.coalesce(heading_path, _none()), " / ")), part(summary), part(joined(keys, ", ")), part(joined(names, ", ")))


def query_text(heading_path: Column, summary: Column, keys: Column, text: Column) -> Column:
    """The non-empty ones of heading, summary and keys, joined by ' | '; the text where all are empty."""
    part = lambda c: F.when(c != "", c)
    heading = F.array_join(F.filter(F.coalesce(heading_path, _none()), lambda x: x != ""), " / ")
    joined = F.concat_ws(" | ", part(heading), part(summary), part(F.array_join(F.coalesce(keys, _none()), " ")))
    return F.when(joined != "", joined).otherwise(F.coalesce(text, F.lit("")))


def has_body_text(text: Column) -> Column:
    """Whether a line has something on it and is no heading."""
    return F.coalesce(text, F.lit("")).rlike(r"(?mU)^\s*[^#\s]")


def char_grams(text: Column, n: int) -> Column:
    """All n-grams of the lower-cased text without white space."""
    # bound once as the only element of an array, so that no gram computes it again
    chars = F.array(F.regexp_extract_all(F.regexp_replace(F.lower(text), SPACE, ""), F.lit("(?s)."), F.lit(0)))
    gram = lambda c: lambda i: F.concat(*[F.get(c, i + k) for k in range(n)])
    return F.transform(chars, lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), gram(c))).otherwise(_none()))[0]


def identifier_parts(names: Column) -> Column:
    """Lower-cased names with their parts at separators and camel-case boundaries of two characters or more."""
    parts = F.transform(names, lambda x: F.split(x, r"[./:@#\-]+"))
    camel = F.transform(F.flatten(parts), lambda x: F.split(x, r"(?<=[a-z0-9])(?=[A-Z])"))
    every = F.concat(names, F.filter(F.concat(F.flatten(parts), F.flatten(camel)), lambda x: F.length(x) >= 2))
    return F.array_distinct(F.transform(every, F.lower))


def match_score(query_tokens: Column, haystack: Column) -> Column:
    """Share of the query's tokens that occur in the haystack; 0 without tokens."""
    hits = F.size(F.filter(query_tokens, lambda t: F.contains(haystack, t)))
    return F.when(F.size(query_tokens) > 0, hits / F.size(query_tokens)).otherwise(F.lit(0.0))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(F.lit(0))
