"""Text functions as Column expressions: tokenizers, shingles, patterns, names and classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_tokens(name: Column) -> Column:
    """Lower-case parts of an identifier: split at underscores, lower-to-upper edges and after acronyms."""
    parts = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.regexp_replace(parts, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(parts, "[_\\s]+", " ")), " "), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Words of a text, each split further at underscores, hyphens and camel edges."""
    parts = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(parts, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def char_ngrams(text: Column, n: int) -> Column:
    """All windows of ``n`` characters of the lower-cased text, in order; a shorter text has none."""
    low = F.lower(text)
    return F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """The set of windows of three characters, sorted."""
    return F.array_sort(F.array_distinct(char_ngrams(text, 3)))


def shingles(text: Column, k: int = 5) -> Column:
    """The set of windows of ``k`` characters; a shorter text is its own only shingle."""
    windows = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.when(F.length(text) >= k, windows).otherwise(F.array(text)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union; two empty sets give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def normalized_code(code: Column) -> Column:
    """Code without line and block comments, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(code, "(?s)/\\*.*?\\*/", ""), "//[^\\n]*", "")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r]+", " "))


# Names that mean one type.
TYPE_ALIASES = {"str": "string", "int": "integer", "bool": "boolean", "float": "number", "double": "number", "dict": "map", "list": "array"}


def normalized_type(name: Column, custom: dict[str, str] | None = None) -> Column:
    """Custom mapping, else lower case, alias and without its package."""
    low = F.lower(name)
    bare = F.element_at(F.split(low, "\\."), -1)
    out = bare
    for old, new in TYPE_ALIASES.items():
        out = F.when(bare == old, F.lit(new)).otherwise(out)
    for old, new in (custom or {}).items():
        out = F.when(name == old, F.lit(new)).otherwise(out)
    return out


def wildcard_match(pattern: Column, text: Column) -> Column:
    """``*`` matches any run; anchored, case-insensitive; an empty or null side never matches."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    regex = F.concat(F.lit("(?is)^"), F.regexp_replace(quoted, r"\*", ".*"), F.lit("$"))
    return F.coalesce((F.length(pattern) > 0) & (F.length(text) > 0) & F.regexp_like(text, regex), F.lit(False))


def search_pattern(pattern: str) -> str:
    """Regex of a search wildcard: the end is anchored only where no star ends the pattern, the start always."""
    import re

    body = ".*".join(re.escape(p) for p in pattern.rstrip("*").split("*"))
    return "^" + body + ("" if pattern.endswith("*") else "$")


def pattern_class(pattern: Column) -> Column:
    """``suffix`` for ``*x``, ``prefix`` for ``x*``, ``contains`` for ``*x*``, ``exact`` without stars, else ``complex``."""
    body = F.regexp_replace(pattern, r"^\*|\*$", "")
    return (
        F.when(body.contains("*") | (F.length(body) == 0), "complex")
        .when(pattern.startswith("*") & pattern.endswith("*"), "contains")
        .when(pattern.startswith("*"), "suffix").when(pattern.endswith("*"), "prefix").otherwise("exact")
    )


def fqn_of_path(path: Column) -> Column:
    """Dotted module name of a source path, without ``src`` and the extension."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), "^(.*/)?src/", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def fqn_parent(fqn: Column) -> Column:
    return F.when(fqn.contains("."), F.regexp_replace(fqn, r"\.[^.]*$", "")).otherwise("")


def fqn_name(fqn: Column) -> Column:
    return F.element_at(F.split(fqn, "\\."), -1)


def module_of(path: Column) -> Column:
    """The part after ``src``, otherwise the first part that does not start with a dot."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.startswith("."))
    place = F.array_position(parts, "src")
    return F.when((place > 0) & (place < F.size(parts)), F.try_element_at(parts, (place + 1).cast("int"))).otherwise(F.try_element_at(parts, F.lit(1)))


def is_test(path: Column, name: Column) -> Column:
    """Does a path or a name follow the conventions of tests?"""
    file = F.element_at(F.split(path, "/"), -1)
    return F.regexp_like(path, F.lit(r"(^|/)(tests?|__tests__|spec)/")) | F.regexp_like(file, F.lit(r"^test_|_test\.|\.test\.|\.spec\.")) | F.regexp_like(name, F.lit("^(test_|Test)|(_test|Test)$"))


def visibility(name: Column, language: Column) -> Column:
    """Python: dunder public, two underscores private, one internal; TypeScript: ``#`` private, ``_`` internal; Go: capitals public."""
    python = F.when(F.regexp_like(name, F.lit("^__.*__$")), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "internal").otherwise("public")
    typescript = F.when(name.startswith("#"), "private").when(name.startswith("_"), "internal").otherwise("public")
    go = F.when(F.regexp_like(name, F.lit("^[A-Z]")), "public").otherwise("internal")
    return F.when(language == "python", python).when(language.isin("typescript", "javascript"), typescript).when(language == "go", go).otherwise("public")


def token_estimate(text: Column) -> Column:
    """Three quarters of the words, at least one."""
    return F.greatest(F.lit(1), F.floor(F.size(F.filter(F.split(text, "\\s+"), lambda w: w != "")) * 0.75).cast("int"))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


# Patterns of query intents and their weights, the base of ``balanced``, question words, verbs and file endings.
INTENTS = {
    "symbol": (
        (r"\b(class|function|method|def)\s+\w+", 0.4), (r"\b(find|locate|show)\s+\w+", 0.3), (r"^[\w.]+$", 0.5), (r"::", 0.4), (r"\w+\.\w+", 0.3),
        (r"[A-Z][a-z]+(?:[A-Z][a-z]+)+", 0.3), (r"\w+_\w+", 0.2), (r"\b(enum|interface|type|protocol|struct)\s+\w+", 0.4), (r"\b(enum|interface|type)\b", 0.3),
    ),
    "flow": (
        (r"\b(call|trace|flow)\b", 0.5), (r"\bwho\s+calls?\b", 0.6), (r"\bwhere\s+used\b", 0.4), (r"\bcall\s+(chain|graph|path)\b", 0.5), (r"\bexecution\s+flow\b", 0.5),
        (r"\bdata\s+flow\b", 0.4), (r"\bfrom\s+\w+\s+to\s+\w+", 0.5), (r"\bcalls?\s+\w+", 0.4), (r"\bused\s+by\b", 0.4), (r"\bdepends?\s+on\b", 0.4),
    ),
    "concept": (
        (r"\bhow\s+(does|do|is)\b", 0.5), (r"\bwhat\s+(is|are)\b", 0.5), (r"\bexplain\b", 0.6), (r"\barchitecture\b", 0.5), (r"\bdesign\b", 0.4), (r"\bconcept\b", 0.5), (r"\bpattern\b", 0.3), (r"\bworks?\b", 0.3),
    ),
    "code": ((r"\bexample\b", 0.5), (r"\bimplement(ation)?\b", 0.5), (r"\bcode\s+(for|that)\b", 0.5), (r"\bloop\b", 0.3), (r"\bconditional\b", 0.3), (r"\balgorithm\b", 0.4), (r"\blogic\b", 0.3)),
}
BALANCED = 0.3
QUESTIONS, VERBS = ("how", "what", "why", "when", "where"), ("get", "set", "create", "delete", "update", "find")
SOURCE_FILE = r"\.(py|ts|js|go|java|rs)\b"


def intent_probabilities(query: Column) -> Column:
    """A map from intents to probabilities: sums of matching patterns (one at most), adjusted by the query as a whole, through a softmax.

    A lone identifier of at most two words speaks for symbol; question words or
    more than eight words for concept; two verbs or a source file for code;
    "from x to y" for flow.
    """
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")
    has = lambda pattern: F.regexp_like(query, F.lit(pattern))
    when = lambda condition, points: F.when(condition, points).otherwise(0.0)
    more = {
        "symbol": when((F.size(words) <= 2) & has(r"^[\w.]+$"), 0.5),
        "flow": when(has(r"(?i)\bfrom\s+\w+\s+to\s+\w+"), 0.5),
        "concept": when(F.arrays_overlap(words, F.array(*map(F.lit, QUESTIONS))), 0.3) + when(F.size(words) > 8, 0.3),
        "code": when(F.size(F.filter(words, lambda w: w.isin(*VERBS))) >= 2, 0.3) + when(has(SOURCE_FILE), 0.4),
    }
    weight = {"balanced": F.exp(F.lit(BALANCED))}
    for intent, patterns in INTENTS.items():
        found = sum((when(has(f"(?i){p}"), points) for p, points in patterns), F.lit(0.0))
        weight[intent] = F.exp(F.least(F.lit(1.0), found) + more[intent])
    total = sum(weight.values(), F.lit(0.0))
    return F.create_map(*[x for intent in (*INTENTS, "balanced") for x in (F.lit(intent), weight[intent] / total)])


def rule_intent(query: Column) -> Column:
    """The most probable intent; ties go to symbol, flow, code, concept, balanced."""
    p = intent_probabilities(query)
    best, out = F.greatest(*[p[i] for i in (*INTENTS, "balanced")]), F.lit("balanced")
    for intent in ("concept", "code", "flow", "symbol"):
        out = F.when(p[intent] == best, F.lit(intent)).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """Regex of an ignore glob: ``**`` spans folders, ``*`` stays inside one."""
    import re

    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", pattern):
        out += {"**": ".*", "**/": "(.*/)?", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return f"(^|.*/){out}$" if "/" not in pattern else f"^{out}$"


def subsumes(wide: Column, narrow: Column) -> Column:
    """Does pattern ``wide`` match all that ``narrow`` does?  Equal: yes; ``*``: yes; a literal: only itself."""
    return (wide == narrow) | (wide == "*") | (~narrow.contains("*") & wide_matches(wide, narrow))


def wide_matches(wide: Column, literal: Column) -> Column:
    return wide.contains("*") & wildcard_match(wide, literal)


def scip_descriptor(scheme: Column, manager: Column, package: Column, version: Column, symbol: Column) -> Column:
    """The parts joined by spaces; an absent part is a dot."""
    return F.concat_ws(" ", *[F.coalesce(F.when(c != "", c), F.lit(".")) for c in (scheme, manager, package, version)], symbol)
