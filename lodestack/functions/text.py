"""Columns over paths, source text and answers: all built in, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of an extension.
EXTENSION_LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "dart": "dart",
    "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "sh": "shell",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    """By extension; unknown ones are ``unknown``."""
    pairs = [F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


#: Spellings of languages besides their names and extensions.
LANGUAGE_ALIASES = {"golang": "go", "python3": "python", "ansi-c": "c"}


def code_language(language: Column, path: Column) -> Column:
    """By extension, which all chunks of a file share; where that is unknown, by the normal name of the language given."""
    names = EXTENSION_LANGUAGE | LANGUAGE_ALIASES | {x: x for x in EXTENSION_LANGUAGE.values()}
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.nullif(language_of(path), F.lit("unknown")), F.element_at(F.create_map(*pairs), F.lower(F.trim(language))), F.lit("unknown"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def last_segments(path: Column, n: int) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "/")


def tokens(text: Column, factor: float = 1.0) -> Column:
    """A token for every four characters, rounded up; null and empty have none."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4 * factor).cast("long")


def preview(text: Column, n: int) -> Column:
    """One line of at most n characters, with an ellipsis where it was cut."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\n\r", "  ")
    return F.when(F.length(flat) > n, F.concat(F.trim(F.substring(flat, 1, n)), F.lit("..."))).otherwise(F.trim(flat))


def truncated(text: Column, budget: Column, notice: str) -> Column:
    """Cut to the budget in tokens, back to the last line end, else blank, else period in the last fifth; the notice comes on top."""
    limit = (budget * 4).cast("int")
    cut = F.substring(text, F.lit(1), limit)
    place = lambda mark: F.length(cut) - F.locate(mark, F.reverse(cut)) + 1
    found = lambda mark: (F.locate(mark, F.reverse(cut)) > 0) & (place(mark) - 1 > 0.8 * limit)
    kept = F.when(found("\n"), F.substring(cut, F.lit(1), place("\n") - 1)).when(found(" "), F.substring(cut, F.lit(1), place(" ") - 1)).when(found("."), F.substring(cut, F.lit(1), place("."))).otherwise(cut)
    return F.when(tokens(text) <= budget, text).otherwise(F.concat(kept, F.lit(notice)))


#: What is taken off Markdown, in this order.
MARKDOWN = [(r"\*\*([^*\n]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"`([^`\n]+)`", "$1"), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*[0-9]+\.[ \t]+", ""), (r"(?m)^#{1,6}[ \t]+", ""), (r"(?m)^>[ \t]*", ""), (r"(?m)^-{3,}$", ""), (r"\n{3,}", "\n\n")]


def plain(markdown: Column) -> Column:
    for pattern, to in MARKDOWN:
        markdown = F.regexp_replace(markdown, pattern, to)
    return F.regexp_replace(markdown, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


#: What the complexity of a text in any language counts.
CONTROL = r"\b(?:if|for|while|do|switch|try|catch|else|elif)\b"
FUNCTIONS = r"\bfunction\b|\b=>\b|\bdef\b|\bclass\b|\binterface\b"
OPERATORS, OPENERS = r"[+\-*/%=<>&^|!~?]+", r"[{\[(]"


def complexity(text: Column) -> Column:
    """2 a branch, 3 a function, a third a run of operators, half an opening bracket, both rounded down; at least 1."""
    total = 2 * matches(text, CONTROL) + 3 * matches(text, FUNCTIONS) + F.floor(matches(text, OPERATORS) / 3) + F.floor(matches(text, OPENERS) / 2)
    return F.greatest(total, F.lit(1)).cast("long")


IMPORTS = r"""(?:import|from|require\()\s*['"]([^'"\n]+)['"]"""


def imports(text: Column) -> Column:
    """Distinct modules named in import, from and require, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IMPORTS), F.lit(1))))


def hash32(text: Column) -> Column:
    """The 32-bit rolling hash h = 31 h + c over UTF-16 units, without sign, in base 36."""
    h = F.call_function("reflect", F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("long")
    return F.lower(F.conv(F.abs(h).cast("string"), 10, 36))
