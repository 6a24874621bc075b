"""Factors of the hybrid score, each between 0 and 1, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of the hybrid score's factors.
WEIGHTS = {"semantic": 0.7, "recency": 0.2, "file_importance": 0.1}

#: The weight of a file by what its name, or its folder, contains; the first that fits counts.
NAME_RULES = [(("component", "comp"), 1.0), (("service", "svc"), 0.95), (("util", "helper", "lib"), 0.9), (("model", "entity", "dto"), 0.9), (("config", "conf"), 0.7), (("test", "spec"), 0.6)]
FOLDER_RULES = [(("component", "ui", "view"), 0.9), (("service", "business"), 0.85), (("util", "common"), 0.8), (("model", "entity"), 0.8), (("config",), 0.6)]
#: Files that programs begin in; what a kind of chunk adds to its quality.
ENTRY_NAMES = ("index.ts", "main.ts", "app.ts")
TYPE_BONUS = {"function": 0.1, "class": 0.15, "method": 0.05, "module": 0.1, "statement": 0.02}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def recency(created: Column, as_of: Column) -> Column:
    """0.9 to the number of months of 30 days; 0.5 if not known."""
    days = (F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(86_400_000_000.0)
    return F.coalesce(clamp(F.pow(F.lit(0.9), days / 30)), F.lit(0.5))


def first_rule(text: Column, rules: list) -> Column:
    out = F.lit(None).cast("double")
    for words, value in reversed(rules):
        out = F.when(text.rlike("|".join(words)), F.lit(value)).otherwise(out)
    return out


def file_importance(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    folder = F.lower(F.regexp_extract(path, r"([^/]*)/[^/]*$", 1))
    entry = F.when(name.isin(*ENTRY_NAMES), F.lit(0.95))
    return F.greatest(F.lit(0.5), first_rule(name, NAME_RULES), first_rule(folder, FOLDER_RULES), entry)


def code_quality(complexity: Column, dependencies: Column, imports: Column, kind: Column) -> Column:
    bonus = F.lit(0.0)
    for k, v in TYPE_BONUS.items():
        bonus = F.when(kind == k, F.lit(v)).otherwise(bonus)
    filled = lambda a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.lit(0.1)).otherwise(F.lit(0.0))
    graded = F.when((complexity > 0) & (complexity < 10), F.lit(0.05)).when((complexity >= 10) & (complexity < 20), F.lit(0.02)).otherwise(F.lit(0.0))
    return clamp(F.lit(0.5) + graded + filled(dependencies) + filled(imports) + bonus)


def relevance(query: str, content: Column, path: Column, kind: Column) -> Column:
    """.9 if all terms occur, .7 of the share if some do; a little more for the path and for functions and classes."""
    if not query:
        return F.lit(0.5)
    terms = query.lower().split()
    text = F.lower(F.coalesce(content, F.lit("")))
    hits = sum((F.contains(text, F.lit(t)).cast("double") for t in terms), F.lit(0.0))
    base = F.when(hits == len(terms), F.lit(0.9)).otherwise(hits / len(terms) * 0.7)
    in_path = F.lit(False)
    for t in terms:
        in_path = in_path | F.contains(F.lower(path), F.lit(t))
    return clamp(base + F.when(in_path, 0.1).otherwise(0.0) + F.when(kind.isin("function", "class", "method"), 0.05).otherwise(0.0))


def hybrid(factors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    w = WEIGHTS | (weights or {})
    return clamp(sum((f * w.get(n, 0.0) for n, f in factors.items()), F.lit(0.0)))


def term_match(query: str, content: Column) -> Column:
    """The share of the query's words that a text holds; null texts hold none."""
    terms = query.lower().split()
    text = F.lower(F.coalesce(content, F.lit("")))
    return sum((F.contains(text, F.lit(t)).cast("double") for t in terms), F.lit(0.0)) / max(1, len(terms))


def any_match(value: Column, parts: list[str]) -> Column:
    """1 if the value holds one of the parts, else 0; null holds none."""
    return F.when(F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(value, p)), F.lit(False)), 1.0).otherwise(0.0)


def contributions(factors: dict[str, Column], weights: dict[str, float]) -> list[Column]:
    """Each factor's part in the score, by its name; factors without a weight have none."""
    return [(f * weights.get(n, 0.0)).alias(n) for n, f in factors.items()]


def three(x: Column) -> Column:
    """A number with three decimals, halves upwards."""
    return F.format_string("%.3f", F.floor(x * 1000 + 0.5) / 1000)


def explanation(factors: dict[str, Column], weights: dict[str, float], labels: dict[str, str]) -> Column:
    """One line for the total and one a factor, with its value and weight."""
    lines = [F.concat(F.lit("Total Score: "), three(hybrid(factors, dict.fromkeys(factors, 0.0) | weights)))]
    lines += [F.concat(F.lit(f"{labels.get(n, n)}: "), three(f), F.lit(f" (weight: {weights.get(n, 0.0):g})")) for n, f in factors.items()]
    return F.array_join(F.array(*lines), "\n")
