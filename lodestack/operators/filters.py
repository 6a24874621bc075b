"""A filter as a dictionary, compiled on the driver to one column that Catalyst pushes to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.globs import regex

EQUAL = {"commit": "commit_sha", "author": "author", "branch": "branch"}
LISTS = {"files": ("file", True), "exclude_files": ("file", False), "languages": ("language", True), "exclude_languages": ("language", False), "chunk_types": ("chunk_type", True), "exclude_chunk_types": ("chunk_type", False)}
BOUNDS = {"created_after": ("created_at", ">="), "created_before": ("created_at", "<="), "min_complexity": ("complexity", ">="), "max_complexity": ("complexity", "<=")}
FILLED = {"has_dependencies": "dependencies", "has_imports": "imports"}


def condition(field: str, spec: object) -> Column:
    """A custom clause: a value for equality, or match.value, match.any and range.{gt,gte,lt,lte}."""
    c = F.col(field)
    if not isinstance(spec, dict):
        return c == F.lit(spec)
    parts = []
    match = spec.get("match", {})
    if "value" in match:
        parts.append(c == F.lit(match["value"]))
    if "any" in match:
        parts.append(c.isin(*match["any"]))
    for op, value in spec.get("range", {}).items():
        parts.append({"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compiled(spec: dict) -> tuple[Column, list[str], list[str]]:
    """(predicate, what was applied, warnings). All clauses hold together; an exclusion keeps rows whose field is null."""
    parts, applied = [], []
    for key, (field, keep) in LISTS.items():
        if spec.get(key):
            inside = F.col(field).isin(*spec[key])
            parts.append(inside if keep else ~F.coalesce(inside, F.lit(False)))
            applied.append(f"{key}: {', '.join(map(str, spec[key]))}")
    for key, keep in (("file_patterns", True), ("exclude_patterns", False)):
        for p in spec.get(key, ()):
            hit = F.col("file").rlike(regex(p))
            parts.append(hit if keep else ~F.coalesce(hit, F.lit(False)))
            applied.append(f"{key}: {p}")
    for key, (field, op) in BOUNDS.items():
        if spec.get(key) is not None:
            value = F.lit(spec[key]).cast("timestamp") if field == "created_at" else F.lit(spec[key])
            parts.append(F.col(field) >= value if op == ">=" else F.col(field) <= value)
            applied.append(f"{field} {op} {spec[key]}")
    for key, field in EQUAL.items():
        if spec.get(key):
            parts.append(F.col(field) == spec[key])
            applied.append(f"{key}: {spec[key]}")
    if spec.get("commit_range"):
        parts.append(F.col("commit_sha").isin(*spec["commit_range"]))
        applied.append("commit_range")
    for key, field in FILLED.items():
        if spec.get(key) is not None:
            full = F.coalesce(F.size(field), F.lit(0)) > 0
            parts.append(full if spec[key] else ~full)
            applied.append(f"{key}: {spec[key]}")
    for field, clause in spec.get("custom", {}).items():
        parts.append(condition(field, clause))
        applied.append(f"custom: {field}")
    warnings = [] if parts else ["No filters specified"]
    return reduce(lambda a, b: a & b, parts, F.lit(True)), applied, warnings


def lint(spec: dict) -> list[str]:
    """Clauses that contradict each other, say nothing or say too much."""
    out = []
    for a, b in (("files", "exclude_files"), ("languages", "exclude_languages"), ("chunk_types", "exclude_chunk_types")):
        both = set(spec.get(a) or ()) & set(spec.get(b) or ())
        if both:
            out.append(f"{a} and {b} share {', '.join(sorted(both))}")
    out += [f"{k} is empty" for k, v in spec.items() if v in ([], {}, "")]
    out += [f"{p} takes every file" for p in spec.get("file_patterns", ()) if p in ("**", "**/*", "*")]
    for low, high in (("created_after", "created_before"), ("min_complexity", "max_complexity")):
        if spec.get(low) is not None and spec.get(high) is not None and spec[low] > spec[high]:
            out.append(f"{low} is beyond {high}")
    return out
