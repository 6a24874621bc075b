"""Constraints of the entities as columns that list what a row breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("typescript", "javascript", "python", "go", "rust", "java", "dart", "c", "cpp", "other")
SEVERITIES = ("info", "low", "medium", "high", "critical")
CATEGORIES = ("bug", "security", "performance", "style", "maintainability", "documentation", "testing")


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order; a rule that is null doesn't hold."""
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def chunk_rules() -> dict[str, Column]:
    return {
        "id": F.col("id").isNull() | (F.col("id") == ""), "file": F.col("file").isNull() | F.col("file").startswith("/") | F.contains("file", F.lit("..")), "language": ~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)),
        "lines": F.coalesce((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit(True)), "sha256": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "commit": ~F.coalesce(F.col("commit_sha").rlike("^[0-9a-f]{7,40}$"), F.lit(False)), "content": F.col("content").isNull(),
    }


def insight_rules() -> dict[str, Column]:
    return {
        "line": F.coalesce(F.col("line") < 1, F.lit(False)), "severity": ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "category": ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)),
        "summary": F.coalesce(F.length("summary") == 0, F.lit(True)), "confidence": F.coalesce(~F.col("confidence").between(0, 1), F.lit(False)),
    }


def prompt_rules() -> dict[str, Column]:
    return {"top_k": ~F.coalesce(F.col("top_k").between(1, 100), F.lit(False)), "budget": ~F.coalesce(F.col("token_budget").between(1000, 100000), F.lit(False)), "text": F.coalesce(F.length("text") == 0, F.lit(True)), "count": F.coalesce(F.col("token_count") < 0, F.lit(False))}
