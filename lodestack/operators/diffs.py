"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, file_no, hunk_no, kind, old_line, new_line, content of every line of a hunk.

    Lines are exploded with their place; headers are numbered by running counts within a diff, and line numbers are a running
    count from the hunk's header. A diff is one row, so its window is bounded by it.
    """
    rows = diffs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))
    return hunk_lines(rows, [key])


def chunk_lines(chunks: DataFrame, keys: list[str], text: str, start: str) -> DataFrame:
    """keys, pos (from 0), line: every line of the files that ``keys`` name, once, out of chunks that may share lines."""
    rows = chunks.where(F.col(text).isNotNull()).select(*keys, (F.coalesce(F.col(start), F.lit(1)) - 1).alias("_at"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("_i", "line"))
    return rows.groupBy(*keys, (F.col("_at") + F.col("_i")).alias("pos")).agg(F.min(F.struct("_at", "line"))["line"].alias("line"))


def hunk_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As ``diff_lines``, out of the lines (pos, line) of the diffs that ``keys`` name."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("file_no", F.sum(F.col("line").startswith("diff --git ").cast("int")).over(w)).withColumn("hunk_no", F.sum(F.col("line").rlike(HUNK).cast("int")).over(w))
    kind = F.when(F.col("line").startswith("+"), "addition").when(F.col("line").startswith("-"), "deletion").otherwise("context")
    head = F.col("line").rlike(HUNK) | F.col("line").startswith("diff --git ") | F.col("line").rlike(r"^(?:---|\+\+\+) [ab/]|^\\")
    number = lambda g: F.last(F.when(F.col("line").rlike(HUNK), F.regexp_extract("line", HUNK, g).cast("int")), ignorenulls=True).over(w)
    x = marked.withColumn("old_start", number(1)).withColumn("new_start", number(3)).where(~head & (F.col("hunk_no") > 0)).withColumn("kind", kind)
    h = Window.partitionBy(*keys, "hunk_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda k: F.sum((F.col("kind") != k).cast("int")).over(h) - 1
    return x.select(
        *keys, "pos", "file_no", "hunk_no", "kind", F.when(F.col("kind") != "addition", F.col("old_start") + count("addition")).alias("old_line"), F.when(F.col("kind") != "deletion", F.col("new_start") + count("deletion")).alias("new_line"),
        F.expr("substring(line, 2)").alias("content"),
    )


def change_status(lines: DataFrame, *key: str) -> DataFrame:
    """key, added, deleted, status: only additions mean added, only deletions deleted, else modified."""
    counts = lines.groupBy(*key).agg(F.count_if(F.col("kind") == "addition").alias("added"), F.count_if(F.col("kind") == "deletion").alias("deleted"))
    return counts.withColumn("status", F.when((F.col("added") > 0) & (F.col("deleted") == 0), "added").when((F.col("deleted") > 0) & (F.col("added") == 0), "deleted").otherwise("modified"))
