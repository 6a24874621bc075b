"""Joins that need more than a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bin; an interval and a point meet only in the bins that both touch.
BIN = 64


def interval_join(chunks: DataFrame, points: DataFrame, on: list[str], start: str, end: str, at: str) -> DataFrame:
    """Every chunk with every point of the same keys within start..end, both ends included.

    Both sides are cut into bins of lines, so the join is on keys and bin: a file with a third of all rows is spread over its
    bins instead of meeting in one task. Nulls match nothing. Columns of ``points`` other than the keys must have names of their own.
    """
    binned = chunks.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))
    placed = points.where(F.col(at).isNotNull()).withColumn("_bin", F.floor(F.col(at) / BIN))
    return binned.join(placed, [*on, "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def delta(old: DataFrame, new: DataFrame, scope: list[str], digest: str, ident: str) -> DataFrame:
    """scope, digest, action, id: unchanged, add or delete, from what is stored and what is there now.

    Each side is collapsed to one row a digest first (the last id stays), as duplicates would multiply in the join.
    """
    one = lambda df, name: df.where(F.col(digest).isNotNull()).groupBy(*scope, digest).agg(F.max(ident).alias(name))
    both = one(old, "_old").join(one(new, "_new"), [*scope, digest], "full_outer")
    action = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "delete").otherwise("unchanged")
    return both.select(*scope, digest, action.alias("action"), F.coalesce("_old", "_new").alias(ident))


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, columns: list[str]) -> DataFrame:
    """Each row of ``left`` with the columns of the last row of ``right`` at or before it, by the keys; one shuffle, no pairs.

    Both sides run through one window in order of time; of equal times, ``right`` comes first.
    """
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*on, at, F.struct(*columns).alias("_row")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*on).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b, allowMissingColumns=True).withColumn("_row", F.last("_row", ignorenulls=True).over(w))
    return merged.where("_side = 1").select(*left.columns, *[F.col("_row")[c].alias(f"last_{c}") for c in columns])
