"""Collections as logs of changes: what a key is now is its last change, so writers only ever add rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write wins: one row a key, the greatest by ``order`` and then by all columns; a hash aggregate, no sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_")).select(*[key if c == key else F.col("_")[c].alias(c) for c in rows.columns])


def replayed(log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """What remains once a log of upserts and deletes has run in order: the last operation of each key, if it isn't a delete."""
    return newest(log, key, [seq]).where(F.col(op) != "delete")


def merged(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key isn't among the changes, and the changes."""
    return stored.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)
