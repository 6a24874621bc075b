"""Streams over files: windows, sessions, duplicates within a watermark, changes merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.store import newest
from lodestack.sources.shared import new_path


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a path as they land, with a zoned time, as watermarks need it."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        folder, _, name = path.rpartition("/")  # a stream watches folders; a single file is its folder's, by name
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives once it has taken all there is. Batches add to a table (append), bring the new state of some ``keys`` (update: the last batch of a key counts) or all of it (complete)."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "progress")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")  # a repeated batch writes the same place

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(out)
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_")).select(*keys, "_.*")
    return rows.select(*stream.columns)


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sliding(events: DataFrame, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size, slide)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def logged_changes(changes: DataFrame, path: str, key: str, order: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A streaming query that adds each batch's last change of every key (op: upsert or delete) to a log at ``path``, one folder a batch, and nothing else; repeating a batch writes the same folder. ``store.replayed`` over the log gives the collection."""
    def add(batch: DataFrame, number: int) -> None:
        derive(newest(batch, key, order)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.option("checkpointLocation", new_path(changes.sparkSession, "progress")).trigger(availableNow=True).foreachBatch(add).start()
