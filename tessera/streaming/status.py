"""Structured Streaming: document status, ingestion of a folder, hashes seen lately, and windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.shared import hadoop
from tessera.sources.store import Change, Snapshot, Store


def arriving(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """A stream of a Parquet table's files, whether the table is a folder of files or a file of its own."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    fs, at = hadoop(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)  # streams read folders only
    return reader.option("pathGlobFilter", name).parquet(folder)


def events(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """A stream of an events table's files; ``ts`` becomes a timestamp, as watermarks want it."""
    return arriving(spark, path, most_files).withColumn("ts", F.col("ts").cast("timestamp"))


def latest_status(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """The newest status of each key (of equal times the larger event), for :func:`upserted`: a durable table, so none is
    lost to those who look later."""
    newest = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id"))
    return stream.groupBy(key).agg(newest.alias("s")).select(key, F.col("s.event_type").alias("status"), F.col("s.ts").alias("at"))


def first_within(stream: DataFrame, keys: list[str], at: str = "ts", lasting: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen within the time before: a cache with a time to live, as state that expires."""
    return stream.withWatermark(at, lasting).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 day", start: str | None = None) -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows, which begin ``start`` after 1970 and whole slides;
    later events than ``late`` are dropped."""
    w = F.window("ts", length, slide, start)
    sums = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    found = stream.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@contextmanager
def a_part_a_core(spark: SparkSession) -> Iterator[None]:
    """Queries that start here deal their state over as many partitions as there are cores, if the session has more: each
    batch opens and commits every partition's state, however few rows it has. The session's setting is as before
    afterwards; a query that goes on from a checkpoint keeps the number it began with."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(was), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def drained(stream: DataFrame, mode: str, checkpoint: str, target: str) -> DataFrame:
    """All that a stream holds now, by a run that ends, written in files of the folder ``target``: what it appends, or, in
    the mode ``complete``, the table as its last batch leaves it. A batch that runs again overwrites its own files."""
    writer = stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer.format("parquet").start(target).awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(target)
    last: list[int] = []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/{batch}")
        last[:] = [batch]

    writer.foreachBatch(keep).start().awaitTermination()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{target}/{last[0]}")


def upserted(stream: DataFrame, store: Store, name: str, checkpoint: str, source: str = "stream") -> Snapshot:
    """All that a stream says of its keys now, by a run that ends, as a table of a store. A batch gives the keys that it
    changed and writes their buckets anew; one that runs again after a failure changes nothing. Whoever looks later finds
    the table as some batch left it."""

    def keep(rows: DataFrame, batch: int) -> None:
        store.commit({name: Change(rows)}, source=source, batch=batch)

    writer = stream.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", checkpoint)
    writer.foreachBatch(keep).start().awaitTermination()
    return store.snapshot()


def ingest(spark: SparkSession, folder: str, index: Callable[[DataFrame, int], None], checkpoint: str, most_files: int = 1000) -> StreamingQuery:
    """Text files that arrive in a folder, handed batch by batch to ``index`` (rows, batch id). A batch may come again
    after a failure, so ``index`` must be idempotent, such as by an upsert."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", most_files).load(folder)
    rows = files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return rows.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
