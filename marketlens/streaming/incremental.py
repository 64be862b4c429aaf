"""Incremental forms of the event operators, with Structured Streaming.

Each takes a stream (or a table) of (ts, key columns) and works for both; ``drained`` runs a stream over all files that
are there and gives its result as a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{name}.parque[t]")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files, with ts as an instant in the session's zone."""
    return table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, however late its next rows come: the state store keeps every key."""
    return events.select(*keys).dropDuplicates(keys)


def sliding_counts(events: DataFrame, key: str, length: str = "14 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events a key in every sliding window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def drained(frame: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns the rows it wrote."""
    spark, name = frame.sparkSession, uuid.uuid4().hex
    query = frame.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{checkpoint}/{name}")
    if mode == "append":
        schema = frame.schema
        query.format("parquet").option("path", f"{checkpoint}/{name}-rows").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{checkpoint}/{name}-rows")
    path = f"{checkpoint}/{name}-rows"
    # complete mode: each batch replaces the result
    query.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def fed(frame: DataFrame, checkpoint: str, batch) -> None:
    """Runs a stream over what is there, each batch through a function of (rows, number)."""
    frame.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{checkpoint}/{uuid.uuid4().hex}").foreachBatch(batch).start().awaitTermination()
