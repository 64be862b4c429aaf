"""Session settings that all jobs share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marketlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apart(frame: DataFrame) -> DataFrame:
    """The rows, worked out by a query of their own and kept in the shared folder, so that the driver need not plan and broadcast for all parts of a long one at once."""
    with_checkpoints(frame.sparkSession)
    return frame.checkpoint()


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Keeps the shared folder that the cluster names in spark.checkpoint.dir; sets one only where there is none."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's own default, too many for rows that hold whole texts
        spark.conf.set(BATCH_ROWS, "1000")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="marketlens-checkpoints-"))
    return spark
