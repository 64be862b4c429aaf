"""Tables written to the folder that driver and executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from marketlens.session import with_checkpoints

#: Spark then deletes a query's shuffle files when the query ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame) -> DataFrame:
    """Writes the frame once as Parquet under spark.checkpoint.dir and reads it again. Nothing of its shuffles stays on disk."""
    spark = with_checkpoints(frame.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    schema = frame.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing reads any more."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            folder = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
