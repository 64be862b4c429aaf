"""Versioned tables: a run's tables are written aside, and one small file then says which version holds.

``folder/versions/<version>/<table>`` holds the rows, ``folder/CURRENT`` the version's name. The pointer is written beside
itself and moved over the old one in one step, so a reader finds the old run or the new one, all tables of the same, also
when the writer dies halfway or when a table is replaced by what was read from it. What a dead writer left is never
pointed at, and goes with the versions that are cleared. The file system has to move files in one step, as HDFS and local
disks do; on an object store that does not, a lock has to stand around ``publish``.

One writer at a time; readers are many. A version that has been read from stays for ``KEPT`` further publishes.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTER = "CURRENT"
KEPT = 3


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that holds, or None before the first publish."""
    at, files = _hadoop(spark, f"{folder}/{POINTER}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def read(spark: SparkSession, folder: str, table: str = "rows", schema: str | StructType | None = None) -> DataFrame:
    """A table of the version that holds now; it stays the same for the frame's life. Without one, an empty table of the schema."""
    version = current_version(spark, folder)
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        if version is not None:
            return reader.parquet(f"{folder}/versions/{version}/{table}")
    except AnalysisException:
        if schema is None:
            raise
    if schema is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.createDataFrame([], schema)


def publish(frames: DataFrame | Mapping[str, DataFrame], folder: str, version: str | None = None, partitions: Mapping[str, str] | None = None, orders: Mapping[str, list[str]] | None = None) -> str:
    """Writes one table (``rows``) or several by name as one version, and makes it the current one.

    partitions: of a table, the column whose values get a folder each; values of earlier versions are gone with them.
    orders: of a table, the columns that its files are sorted by, across files as well.
    A version that holds already is not written again, so a batch that is run twice has the effect of one.
    """
    tables = {"rows": frames} if isinstance(frames, DataFrame) else dict(frames)
    spark = next(iter(tables.values())).sparkSession
    if version is not None and version == current_version(spark, folder):
        return version
    version = version or uuid.uuid4().hex
    for name, frame in tables.items():
        by, order = (partitions or {}).get(name), (orders or {}).get(name)
        # a dead run's files under the same name are overwritten; nobody reads them
        writer = (frame.orderBy(*order) if order else frame).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{folder}/versions/{version}/{name}")
    _point(spark, folder, version)
    _clear(spark, folder, version)
    return version


def _point(spark: SparkSession, folder: str, version: str) -> None:
    jvm = spark._jvm
    beside, files = _hadoop(spark, f"{folder}/.{POINTER}.{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    pointer = jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}")
    context.rename(beside, pointer, how)


def _clear(spark: SparkSession, folder: str, version: str) -> None:
    """Deletes all but the newest versions; the current one always stays."""
    at, files = _hadoop(spark, f"{folder}/versions")
    found = sorted(files.listStatus(at), key=lambda x: -x.getModificationTime())
    for status in found[KEPT + 1 :]:
        if status.getPath().getName() != version:
            files.delete(status.getPath(), True)
