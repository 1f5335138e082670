"""Lineage cuts: tables written once to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new empty folder for this session, deleted when its driver ends.

    It lies in `spark.checkpoint.dir`; where that is unset, in the warehouse, which a
    cluster shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() \
        or spark.conf.get("spark.sql.warehouse.dir")
    where = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return where


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Compute a table once and read it back; it survives lost executors."""
    path = scratch(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when their query has ended, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` gave and nothing will read again."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
