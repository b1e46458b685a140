"""Where intermediate tables go, and how lineage is cut.

Everything lands in the shared folder that the cluster names in
``spark.checkpoint.dir``.  Only where that setting is absent (a local test
session) a folder is made for the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spoolkit-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The written files outlive any executor, so later stages never recompute
    what lies before them.  ``by`` names a column of few values that each get
    a folder, so that a filter on it reads no other.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if by is None:
        df.write.parquet(path)
    else:
        writers = "spark.sql.maxConcurrentOutputFileWriters"
        before = spark.conf.get(writers, None)
        spark.conf.set(writers, "16")  # one file for each value at a time, instead of a sort
        try:
            df.write.partitionBy(by).parquet(path)
        finally:
            if before is None:
                spark.conf.unset(writers)
            else:
                spark.conf.set(writers, before)
    return spark.read.schema(df.schema).parquet(path)
