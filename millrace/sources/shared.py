"""The folder that the driver and all executors share."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def one_jvm(spark: SparkSession) -> bool:
    """Whether the driver is the only executor."""
    master = spark.sparkContext.master
    return master.startswith("local[") or master == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is one local JVM."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not one_jvm(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="millrace-")
        logging.getLogger(__name__).warning("spark.checkpoint.dir is not set, using %s", _LOCAL[sc.applicationId])
    return _LOCAL[sc.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def narrow_batches(spark: SparkSession, rows: int = 2048) -> None:
    """At most so many rows in an Arrow batch, so that rows with long texts or whole sets fit in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def plain_scan(df: DataFrame) -> bool:
    """Whether a frame is nothing but a scan of Parquet files, perhaps of some of its columns."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "Project" and plan.deterministic():
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().lower()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, which a task that runs again gives once more.

    It is made of the task's number and the row's place in it, which are the same each time only where tasks read
    files; a frame that is not a scan of files is written first.
    """
    if not plain_scan(df):
        path = shared_path(df.sparkSession, "rows")
        df.write.parquet(path)
        df = df.sparkSession.read.parquet(path)
    return df.withColumn(name, F.monotonically_increasing_id())
