"""Shared storage for cut points and files.

A cluster names a folder that the driver and every executor can reach in ``spark.checkpoint.dir``.
Checkpoints and intermediate files go there, so a lost executor costs a recomputation and never data.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import narrow_batches, numbered, shared_folder  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, which checkpoints go to as well."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that cut the lineage of a job's large intermediate frames, and go when they are read for the last time.

    They are compressed, unlike checkpoints, and Spark knows their size when it plans what follows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def free(self, *frames: DataFrame) -> None:
        """Delete the tables of these frames."""
        jvm = self.spark._jvm
        for frame, path in self.paths:
            if any(frame is f for f in frames):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = [x for x in self.paths if not any(x[0] is f for f in frames)]


def release() -> None:
    """Give memory that a worker no longer uses back to the system, as workers are kept for later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def released(of_task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, after whose end its worker gives its memory back."""

    @functools.wraps(of_task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from of_task(batches)
        finally:
            release()

    return run


def with_row_key(docs: DataFrame, name: str = "__row") -> DataFrame:
    """The rows with a key of their own, whatever their ids: the number of their Parquet file and their place in it.

    The key is read from files, so a task that runs again gives the same one. A table that is not a plain scan of
    Parquet files is written first. One row for each file reaches the driver.
    """
    spark = docs.sparkSession
    plan = docs._jdf.queryExecution().analyzed()
    plain = plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().lower()
    if not plain:
        path = new_path(spark, "rows")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    files = sorted(r[0] for r in docs.select(F.col("_metadata.file_path")).distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(files)), "__file long, __path string")
    placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    keyed = placed.join(F.broadcast(numbers), "__path")
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns], F.expr("shiftleft(__file, 40) + __at").alias(name))
