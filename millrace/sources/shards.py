"""A table in many small SQLite databases, for clusters without a database server: tasks write them and search them.

Each task puts its rows into databases of at most SHARD_ROWS rows. They lie as binary values in Parquet files of the
shared folder, so that Spark's readers reach them wherever it is. A search hands its condition to the databases; only
rows that meet it leave them. Columns are integers, doubles and strings; a NaN, which SQLite has not, is refused.
"""

from __future__ import annotations

import math
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SHARD_ROWS = 50_000
KINDS = {"byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "real", "double": "real", "string": "text"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def write(df: DataFrame, path: str, name: str) -> None:
    """The rows as databases with a table of this name."""
    odd = [f.name for f in df.schema.fields if f.dataType.typeName() not in KINDS]
    if odd:
        raise ValueError(f"columns of other kinds: {', '.join(odd)}")
    columns = ", ".join(f"{_quoted(f.name)} {KINDS[f.dataType.typeName()]}" for f in df.schema.fields)
    made = f"create table {_quoted(name)} ({columns})"
    put = f"insert into {_quoted(name)} values ({', '.join('?' * len(df.columns))})"

    def packed(db: sqlite3.Connection) -> pa.RecordBatch:
        db.commit()
        content = db.serialize()
        db.close()
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, held = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                if db is not None and held + part.num_rows > SHARD_ROWS:
                    yield packed(db)
                    db, held = None, 0
                if db is None:
                    db = sqlite3.connect(":memory:")
                    db.execute(made)
                rows = [c.to_pylist() for c in part.columns]
                if any(isinstance(x, float) and math.isnan(x) for c in rows for x in c):
                    raise ValueError("a NaN cannot be stored")
                db.executemany(put, zip(*rows, strict=True))
                held += part.num_rows
        if db is not None:
            yield packed(db)

    df.mapInArrow(of_task, "content binary").write.parquet(path)


def scan(spark: SparkSession, path: str, name: str, schema: StructType, where: str = "1") -> DataFrame:
    """The rows that meet a condition in SQLite's SQL."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ", ".join(_quoted(f.name) for f in schema.fields)
    query, arrow = f"select {names} from {_quoted(name)} where {where}", to_arrow_schema(schema)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_py())
                found = db.execute(query)
                while rows := found.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                db.close()

    return spark.read.schema("content binary").parquet(path).mapInArrow(of_task, schema)
