"""The tables of a data folder as views, and an SQL shell over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The table names.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Run a read-only query over the tables that it names; column pruning and filters reach their Parquet scans."""
    import re

    if not re.match(r"\s*(select|with|values)\b", query, re.I):
        raise ValueError("only queries can be run")
    for name in TABLES:
        if re.search(rf"\b{name}\b", query, re.I):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(query)
