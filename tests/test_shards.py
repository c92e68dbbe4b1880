"""The database scan where driver and executors share no database server."""

import pytest

from millrace.plans import file_queries, registry
from millrace.sources import shards


def test_scan_without_a_server(spark, monkeypatch):
    monkeypatch.setattr(file_queries, "one_jvm", lambda _: False)
    got = registry.queries()["s3_database_scan"](spark, "/root/testdata/sf0.001")
    want = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_totalprice > 150000 and o_custkey % 2 = 0").select("o_orderkey", "o_custkey", "o_totalprice")
    assert got.schema == want.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count()


def test_shards_hold_nulls_and_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_ROWS", 7)
    rows = [(i, None if i % 5 == 0 else i / 3, None if i % 4 == 0 else f"s'{i}\"") for i in range(100)]
    frame = spark.createDataFrame(rows, "`a b` long, x double, s string")
    shards.write(frame, str(tmp_path / "s"), "t")
    assert sorted(map(tuple, shards.scan(spark, str(tmp_path / "s"), "t", frame.schema).collect())) == rows
    assert shards.scan(spark, str(tmp_path / "s"), "t", frame.schema, "x > 20").count() == sum(x is not None and x > 20 for _, x, _ in rows)
    assert shards.scan(spark, str(tmp_path / "s"), "t", frame.schema, "0").count() == 0
    with pytest.raises(ValueError):
        shards.write(spark.sql("select array(1) a"), str(tmp_path / "u"), "t")
