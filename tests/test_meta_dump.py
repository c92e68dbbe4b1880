"""The dump by model and session: its folders do not grow with the sessions."""

from pyspark.sql import functions as F

from millrace.sources import sinks


def test_folders_do_not_grow_with_sessions(spark, tmp_path):
    rows = spark.range(900).select(F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("m"), F.col("id") % 3)).alias("model"), F.when(F.col("id") < 890, F.col("id")).alias("session"))
    for _ in range(2):
        sinks.write_meta(rows, str(tmp_path), "session")
    assert len(list((tmp_path / "meta").glob("model=*/*"))) <= 2 * sinks.META_PARTS
    back = spark.read.schema("n long, model string, session long").json(f"{tmp_path}/meta")
    assert sorted((r.n, r.model, r.session) for r in back.where("session is not null").collect()) == sorted((n, f"m{n % 3}", n) for n in range(890) if n % 3 for _ in range(2))
    assert back.where("session is null").count() == 2 * sum(n % 3 > 0 for n in range(890, 900))
    assert back.where(F.col("part") != sinks.meta_part(F.col("session"))).count() == 0
