"""What tasks of Python hold at once does not grow with the rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import replace
from millrace.sources import collection


def test_replace_takes_few_rows_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        got = spark.range(1000).select(replace.replaced(F.concat("id", F.lit(" x")), F.lit("x"), F.lit("y"))["text"].alias("t"))
        assert int(spark.conf.get(name)) <= replace.BATCH_ROWS and got.where("t like '% y'").count() == 1000
    finally:
        spark.conf.set(name, before)


def test_cells_are_given_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collection, "TASK_COPIES", 100)
    x = np.random.default_rng(1).normal(size=(400, 4))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    made = collection.Collection.create(spark, str(tmp_path / "c"), frame, cells=20)
    made.upsert(frame)
    sizes = made._with_cells(frame, 20, "cell").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert sizes.agg(F.sum("n")).first()[0] == 400 * 20
    seen = []

    class Frame:
        schema, columns = frame.schema, frame.columns

        def mapInArrow(self, of_task, _):  # noqa: N802
            batch = pa.RecordBatch.from_pydict({"vec_id": range(400), "embedding": x.tolist()})
            seen.extend(b.num_rows for b in of_task([batch]))

    made._with_cells(Frame(), 20, "cell")
    assert sum(seen) == 400 * 20 and max(seen) <= 100
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    made.upsert(frame.where("vec_id < 200").select("vec_id", F.transform("embedding", lambda y: -y).alias("embedding")))  # moves them
    made.upsert(frame.where("vec_id < 100"))  # and back
    u[100:200] *= -1
    asked = frame.where("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.vec_id) for r in made.search(asked, k=5, exact=True).collect()}
    assert got == {(q, int(i)) for q in (7, 107, 207, 307) for i in np.argsort(-(u @ (x[q] / np.linalg.norm(x[q]))))[:5]}
