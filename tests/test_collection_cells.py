"""The cells of a collection are found without sending the distances between all centroids to the driver."""

from pyspark.ml.clustering import KMeans

from millrace.sources.collection import Collection


def test_cells_come_from_blocks(spark, tmp_path, monkeypatch):
    solvers, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: solvers.append(self.getSolver()) or fit(self, df))
    rows = spark.range(400).selectExpr("id vec_id", "array(cos(id), sin(id), 1.0D) embedding")
    made = Collection.create(spark, str(tmp_path / "c"), rows)
    made.upsert(rows)
    assert solvers == ["block"] and len(made.centroids) == 40 and made.vectors().count() == 400
