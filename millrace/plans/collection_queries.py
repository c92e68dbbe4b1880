"""Registered queries of the stored vector collection: built, changed by upsert and delete, read again and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import documents as store
from millrace.plans.registry import register
from millrace.sources.collection import Collection
from millrace.sources.shared import shared_path
from millrace.sources.tables import table

# What the changed collection holds: every tenth vector with the next one's place (the last keeps its own), every other tenth gone.
LIVE = """live as (select a.vec_id, case when a.vec_id % 10 = 3 then coalesce(b.embedding, a.embedding) else a.embedding end::double[] embedding
    from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 10 <> 7)"""
NEAREST = """q as (select vec_id query_id, embedding::double[] q from embeddings where vec_id % 100 = 0),
    s as (select query_id, vec_id, coalesce(list_cosine_similarity(embedding, q), 0) c from live, q),
    k as (select query_id, vec_id, c, row_number() over (partition by query_id order by round(c, 12) desc, vec_id) k from s)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _changed(spark: SparkSession, d: str) -> Collection:
    """All vectors stored, a tenth of them stored again elsewhere, another tenth deleted; opened anew."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    root = shared_path(spark, "collection")
    made = Collection.create(spark, root, e)
    made.upsert(e)
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    made.upsert(following.where("vec_id % 10 = 3"))
    made.delete(e.where("vec_id % 10 = 7").select("vec_id"))
    return Collection(spark, root)


@register("d2_5_collection_search", f"with {LIVE}, {NEAREST} select query_id, vec_id, round(c, 6) score from k where k <= 10")
def searched(spark: SparkSession, d: str) -> DataFrame:
    """The changed collection, all cells looked at."""
    return _changed(spark, d).search(_queries(spark, d), exact=True).withColumn("score", F.round("score", 6))


@register("d2_5_collection_vectors", f"with {LIVE} select vec_id, round(list_sum(embedding), 6) total from live")
def stored(spark: SparkSession, d: str) -> DataFrame:
    """The live rows of the changed collection after it was compacted and its old files deleted."""
    made = _changed(spark, d)
    made.compact()
    made.vacuum()
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return Collection(spark, made.root).vectors().select("vec_id", F.round(total, 6).alias("total"))


@register("d2_5_collection_recall", "select count(*) queries, true as reached from embeddings where vec_id % 100 = 0")
def recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether a search of the nearest cells finds nine tenths of what comparing all pairs finds."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    made = Collection.create(spark, shared_path(spark, "collection"), e)
    made.upsert(e)
    asked = _queries(spark, d)
    exact = store.nearest(e, asked).select("query_id", "vec_id")
    both = exact.join(made.search(asked).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("reached"))
