"""The training-data pipeline: five stages, each written as Parquet and read again as the next one's documents.

quality rules -> toxicity -> n-gram Jaccard join -> mixing to target weights -> packing

Mixing leaves files that are ranges of slots, in order. Packing works on each task's files by itself and fills sequences by
lengths, so the mixture holds between the ranges that tasks read, each of which has every source in its share, and not from one
sequence to the next within a range.

Every stage but the last returns the columns of its input, whatever their names; each works on all that its predecessor
kept. Rows are told apart by keys of their own, so null and repeated ids, and repeated rows, are nothing special.

Defined results: a null or empty text fails the quality rules; a text that reaches a later stage without words is not
toxic, resembles nothing, is mixed like others and is packed as one end id; without both labels no document counts as
toxic; a null source is a source of its own; an empty table stays empty in every stage; of equal ids in a group of near
copies any one row stays, and a row without an id only where no other is in its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, packing, quality, toxicity
from millrace.llm.queries import vocabulary
from millrace.llm.store import cut, new_path, with_row_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose the lines that break a rule."""
    return quality.clean(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. The network learns from the labelled documents of this stage's input."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, net, name="__toxic").where("__toxic < 0.5").drop("__toxic")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id; null ids come last.

    Rows are told apart by a key of their own, so null and repeated ids do not touch other documents.
    """
    keyed = with_row_key(docs)
    named = keyed.select(F.col("__row").alias("doc_id"), "text")
    groups = cut(jaccard.similar(named, words=5, percent=80).select(F.col("doc_id").alias("__row"), "component_id"))
    ids = groups.join(keyed.select("__row", "doc_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("f")
    stay = ids.groupBy("component_id").agg(first).select("f.__row")
    gone = cut(groups.select("__row").join(stay, "__row", "left_anti"))
    return keyed.join(gone, "__row", "left_anti").select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, so that files and the rows in them follow it."""
    keyed = with_row_key(docs)
    places = mixing.mix(keyed.select("__row", "source"), key="__row").select("__row", F.col("slot").alias("__slot"), F.col("in_block").alias("__at"))
    placed = keyed.join(places, "__row")
    return placed.repartitionByRange("__slot").sortWithinPartitions("__slot", "__at").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    pieces = packing.pack(docs, vocabulary())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed),
]

# The network of the second stage is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage returns for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
