"""A stored collection of vectors: versioned delta files by cell, with upsert, delete, search and compaction.

Vectors lie in the cells of a coarse index: the centroids of k-means over a bounded sample. A commit is one folder of
Parquet files, partitioned by cell, and becomes visible with its log file, which is made once and never changed; a
writer that finds the number of its commit taken starts over on the newer state. Readers of a version see the commits up
to it, whatever is written meanwhile.

    root/cells/            centroids (cell, centroid)
    root/rows/commit=*/cell=*/   rows (vec_id, embedding, version, deleted)
    root/log/<version>.json      folder, rows by cell, whether earlier commits are superseded

A row replaces those of the same id and an earlier version in its cell. An id that moves to another cell, or is deleted,
leaves a row with ``deleted`` in its old cell, so a cell is read without looking at the others.

Defined results: rows with a null id are not stored; of several rows of an id in one upsert the largest vector (by
components in order) stays; vectors that are null, zero, of another length than the centroids' or hold null or non-finite
components are stored in cell 0 and score 0; deleting an unknown id does nothing; an empty collection finds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.operators import neighbours
from millrace.sources.commits import Conflict, Files

ROWS = "vec_id long, embedding array<double>, version long, deleted boolean, commit string, cell int"
#: At most so many rows teach the centroids, and so many tell how many cells a search should look at.
SAMPLE_ROWS, PROBE_ROWS = 50_000, 4_000
MOST_CELLS = 4_096
#: Rows of a block of vectors and of a block of queries, which meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 256
FILE_ROWS = 200_000
#: What a task holds at once when it finds the cells of rows: distances, and copies of rows.
TASK_DISTANCES, TASK_COPIES = 1 << 21, 1 << 14


@dataclass(frozen=True)
class State:
    """What a version of the collection consists of: its commits, and the rows that they hold by cell."""

    version: int
    commits: tuple[str, ...]
    rows: dict[int, int]


def _sampled(vectors: DataFrame, total: int, most: int) -> DataFrame:
    """About ``most`` of ``total`` rows, chosen by a hash of their ids, or all of fewer."""
    share = min(1.0, most / max(1, total))
    return vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))


class Collection:
    """A collection in a folder, as of its newest version or an earlier one."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.pinned = spark, root, version
        self.files = Files(spark, root)
        cells = sorted((r.cell, r.centroid) for r in spark.read.parquet(f"{root}/cells").collect())  # at most MOST_CELLS rows
        self.centroids = np.array([c for _, c in cells], np.float64)
        self.probes = json.loads(self.files.read("probes.json"))["probes"]

    @classmethod
    def create(cls, spark: SparkSession, root: str, sample: DataFrame, cells: int | None = None, seed: int = 1, wanted: float = 0.95, k: int = 10) -> Collection:
        """An empty collection whose cells fit the vectors (vec_id, embedding) of ``sample``, of which a bounded part is used.

        A search looks at as many cells as hold ``wanted`` of the ``k`` nearest in the sample of PROBE_ROWS rows.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        usable = _usable(F.col("embedding"))
        rows = sample.where(usable & F.col("vec_id").isNotNull()).select("vec_id", _unit(F.col("embedding").cast("array<double>")).alias("u"))
        total = rows.count()
        taught = _sampled(rows, total, SAMPLE_ROWS)
        n = taught.count()
        count = max(1, min(MOST_CELLS, cells or round(2 * total**0.5), n // 8))
        if n:
            # By rows, it would send the distances between all centroids, which grow with their square, to the driver for each iteration.
            model = KMeans(k=count, seed=seed, maxIter=15, featuresCol="v", solver="block").fit(taught.select(array_to_vector("u").alias("v")))
            centroids = np.array(model.clusterCenters())
        else:
            centroids = np.zeros((1, 1))
        frame = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        frame.coalesce(1).write.parquet(f"{root}/cells")
        few = np.array([r.u for r in _sampled(rows, total, PROBE_ROWS).select("u").collect()], np.float64)
        Files(spark, root).create("probes.json", json.dumps({"probes": _probes(centroids, few, wanted, k)}))
        return cls(spark, root)

    # -- versions ---------------------------------------------------------------------------------------------------

    def state(self) -> State:
        """The commits of the newest version, or of the one that was asked for."""
        names = [n for n in self.files.names("log") if n.endswith(".json")]
        version, commits, rows = 0, [], {}
        for name in names:
            number = int(name.split(".")[0])
            if self.pinned is not None and number > self.pinned:
                break
            entry = json.loads(self.files.read(f"log/{name}"))
            if entry["whole"]:
                commits, rows = [], {}
            commits.append(entry["commit"])
            for cell, n in entry["rows"].items():
                rows[int(cell)] = rows.get(int(cell), 0) + n
            version = number
        return State(version, tuple(commits), rows)

    def _rows(self, state: State) -> DataFrame:
        """The rows of a version, superseded ones among them."""
        if not state.commits:
            return self.spark.createDataFrame([], ROWS)
        every = self.spark.read.schema(ROWS).parquet(f"{self.root}/rows")
        return every.where(F.col("commit").isin(*state.commits))

    def vectors(self, state: State | None = None) -> DataFrame:
        """(vec_id, embedding, cell) of all live rows."""
        rows = self._rows(state or self.state())
        last = rows.groupBy("cell", "vec_id").agg(F.max_by(F.struct("embedding", "deleted"), "version").alias("r"))
        return last.where("not r.deleted").select("vec_id", "r.embedding", "cell")

    def _commit(self, rows: DataFrame, state: State, whole: bool = False) -> int:
        """Write rows (vec_id, embedding, deleted, cell) as the version after ``state``."""
        name, version = uuid.uuid4().hex, state.version + 1
        path = f"{self.root}/rows/commit={name}"
        # A cell goes to one task for each FILE_ROWS of its rows, so that a large cell is neither one task nor many files.
        dealt = rows.withColumn("version", F.lit(version).cast("long"))
        sizes = {int(r.cell): r["count"] for r in dealt.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
        parts = F.coalesce(F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // FILE_ROWS))])[F.col("cell")], F.lit(1)) if sizes else F.lit(1)
        dealt = dealt.withColumn("__part", F.pmod(F.xxhash64("vec_id"), parts)).repartition("cell", "__part").drop("__part")
        dealt.select("vec_id", "embedding", "version", "deleted", "cell").write.partitionBy("cell").parquet(path)
        entry = {"commit": name, "rows": {str(c): n for c, n in sizes.items()}, "whole": whole}
        try:
            self.files.create(f"log/{version:012d}.json", json.dumps(entry))
        except Conflict:
            self.files.delete(f"rows/commit={name}")
            raise
        return version

    def _retried(self, rows_of: Callable[[State], DataFrame], tries: int = 5) -> int:
        if self.pinned is not None:
            raise ValueError("an earlier version of a collection cannot be changed")
        for left in reversed(range(tries)):
            state = self.state()
            try:
                return self._commit(rows_of(state), state)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    # -- changes ----------------------------------------------------------------------------------------------------

    def _old_cells(self, ids: DataFrame, state: State) -> DataFrame:
        """(vec_id, old) of those ids that are live. Only ids are read of the stored rows."""
        rows = self._rows(state).select("vec_id", "cell", "version", "deleted").join(ids.select("vec_id"), "vec_id", "left_semi")
        last = rows.groupBy("vec_id", "cell").agg(F.max_by("deleted", "version").alias("deleted"))
        return last.where("not deleted").select("vec_id", F.col("cell").alias("old"))

    def upsert(self, vectors: DataFrame) -> int:
        """Store vectors (vec_id, embedding), in place of those with the same ids; the new version's number."""
        given = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        once = given.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))

        def rows(state: State) -> DataFrame:
            new = self._with_cells(once, 1, "cell")
            old = self._old_cells(once, state)
            moved = old.join(new.select("vec_id", "cell"), "vec_id").where("old <> cell")
            gone = moved.select("vec_id", F.lit(None).cast("array<double>").alias("embedding"), F.lit(True).alias("deleted"), F.col("old").alias("cell"))
            return new.select("vec_id", "embedding", F.lit(False).alias("deleted"), "cell").unionByName(gone)

        return self._retried(rows)

    def delete(self, ids: DataFrame) -> int:
        """Delete the vectors with these ids (vec_id); the new version's number."""
        once = ids.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()

        def rows(state: State) -> DataFrame:
            old = self._old_cells(once, state)
            return old.select("vec_id", F.lit(None).cast("array<double>").alias("embedding"), F.lit(True).alias("deleted"), F.col("old").alias("cell"))

        return self._retried(rows)

    def compact(self) -> int:
        """Write all live rows as one commit that supersedes the earlier ones, whose files stay for readers of their versions."""
        state = self.state()
        return self._commit(self.vectors(state).withColumn("deleted", F.lit(False)), state, whole=True)

    def vacuum(self) -> int:
        """Delete the folders that the newest version does not read; how many there were. No writer may be at work."""
        kept = {f"commit={c}" for c in self.state().commits}
        old = [n for n in self.files.names("rows") if n.startswith("commit=") and n not in kept]
        for name in old:
            self.files.delete(f"rows/{name}")
        return len(old)

    # -- search -----------------------------------------------------------------------------------------------------

    def _with_cells(self, vectors: DataFrame, count: int, name: str) -> DataFrame:
        """The rows once for each of their ``count`` nearest cells; a row that has no place goes to cell 0."""
        centroids = self.spark.sparkContext.broadcast(self.centroids)  # at most MOST_CELLS rows
        field = StructType([*vectors.schema.fields, StructField(name, IntegerType())])
        names = vectors.columns
        # So many rows at once that neither their distances to the centroids nor their copies for the cells are large.
        step = max(1, min(TASK_DISTANCES // len(self.centroids), TASK_COPIES // count))

        def of_task(batches):
            c = centroids.value
            half = (c * c).sum(1) / 2
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    cells = np.full((part.num_rows, count), -1)
                    cells[:, 0] = 0  # a row without a place is asked for in cell 0 alone
                    for n, (rows, units) in neighbours.matrices(pa.chunked_array([part.column("embedding")])).items():
                        placed = np.flatnonzero(units.any(1))
                        if n == c.shape[1] and len(placed):
                            away = half - units[placed] @ c.T
                            near = np.argpartition(away, count - 1, axis=1)[:, :count] if count < len(c) else np.tile(np.arange(len(c)), (len(placed), 1))
                            cells[rows[placed]] = near
                    if count == len(c):  # all cells are looked at, whatever the row is
                        cells[:] = np.arange(len(c))
                    row, nth = np.nonzero(cells >= 0)
                    yield pa.RecordBatch.from_arrays([*(part.column(x).take(pa.array(row)) for x in names), pa.array(cells[row, nth], pa.int32())], [*names, name])

        return vectors.mapInArrow(of_task, field)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, vec_id, score): the k live vectors of highest cosine for each query (query_id, embedding).

        ``probes`` cells are read for a query (by default as many as ``create`` found fit); ``exact`` reads all. Ties go
        by vec_id. Rows of a cell are dealt by a hash of their ids into blocks of about BLOCK_ROWS rows, the cell's queries into blocks
        of about BLOCK_QUERIES; each pair of blocks is one task's matrix product, and at most k rows for a query leave it.
        """
        state = self.state()
        cells = len(self.centroids)
        count = cells if exact else max(1, min(cells, probes or self.probes))
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        stored = self._rows(state)
        if count == cells:
            # Every row is compared, so cells say nothing: all count as one, and a query is copied for each block of rows alone.
            asked, stored = asked.withColumn("cell", F.lit(0)), stored.withColumn("cell", F.lit(0))
            state = State(state.version, state.commits, {0: n} if (n := sum(state.rows.values())) else {})
        else:
            asked = self._with_cells(asked, count, "cell")
        asked_of = {int(r.cell): r["count"] for r in asked.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
        held = {c: max(1, -(-n // BLOCK_ROWS)) for c, n in state.rows.items()}
        met = {c: max(1, -(-n // BLOCK_QUERIES)) for c, n in asked_of.items() if c in held}
        if not met:
            return self.spark.createDataFrame([], neighbours.SCHEMA)

        def of_cell(numbers: dict[int, int]) -> Column:
            return F.create_map(*[F.lit(x) for c in met for x in (c, numbers[c])])[F.col("cell")]

        def every(numbers: dict[int, int]) -> Column:
            return F.explode(F.sequence(F.lit(0), of_cell(numbers) - 1))

        def one(key: str, numbers: dict[int, int]) -> Column:
            return F.pmod(F.xxhash64(key, F.lit(3)), of_cell(numbers)).cast("int")

        # All rows of an id in a cell meet in one block, where the newest one decides.
        rows = stored.where(F.col("cell").isin(*met)).select("cell", "vec_id", "embedding", "version", "deleted")
        left = rows.withColumn("rows", one("vec_id", held)).withColumn("asked", every(met))
        right = asked.where(F.col("cell").isin(*met)).withColumn("asked", one("query_id", met)).withColumn("rows", every(held))

        def pair(vectors: pa.Table, queries: pa.Table) -> pa.Table:
            if not vectors.num_rows or not queries.num_rows:
                return neighbours.ARROW.empty_table()
            return neighbours.best(queries.select(["query_id", "embedding"]), _newest(vectors), k)

        keys = ("cell", "rows", "asked")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, neighbours.SCHEMA)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")


def _newest(rows: pa.Table) -> pa.Table:
    """Of each id the row of the highest version, if that is not a deletion. A version that moves an id has both; the live row counts."""
    sort = rows.sort_by([("vec_id", "ascending"), ("version", "descending"), ("deleted", "ascending")])
    ids = sort["vec_id"].to_numpy()
    first = np.append(True, ids[1:] != ids[:-1])
    keep = first & ~sort["deleted"].to_numpy(zero_copy_only=False).astype(bool)
    return sort.filter(pa.array(keep)).select(["vec_id", "embedding"])


def _usable(embedding: Column) -> Column:
    """Whether a vector has a direction."""
    big = F.array_max(F.transform(embedding, F.abs))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (big > 0), F.lit(False))


def _unit(embedding: Column) -> Column:
    """A vector of length 1 in the same direction."""

    def scaled(x: Column) -> Column:
        return F.transform(x, lambda y: y / F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, z: a + z * z)))

    return F.transform(F.array(F.transform(embedding, lambda y: y / F.array_max(F.transform(embedding, F.abs)))), scaled)[0]


def _probes(centroids: np.ndarray, rows: np.ndarray, wanted: float, k: int) -> int:
    """How many of a row's nearest cells hold the given share of its k nearest other rows, in this sample."""
    if len(rows) < 2 or len(centroids) < 2:
        return len(centroids)
    asked = rows[: max(1, 2_000_000 // len(rows))]
    half = (centroids * centroids).sum(1) / 2
    cell = np.argmin(half - rows @ centroids.T, axis=1)
    rank = np.argsort(np.argsort(half - asked @ centroids.T, axis=1), axis=1)
    score = asked @ rows.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-score, axis=1)[:, : min(k, len(rows) - 1)]
    ranks = np.sort(np.take_along_axis(rank, cell[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(wanted * len(ranks))))]) + 1
