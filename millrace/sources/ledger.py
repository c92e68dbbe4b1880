"""A table of usage counters that is written back: conditional updates of the rows that a batch touches, in one commit.

Each key has a weekly, a monthly and a rolling counter with the times they count from. A charge adds to a counter whose time
lies in the charge's own week (from Monday on), month or rolling window, and else starts it anew. Keys lie in buckets by
a hash. A batch reads and rewrites the buckets of its keys only; the log file of its version names the folder of every
bucket, so all of them change at once, and a batch whose name the log already has changes nothing.

    root/rows/commit=*/bucket=*/   rows (key, weekly, monthly, rolling, last, anchor)
    root/batches/<name>            the version under which a batch was tried
    root/log/<version>.json        batch, and the folder of every bucket

Defined results: charges without a key or time are left out, a null cost counts as 0; a charge that is older than its
key's last one counts as if it came with it; charges of equal times go by cost; an empty batch is a version without changes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.commits import Conflict, Files
from millrace.streaming.scans import Rolling, scan

BUCKETS = 256
ROWS = "key long, weekly long, monthly long, rolling long, last timestamp, anchor timestamp, commit string, bucket int"
COLUMNS = ["key", "weekly", "monthly", "rolling", "last", "anchor"]


class Ledger:
    """The counters in a folder, as of its newest version."""

    def __init__(self, spark: SparkSession, root: str, window_seconds: int, buckets: int = BUCKETS):
        self.spark, self.root, self.window, self.buckets = spark, root, window_seconds, buckets
        self.files = Files(spark, root)

    def _entry(self, version: int) -> dict:
        return json.loads(self.files.read(f"log/{version:012d}.json"))

    def version(self) -> int:
        names = [n for n in self.files.names("log") if n.endswith(".json")]
        return int(names[-1].split(".")[0]) if names else 0

    def _folders(self, version: int) -> dict[int, str]:
        """The folder of every bucket that has rows."""
        return {int(b): c for b, c in self._entry(version)["buckets"].items()} if version else {}

    def rows(self, only: list[int] | None = None, version: int | None = None) -> DataFrame:
        """(key, weekly, monthly, rolling, last, anchor) of all buckets, or of some."""
        folders = self._folders(self.version() if version is None else version)
        by_commit: dict[str, list[int]] = {}
        for bucket, commit in folders.items():
            if only is None or bucket in only:
                by_commit.setdefault(commit, []).append(bucket)
        if not by_commit:
            return self.spark.createDataFrame([], ROWS).select(COLUMNS)
        wanted = F.lit(False)
        for commit, buckets in by_commit.items():
            wanted = wanted | ((F.col("commit") == commit) & F.col("bucket").isin(buckets))
        return self.spark.read.schema(ROWS).parquet(f"{self.root}/rows").where(wanted).select(COLUMNS)

    def _known(self, batch: str) -> bool:
        if f"{batch}" not in self.files.names("batches"):
            return False
        tried = int(self.files.read(f"batches/{batch}"))
        return tried <= self.version() and self._entry(tried)["batch"] == batch

    def apply(self, batch: str, charges: DataFrame) -> bool:
        """Count the charges (key, ts, cost) of a batch; whether it was new.

        A writer that finds its version taken by another raises ``Conflict``, and may try again.
        """
        if self._known(batch):
            return False
        version = self.version()
        given = charges.where("key is not null and ts is not null").select(F.col("key").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("cost").cast("long"), F.lit(0)).alias("cost"))
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in given.select(bucket).distinct().collect())  # at most as many as buckets
        folders = self._folders(version)
        if touched:
            name = uuid.uuid4().hex
            old = self.rows(touched, version)
            done = self._counted(old, given).withColumn("bucket", bucket)
            done.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/rows/commit={name}")
            folders |= dict.fromkeys(touched, name)
        if self._known(batch):  # another writer was faster
            return False
        for name_of in (f"batches/{batch}", f"batches/{batch}.claim"):  # an earlier try that was not committed
            self.files.delete(name_of)
        self.files.create(f"batches/{batch}", str(version + 1))
        entry = {"batch": batch, "buckets": {str(b): c for b, c in folders.items()}}
        try:
            self.files.create(f"log/{version + 1:012d}.json", json.dumps(entry))
        except Conflict:
            if touched:
                self.files.delete(f"rows/commit={name}")
            raise
        return True

    def _counted(self, old: DataFrame, charges: DataFrame) -> DataFrame:
        """The rows of the touched buckets after the charges."""
        # A charge never lies before what its key has counted.
        timed = charges.join(old.select("key", F.col("last").alias("__last")), "key", "left").withColumn("ts", F.greatest("ts", "__last")).drop("__last")
        stored = old.select("key", "last", "weekly", "monthly", F.lit(0).alias("kind"), F.unix_micros("anchor").alias("t"), F.col("rolling").alias("c"))
        events = timed.select("key", F.lit(1).alias("kind"), F.unix_micros("ts").alias("t"), F.col("cost").alias("c"))
        micros = self.window * 1_000_000
        # The stored window is the first row of its key, from which the fold goes on.
        rolled = scan(stored.select("key", "kind", "t", "c").unionByName(events), ["key"], ["kind", "t", "c"], "key long, t long, usage long", lambda: Rolling(micros))

        def period(unit: str, ts: str):
            return F.date_trunc(unit, ts)

        sums = timed.groupBy("key", period("week", "ts").alias("w"), period("month", "ts").alias("m")).agg(F.sum("cost").alias("s"), F.max("ts").alias("last"))
        stored_sums = {"week": "weekly", "month": "monthly"}
        counted = None
        for unit, name in stored_sums.items():
            per = sums.groupBy("key", F.col(unit[0]).alias("p")).agg(F.sum("s").alias("s"))
            held = old.select("key", period(unit, "last").alias("p"), F.col(name).alias("s"))
            both = per.unionByName(held).groupBy("key", "p").agg(F.sum("s").alias("s"))
            last = both.groupBy("key").agg(F.max_by("s", "p").alias(name))
            counted = last if counted is None else counted.join(last, "key")
        last = sums.select("key", "last").unionByName(old.select("key", "last")).groupBy("key").agg(F.max("last").alias("last"))
        window = rolled.select("key", F.col("usage").alias("rolling"), F.timestamp_micros("t").alias("anchor"))
        return counted.join(last, "key").join(window, "key").select(COLUMNS)
