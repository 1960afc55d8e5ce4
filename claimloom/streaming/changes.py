"""Incremental maintenance of a snapshot from an ordered change log.

A change is (seq, key, op, payload).  Snapshots are directories of Parquet, one
generation each, named by the sequence number that they are at; the last whole
one is live.  A batch must follow the snapshot without a gap, no number may come
twice, and a change of a key must name the digest of the payload that it
replaces, where the log has a column ``previous``.  A retried batch changes
nothing, but must be the same one; anything else is a conflict and leaves the
snapshot as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.operators import bundles


class Conflict(ValueError):
    """A batch that doesn't follow from the snapshot."""


def digest(payload):
    return F.sha2(payload.cast("string"), 256)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema: str = "key string, seq long, payload string", keep: int = 8):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def generations(self) -> list[int]:
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [n for n in names if n.startswith("at-") and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n[3:]) for n in done)

    def head(self) -> int:
        return max(self.generations(), default=-1)

    def read(self, at: int | None = None) -> DataFrame:
        """The live snapshot, or the one pinned exactly; another is never given in its place."""
        held = self.generations()
        if at is None and not held:
            return self.spark.createDataFrame([], self.schema)
        pin = self.head() if at is None else at
        if pin not in held:
            raise LookupError(f"no snapshot at {pin}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/at-{pin}")

    def pin(self, at: int, log: DataFrame | None = None, consistency: str = "exact") -> tuple[int, bool]:
        """(generation to read, whether it is stale) for a query that asks for a number.

        exact: that generation or none.  allow_stale: else the last one before
        it, if the log (seq) leads from there to the number without a gap, so
        that it is an ancestor.
        """
        if consistency not in ("exact", "allow_stale"):
            raise ValueError(f"consistency {consistency!r}")
        held = self.generations()
        if at in held:
            return at, False
        older = max((g for g in held if g < at), default=None)
        if consistency == "exact" or older is None or log is None or not bundles.contiguous(log, older, at):
            raise LookupError(f"no snapshot at {at}")
        return older, True

    def apply(self, changes: DataFrame) -> int:
        """Apply changes after the head; returns the new head.

        The last change of each key holds; op delete removes it.
        """
        head = self.head()
        n, distinct, low, top, code = self._summary(changes)
        if not n:
            return head
        if distinct < n:
            raise Conflict("a change comes twice")
        if top <= head:
            self._same(low, top, n, code)
            return head
        if low <= head or (head >= 0 and low > head + 1) or top - low + 1 != n:
            raise Conflict(f"changes {low} to {top} don't follow {head} without a gap")
        if "previous" in changes.columns:
            self._linked(changes)
        last = changes.groupBy("key").agg(F.max_by(F.struct("op", "payload", "seq"), "seq").alias("c")).select("key", "c.*")
        old = self.read().join(last.select("key"), "key", "left_anti")
        merged = old.select("key", "seq", "payload").unionByName(last.where("op <> 'delete'").select("key", "seq", "payload"))
        # what was applied is kept first: a receipt without its snapshot says nothing, as the head is older
        receipt = self.spark.createDataFrame([(low, top, n, code)], "low long, top long, n long, code decimal(38,0)")
        receipt.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/receipt-{top}")
        merged.write.mode("overwrite").parquet(f"{self.path}/at-{top}")
        for stale in self.generations()[: -self.keep - 1]:
            fs, at = self._fs(f"{self.path}/at-{stale}")
            fs.delete(at, True)
        return top

    @staticmethod
    def _summary(changes: DataFrame) -> tuple:
        """Count, distinct numbers, least and greatest, and a sum of hashes, which whole batches add up to."""
        code = F.sum(F.xxhash64("seq", "key", "op", "payload").cast("decimal(38,0)"))
        return tuple(changes.agg(F.count(F.lit(1)), F.countDistinct("seq"), F.min("seq"), F.max("seq"), code).first())

    def _same(self, low: int, top: int, n: int, code) -> None:
        """Whether the same batches were applied before: a retry, or a union of batches."""
        fs, at = self._fs(self.path)
        tops = [int(s.getPath().getName()[8:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("receipt-")]
        held = self.spark.read.parquet(*[f"{self.path}/receipt-{t}" for t in tops]).where((F.col("top") >= low) & (F.col("low") <= top))
        if tuple(held.agg(F.min("low"), F.max("top"), F.sum("n"), F.sum("code")).first()) != (low, top, n, code):
            raise Conflict(f"changes {low} to {top} were applied before, but not as these")

    def _linked(self, changes: DataFrame) -> None:
        """Each change's ``previous`` must be the digest of the payload that its key has before it, null if none."""
        held = self.read().select("key", F.lit(-1).cast("long").alias("seq"), F.lit("put").alias("op"), "payload", F.lit(None).cast("string").alias("previous"))
        rows = held.unionByName(changes.select("key", F.col("seq").cast("long"), "op", "payload", "previous"))
        before = F.lag(F.when(F.col("op") != "delete", digest(F.col("payload")))).over(Window.partitionBy("key").orderBy("seq"))
        if rows.withColumn("_before", before).where((F.col("seq") >= 0) & ~F.col("previous").eqNullSafe(F.col("_before"))).limit(1).count():
            raise Conflict("a change replaces another payload than its key has")

    def follow(self, stream: DataFrame, checkpoint: str):
        """A streaming query that applies each micro-batch; available changes only, then it ends."""
        return stream.writeStream.foreachBatch(lambda df, _: self.apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_predecessors(changes: DataFrame) -> DataFrame:
    """Changes whose ``previous`` isn't the digest of the change before them, by key (first ones must have none)."""
    before = F.lag("digest").over(Window.partitionBy("key").orderBy("seq"))
    return changes.withColumn("_before", before).where(~F.col("previous").eqNullSafe(F.col("_before"))).drop("_before")


def windowed(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream by tumbling window; an extra beside the change log."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
