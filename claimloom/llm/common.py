"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder of this machine is set
    under a local master; elsewhere executors couldn't share it, so that is an
    error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimloom-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under one that goes when the application ends."""
    own = f"{shared_dir(spark).rstrip('/')}/claimloom/{spark.sparkContext.applicationId}"
    kept = sys.__dict__.setdefault("_claimloom_folders", set())
    if own not in kept:
        kept.add(own)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, counted: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that ran on it.
    counted: a column whose sum and maximum are taken too (``sizes``).
    """
    path = scratch(df.sparkSession, name)
    write(df, path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.written_to = path
    if counted:
        total, most = held.agg(F.sum(counted), F.max(counted)).first()
        held.sizes = (total or 0, most or 0)
    return held


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no plan reads any more."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


#: Rows that go to a Python worker at once while a table is written.
BATCH_ROWS = 1000


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table, in Arrow batches that stay small where texts are long."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.set(name, before)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns of the given names and no others, whatever else df carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def worker_cache(name: str) -> dict:
    """A dict that lives in this Python worker until another operator claims it."""
    return sys.__dict__.setdefault("_claimloom_worker", {}).setdefault(name, {})


def claim_worker(owner: str) -> None:
    """Free what other operators, and tasks before, have left in this reused Python worker."""
    held = sys.__dict__.setdefault("_claimloom_worker", {})
    if held.get("owner") != owner:
        held.clear()
        held["owner"] = owner
        import gc

        gc.collect()
    trim()


def trim() -> None:
    """Give memory that allocators hold back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library keeps its own counsel
        pass


def join_spread(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right, which has each key once and in ``n`` the number of its rows in left, and was
    written with ``counted="n"``.

    Keys with more than a quarter of an even partition's rows are fewer than
    four for each partition, whatever the data: they are broadcast, and their
    rows stay where they are.  The others are dealt by key.
    """
    spark, rest = right.sparkSession, [c for c in right.columns if c not in (*keys, "n")]
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, most = right.sizes
    bar = total // parts
    even = right.where(F.col("n") <= bar).select(*keys, *rest)
    if most <= bar:
        return left.join(even, keys)
    hot = right.where(F.col("n") > bar).select(*keys, *rest)
    cool = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(even, keys)
    return left.join(F.broadcast(hot), keys).unionByName(cool)


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with ``out``: each row's place, from 0, in the order.

    Rows are dealt by ranges of the order and counted in each, so no task holds
    more than a range, and the window over ranges has one row for each task.
    """
    part, nth, base, n = (unused(df, x) for x in ("_part", "_nth", "_from", "_n"))
    keys = [unused(df, f"_k{i}") for i in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id()).drop(*keys), "ranges")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias(n), F.min(nth).alias(base))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(base)).drop(n)
    return rows.join(F.broadcast(counts), part).withColumn(out, F.col(nth) + F.col(base)).drop(part, nth, base)


def running_total(df: DataFrame, value: str, by: str, out: str, group: list[str] | None = None, span: int = 1000) -> DataFrame:
    """Append ``out``: the total of value over the rows of the group whose ``by``, a whole number from 0, is less.

    Two levels: within spans of by, and over the spans' totals, so no window
    holds more than span rows or one row a span.
    """
    group = group or []
    s, n, base = (unused(df, x) for x in ("_s", "_n", "_base"))
    rows = df.withColumn(s, F.floor(F.col(by) / span))
    earlier = Window.partitionBy(*group).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, s).agg(F.sum(value).alias(n)).withColumn(base, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    within = Window.partitionBy(*group, s).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn(n, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(sums, [*group, s]).withColumn(out, F.col(base) + F.col(n)).drop(s, n, base)


def buckets_for(rows: int, per_bucket: int = 50_000, least: int = 256) -> int:
    """Number of hash buckets of about per_bucket rows."""
    return max(least, -(-rows // per_bucket))


def global_index(df: DataFrame, group: list[str], tie: list[str], n_buckets: int, out: str, size: str | None = None) -> DataFrame:
    """Append ``out``: a 0-based position of each row in its group.

    Rows stand in the order of a bucket (a hash of ``tie``), then of ``tie``.
    With ``size``, rows are as long as that column says, and the position is
    the total of those before.  Two levels, so that a group holding a third of
    all rows is dealt over n_buckets tasks: positions run within (group,
    bucket), and buckets are offset by the total of the buckets before them;
    the window over totals has at most n_buckets rows in a group.
    """
    b, n, base = (unused(df, x) for x in ("_b", "_n", "_base"))
    long = F.col(size).cast("long") if size else F.lit(1).cast("long")
    rows = df.withColumn(b, F.pmod(F.xxhash64(*tie), F.lit(n_buckets)))
    sums = rows.groupBy(*group, b).agg(F.sum(long).alias(n))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    left, right = rows.alias("l"), sums.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, b)]
    joined = left.join(right, on, "left").select("l.*", F.col(f"r.{base}"))
    within = Window.partitionBy(*group, b).orderBy(*tie)
    if not size:
        at = F.row_number().over(within) - 1
    else:
        at = F.coalesce(F.sum(long).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn(out, F.col(base) + at).drop(b, base)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def share_of(hash_: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1, at the full resolution of a double."""
    return F.shiftrightunsigned(hash_, 1).cast("double") / float(1 << 63)


def words(text: Column) -> Column:
    """The words of a text, as an array; null or blank text has none."""
    blank = " \t\n\x0b\x0c\r"
    core = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(blank))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x09-\x0D\x20]+"))
