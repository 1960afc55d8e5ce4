"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a temporary folder under a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under one that goes when the application ends."""
    own = f"{shared_dir(spark).rstrip('/')}/claimloom/{spark.sparkContext.applicationId}-graph"
    if own not in _OWN:
        _OWN.add(own)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


_OWN: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back, so that later steps neither repeat nor depend on its plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.written_to = path
    return held


#: Rows up to which a side that was counted is broadcast.
FEW = 500_000


def few(df: DataFrame, name: str) -> DataFrame:
    """df, written, and broadcast where it has few rows."""
    held = materialize(df, name)
    return F.broadcast(held) if held.count() <= FEW else held


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no plan reads any more."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ranked(df: DataFrame, order: list[tuple[Column, bool]], out: str) -> DataFrame:
    """df with ``out``: each row's place, from 0, in the order of columns, descending where the second says so.

    Rows are dealt by ranges of the order and counted in each, so no task holds
    more than a range, and the window over ranges has one row for each task.
    """
    taken, spare = {c.lower() for c in df.columns}, []
    for name in ("_part", "_nth", "_from", "_n", *(f"_k{i}" for i in range(len(order)))):
        while name in taken:
            name += "_"
        spare.append(name)
    part, nth, base, n, *keys = spare
    sort = [F.col(k).desc() if down else F.col(k) for k, (_, down) in zip(keys, order)]
    rows = df.withColumns(dict(zip(keys, (c for c, _ in order)))).repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = materialize(rows.withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id()).drop(*keys), "ranges")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias(n), F.min(nth).alias(base))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(base)).drop(n)
    return rows.join(F.broadcast(counts), part).withColumn(out, F.col(nth) + F.col(base)).drop(part, nth, base)
