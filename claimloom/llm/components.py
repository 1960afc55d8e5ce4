"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges that one task may hold: up to here hubs need no care.
FEW = 2_000_000


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node.

    Each round hangs every node's neighbours on its least neighbour, first the
    larger ones, then the smaller ones, until the edges are stars.  Least
    neighbours are found by a map-side combined minimum and joined back; those
    of hubs, which are few, by broadcast (``common.join_spread``) where edges
    are more than FEW, so no task gathers more neighbours than that.  A round's edges are written to
    the shared folder, which cuts the lineage.  Null ends and loops are
    dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    u, v = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v")
    # greatest and least skip nulls, so a null end shows as a loop
    paths: list[str] = []

    def settled(df: DataFrame) -> DataFrame:
        paths.append(common.scratch(spark, "stars"))
        df.write.parquet(paths[-1])
        if len(paths) > 2:
            common.remove(spark, paths[-3])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def hung(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
        """rows joined with the least neighbour of their u."""
        if few:
            return rows.join(least.drop("n"), "u")
        held.append(common.materialize(least, "least", counted="n"))
        return common.join_spread(rows, held[-1], ["u"])

    held: list[DataFrame] = []

    now = settled(now.distinct())
    before = _signature(now)
    for _ in range(max_rounds if before[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        few = before[0] <= FEW
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hung(both, least, few).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settled(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hung(large, least, few).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = settled(small.where("u <> v").distinct())
        common.drop(*held)
        held.clear()
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
