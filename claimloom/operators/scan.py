"""Scans: points, adjacency, lifecycle by target, ordered records, change ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_id(claims: DataFrame, *ids: str) -> DataFrame:
    return claims.where(F.col("claim_id").isin(*ids))


def incident(claims: DataFrame, nodes: DataFrame, direction: str = "outgoing") -> DataFrame:
    """(node, orientation, claims.*) of claims at the given nodes (column ``node``).

    ``both`` gives a loop once, as outgoing.  Literals aren't nodes.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction {direction!r}")
    out = claims.join(nodes, claims["subject_id"] == nodes["node"]).select("node", F.lit("outgoing").alias("orientation"), *[claims[c] for c in claims.columns])
    ends = claims.where("object_kind = 'iri'")
    if direction == "both":
        ends = ends.where("object_id <> subject_id")
    inn = ends.join(nodes, ends["object_id"] == nodes["node"]).select("node", F.lit("incoming").alias("orientation"), *[ends[c] for c in claims.columns])
    return {"outgoing": out, "incoming": inn}.get(direction, out.unionByName(inn))


def page(df: DataFrame, key: str, after=None, size: int = 128) -> DataFrame:
    """The next rows in key order, after the last key of the page before."""
    if not 1 <= size <= 100_000:
        raise ValueError("a page holds 1 to 100000 rows")
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def change_range(changes: DataFrame, after: int, through: int) -> DataFrame:
    return changes.where((F.col("seq") > after) & (F.col("seq") <= through))


def as_of(rows: DataFrame, cutoff, column: str = "transaction_time") -> DataFrame:
    """Rows admitted at or before the cutoff."""
    return rows.where(F.col(column) <= F.lit(cutoff).cast("timestamp"))
