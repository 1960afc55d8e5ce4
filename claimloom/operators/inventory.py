"""Inventories, mapped fields and reports over claims."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classes(typed: DataFrame) -> DataFrame:
    """(class, entities): distinct subjects of each class; typed: (subject_id, class[, lifecycle_state])."""
    rows = typed.where("lifecycle_state = 'active'") if "lifecycle_state" in typed.columns else typed
    return rows.groupBy("class").agg(F.countDistinct("subject_id").alias("entities"))


def entities(claims: DataFrame, label: str = "label") -> DataFrame:
    """Per subject: its names, its relations to entities, how many there are, as sorted texts."""
    relation = F.when(F.col("object_kind") == "iri", F.col("relation"))
    return claims.groupBy("subject_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("relation") == label, F.col("object_id")))), "|").alias("names"),
        F.array_join(F.array_sort(F.collect_set(relation)), "|").alias("relations"),
        F.count_if(F.col("object_kind") == "iri").alias("n_links"),
    )


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit in order."""
    if offset < 0 or limit < 1:
        raise ValueError("offset and limit")
    return df.orderBy(*order).offset(offset).limit(limit)


def entities_page(claims: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of ``entities`` by subject: the page's subjects are found first, and only their claims gathered."""
    on = page(claims.select("subject_id").distinct(), ["subject_id"], offset, limit)
    return entities(claims.join(F.broadcast(on), "subject_id", "left_semi")).orderBy("subject_id")


def cursor(snapshot: str, query: str, offset: int) -> str:
    """A cursor that only fits the snapshot and query that it was made for."""
    return f"{offset}:{hashlib.sha256(f'{snapshot}|{query}|{offset}'.encode()).hexdigest()}"


def read_cursor(text: str, snapshot: str, query: str) -> int:
    offset = int(text.split(":", 1)[0])
    if cursor(snapshot, query, offset) != text:
        raise ValueError("cursor of another snapshot or query")
    return offset


def neighbour_literals(claims: DataFrame) -> DataFrame:
    """(claim_id, object_id, relation2, literal): the literal claims of the entities that claims lead to."""
    lit = claims.where("object_kind = 'literal'").select(F.col("subject_id").alias("object_id"), F.col("relation").alias("relation2"), F.col("object_id").alias("literal"))
    return claims.where("object_kind = 'iri'").select("claim_id", "object_id").join(lit, "object_id").select("claim_id", "object_id", "relation2", "literal")


def mapped(subjects: DataFrame, triples: DataFrame, predicate: str, inferred: DataFrame | None = None) -> DataFrame:
    """subjects (subject_id) with ``values``, the sorted distinct objects of the predicate, and their number; null where there are none."""
    rows = triples.where(F.col("p") == predicate).select("s", "o")
    if inferred is not None:
        rows = rows.unionByName(inferred.where(F.col("p") == predicate).select("s", "o"))
    got = rows.groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("values")).withColumn("n_values", F.size("values").cast("long"))
    return subjects.join(got, subjects["subject_id"] == got["s"], "left").drop("s")


def closed_graph(paths: DataFrame, claims: DataFrame) -> DataFrame:
    """Distinct nodes of paths and ends of claims: what a drawing of both needs."""
    nodes = paths.select(F.explode("nodes").alias("node"))
    ends = claims.select(F.col("subject_id").alias("node")).unionByName(claims.where("object_kind = 'iri'").select(F.col("object_id").alias("node")))
    return nodes.unionByName(ends).distinct()


def named_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with ``name``, their first label."""
    first = labels.groupBy("id").agg(F.min("label").alias("name"))
    return nodes.join(first, nodes["node"] == first["id"], "left").drop("id")


def complete_or_rejected(df: DataFrame, most: int) -> list:
    """All rows, or an error if there are more than most; never a part."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def quantile(values: Column, percent: int) -> Column:
    """The element at index (n - 1) * percent / 100, rounded down, of a sorted array."""
    return F.element_at(values, (F.floor((F.size(values) - 1) * percent / 100) + 1).cast("int"))


def latency_report(rows: DataFrame, stage: str, millis: str) -> DataFrame:
    """p50, p95 and maximum by stage, by discrete index.

    Values are ranked by a window and picked by index, so no stage's values
    are gathered in one row.
    """
    w = Window.partitionBy(stage)
    ranked = rows.where(F.col(millis).isNotNull()).select(stage, F.col(millis).alias("v"), (F.row_number().over(w.orderBy(millis)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda p: F.floor((F.col("n") - 1) * p / 100)
    return ranked.groupBy(stage).agg(F.first("n").alias("n"), F.max(F.when(F.col("i") == at(50), F.col("v"))).alias("p50"), F.max(F.when(F.col("i") == at(95), F.col("v"))).alias("p95"), F.max("v").alias("most"))


def set_root(df: DataFrame, column: str) -> DataFrame:
    """One row, ``root``: a digest of the distinct values of a column, in order of their own digests.

    Values are first summed up by the four leading hex digits of their digest,
    then the 65,536 sums, so one task sees at most that share of digests.
    """
    own = df.where(F.col(column).isNotNull()).select(F.sha2(F.col(column).cast("string"), 256).alias("d")).distinct()
    part = own.groupBy(F.substring("d", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("r"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "r"))), lambda x: F.concat_ws(":", x["b"], x["r"])), ","), 256).alias("root"))


def ngram_ranking(texts: DataFrame, column: str, sizes=(2, 3), most: int = 20) -> DataFrame:
    """The most frequent word n-grams: ngram, n."""
    from claimloom.functions import lexical

    words = F.split(lexical.segments(F.col(column)), " ")
    held = texts.select(F.array_compact(F.transform(words, lambda w: F.when(w != "", w))).alias("w"))
    grams = None
    for k in sizes:
        got = held.where(F.size("w") >= k).select(F.explode(_grams(k)).alias("ngram"))
        grams = got if grams is None else grams.unionByName(got)
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "ngram").limit(most)


def _grams(k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))
