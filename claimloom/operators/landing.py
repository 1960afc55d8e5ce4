"""Landing: anchors resolved to entities, exactly or by token overlap, and seeds ranked.

anchors: (block, role, anchor_idx, anchor); landing: (id, label), an entity
having any number of labels.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import lexical


def anchors_frame(spark, blocks: list[dict]) -> DataFrame:
    """anchors of blocks like {"from": [...], "to": [...]}.

    A local relation, whose size is known: joins with it leave the other side where it is.
    """
    rows = [(b, role, i, a) for b, block in enumerate(blocks) for role in ("from", "to") for i, a in enumerate(block.get(role) or [])]
    kinds = (("block", pa.int32()), ("role", pa.string()), ("anchor_idx", pa.int32()), ("anchor", pa.string()))
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)}))


def exact(anchors: DataFrame, landing: DataFrame) -> DataFrame:
    """Entities whose id or a label equals an anchor; score 1, earliest anchor."""
    named = landing.select("id", F.col("label").alias("name")).unionByName(landing.select("id", F.col("id").alias("name"))).where("name is not null")
    hits = anchors.join(named, anchors["anchor"] == named["name"])
    return _best(hits.select("block", "role", "id", F.lit(1).cast("long").alias("score"), "anchor_idx"))


def token_overlap(anchors: DataFrame, landing: DataFrame, least: int = 1) -> DataFrame:
    """Entities that share at least ``least`` tokens with an anchor in one label.

    An equal id or label (in lower case) scores twice the anchor's tokens plus
    one.  Labels are found through their tokens, not by comparing all pairs,
    and repeats are dropped among those found.
    """
    if least < 1:
        raise ValueError("least overlap must be positive")
    asked = anchors.withColumn("q", lexical.tokens(F.col("anchor"))).withColumn("full", 2 * F.size("q").cast("long") + 1)
    words = asked.select("block", "role", "anchor_idx", F.explode("q").alias("token"))
    labels = landing.where("label is not null").select("id", "label")
    held = labels.select("id", "label", F.explode(lexical.tokens(F.col("label"))).alias("token"))
    shared = words.join(held, "token").groupBy("block", "role", "anchor_idx", "id", "label").agg(F.count_distinct("token").alias("score")).where(F.col("score") >= least)
    part = shared.select("block", "role", "id", "score", "anchor_idx")
    low = labels.select("id", lexical.lower_each(F.col("label")).alias("name"))
    whole = asked.join(low, lexical.lower_each(F.col("anchor")) == F.col("name")).select("block", "role", "id", F.col("full").alias("score"), "anchor_idx")
    by_id = asked.join(landing.select("id"), F.col("anchor") == F.col("id")).select("block", "role", "id", F.col("full").alias("score"), "anchor_idx")
    return _best(part.unionByName(whole).unionByName(by_id))


def _best(hits: DataFrame) -> DataFrame:
    """Per block, role and entity, the best score, then the earliest anchor with it."""
    return hits.groupBy("block", "role", "id").agg(F.max(F.struct(F.col("score"), (-F.col("anchor_idx")).alias("i"))).alias("b")).select("block", "role", "id", F.col("b.score").alias("score"), (-F.col("b.i")).alias("anchor_idx"))


def seeds(landed: DataFrame, limit: int | None = 2) -> DataFrame:
    """(block, id, score, seed_rank) of the from side, best first; ``limit`` per block."""
    order = Window.partitionBy("block").orderBy(F.col("score").desc(), "id")
    ranked = landed.where("role = 'from'").withColumn("seed_rank", F.row_number().over(order))
    return (ranked if limit is None else ranked.where(F.col("seed_rank") <= limit)).select("block", "id", "score", "seed_rank")


def targets(landed: DataFrame) -> DataFrame:
    return landed.where("role = 'to'").select("block", "id")


def catalog_from_claims(claims: DataFrame, label_relations=("label",)) -> DataFrame:
    """(id, label): ids from both ends of claims, labels from textual-name literals."""
    ids = claims.select(F.col("subject_id").alias("id")).unionByName(claims.where("object_kind = 'iri'").select(F.col("object_id").alias("id"))).distinct()
    labels = claims.where(F.col("relation").isin(*label_relations) & (F.col("object_kind") == "literal")).select(F.col("subject_id").alias("id"), F.col("object_id").alias("label")).distinct()
    return ids.join(labels, "id", "left")


def latest_image(records: DataFrame, key: str, sequence: str, time: str, cutoff) -> DataFrame:
    """The last record of each key by sequence, if it was admitted by the cutoff (latest first, then the cutoff)."""
    latest = records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), F.col(sequence)).alias("_r")).select(key, "_r.*")
    return latest.where(F.col(time) <= F.lit(cutoff).cast("timestamp"))
