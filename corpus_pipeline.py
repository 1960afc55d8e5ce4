"""The training-corpus pipeline: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the docs of the next.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import common, line_dedup, mixing, ngram_join, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go.

    Texts that are null or without words go with them.  Repeated rows of one
    id share their noise, and stay or go alike; documents that tie with the
    last one stay; without labels all with words stay.  An empty table stays
    empty; columns keep their names, whatever they are.
    """
    return quality.select(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; documents that lose all their words go.

    Null texts, and texts without words from the start, stay as they are;
    documents with null id come last in the order of copies; repeated rows of
    one id and text lose the same lines.  n_chars, where there is one, follows
    the text.
    """
    cut = line_dedup.without_repeats(docs, removed_col=(removed := common.unused(docs, "_removed")))
    left = cut.where(F.col(removed).isNull() | F.col("text").rlike(common.WORD)).drop(removed)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the first by id (nulls last), then class and row number.

    Rows without words are in no group and stay.  Verdicts are joined back by
    id and a hash of the text; rows that repeat both are told apart by number.
    """
    id_, text = F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, nth = common.unused(docs, "_key"), common.unused(docs, "_nth")
    join = ngram_join.Join(docs.withColumn("doc_id", F.struct(id_.alias("id"), F.xxhash64(text, F.lit(1)).alias("key"))))
    rows = join.signed.select("id", "n", "class").join(join.components, "class", "left").where("n > 0").withColumn("root", F.coalesce("root", "class"))
    place = F.struct(F.col("id.id").isNull().alias("last"), F.col("id.id").alias("id"), "class", F.col("id.key").alias("key"))
    least = rows.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # of a group, the rows of one (id, class, key) stay together here, and the first of them alone below
    verdict = rows.join(least, "root").select(F.col("id.id").alias("id"), F.col("id.key").alias("key"), (place == F.col("first")).alias("first")).distinct()
    verdict = common.materialize(verdict, "duplicates")
    if verdict.count() <= ngram_join.BROADCAST_IDS:
        verdict = F.broadcast(verdict)
    d, v = docs.withColumn(key, F.xxhash64(text, F.lit(1))).alias("d"), verdict.alias("v")
    on = F.col("d.doc_id").eqNullSafe(F.col("v.id")) & (F.col(f"d.{key}") == F.col("v.key"))
    judged = d.join(v, on, "left").select("d.*", F.col("v.first").alias(nth)).where(F.coalesce(F.col(nth), F.lit(True)))
    alone = judged.where(F.col(nth).isNull()).drop(key, nth)
    firsts = judged.where(F.col(nth)).drop(nth)
    firsts = firsts.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.lit(1)))).where(F.col(nth) == 1).drop(key, nth)
    return alone.unionByName(firsts)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated and thinned to their target weights.

    A document comes once for each pass that takes words of it; null sources
    are one source; texts without words are in no pass, and go.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of 4096 tokens; an empty text is its separator alone, each row is packed."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Sampling, hashing and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.materialize(docs, "stage")
    return docs
