"""Quality selection by importance resampling.

Words and pairs of neighbouring words are hashed into a fixed number of
buckets.  Two generative models are bucket distributions: of good labelled
documents (target) and of all documents (raw).  A document's importance is the
ratio of its probabilities under the two; adding Gumbel noise to its logarithm
and keeping the k largest samples k documents without replacement in
proportion to importance.

The raw model counts all documents; the target model and k come from labelled
rows, at most ``fit_rows`` of them.  k is all documents times the share of good
labels, taken at the upper end of its confidence interval, so that clean
documents aren't lost to the chance of the labels.

Edge cases: null texts and texts without words have no importance (null) and
are rejected; documents that tie with the k-th are kept; without labels
nothing can be told apart and all documents with words are kept; repeated rows
each count and share their noise; texts are read whole; an empty table gives
no rows; extra columns are kept by ``select`` and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 1 << 14


def features(texts: list) -> tuple:
    """(buckets of all n-grams, number of n-grams of each text); a null has none."""
    import zlib

    import numpy as np

    words = [[] if t is None else t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.array(list(map(len, words)))
    h = np.fromiter((x for w in words for x in map(zlib.crc32, w)), np.uint64, int(n.sum()))
    mixed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
    ends = np.cumsum(n)
    follows = np.ones(max(0, len(h) - 1), bool)  # a pair doesn't cross texts
    follows[ends[(ends > 0) & (ends < len(h))] - 1] = False
    pairs = mixed((h[:-1] * np.uint64(0x2545F4914F6CDD1D) ^ h[1:]) + np.uint64(1)) if len(h) > 1 else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), n)
    return mixed(h), text_of, pairs[follows], text_of[1:][follows] if len(h) > 1 else text_of[:0]


def _count(batches):
    """(text, good) -> n-grams of this task by bucket, in all texts and in good ones."""
    import numpy as np
    import pyarrow as pa

    common.claim_worker("quality")
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            good = np.array(part.column("good").fill_null(False).to_pylist(), bool)
            one, one_of, two, two_of = features(part.column("text").to_pylist())
            raw += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
            if good.any():
                target += np.bincount(one[good[one_of]], minlength=BUCKETS) + np.bincount(two[good[two_of]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _weigh(ratio, text_col: str):
    def run(batches):
        common.claim_worker("quality")
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                one, one_of, two, two_of = features(part.column(text_col).to_pylist())
                n = part.num_rows
                total = np.bincount(one_of, ratio[one], n) + np.bincount(two_of, ratio[two], n)
                some = np.bincount(one_of, minlength=n) > 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total, pa.float64(), mask=~some)], [*part.schema.names, "log_weight"])

    return run


def distinct_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, good, h) of every labelled id; of repeated labels of one id the worst holds."""
    one = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(F.col(f"`{label_col}`")).alias("q")).where("id is not null and q is not null")
    return one.select("id", (F.col("q") > 0).alias("good"), F.xxhash64("id", F.lit("fit")).alias("h"))


def labelled_sample(one: DataFrame, n: int, fit_rows: int) -> DataFrame:
    """(id, good), at most fit_rows of the n rows, by smallest hash."""
    if n > fit_rows:  # most are left out before the exact bound is drawn
        one = one.where(common.share_of(F.col("h")) < 1.2 * fit_rows / n)
    return one.orderBy("h").limit(fit_rows).select("id", "good")


class Model:
    """log_ratio: [BUCKETS]; good_share: the share of good labels, upper end."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", fit_rows: int = 20_000):
        import numpy as np

        one = distinct_labels(labels, id_col, label_col)
        n, good = one.agg(F.count(F.lit(1)), F.count_if("good")).first()  # the share is over all labels, the sample fits the models alone
        sample = common.materialize(labelled_sample(one, n, fit_rows), "labels")
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        rows = rows.join(F.broadcast(sample), "id", "left").select("text", "good")  # fit_rows rows at most
        counts = rows.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
        raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
        raw[counts["bucket"]] += counts["raw"]
        target[counts["bucket"]] += counts["target"]
        self.log_ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if sample.where("good").limit(1).count() else np.zeros(BUCKETS)
        self.good_share = wilson_upper(good, n) if n else 1.0
        self.text_col = text_col

    def weighed(self, docs: DataFrame) -> DataFrame:
        """docs (which must have no column of that name) with log_weight."""
        schema = T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType())])
        return docs.mapInArrow(_weigh(self.log_ratio, self.text_col), schema)


def wilson_upper(good: int, n: int, z: float = 3.0) -> float:
    p = good / n
    return min(1.0, (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def gumbel(key, seed: int = 0):
    """Standard Gumbel noise that key determines."""
    u = (F.pmod(F.xxhash64(key, F.lit("gumbel"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(scores: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column, exactly, by narrowing histograms.

    Each round brings 1024 counts to the driver; the last brings one bin of at
    most 5000 values.
    """
    scores = scores.where(F.col(column).isNotNull())
    n, low, high = scores.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    rank = k  # among values up to high
    while low < high:
        width = (high - low) / 1024
        inside = scores.where((F.col(column) >= low) & (F.col(column) <= high))
        at = F.least(F.lit(1023), F.floor((F.col(column) - low) / width)).cast("int")
        counts = inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect() if width > 0 else []
        if not counts:
            break
        for row in sorted(counts, key=lambda r: -r["b"]):
            if rank <= row["n"]:
                break
            rank -= row["n"]
        low, high = row["low"], row["high"]
        if row["n"] <= 5000:
            return sorted((r[0] for r in scores.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)[rank - 1]
    return low


class Resampling:
    """The fitted model and the score that the k-th document has; ``scores`` holds id, log_weight, score."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", seed: int = 0, **fit):
        self.id_col, self.seed = id_col, seed
        self.model = Model(docs, labels, id_col, text_col, label_col, **fit)
        self.scores = common.materialize(self.scored(common.picked(docs, id_col, text_col)).drop(text_col), "scores")
        k = math.ceil(self.model.good_share * self.scores.where("score is not null").count())
        self.limit = kth_largest(self.scores, "score", k)

    def scored(self, docs: DataFrame) -> DataFrame:
        return self.model.weighed(docs).withColumn("score", F.col("log_weight") + gumbel(F.col(f"`{self.id_col}`"), self.seed))

    def kept(self):
        return F.coalesce(F.col("score") >= self.limit, F.lit(False)) if self.limit is not None else F.lit(False)


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """id, log_weight, score (with noise), kept of every row."""
    done = Resampling(docs, labels, **options)
    return done.scores.withColumn("kept", done.kept())


def select(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with its columns.

    Texts are scored a second time rather than shuffled to their verdicts.
    """
    done, names = Resampling(docs, labels, **options), docs.columns
    spare = [c if c.lower() not in ("log_weight", "score") else common.unused(docs, c) for c in names]
    return done.scored(docs.toDF(*spare)).where(done.kept()).drop("log_weight", "score").toDF(*names)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "score", "kept")
