"""Token counts with a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the
SHA-256 of its file.  Texts whose pair of digests the cache holds are counted
by a join; only one text of each missing digest is encoded, and its count is
appended to the cache.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
each get a row; texts of any length are encoded whole; an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: White space other than space, tab and newline: a text that has some is encoded in one piece.
_RARE_SPACE = "\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
#: Distinct chunks that a Python worker keeps, none longer than LONG characters.
_KEPT, LONG = 400_000, 256


def file_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def load_tokenizer(path: str):
    """The worker's tokenizer for path, loaded once."""
    held = common.worker_cache("tokenizers")
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        held[path] = tok
    return held[path]


def normalised(text: Column) -> Column:
    """The content that counts are a function of: the text, a null being empty.

    Byte-level tokenizers tell any two texts apart, so nothing else may be
    folded without changing counts.
    """
    return F.coalesce(text.cast("string"), F.lit(""))


class ChunkCounter:
    """Counts of whole texts as sums over chunks, each chunk encoded once.

    A chunk is a run of space, tab and newline with the run of other
    characters after it.  The byte-level pre-tokenizer never joins characters
    from both sides of such a boundary, so counts add up exactly.  Texts with
    other white space are encoded in one piece.
    """

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.cache = common.worker_cache("counts " + path)
        self.cut = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+").findall
        self.rare = re.compile(f"[{_RARE_SPACE}]").search

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        cache, out = self.cache, [0] * len(texts)
        chunked, whole = [], []
        for i, t in enumerate(texts):
            if self.rare(t):
                whole.append(i)
            else:
                chunked.append((i, self.cut(t)))
        new: set[str] = set()
        for _, chunks in chunked:
            new.update(chunks)
        new.difference_update(cache)
        todo = list(new)
        for at in range(0, len(todo), 20_000):
            part = todo[at : at + 20_000]
            cache.update(zip(part, self._encode(part)))
        get = cache.__getitem__
        for i, chunks in chunked:
            out[i] = sum(map(get, chunks))
        for at in range(0, len(whole), 64):
            part = whole[at : at + 64]
            for i, n in zip(part, self._encode([texts[i] for i in part])):
                out[i] = n
        if len(cache) > _KEPT:
            cache.clear()
        for c in todo:
            if len(c) > LONG:
                cache.pop(c, None)
        return out


def _counts(path: str):
    def run(batches):
        common.claim_worker("token counts")
        import pyarrow as pa

        counter = ChunkCounter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = counter.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens.

    cache_path: a Parquet table of CACHE_SCHEMA, made if there is none; its
    folder must be shared by driver and executors.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    content = normalised(F.col(f"`{text_col}`"))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), content.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # the partial aggregate leaves one text of a digest in each task, so large groups of copies don't meet in one
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known(), "digest", "left_anti")
    counted = misses.mapInArrow(_counts(tokenizer_path), "digest binary, n_tokens long")
    common.write(counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens"), cache_path, "append")
    sized = common.materialize(keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "sized")
    found = sized.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(known(), "digest")
    return common.join_spread(sized, common.materialize(found, "counts", counted="n"), ["digest"]).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under byte_bpe_50k.json, from a fresh cache."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    counts = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), common.scratch(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
