"""Removal of repeated runs of lines, by winnowing.

A document is its sequence of lines that aren't blank.  From each line, the
shortest run of lines with ``gram_words`` words is a gram; the shortest run
with ``run_words`` words from each line, and that up to each line, is a window.
Each window selects the gram of least hash among those inside it (the last of
equals); a document's fingerprints are its selected positions, each once.
Equal windows select alike, so any repeated run of run_words words shares one.

1. Fingerprints are joined: those whose gram no other position has go.  They
   are few beside the windows, and all that most text is left with.
2. A match is extended both ways, to the windows that selected the position,
   and verified there: of the positions with the same window the first in the
   corpus (documents by id, then lines) stays, the others are repeats.
   Windows that touch make up longer runs; each line of a repeated run lies in
   a window inside the run, in the one from the line or in the one up to it.
3. The lines of repeats are deleted.

The first occurrence of any content stays, since each deletion has an earlier
copy.  A document repeats itself only where its own earlier run ends before
the later begins.  Lines are compared without white space at their ends;
grams and windows by 64-bit hashes of their lines' hashes.

A gram or window that very many positions share is joined apart from the
others, by broadcast, which doesn't move its positions (see
``common.join_spread``); counts and firsts are aggregated before shuffles.

Edge cases: null text has no lines and stays null; documents with null id come
after all others; rows that repeat id and text are one document, so all keep
the same lines; equal ids with different texts are ordered by a hash of the
text; texts of any length and number of lines are read whole; an empty table
gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Deletion lists are broadcast up to this many rows and lines, and joined by a shuffle beyond.
BROADCAST_ROWS, BROADCAST_LINES = 500_000, 4_000_000


def shortest_runs(words: list[int], least: int) -> list[int]:
    """For each start, the end (exclusive) of the shortest run with that many words; -1 if none."""
    out, end, total = [], 0, 0
    for i, n in enumerate(words):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        out.append(end if total >= least else -1)
        total -= n
    return out


def shortest_both_ways(words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs with that many words from each start and up to each end."""
    n = len(words)
    forth = {(start, end) for start, end in enumerate(shortest_runs(words, least)) if end >= 0}
    back = {(n - end, n - start) for start, end in enumerate(shortest_runs(words[::-1], least)) if end >= 0}
    return sorted(forth | back)


def fingerprints(hashes: list[int], words: list[int], gram_words: int, run_words: int) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """(position, gram hash) of each gram that a window selects -> the windows that did: (start, end, content hash)."""
    from xxhash import xxh3_64_intdigest

    raw = b"".join(h.to_bytes(8, "little") for h in hashes)
    ends = shortest_runs(words, gram_words)
    grams = [xxh3_64_intdigest(raw[8 * i : 8 * e]) if e >= 0 else 0 for i, e in enumerate(ends)]
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for start, end in shortest_both_ways(words, run_words):
        least, at = min((grams[i], -i) for i in range(start, end) if 0 <= ends[i] <= end)
        out.setdefault((-at, least), []).append((start, end, xxh3_64_intdigest(raw[8 * start : 8 * end])))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hashes(text: str) -> tuple[list[int], list[int], list[int]]:
    """(numbers, hashes, word counts) of the lines that aren't blank."""
    from xxhash import xxh3_64_intdigest

    numbers, hashes, words = [], [], []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        n = len(line.split())
        if n:
            numbers.append(i)
            hashes.append(xxh3_64_intdigest(line.strip()))
            words.append(n)
    return numbers, hashes, words


MARKS = "array<struct<mark:long,windows:array<struct<start:int,end:int,content:long>>>>"


def _sequences(gram_words: int, run_words: int):
    def run(batches):
        common.claim_worker("lines")
        import pyarrow as pa

        window = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("content", pa.int64())])
        kind = pa.list_(pa.struct([("mark", pa.int64()), ("windows", pa.list_(window))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lines, marks = [], []
                for text in part.column("text").to_pylist():
                    numbers, own, words = line_hashes(text)
                    lines.append(numbers)
                    found = fingerprints(own, words, gram_words, run_words)
                    marks.append([{"mark": _signed(m), "windows": [{"start": s, "end": e, "content": _signed(c)} for s, e, c in w]} for (_, m), w in found.items()])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(lines, pa.list_(pa.int32())), pa.array(marks, kind)], ["id", "key", "lines", "marks"])

    return run


def document_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def removals(docs: DataFrame, id_col="doc_id", text_col="text", gram_words: int = 25, run_words: int = 50) -> DataFrame:
    """(id, key, removed): the numbers of the lines to delete, of documents that have some."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where("text is not null")
    rows = rows.withColumn("key", document_key(F.col("id"), F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    made = f"id {kind}, key long, lines array<int>, marks {MARKS}"
    sequences = common.materialize(rows.mapInArrow(_sequences(gram_words, run_words), made), "lines")

    # fingerprints that several positions share, and the windows that selected them
    marks = sequences.select("id", "key", F.explode("marks").alias("m")).select("id", "key", "m.mark", "m.windows")
    shared = common.materialize(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "marks", counted="n")
    met = common.join_spread(marks, shared, ["mark"]).select("id", "key", F.explode("windows").alias("w"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key", "w.start").alias("place")
    met = common.materialize(met.select("w.content", place, "w.end"), "windows")

    first = met.groupBy("content").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = common.materialize(first, "firsts", counted="n")
    later = common.join_spread(met, first, ["content"]).where("place > first")
    own = F.col("place.id").eqNullSafe(F.col("first.id")) & (F.col("place.key") == F.col("first.key"))
    later = later.where(~own | (F.col("first.start") + F.col("end") - F.col("place.start") <= F.col("place.start")))  # else it overlaps its own first occurrence
    spans = later.select("place.id", "place.key", F.struct("place.start", "end").alias("span"))
    spans = spans.groupBy("id", "key").agg(F.collect_set("span").alias("spans"))  # no more than the document's windows
    s, q = spans.alias("s"), sequences.select("id", "key", "lines").dropDuplicates(["id", "key"]).alias("q")
    joined = s.join(q, F.col("s.id").eqNullSafe(F.col("q.id")) & (F.col("s.key") == F.col("q.key"))).select("s.id", "s.key", "spans", "lines")
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.slice("lines", x["start"] + 1, x["end"] - x["start"]))))
    return joined.select("id", "key", F.array_sort(covered).alias("removed"))


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", removed_col: str | None = None, **options) -> DataFrame:
    """docs with later repeated runs of lines deleted from their texts.

    removed_col: name of a column to add, with the numbers of the deleted
    lines (null if none).
    """
    gone = common.materialize(removals(docs, id_col, text_col, **options), "removed")
    n, lines = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and lines <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    key = common.unused(docs, "_key")
    removed = removed_col or common.unused(docs, "_removed")
    text = F.col(f"`{text_col}`").cast("string")
    left, right = docs.withColumn(key, document_key(F.col(f"`{id_col}`"), text)).alias("d"), gone.alias("g")
    on = F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.id")) & (F.col(f"d.{key}") == F.col("g.key"))
    joined = left.join(right, on, "left").select("d.*", F.col("g.removed").alias(removed)).drop(key)
    left_over = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    kept = common.let(F.split(text, "\n"), lambda x: F.array_join(F.transform(left_over(x), lambda i: x[i]), "\n"))
    out = joined.withColumn(text_col, F.when(F.col(removed).isNull(), text).otherwise(kept))
    return out if removed_col else out.drop(removed)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines deleted (their numbers too), and what remains, as a digest."""
    docs = common.picked(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    docs = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    done = without_repeats(docs, removed_col="removed")
    return done.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"), F.md5("text").alias("text_md5"))
