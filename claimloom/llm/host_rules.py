"""Host-level quality rules.

Each document is measured against base rules.  Failures are added up by host
(the ``source`` column), a host's failure rate is shrunk towards the corpus
with a beta prior fitted to all hosts, and documents of hosts whose shrunk
rate is too high go with it.  DataFrame functions only.

Edge cases: null text has no words and fails the base rule for length; a
document without host is judged by the base rules alone; repeated rows count
each; an empty table gives no rows; texts of any length are measured whole
(windows of words are compared by 64-bit hashes); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Number of words that stand in 3-word windows found twice or more, the first included.

    Windows are hashed, hashes are sorted with their positions in their low
    bits, equal neighbours are marked, and the words that marked windows cover
    are counted: n log n in the words, and nothing beyond the row itself.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.struct(h.alias("h"), F.length(F.bin(n)).alias("bits")), marked)))

    def marked(x: Column) -> Column:
        h, bits = x["h"], x["bits"]
        power = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
        keyed = F.sort_array(F.transform(h, lambda v, i: F.call_function("shiftleft", v, bits).bitwiseOR(i.cast("long"))))
        return let(F.struct(h.alias("h"), bits.alias("bits"), (power - 1).alias("mask"), keyed.alias("s")), covered)

    def covered(x: Column) -> Column:
        h, s, mask, bits = x["h"], x["s"], x["mask"], x["bits"]
        last = F.size(s) - 1
        high = lambda v: F.call_function("shiftright", v, bits)
        at = lambda v: v.bitwiseAND(mask).cast("int")
        same = lambda p, q: (high(s[p]) == high(s[q])) & (h[at(s[p])] == h[at(s[q])])
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(k - 1, k)).otherwise(F.lit(False)) | F.when(k < last, same(k, k + 1)).otherwise(F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda k: at(s[k])))
        start = F.struct(F.lit(0).alias("c"), F.lit(-3).alias("p"))
        return F.aggregate(places, start, lambda acc, p: F.struct((acc["c"] + F.least(F.lit(3), p - acc["p"])).alias("c"), p.alias("p")), lambda acc: acc["c"])

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(of(w))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The base rules' figures of a text, by name."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    solid = F.translate(text, BLANK, "")
    has_word = lambda line: F.translate(line, BLANK, "") != ""
    lines = lambda t: F.filter(F.split(t, "\n"), has_word)
    both = let(common.words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return {
        "words": both,
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.5
) -> DataFrame:
    """One row per row of docs: the measures, base_failed, host_rate (shrunk) and kept."""
    found = measures(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").cast("string").alias("host"), *[c.alias(n) for n, c in found.items()])
    rows = rows.select("id", "host", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("words.r").alias("n_repeat_words"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    rows = common.materialize(rows, "measures")
    hosts = rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    mean, strength = beta_prior(hosts)
    hosts = hosts.select("host", ((F.col("failed") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))
    joined = rows.join(hosts, "host", "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate)
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))


#: The prior counts as at least, and at most, this many documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(mean, strength) of the beta prior of failure rates: alpha = mean * strength.

    Moments of the beta-binomial: of the spread of the hosts' observed rates,
    what chance alone would give is taken off, and the rest is the spread of
    their true rates.  Where none is left (hosts of one document each say
    nothing of it), the prior is as strong as it may be, and hosts get the
    corpus's rate.  One row of sums comes to the driver.
    """
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("f2")
    ).first()
    if not total["n"]:
        return 0.0, LEAST_STRENGTH
    mean = total["failed"] / total["n"]
    chance, free = mean * (1 - mean), total["hosts"] - 1
    room = total["n"] - total["n2"] / total["n"] - free
    if chance <= 0 or room <= 0:
        return mean, MOST_STRENGTH
    alike = ((total["f2"] - mean * total["failed"]) / chance - free) / room  # correlation of a host's documents
    return mean, MOST_STRENGTH if alike <= 1 / (MOST_STRENGTH + 1) else max(LEAST_STRENGTH, 1 / alike - 1)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("host_rate")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
twice as (select doc_id, g from win group by doc_id, g having count(*) > 1),
marks as (select distinct doc_id, i + k as p from win join twice using (doc_id, g), (values (0), (1), (2)) as o(k)),
rep as (select doc_id, count(*) as n_repeat_words from marks group by doc_id),
base as (
  select doc_id, source, len(w) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join rep using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
h as (select source, count(*) as n, sum(base_failed::int) as failed from f where source is not null group by source),
m as (
  select sum(failed) / sum(n) as mean, count(*) - 1 as free, sum(n) - sum(n::double * n) / sum(n) - (count(*) - 1) as room,
    sum(failed::double * failed / n) - sum(failed) / sum(n) * sum(failed) as spread from h),
a as (select mean, case when mean * (1 - mean) <= 0 or room <= 0 then 0 else (spread / (mean * (1 - mean)) - free) / room end as alike from m),
p as (select mean, case when alike <= 1 / (1e6 + 1) then 1e6 else greatest(1.0, 1 / alike - 1) end as s from a),
r as (select source, (failed + mean * s) / (n + s) as rate from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(rate, 0) <= 0.5 as kept
from f left join r using (source)
"""
