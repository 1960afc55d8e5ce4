"""Mixing sources to target weights.  DataFrame functions only.

Each source's documents form a stream of words, cut into blocks of a fixed
number of words.  A source's target, in whole words, is turned into slots of
one block: those of its whole passes over the source, then as many as the rest
needs, of which the last is cut to the words still due (a pass that is not
whole takes the source's short block, if it has one, last).  The slots of all sources are dealt to output shards of equal size by a
pseudorandom permutation, which draws each shard's source counts from the
multinomial distribution conditioned on the totals (so that totals are the
targets exactly, and no source runs over its limit by chance).  A source's
slots, numbered through its shards, are mapped through pseudorandom
permutations of its block numbers, one per pass over the source, and joined to
the documents that the blocks hold.

Edge cases: null text has no words and takes none; null source is a source of
its own, after all others; repeated rows each have a place in the stream;
documents of any length are cut into as many blocks as they need; empty
tables give no rows; extra columns are ignored, and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Slots of one source that one row is expanded to.
CHUNK = 16_384


def shuffled(x: Column, n: Column, *key, rounds: int = 20) -> Column:
    """The place of x under a pseudorandom permutation of 0 .. n-1 that ``key`` names.

    Swap-or-not: in each round x and its mirror image about a random point
    are swapped or not, by a bit that both of them hash to.
    """

    def step(at: Column, r: Column) -> Column:
        def swap(pair: Column) -> Column:
            a, b = pair["a"], pair["b"]
            return F.when(F.xxhash64(*key, r, F.greatest(a, b)).bitwiseAND(F.lit(1)) == 1, b).otherwise(a)

        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at + n, n)
        return common.let(F.struct(at.alias("a"), other.alias("b")), swap)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(source, size) -> source_id, source, source_size, n_docs, target.

    One row per source.  Sources stand by code point, null last, with weights
    repeating.  The level (words per unit of weight) is raised until targets,
    each stopped at max_repeats times its source's size, add up to all words;
    only sums come to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ordered = common.ranked(totals, [F.col("source").isNull(), F.col("source")], "source_id")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    ordered = common.materialize(ordered.withColumn("weight", weight), "sources")
    most = F.lit(max_repeats) * F.col("source_size")
    all_words = ordered.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = most < F.lit(level) * F.col("weight")
        got = ordered.agg(F.count_if(full).alias("n"), F.sum(F.when(full, most).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if got["n"] == stopped or not got["open"]:
            break
        stopped, level = got["n"], (all_words - got["held"]) / got["open"]
    target = F.least(most.cast("double"), F.lit(level) * F.col("weight"))
    return ordered.select("source_id", "source", "source_size", "n_docs", target.alias("target"))


class Mix:
    """A mix of documents: where each document stands, and how often each block is taken."""

    def __init__(self, rows: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, block_words: int = 256, shard_slots: int = 4096, seed: int = 0):
        """rows: source, size and columns that tell rows apart."""
        self.block_words, self.key = block_words, [c for c in rows.columns if c not in ("source", "size")]
        self.targets = targets = source_targets(rows, weights, max_repeats)
        # a null source is told apart by a flag, so that sources are joined by equality and large ones apart
        known = targets.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"), "source_id", "source_size", "target", F.col("n_docs").alias("n"))
        own = rows.withColumns({"_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
        joined = common.join_spread(own, common.materialize(known, "targets", counted="n"), ["_none", "_name"]).drop("_none", "_name")
        n_buckets = common.buckets_for(rows.count())
        self.placed = common.materialize(common.global_index(joined, ["source_id"], [*self.key, "size"], n_buckets, "start", size="size"), "stream")

        plan = targets.where("source_size > 0").withColumn("words", F.least(F.lit(max_repeats) * F.col("source_size"), F.round("target").cast("long")))
        plan = plan.withColumns({"blocks": F.expr(f"(source_size + {block_words - 1}) div {block_words}"), "full": F.expr(f"source_size div {block_words}"), "passes": F.expr("words div greatest(source_size, 1)")})
        plan = plan.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        # the words of the last slot, where the last pass is not whole
        plan = plan.withColumns({"slots": F.expr(f"passes * blocks + (rest + {block_words - 1}) div {block_words}"), "cut": F.when(F.col("rest") > 0, (F.col("rest") - 1) % block_words + 1)}).where("slots > 0")
        plan = common.running_total(plan, "slots", "source_id", "first")
        self.plan = plan = common.materialize(plan.select("source_id", "blocks", "slots", "first", "full", "passes", "cut"), "slots")
        self.all_slots = all_slots = plan.agg(F.sum("slots")).first()[0] or 0

        # each source's slots among all slots, expanded in chunks, dealt to shards
        # (rows are few before they are expanded, so their partitions are counted by slots rather than left to their size)
        width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), all_slots // 200_000)
        chunks = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK)))).repartition(width, "source_id", "chunk")
        one = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1))
        slots = chunks.withColumn("slot", one).select("source_id", (F.col("first") + F.col("slot")).alias("slot"))
        dealt = slots.select("source_id", F.floor(shuffled(F.col("slot"), F.lit(max(1, all_slots)).cast("long"), F.lit(seed)) / shard_slots).alias("shard"))
        counts = dealt.groupBy("source_id", "shard").agg(F.count(F.lit(1)).alias("n"))
        #: Per output shard and source: slots drawn, and the source's slots in earlier shards.
        self.counts = common.materialize(common.running_total(common.materialize(counts, "drawn"), "n", "shard", "from", ["source_id"]), "shards")

        of = [c for c in plan.columns if c != "first"]
        numbered = self.counts.join(plan.select(*of), "source_id").repartition(width, "source_id", "shard").select("shard", *of, F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("nth"))
        turn, at = F.expr("nth div blocks"), F.col("nth") % F.col("blocks")
        among = F.when(turn < F.col("passes"), F.col("blocks")).otherwise(F.greatest("full", F.lit(1)))
        drawn = shuffled(F.least(at, among - 1), among, F.lit(seed), F.col("source_id"), turn)
        block = F.when(at < among, drawn).otherwise(F.col("blocks") - 1)
        #: One row per slot: its shard, the block that it takes, and how many of the block's words where not all.
        self.slots = numbered.select("source_id", "shard", "nth", block.alias("block"), F.when(F.col("nth") == F.col("slots") - 1, F.col("cut")).alias("cut"))

    def taken_blocks(self) -> DataFrame:
        """placed, one row per document and block, or part of a cut block, that it has words in: block, from (its word there), n words, uses."""
        L = self.block_words
        uses = self.slots.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("uses"), F.max("cut").alias("cut"))
        part = lambda low, high, n: F.struct(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"), n.alias("uses"))
        n, cut = F.col("uses"), F.col("cut")
        parts = F.when(cut.isNull(), F.array(part(0, L, n))).otherwise(F.array(part(0, cut, n), part(cut, L, n - 1)))
        uses = uses.select("source_id", "block", F.inline(parts))
        end = F.col("start") + F.col("size")
        inside = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / L), F.floor((end - 1) / L))))
        inside = inside.join(uses, ["source_id", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
        first = F.greatest(F.col("start"), F.col("block") * L + F.coalesce("low", F.lit(0)))
        last = F.least(end, F.col("block") * L + F.coalesce("high", F.lit(L)))
        return inside.withColumn("from", first - F.col("start")).withColumn("n", last - first).where("n > 0").drop("low", "high")

    def taken(self) -> DataFrame:
        """placed with ``taken``: words the mix takes of each document, repeats counted."""
        of = [c for c in self.placed.columns]
        some = self.taken_blocks().groupBy(*of).agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
        return some.unionByName(self.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """id, size, source_size, target, taken of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    done = Mix(common.materialize(rows, "sizes"), **options)
    return done.taken().select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix, with the columns of docs.

    A document comes once for each pass that takes words of it: whole where
    the pass takes all its blocks, else with the words of those it takes, in
    order and with the white space after them.
    """
    text = F.col(f"`{text_col}`")
    digest = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit(1))
    key, twin, uses = (common.unused(docs, x) for x in ("_key", "_twin", "_uses"))
    same = Window.partitionBy("id", "key").orderBy("source")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("key"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"))
    rows = common.materialize(rows.withColumn("twin", F.row_number().over(same)), "sizes")
    done = Mix(rows, **options)
    part = F.struct("from", "n", "uses")
    # a document's list is no longer than the document
    lists = done.taken_blocks().where("uses > 0").groupBy("id", "key", "twin").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("uses").alias("most"), F.sum("n").alias("held"), F.first("size").alias("size"))
    own = docs.withColumn(key, digest)
    own = own.withColumn(twin, F.row_number().over(Window.partitionBy(f"`{id_col}`", key).orderBy(F.col(f"`{source_col}`").cast("string"))))
    left, right = own.alias("l"), lists.alias("r")
    on = F.col(f"l.`{id_col}`").eqNullSafe(F.col("r.id")) & (F.col(f"l.{key}") == F.col("r.key")) & (F.col(f"l.{twin}") - F.col("r.twin") == 0)
    joined = left.join(right, on).select("l.*", F.struct("r.parts", "r.most", "r.held", "r.size").alias(uses))
    turn = common.unused(joined, "_turn")
    out = joined.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{uses}.most"))))
    chosen = F.filter(F.col(f"{uses}.parts"), lambda p: p["uses"] >= F.col(turn))
    whole = F.aggregate(chosen, F.lit(0).cast("long"), lambda a, p: a + p["n"]) == F.col(f"{uses}.size")
    stripped = F.regexp_replace(text, r"^[\x09-\x0D\x20]+", "")
    pieces = F.split(stripped, r"(?<=[\x09-\x0D\x20])(?=[^\x09-\x0D\x20])")
    cut = common.let(pieces, lambda w: F.array_join(F.transform(chosen, lambda p: F.array_join(F.slice(w, (p["from"] + 1).cast("int"), p["n"].cast("int")), "")), ""))
    out = out.withColumn(text_col, F.when(whole, text).otherwise(cut))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
