"""Jaccard self-join of documents on word shingles, by a token-group matrix.

A document is the set of its distinct 5-word shingles (64-bit hashes).  Two
link when 100 * |A and B| >= 80 * |A or B|.  Only distinct sets are compared;
copies share a class.

1. *Groups.*  Sets are partitioned into groups of similar ones: each set is
   compared with the least set in each of a few min-hash buckets, and verified
   links are closed into connected groups.  Work is linear in the sets, however
   large a bucket.
2. *Matrix.*  For each group, the union of its members' prefix tokens is
   stored.  A set's prefix holds its first n - ceil(0.8 n) + 1 tokens under one
   global order, so linked sets share a prefix token, and linked sets of
   different groups put a token into both groups' unions.  The order has
   tokens that very many documents carry last, the rarer of them before the
   more frequent, and all others by hash before.  So what sets have of their
   own comes first, and common passages stay out of prefixes where they can.
3. *Bound and open.*  Pairs of groups that share a token are candidates.  Of a
   pair that links, the first shared token stands at places i and j with
   i + j <= (n + m) / 9, as all before it differ; so one of the two has it
   among its first ninth.  A token that is ordered last pairs only rows of
   which one has it there, and only within that sum: sets that share a licence
   or a passage, but have more than a ninth of their own, never meet over it.
   Single sets carry the parities of how many of their tokens fall on each of
   512 places.  A token that one of two sets has alone turns one place, so the
   sets differ in as many tokens as places or more; where these are too many
   for a link, the pair is left out as it is met.  Single sets that share one of
   the few tokens before a token that is ordered last have met over it, and
   don't meet again.
   The members of the smaller group are queries against blocks of the larger:
   a query's overlap with the block's whole token union bounds its overlap
   with any member, and only blocks where the bound reaches 80 % are opened and
   their members verified.

Every link between sets of different groups is found; sets of one group are
connected by verified links.  Links between sets that are alone are verified
nearest first, and not at all where their ends are connected already.
Components of all links give the result.  Work that isn't linear is left only where very many texts, not
linked with one another, lie just below the threshold: their pairs are looked at.

Buckets, tokens and sets that very many rows share are split: joins on them
deal their rows over tasks by a second hash, and repeat the other side.

Shingles are 64-bit hashes, sets are told apart by 128-bit hashes of theirs:
two shingles of a pair of documents with k words are taken for one with a
chance of about k^2 / 2^65, and the result is exact but for that.

Edge cases: null texts, empty and blank texts have no shingles and link with
nothing; shorter texts are one shingle; repeated rows are copies; of sets that
tie as the least of a bucket or group the first by hash leads it, and
components are named by the least id whichever leads; null ids take part, but
name no component; texts are read whole; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Min-hash keys of a set, and tokens in a key.
BANDS, BAND_TOKENS = 5, 2
#: Tokens in more heads than this are ordered last; at most HOT_MOST of them, 12 bytes each, are broadcast.
HOT_COUNT, HOT_MOST = 32, 1 << 20
#: Tokens before a token in its set that the rows of single sets carry, of those that sets share.
BEFORE = 4
#: Numbers of 64 bits that hold a set's parities: enough for sets of some 600 tokens, longer ones are told apart by their prefixes.
PARITY = 8
#: Rows of one token, or one set, that a task of a join gets.
DEALT = 2000
#: Members of a block that one task opens at a time.
BLOCK = 512
#: Pairs that are verified at once are at most so many for each set that has one.
EACH = 4
#: Ids that are broadcast to select texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_hashes(text: str | None, n: int):
    """The distinct shingles of a text, as sorted unsigned 64-bit hashes."""
    import numpy as np

    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    from xxhash import xxh3_64_intdigest as digest

    own = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(n, len(words))
    mixed = np.full(len(words) - width + 1, width if width < n else 0, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - width + 1 + k]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which linked sets must share one: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def band_keys(tokens) -> list[int]:
    """Keys that similar sets are likely to share: each hashes the least tokens under some orders."""
    import numpy as np

    keys = []
    for b in range(BANDS):
        key = b + 1
        for j in range(BAND_TOKENS):
            odd = np.uint64((0x9E3779B97F4A7C15 * (2 * (b * BAND_TOKENS + j) + 1)) & 0xFFFFFFFFFFFFFFFF)
            turned = tokens * odd
            turned ^= turned >> np.uint64(31)
            key = (key * 0xD6E8FEB86659FD93 + int(tokens[int((turned * np.uint64(0xBF58476D1CE4E5B9)).argmin())])) & 0xFFFFFFFFFFFFFFFF
        keys.append(key - (1 << 64) if key >> 63 else key)
    return keys


def parities(tokens):
    """For each of 64 * PARITY places, whether an odd number of the tokens falls on it, as PARITY numbers."""
    import numpy as np

    place = (tokens >> np.uint64(20)) % np.uint64(64 * PARITY)
    odd = np.bincount(place.astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def head_length(n: int, percent: int) -> int:
    """Tokens of a set that are stored: enough for a prefix of which a third is put last."""
    p = prefix_length(n, percent)
    return min(n, p + p // 2 + 8)


def _lists(arrays):
    """Arrays of unsigned tokens as one Arrow list column."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if len(arrays) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _arrays(column):
    """The lists of an Arrow column as unsigned arrays."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum([0, *(x or 0 for x in column.value_lengths().to_pylist())])
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def _sign(n: int, percent: int):
    """Texts -> size, class, band keys, first tokens by hash and parities of their sets."""

    def run(batches):
        common.claim_worker("shingles")
        import hashlib

        import numpy as np
        import pyarrow as pa

        none = np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_hashes(t, n) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(list(map(len, sets)), pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                        pa.array([band_keys(x) if len(x) else None for x in sets], pa.list_(pa.int64())),
                        _lists([x[: head_length(len(x), percent)] if len(x) else none for x in sets]),
                        _lists([parities(x) if len(x) else none for x in sets]),
                    ],
                    ["id", "n", "class", "bands", "head", "odd"],
                )

    return run


def _count_tokens(batches):
    """Lists of tokens -> tokens, counted within batches.

    A row is one number: the token without its low 8 bits, and its count.
    """
    common.claim_worker("shingles")
    import numpy as np
    import pyarrow as pa

    low = np.uint64(255)
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        if len(flat):
            token, count = np.unique(flat | low, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(((token ^ low) | np.minimum(count, 255).astype(np.uint64)).view(np.int64))], ["packed"])


def put_in_order(tokens, counts):
    """(tokens, ranks): distinct tokens sorted, and the place of each by ascending count."""
    import numpy as np

    tokens, first = np.unique(tokens, return_inverse=True)
    most = np.zeros(len(tokens), np.int64)
    np.maximum.at(most, first, counts)
    ranks = np.empty(len(tokens), np.uint64)
    ranks[np.lexsort((tokens, most))] = np.arange(len(tokens), dtype=np.uint64)
    return tokens, ranks


def ordered_prefix(tokens, n: int, percent: int, late):
    """(prefix, whether tokens were enough) of a set of n, of which the first by hash are given.

    The order of all tokens is that of a number: the token's hash without its
    lowest bit; or, where the token is put last, the highest bit, its rank
    among those, and the eight bits that the ranks don't tell apart.  Prefixes
    hold these numbers, sorted.
    """
    import numpy as np

    p = prefix_length(n, percent)
    keys, (names, ranks) = tokens >> np.uint64(1), late
    if not len(names):
        return keys[:p], True
    masked = tokens | np.uint64(255)
    at = np.minimum(np.searchsorted(names, masked), len(names) - 1)
    put_last = names[at] == masked
    first = keys[~put_last][:p]
    if len(first) == p:
        return first, True
    last = np.uint64(1 << 63) | (ranks[at[put_last]] << np.uint64(8)) | (tokens[put_last] & np.uint64(255))
    return np.concatenate([first, np.sort(last)[: p - len(first)]]), len(tokens) == n


def _prefixes(percent: int, late):
    """(class, n, bands, head, odd, row) -> (class, n, bands, odd, row, prefix, short)."""

    def run(batches):
        common.claim_worker("shingles")
        import pyarrow as pa

        last = late.value
        for batch in batches:
            got = [ordered_prefix(h, k, percent, last) for k, h in zip(batch.column("n").to_pylist(), _arrays(batch.column("head")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("n"), batch.column("bands"), batch.column("odd"), batch.column("row"), _lists([g[0] for g in got]), pa.array([not g[1] for g in got], pa.bool_())],
                ["class", "n", "bands", "odd", "row", "prefix", "short"],
            )

    return run


def _whole_prefixes(percent: int, late):
    """(class, tokens) -> (class, n, prefix)."""

    def run(batches):
        common.claim_worker("shingles")
        import pyarrow as pa

        last = late.value
        for batch in batches:
            sets = _arrays(batch.column("tokens"))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(list(map(len, sets)), pa.int64()), _lists([ordered_prefix(x, len(x), percent, last)[0] for x in sets])], ["class", "n", "prefix"])

    return run


class Block:
    """Members of a group with an index from token to members; the tokens are the group's union."""

    def __init__(self, table, column: str):
        import numpy as np

        self.sets = _arrays(table.column(column).combine_chunks())
        sizes = np.array(list(map(len, self.sets)), np.int64)
        flat, of = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), sizes)
        order = np.argsort(flat, kind="stable")
        self.union, self.first = np.unique(flat[order], return_index=True)
        self.of, self.last = of[order], np.append(self.first[1:], len(flat))

    def shared(self, own):
        """How many of own's tokens are in the union, and in each member."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if not len(at):
            return 0, np.zeros(len(self.sets), np.int64)
        return len(at), np.bincount(np.concatenate([self.of[self.first[k] : self.last[k]] for k in at]), minlength=len(self.sets))


def _bound(percent: int):
    """A block and queries, by their prefixes -> the queries (and members) that may link."""

    def run(key, members, queries):
        common.claim_worker("shingles")
        import numpy as np
        import pyarrow as pa

        names, found = [], set()
        if members.num_rows and queries.num_rows:
            block, sizes = Block(members, "prefix"), members.column("n").to_numpy()
            who = members.column("class").to_pylist()
            ends = np.array([x[-1] for x in block.sets], np.uint64)
            for name, n, own in zip(queries.column("name").to_pylist(), queries.column("size").to_pylist(), _arrays(queries.column("own").combine_chunks())):
                _, shared = block.shared(own)
                open_ = np.flatnonzero((shared > 0) & (100 * sizes >= percent * n) & (100 * n >= percent * sizes))
                kept = []
                for k in open_:
                    # all tokens up to the end of the prefix that ends first are known, so those not shared differ
                    end = min(own[-1], ends[k])
                    differ = int(np.searchsorted(own, end, "right") + np.searchsorted(block.sets[k], end, "right")) - 2 * int(shared[k])
                    if (100 + percent) * differ <= (100 - percent) * (n + int(sizes[k])):
                        kept.append(who[k])
                if kept:
                    names.append(name)
                    found.update(kept)
        rows = [(n, True) for n in set(names)] + [(n, False) for n in found]
        k = len(rows)
        first = lambda c: pa.array([key[c].as_py()] * k, pa.int64())
        return pa.table({"g": first(0), "block": first(1), "class": pa.array([r[0] for r in rows], pa.binary()), "asks": pa.array([r[1] for r in rows], pa.bool_())})

    return run


def _pair_bound(percent: int):
    """Pairs of sets with their prefixes -> the pairs that may link, and the share that is known to differ."""

    def run(batches):
        common.claim_worker("shingles")
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep, share = [], []
            sets = zip(_arrays(batch.column("pa")), _arrays(batch.column("pb")), batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            for k, (x, y, n, m) in enumerate(sets):
                end = min(x[-1], y[-1])
                x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
                differ = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                if (100 + percent) * differ <= (100 - percent) * (n + m):
                    keep.append(k)
                    share.append(differ / (n + m))
            keep = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(share, pa.float64())], ["a", "b", "apart"])

    return run


def _open(percent: int):
    """A block and queries, by their whole sets -> one verified link of each query that has any.

    Members of a group are connected, so one link of a query to it is enough.
    """

    def run(key, members, queries):
        common.claim_worker("shingles")
        import numpy as np
        import pyarrow as pa

        a, b = [], []
        if members.num_rows and queries.num_rows:
            block = Block(members, "tokens")
            who, sizes = members.column("class").to_pylist(), np.array(list(map(len, block.sets)))
            for name, own in zip(queries.column("name").to_pylist(), _arrays(queries.column("own").combine_chunks())):
                bound, shared = block.shared(own)
                if 100 * bound < percent * max(len(own), int(sizes.min())):
                    continue  # the union itself shares too little
                hit = np.flatnonzero(100 * shared >= percent * (sizes + len(own) - shared))
                if len(hit):
                    a.append(name)
                    b.append(who[hit[0]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _ends(pairs: DataFrame, a: str = "a", b: str = "b", out: str = "class") -> DataFrame:
    """(class) of the sets that pairs (a, b) have; each end is made distinct by itself first."""
    return pairs.select(F.col(a).alias(out)).distinct().unionByName(pairs.select(F.col(b).alias(out)).distinct()).distinct()


def _early(info: str) -> Column:
    """Whether a row of the matrix has its token early; see ``Join._across``."""
    return F.col(info).bitwiseAND(F.lit(1)) == 1


def _place(info: str) -> Column:
    return F.shiftright(info, 1).bitwiseAND(F.lit((1 << 20) - 1))


def _both_alone() -> Column:
    return (F.col("i") >= 0) & (F.col("j") >= 0)


class Join:
    """Documents, their classes, and the components of links between classes.

    ``signed``: id, n, class of every row.  ``components``: (class, root) of
    classes with a link.
    """

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", n: int = 5, percent: int = 80):
        spark, self.n, self.percent = docs.sparkSession, n, percent
        self.rows = rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        path = common.scratch(spark, "heads")
        signs = rows.mapInArrow(_sign(n, percent), kind := f"id {kind}, n long, class binary, bands array<long>, head array<long>, odd array<long>")
        common.write(signs.withColumn("row", F.monotonically_increasing_id()), path)
        heads = spark.read.schema(kind + ", row long").parquet(path)
        self.signed = common.materialize(heads.select("id", "n", "class"), "signed")
        own = heads.where("n > 0").select("class", "n", "bands", "head", "odd", "row")
        made = "class binary, n long, bands array<long>, odd array<long>, row long, prefix array<long>, short boolean"
        self.late = self._put_last(own, made)
        # each set once, under the number of its first row; where copies are few, rows stay where they are
        copies = own.groupBy("class").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = common.materialize(copies, "copies", counted="n")
        if copies.sizes[0] <= BROADCAST_IDS:
            again = common.join_spread(own.select("class", "row"), copies, ["class"]).where("row <> first").select("row")
            sets = own.join(F.broadcast(again), "row", "left_anti").select(*own.columns).mapInArrow(_prefixes(percent, self.late), made)
        else:
            sets = own.mapInArrow(_prefixes(percent, self.late), made).groupBy("class").agg(F.min_by(F.struct("n", "bands", "odd", "row", "prefix", "short"), "row").alias("s")).select("class", "s.*")
        self.sets = common.materialize(sets, "sets")
        del own, heads, sets, signs
        common.drop(copies)
        common.remove(spark, path)
        common.tidy(spark)
        missing = self.sets.where("short").select("class")
        whole = "class binary, n long, prefix array<long>"
        prefixes = self.sets.where("not short").select("class", "n", "row", "prefix")
        if missing.limit(1).count():
            found = self._with_tokens(missing).mapInArrow(_whole_prefixes(percent, self.late), whole)
            found = found.join(self.sets.where("short").select("class", "row"), "class").select("class", "n", "row", "prefix")
            prefixes = prefixes.unionByName(common.materialize(found, "prefixes"))
        self.prefixes = prefixes
        self.components = self._across(self._groups())

    def _put_last(self, own: DataFrame, made: str):
        """Broadcast of the tokens (their low 8 bits set) that the order puts last, and their ranks: HOT_MOST at most.

        They are those in more than HOT_COUNT stored heads; and, as sets that
        are left with too short a head must look further, those in more than
        HOT_COUNT of such sets.  Any choice gives the same links; this one
        keeps frequent tokens out of prefixes.
        """
        import numpy as np

        spark = own.sparkSession
        found, counts = self._frequent(own.select("head"), HOT_MOST)
        common.tidy(spark)
        for _ in range(3):
            held = spark.sparkContext.broadcast(put_in_order(found, counts))
            short = own.mapInArrow(_prefixes(self.percent, held), made).where("short").select("class").distinct()
            short = common.materialize(short, "short")
            if not short.limit(1).count():
                return held
            tokens = self._with_tokens(short)
            more, n = self._frequent(tokens.select("tokens"), HOT_MOST)
            common.drop(short, tokens)
            known = np.isin(more, found)
            room = np.flatnonzero(~known)[: HOT_MOST - len(np.unique(found))]
            found, counts = np.concatenate([found, more[known], more[room]]), np.concatenate([counts, n[known], n[room]])
            if not len(room):
                break
        return spark.sparkContext.broadcast(put_in_order(found, counts))

    def _frequent(self, lists: DataFrame, most: int):
        """(tokens, counts) of those in more than HOT_COUNT of the lists, the most frequent ``most`` of them at most."""
        import numpy as np

        packed = lists.mapInArrow(_count_tokens, "packed long")
        token = F.col("packed").bitwiseOR(F.lit(255))
        counts = packed.groupBy(token.alias("token")).agg(F.sum(F.col("packed").bitwiseAND(F.lit(255))).alias("n")).where(F.col("n") > HOT_COUNT)
        counts = common.materialize(counts, "late")
        least, total = HOT_COUNT, 0
        by = {r["b"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(by, reverse=True):
            total += by[b]
            if total > most:
                least = 2 ** ((b + 1) / 4)
                break
        found = counts.where(F.col("n") >= least).toArrow()
        common.drop(counts)
        tokens, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
        by = np.argsort(-n, kind="stable")
        return tokens[by], n[by]

    def _with_tokens(self, classes: DataFrame) -> DataFrame:
        """(class, tokens) of the given distinct classes, from the text of one document each."""
        small = classes.count() <= BROADCAST_IDS
        chosen = F.broadcast(classes) if small else classes
        one = self.signed.where("n > 0").join(chosen, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id"), F.count("id").alias("named"))
        one = common.materialize(one, "chosen")
        # rows of one id with different texts, or null ids: all their texts are tokenised, and told apart by class
        named = one.where("named > 0").select("id").distinct()
        texts = self.rows.join(F.broadcast(named) if small else named, "id", "left_semi")
        if one.where("named = 0").limit(1).count():
            texts = texts.unionByName(self.rows.where("id is null"))
        n = self.n

        def made(batches):
            common.claim_worker("shingles")
            import hashlib

            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    got = [x for x in (shingle_hashes(t, n) for t in batch.column("text").slice(at, 1000).to_pylist()) if len(x)]
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in got], pa.binary()), _lists(got)], ["class", "tokens"])

        found = texts.select("text").mapInArrow(made, "class binary, tokens array<long>")
        held = common.materialize(found.join(chosen, "class", "left_semi").dropDuplicates(["class"]), "tokens")
        common.drop(one)
        return held

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link.

        A set with many pairs is sent to several tasks, DEALT pairs each.
        """
        pairs = common.materialize(pairs, "pairs")
        tokens = self._with_tokens(_ends(pairs))
        of = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        few = (of.agg(F.max("k")).first()[0] or 0) <= DEALT
        left = tokens.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
        if few:
            dealt, left = pairs.withColumn("slot", F.lit(0).cast("long")), left.withColumn("slot", F.lit(0).cast("long"))
        else:
            many = common.materialize(of.where(F.col("k") > DEALT).select("a", F.ceil(F.col("k") / DEALT).alias("k")), "many")
            many = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
            dealt = pairs.join(many, "a", "left").withColumn("slot", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1)))).drop("k")
            left = left.join(many, "a", "left").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)) - 1))).drop("k")
        both = dealt.join(tokens.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b").join(left, ["a", "slot"])
        both = both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("shared"))
        links = both.where(100 * F.col("shared") >= self.percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")
        links = common.materialize(links, "links")
        common.drop(pairs, tokens)
        return links

    def _spanning(self, pairs: DataFrame) -> DataFrame:
        """Links of pairs (a, b, apart), as many as connect what all links of them connect.

        While pairs are many beside their sets, those that look nearest at
        each set are verified, a few more in each round, and pairs whose ends
        are connected by then needn't be: in a large family most go unlooked
        at.  When a round leaves more than half, or pairs are few, the rest is
        verified whole, so nothing that links is missed.
        """
        left, tries, links = common.materialize(pairs, "candidates"), 2, None
        n, before = left.count(), None
        while n > EACH * _ends(left).count() and (before is None or 2 * n < before):
            near = lambda end, other: left.withColumn("r", F.row_number().over(Window.partitionBy(end).orderBy("apart", other))).where(F.col("r") <= tries).drop("r")  # noqa: B023, E731
            chosen = common.materialize(near("a", "b").unionByName(near("b", "a")).distinct(), "nearest")
            found = self._verified(chosen.select("a", "b"))
            links = found if links is None else common.materialize(links.unionByName(found), "links")
            roots = connected_components(links, "a", "b")
            ends = [roots.select(F.col("node").alias(e), F.col("component").alias("root_" + e)) for e in ("a", "b")]
            rest = left.join(chosen.select("a", "b"), ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
            rest = common.materialize(rest.where("root_a is null or root_b is null or root_a <> root_b").select("a", "b", "apart"), "candidates")
            common.drop(left, chosen)
            left, tries, before = rest, 4 * tries, n
            n = left.count()
        found = self._verified(left.select("a", "b"))
        return found if links is None else links.unionByName(found)

    def _groups(self) -> DataFrame:
        """(class, component) of sets in a group of several, connected by verified links to the first of their buckets."""
        keys = self.sets.select("class", "n", F.posexplode("bands").alias("band", "key"))
        least = keys.groupBy("band", "key").agg(F.min(F.struct("class", "n")).alias("first"), F.max("class").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first.class") < F.col("last")).drop("last")
        least = common.materialize(least.select("band", "key", "first", F.col("n").alias("rows")).withColumnRenamed("rows", "n"), "buckets", counted="n")
        pairs = common.join_spread(keys.withColumnRenamed("n", "size"), least, ["band", "key"]).where(F.col("class") > F.col("first.class"))
        pairs = pairs.where((100 * F.col("size") >= self.percent * F.col("first.n")) & (100 * F.col("first.n") >= self.percent * F.col("size")))
        links = self._verified(pairs.select(F.col("first.class").alias("a"), F.col("class").alias("b")).distinct())
        found = common.materialize(connected_components(links, "a", "b").withColumnRenamed("node", "class"), "parts")
        common.tidy(self.signed.sparkSession)
        return found

    def _numbered(self, found: DataFrame) -> DataFrame:
        """class, component, n, prefix of each set, and g, a number of its group (or of a set that is alone) that no other has.

        It is the number of a set's first row, and of a group that of its
        first set, so sets that lie together have numbers alike.
        """
        parts = found.join(self.sets.select("class", "row"), "class")
        parts = common.materialize(parts.join(parts.groupBy("component").agg(F.min("row").alias("least")), "component").select("class", "component", "least"), "numbers")
        parts = F.broadcast(parts) if parts.count() <= BROADCAST_IDS else parts
        return self.prefixes.join(parts, "class", "left").select("class", "component", "n", "prefix", F.coalesce("least", "row").alias("g"))

    def _across(self, found: DataFrame) -> DataFrame:
        """(class, root) of classes with a link; found: groups."""
        spark, t = self.signed.sparkSession, self.percent
        members = self._numbered(found)

        # the matrix: a row per token and group; info: for single sets, n, the token's place in the prefix and its lowest bit,
        # which says that the token is early: among the first ninth of a set's, or of some member's; negative for groups
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cell = members.select("g", "component", "n", F.posexplode("prefix").alias("place", "token"))
        cell = cell.withColumn("early", ((100 + t) * F.col("place") <= (100 - t) * F.col("n")).cast("long"))
        one = F.col("n") * (1 << 21) + F.least(F.col("place"), F.lit((1 << 20) - 1)).cast("long") * 2 + F.col("early")
        single = cell.where("component is null").select("token", "g", one.alias("info"))
        several = cell.where("component is not null").groupBy("token", "g").agg((F.max("early") - 2).alias("info"))
        matrix = single.unionByName(several).repartition(width, "token")
        # tokens that two groups have, and, of those put last, that one has early; it looks at all columns, so the rows are dealt once
        shared = matrix.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.max(_early("info")).alias("any"), F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("k"))
        shared = shared.where("low < high and (token >= 0 or any)").select("token", "k")
        matrix = common.materialize(matrix.join(shared.hint("shuffle_hash"), "token"), "matrix")
        common.tidy(spark)

        # rows of single sets get their sets' parities, and the tokens before theirs
        odd, before = [f"odd{i}" for i in range(PARITY)], [f"before{i}" for i in range(BEFORE)]
        own = members.where("component is null").select("g", "class").join(self.sets.select("class", *[F.col("odd")[i].alias(x) for i, x in enumerate(odd)]), "class").drop("class")
        bare, order = matrix, Window.partitionBy("g").orderBy(_place("info"), "token")
        matrix = bare.where("info >= 0").join(own, "g").withColumns({x: F.lag("token", i + 1).over(order) for i, x in enumerate(before)})
        matrix = common.materialize(matrix.unionByName(bare.where("info < 0"), allowMissingColumns=True), "parities")
        common.drop(bare)
        common.tidy(spark)

        near = self._met(matrix).groupBy("g", "h").agg(F.count_if(~F.col("late")).alias("c"), F.max(F.when(~F.col("late"), F.col("i"))).alias("ci"), F.max(F.when(~F.col("late"), F.col("j"))).alias("cj"), F.max("i").alias("i"), F.max("j").alias("j"))
        alone, n, m = _both_alone(), F.shiftright("i", 21), F.shiftright("j", 21)
        # bound for single sets that share tokens before those put last: up to the last of these, what isn't shared differs
        differ = _place("ci") + _place("cj") + 2 - 2 * F.col("c")
        fits = (F.col("c") == 0) | ((100 + t) * differ <= (100 - t) * (n + m))
        near = common.materialize(near.where(~alone | fits).select("g", "h", alone.alias("alone")), "near")
        common.drop(matrix)
        common.tidy(spark)

        ends = common.materialize(_ends(near, "g", "h", "g"), "ends")
        names = members.select("class", "g", "n", "prefix").join(F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends, "g", "left_semi")
        names = common.materialize(names, "members")
        # both ends are dealt by one exchange
        pairs = near.where("alone").alias("p").join(names.alias("x"), F.col("p.g") == F.col("x.g")).join(names.alias("y"), F.col("p.h") == F.col("y.g"))
        pairs = pairs.select(*[F.col(f"{side}.{c}").alias(out + end) for side, end in (("x", "a"), ("y", "b")) for c, out in (("class", ""), ("n", "n"), ("prefix", "p"))])
        pairs = pairs.mapInArrow(_pair_bound(t), "a binary, b binary, apart double")
        links = self._spanning(pairs).unionByName(self._opened(near.where("not alone"), names))
        inner = found.where(F.col("class") != F.col("component")).select(F.col("class").alias("a"), F.col("component").alias("b"))
        return connected_components(common.materialize(links, "cross").unionByName(inner), "a", "b").select(F.col("node").alias("class"), F.col("component").alias("root"))

    def _met(self, matrix: DataFrame) -> DataFrame:
        """(late, g, h, i, j and more) of rows of one token that meet: those of groups, and those of single sets that may link."""
        t = self.percent
        # two rows of a token meet once: both before the tokens that are put last (which are negative), or one early;
        # rows of a frequent token are dealt by slots, the other tokens' rows meet as they lie
        few = matrix.where("k = 1")
        x, y = few.alias("x"), few.alias("y")
        met = [x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.g") < F.col("y.g")) & ((F.col("x.token") >= 0) | _early("x.info") | _early("y.info")))]
        many = matrix.where("k > 1")
        if many.limit(1).count():
            x = many.where((F.col("token") >= 0) | _early("info")).withColumn("slot", F.pmod(F.hash("g"), F.col("k"))).alias("x")
            y = many.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).alias("y")
            once = (F.col("x.g") < F.col("y.g")) | ((F.col("x.token") < 0) & ~_early("y.info") & (F.col("x.g") != F.col("y.g")))
            met.append(x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.slot") == F.col("y.slot")) & once))
        n, m = F.shiftright("i", 21), F.shiftright("j", 21)
        turn = F.col("x.g") > F.col("y.g")
        pick = lambda a, b, name: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(name)
        apart = reduce(Column.__add__, [F.bit_count(F.col(f"x.odd{k}").bitwiseXOR(F.col(f"y.odd{k}"))) for k in range(PARITY)])
        # single sets that share one of the tokens before have met over it, nearer to their beginnings
        again = reduce(Column.__or__, [F.col(f"x.before{a}") == F.col(f"y.before{b}") for a in range(BEFORE) for b in range(BEFORE)])
        columns = ((F.col("x.token") < 0).alias("late"), apart.alias("apart"), F.coalesce(again, F.lit(False)).alias("again"), pick("x.g", "y.g", "g"), pick("y.g", "x.g", "h"), pick("x.info", "y.info", "i"), pick("y.info", "x.info", "j"))
        met = reduce(DataFrame.unionByName, [part.select(*columns) for part in met])
        alone, sizes = _both_alone(), (100 * n >= t * m) & (100 * m >= t * n)
        first = ~F.col("late") | (((100 + t) * (_place("i") + _place("j")) <= (100 - t) * (n + m)) & ~F.col("again"))
        close = (100 + t) * F.col("apart") <= (100 - t) * (n + m)
        return met.where(~alone | (sizes & first & close))

    def _opened(self, near: DataFrame, names: DataFrame) -> DataFrame:
        """Links between groups of which one at least has several sets: the smaller's members against the larger's blocks."""
        held = names.join(_ends(near, "g", "h", "g"), "g", "left_semi")
        sizes = common.materialize(held.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low"), F.max("n").alias("high")), "sizes")
        other = sizes.select(F.col("g").alias("h"), F.col("m").alias("mh"), F.col("low").alias("lowh"), F.col("high").alias("highh"))
        sized = near.join(sizes, "g").join(other, "h").where((100 * F.col("high") >= self.percent * F.col("lowh")) & (100 * F.col("highh") >= self.percent * F.col("low")))
        swap = F.col("m") > F.col("mh")
        opened = sized.select(F.when(swap, F.col("h")).otherwise(F.col("g")).alias("q"), F.when(swap, F.col("g")).otherwise(F.col("h")).alias("g"), F.greatest("m", "mh").alias("m"))
        opened = common.materialize(opened, "opened")
        touched = opened.select(F.explode(F.array("q", "g")).alias("g")).distinct()
        blocks = F.ceil(F.col("m") / BLOCK)
        targets = held.join(opened.select("g", "m").distinct(), "g").withColumn("block", F.pmod(F.xxhash64("class"), blocks)).select("g", "block", "class", "n", "prefix")
        queries = opened.join(held.withColumnRenamed("g", "q"), "q").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        queries = queries.select(F.col("g").alias("to"), F.col("block").alias("part"), F.col("class").alias("name"), F.col("n").alias("size"), F.col("prefix").alias("own"))
        may = targets.groupBy("g", "block").cogroup(queries.groupBy("to", "part")).applyInArrow(_bound(self.percent), "g long, block long, class binary, asks boolean")
        may = common.materialize(may, "may")
        common.tidy(self.signed.sparkSession)
        tokens = self._with_tokens(may.select("class").distinct())
        whole = may.join(tokens, "class")
        asked = whole.where("asks").select(F.col("g").alias("to"), F.col("block").alias("part"), F.col("class").alias("name"), F.col("tokens").alias("own"))
        return whole.where("not asks").select("g", "block", "class", "tokens").groupBy("g", "block").cogroup(asked.groupBy("to", "part")).applyInArrow(_open(self.percent), "a binary, b binary")

    def documents(self) -> DataFrame:
        """id, n, component (the least id of the component) of every row."""
        rows = self.signed.select("id", "n", "class").join(self.components, "class", "left").withColumn("root", F.coalesce("root", "class"))
        names = rows.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
        return rows.join(names, "root", "left").select("id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Join(common.table(spark, sf_dir, "documents")).documents()
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from d where len(w) > 0),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, m) as (select doc_id, doc_id from documents union select e.b, r.m from r join e on e.a = r.doc_id)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(m) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""
