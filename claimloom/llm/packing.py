"""Best-fit packing by linear grouping.

Documents become token sequences; those longer than a sequence are cut into
pieces of its length.  Pieces over ``large_share`` of a sequence are large.

1. Large lengths are sorted and split into groups of equal cardinality; each
   length is rounded up to the longest of its group, leaving a few sizes.
2. Configurations (multisets of sizes that fit a sequence) are optimised by
   column generation; the optimum is rounded down and the remainder packed
   first-fit.
3. The actual pieces of each group take the places of its rounded size.
4. Small pieces go best-fit, longest first, into what the substitution left
   free, then into new sequences.

Both optimisations work on counts by length (at most one number per token of
a sequence), so the driver's work doesn't grow with the corpus; pieces get
their places from arithmetic on their rank among pieces of equal length.

Edge cases: null texts are empty, and an empty document is its separator
alone; repeated rows are packed once each; an empty table gives no rows; texts
of any length are tokenised whole; other columns are ignored.
"""

from __future__ import annotations

import logging
import re
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import LONG, load_tokenizer

#: Chunks that a Python worker keeps in each of two generations, none longer than LONG characters.
_KEPT = 400_000


class ChunkEncoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    For lower-casing word tokenizers that drop white space and mark word ends:
    the ids of a text are those of its chunks between ASCII white space, and a
    chunk is encoded once while it is among the kept ones.  Chunks of Latin
    letters, digits and ASCII marks are put together from the pieces that the
    pre-tokenizer splits them into; words are encoded many at a time, joined by
    spaces, and told apart by their word-end tokens.
    """

    def __init__(self, path: str):
        import numpy as np

        self.tok = load_tokenizer(path)
        self.held = common.worker_cache("ids " + path)
        if "ends" not in self.held:
            vocabulary = self.tok.get_vocab()
            ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            self.held |= {"ends": ends, "new": {}, "old": {}, "lean": self._lean(path)}
        # Latin letters, single digits, other ASCII but the apostrophe: the pre-tokenizer's own pieces
        self.parts = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+").findall

    @staticmethod
    def _lean(path: str):
        """The same model for plain words alone, which normalisation leaves as they are and which spaces part."""
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(path)
        tok.normalizer = None
        tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if hasattr(tok.model, "_resize_cache"):
            tok.model._resize_cache(0)  # words come once
        return tok

    def one(self, chunk: str) -> bytes:
        import numpy as np

        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, words: list[str], into: dict[str, bytes]) -> None:
        """Encode words made of letters only."""
        import numpy as np

        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(self.held["lean"].encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.held["ends"][ids]) + 1)
            if len(ends) != len(part):
                into.update((w, self.one(w)) for w in part)
                continue
            buffer, start = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist()):
                into[w] = buffer[start:end]
                start = end

    def learn(self, chunks: list[str]) -> None:
        new, old = self.held["new"], self.held["old"]
        made, words = [], set()
        for c in chunks:
            ids = old.get(c)
            if ids is not None:
                new[c] = ids
                continue
            low = c.lower()
            if c.isascii() and c[:-1].isalpha() and (c[-1].isalpha() or c[-1] in ".,"):  # most are a word, or one with a mark
                parts = [low] if c[-1].isalpha() else [low[:-1], c[-1]]
            elif "<|" in c or sum(map(len, parts := self.parts(low))) != len(low) or len(low) != len(c):
                new[c] = self.one(c)
                continue
            if len(parts) > 1 or low != c:
                made.append((c, parts))
            words.update(parts)
        # (set operations with a dict would run over all of it)
        words = [w for w in words if w not in new]
        new.update((w, old[w]) for w in words if w in old)
        words = [w for w in words if w not in new]
        self.plain([w for w in words if w[0].isalpha()], new)
        new.update((w, self.one(w)) for w in words if not w[0].isalpha())
        for c, parts in made:
            new[c] = new[parts[0]] if len(parts) == 1 else b"".join(map(new.__getitem__, parts))

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = self.held["new"]
        new[""] = b""
        chunks = list(set().union(*split).difference(new))
        self.learn(chunks)
        out = [b"".join(map(new.__getitem__, s)) for s in split]
        if max(map(len, chunks), default=0) > LONG:
            for c in (c for c in chunks if len(c) > LONG):
                for key in (c, c.lower(), c.lower()[:-1]):  # the chunk, and the word that it was made of
                    new.pop(key, None)
        if len(new) > _KEPT:
            self.held |= {"new": {}, "old": new}
        return out


PIECES = "piece int, start long, length int, ids_crc32 long"


def _cut(path: str, separator: int, capacity: int):
    end = separator.to_bytes(4, "little")

    def run(batches):
        common.claim_worker("packing")
        import pyarrow as pa

        encoder = ChunkEncoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(encoder.ids(part.column("text").to_pylist())):
                    ids += end
                    for j, b in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[b : b + 4 * capacity]
                        row.append(k)
                        piece.append(j)
                        start.append(b // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


# ---------------------------------------------------------------- plans on counts by length


def linear_groups(lengths: dict[int, int], n_groups: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Groups of nearly equal cardinality, longest first: (rounded size, [(length, first rank, last rank + 1)]).

    Ranks number the pieces of one length from 0.
    """
    total = sum(lengths.values())
    bounds = [total * g // n_groups for g in range(1, n_groups + 1)]
    out, members, seen, g = [], [], 0, 0
    for size in sorted(lengths, reverse=True):
        rank = 0
        while rank < lengths[size]:
            take = min(lengths[size] - rank, bounds[g] - seen)
            if take:
                members.append((size, rank, rank + take))
                rank += take
                seen += take
            if seen == bounds[g]:
                if members:
                    out.append((members[0][0], members))
                members = []
                g += 1
    return out


def best_pattern(sizes: list[int], values, capacity: int):
    """(value, counts) of the multiset of sizes within capacity of the highest value.

    One layer for each further item: the best with it, for every capacity at once.
    """
    import numpy as np

    best, layers = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for k, (s, v) in enumerate(zip(sizes, values)):
            got = best[: capacity + 1 - s] + v
            better = got > more[s:] + 1e-12
            more[s:][better], pick[s:][better] = got[better], k
        if (pick < 0).all():
            break
        layers.append(pick)
        best = more
    counts, c = [0] * len(sizes), capacity
    for pick in reversed(layers):
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 500) -> list[tuple[list[int], int]]:
    """Patterns and how often to use each, covering the demand exactly.

    A linear programme over patterns by column generation (revised simplex,
    one basic pattern per size), rounded down; if the rounds run out, the gap is logged; what is left, less than one
    sequence per size, is packed first-fit on the sizes.
    """
    import numpy as np

    n = len(sizes)
    if not n:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        value, counts = best_pattern(sizes, price, capacity)
        if value <= 1 + 1e-6:
            break
        gap = value - 1  # the programme's optimum is at most this share lower
        x, d = inverse @ need, inverse @ np.array(counts, float)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = counts
    else:
        logging.getLogger(__name__).warning("packing: %d rounds end within %.2g of the best configurations", rounds, gap)
    x = np.linalg.inv(basis) @ need
    left, out = list(demand), []
    for k in range(n):
        pattern = basis[:, k].astype(int).tolist()
        times = max(0, int(np.floor(x[k] + 1e-7)))
        times = min([times] + [left[i] // p for i, p in enumerate(pattern) if p])
        if times:
            out.append((pattern, times))
            left = [a - times * p for a, p in zip(left, pattern)]
    open_: list[list] = []  # [free, pattern]
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        for _ in range(left[i]):
            at = next((o for o in open_ if o[0] >= sizes[i]), None)
            if at is None:
                open_.append(at := [capacity, [0] * n])
            at[0] -= sizes[i]
            at[1][i] += 1
    return out + [(p, 1) for _, p in open_]


def best_fit(free: dict[int, int], small: dict[int, int], capacity: int):
    """Small pieces into sequences, longest first, each into the fullest that has room.

    free: number of sequences by room left.  Sequences of one original room are
    numbered from 0; new ones have room ``capacity`` and follow.  Returns
    (placements, number of new sequences); a placement is (length, first rank,
    last rank + 1, original room, first sequence, pieces per sequence).
    """
    classes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room now -> [(original room, from, to)]
    for room, n in free.items():
        if n:
            classes[room].append((room, 0, n))
    opened, out = 0, []
    fresh_from = free.get(capacity, 0)
    for size in sorted(small, reverse=True):
        rank, n = 0, small[size]
        for room in sorted(r for r in classes if r >= size):
            if rank == n:
                break
            each = room // size
            moved = classes.pop(room)
            while moved and rank < n:
                origin, a, b = moved.pop()
                full = min(b - a, (n - rank) // each)
                if full:
                    out.append((size, rank, rank + full * each, origin, a, each))
                    rank += full * each
                    classes[room - each * size].append((origin, a, a + full))
                    a += full
                if a < b and rank < n:
                    rest = n - rank  # fewer than one sequence takes
                    out.append((size, rank, n, origin, a, rest))
                    rank = n
                    classes[room - rest * size].append((origin, a, a + 1))
                    a += 1
                if a < b:
                    moved.append((origin, a, b))
            if moved:
                classes[room].extend(moved)
        if rank < n:
            each = capacity // size
            full, rest = divmod(n - rank, each)
            at = fresh_from + opened
            if full:
                out.append((size, rank, rank + full * each, capacity, at, each))
                classes[capacity - each * size].append((capacity, at, at + full))
            if rest:
                out.append((size, n - rest, n, capacity, at + full, rest))
                classes[capacity - rest * size].append((capacity, at + full, at + full + 1))
            opened += full + bool(rest)
    return out, opened


# ---------------------------------------------------------------- distributed part


def _counts(df: DataFrame, column: str) -> dict[int, int]:
    """Rows by value of a column that takes at most one value per token of a sequence."""
    return {r[0]: r[1] for r in df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}


def _place_large(plan):
    """length, rank -> sequence, slot: plan maps length -> sorted [(first rank, first place, group)]; places: per group [(first, per sequence, first sequence, first slot)]."""
    ranges, places = plan

    def run(batches):
        common.claim_worker("packing")
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(length), np.int64), np.zeros(len(length), np.int32)
            for size in np.unique(length):
                of = np.flatnonzero(length == size)
                first, place, group = ranges[int(size)]
                k = np.searchsorted(first, rank[of], "right") - 1
                at, grp = place[k] + rank[of] - first[k], group[k]
                for g in np.unique(grp):
                    sub = np.flatnonzero(grp == g)
                    start, per, seq, slot0 = places[int(g)]
                    j = np.searchsorted(start, at[sub], "right") - 1
                    off = at[sub] - start[j]
                    sequence[of[sub]] = seq[j] + off // per[j]
                    slot[of[sub]] = slot0[j] + off % per[j]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(slot)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "slot"])

    return run


def _place_small(placed):
    """length, rank -> original room and sequence number among those of that room; the plan is {length: arrays}."""

    def run(batches):
        common.claim_worker("packing")
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            room, nth, slot = np.zeros(len(length), np.int32), np.zeros(len(length), np.int64), np.zeros(len(length), np.int32)
            for size in np.unique(length):
                of = np.flatnonzero(length == size)
                first, origin, seq, each = placed[int(size)]
                k = np.searchsorted(first, rank[of], "right") - 1
                off = rank[of] - first[k]
                room[of], nth[of], slot[of] = origin[k], seq[k] + off // each[k], 1_000_000 - int(size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(room), pa.array(nth), pa.array(slot)], ["id", "piece", "start", "length", "ids_crc32", "room", "nth", "slot"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    separator: int = 1,
    large_share: float = 1 / 16,
    n_groups: int = 48,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = common.materialize(rows.mapInArrow(_cut(tokenizer_path, separator, capacity), f"id {kind}, {PIECES}"), "pieces")
    lengths = _counts(pieces, "length")
    n_buckets = common.buckets_for(sum(lengths.values()))
    # equal (id, piece, start, crc) rows are repeats of one another, so any order among them is as good
    ranked = common.materialize(common.global_index(pieces, ["length"], ["id", "piece", "ids_crc32"], n_buckets, "rank"), "ranked")

    limit = max(1, int(capacity * large_share))
    groups = linear_groups({k: n for k, n in lengths.items() if k > limit}, n_groups)
    patterns = configurations([g[0] for g in groups], [sum(b - a for _, a, b in g[1]) for g in groups], capacity)
    ranges: dict = defaultdict(list)
    for g, (_, members) in enumerate(groups):
        at = 0
        for size, a, b in members:
            ranges[size].append((a, at, g))
            at += b - a
    places: list = [[] for _ in groups]
    filled, n_sequences = [0] * len(groups), 0
    for pattern, times in patterns:
        slot = 0
        for g, per in enumerate(pattern):
            if per:
                places[g].append((filled[g], per, n_sequences, slot))
                filled[g] += per * times
                slot += per
        n_sequences += times
    columns = lambda rows: tuple(np.array(x, np.int64) for x in zip(*rows))
    plan = {k: columns(sorted(v)) for k, v in ranges.items()}, [columns(p) for p in places]
    placed_type = f"id {kind}, {PIECES}, sequence_id long, slot int"
    large = common.materialize(ranked.where(F.col("length") > limit).mapInArrow(_place_large(plan), placed_type), "large")

    filled_to = large.groupBy("sequence_id").agg(F.sum("length").alias("used")).select("sequence_id", (F.lit(capacity) - F.col("used")).cast("int").alias("room"))
    filled_to = common.materialize(common.global_index(filled_to, ["room"], ["sequence_id"], n_buckets, "nth"), "room")
    placements, _ = best_fit(_counts(filled_to, "room"), {k: n for k, n in lengths.items() if k <= limit}, capacity)
    by_size = defaultdict(list)
    for size, a, _, origin, seq, each in placements:
        by_size[size].append((a, origin, seq, each))
    placed = {k: columns(sorted(v)) for k, v in by_size.items()}
    small = ranked.where(F.col("length") <= limit).mapInArrow(_place_small(placed), f"id {kind}, {PIECES}, room int, nth long, slot int")
    # sequences opened for small pieces alone have no row in filled_to and follow the others
    small = small.join(filled_to.hint("shuffle_hash"), ["room", "nth"], "left").select(
        "id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", F.lit(n_sequences) + F.col("nth")).alias("sequence_id"), "slot"
    )
    order = Window.partitionBy("sequence_id").orderBy("slot", "id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    both = large.unionByName(small).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return both.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens of word_bpe_49k.json."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
