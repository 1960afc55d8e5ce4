"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word (a run of letters, lower-cased, the vocabulary's word mark before it) is
scored by the forward algorithm, which sums the probabilities of all its segmentations
into pieces; a text's likelihood is the product over its words.  Characters
that no piece covers are segmented into the vocabulary's byte pieces.

Training is one expectation step over labelled texts, whole, with a bound on
the rows of each language (``fit_rows``): from equal piece probabilities, forward-backward gives the expected number of uses of each
piece in each language, which are smoothed and normalised.

Edge cases: null text or text without letters gives ``und`` with score 0; so
does every text when nothing could be learned.  Rows with null language or
text teach nothing.  Equal posteriors go to the smallest language name.
Repeated rows count as often as they occur.  Texts of any length are scored
whole, and words of any length too.  An empty table gives no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words whose scores a Python worker keeps, none longer than _LONG; characters whose words a teaching task counts at a time.
_KEPT, _LONG, _COUNTED = 200_000, 256, 50_000_000
UNKNOWN = "und"


class Pieces:
    """The vocabulary: piece -> number, longest piece, numbers of byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.number: dict[str, int] = {}
        self.byte = [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.number[sp.id_to_piece(i)] = i
        self.size = sp.get_piece_size()
        self.longest = max(map(len, self.number))

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """For each end position, the (start, piece numbers) of the arcs that end there."""
        out: list[list[tuple[int, tuple[int, ...]]]] = [[]]
        number, longest = self.number, self.longest
        for end in range(1, len(word) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                n = number.get(word[start:end])
                if n is not None:
                    here.append((start, (n,)))
            if word[end - 1] not in number:  # no piece of its own: spelled in bytes
                here.append((end - 1, tuple(self.byte[b] for b in word[end - 1].encode("utf-8", "surrogatepass"))))
            out.append(here)
        return out


def load_pieces(path: str) -> Pieces:
    held = common.worker_cache("pieces")
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


#: Runs of letters.
_LETTERS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The words of a text: its runs of letters, in lower case."""
    return _LETTERS(text.lower())


def _spans(n: int, longest: int) -> list[slice]:
    """All spans of a word of n characters that a piece may cover, by end, then start."""
    return [slice(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]


class Lattice:
    """The segmentation lattices of many words at once.

    Words of one length share their spans, so forward and backward sums run
    over whole columns.  Words that are very long or need byte pieces are
    handled one by one.
    """

    #: Longer words are summed with rescaling, against underflow.
    longest_word = 30

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.spans: dict[int, list[slice]] = {}

    def by_length(self, words: list[str]):
        """(length, spans, positions in words, [words, spans] piece numbers; -1: no piece), then the words left over."""
        import numpy as np

        groups: dict[int, tuple[list[int], list[int]]] = {}
        rest, number, longest = [], self.pieces.number, self.pieces.longest
        get = number.get
        for k, w in enumerate(words):
            m = "▁" + w
            n = len(m)
            if n > self.longest_word or not all(map(number.__contains__, w)):
                rest.append(k)
                continue
            spans = self.spans.get(n)
            if spans is None:
                spans = self.spans[n] = _spans(n, longest)
            at, ids = groups.setdefault(n, ([], []))
            at.append(k)
            ids.extend(map(get, map(m.__getitem__, spans), _NONE))
        return [(n, self.spans[n], at, np.array(ids, np.int32).reshape(len(at), -1)) for n, (at, ids) in groups.items()], rest


class _Forever:
    def __iter__(self):
        from itertools import repeat

        return repeat(-1)


_NONE = _Forever()


def expected_uses(pieces: Pieces, word: str) -> dict[int, float]:
    """Expected number of uses of each piece over all segmentations of one word, pieces being equally likely."""
    arcs = pieces.arcs("▁" + word)
    n, each = len(arcs) - 1, -math.log(pieces.size)
    ahead = [0.0] + [-math.inf] * n
    for end in range(1, n + 1):
        got = [ahead[s] + each * len(p) for s, p in arcs[end]]
        top = max(got)
        ahead[end] = top + math.log(sum(math.exp(g - top) for g in got))
    back = [-math.inf] * n + [0.0]
    uses: dict[int, float] = {}
    for end in range(n, 0, -1):
        for s, p in arcs[end]:
            v = each * len(p) + back[end]
            a, b = (back[s], v) if back[s] >= v else (v, back[s])
            back[s] = a + math.log1p(math.exp(b - a)) if b > -math.inf else a
            w = math.exp(ahead[s] + v - ahead[n])
            if w > 1e-9:
                for x in p:
                    uses[x] = uses.get(x, 0.0) + w
    return uses


def summed_uses(pieces: Pieces, words: list[str], counts) -> "numpy.ndarray":  # noqa: F821
    """[pieces] expected uses summed over words, each weighted by its count."""
    import numpy as np

    total, lattice, each = np.zeros(pieces.size), Lattice(pieces), 1.0 / pieces.size
    for from_ in range(0, len(words), 50_000):
        part, weight = words[from_ : from_ + 50_000], np.asarray(counts[from_ : from_ + 50_000], float)
        groups, rest = lattice.by_length(part)
        for n, spans, at, ids in groups:
            some = (ids >= 0) * each
            ahead, back = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
            ahead[0] = back[n] = 1.0
            for k, s in enumerate(spans):
                ahead[s.stop] += ahead[s.start] * some[:, k]
            for k in range(len(spans) - 1, -1, -1):
                back[spans[k].start] += back[spans[k].stop] * some[:, k]
            whole = weight[at] / ahead[n]
            for k, s in enumerate(spans):
                used = ids[:, k] >= 0
                if used.any():
                    total += np.bincount(ids[used, k], (ahead[s.start] * back[s.stop] * whole * each)[used], pieces.size)
        for k in rest:
            for p, x in expected_uses(pieces, part[k]).items():
                total[p] += x * weight[k]
    return total


class Scorer:
    """Log probabilities of words under each language, by the forward algorithm."""

    def __init__(self, path: str, table):
        import numpy as np

        self.np, self.pieces = np, load_pieces(path)
        self.table = table  # [pieces, languages] of probabilities
        self.padded = np.concatenate([table, np.zeros((1, table.shape[1]))])  # number -1: no piece
        self.lattice = Lattice(self.pieces)
        # two generations of scored words: those of the older one move up when met again
        self.rows: dict[str, int] = {}
        self.old_rows: dict[str, int] = {}
        self.scores = self.old_scores = np.zeros((0, table.shape[1]))

    def word(self, word: str):
        np, table = self.np, self.table
        arcs = self.pieces.arcs("▁" + word)
        n = len(arcs) - 1
        # scaled forward sums, so that very long words don't underflow
        ahead = np.zeros((n + 1, table.shape[1]))
        ahead[0], scale, base = 1.0, np.zeros(table.shape[1]), 0
        for end in range(1, n + 1):
            total = 0.0
            for s, p in arcs[end]:
                total = total + ahead[s] * (table[p[0]] if len(p) == 1 else table[list(p)].prod(axis=0))
            ahead[end] = total
            if end - base >= 16:  # rescale what later arcs can still reach
                top = ahead[end].copy()
                ahead[max(0, end - self.pieces.longest) : end + 1] /= top
                scale += np.log(top)
                base = end
        return scale + np.log(ahead[n])

    def many(self, words: list[str]):
        np = self.np
        out = np.zeros((len(words), self.table.shape[1]))
        groups, rest = self.lattice.by_length(words)
        for n, spans, at, ids in groups:
            ahead = np.zeros((n + 1, len(at), self.table.shape[1]))
            ahead[0] = 1.0
            for k, s in enumerate(spans):
                some = np.flatnonzero(ids[:, k] >= 0)
                if len(some):
                    ahead[s.stop, some] += ahead[s.start, some] * self.padded[ids[some, k]]
            out[at] = np.log(ahead[n])
        for k in rest:
            out[k] = self.word(words[k])
        return out

    def texts(self, texts: list[str]):
        """[texts, languages] log likelihoods."""
        np = self.np
        split = [words_of(t) for t in texts]
        if len(self.rows) > _KEPT:
            self.old_rows, self.old_scores = self.rows, self.scores
            self.rows, self.scores = {}, self.scores[:0]
        missing = set().union(*split).difference(self.rows)
        again = list(missing.intersection(self.old_rows))
        new = list(missing.difference(again))
        found = [self.old_scores[[self.old_rows[w] for w in again]]]
        found += [self.many(new[at : at + 20_000]) for at in range(0, len(new), 20_000)]
        self.rows.update(zip(again + new, range(len(self.rows), len(self.rows) + len(missing))))
        self.scores = np.concatenate([self.scores, *found])
        get = self.rows.__getitem__
        out = np.array([self.scores[list(map(get, s))].sum(axis=0) for s in split]).reshape(len(split), -1)
        for w in new:
            if len(w) > _LONG:
                del self.rows[w]
        return out


def _teach(path: str):
    """Batches of (lang, text) -> expected uses (lang, piece, uses) of this task."""

    def run(batches):
        common.claim_worker("language")
        from collections import Counter

        import pyarrow as pa

        pieces, seen, total, held = load_pieces(path), {}, {}, 0

        def settle():
            for lang, words in seen.items():
                total[lang] = total.get(lang, 0.0) + summed_uses(pieces, list(words), list(words.values()))
            seen.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen.setdefault(lang, Counter()).update(words_of(text))
                    held += len(text)
                if held > _COUNTED or sum(map(len, seen.values())) > _KEPT:
                    settle()
                    held = 0
        settle()
        for lang, uses in total.items():
            some = uses.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(uses[some])], ["lang", "piece", "uses"])

    return run


def _predict(path: str, langs: list[str], table):
    model = uuid.uuid4().hex

    def run(batches):
        common.claim_worker("language")
        import numpy as np
        import pyarrow as pa

        held = common.worker_cache("language scorers")  # one, for all tasks of a job
        if langs and model not in held:
            held.clear()
            held[model] = Scorer(path, table.value)
        scorer = held.get(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = part.column("text").to_pylist()
                scored = [i for i, t in enumerate(texts) if langs and t is not None and any(map(str.isalpha, t))]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if scored:
                    likely = scorer.texts([texts[i] for i in scored])
                    best = likely.argmax(axis=1)
                    post = 1 / np.exp(np.maximum(likely - likely.max(axis=1, keepdims=True), -700)).sum(axis=1)
                    for i, b, p in zip(scored, best.tolist(), post.tolist()):
                        names[i], scores[i] = langs[b], p
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return run


def train(docs: DataFrame, pieces_path: str, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", fit_rows: int = 5000, smoothing: float = 0.01):
    """(languages, [pieces, languages] array of probabilities) from labelled rows.

    fit_rows bounds the rows that each language is learned from, in
    expectation: of a language with n > fit_rows rows, those are taken whose
    hashed id and text fall into the first fit_rows / n of the range.  What
    comes to the driver is a row count per language and a number per language
    and piece; the table is broadcast, 8 bytes a language and piece.
    """
    import numpy as np

    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit("fit")).alias("h")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, fit_rows / counts[lang]))])
    rows = rows.where(common.share_of(F.col("h")) < share[F.col("lang")]).select("lang", "text")
    uses = rows.mapInArrow(_teach(pieces_path), "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
    table = np.full((load_pieces(pieces_path).size, len(langs)), smoothing)
    at = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (uses.column("piece").to_numpy(), [at[x] for x in uses.column("lang").to_pylist()]), uses.column("uses").to_numpy())
    return langs, table / table.sum(axis=0)


def identify(docs: DataFrame, pieces_path: str, taught: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row; labelled rows where ``taught`` holds may be learned from."""
    langs, table = train(docs.where(taught), pieces_path, lang_col, text_col, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (~F.coalesce(taught, F.lit(False))).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    table = docs.sparkSession.sparkContext.broadcast(table)
    return rows.mapInArrow(_predict(pieces_path, langs, table), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    taught = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0
    return identify(docs, public_tokenizers.path("piece_bpe_32k.model"), taught)
