"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct directions are dealt over shards of bounded size by a hash.  In each
shard a graph is built: vectors join in batches, a greedy beam search from the
entry point proposes neighbours for each, and robust pruning keeps a diverse
few: going from near to far, a candidate goes if a kept neighbour is nearer to
it, times ``relax``, than the vector itself is.  Edges are also entered
backwards, and lists that grow too long are pruned again.  Vectors that the
entry point doesn't reach in the end get an edge from a near vector that it
does.  Every shard is searched with a beam for every query, and the shards'
best are merged: a task loads its shard once and the queries stream through.

All arithmetic is in double precision on vectors that were first divided by
their largest component, so that no length overflows or vanishes.  As the beam
is wider than k and every vector is reached, a query gets k rows wherever
there are k candidates.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows with null id; vectors of another length than the
query's are no candidates; vectors of one direction (to 12 decimals) are
indexed once and tie, so of those the k + 1 smallest ids stand for all; an id
with several vectors is a candidate with each and named once, by its best, and
as a query it asks with the least of them; repeated rows count once; queries
with fewer than k candidates return them all; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Shards hold about SHARD_ROWS directions, until there are MANY_SHARDS of them; then they grow, to MOST_ROWS.
#: A query visits every shard, so their number must grow slower than the table as long as memory allows.
SHARD_ROWS, MANY_SHARDS, MOST_ROWS = 6000, 64, 250_000
#: Reached vectors take in at most so many unreached ones at a time.
ADOPTED = 8


def beam_search(points, graph, entry, queries, beam: int):
    """For each query, the ids and squared distances of a beam after greedy search, nearest first; and all ids visited.

    All queries step together: in each round every query expands its nearest
    unexpanded vector.  graph: [points, degree], -1 where there is no edge.
    """
    import numpy as np

    q = len(queries)
    ids = np.full((q, beam), -1)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = ((queries - points[entry]) ** 2).sum(1)
    seen = np.zeros((q, (len(points) + 7) // 8), np.uint8)
    seen[np.arange(q), entry >> 3] |= np.uint8(1 << (entry & 7))
    visited = []
    active = np.arange(q)
    while len(active):
        open_ = ~done[active]
        has = open_.any(1)
        active, open_ = active[has], open_[has]
        if not len(active):
            break
        at = open_.argmax(1)  # the beam is sorted, so the first is the nearest
        node = ids[active, at]
        done[active, at] = True
        visited.append((active, node, dist[active, at]))
        near = graph[node]
        rows = np.repeat(active, near.shape[1])
        flat = near.ravel()
        ok = flat >= 0
        rows, flat = rows[ok], flat[ok]
        bit = np.left_shift(np.uint8(1), (flat & 7).astype(np.uint8))
        new = (seen[rows, flat >> 3] & bit) == 0
        rows, flat, bit = rows[new], flat[new], bit[new]
        np.bitwise_or.at(seen, (rows, flat >> 3), bit)
        got = 2 - 2 * np.einsum("ij,ij->i", queries[rows], points[flat])
        wide = np.full((len(active), near.shape[1]), -1)
        far = np.full((len(active), near.shape[1]), np.inf)
        place = np.zeros(q, np.int64)
        place[active] = np.arange(len(active))
        own = place[rows]
        nth = np.arange(len(rows)) - np.searchsorted(own, own, "left")
        wide[own, nth], far[own, nth] = flat, got
        all_d = np.concatenate([dist[active], far], 1)
        best = np.argpartition(all_d, beam - 1, 1)[:, :beam] if all_d.shape[1] > beam else np.tile(np.arange(all_d.shape[1]), (len(active), 1))
        best = np.take_along_axis(best, np.take_along_axis(all_d, best, 1).argsort(1, kind="stable"), 1)
        dist[active] = np.take_along_axis(all_d, best, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], wide], 1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], wide < 0], 1), best, 1)
    return ids, dist, visited


def robust_prune(points, near, degree: int, relax: float):
    """near: [vectors, candidates] ids sorted by distance, -1 for none; first column is the vector itself.

    Returns [vectors, degree] kept neighbours.
    """
    import numpy as np

    own, cand = near[:, 0], near[:, 1:]
    n, m = cand.shape
    vec = points[np.maximum(cand, 0)]
    base = 2 - 2 * np.einsum("nd,nmd->nm", points[own], vec)
    alive = (cand >= 0) & (cand != own[:, None])
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        pick = alive.argmax(1)
        out[has, k] = cand[rows, pick][has]
        between = 2 - 2 * np.einsum("nd,nmd->nm", vec[rows, pick], vec)
        alive &= ~((relax * between <= base) & has[:, None])
        alive[rows, pick] = False
    return out


def build_graph(points, degree: int = 24, beam: int = 48, relax: float = 1.2, batch: int = 512):
    """(graph, entry point) over unit vectors."""
    import numpy as np

    n = len(points)
    graph = np.full((n, degree), -1)
    entry = int((points @ points.mean(0)).argmax())
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        part = order[at : at + min(size, batch)]
        ids, dist, visited = beam_search(points, graph, entry, points[part], beam)
        more = np.full((len(part), beam + 64), -1)
        far = np.full((len(part), beam + 64), np.inf)
        more[:, :beam], far[:, :beam] = ids, dist
        filled = np.full(len(part), beam)
        for rows, node, d in visited[-64:]:  # the walk's earlier, farther stops give long edges
            more[rows, filled[rows]], far[rows, filled[rows]] = node, d
            filled[rows] += 1
        # the beam of the batch itself, so that vectors that join together can be neighbours
        inner = 2 - 2 * points[part] @ points[part].T
        np.fill_diagonal(inner, np.inf)
        k = min(degree, len(part))
        close = np.argpartition(inner, k - 1, 1)[:, :k]
        more = np.concatenate([more, part[close]], 1)
        far = np.concatenate([far, np.take_along_axis(inner, close, 1)], 1)
        far[(more < 0) | ~np.isfinite(far)] = np.inf
        more[~np.isfinite(far)] = -1
        graph[part] = robust_prune(points, _sorted_unique(part, more, far), degree, relax)
        # edges backwards
        src, dst = np.repeat(part, degree), graph[part].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = dst.argsort(kind="stable")
        src, dst = src[by], dst[by]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        back = np.full((len(heads), width), -1)
        nth = np.arange(len(dst)) - np.repeat(first, count)
        back[np.repeat(np.arange(len(heads)), count), nth] = src
        both = np.concatenate([graph[heads], back], 1)
        for s in range(0, len(heads), 2048):
            h, b = heads[s : s + 2048], both[s : s + 2048]
            d = 2 - 2 * np.einsum("nd,nmd->nm", points[h], points[np.maximum(b, 0)])
            d[b < 0] = np.inf
            graph[h] = robust_prune(points, _sorted_unique(h, b, d), degree, relax)
        at += len(part)
        size *= 2
    return reach_all(points, graph, entry), entry


def reach_all(points, graph, entry: int):
    """graph with further edges (and columns for them), so that every vector is reached from the entry point."""
    import numpy as np

    n, extra = len(points), []
    reached = np.zeros(n, bool)

    def walk(starts):
        while len(starts):
            reached[starts] = True
            ahead = np.unique(graph[starts])
            starts = ahead[(ahead >= 0) & ~reached[ahead]] if len(ahead) else ahead

    walk(np.array([entry]))
    while not reached.all():
        apart, held = np.flatnonzero(~reached), np.flatnonzero(reached)
        near = np.concatenate([held[(points[apart[at : at + 256]] @ points[held].T).argmax(1)] for at in range(0, len(apart), 256)])
        by = near.argsort(kind="stable")
        apart, near = apart[by], near[by]
        nth = np.arange(len(near)) - np.searchsorted(near, near, "left")
        some = nth < ADOPTED  # the others may be near one of these
        more = np.full((n, int(nth[some].max()) + 1), -1)
        more[near[some], nth[some]] = apart[some]
        extra.append(more)
        walk(apart[some])
    return np.concatenate([graph, *extra], 1) if extra else graph


def _sorted_unique(own, ids, dist):
    """[n, 1 + m]: own, then ids by distance, each once; repeats become -1 at the end."""
    import numpy as np

    by = ids.argsort(1, kind="stable")
    s = np.take_along_axis(ids, by, 1)
    again = np.zeros_like(s, bool)
    again[:, 1:] = s[:, 1:] == s[:, :-1]
    d = np.where(again | (s < 0), np.inf, np.take_along_axis(dist, by, 1))
    by = d.argsort(1, kind="stable")
    s = np.where(np.isfinite(np.take_along_axis(d, by, 1)), np.take_along_axis(s, by, 1), -1)
    return np.concatenate([np.asarray(own)[:, None], s], 1)


def _matrix(column):
    """Vectors of one length as the rows of an array, each divided by its largest component, and their norms then."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x, np.sqrt((x * x).sum(1))


def _build(degree: int, beam: int, relax: float):
    def run(key, table):
        common.claim_worker("neighbours")
        import numpy as np
        import pyarrow as pa

        x, norm = _matrix(table.column("vector"))
        graph, entry = build_graph(x / norm[:, None], degree, beam, relax)
        return pa.table(
            {
                "shard": table.column("shard"),
                "dims": table.column("dims"),
                "nth": pa.array(np.arange(len(x)), pa.int32()),
                "entry": pa.array(np.arange(len(x)) == entry),
                "vector": table.column("vector"),
                "members": table.column("members"),
                "edges": pa.array([e[e >= 0].tolist() for e in graph], pa.list_(pa.int32())),
            }
        )

    return run


class Shard:
    """A shard's graph as it is searched: directions, edges, and the rows that each direction stands for."""

    def __init__(self, table):
        import numpy as np
        import pyarrow as pa

        table = table.take(pa.array(np.argsort(table.column("nth").to_numpy())))
        x, norm = _matrix(table.column("vector"))
        self.points = x / norm[:, None]
        edges = table.column("edges").to_pylist()
        self.graph = np.full((len(x), max(1, max(map(len, edges)))), -1)
        for i, e in enumerate(edges):
            self.graph[i, : len(e)] = e
        self.entry = int(table.column("entry").to_numpy(zero_copy_only=False).argmax())
        members = table.column("members").combine_chunks()
        self.first = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))])
        rows = members.flatten()
        self.ids = rows.field("id").to_numpy(zero_copy_only=False)
        self.rows, self.norms = _matrix(rows.field("vector"))

    def nearest(self, queries, k: int, beam: int):
        """For each query (scaled vector, norm): (ids, cosines) of the k + 1 best rows found."""
        import numpy as np

        x, norm = queries
        found, _, _ = beam_search(self.points, self.graph, self.entry, x / norm[:, None], beam)
        for i, near in enumerate(found):
            near = near[near >= 0]
            of = np.concatenate([np.arange(self.first[j], self.first[j + 1]) for j in near])
            score = (self.rows[of] @ x[i]) / (norm[i] * self.norms[of])
            best = np.lexsort((self.ids[of], -score))[: k + 1]  # the query's own row may be among them
            yield self.ids[of[best]], score[best]


def _search(k: int, beam: int):
    """Rows of a shard's graph, then the queries sent to it -> query_id, vec_id, score of the best of each query."""

    def run(batches):
        common.claim_worker("neighbours")
        import numpy as np
        import pyarrow as pa

        key, held, shard = None, [], None
        for batch in batches:
            own = list(zip(batch.column("shard").to_pylist(), batch.column("dims").to_pylist(), batch.column("asks").to_pylist()))
            starts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(own)]):
                part = batch.slice(a, b - a)
                if own[a][:2] != key:
                    key, held, shard = own[a][:2], [], None
                if not own[a][2]:
                    held.append(part)
                    continue
                if shard is None:
                    shard, held = Shard(pa.Table.from_batches(held)), []
                for at in range(0, len(part), 256):
                    some = part.slice(at, 256)
                    names = some.column("query").to_pylist()
                    found = list(shard.nearest(_matrix(some.column("vector")), k, beam))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(names, [len(f[0]) for f in found]), pa.int64()), pa.array(np.concatenate([f[0] for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.float64())],
                        ["query_id", "vec_id", "score"],
                    )

    return run


def direction(vector: Column) -> Column:
    """A name that vectors of equal direction, to 12 decimals, share."""
    scaled = common.let(F.array_max(F.transform(vector, F.abs)), lambda m: F.transform(vector, lambda x: x / m))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    whole = common.let(scaled, lambda v: common.let(norm(v), lambda n: F.transform(v, lambda x: F.rint(x / n * 1e12).cast("long"))))
    return F.md5(F.array_join(whole.cast("array<string>"), ","))


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"))
    finite = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    return rows.where("id is not null and vector is not null").where(finite & F.exists("vector", lambda v: v != 0))


class Index:
    """Graphs of all shards, as a table: shard, dims, nth, entry, vector, members (id, vector), edges."""

    def __init__(self, vectors: DataFrame, k: int = 5, id_col="vec_id", vector_col="embedding", degree: int = 24, beam: int = 48, relax: float = 1.2, shard_rows: int = SHARD_ROWS, many_shards: int = MANY_SHARDS, most_rows: int = MOST_ROWS):
        self.k = k
        self.rows = rows = common.materialize(clean(vectors, id_col, vector_col).withColumn("digest", direction(F.col("vector"))), "vectors")
        # the k + 1 least ids of one direction, ranked within each task first
        least = Window.partitionBy("digest").orderBy("id")
        some = rows.groupBy("digest", "id").agg(F.min("vector").alias("vector")).withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
        distinct = some.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("members"))
        distinct = common.materialize(distinct.withColumn("vector", F.col("members")[0]["vector"]).withColumn("dims", F.size("vector")), "distinct")
        n = distinct.count()
        self.n_shards = max(1, min(-(-n // shard_rows), many_shards), -(-n // most_rows))
        dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.n_shards)).cast("int")).select("shard", "dims", "vector", "members")
        made = "shard int, dims int, nth int, entry boolean, vector array<double>, members array<struct<id:long,vector:array<double>>>, edges array<int>"
        self.graph = common.materialize(dealt.groupBy("shard", "dims").applyInArrow(_build(degree, beam, relax), made), "graph")
        common.drop(distinct)

    def search(self, queries: DataFrame, beam: int = 96) -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest of each query (id, vector)."""
        shards = self.graph.select("shard", "dims").distinct()
        sent = queries.select("id", "vector", F.size("vector").alias("to_dims")).join(shards, F.col("to_dims") == F.col("dims"))
        sent = sent.select("shard", "dims", F.lit(True).alias("asks"), F.col("id").alias("query"), "vector")
        held = self.graph.withColumn("asks", F.lit(False))
        width = max(self.n_shards, int(self.graph.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = held.unionByName(sent, allowMissingColumns=True).repartition(width, "shard", "dims").sortWithinPartitions("shard", "dims", "asks")
        found = rows.mapInArrow(_search(self.k, max(beam, self.k + 1)), "query_id long, vec_id long, score double")
        # an id that has several vectors counts with its best
        each = found.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all."""
    index = Index(common.table(spark, sf_dir, "embeddings"))
    queries = index.rows.where(F.col("id") % 50 == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    return index.search(queries)
