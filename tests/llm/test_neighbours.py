"""Nearest neighbours: complete results, ties, extreme components, repeated ids, reachability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import ann


def nearest(spark, rows, asked, **options):
    index = ann.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options)
    queries = index.rows.where(F.col("id").isin(asked)).groupBy("id").agg(F.min("vector").alias("vector"))
    return [tuple(r) for r in index.search(queries).orderBy("query_id", "rank").collect()]


def test_one_direction_in_many_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])] + [(20 - k, [2.0**k, 0.0]) for k in range(12)]
    assert nearest(spark, rows, [0]) == [(0, r, 8 + r, 1.0) for r in range(1, 6)]


def test_extreme_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200]), (3, [5e-324, 0.0])]
    found = nearest(spark, rows, [0])
    assert [f[2] for f in found] == [1, 3, 2]
    assert [f[3] for f in found] == pytest.approx([1, 0.5**0.5, 0], abs=1e-12)


def test_one_id_with_several_vectors(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (2, [1.0, 0.9])]
    found = nearest(spark, rows, [0])  # asks with [1, 0]; 2 counts with its nearer vector, and 0 isn't its own neighbour
    assert [f[:3] for f in found] == [(0, 1, 1), (0, 2, 2)] and found[1][3] == pytest.approx(1 / 1.81**0.5)


@pytest.mark.parametrize("kind", ["scaled", "tight"])
def test_no_vector_is_out_of_reach(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12))
    if kind == "scaled":
        more = x[5] * (1 + 0.37 * np.arange(200))[:, None]
    else:
        more = x[rng.integers(40, size=400)] + 1e-6 * rng.normal(size=(400, 12))
    x = np.concatenate([x, more])
    graph, entry = ann.build_graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    seen, ahead = {entry}, [entry]
    while ahead:
        near = {int(v) for u in ahead for v in graph[u] if v >= 0} - seen
        seen |= near
        ahead = list(near)
    assert len(seen) == len(x)
    found = nearest(spark, [(i, v.tolist()) for i, v in enumerate(x)], [0, 5, 1000], shard_rows=300)
    assert len(found) == 15
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, _, v, s in found:
        assert s == pytest.approx(unit[q] @ unit[v], abs=1e-12)
    worst = min(s for q, _, _, s in found if q != 0)
    assert worst > 1 - 1e-9


def test_shards_grow_with_the_table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.Index(df, shard_rows=50, many_shards=4, most_rows=100).n_shards == 4
    assert ann.Index(df, shard_rows=50, many_shards=2, most_rows=100).n_shards == 3
