"""Bundle checks over long chains, and what their rounds and joins carry."""

import random

import pytest

from claimloom.operators import bundles, ontology

TYPED = "bundle string, local_id string, subject string, predicate string, object_kind string, object string, datatype string"


def _random_claims():
    """Claims of 40 bundles and of none: links, literals, types, missing ends; and the bundles of several components."""
    draw, rows, root = random.Random(3), [], {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for b in [None, *(f"b{i}" for i in range(40))]:
        for i in range(draw.randrange(1, 60)):
            n = draw.choice((3, 12, 30))
            s, o = (None if draw.random() < 0.03 else f"e{draw.randrange(n)}" for _ in range(2))
            kind, p = draw.choice(("iri",) * 12 + ("literal", None)), draw.choice(("p",) * 12 + (ontology.TYPE, None))
            rows.append((b, f"c{i}", s, p, kind, o, None))
            link = kind == "iri" and p not in (None, ontology.TYPE)
            ends = [(b, e) for e in ((s, o) if link else (s,)) if e is not None]
            for e in ends:
                root[find(e)] = find(ends[0])
    heads = [b for b, _ in {find(x) for x in list(root)}]
    return rows, {b for b in heads if heads.count(b) > 1}


@pytest.mark.parametrize("whole, share, chunk", [(1 << 28, 1 << 24, 1 << 25), (1 << 28, 1 << 11, 1 << 9), (1 << 10, 1 << 11, 1 << 9), (0, 4, 1 << 9)])
def test_disconnected_in_tasks_and_by_rounds(spark, monkeypatch, whole, share, chunk):
    """Bundles dealt together, alone and by rounds, in few and in many chunks, against brute force."""
    for name, value in (("WHOLE", whole), ("SHARE", share), ("CHUNK", chunk)):
        monkeypatch.setattr(bundles, name, value)
    rows, want = _random_claims()
    got = [r["bundle"] for r in bundles.disconnected(spark.createDataFrame(rows, TYPED)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 5 < len(want) < 40 and None in want


def test_disconnected_writes_bundles_alone(spark, monkeypatch):
    """Bundles that a task can hold: a row of each is written, and no table of their entities or links."""
    sizes, write = {}, bundles.storage.materialize

    def counted(df, name):
        held = write(df, name)
        sizes[name] = max(sizes.get(name, 0), held.count())
        return held

    monkeypatch.setattr(bundles.storage, "materialize", counted)
    rows = [(f"b{i % 3}", f"c{i}", "hub", "p", "iri", f"e{i}", None) for i in range(900)]
    assert [r["bundle"] for r in bundles.disconnected(spark.createDataFrame(rows, TYPED)).collect()] == []
    assert max(sizes.values()) == 3


def test_rounds_shrink(spark, monkeypatch):
    """A bundle that goes by rounds: what they write shrinks, and tables that were read go."""
    held, write = [], bundles.storage.materialize
    dropped, drop = [], bundles.storage.drop

    def counted(df, name):
        out = write(df, name)
        held.append((name, out.count()))
        return out

    monkeypatch.setattr(bundles, "WHOLE", 0)
    monkeypatch.setattr(bundles, "SHARE", 4)
    monkeypatch.setattr(bundles.storage, "materialize", counted)
    monkeypatch.setattr(bundles.storage, "drop", lambda *tables: (dropped.extend(tables), drop(*tables)))
    rows = [("a", f"c{i}", f"e{i}", "p", "iri", f"e{i + 1}", None) for i in range(2000)]
    assert not bundles.disconnected(spark.createDataFrame(rows, TYPED)).collect()
    links = [n for name, n in held if name == "links"]
    assert links[0] < 1500 and all(b < a for a, b in zip(links, links[1:])) and links[-1] == 0
    assert len(dropped) == 2 * len(links) - 1


def test_least_neighbours_settle_chains_fast():
    """A chain of 100,000 in a shuffled order is one component, and a second one stays apart."""
    import numpy as np

    names = np.random.default_rng(5).permutation(200_000)
    a, b = (np.concatenate([names[k : 99_999 + k], names[100_000 + k : 199_999 + k]]) for k in (0, 1))
    roots = bundles._least(200_000, a, b)
    assert len(set(roots[names[:100_000]].tolist())) == len(set(roots[names[100_000:]].tolist())) == 1
    assert (roots == np.arange(200_000)).sum() == 2


def test_disconnected_counts_ends_of_links(spark):
    """A long chain, two of them, a loop, a hub, a claim without object, types that connect nothing."""
    chain = lambda b, k, n: [(b, f"c{k}-{i}", f"e{k}-{(i * 7919) % n}", "p", "iri", f"e{k}-{((i + 1) * 7919) % n}", None) for i in range(n - 1)]
    rows = chain(1, 0, 997) + chain(2, 0, 300) + chain(2, 1, 300) + [(3, "a", "x", "p", "iri", "x", None)] + [(4, f"h{i}", f"x{i}", "p", "iri", "hub", None) for i in range(200)]
    rows += [(5, "a", "x", "p", "iri", "y", None), (5, "b", "z", "p", "iri", None, None), (6, "a", "x", "p", "iri", "y", None), (6, "b", "y", ontology.TYPE, "iri", "K", None)]
    held = spark.createDataFrame(rows, "bundle long, local_id string, subject string, predicate string, object_kind string, object string, datatype string")
    assert sorted(r["bundle"] for r in bundles.disconnected(held).collect()) == [2, 5]


def test_disconnected_does_not_carry_all_links_through_all_rounds(spark, monkeypatch):
    """What the rounds write shrinks: a bundle of 2,000 links leaves fewer than 1,500 after one round."""
    sizes, write = [], bundles.storage.materialize

    def counted(df, name):
        held = write(df, name)
        if name == "links":
            sizes.append(held.count())
        return held

    monkeypatch.setattr(bundles.storage, "materialize", counted)
    rows = [(1, f"c{i}", f"e{i}", "p", "iri", f"e{i + 1}", None) for i in range(2000)]
    held = spark.createDataFrame(rows, "bundle long, local_id string, subject string, predicate string, object_kind string, object string, datatype string")
    assert not bundles.disconnected(held).collect()
    assert sizes[0] < 1500 and all(b < a for a, b in zip(sizes, sizes[1:])) and sizes[-1] == 0


def test_violations_move_claims_once(spark):
    """No claim is grouped by claim and class: subjects that all fit leave one join, that of the objects."""
    from claimloom import queries_bundles

    plan = queries_bundles.violations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bool_or" not in plan and plan.count("Window") == 2
