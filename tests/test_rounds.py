"""The clock on ties, pages of inventories, and what rounds of rules write."""

import duckdb

import __spark_entry__ as entry
from claimloom.operators import inventory, ontology, temporal
from claimloom.sources import star

SF = "/root/testdata/sf0.001"


def test_clock_counts_rows_that_tie_together(spark):
    """As SQL's max(...) over (order by ...): the frame ends with the last row that ties; rows without a key come last."""
    rows = spark.createDataFrame([(1, 1, 5), (1, 1, 9), (1, 2, 0), (2, None, 9), (2, 1, 3)], "u int, k int, wall long")
    got = sorted(((r["u"], r["k"] or 0, r["allocated"]) for r in temporal.monotonic(rows, ["k"], "wall", ["u"]).collect()))
    assert got == [(1, 1, 8), (1, 1, 9), (1, 2, 10), (2, 0, 9), (2, 1, 3)]


def test_clock_reads_times_as_its_sql(spark, tmp_path):
    """Fractions of a millisecond beside a step of the wall, before and after 1970: rounded to the nearest, then cut towards zero."""
    at = [s * 100_000_000 + us for s in (-3, -1, 0, 1, 17061961) for us in (-1500, -501, -500, -499, -1, 0, 1, 499, 500, 501, 1500)]
    db = duckdb.connect()
    db.execute("create table events as select i as user_id, i % 2 as event_id, make_timestamp(t) as ts from (select unnest(?) as t, unnest(range(?)) as i)", [at, len(at)])
    db.execute("insert into events values (900, 1, null), (null, null, timestamp '2024-01-25 15:21:39.999696')")
    db.execute(f"copy events to '{tmp_path}/events.parquet'")
    got = entry.queries()["clock_monotonic"](spark, str(tmp_path)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(db.execute(entry.oracle_sql()["clock_monotonic"]).fetchall(), key=key)


def test_page_gathers_its_subjects_alone(spark):
    held = star.claims(spark, SF)
    got, want = inventory.entities_page(held, 5, 7), inventory.page(inventory.entities(held), ["subject_id"], 5, 7)
    assert list(map(tuple, got.collect())) == list(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_set") < plan.index("LeftSemi")


def test_rounds_write_new_facts_alone(spark, monkeypatch):
    sizes, write = [], ontology.storage.materialize

    def counted(df, name):
        held = write(df, name)
        sizes.append((name, held.count()))
        return held

    monkeypatch.setattr(ontology.storage, "materialize", counted)
    facts = [(f"x{i}", "p", f"y{i}", False) for i in range(100)] + [("p", "rdfs:subPropertyOf", "q", False), ("q", "rdfs:subPropertyOf", "r", False)]
    got = ontology.materialise(spark.createDataFrame(facts, "s string, p string, o string, lit boolean"), ["subproperty"])
    assert got.count() == 302 == got.distinct().count()
    assert [n for name, n in sizes if name == "facts"] == [102] and sorted(n for name, n in sizes if name == "added") == [0, 100, 100]
