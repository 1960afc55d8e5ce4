"""Queries over whole tables: rows of all ids take part."""

import duckdb
import pytest

import __spark_entry__ as entry
from claimloom.operators import policy

SF = "/root/testdata/sf0.01"
TABLES = {"lineitem": "l_orderkey between 1950 and 2060 or l_orderkey between 2650 and 2700", "orders": "o_orderkey between 200 and 700", "events": "event_id < 3200"}
OTHERS = ("region", "nation", "customer", "supplier", "part")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    db = duckdb.connect()
    for name in (*TABLES, *OTHERS):
        db.execute(f"copy (select * from '{SF}/{name}.parquet' where {TABLES.get(name, 'true')}) to '{d}/{name}.parquet'")
        db.execute(f"create view {name} as select * from '{d}/{name}.parquet'")
    return str(d), db


@pytest.mark.parametrize("name", ["bundle_type_violations", "temporal_support", "visibility_fixpoint", "import_structured", "admission_idempotent"])
def test_all_rows(spark, tables, name):
    d, db = tables
    df = entry.queries()[name](spark, d)
    got = sorted(tuple(r) for r in df.collect())
    want = db.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(want) and got


def test_bundles_above_the_bound(spark, tables):
    d, db = tables
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for order, part, supplier in db.execute("select l_orderkey, l_partkey, l_suppkey from lineitem").fetchall():
        b = order % 700
        for end in (f"p:{part}", f"s:{supplier}"):
            root[find((b, f"o:{order}"))] = find((b, end))
    parts = {}
    for x in root:
        parts.setdefault(x[0], set()).add(find(x))
    want = {b for b, roots in parts.items() if len(roots) > 1}
    got = {r["bundle"] for r in entry.queries()["bundle_disconnected"](spark, d).collect()}
    assert got == want and want


def test_long_chains_of_support(spark):
    n, hidden = 12_000, {3, 7 * 900 + 5}
    ids = spark.range(n).where(f"id not in ({', '.join(map(str, hidden))})").selectExpr("id as claim_id")
    kept = policy.visible_fixpoint(ids, ids.where("claim_id >= 7").selectExpr("claim_id", "claim_id - 7 as support_id"))
    assert {r[0] for r in kept.collect()} == {x for x in range(n) if not any(x % 7 == h % 7 and x >= h for h in hidden)}


def test_whole_catalogue(spark, tables):
    d, db = tables
    got = {tuple(r) for r in entry.queries()["catalog_from_claims"](spark, d).select("id", "label").collect()}
    assert got == set(db.execute(f"select id, label from ({entry.oracle_sql()['catalog_from_claims']})").fetchall())
    assert {i[:2] for i, _ in got} == {"r:", "n:", "c:", "s:", "p:", "o:"}


def test_rules_reach_customers_and_suppliers(spark):
    d, db = "/root/testdata/sf0.001", duckdb.connect()
    nations = dict(db.execute(f"select n_nationkey, n_regionkey from '{d}/nation.parquet'").fetchall())
    want = {(f"n:{n}", f"r:{r}") for n, r in nations.items()}
    for prefix, sql in (("c", f"select c_custkey, c_nationkey from '{d}/customer.parquet'"), ("s", f"select s_suppkey, s_nationkey from '{d}/supplier.parquet'")):
        for k, n in db.execute(sql).fetchall():
            want |= {(f"{prefix}:{k}", f"n:{n}"), (f"{prefix}:{k}", f"r:{nations[n]}")}
    rows = entry.queries()["materialise_fixpoint"](spark, d).collect()
    assert {(r["s"], r["o"]) for r in rows if r["p"] == "within"} == want
    assert {r["s"] for r in rows if r["o"] == "class:place" and r["p"] == "rdf:type"} == {o for _, o in want}
