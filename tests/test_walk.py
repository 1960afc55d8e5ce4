"""Walks: small graphs whose paths follow by hand, and a sequential simulation on random graphs."""

import random
from datetime import datetime
from decimal import Decimal

import pytest

from claimloom.operators import landing, walk
from claimloom.operators.predicates import PlanError
from claimloom.plans.compile import compile_query
from claimloom.plans.run import execute

DAY = datetime(2025, 3, 9)
SCHEMA = "claim_id string, subject_id string, relation string, object_kind string, object_id string, confidence decimal(9,6), grounding int, transaction_time timestamp"


def claims(spark, edges):
    """edges: (id, from, to, confidence[, time[, relation]]); a to in angle brackets is a literal."""
    rows = []
    for i, a, b, c, *more in edges:
        literal = b.startswith("<")
        time, relation = (*more, *(DAY, "knows")[len(more) :])
        rows.append((i, a, relation, "literal" if literal else "iri", b.strip("<>") if literal else b, Decimal(c), 0, time))
    return spark.createDataFrame(rows, SCHEMA)


def ask(spark, edges, start, depth=2, labels=None, hidden=(), end=None, walk_part=None, filters=(), capabilities=frozenset(), **bounds):
    """Run a query over a small graph; entities have no labels but those given."""
    shown = [e for e in edges if not {e[1], e[2]} & set(hidden)]
    names = {n for e in shown for n in e[1:3] if not n.startswith("<")}
    catalog = spark.createDataFrame([(n, (labels or {}).get(n)) for n in sorted(names)], "id string, label string")
    about = {"from": start, "match": "exact"} | ({"to": end} if end else {})
    plan = compile_query({"about": [about], "bounds": {"max_depth": depth} | bounds, "walk": walk_part or {}, "filter": {"predicates": list(filters)}}, capabilities=capabilities)
    return execute(plan, claims(spark, shown), catalog)


def found(result):
    return [" ".join(r["ids"]) for r in result.paths.orderBy("rank").collect()]


# A ferry line with a short cut: port - isle - cape - reef, port - cape, and a note at the reef.
FERRY = [
    ("pi", "port", "isle", "0.75"),
    ("ic", "isle", "cape", "0.6"),
    ("pc", "port", "cape", "0.4"),
    ("cr", "cape", "reef", "0.95"),
    ("note", "reef", "<no landing>", "1"),
]
# A ring of three, and a claim of an island about itself.
RING = [("ab", "a", "b", "0.9"), ("bc", "b", "c", "0.9"), ("ca", "c", "a", "0.9"), ("cc", "c", "c", "0.2")]


def test_paths_rank_by_length_then_product(spark):
    # one step: 0.75, 0.4; two: pi ic 0.45, pc cr 0.38; three: pi ic cr
    assert found(ask(spark, FERRY, ["port"], 3)) == ["pi", "pc", "pi ic", "pc cr", "pi ic cr", "pc cr note"]


def test_paths_that_connect(spark):
    assert found(ask(spark, FERRY, ["port"], 3, end=["reef"])) == ["pc cr", "pi ic cr"]
    assert found(ask(spark, FERRY, ["port"], 3, end=["port"])) == []


def test_against_the_claims_direction(spark):
    assert found(ask(spark, FERRY, ["cape"], 2, walk_part={"direction": "incoming"})) == ["ic", "pc", "ic pi"]
    both = found(ask(spark, FERRY, ["isle"], 2, walk_part={"direction": "both"}))
    assert both[:2] == ["pi", "ic"] and set(both[2:]) == {"pi pc", "ic cr", "ic pc"}


def test_rings(spark):
    once = ["ab", "ab bc", "ab bc ca", "ab bc cc", "ab bc cc ca"]
    assert found(ask(spark, RING, ["a"], 4)) == once
    assert found(ask(spark, RING, ["a"], 4, cycle_policy="no_repeated_node")) == ["ab", "ab bc"]
    again = found(ask(spark, RING, ["a"], 4, cycle_policy="allow_repeated_claim"))
    assert "ab bc ca ab" in again and "ab bc cc cc" in again and len(again) == 7
    # a claim of c about c is met once from c, whichever way one looks
    assert found(ask(spark, RING, ["c"], 1, walk_part={"direction": "both"})) == ["bc", "ca", "cc"]


def test_literals_end_paths(spark):
    rows = ask(spark, FERRY, ["reef"], 5).paths.collect()
    assert [(list(r["ids"]), list(r["nodes"]), r["node"]) for r in rows] == [(["note"], ["reef"], None)]


def test_caps(spark):
    star = [(f"s{k}", "hub", f"leaf{k}", f"0.{k}") for k in range(1, 8)]
    assert found(ask(spark, star, ["hub"], 1)) == ["s7", "s6", "s5", "s4"]  # four each, if nothing is said
    assert found(ask(spark, star, ["hub"], 1, fanout_limit=9)) == ["s7", "s6", "s5", "s4", "s3", "s2", "s1"]
    assert found(ask(spark, star, ["hub"], 1, fanout_limit=9, path_limit=2)) == ["s7", "s6"]
    assert found(ask(spark, star, ["hub"], 1, max_claims=3)) == ["s7", "s6", "s5"]
    assert found(ask(spark, star, ["hub"], 0)) == found(ask(spark, star, ["hub"], 1, path_limit=0)) == []
    # the cap on steps from one place counts after predicates
    assert found(ask(spark, star, ["hub"], 1, fanout_limit=1, walk_part={"predicates": [["meta:confidence", "<", Decimal("0.35")]]})) == ["s3"]
    # one claim in two blocks counts once
    two = compile_query({"about": [{"from": ["hub"], "match": "exact"}] * 2, "bounds": {"max_depth": 1, "max_claims": 1}})
    got = execute(two, claims(spark, star), spark.createDataFrame([("hub", None)], "id string, label string"))
    assert [(r["block"], list(r["ids"])) for r in got.paths.orderBy("rank").collect()] == [(0, ["s7"]), (1, ["s7"])]


def test_filters_look_at_whole_paths(spark):
    assert found(ask(spark, FERRY, ["port"], 3, filters=[["meta:claim_id", "=", "cr"]], path_limit=1)) == ["pc cr"]
    assert found(ask(spark, FERRY, ["port"], 3, filters=[["meta:claim_id", "=", "cr"], ["meta:claim_id", "=", "pi"]])) == ["pi ic cr"]


def test_times(spark):
    edges = [("old", "x", "y", "0.5", datetime(2024, 5, 1)), ("new", "x", "z", "0.5", datetime(2024, 6, 1))]
    assert found(ask(spark, edges, ["x"], 1)) == ["new", "old"]  # of equals the newer
    assert found(ask(spark, edges, ["x"], 1, as_of="2024-05-31T23:59:59.999Z")) == ["old"]
    assert found(ask(spark, edges, ["x"], 1, as_of="2024-04-30T00:00:00Z")) == []


def test_hidden_claims_cannot_influence(spark):
    assert found(ask(spark, FERRY, ["port"], 3, end=["reef"], hidden=("isle",))) == ["pc cr"]
    twins = [("u", "left", "far", "0.9"), ("v", "right", "far", "0.1")]
    name = {"left": "twin", "right": "twin"}
    assert found(ask(spark, twins, ["twin"], 1, labels=name, seed_limit=1)) == ["u"]
    assert found(ask(spark, twins, ["twin"], 1, labels=name, seed_limit=1, hidden=("left",))) == ["v"]


def test_notices(spark):
    notices = lambda **o: ask(spark, FERRY, o.pop("start", ["port"]), o.pop("depth", 3), **o).notices
    assert "max_depth" in notices(depth=1) and "max_depth" not in notices(depth=4)
    assert "fanout_limit" in notices(fanout_limit=1) and "fanout_limit" not in notices(fanout_limit=2)
    assert "max_claims" in notices(max_claims=2) and "path_limit" in notices(path_limit=3)
    assert notices(start=["nowhere"]) == ["empty_landing"]


def test_products_are_exact(spark):
    from pyspark.sql import functions as F

    close = [("p", "x", "y", "0.951"), ("q", "x", "z", "0.955"), ("r", "z", "w", "0.001"), ("s", "y", "v", "0.000999")]
    got = walk.summary(ask(spark, close, ["x"], 2).paths).orderBy("rank").collect()
    assert [(r["claim_ids"], r["numerator"]) for r in got] == [("q", "955000"), ("p", "951000"), ("q r", "955000000"), ("p s", "950049000")]
    # a chain of 25: the product has some 150 digits
    chain = [(f"k{i:02d}", f"n{i}", f"n{i + 1}", f"0.{900_001 + 37 * i}") for i in range(25)]
    start = spark.createDataFrame([(0, "n0", 1, 1)], "block int, id string, score long, seed_rank int")
    done = walk.walk(claims(spark, chain), start, walk.Options(25, fanout_limit=None, max_claims=None))
    last = walk.summary(walk.ranked(done.paths, None)).orderBy(F.col("depth").desc()).first()
    want = 1
    for i in range(25):
        want *= 900_001 + 37 * i
    assert last["depth"] == 25 and int(last["numerator"]) == want
    for bad in ("double", "decimal(12,10)"):
        with pytest.raises(PlanError):
            walk.walk(claims(spark, close).withColumn("confidence", F.col("confidence").cast(bad)), start, walk.Options(1))


def test_counters(spark):
    out = ask(spark, FERRY, ["port"], 3, walk_part={"predicates": [["meta:confidence", ">", Decimal("0.5")]]})
    assert out.explain is None
    plan = compile_query({"about": [{"from": ["port"], "match": "exact"}], "bounds": {"max_depth": 3}, "walk": {"predicates": [["meta:confidence", ">", Decimal("0.5")]]}, "return": {"explain": True}})
    got = execute(plan, claims(spark, FERRY), spark.createDataFrame([("port", None)], "id string, label string"))
    # pi and pc are examined, pi is eligible; then ic; then cr
    assert got.explain["counters"] == {"examined": 4, "eligible": 3, "traversed": 3, "unique_traversed": 3, "returned_paths": 3}


def test_ontology_predicates(spark):
    edges = [("e1", "x", "dog", "1", DAY, "bit"), ("e2", "x", "oak", "1", DAY, "felled"), ("e3", "dog", "x", "1", DAY, "fled"), ("e4", "x", "<text>", "1", DAY, "said")]
    closed = lambda *pairs: spark.createDataFrame([*pairs, *{(t, t) for p in pairs for t in p}], "term string, ancestor string")
    about = {"property": closed(("bit", "hurt"), ("felled", "hurt")), "class": closed(("dog", "animal"), ("oak", "plant"))}

    def of(field, op, target, phase="walk", ontology=about, depth=1):
        plan = compile_query({"about": [{"from": ["x"], "match": "exact"}], "bounds": {"max_depth": depth}, phase: {"predicates": [[field, op, target]]}}, capabilities=frozenset({"ontology"}))
        return sorted(found(execute(plan, claims(spark, edges), spark.createDataFrame([("x", None)], "id string, label string"), ontology=ontology)))

    assert of("meta:relation", "subproperty_of", "hurt") == ["e1", "e2"]
    assert of("meta:relation", "subproperty_of", "bit") == ["e1"]
    assert of("meta:relation", "not_subproperty_of", "hurt") == ["e4"]
    assert of("meta:object_id", "isa", "animal") == ["e1"] and of("meta:object_id", "not_isa", "animal") == ["e2", "e4"]
    assert of("meta:object_id", "isa", "unheard of") == []
    assert of("path.meta:relation", "contains_subproperty_of", "bit", depth=2) == ["e1", "e1 e3"]
    assert of("path.meta:object_id", "contains_isa", "animal", "filter", depth=2) == ["e1", "e1 e3"]
    assert of("meta:object_id", "isa", "plant", "filter", depth=2) == ["e2"]
    with pytest.raises(PlanError) as e:
        of("meta:object_id", "isa", "animal", ontology={"property": about["property"]})
    assert e.value.kind == "unsupported"


def test_evidence_of_returned_claims(spark):
    from claimloom.functions import lexical
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("d1", "héllo\nworld"), ("d2", "other")], "source_id string, text string")
    v = {r[0]: r[1] for r in docs.select("source_id", lexical.sha256(F.col("text"))).collect()}
    h = lambda t: spark.range(1).select(lexical.sha256(F.lit(t))).first()[0]
    one = lambda s, ver, a, b, w, c: (s, ver, a, b, w, c)
    lineage = {"pi": [one("d1", v["d1"], 7, 12, None, h("world"))], "pc": [one("d2", "sha256:old", None, None, True, None), one("d9", "sha256:x", 0, 1, None, None)], "note": [one("d2", v["d2"], None, None, True, h("other"))]}
    kind = "array<struct<source_id:string,version:string,start:int,end:int,whole:boolean,content_hash:string>>"
    rows = spark.createDataFrame(list(lineage.items()), f"claim_id string, lineage {kind}")
    held = claims(spark, FERRY).join(rows, "claim_id", "left")
    plan = compile_query({"about": [{"from": ["port"], "match": "exact"}], "bounds": {"max_depth": 1}, "return": {"evidence": True}})
    got = execute(plan, held, spark.createDataFrame([("port", None)], "id string, label string"), sources=docs)
    assert sorted((r["source_id"], r["outcome"], r["content"]) for r in got.evidence.collect()) == [("d1", "verified", "world"), ("d2", "unavailable", None), ("d9", "unavailable", None)]
    assert "evidence_unavailable" in got.notices


def simulate(edges, seeds, o):
    """The walk one candidate at a time."""
    unique, kept, frontier = set(), [], [(0, r + 1, s, s, (), (s,)) for r, s in enumerate(seeds)]
    for _ in range(o.max_depth):
        nxt = []
        for block, rank, seed, node, used, nodes in sorted(frontier, key=lambda p: (p[0], p[1], p[4])):
            out = []
            for i, s, d, c, t in edges:
                if o.direction != "incoming" and s == node:
                    out.append((i, d, c, t))
                elif o.direction != "outgoing" and d == node:
                    out.append((i, s, c, t))
            if o.direction == "incoming":
                out = [(i, s, c, t) for i, s, d, c, t in edges if d == node]
            out.sort(key=lambda x: (-Decimal(x[2]), -x[3].timestamp(), x[0]))
            took = 0
            for i, to, _, _ in out:
                if o.cycle == "no_repeated_claim" and i in used or o.cycle == "no_repeated_node" and to in nodes:
                    continue
                if took == o.fanout_limit:
                    break
                took += 1
                if i not in unique:
                    if len(unique) == o.max_claims:
                        continue
                    unique.add(i)
                path = (block, rank, seed, to, used + (i,), nodes + (to,))
                kept.append(path)
                nxt.append(path)
        frontier = nxt
    return sorted((p[2], p[4]) for p in kept)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(6)]
    edges = [(f"e{i:02d}", rng.choice(names), rng.choice(names), rng.choice(["0.5", "0.7", "1"]), datetime(2026, 1, rng.randint(1, 3))) for i in range(16)]
    o = walk.Options(3, rng.choice(["outgoing", "incoming", "both"]), rng.choice([1, 2, 3]), rng.choice([3, 6, 12]), None, rng.choice(walk.CYCLES))
    seeds = names[:2]
    start = spark.createDataFrame([(0, s, 1, r + 1) for r, s in enumerate(seeds)], "block int, id string, score long, seed_rank int")
    got = walk.walk(claims(spark, edges), start, o).paths
    assert sorted((r["seed"], tuple(r["ids"])) for r in got.select("seed", "ids").collect()) == simulate(edges, seeds, o)


def test_program_with_state(spark):
    """A program keeps the sum of confidences along a path under a bound: 0.75 and 0.4 are under 1.2, 0.75 + 0.6 isn't."""
    program = {"name": "sum", "init": {"total": 0}, "bind": {"c": "meta:confidence", "most": "bound:most"}, "let": {"next_total": "state.total + c"}, "next": {"total": "next_total"}, "keep": "next_total <= most"}
    got = ask(spark, FERRY, ["port"], 2, walk_part={"predicates": [program]}, capabilities=frozenset({"programs"}), most=Decimal("1.2"))
    assert found(got) == ["pi", "pc"]


def test_landing_scores(spark):
    catalog = spark.createDataFrame([("x", "Red Widget"), ("y", "red ring"), ("z", "ΟΔΟΣ"), ("w", None)], "id string, label string")
    got = landing.token_overlap(landing.anchors_frame(spark, [{"from": ["red widget", "οδοσ", "w"]}]), catalog)
    assert {r["id"]: r["score"] for r in got.collect()} == {"x": 5, "y": 1, "z": 3, "w": 3}


def test_unknown_cycle_policy(spark):
    with pytest.raises(PlanError):
        ask(spark, RING, ["a"], 1, cycle_policy="?")
