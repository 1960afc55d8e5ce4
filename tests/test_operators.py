"""Scans, predicates, lifecycle, policy, ontology, inventories, vocabulary, streams, imports, replay."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimloom.operators import inventory, landing, ontology, policy, replay, scan, temporal, vocabulary
from claimloom.operators.predicates import Lane, ListLane, PlanError, conjunction, test as predicate
from claimloom.plans.compile import compile_query
from claimloom.sources import imports
from claimloom.streaming.changes import Conflict, Snapshots, check_predecessors

from .test_walk import FERRY, claims

# ---------------------------------------------------------------- predicates

EXT = '{"n": 7, "s": "abc", "b": true, "null": null, "a.b": 1, "big": 12.5}'


def ask(spark, op, key, value):
    df = spark.createDataFrame([(EXT,)], "ext string").withColumn("ext", F.parse_json("ext"))
    return df.select(predicate(op, Lane.json(F.col("ext"), key), value).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "op,key,value,want",
    [
        ("=", "n", 7, True), ("!=", "n", 7, False), ("!=", "none", 7, False), ("=", "none", None, False), ("=", "null", None, True), ("!=", "null", 3, True), ("=", "null", 3, False),
        (">", "n", 6, True), ("<=", "n", Decimal("6.5"), False), (">", "none", 6, False), ("=", "s", "abc", True), ("<", "s", "abd", True), ("=", "b", True, True), ("contains", "s", "bc", True), ("contains", "s", "", True),
        ("in", "n", [1, 7], True), ("not_in", "n", [1, 2], True), ("not_in", "none", [1], False), ("in", "null", [None], True), ("exists", "null", True, True), ("exists", "none", True, False), ("exists", "none", False, True),
        ("=", "a.b", 1, True), (">=", "big", Decimal("12.5"), True),
    ],
)
def test_open_metadata(spark, op, key, value, want):
    assert ask(spark, op, key, value) is want


@pytest.mark.parametrize("op,key,value", [("=", "n", "7"), (">", "null", 1), ("in", "s", [1]), ("contains", "n", "7"), ("in", "n", ["x"])])
def test_type_errors_at_run_time(spark, op, key, value):
    with pytest.raises(PySparkException):
        ask(spark, op, key, value)


@pytest.mark.parametrize("op,value", [(">", None), (">", True), ("in", 1), ("in", [1, "a"]), ("exists", 1), ("~", 1), ("isa", "x"), ("=", [1]), ("contains_any", [1])])
def test_type_errors_of_plans(spark, op, value):
    with pytest.raises(PlanError):
        predicate(op, Lane.of("number", F.lit(1)), value)


def test_lists(spark):
    df = spark.createDataFrame([([("a", 1), ("b", None), ("a", 3)],)], "steps array<struct<s:string,n:int>>")
    names = ListLane.over(F.col("steps"), lambda s: Lane.of("string", s["s"]))
    numbers = ListLane.over(F.col("steps"), lambda s: Lane.of("number", s["n"]))
    got = df.select(predicate("contains", names, "b"), predicate("contains", names, "c"), predicate("contains_any", names, ["x", "a"]), predicate("contains", numbers, 3), predicate("contains", numbers, None), predicate("exists", names, True)).first()
    assert list(got) == [True, False, True, True, False, True]
    with pytest.raises(PlanError):
        predicate("contains_any", names, [1, "a"])


def test_conjunction_stops_at_the_first_failure(spark):
    boom = F.raise_error(F.lit("reached")).cast("boolean")
    assert spark.range(1).select(conjunction([F.col("id") > 0, boom]).alias("x")).first()["x"] is False
    with pytest.raises(PySparkException):
        spark.range(1).select(conjunction([F.col("id") == 0, boom]).alias("x")).collect()


# ---------------------------------------------------------------- lifecycle, clock, policy


def test_lifecycle(spark):
    held = claims(spark, [("a", "s", "t", "1"), ("b", "s", "t", "1"), ("c", "s", "t", "1"), ("d", "s", "t", "1")])
    t = lambda k: datetime(2026, 1, k)
    rows = [("x1", "a", "contradicted_by", t(1), False), ("x2", "a", "retracted_by", t(2), False), ("x3", "a", "retracted_by", t(3), False), ("x0", "a", "retracted_by", t(3), False), ("y", "b", "superseded_by", t(9), False), ("z", "d", "superseded_by", t(1), True)]
    life = spark.createDataFrame(rows, "assertion_id string, target string, relation string, transaction_time timestamp, denied boolean")
    got = {r["claim_id"]: (r["lifecycle_state"], r["supports"]) for r in temporal.fold(held, life, "2026-01-05").collect()}
    assert got == {"a": ("retracted", ["x0", "x3", "x2"]), "b": ("active", []), "c": ("active", [])}
    with pytest.raises(PySparkException):
        temporal.fold(held, life.withColumn("relation", F.lit("liked_by"))).collect()


def test_clock(spark):
    walls = [5, 5, 4, 10, 10, 3]
    got = temporal.monotonic(spark.createDataFrame(list(enumerate(walls)), "seq int, wall long"), ["seq"], "wall").orderBy("seq").collect()
    want, last = [], -(10**9)
    for w in walls:
        last = max(w, last + 1)
        want.append(last)
    assert [r["allocated"] for r in got] == want and temporal.allocate(5, 7, 3) == 8


def test_policy(spark):
    asked = spark.createDataFrame([(r, p) for r in ("r1", "r2", "r3") for p in ("p", "q")], "resource string, property string")
    schema = "rule_id string, target string, value string, allow boolean, required boolean"
    kinds = spark.createDataFrame([("r3", "k")], "resource string, class string")

    def run(*rules):
        got = policy.decide(asked, spark.createDataFrame(list(rules), schema), kinds).collect()
        return {r["resource"] + r["property"] for r in got if r["allowed"]}

    assert run() == set()
    assert run(("1", "property", "p", True, False)) == {"r1p", "r2p", "r3p"}
    assert run(("1", "default", None, True, False), ("2", "subject", "r1", False, False)) == {"r2p", "r2q", "r3p", "r3q"}
    assert run(("1", "subject", "r1", False, False), ("2", "property", "p", True, True), ("3", "class", "k", False, True)) == {"r1p", "r2p"}


def test_visible_fixpoint(spark):
    ids = spark.createDataFrame([(c,) for c in "abcdx"], "claim_id string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "gone"), ("x", "d")], "claim_id string, support_id string")
    assert {r[0] for r in policy.visible_fixpoint(ids, needs).collect()} == {"a", "b", "c"}


# ---------------------------------------------------------------- scans and landing


def test_scans(spark):
    held = claims(spark, [("loop", "s", "s", "1"), ("a", "s", "t", "0.8")])
    nodes = spark.createDataFrame([("s",)], "node string")
    both = sorted((r["claim_id"], r["orientation"]) for r in scan.incident(held, nodes, "both").collect())
    assert both == [("a", "outgoing"), ("loop", "outgoing")]
    assert [r["claim_id"] for r in scan.page(held, "claim_id", "a", 1).collect()] == ["loop"]
    with pytest.raises(ValueError):
        scan.page(held, "claim_id", None, 0)


def test_latest_then_cutoff(spark):
    rows = [("k", 1, "old", datetime(2026, 1, 1)), ("k", 2, "new", datetime(2026, 3, 1)), ("m", 1, "only", datetime(2026, 1, 1))]
    got = landing.latest_image(spark.createDataFrame(rows, "key string, seq int, label string, time timestamp"), "key", "seq", "time", "2026-02-01").collect()
    assert [r["label"] for r in got] == ["only"]  # the latest of k is later than the cutoff, and an older one isn't taken


# ---------------------------------------------------------------- ontology

FAMILIES = [
    ("symmetric", [("p", "rdf:type", "owl:SymmetricProperty"), ("a", "p", "b")], ("b", "p", "a")),
    ("inverse", [("p", "owl:inverseOf", "q"), ("a", "q", "b")], ("b", "p", "a")),
    ("transitive", [("p", "rdf:type", "owl:TransitiveProperty"), ("a", "p", "b"), ("b", "p", "c")], ("a", "p", "c")),
    ("chain", [("r", "owl:chain1", "p"), ("r", "owl:chain2", "q"), ("a", "p", "b"), ("b", "q", "c")], ("a", "r", "c")),
    ("domain", [("p", "rdfs:domain", "C"), ("a", "p", "b")], ("a", "rdf:type", "C")),
    ("range", [("p", "rdfs:range", "C"), ("a", "p", "b")], ("b", "rdf:type", "C")),
    ("subproperty", [("p", "rdfs:subPropertyOf", "q"), ("a", "p", "b")], ("a", "q", "b")),
    ("functional", [("p", "rdf:type", "owl:FunctionalProperty"), ("a", "p", "b"), ("a", "p", "c")], ("b", "owl:sameAs", "c")),
    ("inverse_functional", [("p", "rdf:type", "owl:InverseFunctionalProperty"), ("a", "p", "c"), ("b", "p", "c")], ("a", "owl:sameAs", "b")),
    ("key", [("C", "owl:hasKey", "p"), ("a", "rdf:type", "C"), ("b", "rdf:type", "C"), ("a", "p", "1"), ("b", "p", "1")], ("a", "owl:sameAs", "b")),
    ("subclass", [("C", "rdfs:subClassOf", "D"), ("a", "rdf:type", "C")], ("a", "rdf:type", "D")),
    ("equivalent_class", [("C", "owl:equivalentClass", "D"), ("a", "rdf:type", "D")], ("a", "rdf:type", "C")),
    ("has_value_type", [("R", "owl:hasValue", "v"), ("R", "owl:onProperty", "p"), ("a", "p", "v")], ("a", "rdf:type", "R")),
    ("has_value_fact", [("R", "owl:hasValue", "v"), ("R", "owl:onProperty", "p"), ("a", "rdf:type", "R")], ("a", "p", "v")),
    ("some_values", [("R", "owl:someValuesFrom", "C"), ("R", "owl:onProperty", "p"), ("a", "p", "b"), ("b", "rdf:type", "C")], ("a", "rdf:type", "R")),
    ("all_values", [("R", "owl:allValuesFrom", "C"), ("R", "owl:onProperty", "p"), ("a", "rdf:type", "R"), ("a", "p", "b")], ("b", "rdf:type", "C")),
    ("intersection", [("I", "owl:intersectionOf", "C"), ("I", "owl:intersectionOf", "D"), ("a", "rdf:type", "C"), ("a", "rdf:type", "D")], ("a", "rdf:type", "I")),
    ("union", [("U", "owl:unionOf", "C"), ("U", "owl:unionOf", "D"), ("a", "rdf:type", "D")], ("a", "rdf:type", "U")),
    ("one_of", [("O", "owl:oneOf", "a")], ("a", "rdf:type", "O")),
    ("max_cardinality", [("M", "owl:maxCardinality", "1"), ("M", "owl:onProperty", "p"), ("a", "rdf:type", "M"), ("a", "p", "b"), ("a", "p", "c")], ("b", "owl:sameAs", "c")),
    ("max_qualified_cardinality", [("M", "owl:maxQualifiedCardinality", "1"), ("M", "owl:onProperty", "p"), ("M", "owl:onClass", "C"), ("a", "rdf:type", "M"), ("a", "p", "b"), ("a", "p", "c"), ("a", "p", "d"), ("b", "rdf:type", "C"), ("c", "rdf:type", "C")], ("b", "owl:sameAs", "c")),
]


def triples(spark, rows):
    return spark.createDataFrame([(*r, False) if len(r) == 3 else r for r in rows], "s string, p string, o string, lit boolean")


@pytest.mark.parametrize("name,rows,want", FAMILIES, ids=[f[0] for f in FAMILIES])
def test_rule_families(spark, name, rows, want):
    new = {(r["s"], r["p"], r["o"]) for r in ontology.RULES[name](triples(spark, rows)).collect()}
    assert want in new and len({x for x in new if x[1] == "owl:sameAs"}) <= 1


def test_literals_don_t_take_entity_rules(spark):
    rows = [("p", "rdfs:range", "C", False), ("p", "rdfs:domain", "D", False), ("a", "p", "text", True)]
    assert ontology.RULES["range"](triples(spark, rows)).count() == 0 and ontology.RULES["domain"](triples(spark, rows)).count() == 1


def test_materialise_with_same_nodes(spark):
    rows = [("p", "rdf:type", "owl:FunctionalProperty"), ("x", "p", "b"), ("x", "p", "c"), ("c", "q", "z"), ("q", "rdfs:domain", "K")]
    got = {(r["s"], r["p"], r["o"]) for r in ontology.materialise(triples(spark, rows), ["functional", "domain"]).collect()}
    assert ("b", "q", "z") in got and ("b", "rdf:type", "K") in got and ("b", "owl:sameAs", "c") in got and ("c", "q", "z") not in got
    with pytest.raises(RuntimeError):
        ontology.materialise(triples(spark, rows), ["functional", "domain"], most=2)


def test_closure_and_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "c string, p string")
    got = {(r[0], r[1]) for r in ontology.closure(pairs, "c", "p").collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"} | {("d", x) for x in "abcd"}
    assert ontology.cycles({"a": ["b"], "b": ["c"], "c": ["a"], "d": ["d", "a"], "e": []}) == [["a", "b", "c"], ["d"]]


# ---------------------------------------------------------------- inventories and vocabulary


def test_reports(spark):
    rows = spark.createDataFrame([("s", float(v)) for v in [5, 1, 9, 3]] + [("t", None)], "stage string, ms double")
    got = inventory.latency_report(rows, "stage", "ms").collect()
    assert [(r["stage"], r["n"], r["p50"], r["p95"], r["most"]) for r in got] == [("s", 4, 3.0, 5.0, 9.0)]
    a, b = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in ("abca", "cba"))
    assert inventory.set_root(a, "x").first()[0] == inventory.set_root(b, "x").first()[0] != inventory.set_root(a.where("x <> 'a'"), "x").first()[0]
    mark = inventory.cursor("snap", "q", 20)
    assert inventory.read_cursor(mark, "snap", "q") == 20
    with pytest.raises(ValueError):
        inventory.read_cursor(mark, "other", "q")
    with pytest.raises(ValueError):
        inventory.complete_or_rejected(a, 2)


def test_vocabulary(spark):
    terms = spark.createDataFrame([("x:NetIncome", "class", "Net Income", ["profit"], "What is left", "canonical"), ("x:Income", "class", "Income", None, None, "canonical"), ("x:Profit", "class", "Profit", ["gain"], None, "deprecated")], "iri string, kind string, label string, synonyms array<string>, definition string, status string")
    asked = spark.createDataFrame([("profit",), ("Income",), ("none",), ("Profit",)], "text string")
    got = {r["text"]: (r["status"], r["iri"]) for r in vocabulary.resolve_exact(terms, asked).collect()}
    assert got == {"profit": ("unique", "x:NetIncome"), "Income": ("unique", "x:Income"), "none": ("not_found", None), "Profit": ("unique", "x:Profit")}
    rank = vocabulary.match_rank(F.lit("in-come"), *[F.col(c) for c in ("iri", "label", "synonyms", "definition")])
    assert {r["iri"]: r["r"] for r in terms.select("iri", rank.alias("r")).collect()} == {"x:NetIncome": 2, "x:Income": 0, "x:Profit": None}
    assert [r["iri"] for r in vocabulary.search(terms, "INCOME").collect()] == ["x:Income", "x:NetIncome"]


def test_gazetteer(spark):
    facts = [("g", "e1", "rdf:type", "Firm", False), ("g", "e1", "name", "Acme", True), ("g", "e1", "name", "ACME", True), ("g", "e1", "vat", "77", True), ("h", "e1", "vat", "88", True)]
    facts += [("g", "e2", "rdf:type", "Firm", False), ("g", "e2", "name", "Bolt", True), ("g", "e3", "rdf:type", "Person", False), ("g", "e3", "vat", "99", True), ("g", "e4", "rdf:type", "Firm", False), ("g", "e4", "vat", "5", True)]
    table = spark.createDataFrame(facts, "graph string, subject string, predicate string, object string, lit boolean")
    approved = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "iri string")
    made = vocabulary.build_gazetteer(table, approved, ["g"], ["name"], ["vat"], ["Firm"])
    got = made.collect()
    # e2 has no identifier, e3 is no firm, e4 isn't approved; what graph h says isn't seen
    assert [(r["iri"], r["labels"], [tuple(i) for i in r["identifiers"]]) for r in got] == [("e1", ["ACME", "Acme"], [("vat", "77")])]
    assert {r["iri"] for r in vocabulary.build_gazetteer(table, approved, ["g", "h"], ["name"], ["vat"]).collect()} == {"e1", "e3"}
    asked = spark.createDataFrame([("r1", "e1", "vat no. 77"), ("r1", "e1", "nothing"), ("r2", "e1", "vat no. 88"), ("r3", "e9", "77")], "request string, iri string, quote string")
    probes = vocabulary.identifier_probes(asked, made)
    assert sorted((r["request"], r["value"] or "") for r in probes.collect()) == [("r1", "77"), ("r2", ""), ("r3", "")]
    status = {r["request"]: r["status"] for r in vocabulary.resolve_known(probes, vocabulary.identifier_index(made), made).collect()}
    assert status == {"r1": "resolved", "r2": "identifier_required", "r3": "identifier_required"}


def test_authority(spark):
    held = claims(spark, [("a", "x", "y", "1"), ("b", "y", "z", "1"), ("c", "x", "<secret>", "1"), ("d", "x", "w", "1")]).withColumn("lineage", F.when(F.col("claim_id") == "d", F.array(F.struct(F.lit("closed").alias("source_id")))))
    rules = spark.createDataFrame([("1", "default", None, True, False), ("2", "subject", "z", False, False), ("3", "subject", "closed", False, False)], "rule_id string, target string, value string, allow boolean, required boolean")
    life = spark.createDataFrame([("l", "a", "retracted_by", datetime(2025, 4, 1))], "assertion_id string, target string, relation string, transaction_time timestamp")
    got = {r["claim_id"]: r["lifecycle_state"] for r in policy.Authority(rules, lifecycle=life).usable(held).collect()}
    assert got == {"a": "retracted", "c": "active"}  # b leads to z, d was made from a closed source
    assert {r["claim_id"] for r in policy.Authority(rules, lifecycle=life).usable(held, "2025-03-01").collect()} == set()
    support = spark.createDataFrame([("y", "z"), ("w", "a")], "entity string, support_id string")
    assert {r["claim_id"] for r in policy.Authority(rules, classified=support).usable(held).collect()} == {"c"}


def test_hidden_terms_fail_a_query(spark):
    from claimloom.plans.run import execute

    rules = spark.createDataFrame([("1", "default", None, True, False), ("2", "subject", "secret", False, False)], "rule_id string, target string, value string, allow boolean, required boolean")
    empty = spark.createDataFrame([], "term string, ancestor string")

    def run(term):
        plan = compile_query({"about": [{"from": ["port"], "match": "exact"}], "bounds": {"max_depth": 1}, "walk": {"predicates": [["meta:object_id", "not_isa", term]]}}, capabilities=frozenset({"ontology"}))
        return execute(plan, claims(spark, FERRY), spark.createDataFrame([("port", None)], "id string, label string"), authority=policy.Authority(rules), ontology={"class": empty})

    with pytest.raises(PlanError) as e:
        run("secret")
    assert e.value.kind == "denied"
    got = run("open")
    assert got.paths.count() == 2 and got.release(policy.Authority(rules)).count() == 2
    with pytest.raises(PlanError):
        got.release(policy.Authority(rules.where("rule_id = '1'")))
    assert {tuple(r) for r in got.footprint.collect()} == {("port", "knows"), ("port", "identity"), ("knows", "vocabulary"), ("isle", "identity"), ("cape", "identity")}


def test_limits_of_programs():
    from claimloom.operators.programs import Program

    Program({"let": {"a": "1 + 2", "b": "a * a"}, "keep": "b > 3"}, "p")
    # each let doubles the one before: 2^20 operations of a few lines
    lets = {"a0": "1"} | {f"a{i}": f"a{i - 1} + a{i - 1}" for i in range(1, 21)}
    large = [{"let": lets, "keep": "a20 > 1"}, {"keep": "(" * 40 + "1" + " + 1)" * 40 + " > 1"}, {"keep": "min(" + ", ".join(["abs(1)"] * 1100) + ") > 1"}, {"init": {"s": "x" * 70_000}, "keep": "true"}]
    for spec in large:
        with pytest.raises(PlanError) as e:
            Program(spec, "p")
        assert e.value.kind == "limit"


def test_entity_ids(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["a", "b"],), (["a"],)], "anchors array<string>")
    ids = [r[0] for r in df.select(vocabulary.entity_id(F.lit("doc"), F.col("anchors"))).collect()]
    assert ids[0] == ids[1] != ids[2]
    mentions = spark.createDataFrame([("Acme", "org"), ("Acme", "person"), ("New", "org")], "spelling string, class string")
    known = spark.createDataFrame([("Acme", "org", "e:1"), ("Acme", "person", "e:2"), ("Acme", "person", "e:3")], "spelling string, class string, iri string")
    got = {(r["spelling"], r["class"]): (r["entity"], r["minted"]) for r in vocabulary.resolve_or_mint(mentions, known, "doc").collect()}
    assert got["Acme", "org"] == ("e:1", False) and got["Acme", "person"][1] and got["New", "org"][0].startswith("minted:")


# ---------------------------------------------------------------- streams, imports, replay


def test_snapshots(spark, tmp_path):
    log = lambda *rows: spark.createDataFrame(list(rows), "seq long, key string, op string, payload string")
    s = Snapshots(spark, str(tmp_path / "s"), keep=2)
    assert s.read().count() == 0 and s.head() == -1
    s.apply(log((1, "a", "put", "1"), (2, "b", "put", "1"), (3, "a", "put", "2")))
    assert s.apply(log((1, "a", "put", "1"), (2, "b", "put", "1"), (3, "a", "put", "2"))) == 3  # a retry
    s.apply(log((4, "b", "delete", None)))
    # another batch under numbers that were applied, a part of one, a gap, a number twice, an overlap
    others = ([(3, "a", "put", "old")], [(1, "a", "put", "1")], [(6, "a", "put", "3")], [(5, "a", "put", "3"), (5, "b", "put", "3")], [(4, "b", "delete", None), (5, "a", "put", "3")])
    for rows in others:
        with pytest.raises(Conflict):
            s.apply(log(*rows))
    assert s.head() == 4
    assert s.apply(log((1, "a", "put", "1"), (2, "b", "put", "1"), (3, "a", "put", "2"), (4, "b", "delete", None))) == 4  # both batches at once
    assert {(r["key"], r["payload"]) for r in s.read().collect()} == {("a", "2")}
    assert {(r["key"], r["payload"]) for r in s.read(3).collect()} == {("a", "2"), ("b", "1")}
    with pytest.raises(LookupError):
        s.read(2)
    for k in range(5, 9):
        s.apply(log((k, "c", "put", str(k))))
    assert s.generations() == [6, 7, 8]
    chain = spark.createDataFrame([("k", 1, None, "x"), ("k", 2, "x", "y"), ("k", 3, "x", "z")], "key string, seq int, previous string, digest string")
    assert [r["seq"] for r in check_predecessors(chain).collect()] == [3]


def test_stale_pins(spark, tmp_path):
    s, log = Snapshots(spark, str(tmp_path / "s")), spark.range(12).withColumnRenamed("id", "seq")
    for low, top in ((0, 4), (4, 7)):
        s.apply(log.where(f"seq >= {low} and seq < {top}").selectExpr("seq", "'k' as key", "'put' as op", "string(seq) as payload"))
    assert s.pin(3) == (3, False) and s.pin(6, log, "allow_stale") == (6, False) and s.pin(9, log, "allow_stale") == (6, True)
    for at, changes, how in ((9, log, "exact"), (9, log.where("seq <> 8"), "allow_stale"), (9, None, "allow_stale"), (2, log, "allow_stale")):
        with pytest.raises(LookupError):
            s.pin(at, changes, how)


def test_changes_name_what_they_replace(spark, tmp_path):
    import hashlib

    of = lambda text: hashlib.sha256(text.encode()).hexdigest()
    log = lambda *rows: spark.createDataFrame(list(rows), "seq long, key string, op string, payload string, previous string")
    s = Snapshots(spark, str(tmp_path / "s"))
    s.apply(log((0, "a", "put", "x", None), (1, "a", "put", "y", of("x")), (2, "b", "put", "z", None)))
    for row in ((3, "a", "put", "w", of("x")), (3, "a", "put", "w", None), (3, "c", "put", "w", of("x"))):
        with pytest.raises(Conflict):
            s.apply(log(row))
    s.apply(log((3, "a", "delete", None, of("y")), (4, "a", "put", "new", None)))
    assert {(r["key"], r["payload"]) for r in s.read().collect()} == {("a", "new"), ("b", "z")}


def test_imports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.exe").write_text("x")
    (tmp_path / "sub").mkdir()
    got = {r["name"]: (r["kind"], r["status"], r["text"]) for r in imports.folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("plain", "accepted", "héllo"), "b.md": ("markdown", "not UTF-8", None), "c.exe": (None, "unsupported kind", None)}
    with pytest.raises(ValueError):
        imports.folder(spark, str(tmp_path), 2)
    literals = [("200", "xsd:unsignedByte", True), ("256", "xsd:unsignedByte", False), ("-1", "xsd:nonNegativeInteger", False), ("1.5", "xsd:decimal", True), ("x", "xsd:decimal", False), ("2024-02-30", "xsd:date", False), ("2024-02-29Z", "xsd:date", True), ("maybe", "xsd:boolean", False), ("any", "xsd:string", True)]
    df = spark.createDataFrame([(v, t) for v, t, _ in literals], "v string, t string")
    assert [r[0] is None for r in df.select(imports.literal_error(F.col("v"), F.col("t"))).collect()] == [ok for _, _, ok in literals]
    store = imports.Store(spark, str(tmp_path / "store"))
    rows = spark.range(3)
    assert store.admit(rows, "k1", 100) == (1, 100) == store.admit(rows, "k1", 500)
    assert store.admit(rows, "k2", 50) == (2, 101) and store.read().count() == 6 and store.read(1).count() == 3


def test_replay(spark):
    catalog = spark.createDataFrame([("port", None)], "id string, label string")
    plan = compile_query({"about": [{"from": ["port"], "match": "exact"}], "bounds": {"max_depth": 2}})
    held = replay.record(plan, claims(spark, FERRY), catalog, "one")
    again = lambda edges, snap: replay.replay(held, claims(spark, edges), catalog, snap)
    assert again(FERRY, "one") == "reproduced" and again(FERRY, "two") == "best_effort"
    assert again(FERRY[:2], "one") == "diverged"
    assert replay.replay(held | {"snapshot": None}, claims(spark, FERRY), catalog, "one") == "not_replayable"
    verdicts = spark.createDataFrame([("reproduced",), ("diverged",), ("best_effort",)], "v string")
    assert verdicts.agg(replay.weakest(F.col("v"))).first()[0] == "diverged"
