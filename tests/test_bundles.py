"""Bundle checks and identities."""

from pyspark.sql import functions as F

from claimloom.operators import bundles

CLAIMS = "bundle int, local_id string, subject string, predicate string, object_kind string, object string, datatype string, valid_time string, qualifier string"


def frame(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], CLAIMS)


def test_connection(spark):
    rows = [(1, "a", "x", "p", "iri", "y"), (1, "b", "y", "p", "iri", "z"), (2, "a", "x", "p", "iri", "y"), (2, "b", "z", "p", "literal", "1"), (3, "a", "x", "rdf:type", "iri", "C"), (3, "b", "y", "p", "literal", "1"), (4, "a", "x", "p", "literal", "1")]
    assert sorted(r["bundle"] for r in bundles.disconnected(frame(spark, *rows)).collect()) == [2, 3]


def test_types(spark):
    claims = frame(spark, (1, "ok", "x", "p", "iri", "y"), (1, "bad", "y", "p", "iri", "x"), (1, "lit", "x", "p", "literal", "1", "xsd:string"))
    types = spark.createDataFrame([(1, "x", "Sub"), (1, "y", "D"), (1, "y", "E")], "bundle int, entity string, class string")
    up = spark.createDataFrame([("Sub", "Sub"), ("Sub", "C"), ("D", "D"), ("E", "E")], "term string, ancestor string")
    rule = lambda c: spark.createDataFrame([("p", c)], "property string, class string")
    got = {(r["local_id"], r["reason"]) for r in bundles.type_violations(claims, types, rule("C"), rule("D"), up).collect()}
    assert got == {("bad", "domain"), ("bad", "range"), ("lit", "range")}


def test_spans(spark):
    rows = [("i", 0, 0, 5, 0, 20), ("i", 1, 4, 8, 0, 20), ("i", 2, 8, 9, 0, 20), ("j", 0, 3, 3, 0, 9), ("k", 0, 5, 30, 0, 20)]
    got = {(r["item"], r["at"]): r["reason"] for r in bundles.spans_in_order(spark.createDataFrame(rows, "item string, at int, start int, end int, window_start int, window_end int")).collect()}
    assert got == {("i", 1): "overlaps or out of order", ("j", 0): "empty or negative", ("k", 0): "outside the window"}


def test_roles(spark):
    rows = [("Chief Executive", "Ada Byron", "Ada Byron is the chief executive.", True), ("auditor", "Ada", "Ada is not a auditor", False), ("buyer", "Acme", "buyer Acme pays", True), ("buyer", "Acme", "Acme met the buyer", False), ("", "Acme", "Acme", False)]
    df = spark.createDataFrame(rows, "role string, name string, quote string, want boolean")
    assert df.where(bundles.role_explicit(F.col("role"), F.col("name"), F.col("quote")) != F.col("want")).count() == 0


def test_identities(spark):
    rows = [("d", "r1", "l1", "Acme", 3, 7, []), ("d", "r2", "l9", "Acme", 3, 7, []), ("d", "r3", "l1", "Acme", 3, 7, []), ("d", "r3", "l1", "Acme", 30, 34, []), ("d", "r4", "l1", "Bob", 9, 12, ["id=1"]), ("d", "r5", "l1", "Bob", 9, 12, ["id=2"])]
    got = {r["request"]: (r["entity"], r["anchor"]) for r in bundles.document_entities(spark.createDataFrame(rows, "doc string, request string, local_id string, name string, start int, end int, identifiers array<string>")).collect()}
    assert got["r1"] == got["r2"] and got["r1"][1] == "exact"
    assert got["r3"][1] == "contextual" and got["r3"][0] != got["r1"][0]
    assert got["r4"][0] != got["r5"][0]


def test_ancestry_and_sources(spark):
    log = spark.createDataFrame([(k,) for k in (1, 2, 3, 5)], "seq int")
    assert bundles.contiguous(log, 1, 3) and bundles.contiguous(log, 3, 3) and not bundles.contiguous(log, 2, 5)
    rows = [("a", [("s2", "u"), ("s1", "u")]), ("b", [("s1", "u")])]
    got = bundles.path_sources(spark.createDataFrame(rows, "claim_id string, lineage array<struct<source_id:string,uri:string>>")).collect()
    assert [r["source_id"] for r in got] == ["s1", "s2"]


def test_component_report(spark):
    rows = [("entity", True, True, True), ("entity", False, False, True), ("entity", False, True, False)]
    r = bundles.component_report(spark.createDataFrame(rows, "kind string, grounded boolean, expected boolean, proposed boolean")).first()
    assert (r["proposed"], r["grounded"], r["precision"], r["recall"]) == (2, 1, 500, 500)
