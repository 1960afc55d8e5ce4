"""Queries over what a principal may see, ontology predicates in plans, evidence and the gazetteer."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import lexical
from claimloom.operators import documents, ontology, policy, vocabulary, walk
from claimloom.plans.compile import compile_query
from claimloom.plans.run import execute
from claimloom.queries import _LINES, _ORDERS, _STATE, _STRUCT, query, walk_sql
from claimloom.sources import star

RULES = [
    ("d", "default", None, True, False),
    ("s", "subject", "o:3", False, False),
    ("v", "subject", "in_region", False, False),
    ("c", "class", "closed", False, True),
]
_SEEDS = sorted(_ORDERS)
_CLOSED = "(object_kind = 'iri' and object_id like 's:%' and try_cast(substr(object_id, 3) as int) % 7 = 0)"
_USABLE = f"subject_id <> 'o:3' and object_id <> 'o:3' and relation <> 'in_region' and not {_CLOSED}"


def _authority(spark, d, lifecycle):
    """Order 3 is hidden, and the vocabulary's record of in_region, and every seventh supplier."""
    suppliers = star.table(spark, d, "supplier").where(F.col("s_suppkey") % 7 == 0)
    classes = suppliers.select(F.concat(F.lit("s:"), "s_suppkey").alias("resource"), F.lit("closed").alias("class"))
    rules = spark.createDataFrame(RULES, "rule_id string, target string, value string, allow boolean, required boolean")
    return policy.Authority(rules, classes, lifecycle)


@query(
    "authorized_claims",
    f"with {_STATE.format('')} select relation, lifecycle_state, count(*) as n from stated where {_USABLE} and not (subject_id like 's:%' and try_cast(substr(subject_id, 3) as int) % 7 = 0) group by relation, lifecycle_state",
)
def authorized_claims(spark, d):
    """All usable claims with their states: each needs its relation, its ends and the relation's record to be visible."""
    return _authority(spark, d, star.lifecycle(spark, d)).usable(star.claims(spark, d)).groupBy("relation", "lifecycle_state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "query_authorized",
    f"with {_STATE.format('')}, "
    + walk_sql(f"select * from stated where {_USABLE} and relation in ('contains', 'shipped_by', 'placed_by')", _SEEDS, 2, "both", 4, 100, 300, where="lifecycle_state <> 'retracted'").removeprefix("with "),
)
def query_authorized(spark, d):
    """A query of a principal, end to end: hidden claims neither land, nor take a place, nor use up a cap."""
    plan = compile_query(
        {
            "about": [{"from": _ORDERS, "match": "exact"}],
            "bounds": {"max_depth": 2, "seed_limit": 100, "fanout_limit": 4, "max_claims": 100, "path_limit": 300},
            "walk": {"direction": "both", "predicates": [["meta:lifecycle_state", "!=", "retracted"]]},
        }
    )
    catalog = star.table(spark, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.lit(None).cast("string").alias("label"))
    held = star.graph(spark, d, star.LINES + star.PLACED)
    return walk.summary(execute(plan, held, catalog, authority=_authority(spark, d, lambda targets: star.lifecycle(spark, d, targets))).paths)


@query(
    "complete_claims",
    "select relation, count(*) as n from claims where not (relation = 'contains' and length(object_id) % 2 = 0) and not (relation = 'label' and length(object_id) % 3 = 0) group by relation",
)
def complete_claims(spark, d):
    """Claims all of whose facts are visible, where some objects and some confidences are hidden."""
    one = lambda name: F.struct(F.lit(name).alias("property"), F.col(name).cast("string").alias("value"))
    n, facts = F.length("object_id"), F.array(*[one(c) for c in ("subject_id", "relation", "object_id", "confidence")])
    hidden = lambda f: ((F.col("relation") == "contains") & (n % 2 == 0) & (f["property"] == "object_id")) | ((F.col("relation") == "label") & (n % 3 == 0) & (f["property"] == "confidence"))
    held = star.claims(spark, d).where(policy.complete(facts, F.filter(facts, lambda f: ~hidden(f))))
    return held.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("disjoint_types", "select 'c:' || c_custkey as entity, 'party' as a, 'thing' as b from customer where c_custkey % 3 = 0 and c_nationkey < 10", claims=False)
def disjoint_types(spark, d):
    """Customers that fall under two classes declared disjoint."""
    c = star.table(spark, d, "customer")
    iri = F.concat(F.lit("c:"), "c_custkey").alias("entity")
    types = c.where(F.col("c_custkey") % 3 == 0).select(iri, F.lit("customer").alias("class")).unionByName(c.where(F.col("c_nationkey") < 10).select(iri, F.lit("part").alias("class")))
    closed = ontology.closure(spark.createDataFrame([("customer", "party"), ("part", "thing")], "a string, b string"), "a", "b")
    return ontology.disjoint_violations(types, spark.createDataFrame([("party", "thing")], "a string, b string"), closed)


@query("iri_encoded", "select distinct text[1:40] as part, url_encode(text[1:40]) as iri from documents where text is not null", claims=False)
def iri_encoded(spark, d):
    part = F.substring("text", 1, 40)
    return star.table(spark, d, "documents").where("text is not null").select(part.alias("part"), lexical.percent_encoded(part).alias("iri")).distinct()


# ---------------------------------------------------------------- ontology predicates


def _ontology(spark):
    """Relations below ``located``, one of them below ``member`` too; regions below ``west`` or ``east``."""
    up = spark.createDataFrame([("in_nation", "member"), ("member", "located"), ("in_region", "located"), ("placed_by", "deal")], "a string, b string")
    kinds = spark.createDataFrame([("r:0", "west"), ("r:1", "west"), ("r:3", "east"), ("west", "place"), ("east", "place")], "a string, b string")
    return {"property": ontology.closure(up, "a", "b"), "class": ontology.closure(kinds, "a", "b")}


def _asked(spark, d, seeds, bounds, walk_part, filters=()):
    about = [{"from": seeds, "match": "exact"}]
    plan = compile_query({"about": about, "bounds": bounds, "walk": walk_part, "filter": {"predicates": list(filters)}}, capabilities=frozenset({"ontology"}))
    catalog = spark.createDataFrame([(s, None) for s in seeds], "id string, label string")
    return walk.summary(execute(plan, star.graph(spark, d, star.STRUCTURE + star.PLACED), catalog, ontology=_ontology(spark)).paths)


@query("query_subproperty", walk_sql(_STRUCT, ["r:3"], 3, "incoming", None, None, 400, where="relation in ('in_nation', 'in_region')"))
def query_subproperty(spark, d):
    return _asked(spark, d, ["r:3"], {"max_depth": 3, "fanout_limit": None, "max_claims": None, "path_limit": 400}, {"direction": "incoming", "predicates": [["meta:relation", "subproperty_of", "located"]]})


@query("query_not_subproperty", walk_sql(_STRUCT, ["c:1", "c:2", "c:3", "n:2"], 2, "both", 5, None, 400, where="relation <> 'in_nation'"))
def query_not_subproperty(spark, d):
    return _asked(spark, d, ["c:1", "c:2", "c:3", "n:2"], {"max_depth": 2, "seed_limit": 9, "fanout_limit": 5, "max_claims": None, "path_limit": 400}, {"direction": "both", "predicates": [["meta:relation", "not_subproperty_of", "member"]]})


_NATIONS = sorted(f"n:{i}" for i in range(25))


@query("query_isa", walk_sql(_STRUCT, _NATIONS, 1, "outgoing", None, None, 400, where="object_id in ('r:0', 'r:1')"))
def query_isa(spark, d):
    return _asked(spark, d, _NATIONS, {"max_depth": 1, "seed_limit": 99, "fanout_limit": None, "max_claims": None, "path_limit": 400}, {"predicates": [["meta:object_id", "isa", "west"]]})


@query("query_not_isa", walk_sql(_STRUCT, _NATIONS, 1, "outgoing", None, None, 400, where="object_id not in ('r:0', 'r:1')"))
def query_not_isa(spark, d):
    return _asked(spark, d, _NATIONS, {"max_depth": 1, "seed_limit": 99, "fanout_limit": None, "max_claims": None, "path_limit": 400}, {"predicates": [["meta:object_id", "not_isa", "west"]]})


_FROM = [f"c:{i}" for i in range(1, 30)]
_TO_REGION = walk_sql(_STRUCT, sorted(_FROM), 2, "outgoing", None, None, 400, keep="list_has_any(nodes, ['r:0', 'r:1'])")


@query("query_contains_isa", _TO_REGION)
def query_contains_isa(spark, d):
    """Paths of which some step leads to something below west."""
    bounds = {"max_depth": 2, "seed_limit": 99, "fanout_limit": None, "max_claims": None, "path_limit": 400}
    return _asked(spark, d, _FROM, bounds, {}, [["path.meta:object_id", "contains_isa", "west"]])


@query("query_contains_subproperty", walk_sql(_STRUCT, ["n:2", "n:3"], 2, "both", 5, None, 400, where="({depth} > 1 or relation = 'in_nation')"))
def query_contains_subproperty(spark, d):
    """A walk whose paths hold a member relation from the first step on."""
    bounds = {"max_depth": 2, "seed_limit": 9, "fanout_limit": 5, "max_claims": None, "path_limit": 400}
    return _asked(spark, d, ["n:2", "n:3"], bounds, {"direction": "both", "predicates": [["path.meta:relation", "contains_subproperty_of", "member"]]})


# ---------------------------------------------------------------- evidence


@query(
    "evidence_hydrated",
    """with s as (select doc_id, text, doc_id % 9 as k, 'sha256:' || sha256(text) as v, text[1:1] as head from documents where text[1:1] >= ' ' and text[1:1] < chr(127))
select 'd:' || doc_id as source_id, case when k in (1, 5) then 'unverifiable' when k in (2, 3, 4) then 'unavailable' when k = 6 then 'changed' else 'verified' end as outcome,
  case when k = 7 then text when k in (0, 8) then head end as content from s""",
    claims=False,
)
def evidence_hydrated(spark, d):
    """Each document as a source: by its first character or whole, of no version, another one, beyond its end, with a false witness, without hash."""
    docs = star.table(spark, d, "documents").select(F.concat(F.lit("d:"), "doc_id").alias("source_id"), "doc_id", "text")
    held = docs.where((F.substring("text", 1, 1) >= " ") & (F.substring("text", 1, 1) < "\x7f"))
    k, one = F.col("doc_id") % 9, F.substring("text", 1, 1)
    whole = k == 7
    own = F.when(k == 6, lexical.sha256(F.lit("other"))).when(whole, lexical.sha256(F.col("text"))).when(k != 5, lexical.sha256(one))
    sources = held.select(
        "source_id",
        F.when(k == 2, F.lit("sha256:0")).when(k != 1, lexical.sha256(F.col("text"))).alias("version"),
        F.when(~whole, F.lit(0)).alias("start"),
        F.when(k == 3, F.lit(1 << 30)).when(~whole, F.lit(1)).alias("end"),
        whole.alias("whole"),
        own.alias("content_hash"),
        F.when(k == 4, F.lit(2)).when(k == 8, F.lit(1)).cast("long").alias("line_start"),
    )
    return documents.hydrate(sources.unionByName(sources), docs).select("source_id", "outcome", "content")


# ---------------------------------------------------------------- gazetteer


def _facts(spark, d):
    """Customers as facts: class, label and segment in one graph, their number in another for every third."""
    c = star.table(spark, d, "customer")
    iri = F.concat(F.lit("c:"), "c_custkey")
    own = F.array(
        F.struct(F.lit("open").alias("graph"), F.lit("rdf:type").alias("predicate"), F.when(F.col("c_custkey") % 4 == 0, "Closed").otherwise("Customer").alias("object"), F.lit(False).alias("lit")),
        F.struct(F.lit("open").alias("graph"), F.lit("label").alias("predicate"), F.col("c_name").alias("object"), F.lit(True).alias("lit")),
        F.struct(F.lit("open").alias("graph"), F.lit("nickname").alias("predicate"), F.lower("c_name").alias("object"), F.lit(True).alias("lit")),
        F.struct(F.when(F.col("c_custkey") % 3 == 0, "hidden").otherwise("open").alias("graph"), F.lit("number").alias("predicate"), F.col("c_custkey").cast("string").alias("object"), F.lit(True).alias("lit")),
    )
    facts = c.select(iri.alias("subject"), F.explode(own).alias("f")).select("subject", "f.*")
    approved = c.where(F.col("c_custkey") % 5 != 0).select(iri.alias("iri"))
    return facts, approved


def _gazetteer(spark, d):
    facts, approved = _facts(spark, d)
    return vocabulary.build_gazetteer(facts, approved, ["open"], ["label", "nickname"], ["number"], ["Customer"])


_KNOWN = "select c_custkey as k, c_name from customer where c_custkey % 5 <> 0 and c_custkey % 4 <> 0 and c_custkey % 3 <> 0"


@query("gazetteer_build", f"select 'c:' || k as iri, 'Customer' as classes, array_to_string(list_sort([c_name, lower(c_name)]), '|') as labels, 'number=' || k as identifiers from ({_KNOWN})", claims=False)
def gazetteer_build(spark, d):
    ids = F.array_join(F.transform("identifiers", lambda i: F.concat(i["scheme"], F.lit("="), i["value"])), "|")
    return _gazetteer(spark, d).select("iri", F.array_join("classes", "|").alias("classes"), F.array_join("labels", "|").alias("labels"), ids.alias("identifiers"))


@query("gazetteer_aliases", f"select label, 'c:' || k as iri from ({_KNOWN}) t, unnest([c_name, lower(c_name)]) as u(label)", claims=False)
def gazetteer_aliases(spark, d):
    return vocabulary.alias_index(_gazetteer(spark, d))


@query(
    "identifier_probes",
    f"""with known as ({_KNOWN}), r as (select 'q' || c_custkey as request, c_custkey as k, case when c_custkey % 2 = 1 then 'customer ' || c_custkey || ' wrote' else 'nobody wrote' end as quote from customer)
select request, case when known.k is null or not contains(quote, cast(r.k as varchar)) then 'identifier_required' else 'resolved' end as status from r left join known on r.k = known.k""",
    claims=False,
)
def identifier_probes(spark, d):
    """Requests that name a customer and quote a document: with the customer's number in the quote they resolve."""
    c = star.table(spark, d, "customer")
    quote = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("customer "), "c_custkey", F.lit(" wrote"))).otherwise("nobody wrote")
    asked = c.select(F.concat(F.lit("q"), "c_custkey").alias("request"), F.concat(F.lit("c:"), "c_custkey").alias("iri"), quote.alias("quote"))
    held = _gazetteer(spark, d)
    return vocabulary.resolve_known(vocabulary.identifier_probes(asked, held), vocabulary.identifier_index(held), held).select("request", "status")
