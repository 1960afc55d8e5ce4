"""The query front end: its two forms, layers of defaults, and what is refused."""

import json
from decimal import Decimal

import pytest

from claimloom.operators.predicates import PlanError
from claimloom.plans.compile import compile_query, expand, merge, substitute
from claimloom.plans.text import parse

START = {"about": [{"from": ["harbour"], "match": "exact"}], "bounds": {"max_depth": 2}}
EVERY = frozenset({"lexical", "ontology", "programs"})


def refused(query, kind, **options):
    with pytest.raises(PlanError) as e:
        compile_query(query, **options)
    return e.value.kind == kind


def walking(*predicates):
    return START | {"walk": {"predicates": list(predicates)}}


def test_each_part_of_the_text_form():
    """Part by part, the text form gives what the other form says."""
    assert parse('QUERY\nABOUT\n  FROM "old town" TO quay MATCH approximate\n')["about"] == [{"from": ["old town"], "to": ["quay"], "match": "approximate"}]
    assert parse("QUERY\nBOUNDS\n  fanout_limit = 7\n  share = 0.125\n")["bounds"] == {"fanout_limit": 7, "share": Decimal("0.125")}
    assert parse('QUERY\nCONTEXT\n  sea = "urn:sea:"\n')["@context"] == {"sea": "urn:sea:"}
    assert parse("QUERY\nRETURN\n  explain\n  claims = false\n")["return"] == {"explain": True, "claims": False}
    got = parse("QUERY\nWALK both\n  WHERE\n    meta:relation = ships\n    meta:depth < 3\n")["walk"]
    assert got["direction"] == "both" and [p[:2] for p in got["predicates"]] == [["meta:relation", "="], ["meta:depth", "<"]]
    got = parse("QUERY\nFILTER\n  PREDICATE near\n    WHERE\n      meta:depth <= bound:far\n")["filter"]["predicates"]
    assert got == [{"name": "near", "where": ["meta:depth", "<=", "bound:far"]}]


def test_forms_agree_on_a_program():
    text = "QUERY\nABOUT\n  FROM harbour MATCH exact\nBOUNDS\n  max_depth = 4\nWALK incoming\n  PREDICATE hops\n    BIND\n      n = meta:depth\n    KEEP n < 4\n"
    value = {
        "about": [{"from": ["harbour"], "match": "exact"}],
        "bounds": {"max_depth": 4},
        "walk": {"direction": "incoming", "predicates": [{"name": "hops", "bind": {"n": "meta:depth"}, "keep": "n < 4"}]},
    }
    assert parse(text) == parse(json.dumps(value)) == value
    a, b = (compile_query(parse(t), capabilities=EVERY).digest() for t in (text, json.dumps(value)))
    assert a == b


def test_comments_and_number_spellings_change_nothing():
    plain = compile_query(parse("QUERY\nABOUT\n  FROM h MATCH exact\nBOUNDS\n  max_depth = 3\n"))
    spelt = compile_query(parse("QUERY\n# who\nABOUT\n  FROM h MATCH exact\nBOUNDS\n  max_depth = 3.00  // deep\n"))
    other = compile_query(parse("QUERY\nABOUT\n  FROM h MATCH exact\nBOUNDS\n  max_depth = 4\n"))
    assert plain.digest() == spelt.digest() != other.digest()


@pytest.mark.parametrize(
    "why,text",
    [
        ("a bound twice", "QUERY\nBOUNDS\n  far = 1\n  far = 1\n"),
        ("a key twice", '{"bounds": {}, "bounds": {}}'),
        ("a section that a query hasn't", "QUERY\nNAME sea\n"),
        ("a part that no result has", "QUERY\nRETURN\n  weather\n"),
        ("a tab", "QUERY\nFILTER\n\tWHERE\n"),
        ("an odd indent", "QUERY\n   BOUNDS\n"),
        ("a program that keeps nothing", "QUERY\nFILTER\n  PREDICATE p\n    INIT\n      n = 0\n"),
        ("an empty profile", "PROFILE\n"),
    ],
)
def test_malformed_texts(why, text):
    with pytest.raises(PlanError):
        parse(text)


def test_layers():
    low = {"bounds": {"far": 1, "ports": ["a", "b"]}, "filter": {"predicates": [["meta:depth", ">", 0], {"name": "n", "where": ["meta:depth", "<", 9]}]}}
    high = {"bounds": {"near": 0, "ports": ["c"]}, "filter": {"predicates": [{"name": "n", "where": ["meta:depth", "<", 5]}, ["meta:depth", "!=", 3]]}}
    both = merge(low, high)
    assert both["bounds"] == {"far": 1, "near": 0, "ports": ["c"]}
    # a named predicate is replaced where it stands, others are added
    assert both["filter"]["predicates"] == [["meta:depth", ">", 0], {"name": "n", "where": ["meta:depth", "<", 5]}, ["meta:depth", "!=", 3]]
    assert merge(low, {"filter": {"drop_predicates": ["n"]}})["filter"]["predicates"] == low["filter"]["predicates"][:1]
    assert merge(low, {"filter": {"predicates": []}})["filter"]["predicates"] == []
    assert merge(low, {"walk": {"direction": "both"}})["filter"] == low["filter"]


def test_profiles_and_defaults():
    profile = {"name": "coast", "about": [{"from": ["elsewhere"]}], "bounds": {"max_depth": 6, "fanout_limit": 2}, "filter": {"predicates": [["meta:depth", ">", 1]]}}
    plan = compile_query(START | {"profile": "coast"}, profile, {"defaults": {"bounds": {"path_limit": 30, "fanout_limit": 9}}})
    o = plan.options
    assert (o.max_depth, o.fanout_limit, o.path_limit, o.max_claims, plan.seed_limit) == (2, 2, 30, 16, 2)
    assert o.filters == [("meta:depth", ">", 1)] and plan.blocks[0]["from"] == ["harbour"] and plan.notices == ["ignored_profile_about"]
    assert refused(START | {"profile": "reef"}, "invalid", profile=profile)
    assert refused(START | {"profile": "coast/../reef"}, "invalid") and refused(START | {"profile": "/coast"}, "invalid")
    assert refused(START | {"profile": "coast"}, "unsupported", profile=profile | {"profile": "more"})


def test_names():
    context = {"sea": "urn:sea:"}
    assert expand(context, "sea:cod") == "urn:sea:cod" and expand(context, "http://sea/") == "http://sea/" and expand(context, "plain") == "plain"
    with pytest.raises(PlanError):
        expand(context, "land:cod")
    plan = compile_query(walking(["meta:relation", "in", ["sea:a", "bound:other"]]) | {"@context": context, "bounds": {"max_depth": 1, "other": "sea:b"}})
    assert plan.options.predicates == [("meta:relation", "in", ["urn:sea:a", "urn:sea:b"])]
    assert substitute(["bound:x", "y"], {"x": 3}) == [3, "y"]


FIELDS_AND_OPERANDS = {
    "invalid": [
        ["meta:depth", "<>", 2],
        ["meta:weather", "=", "fair"],
        ["depth", "=", 2],
        ["meta:depth", "=", "two"],
        ["meta:relation", "=", 2],
        ["meta:relation", "in", ["a", 2]],
        ["meta:relation", "in", "a"],
        ["meta:depth", "<=", "bound:unset"],
        ["meta:depth", ">=", None],
        ["meta:relation", "contains_any", ["a"]],
        ["path.meta:relation", "=", "a"],
        ["meta:claim_id", "exists", "yes"],
        ["meta:relation", "contains_isa", "a"],
        ["path.meta:relation", "isa", "a"],
        ["meta:confidence", "isa", "a"],
        ["meta:relation", "subproperty_of", 7],
    ],
    None: [
        ["meta:ext:sea:salt", "exists", True],
        ["meta:ext:salt", ">", 3],
        ["path.meta:relation", "contains", "a"],
        ["path.meta:object_id", "contains_any", ["a", "b"]],
        ["meta:grounding_level", ">=", "claim_only"],
        ["meta:object_id", "not_isa", "a"],
        ["path.meta:relation", "contains_subproperty_of", "a"],
        ["meta:relation", "!=", None],
    ],
}


@pytest.mark.parametrize("kind,triple", [(k, t) for k, ts in FIELDS_AND_OPERANDS.items() for t in ts], ids=str)
def test_static_types(kind, triple):
    if kind is None:
        assert compile_query(walking(triple), capabilities=EVERY).options.predicates == [tuple(triple)]
    else:
        assert refused(walking(triple), kind, capabilities=EVERY)


def test_what_needs_a_capability():
    lexical = {"about": [{"from": ["harbour"]}], "bounds": {"max_depth": 1}}
    programs, ontology = walking({"name": "all", "keep": "true"}), walking(["meta:object_id", "isa", "ship"])
    for query, name in ((lexical, "lexical"), (programs, "programs"), (ontology, "ontology")):
        assert refused(query, "unsupported", capabilities=EVERY - {name})
        compile_query(query, capabilities=EVERY)


def test_bounds():
    assert refused({"about": START["about"], "bounds": {}}, "invalid")
    assert refused(START | {"bounds": {"max_depth": -2}}, "range") and refused(START | {"bounds": {"max_depth": Decimal("1.5")}}, "range")
    assert refused(START | {"bounds": {"max_depth": True}}, "invalid") and refused(START | {"bounds": {"max_depth": 1, "cycle_policy": "never"}}, "invalid")
    zero = compile_query(START | {"bounds": dict.fromkeys(("path_limit", "max_claims", "fanout_limit", "max_depth", "seed_limit"), 0)})
    assert (zero.options.max_depth, zero.options.path_limit, zero.seed_limit) == (0, 0, 0)


def test_shapes():
    assert refused({"bounds": {"max_depth": 1}}, "invalid") and refused(START | {"weather": "fair"}, "invalid")
    assert refused(START | {"about": [{"from": [], "match": "exact"}]}, "invalid") and refused(START | {"about": [{"from": ["a"], "to": [], "match": "exact"}]}, "invalid")
    assert refused(START | {"walk": {"direction": "sideways"}}, "invalid") and refused(START | {"about": [{"from": ["a"], "match": "fuzzy"}]}, "invalid")


def test_captured_times():
    plain, at = compile_query(START), compile_query(START, captured="2025-03-09T10:00:00Z")
    assert plain.as_of is None and at.as_of.startswith("2025-03-09T10:00:00") and plain.digest() != at.digest()
    own = START | {"bounds": START["bounds"] | {"as_of": "2024-01-01T00:00:00Z"}}
    assert compile_query(own, captured="2025-03-09T10:00:00Z").digest() == compile_query(own).digest()
