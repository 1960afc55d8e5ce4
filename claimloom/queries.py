"""Queries of the claim-graph operators, each with the SQL it equals.

QUERIES maps a name to a function of (spark, sf_dir); ORACLE_SQL maps the same
name to SQL over the tables, where SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import landing, policy, scan, temporal, walk
from claimloom.operators.predicates import Lane, test
from claimloom.sources import star

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, claims: bool = True):
    """Register a query; sql may use the tables of star.SQL_CLAIMS where claims is true."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (f"with {star.SQL_CLAIMS}, " + sql.removeprefix("with ") if sql.startswith("with ") else f"with {star.SQL_CLAIMS} {sql}") if claims else sql
        return f

    return add


# ---------------------------------------------------------------- scans

_SCAN = "claim_id, subject_id, relation, object_id"


@query("scan_point", f"select {_SCAN} from claims where claim_id in ('nr:3', 'oc:17')")
def scan_point(spark, d):
    return scan.by_id(star.claims(spark, d), "nr:3", "oc:17").select("claim_id", "subject_id", "relation", "object_id")


def _incident(spark, d, direction):
    nodes = spark.createDataFrame([("n:3",), ("c:7",), ("r:1",)], "node string")
    return scan.incident(star.claims(spark, d), nodes, direction).select("node", "orientation", "claim_id")


_OUT = "select subject_id as node, 'outgoing' as orientation, claim_id from claims where subject_id in ('n:3', 'c:7', 'r:1')"
_IN = "select object_id as node, 'incoming' as orientation, claim_id from claims where object_kind = 'iri' and object_id in ('n:3', 'c:7', 'r:1')"
query("scan_incident_out", _OUT)(lambda s, d: _incident(s, d, "outgoing"))
query("scan_incident_in", _IN)(lambda s, d: _incident(s, d, "incoming"))
query("scan_incident_both", f"{_OUT} union all {_IN} and object_id <> subject_id")(lambda s, d: _incident(s, d, "both"))


@query("scan_lifecycle_by_target", "select target, assertion_id, relation from lifecycle l where target in (select claim_id from claims where subject_id in ('o:1', 'o:2', 'o:3'))")
def scan_lifecycle(spark, d):
    held = star.line_claims(spark, d).where(F.col("subject_id").isin("o:1", "o:2", "o:3")).select(F.col("claim_id").alias("target"))
    return star.lifecycle(spark, d).join(held, "target", "left_semi").select("target", "assertion_id", "relation")


@query("scan_ordered_page", "select claim_id, subject_id from claims where claim_id > 'lp:2' order by claim_id limit 128")
def scan_page(spark, d):
    return scan.page(star.claims(spark, d), "claim_id", "lp:2", 128).select("claim_id", "subject_id")


@query("change_range", "select event_id as seq, 'user:' || user_id as key, event_type as kind from events where event_id > 100 and event_id <= 400", claims=False)
def change_range(spark, d):
    return scan.change_range(star.changes(spark, d), 100, 400).select("seq", "key", "kind")


@query("asof_cutoff", "select relation, count(*) as n from claims where tx <= timestamp '1996-06-30' group by relation")
def asof_cutoff(spark, d):
    return scan.as_of(star.claims(spark, d), "1996-06-30").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- landing

_BLOCKS = [{"from": ["EUROPE", "c:5", "red widget"], "to": ["n:4"]}, {"from": ["small ring"]}]
_ANCHORS = """anchors(block, role, i, anchor) as (values (0, 'from', 0, 'EUROPE'), (0, 'from', 1, 'c:5'), (0, 'from', 2, 'red widget'),
  (0, 'to', 0, 'n:4'), (1, 'from', 0, 'small ring'))"""
_EXACT = f"""{_ANCHORS}, hits as (
  select block, role, id, i from anchors join names on anchor = label union all select block, role, id, i from anchors join names on anchor = id),
landed as (select block, role, id, 1 as score, min(i) as anchor_idx from hits group by block, role, id)"""


@query("landing_exact", f"with {_EXACT} select * from landed")
def landing_exact(spark, d):
    return landing.exact(landing.anchors_frame(spark, _BLOCKS), star.landing(spark, d))


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))"
_OVERLAP = f"""{_ANCHORS}, asked as (select *, {_TOKENS.format("anchor")} as q from anchors),
held as (select distinct id, label, {_TOKENS.format("label")} as t from names),
hits as (
  select block, role, id, i, case when lower(anchor) = lower(label) then 2 * len(q) + 1 else len(list_intersect(q, t)) end as score from asked, held
  union all select block, role, id, i, 2 * len(q) + 1 from asked join held on anchor = id),
landed as (
  select block, role, id, max(score) as score, arg_max(i, score * 100 - i) as anchor_idx from hits where score >= 1 group by block, role, id)"""


@query("landing_token_overlap", f"with {_OVERLAP} select * from landed")
def landing_token_overlap(spark, d):
    return landing.token_overlap(landing.anchors_frame(spark, _BLOCKS), star.landing(spark, d))


@query("seed_topk", f"with {_OVERLAP} select * from (select block, id, score, row_number() over (partition by block order by score desc, id) as seed_rank from landed where role = 'from') where seed_rank <= 2")
def seed_topk(spark, d):
    return landing.seeds(landing.token_overlap(landing.anchors_frame(spark, _BLOCKS), star.landing(spark, d)), 2)


@query("landing_match_counts", f"with {_OVERLAP} select block, role, count(*) as n from landed group by block, role")
def landing_counts(spark, d):
    return landing.token_overlap(landing.anchors_frame(spark, _BLOCKS), star.landing(spark, d)).groupBy("block", "role").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_from_claims", "select distinct i.id, label from (select subject_id as id from claims union select object_id from claims where object_kind = 'iri') i left join names n on i.id = n.id")
def catalog(spark, d):
    return landing.catalog_from_claims(star.claims(spark, d))


@query("latest_image", "select user_id, last.event_id as event_id, last.event_type as event_type from (select user_id, arg_max(struct_pack(event_id := event_id, event_type := event_type, ts := ts), event_id) as last from events group by user_id) where last.ts <= timestamp '2024-01-31 12:00:00'", claims=False)
def latest_image(spark, d):
    return landing.latest_image(star.table(spark, d, "events"), "user_id", "event_id", "ts", "2024-01-31 12:00:00").select("user_id", "event_id", "event_type")


# ---------------------------------------------------------------- predicates on fixed fields

_FIXED = {
    "pred_eq": (("string", "relation", "=", "placed_by"), "relation = 'placed_by'"),
    "pred_ne": (("string", "relation", "!=", "contains"), "relation <> 'contains'"),
    "pred_lt": (("number", "confidence", "<", "0.95"), "pct < 95"),
    "pred_ge": (("timestamp", "transaction_time", ">=", "1998-01-01T00:00:00Z"), "tx >= timestamp '1998-01-01'"),
    "pred_grounding": (("grounding", "grounding", ">", "claim_only"), "grounding > 0"),
    "pred_in": (("string", "object_id", "in", ["r:1", "n:3", "p:10"]), "object_id in ('r:1', 'n:3', 'p:10')"),
    "pred_not_in": (("string", "relation", "not_in", ["contains", "shipped_by", "label"]), "relation not in ('contains', 'shipped_by', 'label')"),
    "pred_contains": (("string", "claim_id", "contains", "-1-"), "contains(claim_id, '-1-')"),
    "pred_exists": (("string", "object_id", "exists", True), "object_id is not null"),
}


def _predicate(kind, column, op, value):
    from decimal import Decimal

    value = Decimal(value) if kind == "number" else value

    def run(spark, d):
        held = star.claims(spark, d).where(test(op, Lane.of(kind, F.col(column)), value))
        return held.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))

    return run


for _name, (_args, _sql) in _FIXED.items():
    query(_name, f"select relation, count(*) as n from claims where {_sql} group by relation")(_predicate(*_args))


@query("pred_ext_number", "select event_type, count(*) as n from events where try_cast(json_extract_string(props, '$.k') as int) >= 50 group by event_type", claims=False)
def pred_ext(spark, d):
    """Open metadata: a number inside a JSON object."""
    rows = star.table(spark, d, "events").withColumn("ext", F.try_parse_json("props"))
    return rows.where(test(">=", Lane.json(F.col("ext"), "k"), 50)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("pred_ext_missing", "select event_type, count(*) as n from events where event_id % 3 = 0 or (event_id % 5 <> 0 and (props is null or json_extract(props, '$.k') is null)) group by event_type", claims=False)
def pred_ext_missing(spark, d):
    """A field is missing in every third event; in every fifth it is there as null, which isn't missing."""
    k = F.col("event_id")
    rows = star.table(spark, d, "events").withColumn("ext", F.try_parse_json(F.when(k % 3 == 0, F.lit('{"other": 1}')).when(k % 5 == 0, F.lit('{"k": null}')).otherwise(F.col("props"))))
    return rows.where(test("exists", Lane.json(F.col("ext"), "k"), False)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- lifecycle and policy

_STATE = """fold as (
  select target, max(case relation when 'retracted_by' then 3 when 'superseded_by' then 2 else 1 end) as p from lifecycle {0} group by target),
stated as (select c.*, case coalesce(p, 0) when 3 then 'retracted' when 2 then 'superseded' when 1 then 'contradicted' else 'active' end as lifecycle_state
  from claims c left join fold on claim_id = target)"""


@query("lifecycle_state", f"with {_STATE.format('')} select relation, lifecycle_state, count(*) as n from stated group by relation, lifecycle_state")
def lifecycle_state(spark, d):
    return temporal.fold(star.claims(spark, d), star.lifecycle(spark, d)).groupBy("relation", "lifecycle_state").agg(F.count(F.lit(1)).alias("n"))


@query("lifecycle_asof", f"with {_STATE.format(chr(119) + 'here tx <= timestamp ' + chr(39) + '1998-01-01' + chr(39))} select relation, lifecycle_state, count(*) as n from stated where tx <= timestamp '1998-01-01' group by relation, lifecycle_state")
def lifecycle_asof(spark, d):
    held = scan.as_of(star.claims(spark, d), "1998-01-01")
    return temporal.fold(held, star.lifecycle(spark, d), "1998-01-01").groupBy("relation", "lifecycle_state").agg(F.count(F.lit(1)).alias("n"))


@query("lifecycle_supports", "select claim_id, assertion_id as supports from claims join lifecycle on claim_id = target where subject_id in ('o:5', 'o:6', 'o:7', 'o:8')")
def lifecycle_supports(spark, d):
    held = star.line_claims(spark, d).where(F.col("subject_id").isin("o:5", "o:6", "o:7", "o:8"))
    got = temporal.fold(held, star.lifecycle(spark, d)).where(F.size("supports") > 0)
    return got.select("claim_id", F.array_join("supports", " ").alias("supports"))


@query(
    "clock_monotonic",
    """with ms as (select user_id, event_id, epoch_ms(ts) // 100000 as wall, row_number() over (partition by user_id order by event_id) as nth from events)
select user_id, event_id, max(wall - nth) over (partition by user_id order by event_id) + nth as allocated from ms""",
    claims=False,
)
def clock(spark, d):
    """SQL's epoch_ms rounds to the nearest millisecond, halves away from zero, and its // cuts towards zero."""
    rows = star.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = rows.select("user_id", "event_id", F.expr("(us div 1000 + us % 1000 div 500) div 100000").alias("wall"))
    return temporal.monotonic(rows, ["event_id"], "wall", ["user_id"]).select("user_id", "event_id", "allocated")


#: (rule_id, target, value, allow, required)
RULES = [
    ("d", "default", None, True, False),
    ("s", "subject", "o:3", False, False),
    ("p", "property", "shipped_by", True, True),
    ("q", "property", "label", False, False),
    ("c", "class", "supplier", False, True),
]


def _requests(spark, d):
    return star.claims(spark, d).select(F.col("subject_id").alias("resource"), F.col("relation").alias("property")).distinct()


def _classes(spark, d):
    return star.claims(spark, d).select(F.col("subject_id").alias("resource")).distinct().where(F.startswith("resource", F.lit("s:"))).withColumn("class", F.lit("supplier"))


_POLICY = """asked as (select distinct subject_id as resource, relation as property from claims),
allowed as (select resource, property, case
  when resource like 's:%' then false when property = 'shipped_by' then true
  when resource = 'o:3' or property = 'label' then false else true end as allowed from asked)"""


@query("policy_allow", f"with {_POLICY} select property, allowed, count(*) as n from allowed group by property, allowed")
def policy_allow(spark, d):
    rules = spark.createDataFrame(RULES, "rule_id string, target string, value string, allow boolean, required boolean")
    got = policy.decide(_requests(spark, d), rules, _classes(spark, d))
    return got.groupBy("property", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "usable_claims",
    f"with {_POLICY} select relation, count(*) as n from claims c join allowed a on a.resource = c.subject_id and a.property = c.relation where a.allowed and (object_kind = 'literal' or object_id not in (select resource from allowed where not allowed and property = 'label' and resource like 'n:%')) group by relation",
)
def usable(spark, d):
    rules = spark.createDataFrame(RULES, "rule_id string, target string, value string, allow boolean, required boolean")
    nation = (F.col("object_kind") == "iri") & F.startswith("object_id", F.lit("n:"))
    needs = [policy.Need("subject_id", of="relation"), policy.Need("object_id", "label", where=nation)]
    held = policy.usable(star.claims(spark, d), policy.Verdicts(rules, _classes(spark, d)), *needs)
    return held.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "visibility_fixpoint",
    """with e as (select event_id as id, event_id - 7 as support, event_type from events),
a as (select id, support from e where event_type <> 'error'),
recursive_ok as (with recursive ok(id) as (select id from a where support < 0 union all select a.id from a join ok on a.support = ok.id) select id from ok)
select count(*) as n, max(id) as top from recursive_ok""",
    claims=False,
)
def visibility(spark, d):
    """Each event requires the one seven before it; those of hidden events go with them."""
    rows = star.table(spark, d, "events").select(F.col("event_id").alias("claim_id"), (F.col("event_id") - 7).alias("support_id"), "event_type")
    held = rows.where("event_type <> 'error'")
    got = policy.visible_fixpoint(held.select("claim_id"), held.where("support_id >= 0").select("claim_id", "support_id"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.max("claim_id").alias("top"))


# ---------------------------------------------------------------- walks


def seeds_at(spark, *ids: str, blocks: int = 1) -> DataFrame:
    return spark.createDataFrame([(b, x, 1, r + 1) for b in range(blocks) for r, x in enumerate(ids)], "block int, id string, score long, seed_rank int")


def _walk(claims, seeds, targets=None, **options):
    opts = walk.Options(**options)
    done = walk.walk(claims, seeds, opts, targets)
    return walk.ranked(walk.filtered(done.paths, opts.filters), opts.path_limit)


def walk_sql(source: str, seeds: list[str] | str, depth: int, direction: str, fanout: int | None, max_claims: int | None, limit: int, cycle: str = "no_repeated_claim", where: str = "true", targets: list[str] | None = None, keep: str = "true", blocks: int = 1) -> str:
    """The walk as one common table expression per depth; seeds: ids in order of rank, or a select of (block, seed, seed_rank)."""
    values = seeds if isinstance(seeds, str) else "values " + ", ".join(f"({b}, '{s}', {r + 1})" for b in range(blocks) for r, s in enumerate(seeds))
    out = [
        f"src as ({source})",
        f"""p0 as (select block, seed, seed_rank, seed as node, cast([] as varchar[]) as ids, [seed] as nodes, cast([] as timestamp[]) as times,
  cast(1 as hugeint) as num, 2 as g, false as reached, 0 as depth, cast([] as int[]) as pcts from ({values}) as s(block, seed, seed_rank))""",
        "known0 as (select cast(null as varchar) as id where false)",
    ]
    for k in range(1, depth + 1):
        parts = []
        if direction in ("outgoing", "both"):
            parts.append(f"select p.*, c.*, case when object_kind = 'iri' then object_id end as nxt from p{k - 1} p join src c on c.subject_id = p.node")
        if direction in ("incoming", "both"):
            loop = " and object_id <> subject_id" if direction == "both" else ""
            parts.append(f"select p.*, c.*, subject_id as nxt from p{k - 1} p join src c on c.object_id = p.node and object_kind = 'iri'{loop}")
        unseen = {"no_repeated_claim": "not list_contains(ids, claim_id)", "allow_repeated_claim": "true", "no_repeated_node": "(nxt is null or not list_contains(nodes, nxt))"}[cycle]
        out.append(f"c{k} as (select * from ({' union all '.join(parts)}) where {unseen} and {where.format(depth=k)})")
        out.append(f"r{k} as (select *, row_number() over (partition by block, seed_rank, ids order by pct desc, tx desc, claim_id) as place from c{k})")
        out.append(f"f{k} as (select * from r{k} where {'true' if fanout is None else f'place <= {fanout}'})")
        if max_claims is None:
            out.append(f"a{k} as (select * from f{k})")
        else:
            out.append(f"o{k} as (select *, row_number() over (order by block, seed_rank, ids, place) as ord from f{k})")
            out.append(f"n{k} as (select claim_id as id, min(ord) as first_ord from o{k} where claim_id not in (select id from known{k - 1}) group by claim_id)")
            out.append(f"known{k} as (select id from known{k - 1} union all select id from (select id, row_number() over (order by first_ord) as rn from n{k}) where rn <= {max_claims} - (select count(*) from known{k - 1}))")
            out.append(f"a{k} as (select * exclude (ord) from o{k} where claim_id in (select id from known{k}))")
        hit = f"coalesce(nxt in ({', '.join(repr(t) for t in targets)}), false)" if targets else "false"
        out.append(
            f"""p{k} as (select block, seed, seed_rank, nxt as node, list_append(ids, claim_id) as ids, case when nxt is null then nodes else list_append(nodes, nxt) end as nodes,
  list_append(times, tx) as times, num * pct as num, least(g, grounding) as g, {hit} as reached, {k} as depth, list_append(pcts, pct) as pcts from a{k})"""
        )
    every = " union all ".join(f"select * from p{k}" for k in range(1, depth + 1))
    if targets:
        every = f"select * from ({every}) where reached"
    out.append(f"every as (select * from ({every}) where {keep})")
    # times rank in descending order element by element, so their negatives rank ascending
    out.append("scored as (select *, row_number() over (order by depth, num desc, g desc, list_transform(times, lambda t: -epoch_us(t)), ids, block, seed) as rank from every)")
    return f"with {', '.join(out)} select rank, block, seed as seed_id, depth, array_to_string(ids, ' ') as claim_ids, array_to_string(nodes, ' ') as node_ids, cast(num as varchar) as numerator, g as grounding, reached from scored where rank <= {limit}"


_ORDERS = [f"o:{i}" for i in range(1, 40)]
_STRUCT = "select * from structure union all select * from placed"
_LINES = "select * from line_claims union all select * from placed"

_WALKS = {
    # name: (claims, seeds, options)
    "walk_outward_d1": ("lines", ["o:1", "o:2"], {"max_depth": 1, "fanout_limit": None, "max_claims": None, "path_limit": 100}),
    "walk_outward_d2": ("orders", _ORDERS, {"max_depth": 2, "fanout_limit": None, "max_claims": None, "path_limit": 200}),
    "walk_incoming": ("orders", ["n:3", "n:4"], {"max_depth": 2, "direction": "incoming", "fanout_limit": None, "max_claims": None, "path_limit": 500}),
    "walk_both": ("lines", ["o:11", "o:12"], {"max_depth": 2, "direction": "both", "fanout_limit": 20, "max_claims": None, "path_limit": 500}),
    "walk_no_repeated_node": ("lines", ["o:11", "o:12"], {"max_depth": 2, "direction": "both", "fanout_limit": 20, "max_claims": None, "path_limit": 500, "cycle": "no_repeated_node"}),
    "walk_allow_repeated_claim": ("lines", ["o:11", "o:12"], {"max_depth": 2, "direction": "both", "fanout_limit": 20, "max_claims": None, "path_limit": 500, "cycle": "allow_repeated_claim"}),
    "walk_fanout": ("lines", _ORDERS, {"max_depth": 2, "direction": "both", "fanout_limit": 3, "max_claims": None, "path_limit": 500}),
    "walk_max_claims": ("lines", _ORDERS, {"max_depth": 3, "direction": "both", "fanout_limit": 3, "max_claims": 150, "path_limit": 500}),
    "walk_multi_block": ("lines", ["o:11"], {"max_depth": 2, "direction": "both", "fanout_limit": 4, "max_claims": 12, "path_limit": 200}),
    "path_rank_topk": ("lines", _ORDERS, {"max_depth": 2, "direction": "both", "fanout_limit": 4, "max_claims": 64, "path_limit": 8}),
}


def _claims_of(kind):
    return {
        "lines": lambda s, d: star.graph(s, d, star.LINES + star.PLACED),
        "orders": lambda s, d: star.graph(s, d, star.STRUCTURE + star.PLACED),
    }[kind]


def _register_walk(name, kind, seeds, options, sql_options=None, targets=None, blocks=1):
    def run(spark, d):
        t = None if targets is None else spark.createDataFrame([(b, x) for b in range(blocks) for x in targets], "block int, id string")
        return walk.summary(_walk(_claims_of(kind)(spark, d), seeds_at(spark, *seeds, blocks=blocks), t, **options))

    o = options
    sql = walk_sql({"lines": _LINES, "orders": _STRUCT}[kind], seeds, o["max_depth"], o.get("direction", "outgoing"), o["fanout_limit"], o["max_claims"], o["path_limit"], o.get("cycle", "no_repeated_claim"), targets=targets, blocks=blocks, **(sql_options or {}))
    query(name, sql)(run)


for _name, (_kind, _seeds, _options) in _WALKS.items():
    _register_walk(_name, _kind, _seeds, _options, blocks=2 if _name == "walk_multi_block" else 1)

_register_walk("walk_connecting", "orders", ["r:3"], {"max_depth": 3, "direction": "incoming", "fanout_limit": None, "max_claims": None, "path_limit": 50}, targets=[f"c:{i}" for i in range(40)] + ["o:7", "o:8", "o:9"])
_register_walk(
    "walk_predicates",
    "lines",
    _ORDERS,
    {"max_depth": 2, "direction": "both", "fanout_limit": 5, "max_claims": None, "path_limit": 300, "predicates": [("meta:confidence", ">=", 1), ("meta:depth", "<=", 2), ("meta:relation", "!=", "placed_by")]},
    {"where": "pct >= 100 and {depth} <= 2 and relation <> 'placed_by'"},
)
_register_walk(
    "filter_existential",
    "lines",
    _ORDERS,
    {"max_depth": 2, "direction": "both", "fanout_limit": 3, "max_claims": None, "path_limit": 300, "filters": [("meta:relation", "=", "contains"), ("meta:confidence", "=", 1)]},
    {"keep": "list_has_any(list_transform(ids, lambda x: x[1:2]), ['lp']) and list_contains(pcts, 100)"},
)
_register_walk(
    "filter_path_list",
    "lines",
    _ORDERS,
    {"max_depth": 2, "direction": "both", "fanout_limit": 3, "max_claims": None, "path_limit": 300, "filters": [("path.meta:relation", "contains_any", ["placed_by", "shipped_by"])]},
    {"keep": "list_has_any(list_transform(ids, lambda x: x[1:2]), ['oc', 'ls'])"},
)


def _finer(claims):
    """Confidences with five decimals, of the claim's own and the lengths of its ids."""
    fine = F.col("confidence") * 100_000 - F.length("claim_id") * 13 - F.length("object_id") * 7
    return claims.withColumn("confidence", (fine.cast("decimal(7,0)") * F.lit("0.00001").cast("decimal(5,5)")).cast("decimal(6,5)"))


@query("path_confidence_exact", walk_sql(f"select * replace (pct * 1000 - length(claim_id) * 13 - length(object_id) * 7 as pct) from ({_LINES})", _ORDERS, 3, "both", 3, None, 500))
def path_confidence(spark, d):
    """Products of three confidences of five decimals, to the last digit, and the order that they give."""
    return walk.summary(_walk(_claims_of("lines")(spark, d).map(_finer), seeds_at(spark, *_ORDERS), max_depth=3, direction="both", fanout_limit=3, max_claims=None, path_limit=500))


@query("claims_returned_distinct", walk_sql(_LINES, _ORDERS, 2, "both", 4, 64, 50).replace("select rank,", "select distinct unnest(ids) as claim_id from (select rank, ids,") + ")")
def returned(spark, d):
    top = _walk(_claims_of("lines")(spark, d), seeds_at(spark, *_ORDERS), max_depth=2, direction="both", fanout_limit=4, max_claims=64, path_limit=50)
    return walk.returned_claims(top).select("claim_id")


# ---------------------------------------------------------------- the flagship


def flagship(spark, sf_dir) -> DataFrame:
    """From region EUROPE, inward to nations and customers, confidence at least 0.9, the best 8 paths."""
    landed = landing.exact(landing.anchors_frame(spark, [{"from": ["EUROPE"]}]), star.landing(spark, sf_dir))
    top = _walk(_claims_of("orders")(spark, sf_dir), landing.seeds(landed), max_depth=2, direction="incoming", predicates=[("meta:confidence", ">=", __import__("decimal").Decimal("0.9"))])
    return walk.summary(top)


query("flagship", walk_sql(_STRUCT, ["r:3"], 2, "incoming", 4, 16, 8, where="pct >= 90"))(flagship)
