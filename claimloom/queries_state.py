"""Queries of programs with state, streams, sources and replay."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from claimloom import storage
from claimloom.operators import replay, walk
from claimloom.plans.compile import compile_query
from claimloom.plans.run import execute
from claimloom.plans.text import parse
from claimloom.queries import _ANCHORS, _OVERLAP, _STRUCT, query, walk_sql
from claimloom.sources import imports, star
from claimloom.streaming.changes import Snapshots


def _orders(spark, d):
    return star.graph(spark, d, star.STRUCTURE + star.PLACED)


# ---------------------------------------------------------------- programs

PROGRAM = {"name": "steps", "init": {"total": 0}, "bind": {"c": "meta:confidence", "d": "meta:depth"}, "let": {"sum": "state.total + c * d"}, "next": {"total": "sum"}, "keep": "sum <= 3"}


@query("custom_state_accumulate", walk_sql(_STRUCT, ["r:3"], 3, "incoming", 4, 64, 100, where="{depth} * ({depth} + 1) / 2 <= 3"))
def custom_state(spark, d):
    """A program that sums confidence times depth along each path; all confidences here are one."""
    plan = compile_query(
        {"about": [{"from": ["r:3"], "match": "exact"}], "bounds": {"max_depth": 3, "max_claims": 64, "path_limit": 100}, "walk": {"direction": "incoming", "predicates": [PROGRAM]}},
        capabilities=frozenset({"programs"}),
    )
    return walk.summary(execute(plan, _orders(spark, d), star.landing(spark, d)).paths)


TEXT = """QUERY
CONTEXT
  n = "n:"
ABOUT
  FROM "EUROPE" MATCH exact
BOUNDS
  max_depth = 2
  floor = 0.9
WALK incoming
  PREDICATE sure
    WHERE
      meta:confidence >= bound:floor
RETURN
  claims
  paths
"""


@query("query_text", walk_sql(_STRUCT, ["r:3"], 2, "incoming", 4, 16, 8, where="pct >= 90"))
def query_text(spark, d):
    """The flagship query, written as text: parsed, compiled and run."""
    plan = compile_query(parse(TEXT))
    return walk.summary(execute(plan, _orders(spark, d), star.landing(spark, d)).paths)


_NEAR = _OVERLAP.replace(_ANCHORS, "anchors(block, role, i, anchor) as (values (0, 'from', 0, 'nation 7'))")


@query(
    "query_approximate",
    f"with {_NEAR}, near as (select block, id, row_number() over (partition by block order by score desc, id) as seed_rank from landed), "
    + walk_sql(_STRUCT, "select block, id, seed_rank from near where seed_rank <= 2", 2, "incoming", 4, 16, 8).removeprefix("with "),
)
def query_approximate(spark, d):
    """Token-overlap landing, two hops."""
    plan = compile_query({"about": [{"from": ["nation 7"], "match": "approximate"}], "bounds": {"max_depth": 2}, "walk": {"direction": "incoming"}}, capabilities=frozenset({"lexical"}))
    return walk.summary(execute(plan, _orders(spark, d), star.landing(spark, d)).paths)


@query("replay_verdict", walk_sql(_STRUCT, ["r:3"], 2, "incoming", 4, 16, 8, where="pct >= 90").replace("select rank,", "select 'reproduced' as verdict, rank,"))
def replay_verdict(spark, d):
    """The verdict of a replay, beside the paths that were recorded."""
    plan = compile_query(parse(TEXT))
    claims, names = _orders(spark, d), star.landing(spark, d)
    held = replay.record(plan, claims, names, "snapshot-1")
    paths = walk.summary(execute(plan, claims, names).paths)
    return paths.withColumn("verdict", F.lit(replay.replay(held, claims, names, "snapshot-1")))


# ---------------------------------------------------------------- streams


def _log(spark, d):
    events = star.table(spark, d, "events")
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("event_type").alias("payload"))


_LAST = "select 'user:' || user_id as key, max(event_id) as seq, arg_max(event_type, event_id) as payload from events {0} group by user_id"


@query("stream_apply", f"select * from ({_LAST.format('')}) where payload <> 'error'", claims=False)
def stream_apply(spark, d):
    """The change log, applied by a stream in two parts and a repeat of the first."""
    base = storage.scratch(spark, "stream")
    log = _log(spark, d)
    snapshots = Snapshots(spark, base + "/snapshots")
    half = log.agg(F.max("seq")).first()[0] // 2
    log.where(F.col("seq") <= half).coalesce(1).write.parquet(base + "/log/part=0")
    source = lambda: spark.readStream.schema(log.schema).parquet(base + "/log/part=*")
    snapshots.follow(source(), base + "/checkpoint").awaitTermination()
    log.where(F.col("seq") > half).coalesce(1).write.parquet(base + "/log/part=1")
    snapshots.follow(source(), base + "/checkpoint").awaitTermination()
    snapshots.apply(log.where(F.col("seq") <= half))  # a retry changes nothing
    return snapshots.read()


@query("snapshot_pinned", f"with e as (select * from events where event_id <= 300) select * from ({_LAST.format('').replace('from events', 'from e')}) where payload <> 'error'", claims=False)
def snapshot_pinned(spark, d):
    """An older generation, read by its exact number after a later one was applied."""
    base = storage.scratch(spark, "pins")
    snapshots, log = Snapshots(spark, base), _log(spark, d)
    pin = snapshots.apply(log.where("seq <= 300"))
    snapshots.apply(log.where("seq > 300"))
    return snapshots.read(pin)


# ---------------------------------------------------------------- sources


@query(
    "import_structured",
    """with c as (select o_orderkey, o_custkey, o_orderdate, o_totalprice from orders)
select 'order:' || o_orderkey as subject_id, 'placed_by' as relation, 'customer:' || o_custkey as object_id, 'accepted' as status from c
union all select 'order:' || o_orderkey, 'total', cast(cast(o_totalprice as decimal(18,2)) as varchar), case when o_totalprice > 400000 then 'literal out of range' else 'accepted' end from c""",
    claims=False,
)
def import_structured(spark, d):
    """Orders as structured claims, checked row by row."""
    o = star.table(spark, d, "orders")
    subject = F.concat(F.lit("order:"), "o_orderkey")
    links = o.select(subject.alias("subject_id"), F.lit("placed_by").alias("relation"), F.lit("iri").alias("object_kind"), F.concat(F.lit("customer:"), "o_custkey").alias("object_id"), F.lit(None).cast("string").alias("datatype"))
    totals = o.select(subject.alias("subject_id"), F.lit("total").alias("relation"), F.lit("literal").alias("object_kind"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("object_id"), F.lit("xsd:decimal").alias("datatype"))
    got = imports.validate(links.unionByName(totals), {"placed_by": ("iri", None), "total": ("literal", Decimal(400000))})
    return got.select("subject_id", "relation", "object_id", "status")


@query(
    "claim_ids_deterministic",
    """with k as (select l_orderkey || '|' || l_partkey || '|' || l_suppkey as k from lineitem)
select k as subject_id, 'claim:' || sha256('8:import-1' || length(k) || ':' || k || '4:line3:iri1:x-') as id from k""",
    claims=False,
)
def claim_ids(spark, d):
    """The id of each claim of an import, by its content."""
    lines = star.table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey").alias("subject_id"), F.lit("line").alias("relation"), F.lit("iri").alias("object_kind"), F.lit("x").alias("object_id"), F.lit(None).cast("string").alias("datatype"))
    return lines.select("subject_id", imports.claim_id("import-1").alias("id"))


@query("admission_idempotent", "select 'oc:' || o_orderkey as claim_id, 'c:' || o_custkey as object_id, 1 as seq from orders", claims=False)
def admission(spark, d):
    """A batch admitted twice under one key counts once."""
    store = imports.Store(spark, storage.scratch(spark, "admit"))
    batch = star.order_claims(spark, d)
    first = store.admit(batch, "batch-1", 1_000)
    again = store.admit(batch, "batch-1", 2_000)
    assert first == again
    return store.read().select("claim_id", "object_id", "seq")


@query("recover_times", "with t as (select user_id, event_id, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id order by ts, event_id) as nth from events) select user_id, event_id, max(ms - nth) over (partition by user_id order by nth) + nth as at from t", claims=False)
def recover_times(spark, d):
    """Admission times from a commit history: truncated to milliseconds, then made to rise."""
    from claimloom.operators import temporal

    rows = star.table(spark, d, "events").select("user_id", "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return temporal.monotonic(rows, ["ts", "event_id"], "ms", ["user_id"], "at").select("user_id", "event_id", "at")
