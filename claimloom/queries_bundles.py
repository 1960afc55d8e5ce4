"""Queries of bundle checks and identities, with orders as bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import bundles, ontology, walk
from claimloom.queries import _walk, query, seeds_at
from claimloom.sources import star


def _bundles(spark, d):
    """Orders of one remainder as a bundle: order -> part and order -> supplier claims."""
    two = F.array(*[F.struct(F.lit(p).alias("predicate"), F.concat(F.lit(to), col).alias("object")) for p, col, to in (("contains", "l_partkey", "p:"), ("shipped_by", "l_suppkey", "s:"))])
    lines = star.keyed_lineitem(spark, d).select(F.pmod("l_orderkey", F.lit(700)).alias("bundle"), "k", F.concat(F.lit("o:"), "l_orderkey").alias("subject"), F.inline(two))
    local = F.concat(F.substring("predicate", 1, 1), F.lit(":"), "k")
    return lines.select("bundle", local.alias("local_id"), "subject", "predicate", F.lit("iri").alias("object_kind"), "object", F.lit(None).cast("string").alias("datatype"))


@query("bundle_disconnected")
def disconnected(spark, d):
    """Over all orders; recursive SQL is too slow for that, so tests hold it against brute force."""
    return bundles.disconnected(_bundles(spark, d))


@query(
    "bundle_type_violations",
    """select l_orderkey % 700 as bundle, 's:' || k as local_id, 'range' as reason from lines where l_suppkey % 3 = 0""",
)
def violations(spark, d):
    """Suppliers of every third key are typed as parts, and so are outside the range."""
    claims = _bundles(spark, d)
    ends = claims.select("bundle", F.col("subject").alias("entity")).unionByName(claims.select("bundle", F.col("object").alias("entity"))).distinct()
    key = F.split_part("entity", F.lit(":"), F.lit(2)).cast("long")
    kind = F.when(F.startswith("entity", F.lit("o:")), "order").when(F.startswith("entity", F.lit("p:")) | (key % 3 == 0), "part").otherwise("supplier")
    closed = ontology.closure(spark.createDataFrame([("order", "thing"), ("part", "thing"), ("supplier", "party")], "a string, b string"), "a", "b")
    domains = spark.createDataFrame([("contains", "thing"), ("shipped_by", "order")], "property string, class string")
    ranges = spark.createDataFrame([("contains", "part"), ("shipped_by", "party")], "property string, class string")
    return bundles.type_violations(claims, ends.withColumn("class", kind), domains, ranges, closed)


@query(
    "temporal_support",
    """with e as (select event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as t from events)
select user_id as bundle, 'c' || event_id as local_id, case when event_id % 5 = 0 then 'mismatch' when event_id % 7 = 0 then 'unknown qualifier' when event_id % 11 = 0 then 'no support' else 'supports itself' end as reason
from e where event_id % 5 = 0 or event_id % 7 = 0 or event_id % 11 = 0 or event_id % 13 = 0""",
    claims=False,
)
def temporal_support(spark, d):
    e = star.table(spark, d, "events").select("event_id", F.col("user_id").alias("bundle"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    k = F.col("event_id")
    me, its = F.concat(F.lit("c"), k), F.concat(F.lit("q"), k)
    qualifier = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("none")).when(k % 11 == 0, its).when(k % 13 == 0, me).otherwise(its)
    own = e.select("bundle", me.alias("local_id"), F.lit("s").alias("subject"), F.lit("x").alias("object"), F.lit("xsd:string").alias("datatype"), F.col("t").alias("valid_time"), qualifier.cast("string").alias("qualifier"))
    quals = e.select("bundle", its.alias("local_id"), F.when(k % 11 == 0, "other").otherwise("s").alias("subject"), F.col("t").alias("object"), F.lit("xsd:dateTime").alias("datatype"), F.lit(None).cast("string").alias("valid_time"), F.lit(None).cast("string").alias("qualifier"))
    return bundles.unsupported_times(own.unionByName(quals))


@query("change_contiguous", "select count(*) = 300 as ok from events where event_id > 100 and event_id <= 400", claims=False)
def contiguous(spark, d):
    ok = bundles.contiguous(star.changes(spark, d).select("seq"), 100, 400)
    return spark.createDataFrame([(ok,)], "ok boolean")


@query(
    "classify_endpoints",
    """select 'c:' || c_custkey as entity, case when c_custkey % 4 = 1 then '' when c_custkey % 4 = 2 then 'customer|' || c_mktsegment else 'customer' end as classes,
  case when c_custkey % 9 = 0 then 'provisional' when c_custkey % 4 = 1 then 'unclassified' else 'classified' end as state from customer""",
    claims=False,
)
def classify(spark, d):
    c = star.table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("c:"), "c_custkey").alias("entity"))
    k = F.col("c_custkey")
    first = c.where(k % 4 != 1).select("entity", F.lit("customer").alias("class"))
    second = c.where(k % 4 == 2).select("entity", F.col("c_mktsegment").alias("class"))
    got = bundles.classifications(c.select("entity", (k % 9 == 0).alias("provisional")), first, second)
    # classes stand in order of code points, and upper case comes first
    return got.select("entity", F.when(F.contains("classes", F.lit("|")), F.concat_ws("|", F.element_at(F.split("classes", r"\|"), 2), F.element_at(F.split("classes", r"\|"), 1))).otherwise(F.col("classes")).alias("classes"), "state")


@query("path_contains_subproperty", "with w as (select s.claim_id from structure s where relation = 'in_nation' and object_id = 'n:3') select count(*) as n from w")
def path_contains(spark, d):
    """Paths from a nation of which some step's relation is below ``located``."""
    top = _walk(star.structure_claims(spark, d), seeds_at(spark, "n:3"), max_depth=1, direction="incoming", fanout_limit=None, max_claims=None, path_limit=None)
    closed = ontology.closure(spark.createDataFrame([("in_nation", "located"), ("in_region", "located")], "a string, b string"), "a", "b")
    return bundles.path_entails(top, "relation", closed, "located").agg(F.count(F.lit(1)).alias("n"))


@query(
    "explain_counters",
    """with m as (select object_id as c, tx from placed where object_id in ('c:1', 'c:2', 'c:3')), e as (select c, count(*) as n from m where tx >= timestamp '1996-01-01' group by c)
select (select count(*) from m) as examined, (select coalesce(sum(n), 0) from e) as eligible, (select coalesce(sum(least(n, 2)), 0) from e) as traversed""",
)
def counters(spark, d):
    """Orders of three customers: all are examined, later ones eligible, two of each customer walked."""
    o = walk.Options(1, "incoming", 2, None, None, predicates=[("meta:transaction_time", ">=", "1996-01-01T00:00:00Z")], explain=True)
    done = walk.walk(star.graph(spark, d, star.PLACED), seeds_at(spark, "c:1", "c:2", "c:3"), o)
    return spark.createDataFrame([tuple(done.counters[c] for c in ("examined", "eligible", "traversed"))], "examined long, eligible long, traversed long")
