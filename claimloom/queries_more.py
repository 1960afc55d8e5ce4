"""Queries of inventories, ontology, documents and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import lexical
from claimloom.operators import documents, inventory, ontology, vocabulary
from claimloom.queries import query
from claimloom.sources import star

# ---------------------------------------------------------------- inventories


def _typed(spark, d):
    """Customers and suppliers, typed by their nation."""
    held = star.structure_claims(spark, d).where("relation = 'in_nation'")
    return held.select("subject_id", F.concat(F.lit("class:"), "object_id").alias("class"))


@query("class_inventory", "select 'class:' || object_id as class, count(distinct subject_id) as entities from structure where relation = 'in_nation' group by object_id")
def class_inventory(spark, d):
    return inventory.classes(_typed(spark, d))


_ENTITIES = """e as (
  select subject_id, coalesce(array_to_string(list_sort(list(distinct object_id) filter (where relation = 'label')), '|'), '') as names,
    coalesce(array_to_string(list_sort(list(distinct relation) filter (where object_kind = 'iri')), '|'), '') as relations,
    count(*) filter (where object_kind = 'iri') as n_links
  from claims group by subject_id)"""


@query("entity_inventory", f"with {_ENTITIES} select relations, count(*) as n, sum(n_links) as links from e group by relations")
def entity_inventory(spark, d):
    return inventory.entities(star.claims(spark, d)).groupBy("relations").agg(F.count(F.lit(1)).alias("n"), F.sum("n_links").alias("links"))


@query("inventory_page", f"with {_ENTITIES} select * from e order by subject_id limit 25 offset 50")
def inventory_page(spark, d):
    return inventory.entities_page(star.claims(spark, d), 50, 25)


@query("neighbour_literals", "select a.claim_id, a.object_id, b.relation as relation2, b.object_id as literal from structure a join labels_c b on a.object_id = b.subject_id")
def neighbour_literals(spark, d):
    return inventory.neighbour_literals(star.structure_claims(spark, d).unionByName(star.label_claims(spark, d)))


def _triples(spark, d):
    return star.claims(spark, d).select(F.col("subject_id").alias("s"), F.col("relation").alias("p"), F.col("object_id").alias("o"), (F.col("object_kind") == "literal").alias("lit"))


@query("mapped_stored", "select o as subject_id, list_sort(list(distinct c.object_id))[1] as first_value, count(distinct c.object_id) as n_values from (select 'o:' || o_orderkey as o from orders) left join line_claims c on c.subject_id = o and relation = 'contains' group by o having count(c.object_id) > 0")
def mapped_stored(spark, d):
    """Stored values (sorted) and computed counts of one predicate."""
    orders = star.order_claims(spark, d).select("subject_id").distinct()
    got = inventory.mapped(orders, _triples(spark, d), "contains").where("values is not null")
    return got.select("subject_id", F.element_at("values", 1).alias("first_value"), "n_values")


@query(
    "latency_report",
    "select event_type, count(*) as n, list_sort(list(value))[1 + (count(*) - 1) * 50 // 100] as p50, list_sort(list(value))[1 + (count(*) - 1) * 95 // 100] as p95, max(value) as most from events where value is not null group by event_type",
    claims=False,
)
def latency(spark, d):
    return inventory.latency_report(star.table(spark, d, "events"), "event_type", "value")


# ---------------------------------------------------------------- ontology


def _classes(spark, d):
    """Nation classes below region classes, those below class:place."""
    up = star.structure_claims(spark, d).where("relation = 'in_region'").select(F.concat(F.lit("class:"), "subject_id").alias("child"), F.concat(F.lit("class:"), "object_id").alias("parent"))
    return up.unionByName(up.select(F.col("parent").alias("child"), F.lit("class:place").alias("parent"))).distinct()


_UP = """up as (
  select 'class:' || subject_id as child, 'class:' || object_id as parent from structure where relation = 'in_region'
  union select 'class:' || object_id, 'class:place' from structure where relation = 'in_region'),
closed as (
  with recursive c(term, ancestor) as (
    select child, child from up union select parent, parent from up union select term, parent from c join up on ancestor = child)
  select * from c)"""


@query("subclass_closure", f"with {_UP} select term, ancestor from closed")
def subclass_closure(spark, d):
    return ontology.closure(_classes(spark, d), "child", "parent")


@query("pred_isa", f"with {_UP} select subject_id from structure where relation = 'in_nation' and 'class:' || object_id in (select term from closed where ancestor = 'class:r:2')")
def pred_isa(spark, d):
    closed = ontology.closure(_classes(spark, d), "child", "parent")
    return ontology.entailed(_typed(spark, d), "class", closed, ["class:r:2"]).select("subject_id")


@query("pred_not_isa", f"with {_UP} select subject_id from structure where relation = 'in_nation' and 'class:' || object_id not in (select term from closed where ancestor = 'class:r:2')")
def pred_not_isa(spark, d):
    closed = ontology.closure(_classes(spark, d), "child", "parent")
    return ontology.not_entailed(_typed(spark, d), "class", closed, ["class:r:2"]).select("subject_id")


@query("hierarchy_facts", f"with {_UP} select ancestor as class, count(distinct subject_id) as n from structure join closed on term = 'class:' || object_id where relation = 'in_nation' group by ancestor")
def hierarchy_facts(spark, d):
    types = _typed(spark, d).select(F.col("subject_id").alias("s"), F.lit(ontology.TYPE).alias("p"), F.col("class").alias("o"), F.lit(False).alias("lit"))
    closed = ontology.closure(_classes(spark, d), "child", "parent")
    got = ontology.hierarchy_facts(types, closed, closed.where(F.lit(False)))
    return got.groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("n"))


@query("domain_range_inherit", f"with {_UP}, c(property, value) as (values ('class:r:1', 'x'), ('class:place', 'y')) select distinct term, value from closed join c on ancestor = property")
def domain_range(spark, d):
    limits = spark.createDataFrame([("class:r:1", "x"), ("class:place", "y")], "property string, value string")
    return ontology.inherited(limits, ontology.closure(_classes(spark, d), "child", "parent"))


def _rule(name, schema_rows, sql, relation="in_nation"):
    def run(spark, d):
        schema = spark.createDataFrame([(*r, False) for r in schema_rows], "s string, p string, o string, lit boolean")
        data = _triples(spark, d).where(F.col("p").isin(relation.split(",")))
        new = ontology.RULES[name](data.unionByName(schema)).distinct()
        return new.where(~F.startswith("s", F.lit("in_"))).select("s", "p", "o")

    query(f"rule_{name}", sql)(run)


_IN = "from structure where relation = 'in_nation'"
_rule("symmetric", [("in_nation", ontology.TYPE, "owl:SymmetricProperty")], f"select distinct object_id as s, relation as p, subject_id as o {_IN}")
_rule("inverse", [("in_nation", "owl:inverseOf", "has_member")], f"select distinct object_id as s, 'has_member' as p, subject_id as o {_IN}")
_rule("domain", [("in_nation", "rdfs:domain", "class:party")], f"select distinct subject_id as s, 'rdf:type' as p, 'class:party' as o {_IN}")
_rule("range", [("in_nation", "rdfs:range", "class:nation")], f"select distinct object_id as s, 'rdf:type' as p, 'class:nation' as o {_IN}")
_rule("subproperty", [("in_nation", "rdfs:subPropertyOf", "located_in")], f"select distinct subject_id as s, 'located_in' as p, object_id as o {_IN}")
_rule("chain", [("located", "owl:chain1", "in_nation"), ("located", "owl:chain2", "in_region")], "select distinct a.subject_id as s, 'located' as p, b.object_id as o from structure a join structure b on a.object_id = b.subject_id where a.relation = 'in_nation' and b.relation = 'in_region'", "in_nation,in_region")
_rule("has_value_type", [("class:home", "owl:hasValue", "n:3"), ("class:home", "owl:onProperty", "in_nation")], f"select distinct subject_id as s, 'rdf:type' as p, 'class:home' as o {_IN} and object_id = 'n:3'")
_rule("inverse_functional", [("in_region", ontology.TYPE, "owl:InverseFunctionalProperty")], "select distinct m as s, 'owl:sameAs' as p, subject_id as o from (select subject_id, min(subject_id) over (partition by object_id) as m from structure where relation = 'in_region') where m <> subject_id", "in_region")


@query(
    "materialise_fixpoint",
    """with within as (
  with recursive w(s, o) as (select subject_id, object_id from structure union select w.s, b.object_id from w join structure b on w.o = b.subject_id) select * from w),
schema(s, p, o) as (values ('in_region', 'rdfs:subPropertyOf', 'within'), ('within', 'rdf:type', 'owl:TransitiveProperty'), ('in_nation', 'rdfs:subPropertyOf', 'within'), ('within', 'rdfs:range', 'class:place'))
select s, p, o, false as lit from (select subject_id as s, relation as p, object_id as o from structure union select s, 'within', o from within union select o, 'rdf:type', 'class:place' from within union select s, p, o from schema)""",
)
def materialise(spark, d):
    """Several rules to a fixed point over customers, suppliers, nations and regions."""
    schema = [("in_region", "rdfs:subPropertyOf", "within"), ("within", ontology.TYPE, "owl:TransitiveProperty"), ("in_nation", "rdfs:subPropertyOf", "within"), ("within", "rdfs:range", "class:place")]
    data = _triples(spark, d).where(F.col("p").isin("in_nation", "in_region")).unionByName(spark.createDataFrame([(*r, False) for r in schema], "s string, p string, o string, lit boolean"))
    return ontology.materialise(data, ["subproperty", "transitive", "range", "subclass"])


# ---------------------------------------------------------------- documents


@query(
    "line_coordinates",
    """with p as (select doc_id, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, unnest(range(1, len(ls) + 1)) as line, ls from p),
b as (select doc_id, line, ls[line] as content, strlen(ls[line]) + case when line < len(ls) then 1 else 0 end as n from l),
s as (select doc_id, line, content, n, coalesce(sum(n) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) as start from b)
select doc_id, line, cast(start as bigint) as start, cast(start + n as bigint) as "end", 'sha256:' || sha256(content) as content_hash from s where n > 0""",
    claims=False,
)
def line_coordinates(spark, d):
    return documents.lines(star.table(spark, d, "documents"))


def _quotes(spark, d):
    """Each document's first three words, and a benchmark passage looked for in every hundredth document."""
    docs = star.table(spark, d, "documents")
    own = docs.select("doc_id", F.regexp_extract("text", r"^(\S+ \S+ \S+)", 1).alias("quote")).where("quote <> ''")
    return own.withColumn("occurrence", F.lit(0))


@query(
    "quote_resolve",
    r"""with q as (select doc_id, regexp_extract(text, '^(\S+ \S+ \S+)', 1) as quote, text from documents)
select doc_id, quote, cast(0 as bigint) as start, strlen(quote) as "end", 1 as line_start, 'resolved' as status, 'sha256:' || sha256(quote) as content_hash from q where quote <> ''""",
    claims=False,
)
def quote_resolve(spark, d):
    got = documents.resolve_quotes(_quotes(spark, d), star.table(spark, d, "documents"))
    return got.select("doc_id", "quote", "start", "end", "line_start", "status", "content_hash")


@query(
    "quote_unique",
    r"""with q as (select doc_id, regexp_extract(text, '^(\S+ \S+ \S+)', 1) as quote, text from documents)
select doc_id, (length(text) - length(replace(text, quote, ''))) // length(quote) as n from q where quote <> ''""",
    claims=False,
)
def quote_unique(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", "text")
    return _quotes(spark, d).join(docs, "doc_id").select("doc_id", documents.occurrences(F.col("text"), F.col("quote")).alias("n"))


@query(
    "evidence_verify",
    """select doc_id, case when doc_id % 5 = 0 then 'changed' when doc_id % 7 = 0 then 'unverifiable' when doc_id % 11 = 0 then 'changed' else 'verified' end as verdict
from documents where text[1:1] >= ' ' and text[1:1] < chr(127) and length(text) > 1""",
    claims=False,
)
def evidence_verify(spark, d):
    """Spans of first characters, some with another version, none, or another quote."""
    docs = star.table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    ascii_first = (F.substring("text", 1, 1) >= " ") & (F.substring("text", 1, 1) < "\x7f")
    evidence = docs.where((F.length("text") > 1) & ascii_first).select(
        "doc_id",
        F.when(k % 5 == 0, F.lit("sha256:0")).otherwise(lexical.sha256(F.col("text"))).alias("version_hash"),
        F.lit(0).alias("start"),
        F.when((k % 7 == 0), F.lit(10_000_000)).otherwise(F.lit(1)).alias("end"),
        F.when(k % 11 == 0, F.lit("\x01")).otherwise(F.substring("text", 1, 1)).alias("quote"),
        F.lit(None).cast("string").alias("content_hash"),
    )
    return documents.verify_evidence(evidence, docs).select("doc_id", "verdict")


@query("known_mentions", "select d.doc_id, b.item_id as entity, strlen(b.text) as n_bytes from documents d join benchmark b on contains(d.text, b.text)", claims=False)
def known_mentions(spark, d):
    aliases = star.table(spark, d, "benchmark").select(F.col("item_id").alias("entity"), F.col("text").alias("alias"))
    got = documents.mentions(star.table(spark, d, "documents"), aliases)
    return got.select("doc_id", "entity", (F.col("end") - F.col("start")).alias("n_bytes")).distinct()


@query("windows_plain")
def windows_plain(spark, d):
    """Windows of all documents as plain text (rows only; tests compare pages and spans)."""
    return documents.windows(star.table(spark, d, "documents")).select("doc_id", "ordinal", "start", "end", "block_kind")


@query("ngram_rank", r"""with w as (select list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda t: t <> '') as w from part)
select array_to_string(w, ' ') as ngram, count(*) as n from w where len(w) = 2 group by 1 order by n desc, ngram limit 10""", claims=False)
def ngram_rank(spark, d):
    return inventory.ngram_ranking(star.table(spark, d, "part"), "p_name", (2,), 10)


# ---------------------------------------------------------------- vocabulary and gazetteer


def _terms(spark, d):
    part = star.table(spark, d, "part")
    return part.select(F.concat(F.lit("v:"), "p_partkey").alias("iri"), F.lit("class").alias("kind"), F.col("p_name").alias("label"), F.array("p_brand").alias("synonyms"), F.col("p_type").alias("definition"), F.lit("canonical").alias("status"))


@query("vocab_search", "select 'v:' || p_partkey as iri, p_name as label from part where contains(lower('v:' || p_partkey), 'red w') or contains(lower(p_name), 'red w') or contains(lower(p_brand), 'red w') order by 1 limit 20", claims=False)
def vocab_search(spark, d):
    return vocabulary.search(_terms(spark, d), "Red W").select("iri", "label")


@query(
    "vocab_resolve_exact",
    """with n as (select distinct 'v:' || p_partkey as iri, t as text from part, unnest([p_name, p_brand, 'v:' || p_partkey]) as u(t)),
a(text) as (values ('red widget'), ('v:17'), ('nothing'))
select a.text, case count(iri) when 0 then 'not_found' when 1 then 'unique' else 'ambiguous' end as status, case count(iri) when 1 then min(iri) end as iri from a left join n on a.text = n.text group by a.text""",
    claims=False,
)
def vocab_resolve(spark, d):
    return vocabulary.resolve_exact(_terms(spark, d), spark.createDataFrame([("red widget",), ("v:17",), ("nothing",)], "text string"))


@query(
    "vocab_match_rank",
    """with k as (select 'v:' || p_partkey as iri, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as l, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as s,
  regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as d, cast(p_partkey as varchar) as i from part),
r as (select iri, least(
  case when i = 'ring' then 0 when starts_with(i, 'ring') then 1 when contains(i, 'ring') then 2 end,
  case when l = 'ring' then 3 when starts_with(l, 'ring') then 4 when contains(l, 'ring') then 5 end,
  case when s = 'ring' then 6 when starts_with(s, 'ring') then 7 when contains(s, 'ring') then 8 end,
  case when d = 'ring' then 9 when starts_with(d, 'ring') then 10 when contains(d, 'ring') then 11 end) as rank from k)
select iri, rank from r where rank is not null""",
    claims=False,
)
def vocab_rank(spark, d):
    terms = _terms(spark, d)
    rank = vocabulary.match_rank(F.lit("Ring"), F.col("iri"), F.col("label"), F.col("synonyms"), F.col("definition"))
    return terms.select("iri", rank.alias("rank")).where("rank is not null")


def _gazetteer(spark, d):
    c = star.table(spark, d, "customer")
    return c.select(F.concat(F.lit("c:"), "c_custkey").alias("iri"), F.array("c_name").alias("labels"), F.array(F.struct(F.lit("segment").alias("scheme"), F.col("c_mktsegment").alias("value"))).alias("identifiers"))


@query("gazetteer_search", "select 'c:' || c_custkey as iri from customer where contains(lower(c_name), '00012') or contains(lower(c_mktsegment), '00012') or contains('c:' || c_custkey, '00012') order by 1 limit 128", claims=False)
def gazetteer_search(spark, d):
    return vocabulary.gazetteer_search(_gazetteer(spark, d), "00012").select("iri")


@query(
    "resolve_known_iri",
    """with ids as (select 'o:' || o_orderkey as iri, 'customer' as scheme, cast(o_custkey as varchar) as value from orders
  union all select 'o:' || o_orderkey, 'status', o_orderstatus from orders union all select 'o:' || o_orderkey, 'key', cast(o_orderkey as varchar) from orders),
r(request, iri, scheme, value) as (values ('a', 'o:7', 'key', '7'), ('b', 'o:8', 'key', '9'), ('c', null, 'status', 'F'), ('d', 'o:3', null, null), ('e', null, 'key', '-1'), ('f', null, 'key', '20')),
m as (select request, i.iri as found from r join ids i on r.scheme = i.scheme and r.value = i.value),
n as (select request, count(distinct found) as hits, min(found) as found from m group by request)
select r.request, case when value is null then 'identifier_required' when hits is null then 'not_found' when hits > 1 then 'ambiguous'
  when r.iri is not null and r.iri <> found then 'mismatch' when found not in ('o:7', 'o:8', 'o:9') then 'not_approved' else 'resolved' end as status
from r left join n on r.request = n.request""",
    claims=False,
)
def resolve_known(spark, d):
    o = star.table(spark, d, "orders")
    iri = F.concat(F.lit("o:"), "o_orderkey")
    pairs = F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(c).cast("string").alias("value")) for s, c in (("customer", "o_custkey"), ("status", "o_orderstatus"), ("key", "o_orderkey"))])
    ids = o.select(iri.alias("iri"), F.explode(pairs).alias("x")).select("iri", "x.*")
    rows = [("a", "o:7", "key", "7"), ("b", "o:8", "key", "9"), ("c", None, "status", "F"), ("d", "o:3", None, None), ("e", None, "key", "-1"), ("f", None, "key", "20")]
    approved = spark.createDataFrame([("o:7",), ("o:8",), ("o:9",)], "iri string")
    return vocabulary.resolve_known(spark.createDataFrame(rows, "request string, iri string, scheme string, value string"), ids, approved).select("request", "status")


@query("unique_mapping", "select source, target from (select l_orderkey as source, min(l_returnflag) as target, count(distinct l_returnflag) as n from lineitem group by l_orderkey) where n = 1", claims=False)
def unique_mapping(spark, d):
    """Orders all of whose lines have one return flag."""
    return vocabulary.unique_mapping(star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_returnflag").alias("target")))
