"""Vocabulary search and entity lookup.

terms: (iri, kind, label, synonyms array, definition, status).
gazetteer: (iri, class, labels array, identifiers array of (scheme, value)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import lexical

KINDS = ("class", "property", "individual")


def search(terms: DataFrame, text: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Terms whose label, synonym or iri holds the text, case aside, in iri order."""
    if not 1 <= limit <= 20:
        raise ValueError("a search gives 1 to 20 terms")
    q = text.lower()
    hit = F.contains(F.lower("iri"), F.lit(q)) | F.contains(F.lower("label"), F.lit(q)) | F.exists("synonyms", lambda s: F.contains(F.lower(s), F.lit(q)))
    rows = terms.where(F.coalesce(hit, F.lit(False)))
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("iri").limit(limit)


def resolve_exact(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (text) with status unique, ambiguous or not_found, and the term's iri if unique."""
    names = terms.select("iri", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("iri", "label"), F.coalesce("synonyms", F.array().cast("array<string>")))))).alias("text")).distinct()
    got = names.join(asked.select("text").distinct(), "text").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("iri").alias("one"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "not_found").when(n == 1, "unique").otherwise("ambiguous")
    return asked.select("text").distinct().join(got, "text", "left").select("text", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("iri"))


def describe(terms: DataFrame, iri: str) -> DataFrame:
    return terms.where(F.col("iri") == iri)


def match_rank(query: Column, iri: Column, label: Column, synonyms: Column, definition: Column) -> Column:
    """0 to 11, less being nearer, or null: equal, prefix and part of iri, label, synonym and definition, by ASCII keys."""
    q = lexical.search_key(query)

    def near(text: Column, base: int) -> Column:
        key = lexical.search_key(text)
        return F.when((q == "") | key.isNull(), F.lit(None).cast("int")).when(key == q, base).when(F.startswith(key, q), base + 1).when(F.contains(key, q), base + 2)

    best = F.array_min(F.array_compact(F.transform(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: near(s, 6))))
    return F.array_min(F.array_compact(F.array(near(lexical.local_name(iri), 0), near(label, 3), best, near(definition, 9))))


def build_gazetteer(facts: DataFrame, approved: DataFrame, graphs: list[str], labels: list[str], identifying: list[str], classes: list[str] | None = None, type_predicate: str = "rdf:type") -> DataFrame:
    """(iri, classes, labels, identifiers) of the entities that may be looked up.

    facts: (graph, subject, predicate, object, lit); only those of the given
    graphs count.  An entity must be approved (iri), be of one of the classes
    if any are given, and have an identifier: being labelled isn't enough to
    be known.  Values are distinct and sorted.
    """
    held = facts.where(F.col("graph").isin(*graphs)).join(approved.select(F.col("iri").alias("subject")).distinct(), "subject", "left_semi")
    of = lambda names, value, also=F.lit(True): F.array_sort(F.collect_set(F.when(F.col("predicate").isin(*names) & also, value)))
    one = F.struct(F.col("predicate").alias("scheme"), F.col("object").alias("value"))
    rows = held.groupBy(F.col("subject").alias("iri")).agg(
        of([type_predicate], F.col("object"), ~F.col("lit")).alias("classes"), of(labels, F.col("object"), F.col("lit")).alias("labels"), of(identifying, one).alias("identifiers")
    )
    rows = rows.where(F.size("identifiers") > 0)
    return rows if not classes else rows.where(F.arrays_overlap("classes", F.array(*[F.lit(c) for c in classes])))


def alias_index(gazetteer: DataFrame) -> DataFrame:
    """(label, iri) of every label; one label may have several entities."""
    return gazetteer.select(F.explode("labels").alias("label"), "iri").distinct()


def identifier_index(gazetteer: DataFrame) -> DataFrame:
    """(scheme, value, iri) of every identifier."""
    return gazetteer.select("iri", F.explode("identifiers").alias("i")).select("i.scheme", "i.value", "iri").distinct()


def identifier_probes(proposed: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(request, iri, scheme, value): the proposed entity's identifiers that stand in a quote of the request.

    proposed: (request, iri, quote), a row per grounded quote.  A request none
    of whose quotes holds one comes once, without a probe, as ``resolve_known``
    expects it.
    """
    held = identifier_index(gazetteer)
    met = proposed.join(held, "iri").where(F.contains("quote", F.col("value"))).select("request", "iri", "scheme", "value").distinct()
    asked = proposed.select("request", "iri").distinct()
    return asked.join(met, ["request", "iri"], "left")


def gazetteer_search(gazetteer: DataFrame, text: str, limit: int = 128) -> DataFrame:
    """Entries whose iri, label or identifier holds the text, case aside, in iri order."""
    if not 1 <= limit <= 128:
        raise ValueError("a search gives 1 to 128 entries")
    q = F.lit(text.lower())
    hit = F.contains(F.lower("iri"), q) | F.exists("labels", lambda x: F.contains(F.lower(x), q)) | F.exists("identifiers", lambda x: F.contains(F.lower(x["value"]), q))
    return gazetteer.where(F.coalesce(hit, F.lit(False))).orderBy("iri").limit(limit)


def resolve_known(requests: DataFrame, identifiers: DataFrame, approved: DataFrame) -> DataFrame:
    """requests (request, iri, scheme, value), a row per probe, with status and resolved iri of each request.

    All probes must lead to one and the same approved entity:
    identifier_required without probes, not_found, ambiguous (several entities
    meet all probes), mismatch (not the one asked for), not_approved, resolved.
    """
    probes = requests.where("value is not null").select("request", "scheme", "value").distinct()
    need = probes.groupBy("request").agg(F.count(F.lit(1)).alias("need"))
    meets = probes.join(identifiers.select("scheme", "value", F.col("iri").alias("found")).distinct(), ["scheme", "value"]).groupBy("request", "found").agg(F.count(F.lit(1)).alias("n"))
    whole = meets.join(need, "request").where("n = need").groupBy("request").agg(F.count(F.lit(1)).alias("hits"), F.min("found").alias("found"))
    asked = requests.groupBy("request").agg(F.max("iri").alias("iri"))
    ok = approved.select(F.col("iri").alias("found"), F.lit(True).alias("ok")).distinct()
    rows = asked.join(need, "request", "left").join(whole, "request", "left").join(ok, "found", "left")
    status = (
        F.when(F.col("need").isNull(), "identifier_required")
        .when(F.col("hits").isNull(), "not_found")
        .when(F.col("hits") > 1, "ambiguous")
        .when(F.col("iri").isNotNull() & (F.col("iri") != F.col("found")), "mismatch")
        .when(F.col("ok").isNull(), "not_approved")
        .otherwise("resolved")
    )
    return rows.select("request", status.alias("status"), F.when(status == "resolved", F.col("found")).alias("resolved"))


def unique_mapping(mappings: DataFrame) -> DataFrame:
    """(source, target) of sources with exactly one target."""
    return mappings.groupBy("source").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def entity_id(scope: Column, anchors: Column) -> Column:
    """An id that the set of anchors determines, in whatever order they came."""
    return F.concat(F.lit("entity:"), F.sha2(F.concat_ws("\u0001", scope, F.array_join(F.array_sort(F.array_distinct(anchors)), "\u0002")), 256))


def resolve_or_mint(mentions: DataFrame, existing: DataFrame, scope: str) -> DataFrame:
    """mentions (spelling, class) with the existing entity's iri, else one minted from scope, spelling and class."""
    held = existing.groupBy("spelling", "class").agg(F.min("iri").alias("iri"), F.countDistinct("iri").alias("n"))
    minted = F.concat(F.lit("minted:"), F.sha2(F.concat_ws("\u0001", F.lit(scope), "spelling", "class"), 256))
    one = F.when(F.col("n") == 1, F.col("iri"))
    return mentions.join(held, ["spelling", "class"], "left").select(*[mentions[c] for c in mentions.columns], F.coalesce(one, minted).alias("entity"), one.isNull().alias("minted"))


def lookup_status(found: Column) -> Column:
    return F.when(found == 0, "not_found").when(found == 1, "unique").otherwise("ambiguous")
