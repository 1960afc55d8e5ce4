"""Checks on bundles of proposed claims, and on what was extracted.

claims: (bundle, local_id, subject, predicate, object_kind, object, datatype,
valid_time, qualifier), subjects and entity objects being ids local to the
bundle.  Each check gives the rows that fail, with a reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import storage
from claimloom.functions import lexical
from claimloom.operators import ontology


#: Bytes of a bundle's links up to which one task settles it; larger ones go by rounds.
WHOLE = 128 << 20
#: Bytes of links that are dealt to a task together; a bundle with a quarter of that is dealt alone.
SHARE = 16 << 20
#: Bytes of links that are packed together.
CHUNK = 32 << 20


def disconnected(claims: DataFrame, limit: int = 64) -> DataFrame:
    """(bundle, reason): bundles whose entities the claims between them don't connect.

    Type claims connect nothing.  Bundles don't meet, so a task settles all
    that it is dealt in memory, by the entities' own texts, and links move
    once, packed.  Only bundles that are too large for a task are contracted
    in rounds.
    """
    link = (F.col("object_kind") == "iri") & (F.col("predicate") != ontology.TYPE)
    to = F.when(link, F.col("object"))
    # a claim that links nothing is its entity's link to itself
    a, b = F.coalesce("subject", to), F.coalesce(to, "subject")
    pairs = claims.select("bundle", a.alias("a"), b.alias("b")).where("a is not null")
    weight = F.lit(24) + F.octet_length("a") + F.octet_length("b")
    sizes = storage.materialize(pairs.groupBy("bundle").agg(F.sum(weight).alias("bytes")), "sizes")
    # at most one for each SHARE / 4 bytes of links, so they are few
    own = F.broadcast(sizes.where(F.col("bytes") >= SHARE // 4).select(F.col("bundle").alias("_bundle"), (F.col("bytes") > WHOLE).alias("large")))
    same = F.col("bundle").eqNullSafe(F.col("_bundle"))
    alone, rest = sizes.agg(F.count_if(F.col("bytes") >= SHARE // 4), F.coalesce(F.sum(F.when(F.col("bytes") < SHARE // 4, F.col("bytes"))), F.lit(0))).first()
    shared = rest // SHARE + 1
    number = F.xxhash64("bundle")
    share = F.when(F.col("large").isNull(), F.pmod(number, F.lit(shared))).otherwise(number)
    dealt = pairs.join(own, same, "left").where(~F.coalesce("large", F.lit(False))).select(share.alias("share"), "bundle", "a", "b")
    packed = dealt.mapInArrow(_pack(CHUNK), "share long, links binary").repartition(shared + alone, "share").sortWithinPartitions("share")
    found = packed.mapInArrow(_settle, f"bundle {claims.schema['bundle'].dataType.simpleString()}")
    large = _by_rounds(claims.join(own.where("large"), same, "left_semi"), link, limit)
    return storage.materialize(found.unionByName(large), "disconnected").select("bundle", F.lit("disconnected").alias("reason"))


def _pack(chunk: int):
    def run(batches):
        """(share, bundle, a, b) as (share, links): the rows of a share that are in one chunk, as a compressed Arrow stream."""
        import numpy as np
        import pyarrow as pa

        packing = pa.ipc.IpcWriteOptions(compression="zstd")

        def codes(column):
            return column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)

        def packed(held):
            table = pa.Table.from_batches(held)
            share = table.column("share").to_numpy()
            # rows of a bundle and of an entity side by side are packed well
            order = np.lexsort((codes(table.column("a")), codes(table.column("bundle")), share))
            share, rows = share[order], table.select(["bundle", "a", "b"]).take(pa.array(order)).combine_chunks()
            starts = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1])))
            links = []
            for at, end in zip(starts, [*starts[1:], len(share)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=packing) as out:
                    out.write_table(rows.slice(at, end - at))
                links.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(share[starts], pa.int64()), pa.array(links, pa.binary())], ["share", "links"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= chunk:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _settle(batches):
    """(bundle) of several components, of (share, links), each share's rows one after the other."""
    import pyarrow as pa

    share, held = None, []
    for batch in batches:
        for now, links in zip(batch.column("share").to_pylist(), batch.column("links")):
            if held and now != share:
                yield _several(held)
                held = []
            share = now
            held.append(pa.py_buffer(links.as_buffer().to_pybytes()))
    if held:
        yield _several(held)


def _several(links):
    """The bundles of several components among some that are here as a whole."""
    import numpy as np
    import pyarrow as pa

    table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in links])
    bundles = table.column("bundle").combine_chunks().dictionary_encode("encode")
    ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).dictionary_encode()
    n, names, several = table.num_rows, len(ends.chunk(0).dictionary), len(bundles.dictionary) > 1
    del table
    nodes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in ends.chunks])
    del ends
    of = np.zeros(names, np.int64)
    if several:  # an entity is another one in each bundle
        whole = bundles.indices.to_numpy(zero_copy_only=False).astype(np.int64) * names
        keys, nodes = np.unique(np.concatenate([whole, whole]) + nodes, return_inverse=True)
        of = keys // names
    roots = _least(len(of), nodes[:n], nodes[n:])
    count = np.bincount(of[roots == np.arange(len(of))], minlength=len(bundles.dictionary))
    return pa.RecordBatch.from_arrays([bundles.dictionary.take(pa.array(np.flatnonzero(count > 1)))], ["bundle"])


def _least(n, a, b):
    """The root of each of n nodes' components, for links between a and b: nodes join their least neighbour until no link is left."""
    import numpy as np

    root = me = np.arange(n, dtype=a.dtype)
    while True:
        keep = a != b
        a, b = a[keep], b[keep]
        if not len(a):
            return root
        near = np.full(n, n, a.dtype)
        np.minimum.at(near, a, b)
        np.minimum.at(near, b, a)
        near = np.where(near == n, me, near)
        # two may choose one another, and then the lesser stays; longer rings can't be
        near = np.where((near[near] == me) & (me < near), me, near)
        while (near[near] != near).any():
            near = near[near]
        root, a, b = near[root], near[a], near[b]


def _by_rounds(claims: DataFrame, link: Column, limit: int) -> DataFrame:
    """(bundle) of several components, of bundles of any size.

    Every round puts the least of an entity and its neighbours in the entity's
    place, at both ends of its links.  That keeps components apart and
    together, and links inside one entity fall away, so rounds shrink; entities
    that no link leaves any more are a component each.  Two hashes of 64 bits
    stand for an entity, the second telling whether the first meets another one
    in a bundle, which then gets other hashes.
    """
    claims = claims.withColumn("bundle", F.struct("bundle"))  # so that a null equals itself
    for seed in range(limit):
        node = lambda c, k: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(2 * seed + k), c))  # noqa: B023, E731
        ends = F.array(*[F.struct(node(own, 0).alias("a"), node(own, 1).alias("sure"), node(to, 0).alias("b")) for own, to in (("subject", "object"), ("object", "subject"))])
        alone = F.transform(F.slice(ends, 1, 1), lambda x: F.struct(x["a"].alias("a"), x["sure"].alias("sure"), F.lit(None).cast("long").alias("b")))
        rows = claims.select("bundle", F.inline(F.when(link, ends).otherwise(alone))).where("a is not null")
        first = rows.groupBy("bundle", "a").agg(F.least("a", F.min("b")).alias("to"), F.min("sure").alias("low"), F.max("sure").alias("high"))
        first = storage.materialize(first, "least")
        if first.where("low <> high").limit(1).count():
            storage.drop(first)
            continue
        links = claims.where(link).select("bundle", node("subject", 0).alias("a"), node("object", 0).alias("b")).where("a <> b")
        return _unjoined(first, links, limit).select("bundle.bundle")
    raise RuntimeError("hashes meet")


def _unjoined(first: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """(bundle) of several components; first: (bundle, a, to), the least of each node and its neighbours, written; links: (bundle, a, b), between different nodes."""
    done, least, read = [], first, [first]
    for _ in range(limit):
        here = lambda end: least.select("bundle", F.col("a").alias(end), F.col("to").alias("to_" + end))  # noqa: B023, E731
        moved = links.join(here("a"), ["bundle", "a"]).join(here("b"), ["bundle", "b"]).where("to_a <> to_b")
        moved = moved.select("bundle", F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        links = storage.materialize(moved, "links")
        # nodes of the next round that no link has are components; the others go on
        both = links.select("bundle", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        nodes = least.select("bundle", F.col("to").alias("a"), F.lit(None).cast("long").alias("b")).distinct()
        near = storage.materialize(nodes.unionByName(both).groupBy("bundle", "a").agg(F.min("b").alias("b")), "near")
        done.append(storage.materialize(near.where("b is null").groupBy("bundle").agg(F.count(F.lit(1)).alias("n")), "done"))
        storage.drop(*read)
        read = [links, near]
        least = near.where("b is not null").select("bundle", "a", F.least("a", "b").alias("to"))
        if not links.limit(1).count():
            return reduce(DataFrame.unionByName, done).groupBy("bundle").agg(F.sum("n").alias("n")).where("n > 1").select("bundle")
    raise RuntimeError("links did not settle")


def type_violations(claims: DataFrame, types: DataFrame, domains: DataFrame, ranges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(bundle, local_id, reason): subjects outside a property's domains, objects outside its ranges.

    types: (bundle, entity, class); domains and ranges: (property, class), all
    of which must hold; ancestors: the classes' reflexive closure.  Literal
    objects are held against ranges by their datatype.  An entity of several
    classes fits if one of them does, so an entity's fits are gathered once,
    and each claim is held against those of its end.
    """
    every = domains.select("class").unionByName(ranges.select("class")).distinct()
    up = ancestors.select(F.col("term").alias("own"), F.col("ancestor").alias("class")).unionByName(every.select(F.col("class").alias("own"), "class"))
    up = up.join(every, "class", "left_semi").groupBy("own").agg(F.collect_set("class").alias("fits"))
    kinds = types.join(up, types["class"] == up["own"]).groupBy("bundle", F.col("entity").alias("e")).agg(F.array_distinct(F.flatten(F.collect_set("fits"))).alias("fits"))

    def needs(rules: DataFrame) -> DataFrame:
        return rules.groupBy(F.col("property").alias("predicate")).agg(F.collect_set("class").alias("needs"))

    def failing(rows: DataFrame, reason: str) -> DataFrame:
        fails = F.size(F.array_except("needs", F.coalesce("fits", F.array().cast("array<string>")))) > 0
        return rows.where(fails).select("bundle", "local_id", F.lit(reason).alias("reason"))

    # subjects have many claims, so they are judged once for each property; those that fail are mostly few
    asked = claims.select("bundle", F.col("subject").alias("e"), "predicate").distinct().join(needs(domains), "predicate")
    bad = failing(asked.join(kinds, ["bundle", "e"], "left").withColumn("local_id", F.struct("e", "predicate")), "domain").select("bundle", "local_id.*")
    bad = storage.few(bad, "outside").withColumnsRenamed({"bundle": "_b", "e": "_e", "predicate": "_p"})
    subjects = claims.join(bad, (claims["bundle"] == bad["_b"]) & claims["subject"].eqNullSafe(bad["_e"]) & (claims["predicate"] == bad["_p"]), "left_semi").select("bundle", "local_id", F.lit("domain").alias("reason"))
    limits = claims.join(needs(ranges), "predicate")
    objects = limits.where("object_kind = 'iri'").withColumn("e", F.col("object")).select("bundle", "local_id", "e", "needs").join(kinds, ["bundle", "e"], "left")
    literals = limits.where("object_kind = 'literal'").join(up, F.col("datatype") == F.col("own"), "left")
    return subjects.unionByName(failing(objects, "range").unionByName(failing(literals, "range"))).distinct()


def unsupported_times(claims: DataFrame) -> DataFrame:
    """(bundle, local_id, reason): valid times without another dateTime claim of the same subject and value to support them."""
    support = claims.select("bundle", F.col("local_id").alias("qualifier"), F.col("subject").alias("s2"), F.col("object").alias("o2"), F.col("datatype").alias("d2"), F.lit(True).alias("there"))
    joined = claims.join(support, ["bundle", "qualifier"], "left")
    reason = (
        F.when(F.col("valid_time").isNull() & F.col("qualifier").isNull(), F.lit(None).cast("string"))
        .when(F.col("valid_time").isNull() | F.col("qualifier").isNull(), "mismatch")
        .when(F.col("qualifier") == F.col("local_id"), "supports itself")
        .when(F.col("there").isNull(), "unknown qualifier")
        .when((F.col("s2") != F.col("subject")) | ~F.col("d2").eqNullSafe("xsd:dateTime") | ~F.col("o2").eqNullSafe(F.col("valid_time")), "no support")
    )
    return joined.select("bundle", "local_id", reason.alias("reason")).where("reason is not null")


def spans_in_order(spans: DataFrame) -> DataFrame:
    """(item, at, reason): spans (item, at, start, end, window_start, window_end) that leave their window or overlap the one before."""
    before = F.lag("end").over(Window.partitionBy("item").orderBy("at"))
    reason = (
        F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "empty or negative")
        .when((F.col("start") < F.col("window_start")) | (F.col("end") > F.col("window_end")), "outside the window")
        .when(before > F.col("start"), "overlaps or out of order")
    )
    return spans.select("item", "at", reason.alias("reason")).where("reason is not null")


def provisional_id(prefix: str, *parts: Column) -> Column:
    """An id made from lower-cased texts."""
    return F.concat(F.lit(prefix), F.sha2(lexical.lower_each(F.concat_ws("\u0000", *parts)), 256))


def _tokens(text: Column) -> Column:
    """A text's words, letters and digits alone and in lower case, each after a space; a space at the end."""
    return F.concat(F.lit(" "), F.regexp_replace(F.btrim(F.regexp_replace(lexical.lower_each(text), r"[^\p{L}\p{N}]+", " ")), " ", "  "), F.lit(" "))


def role_explicit(role: Column, name: Column, quote: Column) -> Column:
    """Whether a quote says plainly that the named one has the role.

    Role and name must stand side by side: the role first, with nothing or
    "is" between; or the name first, with "as", or "is" and an article,
    between.  A role that follows "no", or "not" and perhaps an article, in
    the quote is denied.  Where role and name are one text, that is enough.
    """
    r, n, q = (_tokens(c) for c in (role, name, quote))
    forms = F.concat(r, F.lit("( is )?"), n, F.lit("|"), n, F.lit("( as | is  (a|the) )"), r)
    denied = F.rlike(q, F.concat(F.lit(" (no|not|not  a|not  the) "), r))
    said = (r == n) | F.rlike(q, forms)
    return (F.btrim(r) != "") & (F.btrim(n) != "") & F.contains(q, r) & F.contains(q, n) & said & ~denied


def document_entities(mentions: DataFrame) -> DataFrame:
    """(doc, request, local_id, name, entity, anchor): identities of what a document names.

    mentions: (doc, request, local_id, name, start, end, identifiers), a row
    per grounded span, identifiers being sorted ``scheme=value`` texts.  One
    exact span is an exact anchor, so other requests that ground the same name
    there meet in one entity; several give the earliest, told apart by request
    and local id.  Entities that carry different values of one scheme stay
    apart.
    """
    own = mentions.groupBy("doc", "request", "local_id", "name").agg(
        F.countDistinct("start", "end").alias("spans"), F.min(F.struct("start", "end")).alias("at"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("identifiers")))), ",").alias("ids")
    )
    exact = F.col("spans") == 1
    place = F.concat_ws("\u0001", F.col("doc").cast("string"), F.col("at.start").cast("string"), F.col("at.end").cast("string"), "name")
    key = F.when(exact, place).otherwise(F.concat_ws("\u0001", place, "request", "local_id"))
    held = own.withColumn("key", key).withColumn("anchor", F.when(exact, "exact").otherwise("contextual"))
    # identifiers that contradict one another keep holders of one key apart
    w = Window.partitionBy("key")
    clash = (F.size(F.collect_set(F.when(F.col("ids") != "", F.col("ids"))).over(w)) > 1) & (F.col("ids") != "")
    return held.select("doc", "request", "local_id", "name", F.concat(F.lit("entity:"), F.sha2(F.concat_ws("\u0002", "key", F.when(clash, F.col("ids"))), 256)).alias("entity"), "anchor")


def classifications(endpoints: DataFrame, *sources: DataFrame) -> DataFrame:
    """endpoints (entity, provisional) with all their classes and state: provisional, unclassified or classified."""
    every = sources[0].select("entity", "class")
    for s in sources[1:]:
        every = every.unionByName(s.select("entity", "class"))
    got = every.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("class")), "|").alias("classes"))
    state = F.when(F.col("provisional"), "provisional").when(F.coalesce("classes", F.lit("")) == "", "unclassified").otherwise("classified")
    return endpoints.join(got, "entity", "left").select("entity", F.coalesce("classes", F.lit("")).alias("classes"), state.alias("state"))


def path_sources(claims: DataFrame) -> DataFrame:
    """The distinct lineage sources of claims (column lineage: array of structs), in order of their JSON."""
    one = claims.select(F.explode("lineage").alias("s")).select(F.to_json("s").alias("source"), "s.*").distinct()
    return one.orderBy("source")


def contiguous(changes: DataFrame, pin: int, head: int) -> bool:
    """Whether the changes lead from pin to head without a gap, so that pin is an ancestor."""
    got = changes.where((F.col("seq") > pin) & (F.col("seq") <= head)).agg(F.count(F.lit(1)), F.countDistinct("seq"), F.min("seq"), F.max("seq")).first()
    return pin == head or (got[0] == got[1] == head - pin and got[2] == pin + 1 and got[3] == head)


def path_entails(paths: DataFrame, column: str, ancestors: DataFrame, target: str) -> DataFrame:
    """Paths some step of which has a column at or below a class or property (contains_isa, contains_subproperty_of)."""
    below = ancestors.where(F.col("ancestor") == target).select(F.col("term").alias("v")).unionByName(paths.sparkSession.createDataFrame([(target,)], "v string")).distinct()
    hits = paths.select("block", "seed", "ids", F.explode(F.transform("steps", lambda s: s[column])).alias("v")).join(below, "v", "left_semi").select("block", "seed", "ids").distinct()
    return paths.join(hits, ["block", "seed", "ids"], "left_semi")


def component_report(items: DataFrame) -> DataFrame:
    """Per kind of component: how many were proposed, grounded and right; precision and recall in thousandths.

    items: (kind, grounded, expected, proposed) booleans.
    """
    hit = F.count_if(F.col("proposed") & F.col("expected"))
    return items.groupBy("kind").agg(
        F.count_if("proposed").alias("proposed"),
        F.count_if(F.col("proposed") & F.col("grounded")).alias("grounded"),
        F.floor(1000 * hit / F.greatest(F.count_if("proposed"), F.lit(1))).alias("precision"),
        F.floor(1000 * hit / F.greatest(F.count_if("expected"), F.lit(1))).alias("recall"),
    )
