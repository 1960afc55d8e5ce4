"""Closures and rules over triples (s, p, o, lit), lit telling literals from entities.

Closures and materialisation run in rounds until a round adds nothing; each
round's facts are written, so plans don't grow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import storage

TYPE, SAME = "rdf:type", "owl:sameAs"


def closure(pairs: DataFrame, child: str, parent: str, limit: int = 64) -> DataFrame:
    """(term, ancestor), reflexive for every term in pairs, transitive; paths double in length each round."""
    edges = pairs.select(F.col(child).alias("term"), F.col(parent).alias("ancestor")).where("term is not null and ancestor is not null")
    terms = edges.select("term").unionByName(edges.select(F.col("ancestor").alias("term"))).distinct()
    known = storage.materialize(edges.unionByName(terms.select("term", F.col("term").alias("ancestor"))).distinct(), "closure")
    before = known.count()
    for _ in range(limit):
        hop = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.term")).select("a.term", "b.ancestor")
        known = storage.materialize(hop.distinct(), "closure")  # reflexive, so it holds what was known
        after = known.count()
        if after == before:
            return known
        before = after
    raise RuntimeError("closure cut off")


def entailed(values: DataFrame, column: str, ancestors: DataFrame, targets: list[str]) -> DataFrame:
    """Rows whose column is one of the targets or below one (isa, subproperty_of)."""
    below = ancestors.where(F.col("ancestor").isin(*targets)).select(F.col("term").alias(column)).distinct()
    direct = values.sparkSession.createDataFrame([(t,) for t in targets], f"{column} string")
    return values.join(below.unionByName(direct).distinct(), column, "left_semi")


def not_entailed(values: DataFrame, column: str, ancestors: DataFrame, targets: list[str]) -> DataFrame:
    below = ancestors.where(F.col("ancestor").isin(*targets)).select(F.col("term").alias(column)).distinct()
    direct = values.sparkSession.createDataFrame([(t,) for t in targets], f"{column} string")
    return values.join(below.unionByName(direct).distinct(), column, "left_anti")


def disjoint_violations(types: DataFrame, disjoint: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(entity, a, b): entities (entity, class) that fall under both of two classes declared disjoint (a, b)."""
    under = types.join(ancestors, types["class"] == ancestors["term"]).select("entity", "ancestor").distinct()
    first = disjoint.join(under.withColumnRenamed("ancestor", "a"), "a")
    return first.join(under.withColumnRenamed("ancestor", "b"), ["entity", "b"]).select("entity", "a", "b").distinct()


def hierarchy_facts(triples: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Each triple under the ancestors of its property, each type under the ancestors of its class."""
    up = triples.join(properties, triples["p"] == properties["term"]).select("s", F.col("ancestor").alias("p"), "o", "lit")
    kinds = triples.where(F.col("p") == TYPE).join(classes, F.col("o") == classes["term"]).select("s", "p", F.col("ancestor").alias("o"), "lit")
    return triples.unionByName(up).unionByName(kinds).distinct()


def inherited(constraints: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(term, value): domains or ranges (property, value) that a term's ancestors and itself declare."""
    return ancestors.join(constraints, ancestors["ancestor"] == constraints["property"]).select("term", "value").distinct()


def _typed(triples: DataFrame, cls: str) -> DataFrame:
    return triples.where((F.col("p") == TYPE) & (F.col("o") == cls)).select(F.col("s").alias("prop"))


def _of(triples: DataFrame, p: str, a: str, b: str) -> DataFrame:
    return triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))


def _fact(s, p, o, lit=None):
    c = lambda x: x if not isinstance(x, str) else F.col(x)
    return [c(s).alias("s"), c(p).alias("p"), c(o).alias("o"), (F.lit(False) if lit is None else c(lit)).alias("lit")]


def _merge(groups: DataFrame) -> DataFrame:
    """(key, node): nodes of one key are the same; each is tied to the least, not to all others."""
    least = groups.groupBy("key").agg(F.min("node").alias("least"))
    return groups.join(least, "key").where("node <> least").select(*_fact("least", F.lit(SAME), "node")).distinct()


def _lists(t: DataFrame, p: str) -> DataFrame:
    """(head, item) of constructs stated one item at a time, as the loader spells lists out."""
    return _of(t, p, "head", "item")


def _intersection(t: DataFrame) -> DataFrame:
    parts = _lists(t, "owl:intersectionOf")
    need = parts.groupBy("head").agg(F.count(F.lit(1)).alias("need"))
    kinds = t.where(F.col("p") == TYPE).select("s", F.col("o").alias("item"))
    has = kinds.join(parts, "item").groupBy("s", "head").agg(F.countDistinct("item").alias("n"))
    whole = has.join(need, "head").where("n = need").select(*_fact("s", F.lit(TYPE), "head"))
    back = kinds.join(parts.withColumnRenamed("item", "part"), F.col("item") == F.col("head")).select(*_fact("s", F.lit(TYPE), "part"))
    return whole.unionByName(back)


def _links(t: DataFrame) -> DataFrame:
    return t.where("not lit")


def _key(t: DataFrame) -> DataFrame:
    keys = _of(t, "owl:hasKey", "cls", "prop")
    need = keys.groupBy("cls").agg(F.count(F.lit(1)).alias("need"))
    members = t.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("cls"))
    held = t.join(keys, t["p"] == keys["prop"]).select(F.col("s").alias("node"), "cls", "prop", F.concat_ws("\u0001", F.col("lit").cast("string"), "o").alias("v"))
    held = held.join(members, ["node", "cls"]).groupBy("node", "cls", "prop").agg(F.array_join(F.array_sort(F.collect_set("v")), "\u0002").alias("v"))
    one = held.groupBy("node", "cls").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("\u0003", "prop", "v"))), "\u0004").alias("v")).join(need, "cls").where("n = need")
    return _merge(one.select(F.concat_ws("\u0005", "cls", "v").alias("key"), "node"))


def _max_one(t: DataFrame) -> DataFrame:
    ones = t.where((F.col("p") == "owl:maxCardinality") & (F.col("o") == "1")).select(F.col("s").alias("cls"))
    on = _of(t, "owl:onProperty", "cls", "prop")
    members = t.where(F.col("p") == TYPE).select("s", F.col("o").alias("cls"))
    held = _links(t).select("s", F.col("p").alias("prop"), F.col("o").alias("node"))
    return _merge(held.join(members.join(ones.join(on, "cls"), "cls"), ["s", "prop"]).select(F.concat_ws("\u0001", "s", "cls").alias("key"), "node").distinct())


def _max_one_qualified(t: DataFrame) -> DataFrame:
    ones = t.where((F.col("p") == "owl:maxQualifiedCardinality") & (F.col("o") == "1")).select(F.col("s").alias("cls"))
    on = _of(t, "owl:onProperty", "cls", "prop").join(_of(t, "owl:onClass", "cls", "kind"), "cls")
    kinds = t.where(F.col("p") == TYPE).select("s", F.col("o").alias("cls"))
    held = _links(t).select("s", F.col("p").alias("prop"), F.col("o").alias("node")).join(kinds.join(ones.join(on, "cls"), "cls"), ["s", "prop"])
    fit = held.join(kinds.select(F.col("s").alias("node"), F.col("cls").alias("kind")), ["node", "kind"])
    return _merge(fit.select(F.concat_ws("\u0001", "s", "cls").alias("key"), "node").distinct())


def _chains(t: DataFrame) -> DataFrame:
    """Chains of two: owl:chain1 and owl:chain2 name a property's parts (longer ones are spelled as chains of chains)."""
    two = _of(t, "owl:chain1", "prop", "first").join(_of(t, "owl:chain2", "prop", "second"), "prop")
    a = _links(t).select(F.col("s").alias("a"), F.col("p").alias("first"), F.col("o").alias("mid"))
    b = t.select(F.col("s").alias("mid"), F.col("p").alias("second"), F.col("o").alias("z"), "lit")
    return a.join(two, "first").join(b, ["mid", "second"]).select(*_fact("a", "prop", "z", "lit"))


def _restriction(t: DataFrame, p: str, name: str) -> DataFrame:
    """(cls, prop, name) of restrictions stating p."""
    return _of(t, p, "cls", name).join(_of(t, "owl:onProperty", "cls", "prop"), "cls")


#: Rule families: name -> new facts of a set of triples.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "symmetric": lambda t: _links(t).join(_typed(t, "owl:SymmetricProperty"), F.col("p") == F.col("prop")).select(*_fact("o", "p", "s")),
    "inverse": lambda t: _links(t).join(_of(t, "owl:inverseOf", "a", "b").unionByName(_of(t, "owl:inverseOf", "b", "a")), F.col("p") == F.col("a")).select(*_fact("o", "b", "s")),
    "transitive": lambda t: _links(t).join(_typed(t, "owl:TransitiveProperty"), F.col("p") == F.col("prop")).select("s", "p", "o").join(_links(t).select(F.col("s").alias("o"), "p", F.col("o").alias("z")), ["o", "p"]).select(*_fact("s", "p", "z")),
    "chain": _chains,
    "domain": lambda t: t.join(_of(t, "rdfs:domain", "prop", "cls"), F.col("p") == F.col("prop")).select(*_fact("s", F.lit(TYPE), "cls")),
    "range": lambda t: _links(t).join(_of(t, "rdfs:range", "prop", "cls"), F.col("p") == F.col("prop")).select(*_fact("o", F.lit(TYPE), "cls")),
    "subproperty": lambda t: t.join(_of(t, "rdfs:subPropertyOf", "prop", "up"), F.col("p") == F.col("prop")).select(*_fact("s", "up", "o", "lit")),
    "functional": lambda t: _merge(_links(t).join(_typed(t, "owl:FunctionalProperty"), F.col("p") == F.col("prop")).select(F.concat_ws("\u0001", "p", "s").alias("key"), F.col("o").alias("node")).distinct()),
    "inverse_functional": lambda t: _merge(t.join(_typed(t, "owl:InverseFunctionalProperty"), F.col("p") == F.col("prop")).select(F.concat_ws("\u0001", "p", "o").alias("key"), F.col("s").alias("node")).distinct()),
    "key": _key,
    "subclass": lambda t: t.where(F.col("p") == TYPE).join(_of(t, "rdfs:subClassOf", "cls", "up"), F.col("o") == F.col("cls")).select(*_fact("s", "p", "up")),
    "equivalent_class": lambda t: t.where(F.col("p") == TYPE).join(_of(t, "owl:equivalentClass", "a", "b").unionByName(_of(t, "owl:equivalentClass", "b", "a")), F.col("o") == F.col("a")).select(*_fact("s", "p", "b")),
    "has_value_type": lambda t: t.join(_restriction(t, "owl:hasValue", "v"), (F.col("p") == F.col("prop")) & (F.col("o") == F.col("v"))).select(*_fact("s", F.lit(TYPE), "cls")),
    "has_value_fact": lambda t: t.where(F.col("p") == TYPE).join(_restriction(t, "owl:hasValue", "v"), F.col("o") == F.col("cls")).select(*_fact("s", "prop", "v")),
    "some_values": lambda t: _links(t).join(_restriction(t, "owl:someValuesFrom", "kind"), F.col("p") == F.col("prop")).select("s", "o", "cls", "kind").join(t.where(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("kind")), ["o", "kind"]).select(*_fact("s", F.lit(TYPE), "cls")),
    "all_values": lambda t: t.where(F.col("p") == TYPE).join(_restriction(t, "owl:allValuesFrom", "kind"), F.col("o") == F.col("cls")).select("s", "prop", "kind").join(_links(t).select("s", F.col("p").alias("prop"), F.col("o").alias("z")), ["s", "prop"]).select(*_fact("z", F.lit(TYPE), "kind")),
    "intersection": _intersection,
    "union": lambda t: t.where(F.col("p") == TYPE).join(_lists(t, "owl:unionOf"), F.col("o") == F.col("item")).select(*_fact("s", "p", "head")),
    "one_of": lambda t: _lists(t, "owl:oneOf").select(*_fact("item", F.lit(TYPE), "head")),
    "max_cardinality": _max_one,
    "max_qualified_cardinality": _max_one_qualified,
}


#: Families that look at one fact beside the schema: what they give from facts of earlier rounds is there already.
LINEAR = ("symmetric", "inverse", "domain", "range", "subproperty", "subclass", "equivalent_class", "has_value_type", "has_value_fact", "union", "one_of")


def _of_schema() -> Column:
    """Whether a fact is about classes and properties rather than entities."""
    spelt = F.startswith("p", F.lit("rdfs:")) | (F.startswith("p", F.lit("owl:")) & (F.col("p") != SAME))
    return spelt | ((F.col("p") == TYPE) & F.startswith("o", F.lit("owl:")))


def canonical(triples: DataFrame) -> DataFrame:
    """Triples with each class of same nodes replaced, in both places, by its least."""
    pairs = triples.where((F.col("p") == SAME) & (F.col("s") != F.col("o"))).select(F.col("s").alias("a"), F.col("o").alias("b"))
    pairs = storage.materialize(pairs.distinct(), "same")
    if not pairs.limit(1).count():
        return triples
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = storage.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        jump = label.select(F.col("a").alias("root"), F.col("root").alias("r2"))
        new = label.join(near, "a").join(jump, "root", "left").select("a", F.least("root", "r", F.coalesce("r2", "root")).alias("root"))
        new = storage.materialize(new, "roots")
        if not new.join(label.withColumnRenamed("root", "old"), "a").where("root <> old").limit(1).count():
            break
        label = new
    star = new.where("a <> root").select(*_fact("root", F.lit(SAME), "a"))
    rest = triples.where(F.col("p") != SAME)
    rest = rest.join(new.select(F.col("a").alias("s"), F.col("root").alias("rs")), "s", "left").join(new.select(F.col("a").alias("o"), F.col("root").alias("ro")), "o", "left")
    rest = rest.select(F.coalesce("rs", "s").alias("s"), "p", F.when(F.col("lit"), F.col("o")).otherwise(F.coalesce("ro", "o")).alias("o"), "lit")
    return rest.unionByName(star).distinct()


def materialise(triples: DataFrame, rules=None, limit: int = 50, most: int | None = None) -> DataFrame:
    """All facts that follow by the named rules (all, if none are named), same nodes made one.

    Families that look at one fact are run on what the round before has added
    (and the schema), unless that is schema itself; the others on all facts.
    most: facts at which it gives up with an error; a partial answer is never returned.
    """
    chosen = list(RULES) if rules is None else list(rules)
    now = storage.materialize(triples.select("s", "p", "o", "lit").distinct(), "facts")
    n, new = now.count(), now
    for _ in range(limit):
        fresh = now if new.where(_of_schema()).limit(1).count() else new.unionByName(now.where(_of_schema()))
        # only what the rules give is made distinct and held against what is known, and only what is new is written
        given = reduce(DataFrame.unionByName, [RULES[name](fresh if name in LINEAR else now) for name in chosen]) if chosen else now.where(F.lit(False))
        known = now.select(*[F.col(c).alias("_" + c) for c in ("s", "p", "o", "lit")])
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_" + c)) for c in ("s", "p", "o", "lit")])
        new = storage.materialize(given.distinct().join(known, same, "left_anti"), "added")
        grown = now.unionByName(new)
        one = canonical(grown)
        if one is not grown:  # same nodes were made one
            one = storage.materialize(one, "facts")
            new, grown = storage.materialize(one.subtract(now), "added"), one
        m = grown.count()
        if most is not None and m > most:
            raise RuntimeError("more facts than allowed")
        if m == n and not new.limit(1).count():
            return grown
        now, n = grown, m
    raise RuntimeError("no fixed point within the rounds")


def cycles(imports: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components of more than one, or with a loop, of a small import graph."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []
    for root in sorted(imports):
        if root in index:
            continue
        work = [(root, iter(sorted(imports.get(root, []))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is not None:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    work.append((nxt, iter(sorted(imports.get(nxt, [])))))
                elif nxt in stack:
                    low[node] = min(low[node], index[nxt])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
            if low[node] == index[node]:
                part = stack[stack.index(node) :]
                del stack[stack.index(node) :]
                if len(part) > 1 or node in imports.get(node, []):
                    out.append(sorted(part))
    return out
