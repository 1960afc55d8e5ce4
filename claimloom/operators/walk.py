"""Bounded path expansion over claims, one join for each depth.

A path is a row: block, seed, seed_rank, node (where it goes on; null at a
literal), ids, nodes (entities it has been at), steps (its claims' metadata),
numerator (the exact product of its confidences as whole numbers of their last
decimal, see functions.products; paths of one depth have one denominator),
grounding (its weakest) and reached (whether it ends at a target).

Every depth is written to the shared folder: the next joins a table, not a plan
that grows with depth.  Caps are set-based and exact:

- fanout: the first claims of each parent, by confidence, then admission time
  (both descending), then id;
- the claim budget: each candidate has a place in the order of parents and of
  their candidates, a new claim's place is its first, and as many new claims are
  admitted, by place, as the budget has left.  This equals admitting one by one,
  since a claim is admitted or refused once, at its first occurrence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import storage
from claimloom.functions import products
from claimloom.operators import predicates
from claimloom.operators.graph import Graph

CYCLES = ("no_repeated_claim", "allow_repeated_claim", "no_repeated_node")
STEP = ["claim_id", "subject_id", "relation", "object_kind", "object_id", "confidence", "grounding", "transaction_time"]


@dataclass
class Options:
    max_depth: int
    direction: str = "outgoing"
    fanout_limit: int | None = 4
    max_claims: int | None = 16
    path_limit: int | None = 8
    cycle: str = "no_repeated_claim"
    #: (field, operator, value) that each claim of a path must meet.
    predicates: list[tuple] = field(default_factory=list)
    #: (field, operator, value) that paths must meet.
    filters: list[tuple] = field(default_factory=list)
    #: A predicate over columns of a candidate, for programs (see operators.programs).
    programs: list = field(default_factory=list)
    #: Closures (term, ancestor) of classes and properties, for predicates that ask an ontology.
    ontology: dict[str, DataFrame] = field(default_factory=dict)
    #: Count what is examined and eligible too, which takes a pass over each depth's candidates.
    explain: bool = False


@dataclass
class Walk:
    paths: DataFrame
    notices: set[str]
    counters: dict[str, int]
    #: All paths that were walked, those that reached no target too.
    every: DataFrame | None = None


def start(seeds: DataFrame) -> DataFrame:
    """Seeds (block, id, seed_rank) as paths of no claims."""
    return seeds.select(
        "block",
        F.col("id").alias("seed"),
        "seed_rank",
        F.col("id").alias("node"),
        F.array().cast("array<string>").alias("ids"),
        F.array("id").alias("nodes"),
        products.one().alias("numerator"),
        F.lit(2).alias("grounding"),
    )


def _candidates(frontier: DataFrame, graph: Graph, direction: str, steps: list[str]) -> DataFrame:
    """frontier rows with the columns of a claim at their node (prefixed c_) and the node that it leads to."""
    renamed = lambda claims: claims.select(*[F.col(x).alias("c_" + x) for x in steps])
    parts, nodes = [], graph.nodes(frontier)
    if direction in ("outgoing", "both"):
        parts.append(frontier.join(renamed(graph.outgoing(nodes)), F.col("node") == F.col("c_subject_id")).withColumn("to", F.when(F.col("c_object_kind") == "iri", F.col("c_object_id"))))
    if direction in ("incoming", "both"):
        own = renamed(graph.incoming(nodes))
        if direction == "both":
            own = own.where("c_object_id <> c_subject_id")
        parts.append(frontier.join(own, F.col("node") == F.col("c_object_id")).withColumn("to", F.col("c_subject_id")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def decimals(claims: DataFrame) -> int:
    """The decimal places of confidences: at most nine, so that products stay exact."""
    kind = claims.schema["confidence"].dataType
    if not isinstance(kind, T.DecimalType) or kind.scale > products.DIGITS:
        raise predicates.PlanError("invalid", "confidences are decimals of at most nine places")
    return kind.scale


def _entailed(found: DataFrame, options: Options) -> tuple[DataFrame, dict[int, Column]]:
    """found with a flag for each predicate that asks an ontology, whether it holds; running ones for whole paths.

    A path predicate holds from the first step on that meets it, so the flag
    travels with the path (``_o0`` and so on).
    """
    asked = {}
    for i, (name, op, target) in enumerate(options.predicates):
        if op not in predicates.ONTOLOGY:
            continue
        value = F.col("c_" + predicates.column_of(name))
        below = predicates.below(options.ontology, op, target).select(F.col("term").alias(f"_b{i}"))
        found = found.join(below, value == F.col(f"_b{i}"), "left")
        hit = F.col(f"_b{i}").isNotNull()
        if op.startswith("contains"):
            hit = F.col(f"_o{i}") | hit
        asked[i] = value.isNotNull() & ~hit if op.startswith("not_") else hit
    return found, asked


def walk(claims: DataFrame | Graph, seeds: DataFrame, options: Options, targets: DataFrame | None = None) -> Walk:
    """Paths from seeds over usable claims; with targets (block, id), those that end at one.

    claims must hold STEP and whatever further columns predicates use.
    Counters: candidates examined, those eligible after cycles and predicates,
    and paths traversed; the first two only where options.explain asks.
    """
    graph = Graph.of(claims)
    claims = graph.by_subject
    scale = decimals(claims)
    if options.cycle not in CYCLES:
        raise predicates.PlanError("invalid", f"cycle policy {options.cycle!r}")
    extra = [c for c in ("lifecycle_state", "relation_type", "subject_type", "object_type", "claim_type", "ext", "lineage") if c in claims.columns]
    steps = STEP + extra
    first = start(seeds)
    notices: set[str] = set()
    counters = {"examined": 0, "eligible": 0, "traversed": 0} if options.explain else {"traversed": 0}
    flags = [f"_o{i}" for i, t in enumerate(options.predicates) if t[1] in predicates.ONTOLOGY and t[1].startswith("contains")]
    empty = F.array().cast(claims.select(F.array(F.struct(*steps, F.lit(1).alias("depth"))).alias("s")).schema["s"].dataType)
    frontier = storage.materialize(first.withColumn("steps", empty).withColumns({f: F.lit(False) for f in flags}), "seeds")
    for state, _, _ in (p.state() for p in options.programs):
        frontier = state(frontier)
    known: DataFrame | None = None
    left, kept, grew = options.max_claims, [], []
    for depth in range(1, options.max_depth + 1):
        found = examined = _candidates(frontier, graph, options.direction, steps)
        if options.cycle == "no_repeated_claim":
            found = found.where(~F.array_contains("ids", F.col("c_claim_id")))
        elif options.cycle == "no_repeated_node":
            found = found.where(F.col("to").isNull() | ~F.array_contains("nodes", F.col("to")))
        found = found.withColumn("c_depth", F.lit(depth))
        passing = F.lit(True)
        if options.predicates:
            here = F.struct(*[F.col("c_" + x).alias(x) for x in steps], F.col("c_depth").alias("depth"))
            path = F.concat("steps", F.array(here))
            found, asked = _entailed(found, options)
            passing = predicates.conjunction([asked[i] if i in asked else triple(t, lambda n: F.col("c_" + n), path) for i, t in enumerate(options.predicates)])
            found = found.withColumns({f: F.col(f) | F.col("_b" + f[2:]).isNotNull() for f in flags})
        for program in options.programs:
            found, keep = program.step(found)
            passing = F.when(passing, keep).otherwise(F.lit(False))
        found = found.withColumn("_pass", passing)
        if options.explain:
            counters["examined"] += examined.count()
            counters["eligible"] += found.where("_pass").count()
        parent = Window.partitionBy("block", "seed_rank", "ids")
        ranked = found.where("_pass").withColumn("place", F.row_number().over(parent.orderBy(F.col("c_confidence").desc(), F.col("c_transaction_time").desc(), "c_claim_id")))
        if options.fanout_limit is not None:
            ranked = ranked.where(F.col("place") <= options.fanout_limit + 1)  # one more tells that some were left out
        ranked = storage.materialize(ranked.drop("_pass"), f"depth{depth}")
        fits = ranked
        if options.fanout_limit is not None:
            fits = ranked.where(F.col("place") <= options.fanout_limit)
            if ranked.where(F.col("place") > options.fanout_limit).limit(1).count():
                notices.add("fanout_limit")
        if left is not None:
            ids = fits.select(F.col("c_claim_id").alias("id"), F.struct("block", "seed_rank", "ids", "place").alias("at")).groupBy("id").agg(F.min("at").alias("at"))
            if known is not None:
                ids = ids.join(known, "id", "left_anti")
            # the budget bounds what is admitted, so the order of new claims is a top-k
            new = storage.materialize(ids.orderBy("at").limit(left + 1), "new") if left >= 0 else None
            fresh = new.orderBy("at").limit(left).select("id")
            n = new.count()
            if n > left:
                notices.add("max_claims")
            left -= min(left, n)
            known = storage.materialize(fresh if known is None else known.unionByName(fresh), "known")
            fits = fits.join(known, fits["c_claim_id"] == known["id"], "left_semi")
        grown = fits.select(
            "block",
            "seed",
            "seed_rank",
            F.col("to").alias("node"),
            F.concat("ids", F.array("c_claim_id")).alias("ids"),
            F.when(F.col("to").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("to"))).alias("nodes"),
            F.concat("steps", F.array(F.struct(*[F.col("c_" + x).alias(x) for x in steps], F.col("c_depth").alias("depth")))).alias("steps"),
            products.times(F.col("numerator"), (F.col("c_confidence") * 10**scale).cast("long")).alias("numerator"),
            F.least("grounding", "c_grounding").alias("grounding"),
            *flags,
            *[c for p in options.programs for c in p.columns],
        )
        if targets is not None:
            t = targets.select(F.col("block").alias("t_block"), F.col("id").alias("t_id")).distinct()
            grown = grown.join(t, (F.col("block") == F.col("t_block")) & (F.col("node") == F.col("t_id")), "left").withColumn("reached", F.col("t_id").isNotNull()).drop("t_block", "t_id")
        else:
            grown = grown.withColumn("reached", F.lit(False))
        grown = storage.materialize(grown.withColumn("depth", F.lit(depth)), f"paths{depth}")
        n = grown.count()
        counters["traversed"] += n
        grew.append(grown)
        kept.append(grown if targets is None else grown.where("reached"))
        frontier = grown.where("node is not null").drop("depth", "reached")
        if not n:
            break
    else:
        if options.max_depth and frontier.limit(1).count():
            notices.add("max_depth")
    none = frontier.withColumns({"reached": F.lit(False), "depth": F.lit(0)}).where(F.lit(False))
    paths, every = (reduce(DataFrame.unionByName, parts) if parts else none for parts in (kept, grew))
    return Walk(paths, notices, counters, every)


def triple(t: tuple, column: Callable[[str], Column], path: Column) -> Column:
    """A triple over a candidate's columns (``meta``) or the path's steps (``path.meta``)."""
    name, op, value = t
    if name.startswith("path.meta:"):
        return predicates.test(op, predicates.ListLane.over(path, lambda s: predicates.field(name[10:], lambda n: s[n])), value)
    return predicates.test(op, predicates.field(name.removeprefix("meta:"), column), value)


def filtered(paths: DataFrame, filters: list[tuple], ontology: dict[str, DataFrame] | None = None) -> DataFrame:
    """Paths that meet all filters; one on ``meta:`` is met if any claim of the path meets it, and looks at all of them."""
    for t in filters:
        if t[1] in predicates.ONTOLOGY:
            paths = _entailed_paths(paths, t, ontology or {})
    tests, filters = [], [t for t in filters if t[1] not in predicates.ONTOLOGY]
    for t in filters:
        if t[0].startswith("path.meta:"):
            tests.append(triple(t, F.col, F.col("steps")))
        else:
            tests.append(_any_step(*t))
    out = paths
    for i, t in enumerate(tests):
        out = out.withColumn(f"_t{i}", t)
    met = F.lit(True)
    for i in range(len(tests)):
        met = met & F.col(f"_t{i}")
    return out.where(met).drop(*[f"_t{i}" for i in range(len(tests))])


def _entailed_paths(paths: DataFrame, t: tuple, ontology: dict[str, DataFrame]) -> DataFrame:
    """Paths some step of which meets a predicate that asks an ontology."""
    name, op, target = t
    key = ["block", "seed", "ids"]
    values = paths.select(*key, F.explode(F.transform("steps", lambda s: s[predicates.column_of(name)])).alias("term")).where("term is not null")
    below = predicates.below(ontology, op, target)
    hits = values.join(below, "term", "left_anti" if op.startswith("not_") else "left_semi").select(*key).distinct()
    return paths.join(hits, key, "left_semi")


def _any_step(name: str, op: str, value) -> Column:
    hits = F.transform("steps", lambda s: predicates.test(op, predicates.field(name.removeprefix("meta:"), lambda n: s[n]), value))
    return F.aggregate(hits, F.lit(False), lambda a, b: a | b)


def order() -> list[tuple[Column, bool]]:
    """The ranking of paths: columns, and whether they descend."""
    times = F.transform("steps", lambda s: s["transaction_time"])
    return [(F.col("depth"), False), (products.order(F.col("numerator")), True), (F.col("grounding"), True), (times, True), (F.col("ids"), False), (F.col("block"), False), (F.col("seed"), False)]


def ranked(paths: DataFrame, limit: int | None = 8) -> DataFrame:
    """The best paths with their ``rank`` from 1; without a limit all, ranked by ranges."""
    if limit is None:
        return storage.ranked(paths, order(), "_place").withColumn("rank", F.col("_place") + 1).drop("_place")
    by = [c.desc() if down else c for c, down in order()]
    return paths.orderBy(*by).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def summary(paths: DataFrame) -> DataFrame:
    """Ranked paths as plain columns."""
    return paths.select(
        F.col("rank").cast("long"),
        F.col("block").cast("long"),
        F.col("seed").alias("seed_id"),
        F.col("depth").cast("long"),
        F.array_join("ids", " ").alias("claim_ids"),
        F.array_join("nodes", " ").alias("node_ids"),
        products.text(F.col("numerator")).alias("numerator"),
        F.col("grounding").cast("long"),
        "reached",
    )


def returned_claims(paths: DataFrame) -> DataFrame:
    """The distinct claims of paths."""
    return paths.select(F.explode("steps").alias("s")).select("s.*").drop("depth").dropDuplicates(["claim_id"])
