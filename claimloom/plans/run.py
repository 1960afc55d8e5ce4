"""Running a compiled plan over claims: landing, walk, filter, ranking, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import storage
from claimloom.functions import canonical
from claimloom.operators import bundles, documents, landing, policy, predicates, programs, scan, walk
from claimloom.operators.graph import Graph
from claimloom.operators.predicates import PlanError
from claimloom.plans.compile import Plan


class Result:
    """paths are ranked; claims, evidence and explain are None unless the query selects them.

    footprint: under an authority, the (resource, property) pairs that the
    returned claims rest on, which must still be allowed when it is shown.
    """

    def __init__(self, paths: DataFrame, claims: DataFrame | None, notices: list[str], seeds: DataFrame, explain: dict | None, evidence: DataFrame | None = None, footprint: DataFrame | None = None):
        self.paths, self.claims, self.notices, self.seeds, self.explain, self.evidence, self.footprint = paths, claims, notices, seeds, explain, evidence, footprint

    #: The state of the authority that the result was made under.
    authority: tuple | None = None

    def release(self, authority: policy.Authority) -> DataFrame:
        """The paths, if the authority is still what it was when they were found."""
        if authority.digest() != self.authority:
            raise PlanError("denied", "the policy changed while the query ran")
        return self.paths

    def digest(self) -> str:
        """A digest of the ranked paths."""
        rows = [r.asDict() for r in walk.summary(self.paths).orderBy("rank").collect()]
        return canonical.digest(rows, "response")


def execute(
    plan: Plan,
    claims: DataFrame | Graph,
    catalog: DataFrame,
    landed: DataFrame | None = None,
    authority: policy.Authority | None = None,
    ontology: dict[str, DataFrame] | None = None,
    sources: DataFrame | None = None,
) -> Result:
    """Run a plan.

    Without an authority, claims must be usable ones already; with one, those
    that it hides are left out before anything is landed, walked or counted,
    and the rest have their lifecycle state.  catalog (id, label) must hold
    what the principal may land on.  landed: recorded landings, in a replay.
    ontology: closures by kind (class, property).  sources (source_id, text):
    the documents that evidence is read from.
    """
    spark = catalog.sparkSession
    state = None if authority is None else authority.digest()
    if authority is not None:
        _check_terms(plan, authority, spark)
        if isinstance(claims, Graph) and claims.at_subject is not None:
            claims = claims.at_nodes(lambda c: authority.usable(c, plan.as_of))
        else:
            claims = storage.materialize(authority.usable(Graph.of(claims).by_subject, plan.as_of), "usable")
    elif plan.as_of is not None:
        claims = Graph.of(claims).map(lambda c: scan.as_of(c, plan.as_of))
    if landed is None:
        parts = []
        for b, block in enumerate(plan.blocks):
            asked = landing.anchors_frame(spark, [block]).withColumn("block", F.lit(b))
            parts.append((landing.exact if block["match"] == "exact" else landing.token_overlap)(asked, catalog))
        landed = parts[0]
        for p in parts[1:]:
            landed = landed.unionByName(p)
    notices = set(plan.notices)
    seeds = storage.materialize(landing.seeds(landed, plan.seed_limit + 1), "landed")  # one more tells that some were left out
    if seeds.groupBy("block").count().count() < len(plan.blocks):
        notices.add("empty_landing")
    if seeds.where(F.col("seed_rank") > plan.seed_limit).limit(1).count():
        notices.add("seed_limit")
    seeds = seeds.where(F.col("seed_rank") <= plan.seed_limit)
    targets = storage.materialize(landing.targets(landed), "targets") if any("to" in b for b in plan.blocks) else None
    plan.options.programs = [programs.Program(p, f"walk{i}") for i, p in enumerate(plan.programs.get("walk", []))]
    plan.options.ontology, plan.options.explain = ontology or {}, bool(plan.returns["explain"])
    done = walk.walk(claims, seeds, plan.options, targets)
    kept = walk.filtered(done.paths, plan.options.filters, plan.options.ontology)
    for i, p in enumerate(plan.programs.get("filter", [])):
        kept = programs.Program(p, f"filter{i}").over_paths(kept)
    limit = plan.options.path_limit
    if limit is not None and kept.limit(limit + 1).count() > limit:
        notices.add("path_limit")
    top = walk.ranked(kept, limit)
    returned = walk.returned_claims(top).orderBy("claim_id") if plan.returns["claims"] else None
    explain = None
    if plan.returns["explain"]:
        explain = {"counters": done.counters | {"unique_traversed": walk.returned_claims(done.every).count(), "returned_paths": top.count()}, "plan": plan.digest()}
    evidence = None
    if plan.returns["evidence"]:
        evidence = documents.hydrate(bundles.path_sources(walk.returned_claims(top)), sources)
        if evidence.where("outcome <> 'verified'").limit(1).count():
            notices.add("evidence_unavailable")
    footprint = None
    if authority is not None:
        footprint = policy.dependencies(walk.returned_claims(top), authority.classified).select("resource", "property").distinct()
    result = Result(top, returned, sorted(notices | done.notices), seeds, explain, evidence, footprint)
    result.authority = state
    return result


def _check_terms(plan: Plan, authority: policy.Authority, spark) -> None:
    """What a query's terms mean must be visible too: one that asks by a hidden class or property fails, rather than finding nothing."""
    terms = sorted({t[2] for t in plan.options.predicates + plan.options.filters if t[1] in predicates.ONTOLOGY})
    if terms:
        asked = spark.createDataFrame([(t, "vocabulary") for t in terms], "resource string, property string")
        hidden = policy.decide(asked, authority.rules, authority.classes).where(~F.coalesce("allowed", F.lit(False))).select("resource").limit(1).collect()
        if hidden:
            raise PlanError("denied", "a term that the query asks by")
