"""Recording an execution and replaying it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.plans.compile import Plan
from claimloom.plans.run import execute

#: From the strongest to the weakest.
VERDICTS = ("reproduced", "best_effort", "diverged", "not_replayable")


def record(plan: Plan, claims: DataFrame, catalog: DataFrame, snapshot: str | None) -> dict:
    """What a replay needs: plan, seeds, snapshot and the digest of the result."""
    result = execute(plan, claims, catalog)
    seeds = [r.asDict() for r in result.seeds.orderBy("block", "seed_rank").collect()]  # seed_limit rows a block
    return {"plan": plan, "plan_hash": plan.digest(), "snapshot": snapshot, "seeds": seeds, "response_hash": result.digest()}


def replay(recorded: dict, claims: DataFrame, catalog: DataFrame, snapshot: str | None) -> str:
    """Run a recorded plan again from its recorded seeds and compare digests."""
    if recorded["plan"].digest() != recorded["plan_hash"] or recorded["snapshot"] is None:
        return "not_replayable"
    landed = catalog.sparkSession.createDataFrame([(s["block"], "from", s["id"], s["score"], 0) for s in recorded["seeds"]], "block int, role string, id string, score long, anchor_idx int")
    same = execute(recorded["plan"], claims, catalog, landed).digest() == recorded["response_hash"]
    if not same:
        return "diverged"
    return "reproduced" if snapshot == recorded["snapshot"] else "best_effort"


def weakest(verdict: Column) -> Column:
    """An aggregate: the weakest of verdicts."""
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict)
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.max(rank).cast("int"))
