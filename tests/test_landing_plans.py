"""Landing moves and writes what an anchor meets, not every label."""

from claimloom.operators import landing
from claimloom.plans.compile import compile_query
from claimloom.plans.run import execute


def _moved(spark, f):
    """f's result and the shuffle records that its jobs wrote."""
    store, group = spark.sparkContext._jsc.sc().statusStore(), f"moved-{id(f)}"
    spark.sparkContext.setJobGroup(group, "landing")
    try:
        got = f()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    tracker, n = spark.sparkContext.statusTracker(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            n += store.lastStageAttempt(stage).shuffleWriteRecords()
    return got, n


def test_labels_without_a_shared_token_stay(spark):
    """Repeated labels and ids count once, and 20,000 labels that no anchor meets aren't shuffled."""
    rows = spark.range(20_000).selectExpr("concat('x:', id) as id", "concat('part ', id) as label")
    met = spark.createDataFrame([("a", "blue ring"), ("a", "blue ring"), ("a", "ring"), ("b", "blue"), ("a", None)], "id string, label string")
    asked = landing.anchors_frame(spark, [{"from": ["blue ring 7z", "x:5"]}])
    for found, want in ((landing.token_overlap, {"a": 2, "b": 1, "x:5": 5}), (landing.exact, {"x:5": 1})):
        got, moved = _moved(spark, lambda: {r["id"]: r["score"] for r in found(asked, rows.unionByName(met)).collect()})  # noqa: B023
        assert {k: v for k, v in got.items() if k in want} == want
        assert moved < 1000


def test_seeds_are_the_first_of_many(spark):
    """An anchor that every label shares: only as many rows as the limit asks for meet in a task, and the notice stays."""
    labels = spark.range(20_000).selectExpr("concat('x:', lpad(id, 6, '0')) as id", "concat('part ', id) as label")
    claims = spark.createDataFrame([("k", "x:000001", "next", "iri", "x:000002", 2, None)], "claim_id string, subject_id string, relation string, object_kind string, object_id string, grounding int, transaction_time timestamp").selectExpr("*", "cast(1 as decimal(5, 2)) as confidence")
    plan = compile_query({"about": [{"from": ["part"], "match": "approximate"}], "bounds": {"max_depth": 1}}, capabilities=frozenset({"lexical"}))
    result = execute(plan, claims, labels)
    assert [r["id"] for r in result.seeds.orderBy("seed_rank").collect()] == ["x:000000", "x:000001"] and "seed_limit" in result.notices
    assert [r["ids"] for r in result.paths.collect()] == [["k"]]
    assert "Window" not in result.seeds._jdf.queryExecution().executedPlan().toString()
