"""The settled clustering queries return a fixed point: one more update moves nothing."""

import math

import numpy as np
import pytest

from usage_ts.operators import clustering as CL
from usage_ts.plans import clusters as P

SF = "/root/testdata/sf0.001"


def test_settled_queries_are_a_fixed_point(spark):
    _, _, points, found = P.clustered(spark, SF, until=P.SETTLED)
    assert found.converged and found.iterations > P.ITERATIONS + 1
    labelled = found.assign(points)
    for r in CL.numeric_update(labelled, ["label"], P.NUMERIC).collect():
        assert all(math.isclose(r[c], v, abs_tol=1e-9) for c, v in zip(P.NUMERIC, found.centroids[r["label"]].numeric))
    for r in CL.category_update(labelled, ["label"], P.CATEGORICAL).collect():
        assert found.centroids[r["label"]].categorical[P.CATEGORICAL.index(r["feature"])] == r["value"]
    labels = {r["account"]: r["label"] for r in labelled.collect()}
    scores = P.silhouette_settled(spark, SF).collect()
    assert {r["account"]: r["label"] for r in scores} == labels
    shares = {r["label"]: r["n"] for r in P.cluster_shares_settled(spark, SF).collect()}
    assert shares == dict(enumerate(found.sizes))


def test_restarts_run_until_the_cost_stands(spark):
    costs = [r["cost"] for r in P.kprototypes_restarts(spark, SF).orderBy("iteration").collect()]
    assert costs[-2] - costs[-1] <= 1e-6 * costs[-1]


def _mixed_points(spark, parts):
    rows = [(i, float(i % 7), float(i * i % 11), None if i % 5 == 0 else "ab"[i % 2], str(i % 3)) for i in range(600)]
    points = spark.createDataFrame(rows, "account long, x double, y double, c string, d string").repartition(parts, "account").persist()
    starts = [[CL.Centroid([float(r[1]), float(r[2])], [r[3], r[4]]) for r in rows[:k]] for k in (2, 4)]
    return points, starts


def test_an_iteration_starts_few_tasks_for_few_points(spark):
    points, starts = _mixed_points(spark, 64)
    points.count()
    context = spark.sparkContext
    context.setJobGroup("few-tasks", "few points in many partitions")
    found = CL.k_prototypes_runs(points, starts, ["x", "y"], ["c", "d"], 0.5, 6, -1.0)
    context.setJobGroup("", "")
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    known = [i for i in map(tracker.getStageInfo, stages) if i]
    assert [f.iterations for f in found] == [6, 6] and known
    assert sum(i.numTasks for i in known) < 6 * 64


def test_sums_added_by_shuffles_and_on_the_driver_agree(spark, monkeypatch):
    points, starts = _mixed_points(spark, 8)
    run = lambda: CL.k_prototypes_runs(points, [list(s) for s in starts], ["x", "y"], ["c", "d"], 0.5, 5, -1.0)
    driver = run()
    monkeypatch.setattr(CL, "DRIVER_ROWS", 0)
    monkeypatch.setattr(CL, "HELD_COUNTS", 3)
    for a, b in zip(driver, run(), strict=True):
        assert a.sizes == b.sizes and math.isclose(a.cost, b.cost, rel_tol=1e-12)
        for x, y in zip(a.centroids, b.centroids, strict=True):
            assert x.categorical == y.categorical
            assert all(math.isclose(v, w, abs_tol=1e-12) for v, w in zip(x.numeric, y.numeric, strict=True))


def test_tasks_of_a_pass():
    assert [CL.pass_tasks(n, 12) for n in (0, 9_000, 90_000, 1_000_000, 5_400_000)] == [1, 1, 9, 12, 24]


def _scattered(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *(rng.normal(size=2) + 2 * (i % 3)).tolist(), None if i % 9 == 0 else "ab"[i % 2], str(i % 4)) for i in range(3000)]
    rows += [(3000 + i, 1.0, 1.0, "a", "0") for i in range(50)] + [(4000, 50.0, 50.0, "z", None)]
    points = spark.createDataFrame(rows, "account long, x double, y double, c string, d string").repartition(4, "account").persist()
    starts = [[CL.Centroid(list(r[1:3]), list(r[3:])) for r in rows[:k]] for k in (1, 3, 6)]
    return points, [*starts, [starts[1][0]] * 2 + [CL.Centroid([900.0, 900.0], ["a", "0"])]]


def test_passes_that_look_at_few_points_end_as_full_passes_do(spark, monkeypatch):
    points, starts = _scattered(spark)
    shares = []
    update = CL._Bounds.updates

    def noted(self, found, live):
        out = update(self, found, live)
        shares.append((self.looked, sum(m["size"] for m in out[0].values()) == len(live) * 3051))
        return out

    monkeypatch.setattr(CL._Bounds, "updates", noted)
    run = lambda: CL.k_prototypes_runs(points, [list(s) for s in starts], ["x", "y"], ["c", "d"], 0.5, None, 1e-12)
    few = run()
    assert all(whole for _, whole in shares) and sum(0 < s <= CL.LOOKED_AT for s, _ in shares) > len(shares) / 2
    monkeypatch.setattr(CL, "DRIVER_ROWS", 0)
    for a, b in zip(few, run(), strict=True):
        assert a.converged and b.converged and a.iterations == b.iterations and a.sizes == b.sizes
        assert a.costs == [math.isclose(x, y, rel_tol=1e-12) and x for x, y in zip(a.costs, b.costs, strict=True)]
        for x, y in zip(a.centroids, b.centroids, strict=True):
            assert x.categorical == y.categorical
            assert all(math.isclose(v, w, abs_tol=1e-9) for v, w in zip(x.numeric, y.numeric, strict=True))


def test_scores_of_all_clusterings_come_from_two_passes(spark, monkeypatch):
    points, starts = _scattered(spark)
    lone = [[starts[1][0], starts[1][1], CL.Centroid([50.0, 50.0], ["z", None]), CL.Centroid([900.0, 900.0], ["a", None])]]
    found = [CL.Clustering(s, [0] * len(s), 0.0, 0.5, 0, ["x", "y"], ["c", "d"]) for s in [*starts[1:], *lone]]
    of = [CL.silhouette(f.assign(points), ["x", "y"], ["c", "d"], 0.5).first()["silhouette"] for f in found]
    monkeypatch.setattr(CL, "silhouette", None)
    assert CL.silhouettes(points, found) == [pytest.approx(s, abs=1e-12) for s in of]


def test_a_date_filter_goes_below_the_shuffle_of_the_lines(spark):
    plan = P.profiles(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert ">= 1999-09-17" in plan[plan.index("Exchange hashpartitioning(l_orderkey") :]
