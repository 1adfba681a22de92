"""Mixed-type clustering: planted clusters, falling cost, exact silhouette, stores."""

import random

import pytest
from pyspark.sql import functions as F

from usage_ts.functions import mixed
from usage_ts.operators import clustering as CL
from usage_ts.plans import jobs
from usage_ts.sources import store
from usage_ts.sources.layout import Layout

NUM, CAT = ["x", "y"], ["c", "e"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        g = i % 3
        rows.append((i, g, rng.gauss(4 * g, 0.4), rng.gauss(-3 * g, 0.4), "abc"[g], rng.choice("uv")))
    return spark.createDataFrame(rows, "account int, truth int, x double, y double, c string, e string").persist()


def brute_silhouette(rows, gamma):
    def d(a, b):
        return sum((a[n] - b[n]) ** 2 for n in NUM) + gamma * sum(a[n] != b[n] for n in CAT)

    out = {}
    for a in rows:
        groups = {}
        for b in rows:
            if b["account"] != a["account"]:
                groups.setdefault(b["label"], []).append(d(a, b))
        own = groups.pop(a["label"], None)
        if not own:
            out[a["account"]] = 0.0
            continue
        inner, outer = sum(own) / len(own), min(sum(v) / len(v) for v in groups.values())
        out[a["account"]] = (outer - inner) / max(inner, outer)
    return out


def test_planted_clusters_are_found_and_cost_falls(points):
    found = CL.k_prototypes(points, 3, NUM, CAT, runs=4, seed=1)
    assert sorted(found.sizes) == [100, 100, 100]
    assert all(b <= a + 1e-9 for a, b in zip(found.costs, found.costs[1:]))
    pairs = found.assign(points).groupBy("truth").agg(F.countDistinct("label").alias("n")).collect()
    assert all(r.n == 1 for r in pairs)
    again = CL.k_prototypes(points, 3, NUM, CAT, runs=4, seed=1)
    assert again.costs == found.costs


def test_cost_is_the_distance_to_the_nearest_centroid(points):
    cents = [CL.Centroid([0.0, 0.0], ["a", "u"]), CL.Centroid([4.0, -3.0], ["b", None])]
    for r in CL.assign(points, cents, NUM, CAT, 0.7).limit(50).collect():
        ds = [
            (r.x - c.numeric[0]) ** 2 + (r.y - c.numeric[1]) ** 2 + 0.7 * ((r.c != c.categorical[0]) + (r.e != c.categorical[1]))
            for c in cents
        ]
        assert r.cost == pytest.approx(min(ds)) and r.label == ds.index(min(ds))


def test_distance_between_two_columns_sets(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", "b"), (0.0, 0.0, None, None)], "x double, y double, c string, e string")
    text = mixed.mixed_distance((["`x`"], ["`y`"]), (["`c`"], ["`e`"]), 0.5)
    assert [r[0] for r in df.select(F.expr(text)).collect()] == [1.5, 0.0]


def test_more_starts_than_one_pass_holds(points):
    found = CL.k_prototypes(points, 6, NUM, CAT, runs=5, max_iter=2)
    assert len(found.centroids) == 6 and sum(found.sizes) == 300


def test_empty_cluster_is_reseeded(points):
    far = CL.Centroid([1e6, 1e6], ["z", "z"])
    start = [CL.Centroid([0.0, 0.0], ["a", "u"]), CL.Centroid([8.0, -6.0], ["c", "u"]), far]
    found = CL.k_prototypes(points, 3, NUM, CAT, starts=[start], max_iter=15)
    assert min(found.sizes) > 0


def test_cost_and_sizes_are_those_of_the_returned_centroids(points):
    for limit in (2, None):
        found = CL.k_prototypes(points, 8, NUM, CAT, runs=3, max_iter=limit)
        rows = found.assign(points).groupBy("label").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).collect()
        assert sum(r.cost for r in rows) == pytest.approx(found.cost)
        assert {r.label: r.n for r in rows} == {i: n for i, n in enumerate(found.sizes) if n}
        assert found.converged == (limit is None)


def test_settled_centroids_are_a_fixed_point(points):
    found = CL.k_prototypes(points, 4, NUM, CAT, tolerance=1e-12)
    labelled = found.assign(points)
    for r in CL.numeric_update(labelled, ["label"], NUM).collect():
        assert [r[c] for c in NUM] == pytest.approx(found.centroids[r.label].numeric)
    for r in CL.category_update(labelled, ["label"], CAT).collect():
        assert found.centroids[r.label].categorical[CAT.index(r.feature)] == r.value


def test_runs_may_share_start_rows(points):
    few = points.orderBy("account").limit(9)
    assert len(CL.seed_centroids(few, 4, 15, NUM, CAT, "account", 0)) == 15


def test_null_categories_and_no_categories(spark):
    df = spark.createDataFrame([(i, float(i % 2), None if i % 2 else "a") for i in range(20)], "account int, x double, c string")
    assert sorted(CL.k_prototypes(df, 2, ["x"], ["c"], runs=4).sizes) == [10, 10]
    assert sorted(CL.k_prototypes(df, 2, ["x"], [], runs=4).sizes) == [10, 10]


def test_too_few_points(points):
    with pytest.raises(ValueError):
        CL.k_prototypes(points.limit(2), 3, NUM, CAT)


def test_silhouette_equals_brute_force(points):
    cents = [CL.Centroid([0.0, 0.0], ["a", "u"]), CL.Centroid([4.0, -3.0], ["b", "v"]), CL.Centroid([99.0, 99.0], ["q", "q"])]
    labelled = CL.assign(points, cents, NUM, CAT, 0.5)
    single = labelled.withColumn("label", F.when(F.col("account") == 0, 2).otherwise(F.col("label"))).persist()
    want = brute_silhouette([r.asDict() for r in single.collect()], 0.5)
    got = {r.account: r.silhouette for r in CL.silhouette_rows(single, NUM, CAT, 0.5).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_best_k_finds_three(points):
    t = {r.k: r for r in CL.best_k(points, range(2, 6), NUM, CAT, runs=4, seed=2).collect()}
    assert [k for k, r in t.items() if r.is_best] == [3]


def test_no_pairs_are_formed(points):
    cents = [CL.Centroid([0.0, 0.0], ["a", "u"]), CL.Centroid([4.0, -3.0], ["b", "v"])]
    rows = CL.silhouette_rows(CL.assign(points, cents, NUM, CAT, 0.5), NUM, CAT, 0.5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_client_job(spark):
    layout = Layout(numeric=("PARCEL_AREA",), boolean=("S90MT",), categorical=("METER_SIZE",), not_clustered=())
    months = {f"CONS_{m}m_ago": F.col("id") % 5 + m for m in range(12)}
    profiles = spark.range(60).select(
        F.col("id").alias("CONTRACT_ACCOUNT"),
        (F.col("id") % 2 * 10.0).alias("PARCEL_AREA"),
        (F.col("id") % 2 * 1.0).alias("S90MT"),
        F.when(F.col("id") % 2 == 0, "M1").otherwise("M2").alias("METER_SIZE"),
        *[c.cast("double").alias(n) for n, c in months.items()],
    )
    members, report, found = jobs.cluster_clients(profiles, 2, layout, runs=3)
    assert members.count() == 60 and {r.cluster for r in members.collect()} <= {1, 2}
    assert sum(r.percent for r in report.collect()) == pytest.approx(100)
    assert set(r.METER_SIZE for r in report.collect()) <= {"M1", "M2"}
    sweep = jobs.sweep_clusters(profiles, 2, 3, layout, runs=2)
    assert sweep.filter("is_best").count() == 1


def test_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    built = []

    def build():
        built.append(1)
        return spark.range(4).withColumn("g", F.col("id") % 2)

    assert store.read_or_build(spark, path, build).count() == 4
    assert store.read_or_build(spark, path, build).count() == 4 and built == [1]
    store.write_table(spark.range(6).withColumn("g", F.col("id") % 2), str(tmp_path / "p"), ["g"])
    assert (tmp_path / "p" / "g=0").exists() and spark.read.parquet(str(tmp_path / "p")).count() == 6
    for run, n in (("r1", 3), ("r2", 5), ("r1", 2)):
        store.append_run(spark.range(n), str(tmp_path / "runs"), run)
    counts = {r.run_id: r["count"] for r in spark.read.parquet(str(tmp_path / "runs")).groupBy("run_id").count().collect()}
    assert counts == {"r1": 2, "r2": 5}
    run = jobs.save_run({"metrics": spark.range(2)}, str(tmp_path / "all"), "r9")
    assert run == "r9" and spark.read.parquet(str(tmp_path / "all" / "metrics")).count() == 2


def test_months_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "m")
    days = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2020-03-31')) AS d, 1 AS v")
    store.write_by_month(days, path)
    store.write_by_month(days.filter("d >= '2020-03-01'").withColumn("v", F.lit(2)), path)
    got = {r.month: (r.n, r.v) for r in spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.max("v").alias("v")).collect()}
    assert got == {"2020-01": (31, 1), "2020-02": (29, 1), "2020-03": (31, 2)}


def test_text_sinks(spark, tmp_path):
    store.write_csv(spark.range(3), str(tmp_path / "c"))
    assert store.read_csv_table(spark, str(tmp_path / "c"), "id long").count() == 3
    store.write_json(spark.range(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
