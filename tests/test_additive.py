"""Additive model: planted trend changes, optimality, short series."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learning import table

from usage_ts.learning import additive, search
from usage_ts.learning import forecasters as FC

DAYS = 1500


def blocks(n):
    t, day = np.arange(n) / max(n - 1, 1), np.arange(n) + 17_532
    hinges = [np.maximum(t - 0.8 * j / additive.CHANGEPOINTS, 0) for j in range(1, additive.CHANGEPOINTS + 1)]
    wave = lambda period, k: np.column_stack([f(2 * np.pi * i * day / period) for i in range(1, k + 1) for f in (np.sin, np.cos)])
    return {
        "trend": np.column_stack([np.ones(n), t, *hinges]),
        "yearly": wave(365.25, 10),
        "weekly": wave(7, 3),
        "holidays": np.empty((n, 0)),
    }


def planted(noise=0.005):
    """Changes at the fifth and fifteenth place only."""
    x = blocks(DAYS)
    y = x["trend"] @ np.concatenate([[0.2, 1.0], np.eye(25)[4] * -2.0 + np.eye(25)[14] * 1.8]) + 0.1 * x["weekly"][:, 0]
    return x, y + np.random.default_rng(4).normal(size=DAYS) * noise


def params(mode, tau=0.02):
    return {**additive.DEFAULTS, "SEASONALITY_MODE": mode, "CHANGEPOINT_PRIOR_SCALE": tau, "SEASONALITY_PRIOR_SCALE": 1.0}


def objective(x, y, p, noise, coef):
    season = sum(x[b] @ coef[b] for b in additive.BLOCKS[1:])
    level = x["trend"] @ coef["trend"]
    rest = y - (level * (1 + season) if p["SEASONALITY_MODE"] == "multiplicative" else level + season)
    ridge = sum(np.sum(coef[b] ** 2) for b in additive.BLOCKS[1:]) / p["SEASONALITY_PRIOR_SCALE"] ** 2
    return rest @ rest / 2 + noise * (ridge / 2 + np.abs(coef["trend"][2:]).sum() / p["CHANGEPOINT_PRIOR_SCALE"])


def test_planted_changes_are_found_and_few_others():
    x, y = planted()
    coef, _ = additive.solve(x, y, params("additive"))
    changes = coef["trend"][2:]
    assert changes[[4, 14]] == pytest.approx([-2.0, 1.8], abs=0.15)
    assert np.sum(np.abs(np.delete(changes, [4, 14]))) < 0.2
    assert np.sum(changes == 0) >= 12


def test_a_strong_prior_leaves_a_line():
    x, y = planted()
    coef, _ = additive.solve(x, y, params("additive", 1e-9))
    assert not coef["trend"][2:].any()


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
@pytest.mark.parametrize("tau", [0.001, 0.02, 1.0])
def test_no_step_is_better(mode, tau):
    """Neither along a coefficient nor in a random direction."""
    x, y = planted(0.02)
    p = params(mode, tau)
    coef, noise = additive.solve(x, y, p)
    best, rng = objective(x, y, p, noise, coef), np.random.default_rng(0)
    for b in additive.BLOCKS[:3]:
        for i in range(len(coef[b]) + 20):
            step = np.eye(len(coef[b]))[i] if i < len(coef[b]) else rng.normal(size=len(coef[b]))
            for size in (1e-2, -1e-2, 1e-3, -1e-3):
                assert objective(x, y, p, noise, {**coef, b: coef[b] + size * step}) > best * (1 - 1e-9)


def test_priced_changes_equal_plain_coordinate_descent():
    rng = np.random.default_rng(6)
    x = np.maximum(np.linspace(0, 1, 200)[:, None] - np.linspace(0.1, 0.9, 8), 0)
    y = x @ np.array([0, 3, 0, 0, -4, 0, 0, 1.0]) + rng.normal(size=200) * 0.1
    gram, product, price = x.T @ x, x.T @ y, 0.3
    b = np.zeros(8)
    for _ in range(200_000 // 8):
        for j in range(8):
            free = product[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(free) * max(abs(free) - price, 0) / gram[j, j]
    assert additive.sparse_changes(gram, product, price) == pytest.approx(b, abs=1e-3)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_constant_zero_and_straight_series(mode):
    for y in (np.zeros(40), np.full(40, 0.7), np.arange(40) / 40, np.array([0.0, 1.0])):
        x = blocks(len(y))
        coef, _ = additive.solve(x, y, params(mode))
        assert x["trend"] @ coef["trend"] == pytest.approx(y, abs=1e-6)


def test_one_day_and_empty_series_keep_their_rows(spark):
    s = table(spark, one=[5.0], long=[float(i % 7 + i) for i in range(60)], holes=[1.0, None, 3.0, 4.0], none=[None, None])
    s = s.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    models = FC.fit_models(FC.with_params(s, "additive"), "additive")
    fitted = {r.series_key: r.b_trend is not None for r in models.collect()}
    assert fitted == {"one": False, "long": True, "holes": True}
    ahead = FC.forecast(models, 4, model="additive")
    found = {r.series_key: (r.n, r.known) for r in ahead.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.count("yhat").alias("known")).collect()}
    assert found == {"one": (4, 0), "long": (4, 4), "holes": (4, 4)}
    parts = additive.components(s.withColumn("params", F.lit(None)), models.drop("model"))
    assert parts.count() == 67 and parts.filter("series_key = 'none' AND yhat IS NOT NULL").count() == 0
    assert additive.seasonality_parameters(models).count() == 6


def test_one_day_of_training_scores_nulls(spark):
    s = table(spark, one=[5.0, 6.0, 7.0], long=[float(i % 7 + i) for i in range(60)])
    split = s.withColumn("role", F.when((F.col("series_key") == "one") & (F.dayofmonth("ds") > 1), "test").otherwise("train"))
    split = split.withColumn("role", F.when((F.col("series_key") == "long") & (F.col("y") > 50), "test").otherwise(F.col("role")))
    board = {r.series_key: r.MAE for r in search.evaluate_all(split, {"additive": None}).collect()}
    assert set(board) == {"one", "long"} and board["one"] is None and board["long"] is not None


def test_a_null_key_is_a_series(spark):
    s = table(spark, a=[float(i % 7 + i) for i in range(60)])
    both = s.unionByName(s.withColumn("series_key", F.lit(None).cast("string")))
    models = FC.fit_models(FC.with_params(both, "additive"), "additive")
    ahead = FC.forecast(models, 5, model="additive").groupBy("series_key").agg(F.collect_list("yhat").alias("y")).collect()
    got = {r.series_key: sorted(r.y) for r in ahead}
    assert set(got) == {"a", None} and len(got["a"]) == 5 and got["a"] == pytest.approx(got[None])
