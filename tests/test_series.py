"""Positional operators and evaluation on hand-made series."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from usage_ts.functions.quantiles import exact_quantiles
from usage_ts.operators import evaluation, series, statistics

D0 = dt.date(2021, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def make(spark, ys, key="s"):
    return spark.createDataFrame([(key, day(i), float(y)) for i, y in enumerate(ys)], "series_key string, ds date, y double")


def values(df, col, order="ds"):
    return [r[col] for r in df.orderBy(order).collect()]


def test_splits(spark):
    s = make(spark, range(11))
    assert values(series.split_fixed(s, 3), "role") == ["train"] * 8 + ["test"] * 3
    assert values(series.split_fixed(s, 0), "role") == ["train"] * 11
    assert values(series.split_fraction(s, 0.1), "role") == ["train"] * 9 + ["test"] * 2
    v = series.split_validation(s, 0.2, context=2)
    assert values(v, "role") == ["train"] * 8 + ["val"] * 3
    assert values(v, "is_context") == [False] * 6 + [True] * 2 + [False] * 3


def test_trim_zero_keeps_all(spark):
    s = make(spark, range(5))
    assert values(series.trim(s, 0, 0), "y") == [0, 1, 2, 3, 4]
    assert values(series.trim(s, 1, 2), "y") == [1, 2]


def test_windows_never_hold_their_own_row_and_jump_over_gaps(spark):
    s = series.drop_ranges(make(spark, range(8)), [(day(3), day(4))])
    w = series.lag_windows(s, 2)
    got = {r.y: r.window for r in w.collect()}
    assert got == {2.0: [0.0, 1.0], 5.0: [1.0, 2.0], 6.0: [2.0, 5.0], 7.0: [5.0, 6.0]}
    assert series.recent_window(s, 2).first().window == [6.0, 7.0]
    assert series.recent_window(s, 9).count() == 0


def test_windows_of_several_features_are_time_major(spark):
    s = make(spark, range(4)).withColumn("z", F.col("y") * 10)
    assert series.lag_windows(s, 2, ["y", "z"]).orderBy("ds").first().window == [0.0, 0.0, 1.0, 10.0]
    assert series.recent_window(s, 2, ["y", "z"]).first().window == [2.0, 20.0, 3.0, 30.0]


def test_gap_table_equals_gap_list(spark):
    s = make(spark, range(10))
    t = spark.createDataFrame([(day(2), day(3)), (day(3), day(5)), (day(9), day(8))], "lo date, hi date")
    a = values(series.drop_ranges_table(s, t), "y")
    assert a == values(series.drop_ranges(s, [(day(2), day(3)), (day(3), day(5))]), "y") == [0, 1, 6, 7, 8, 9]


def test_folds_follow_the_block_rule(spark):
    s = make(spark, range(23))
    folds = series.cv_folds(s, quantiles=4, folds=2).collect()
    by = {}
    for r in folds:
        by.setdefault((r.fold, r.role), []).append(int(r.y))
    # Blocks of 23 // 5 = 4 rows, counted from the end.
    assert sorted(by[(4, "test")]) == [19, 20, 21, 22] and sorted(by[(4, "train")]) == list(range(19))
    assert sorted(by[(3, "test")]) == [15, 16, 17, 18] and sorted(by[(3, "train")]) == list(range(15))
    assert {k[0] for k in by} == {3, 4}
    assert len({r.fold for r in series.cv_folds(s, 4, None).collect()}) == 4


@pytest.mark.parametrize("lag", [1, 7])
def test_difference_and_integrate_are_inverse(spark, lag):
    s = make(spark, [(i * 7919) % 31 for i in range(30)])
    back = series.integrate(series.difference(s, lag=lag), lag=lag)
    assert values(back, "y_back") == values(s, "y")


def test_scale_and_unscale_are_inverse(spark):
    s = make(spark, [1, 2, 3, 4]).unionByName(make(spark, [5, 5, 5], "constant"))
    stats = series.fit_scale(s, ["y"])
    z = series.apply_scale(s, stats, ["y"])
    assert values(z.filter("series_key = 's'"), "y_z")[0] == pytest.approx(-1.5 / math.sqrt(1.25))
    assert set(values(z.filter("series_key = 'constant'"), "y_z")) == {0.0}
    back = series.undo_scale(z, stats, ["y"])
    assert back.filter("abs(y_back - y) > 1e-12").count() == 0


def test_holiday_flags_do_not_multiply_rows(spark):
    s = make(spark, range(5))
    cal = spark.createDataFrame([("a", day(1)), ("b", day(1)), ("b", day(2))], "holiday string, ds date")
    f = series.holiday_flags(s, cal, {"a": "is_a", "b": "is_b"})
    assert values(f, "is_a") == [0, 1, 1, 0, 0] and values(f, "is_b") == [0, 1, 1, 1, 0]


def test_future_dates(spark):
    s = make(spark, range(3))
    assert values(series.future_spine(s, 2), "ds") == [day(3), day(4)]
    assert series.future_spine(s, 2, include_history=True).count() == 5


def test_metrics_bands_and_null_rules(spark):
    rows = [
        ("m", day(0), 10.0, 8.0, None), ("m", day(1), 10.0, 11.0, None),
        ("m", day(2), 10.0, None, 8.0), ("m", day(3), 0.0, None, 1.0), ("m", day(4), 20.0, None, 25.0),
    ]
    e = spark.createDataFrame(rows, "series_key string, ds date, gt double, model double, forecast double")
    m = evaluation.forecast_metrics(e).first()
    assert (m.residuals_mean, m.error_mean, m.MAE, m.MSE, m.zero_actuals) == (0.5, -4 / 3, 8 / 3, 10.0, 1)
    assert m.MAPE == pytest.approx((0.2 + 0.25) / 2) and m.RMSE == pytest.approx(math.sqrt(10))
    b = {r.ds: r for r in evaluation.forecast_bands(e).collect()}
    assert b[day(2)].conf_int_up == pytest.approx(8 + 1.96 * m.residuals_std)
    assert b[day(2)].pred_int_low == pytest.approx(8 - 1.96 * m.error_std)
    assert b[day(0)].conf_int_low is None and b[day(3)].error_pct is None


def test_fold_summary_rows(spark):
    m = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 4.0)], "series_key string, fold int, MAE double")
    got = {r.fold: r.MAE for r in evaluation.fold_summary(m, names=["MAE"]).collect()}
    assert got == {"1": 2.0, "2": 4.0, "mean": 3.0, "std": pytest.approx(math.sqrt(2))}


def test_quantiles_equal_percentile_also_for_hot_values(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 2 == 0, F.lit(5.0)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(
            F.exp(((F.col("id") * 7919) % 5003) / 700.0)
        ).alias("v"),
    )
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.quantile for r in exact_quantiles(df, ["g"], "v", probs, stretches=16).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    assert len(got) == len(want) * len(probs)
    for r in want:
        for p, q in zip(probs, r.q):
            assert got[(r.g, p)] == pytest.approx(q, rel=1e-12)


def test_box_and_density(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 100]] + [(None, 7.0)], "c string, x double")
    box = {r.category: r for r in statistics.box_stats(df, ["c"], "x").collect()}
    assert (box["a"].q1, box["a"].median, box["a"].q3, box["a"].whisker_low, box["a"].whisker_high, box["a"].outliers) == (2, 3, 4, 1, 4, 1)
    assert box["MISSING"].n == 1
    bins = statistics.histogram(df, [], "x", 0.0, 0.5)
    d = statistics.density(bins, [], 0.0, 0.5, 1.0)
    assert d.agg(F.sum("density")).first()[0] * 0.5 == pytest.approx(1.0, abs=1e-3)


def test_feature_histograms_cover_every_value(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(11)] + [(None, None)], "a double, b double")
    h = statistics.feature_histograms(df, ["a", "b"], 5).collect()
    assert {(r.feature, r.bin): r.n for r in h} == {("a", 0): 2, ("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("a", 4): 3, ("b", 0): 11}
    with pytest.raises(ValueError):
        statistics.feature_histograms(df.filter("a < 0"), ["a"])
