"""Series too short for cross-validation keep a row."""

import datetime as dt

from usage_ts.learning import search


def series(spark):
    day = dt.date(2020, 1, 1)
    rows = [("long", day + dt.timedelta(i), float(i % 7 + i)) for i in range(120)]
    rows += [(k, day + dt.timedelta(i), float(i)) for k in ("short", None) for i in range(3)]
    return spark.createDataFrame(rows, "series_key string, ds date, y double")


def test_search_keeps_short_series(spark):
    rows = search.search(series(spark), "linear_regression", [{"T_X": 2}], quantiles=10).collect()
    best = {r["series_key"]: r for r in rows if r["trial"] == "Best"}
    assert set(best) == {"long", "short", None} and len(rows) == 4
    assert best["long"]["score"] is not None
    assert best["short"]["score"] is None and best["short"]["params"] is None


def test_cross_validate_keeps_short_series(spark):
    rows = search.cross_validate(series(spark), "linear_regression", {"T_X": 2}).collect()
    assert sorted(str(r["series_key"]) for r in rows) == ["None", *["long"] * 5, "short"]
    assert all((r["fold"] is None) == (r["MAE"] is None) == (r["series_key"] != "long") for r in rows)
