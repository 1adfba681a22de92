"""The racing search against the full one."""

import json

import numpy as np
import pytest
from test_learning import ar, table

from usage_ts.learning import search


@pytest.fixture(scope="module")
def weeks(spark):
    t = np.arange(260)
    rng = np.random.default_rng(1)
    return table(spark, a=50 + 9 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.3, 260), b=ar([0.7], 260, 2, 40), c=[1.0, 2.0, 3.0])


TRIALS = [{"T_X": w} for w in (1, 2, 7, 2, 3)]


def best(rows):
    return {r.series_key: (r.score, r.params) for r in rows if r.trial == "Best"}


def test_keeping_all_is_the_full_search(weeks):
    full = search.search(weeks, "linear_regression", TRIALS).collect()
    raced = search.race(weeks, "linear_regression", TRIALS, keep=1.0).collect()
    for key, (score, params) in best(full).items():
        got = best(raced)[key]
        assert got[1] == params and got[0] == (pytest.approx(score) if score is not None else None)
    one = {(r.series_key, r.trial): r.score for r in full}
    for r in raced:
        assert r.score is None or r.score == pytest.approx(one[r.series_key, r.trial])
    # Trial 3 repeats trial 1 and is not fitted again.
    assert {r.trial for r in raced} == {"0", "1", "2", "4", "Best"}


def test_few_trials_reach_the_last_fold(weeks):
    rows = search.race(weeks, "linear_regression", TRIALS, keep=0.5).collect()
    ran = sorted(r.folds for r in rows if r.series_key == "a" and r.trial != "Best")
    assert ran == [1, 1, 2, 5]
    full = best(search.search(weeks, "linear_regression", TRIALS).collect())
    assert json.loads(best(rows)["a"][1]) == json.loads(full["a"][1])
    assert best(rows)["c"] == (None, None) and best(rows)["a"][0] == pytest.approx(full["a"][0])


def test_unscored_trials_and_wrong_shares(spark, weeks):
    rows = search.race(weeks, "linear_regression", [{"T_X": 5000}, {"T_X": 3}], keep=0.5).collect()
    assert {json.loads(r.params)["T_X"] for r in rows if r.trial == "Best" and r.params} == {3}
    with pytest.raises(ValueError):
        search.race(weeks, "linear_regression", TRIALS, keep=0)
    assert search.race(weeks.limit(0), "linear_regression", TRIALS).count() == 0
