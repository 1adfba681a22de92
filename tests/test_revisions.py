"""Daily sums revised by changed records against a complete rebuild."""

import datetime as dt
import random

from pyspark.sql import functions as F

from usage_ts.operators import intervals, revisions
from usage_ts.plans import jobs
from usage_ts.sources.layout import Layout

LAYOUT = Layout()
D0 = dt.date(2015, 1, 1)


def records(spark, rows):
    """(class, first day, days, quantity) as clean records of the default layout."""
    kinds = {LAYOUT.start: "date", LAYOUT.end: "date", LAYOUT.value: "double", LAYOUT.rate_class: "string"}
    out = []
    for i, (kind, first, days, quantity) in enumerate(rows):
        start = D0 + dt.timedelta(days=first)
        known = {LAYOUT.start: start, LAYOUT.end: start + dt.timedelta(days=days - 1), LAYOUT.value: float(quantity), LAYOUT.rate_class: kind}
        row = []
        for c in LAYOUT.columns:
            number = float(i % 5) if c in LAYOUT.numeric else i % 2 if c in LAYOUT.boolean else f"v{i % 3}"
            row.append(known.get(c, number))
        out.append(tuple(row))
    types = [f"`{c}` {kinds.get(c, 'double' if c in LAYOUT.numeric else 'int' if c in LAYOUT.boolean else 'string')}" for c in LAYOUT.columns]
    return spark.createDataFrame(out, ", ".join(types))


def some(rng, n):
    return [(rng.choice("AB"), rng.randrange(900), rng.randint(1, 60), rng.randint(0, 900)) for _ in range(n)]


def rebuilt(df, by):
    sums = intervals.daily_sums(df, LAYOUT.numeric, LAYOUT.boolean, by, LAYOUT.start, LAYOUT.end, LAYOUT.value)
    return intervals.closed_horizon(intervals.context_of(sums, LAYOUT.numeric, LAYOUT.boolean, by), by)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_revised_table_equals_rebuild(spark, tmp_path):
    rng = random.Random(1)
    kept, gone, added = some(rng, 120), some(rng, 15), some(rng, 15)
    old = records(spark, kept + gone + kept[:4])
    # Revisions of records far more than half a year before the last one, and two copies fewer.
    revised = [(k, a, d, q + 7) for k, a, d, q in kept[:20]] + kept[20:]
    new = records(spark, revised + added)
    by = [LAYOUT.rate_class]
    path = str(tmp_path / "state")
    jobs.daily_state(old, path, LAYOUT, by)
    assert rows_of(jobs.revise_daily(spark, path, old, new, LAYOUT, by)) == rows_of(rebuilt(new, by))
    # Nothing changed: nothing is written.
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    jobs.revise_daily(spark, path, new, new, LAYOUT, by)
    assert stamps == {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}


def test_only_touched_months_are_rewritten(spark, tmp_path):
    rows = [("A", 30 * k, 30, 300) for k in range(24)]
    old = records(spark, rows)
    new = old.withColumn(LAYOUT.value, F.when(F.col(LAYOUT.start) == D0 + dt.timedelta(days=60), 600.0).otherwise(F.col(LAYOUT.value)))
    path = str(tmp_path / "state")
    jobs.daily_state(old, path, LAYOUT, [LAYOUT.rate_class])
    before = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "state").glob("month=*")}
    got = jobs.revise_daily(spark, path, old, new, LAYOUT, [LAYOUT.rate_class])
    after = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "state").glob("month=*")}
    assert {m for m in after if after[m] != before[m]} == {"month=2015-03"}
    assert rows_of(got) == rows_of(rebuilt(new, [LAYOUT.rate_class]))


def test_everything_taken_back(spark):
    old = records(spark, some(random.Random(2), 20))
    delta = intervals.daily_sums(
        revisions.changes(old, old.limit(0), LAYOUT.columns), LAYOUT.numeric, LAYOUT.boolean, [], LAYOUT.start, LAYOUT.end, LAYOUT.value, sign=F.col("sign")
    )
    state = intervals.daily_sums(old, LAYOUT.numeric, LAYOUT.boolean, [], LAYOUT.start, LAYOUT.end, LAYOUT.value)
    left = revisions.merged(state, delta, ["d"])
    assert revisions.touched(left, ["d"]).count() == 0 and revisions.horizon(left).count() == 0
