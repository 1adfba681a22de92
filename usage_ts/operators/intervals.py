"""Interval records to daily figures.

Two strategies with equal results:

``delta``
    A record adds its amounts on its first day and takes them away on the day
    after its last. The two marks per record are summed per day below the
    shuffle, then a running sum goes over the small daily table. Work per
    record does not depend on the length of its interval.
``explode``
    A record is copied to each of its days, and days are aggregated. Rows grow
    by the interval length, yet any aggregate can be used.

Amounts are fixed-point, so sums do not depend on the order of addition and a
running sum returns to exactly zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usage_ts.functions import columns as C
from usage_ts.operators import joins

EXACT = "decimal(20,8)"
EXACT_SQUARE = "decimal(38,13)"


def _valid(df: DataFrame, start: str, end: str) -> DataFrame:
    """Records with a readable, non-negative interval; pushed down to the scan."""
    return df.filter(F.col(end) >= F.col(start))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    amounts: Mapping[str, Column],
    start: str = "start_d",
    end: str = "end_d",
    day: str = "d",
    first_day=None,
    sign: Column | None = None,
    until: str | None = None,
) -> DataFrame:
    """Every day from the first start to the last end of each group, with totals over active records.

    Output: ``by``, ``day``, ``n`` and one column per amount; days without an
    active record are present with zeros. Null amounts count as zero.
    ``first_day`` cuts the history: earlier days are not produced. ``sign`` is 1
    for a record to count and -1 for one to take back. With ``until`` days of one
    level stay one row, from ``day`` up to the day ``until``.
    """
    records = _valid(df, start, end)
    opening = F.col(start)
    if first_day is not None:
        cut = F.lit(first_day).cast("date")
        records = records.filter(F.col(end) >= cut)
        opening = F.greatest(opening, cut)
    names = list(amounts)
    plus, minus = F.lit(1) if sign is None else sign, F.lit(-1) if sign is None else -sign
    marks = records.select(
        *by,
        *[a.alias(name) for name, a in amounts.items()],
        F.explode(
            F.array(
                F.struct(opening.alias("day"), plus.cast("int").alias("sign")),
                F.struct(F.date_add(end, 1).alias("day"), minus.cast("int").alias("sign")),
            )
        ).alias("m"),
    )
    changes = marks.groupBy(*by, F.col("m.day").alias(day)).agg(
        F.sum(F.col("m.sign")).alias("n"),
        *[F.sum(F.when(F.col("m.sign") > 0, F.col(c)).otherwise(-F.col(c))).alias(c) for c in names],
    )
    by_day = Window.partitionBy(*by).orderBy(day) if by else Window.orderBy(day)
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = changes.select(
        *by,
        day,
        F.sum("n").over(so_far).alias("n"),
        *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in names],
        F.lead(day).over(by_day).alias("_next"),
    )
    held = levels.filter(F.col("_next").isNotNull())
    if until:
        return held.select(*by, day, F.date_sub("_next", 1).alias(until), "n", *names)
    return held.select(
        *by,
        F.explode(F.sequence(F.col(day), F.date_sub("_next", 1))).alias(day),
        "n",
        *names,
    )


def on_each_day(
    df: DataFrame,
    start: str = "start_d",
    end: str = "end_d",
    day: str = "d",
    first_day=None,
) -> DataFrame:
    """J1 by copying: each record once per day of its interval."""
    records = _valid(df, start, end)
    opening = F.col(start)
    if first_day is not None:
        cut = F.lit(first_day).cast("date")
        records = records.filter(F.col(end) >= cut)
        opening = F.greatest(opening, cut)
    return records.withColumn(day, F.explode(F.sequence(opening, F.col(end))))


def daily_consumption(
    df: DataFrame,
    by: Sequence[str] = (),
    start: str = "start_d",
    end: str = "end_d",
    value: str = "consumption",
    day: str = "d",
    strategy: str = "delta",
    first_day=None,
    spine: bool = False,
    rejects: bool = False,
    until: str | None = None,
) -> DataFrame:
    """A2: (``by``, day, n, consumption), each record's quantity spread evenly over its days.

    ``spine`` keeps days without an active record as zeros (W1); otherwise
    only days with records are returned. ``rejects`` adds ``n_rejected``, the active
    records that have a quantity, though one beyond the fixed-point types. With
    ``until`` a row stands for all days from ``day`` to that one, so the table
    grows with the records and not with their days.
    """
    rate = C.daily_rate(F.col(value), F.col(start), F.col(end))
    lost = F.col(value).isNotNull() & rate.isNull()
    if strategy == "delta":
        amounts = {"consumption": F.coalesce(rate, F.lit(0))} | ({"n_rejected": lost.cast("int")} if rejects else {})
        days = running_totals(df, by, amounts, start, end, day, first_day, until=until)
        return days if spine else days.filter("n > 0")
    if strategy != "explode":
        raise ValueError(f"unknown strategy {strategy!r}")
    totals = (
        on_each_day(df.withColumns({"_rate": rate, "_lost": lost}), start, end, day, first_day)
        .groupBy(*by, day)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("_rate"), F.lit(0)).alias("consumption"),
            *([F.count_if("_lost").alias("n_rejected")] if rejects else []),
        )
    )
    counted = ["n", "consumption", *(["n_rejected"] if rejects else [])]
    days = with_spine(totals, by, counted, day) if spine else totals
    return days.select(*by, day, F.col(day).alias(until), *counted) if until else days


def with_spine(
    daily: DataFrame, by: Sequence[str], zero: Sequence[str], day: str = "d"
) -> DataFrame:
    """Complete each group's days between its first and last, ``zero`` columns filled with 0.

    The day range comes from the daily table, which is small by then. Each row
    fills the gap up to the next one, so no join is needed.
    """
    by_day = Window.partitionBy(*by).orderBy(day) if by else Window.orderBy(day)
    upto = F.coalesce(F.date_sub(F.lead(day).over(by_day), 1), F.col(day))
    filled = daily.withColumn("_upto", upto).withColumn(
        "_day", F.explode(F.sequence(F.col(day), F.col("_upto")))
    )
    own = F.col("_day") == F.col(day)
    return filled.select(
        *by,
        F.col("_day").alias(day),
        *[
            F.when(own, F.col(c)).otherwise(F.lit(0) if c in zero else F.lit(None)).alias(c)
            for c in daily.columns
            if c not in (*by, day)
        ],
    )


def closed_horizon(daily: DataFrame, by: Sequence[str] = (), day: str = "d") -> DataFrame:
    """A1: drop the last day of each group (the latest end itself is not part of the horizon)."""
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    return (
        daily.withColumn("_last", F.max(day).over(group)).filter(F.col(day) < F.col("_last")).drop("_last")
    )


def daily_by_class(
    df: DataFrame,
    group: str = "rate_class",
    all_label: str = "ALL",
    strategy: str = "delta",
    spine: bool = False,
    **cols,
) -> DataFrame:
    """The daily series of every class and of the whole system, in one pass over the records.

    Records are reduced to (class, day) first; the whole-system rows are then
    grouped from that small table, not from the records.
    """
    day = cols.get("day", "d")
    per_class = daily_consumption(df, [group], strategy=strategy, spine=spine, **cols)
    return (
        per_class.groupingSets([(group, day), (day,)], group, day)
        .agg(
            F.grouping(group).alias("_all"),
            F.sum("n").alias("n"),
            F.sum("consumption").alias("consumption"),
        )
        .select(
            F.when(F.col("_all") == 1, F.lit(all_label)).otherwise(F.col(group)).alias(group),
            day,
            "n",
            "consumption",
        )
    )


def numeric_context(
    df: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    start: str = "start_d",
    end: str = "end_d",
    day: str = "d",
    strategy: str = "delta",
    first_day=None,
) -> DataFrame:
    """A3: mean and sample deviation of each attribute over the records active on a day.

    ``delta`` carries count, sum and sum of squares as fixed-point numbers; the
    attribute keeps eight decimals. For one that needs more, use ``explode``.
    What is beyond the type is left out of its attribute (``reject_counts``).
    """
    if strategy == "explode":
        return (
            on_each_day(df, start, end, day, first_day)
            .groupBy(*by, day)
            .agg(
                F.count(F.lit(1)).alias("n"),
                *[F.avg(f).alias(f"{f}_avg") for f in features],
                *[F.stddev_samp(f).alias(f"{f}_std") for f in features],
            )
        )
    days = running_totals(df, by, moment_amounts(features), start, end, day, first_day).filter("n > 0")
    return days.select(*by, day, "n", *moment_columns(features))


def reject_counts(
    df: DataFrame, numeric: Sequence[str], start: str = "start_d", end: str = "end_d", value: str = "consumption"
) -> DataFrame:
    """One row: records, those with a broken or missing interval, and those whose quantity or attribute does not fit.

    Only values that are there count as rejected; a quantity is judged where the interval is sound.
    """
    sound = F.coalesce(F.col(end) >= F.col(start), F.lit(False))
    lost = F.col(value).isNotNull() & C.daily_rate(F.col(value), F.col(start), F.col(end)).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~sound).alias("no_interval"),
        F.count_if(sound & lost).alias(f"{value}_rejected"),
        *[F.count_if(F.col(f).isNotNull() & F.col(f).try_cast(EXACT).isNull()).alias(f"{f}_rejected") for f in numeric],
    )


def moment_amounts(features: Sequence[str]) -> dict[str, Column]:
    """Count, sum and sum of squares of each attribute, as amounts for a running total."""
    amounts: dict[str, Column] = {}
    for f in features:
        exact = F.col(f).try_cast(EXACT)
        amounts[f"_c_{f}"] = exact.isNotNull().cast("int")
        amounts[f"_s_{f}"] = F.coalesce(exact, F.lit(0).cast(EXACT))
        amounts[f"_q_{f}"] = F.coalesce((exact * exact).try_cast(EXACT_SQUARE), F.lit(0).cast(EXACT_SQUARE))
    return amounts


def squared_deviations(count: Column, total: Column, squares: Column) -> Column:
    """Sum of squared deviations from the mean, from fixed-point sums, without cancellation.

    With m near the mean and r = total - count * m it is (squares - m * total) - m * r - r * r / count. The first
    difference is taken in fixed point, on a total cut to seven decimals so that the product is exact; what was cut
    off and r are small, and exact before they become doubles. Totals of 1e12 and more are subtracted as doubles.
    """
    rough = F.try_divide(total.cast("double"), count)
    m, whole = rough.try_cast("decimal(18,6)"), total.try_cast("decimal(28,8)")
    cut = total.try_cast("decimal(19,7)")
    near = (squares - m * cut).cast("double")
    r = (whole - (count * m).try_cast("decimal(28,6)")).cast("double")
    left = m.cast("double") * ((whole - cut).cast("double") + r) + F.try_divide(r * r, count)
    return F.coalesce(near - left, squares.cast("double") - total.cast("double") * rough)


def moment_columns(features: Sequence[str]) -> list[Column]:
    """Mean and sample deviation of each attribute from its running totals."""
    out = []
    for f in features:
        count, total = F.col(f"_c_{f}"), F.col(f"_s_{f}")
        mean = F.try_divide(total.cast("double"), count)
        spread = F.try_divide(squared_deviations(count, total, F.col(f"_q_{f}")), count - 1)
        out.append(mean.alias(f"{f}_avg"))
        out.append(F.when(count > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias(f"{f}_std"))
    return out


def daily_context(
    df: DataFrame,
    numeric: Sequence[str],
    flags: Sequence[str],
    by: Sequence[str] = (),
    start: str = "start_d",
    end: str = "end_d",
    value: str = "consumption",
    day: str = "d",
    first_day=None,
) -> DataFrame:
    """A2-A4, W1 together: consumption, means, deviations and shares of every day in one pass.

    Days without an active record are present: consumption 0, shares and means null.
    """
    return context_of(daily_sums(df, numeric, flags, by, start, end, value, day, first_day), numeric, flags, by, day)


def daily_sums(
    df: DataFrame,
    numeric: Sequence[str],
    flags: Sequence[str],
    by: Sequence[str] = (),
    start: str = "start_d",
    end: str = "end_d",
    value: str = "consumption",
    day: str = "d",
    first_day=None,
    sign: Column | None = None,
) -> DataFrame:
    """What :func:`daily_context` is made of: counts and fixed-point sums, which add up and can be taken back."""
    rate = C.daily_rate(F.col(value), F.col(start), F.col(end))
    return running_totals(df, by, context_amounts(rate, numeric, flags), start, end, day, first_day, sign)


def context_amounts(rate: Column, numeric: Sequence[str], flags: Sequence[str]) -> dict[str, Column]:
    """What a record adds to each of its days."""
    amounts = {"consumption": F.coalesce(rate, F.lit(0))} | moment_amounts(numeric)
    return amounts | {f"_f_{f}": F.coalesce(F.col(f).try_cast(EXACT), F.lit(0).cast(EXACT)) for f in flags}


def context_of(
    sums: DataFrame,
    numeric: Sequence[str],
    flags: Sequence[str],
    by: Sequence[str] = (),
    day: str = "d",
    others: Sequence[str] = (),
) -> DataFrame:
    """Consumption, means, deviations and shares of the days of :func:`daily_sums`, and ``others`` as they are."""
    return sums.select(
        *by,
        day,
        "n",
        "consumption",
        *moment_columns(numeric),
        *[F.try_divide(F.col(f"_f_{f}").cast("double"), F.col("n")).alias(f) for f in flags],
        *others,
    )


def boolean_share(
    df: DataFrame,
    flags: Sequence[str],
    by: Sequence[str] = (),
    start: str = "start_d",
    end: str = "end_d",
    day: str = "d",
    first_day=None,
) -> DataFrame:
    """A4: share of active records on which each 0/1 attribute is set."""
    amounts = {f: F.coalesce(F.col(f).try_cast(EXACT), F.lit(0).cast(EXACT)) for f in flags}
    days = running_totals(df, by, amounts, start, end, day, first_day).filter("n > 0")
    return days.select(
        *by, day, "n", *[(F.col(f).cast("double") / F.col("n")).alias(f) for f in flags]
    )


def category_fractions(
    df: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    start: str = "start_d",
    end: str = "end_d",
    day: str = "d",
    first_day=None,
) -> DataFrame:
    """A5, A6 in long form: (``by``, day, feature, value, n, fraction) for values seen that day."""
    pairs = df.select(
        *by,
        start,
        end,
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
        ).alias("p"),
    ).select(*by, start, end, "p.feature", "p.value").filter(F.col("value").isNotNull())
    counts = running_totals(pairs, [*by, "feature", "value"], {}, start, end, day, first_day)
    of_day = Window.partitionBy(*by, "feature", day)
    return counts.filter("n > 0").select(
        *by, day, "feature", "value", "n", (F.col("n") / F.sum("n").over(of_day)).alias("fraction")
    )


def pivot_fractions(
    fractions: DataFrame, values: Mapping[str, Sequence[str]], by: Sequence[str] = (), day: str = "d"
) -> DataFrame:
    """A5 in wide form: one column ``<feature>_<value>`` per listed value, 0 where unseen."""
    wanted = [
        F.coalesce(
            F.max(F.when((F.col("feature") == f) & (F.col("value") == v), F.col("fraction"))), F.lit(0.0)
        ).alias(f"{f}_{v}")
        for f, vs in values.items()
        for v in vs
    ]
    return fractions.groupBy(*by, day).agg(*wanted)


SHARES = "shares"


def daily_wide(
    df: DataFrame,
    numeric: Sequence[str],
    flags: Sequence[str],
    categories: Sequence[str],
    by: Sequence[str] = (),
    start: str = "start_d",
    end: str = "end_d",
    value: str = "consumption",
    day: str = "d",
    first_day=None,
) -> DataFrame:
    """The columns of :func:`daily_context` and a map of shares, all from one pass over the records.

    ``shares`` maps each feature to a map of the values seen that day and their share; a feature without a
    known value that day has an empty map. A record is one row for the numbers and one per known category
    value, added up per day below the shuffle.
    """
    kind = [F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("value"))]
    kind += [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in categories]
    kinds = F.filter(F.array(*kind), lambda k: k["feature"].isNull() | k["value"].isNotNull())
    rows = df.withColumn("_kind", F.explode(kinds))
    rows = rows.withColumns({"_feature": F.col("_kind.feature"), "_value": F.col("_kind.value")}).drop("_kind")
    rate = C.daily_rate(F.col(value), F.col(start), F.col(end))
    amounts = context_amounts(rate, numeric, flags)
    of_numbers = {c: F.when(F.col("_feature").isNull(), a) for c, a in amounts.items()}
    days = running_totals(rows, [*by, "_feature", "_value"], of_numbers, start, end, day, first_day)
    days = days.filter(F.col("_feature").isNull() | (F.col("n") > 0))
    own = F.col("_feature").isNull()
    entry = F.when(~own, F.struct(F.col("_feature").alias("f"), F.col("_value").alias("v"), "n"))
    sums = days.groupBy(*by, day).agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("n", *amounts)], F.array_sort(F.collect_list(entry)).alias("_seen")
    )

    def shares_of(feature: str) -> Column:
        seen = F.filter("_seen", lambda e: e["f"] == feature)
        total = F.aggregate(seen, F.lit(0).cast("bigint"), lambda t, e: t + e["n"])
        return F.map_from_entries(F.transform(seen, lambda e: F.struct(e["v"], e["n"] / total)))

    shares = [x for c in categories for x in (F.lit(c), shares_of(c))]
    made = F.create_map(*shares) if shares else F.map_from_arrays(F.array(), F.array()).cast("map<string,map<string,double>>")
    return context_of(sums.withColumn(SHARES, made), numeric, flags, by, day, [SHARES])


def value_dictionary(days: DataFrame, known: DataFrame | None = None, version: int = 1) -> DataFrame:
    """(feature, value, position, version) of the values in ``shares``: those of ``known`` as they are, new ones after them.

    Positions count within a feature from 0, new values in alphabetical order, so a column keeps its place
    when later days bring more values.
    """
    seen = days.select(F.explode(SHARES).alias("feature", "_of")).select("feature", F.explode(F.map_keys("_of")).alias("value")).distinct()
    if known is not None:
        seen = seen.join(known.select("feature", "value"), ["feature", "value"], "left_anti")
    place = F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1
    fresh = seen.withColumn("position", place)
    if known is not None:
        after = known.groupBy("feature").agg((F.max("position") + 1).alias("_after"))
        fresh = fresh.join(after, "feature", "left").withColumn("position", F.col("position") + F.coalesce("_after", F.lit(0)))
    fresh = fresh.select("feature", "value", F.col("position").cast("int").alias("position"), F.lit(version).alias("version"))
    return fresh if known is None else known.select(*fresh.columns).unionByName(fresh)


def share_of(feature: str, value: str) -> Column:
    """A5: the share of one category value, 0 on days that lack it."""
    return F.coalesce(F.try_element_at(F.try_element_at(SHARES, F.lit(feature)), F.lit(value)), F.lit(0.0))


def widened(days: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """A5: a column ``<feature>_<value>`` per listed value instead of ``shares``; names may hold dots."""
    shares = [share_of(f, v).alias(f"{f}_{v}") for f, vs in values.items() for v in vs]
    return days.select(*[F.col(f"`{c}`") for c in days.columns if c != SHARES], *shares)


def active_on(
    df: DataFrame,
    dates: DataFrame,
    date: str = "d",
    start: str = "start_d",
    end: str = "end_d",
    span: int = 32,
) -> DataFrame:
    """J1 as a join: every (record, date) pair with start <= date <= end.

    Dates and intervals are cut into stretches of ``span`` days, which makes an
    equi-join of what would be a comparison of every record with every date.
    ``dates`` must hold distinct dates. All records lie on few stretches, so they
    are salted unless the dates are few enough to be broadcast.
    """

    def stretch(c):
        return F.floor(F.unix_date(c) / span)

    keyed = dates.withColumn("_stretch", stretch(F.col(date)))
    spans = _valid(df, start, end).withColumn(
        "_stretch", F.explode(F.sequence(stretch(F.col(start)), stretch(F.col(end))))
    )
    return (
        joins.salted(spans, keyed, ["_stretch"])
        .filter(F.col(date).between(F.col(start), F.col(end)))
        .drop("_stretch")
    )
