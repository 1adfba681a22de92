"""End-to-end jobs: extracts to daily table, client table, clusters, forecasts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_ts.functions import columns as C
from usage_ts.learning import forecasters as FC
from usage_ts.learning import additive, forest, orders, search  # noqa: F401  these register themselves
from usage_ts.operators import cleaning, clients, clustering, dedup, evaluation, intervals, revisions, series
from usage_ts.sources import extracts, store
from usage_ts.sources.layout import Layout
from usage_ts.sources.lineage import shared_folder


def load_records(
    spark: SparkSession,
    directory: str,
    layout: Layout = Layout(),
    rate_class: str = "all",
    compat: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Clean, deduplicated billing records of all extracts of a folder; ``multiline`` if cells may hold line breaks."""
    frames = extracts.read_extracts(spark, extracts.list_extracts(spark, directory), multiline)
    absent = {c: C.UNKNOWN_CATEGORY if c in layout.categorical else "0.0" for c in layout.columns}
    rows = extracts.union_extracts(frames, [*layout.columns, extracts.SOURCE], absent)
    rows = extracts.of_rate_class(rows, rate_class, layout.rate_class, compat=compat)
    plain = [c for c in layout.categorical if c not in layout.codes]
    clean = cleaning.clean_records(
        rows,
        dates=[layout.start, layout.end],
        numbers=[layout.value, *layout.numeric],
        flags=layout.boolean,
        codes=layout.codes,
        categories=plain,
    )
    # "Last" is the greatest file name, then the greatest row.
    order = [extracts.SOURCE, *[c for c in layout.columns if c not in layout.key]]
    return dedup.keep_last(clean, layout.key, order).select(*layout.columns)


def merge_extracts(spark: SparkSession, directory: str, as_of, layout: Layout = Layout()) -> DataFrame:
    """Every column of every extract, latest row of each key, last years only."""
    frames = extracts.read_extracts(spark, extracts.list_extracts(spark, directory))
    merged = cleaning.clean_records(extracts.union_extracts(frames), dates=[layout.start, layout.end])
    order = [extracts.SOURCE, *[c for c in merged.columns if c not in (*layout.key, extracts.SOURCE)]]
    kept = extracts.within_retention(merged, layout.end, as_of, layout.retention_years)
    return dedup.keep_last(kept, layout.key, order).drop(extracts.SOURCE)


def daily_table(
    records: DataFrame, layout: Layout = Layout(), by: Sequence[str] = (), first_day=None
) -> DataFrame:
    """Wide daily table: consumption, means, deviations, shares and category fractions.

    One pass over the records. The days are then written to the shared folder, and the category values, which
    become columns, are read from there.
    """
    spark = records.sparkSession
    days = intervals.daily_wide(
        records, layout.numeric, layout.boolean, layout.categorical, by,
        layout.start, layout.end, layout.value, first_day=first_day,
    )
    path = shared_folder(spark, "days")
    days.write.parquet(path)
    days = spark.read.schema(days.schema).parquet(path)
    values: dict[str, list[str]] = {c: [] for c in layout.categorical}
    for r in intervals.value_dictionary(days).orderBy("feature", "position").collect():
        values[r.feature].append(r.value)
    table = intervals.widened(intervals.closed_horizon(days, by), values)
    return series.drop_ranges(table.drop("n"), layout.missing_ranges, "d")


def build_daily(
    spark: SparkSession,
    directory: str,
    layout: Layout = Layout(),
    rate_class: str = "all",
    by: Sequence[str] = (),
    raw_path: str | None = None,
    out_path: str | None = None,
) -> DataFrame:
    """Complete run. With ``by`` = the rate class, all classes in one pass.

    Naming ``raw_path`` keeps the clean records, and spares the second pass the ingest.
    """
    records = load_records(spark, directory, layout, rate_class)
    if raw_path:
        store.write_table(records, raw_path)
        records = store.read_table(spark, raw_path)
    table = series.trim(daily_table(records, layout, by), layout.start_trim, layout.end_trim, by, "d")
    if out_path:
        store.write_table(table, out_path, by)
    return table


def refresh_daily(
    spark: SparkSession,
    old_records: DataFrame,
    old_daily: DataFrame,
    new_records: DataFrame,
    layout: Layout = Layout(),
    by: Sequence[str] = (),
) -> DataFrame:
    """Incremental run: recompute from half a year before the last old start, keep older days."""
    cut = series.look_back_cut(old_records, layout.start, layout.look_back_days)
    recent = new_records.filter(F.col(layout.end) >= F.lit(cut))
    new_daily = daily_table(recent, layout, by, first_day=cut)
    # Category values that one side lacks have fraction 0 there.
    shares = {c for c in (*old_daily.columns, *new_daily.columns) if c not in (*by, "d")}

    def complete(df):
        return df.withColumns({c: F.lit(0.0) for c in sorted(shares) if c not in df.columns})

    merged = series.replace_tail(complete(old_daily), complete(new_daily), cut, "d")
    return series.trim(merged, 0, layout.end_trim, by, "d")


def daily_state(records: DataFrame, path: str, layout: Layout = Layout(), by: Sequence[str] = ()) -> None:
    """Sums per day, in folders by month: what :func:`revise_daily` keeps up to date."""
    sums = intervals.daily_sums(
        records, layout.numeric, layout.boolean, by, layout.start, layout.end, layout.value
    )
    store.write_by_month(sums, path)


def revise_daily(
    spark: SparkSession,
    path: str,
    old_records: DataFrame,
    new_records: DataFrame,
    layout: Layout = Layout(),
    by: Sequence[str] = (),
) -> DataFrame:
    """W14 for revisions of any age: take back what is gone or was changed, add what is new, rewrite only months touched.

    Returns the daily figures of the revised state at ``path``.
    """
    changed = revisions.changes(old_records, new_records, layout.columns)
    delta = intervals.daily_sums(
        changed, layout.numeric, layout.boolean, by, layout.start, layout.end, layout.value, sign=F.col("sign")
    )
    revisions.revise_table(spark, path, delta, by)
    sums = store.read_table(spark, path).drop("month")
    return intervals.closed_horizon(
        intervals.context_of(revisions.horizon(sums, by), layout.numeric, layout.boolean, by), by
    )


def client_table(records: DataFrame, eval_date, layout: Layout = Layout(), compat: bool = False) -> DataFrame:
    """One row per account: attributes as of a date and the twelve months before it."""
    attributes = [*layout.numeric, *layout.boolean, *layout.categorical]
    return clients.client_profiles(
        records, eval_date, attributes, [layout.value, *attributes],
        layout.account, layout.start, layout.end, layout.value, compat, "CONS_",
    )


def cluster_clients(
    profiles: DataFrame, k: int = 4, layout: Layout = Layout(), runs: int = 15, seed: int = 0
) -> tuple[DataFrame, DataFrame, clustering.Clustering]:
    """(memberships, centroid report, clustering) of a client table."""
    out = set(layout.not_clustered)
    months = [c for c in profiles.columns if c.startswith("CONS_")]
    numeric = [c for c in (*layout.numeric, *months) if c not in out]
    flags = [c for c in layout.boolean if c not in out]
    categorical = [c for c in layout.categorical if c not in out] + flags
    scaler = clustering.fit_scaler(profiles, numeric)
    points = clustering.filled(scaler.transform(profiles), numeric, categorical, [layout.account])
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    found = clustering.k_prototypes(points, k, numeric, categorical, layout.account, runs=runs, seed=seed)
    labelled = found.assign(points)
    members = clustering.cluster_memberships(profiles, labelled, layout.account)
    report = clustering.centroid_report(profiles, labelled, numeric, categorical, flags, layout.account)
    return members, report, found


def sweep_clusters(
    profiles: DataFrame, k_min: int = 3, k_max: int = 12, layout: Layout = Layout(), runs: int = 15, seed: int = 0
) -> DataFrame:
    """Silhouette of each k in a range, the best one marked."""
    out = set(layout.not_clustered)
    months = [c for c in profiles.columns if c.startswith("CONS_")]
    numeric = [c for c in (*layout.numeric, *months) if c not in out]
    categorical = [c for c in (*layout.categorical, *layout.boolean) if c not in out]
    scaler = clustering.fit_scaler(profiles, numeric)
    points = clustering.filled(scaler.transform(profiles), numeric, categorical, [layout.account])
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    return clustering.best_k(points, range(k_min, k_max + 1), numeric, categorical, layout.account, runs=runs, seed=seed)


def train(
    daily: DataFrame,
    model: str | FC.Forecaster,
    params: Mapping[str, object] | None = None,
    test_rows: int | None = None,
    test_fraction: float = 0.1,
    by: Sequence[str] = ("series_key",),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evaluation with bands, metrics, fitted models) of one forecaster on every series."""
    if test_rows is None:
        split = series.split_fraction(daily, test_fraction, by)
    else:
        split = series.split_fixed(daily, test_rows, by)
    ready = FC.with_params(split, model, params)
    rows = FC.evaluate(ready, model, by)
    models = FC.fit_models(ready.filter("role = 'train'"), model, by)
    return evaluation.forecast_bands(rows, by), evaluation.forecast_metrics(rows, by), models


def train_all(
    daily: DataFrame,
    models: Mapping[str, Mapping[str, object] | None] | None = None,
    test_fraction: float = 0.1,
    by: Sequence[str] = ("series_key",),
) -> DataFrame:
    """Metrics of every registered forecaster on every series, one table."""
    chosen = models or {n: None for n in FC.REGISTRY}
    return search.evaluate_all(series.split_fraction(daily, test_fraction, by), chosen, by)


def per_class_series(daily: DataFrame, key: str, value: str = "consumption") -> DataFrame:
    """(series_key, ds, y) from a daily table."""
    return daily.select(F.col(key).alias("series_key"), F.col("d").alias("ds"), C.plain(F.col(value)).alias("y"))


def save_forecast(forecast: DataFrame, path: str, by: str = "series_key") -> None:
    """One folder per series; for very many series choose a coarser ``by``."""
    store.write_table(forecast, path, [by])


def save_decomposition(
    dates: DataFrame, models: DataFrame, folder: str, by: Sequence[str] = ("series_key",), holidays: Sequence[str] = ()
) -> None:
    """Trend and holiday components as tables, season parameters as JSON."""
    parts = additive.components(dates, models, by, holidays)
    for name in ("trend", "holidays"):
        store.write_table(parts.select(*by, "ds", name), f"{folder}/{name}_component")
    store.write_json(additive.seasonality_parameters(models, by), f"{folder}/seasonality_parameters")


def save_run(tables: Mapping[str, DataFrame], folder: str, run_id: str | None = None) -> str:
    """Write the result tables of a run side by side under its id."""
    run_id = run_id or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d-%H%M%S")
    for name, table in tables.items():
        store.append_run(table, f"{folder}/{name}", run_id)
    return run_id


