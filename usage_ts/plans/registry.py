"""All registered queries and their SQL twins."""

from __future__ import annotations

from usage_ts.plans import clusters, daily, descriptive, evaluation, forecasting, ingest, timeseries

MODULES = (ingest, daily, timeseries, evaluation, forecasting, clusters, descriptive)


def queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
