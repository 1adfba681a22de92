"""Clusters of mixed numeric and categorical profiles.

Scaled points live in one persisted table. An iteration is one job for all runs
and all k, by as few tasks as keep all cores busy: each sums what its points add
to every cluster. Few sums are added on the driver; then points are looked at only
if their label can have changed (:class:`_Bounds`). Many sums are added by shuffles
of a scan of all points. Nothing is joined. Labels of the result are a column
expression with literal centroids.

The silhouette is exact and linear: the mean squared distance from a point to a
cluster follows from the cluster's size, sum and sum of squares, and the mean
number of mismatches from its category counts. No pairs of points are formed and
no sample is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usage_ts.functions import mixed
from usage_ts.operators import joins

# Fixed value: gamma is half the mean deviation of the numeric features.
GAMMA_SHARE = 0.5
#: Points worth a task of their own in a pass, and the most that one task takes in a single round of tasks.
TASK_ROWS, MOST_TASK_ROWS = 10_000, 250_000
#: Category counts that a task holds before it hands them on.
HELD_COUNTS = 50_000
#: Rows of partial sums that a pass may bring to the driver.
DRIVER_ROWS = 50_000
#: Share of all labels that a pass may look at again before every point gets new bounds.
LOOKED_AT = 0.25
#: Points nearest to another label first: the shares of a block at which it is cut, so that far parts are passed over.
CUTS = (1 / 16, 1 / 8, 1 / 4, 1 / 2)


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per numeric column, fitted on a whole table."""

    mean: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.scale[c]) for c in self.mean}
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.mean[c]) for c in self.mean})


def fit_scaler(df: DataFrame, numeric: Sequence[str]) -> Scaler:
    """A14 over a whole table: one aggregation, one row to the driver."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]
    ).first()
    return Scaler(
        {c: float(row[f"m_{c}"] or 0.0) for c in numeric},
        {c: float(row[f"s_{c}"] or 1.0) or 1.0 for c in numeric},
    )


@dataclass
class Centroid:
    numeric: list[float]
    categorical: list


def default_gamma(points: DataFrame, numeric: Sequence[str]) -> float:
    row = points.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first()
    return GAMMA_SHARE * sum(float(row[c] or 0.0) for c in numeric) / max(len(numeric), 1)


def filled(points: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Projection with null numbers as 0, so that distance code needs no null checks."""
    return points.select(
        *keep,
        *[F.expr(f"coalesce(CAST(`{c}` AS DOUBLE), 0D)").alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in categorical],
    )


def pass_tasks(rows: int, cores: int) -> int:
    """Tasks of a pass over ``rows`` points: whole rounds of all cores, fewer if the points are too few for that."""
    rounds = max(1, math.ceil(rows / (cores * MOST_TASK_ROWS)))
    return max(1, min(rounds * cores, math.ceil(rows / TASK_ROWS)))


def in_passes(points: DataFrame, categorical: Sequence[str], clusters: int) -> tuple[DataFrame, int, bool]:
    """Persisted points by as few tasks as keep all cores busy, their number, and whether the sums of these tasks are few.

    The partitions of the points are merged, not moved. A pass is short, so starting a Python task for each of
    some hundred small partitions would be most of it, and so would shuffles of sums that are few anyway.
    """
    row = points.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(c) for c in categorical]).first()
    tasks = pass_tasks(row["n"], points.sparkSession.sparkContext.defaultParallelism)
    values = sum(row[c] + 1 for c in categorical)
    return points.coalesce(tasks), row["n"], tasks * clusters * (1 + values) <= DRIVER_ROWS


def nearest(
    centroids: Sequence[Centroid], numeric: Sequence[str], categorical: Sequence[str], gamma: float
) -> str:
    """Struct (score, label) of the nearest centroid; the lower label wins a tie.

    The cost is the score plus the squared norm of the row.
    """
    xs, cs = [mixed.name(c) for c in numeric], [mixed.name(c) for c in categorical]
    options = []
    for i, k in enumerate(centroids):
        score = mixed.centroid_score(xs, k.numeric, cs, [mixed.text(v) for v in k.categorical], gamma)
        options.append(f"named_struct('score', {score}, 'label', {i})")
    return f"least({', '.join(options)})" if len(options) > 1 else options[0]


def _cost(score: str, numeric: Sequence[str]) -> Column:
    norm = mixed.squared_norm([mixed.name(c) for c in numeric])
    return F.expr(f"greatest({score} + ({norm}), 0D)").alias("cost")


def assign(
    points: DataFrame,
    centroids: Sequence[Centroid],
    numeric: Sequence[str],
    categorical: Sequence[str],
    gamma: float,
) -> DataFrame:
    """Label (from 0) and distance of the nearest centroid for every point."""
    rest = [c for c in points.columns if c not in (*numeric, *categorical)]
    ready = filled(points, numeric, categorical, rest)
    best = ready.withColumn("_best", F.expr(nearest(centroids, numeric, categorical, gamma)))
    return best.select(*points.columns, F.col("_best.label").alias("label"), _cost("_best.score", numeric))


def numeric_update(labelled: DataFrame, by: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Mean of each numeric feature per cluster, with size and cost."""
    return labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("cost").alias("cost"),
        *[F.avg(c).alias(c) for c in numeric],
    )


def category_update(labelled: DataFrame, by: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Most frequent value (as text) of each categorical feature per cluster; the smaller one wins a tie.

    Values are counted before the mode is taken, so no cluster is gathered whole.
    """
    pairs = labelled.select(
        *by,
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in categorical])
        ),
    )
    return (
        pairs.groupBy(*by, "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*by, "feature")
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    )


@dataclass
class Clustering:
    centroids: list[Centroid]
    sizes: list[int]
    cost: float
    gamma: float
    iterations: int
    numeric: list[str]
    categorical: list[str]
    costs: list[float] = field(default_factory=list)
    converged: bool = True

    def assign(self, points: DataFrame) -> DataFrame:
        return assign(points, self.centroids, self.numeric, self.categorical, self.gamma)


def seed_centroids(
    points: DataFrame, k: int, runs: int, numeric: Sequence[str], categorical: Sequence[str], key: str, seed: int
) -> list[list[Centroid]]:
    """k start rows for each run, picked by a seeded hash of the key.

    A top-k query: every task keeps its k * runs smallest hashes.
    """
    def first(run: int) -> DataFrame:
        order = [F.xxhash64(F.lit(seed + run), F.col(key).cast("string")), F.col(key)]
        return points.orderBy(*order).limit(k).select(*numeric, *categorical, F.lit(run).alias("run"))

    starts: list[list[Centroid]] = [[] for _ in range(runs)]
    for r in reduce(DataFrame.unionByName, map(first, range(runs))).collect():
        starts[r["run"]].append(Centroid([float(r[c]) for c in numeric], [r[c] for c in categorical]))
    if len(starts[0]) < k:
        raise ValueError(f"{k} clusters need at least {k} points, found {len(starts[0])}")
    return starts


def k_prototypes(
    points: DataFrame,
    k: int,
    numeric: Sequence[str],
    categorical: Sequence[str],
    key: str = "account",
    gamma: float | None = None,
    runs: int = 1,
    max_iter: int | None = None,
    tolerance: float = 1e-6,
    seed: int = 0,
    starts: Sequence[Sequence[Centroid]] | None = None,
) -> Clustering:
    """Alternate assignment and update from ``runs`` starts, keep the cheapest result."""
    states = starts or seed_centroids(points, k, runs, numeric, categorical, key, seed)
    if gamma is None:
        gamma = default_gamma(points, numeric)
    return _cheapest(k_prototypes_runs(points, states, numeric, categorical, gamma, max_iter, tolerance))


def _cheapest(found: Sequence[Clustering]) -> Clustering:
    return min(found, key=lambda f: f.cost)


def k_prototypes_runs(
    points: DataFrame,
    starts: Sequence[Sequence[Centroid]],
    numeric: Sequence[str],
    categorical: Sequence[str],
    gamma: float,
    max_iter: int | None = None,
    tolerance: float = 1e-6,
) -> list[Clustering]:
    """M15 from every start, which may differ in their number of centroids.

    ``points`` should be scaled and persisted. An iteration is one job for all
    runs that are not settled. An empty cluster moves to the point farthest from
    its centroid. A run stops when its cost falls by no more than ``tolerance``
    of it, or after ``max_iter`` iterations if given; ``converged`` tells which.
    Cost and sizes are those of the returned centroids.
    """
    numeric, categorical = list(numeric), list(categorical)
    ready, rows, few = in_passes(filled(points, numeric, categorical), categorical, sum(map(len, starts)))
    found = [Clustering(list(s), [0] * len(s), math.inf, gamma, 0, numeric, categorical, [], False) for s in starts]
    live = list(range(len(found)))
    bounds = _Bounds(ready, rows) if few else None
    while live and (max_iter is None or found[live[0]].iterations < max_iter):
        means, modes = bounds.updates(found, live) if bounds else _updates(ready, found, live)
        moves = {}
        for r in live:
            run = found[r]
            run.iterations += 1
            run.sizes = [means[r, i]["size"] if (r, i) in means else 0 for i in range(len(run.sizes))]
            run.cost = sum(means[r, i]["cost"] for i, n in enumerate(run.sizes) if n)
            run.costs.append(run.cost)
            slack = tolerance * max(run.cost, 1e-12)
            # An empty cluster gets two more rounds; with fewer different points than clusters it stays empty.
            back = 2 if 0 in run.sizes else 1
            run.converged = len(run.costs) > back and run.costs[-1 - back] - run.cost <= slack
            if not run.converged and run.iterations != max_iter:
                moves[r] = run
        live = list(moves)
        far = _farthest(ready, [r for r in live if 0 in found[r].sizes], found)
        for r, run in moves.items():
            for i, n in enumerate(run.sizes):
                if n:
                    chosen = [modes[r, i][c] for c in categorical]
                    run.centroids[i] = Centroid([float(means[r, i][c]) for c in numeric], chosen)
                elif far.get(r):
                    run.centroids[i] = far[r].pop(0)
    if bounds:
        bounds.end()
    return found


def _partial_sums(found: Sequence[Clustering], live: Sequence[int]):
    """Sizes, costs, sums and category counts of the points of one task under every live run.

    The distances of a batch to all centroids are one matrix product, so a pass serves any number of
    runs; a generated expression would have to be compiled anew for every iteration and run.
    """
    numeric, categorical, gamma = found[0].numeric, found[0].categorical, found[0].gamma
    cells = [c for r in live for c in found[r].centroids]
    centers = np.array([c.numeric for c in cells], float).reshape(len(cells), len(numeric))
    picks = [np.array([_as_text(c.categorical[j]) for c in cells], object) for j in range(len(categorical))]
    widths = [(r, len(found[r].centroids)) for r in live]

    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), *[pa.float64()] * (1 + len(numeric))]
    names = ["run", "label", "feature", "value", "n", "cost", *(f"s{i}" for i in range(len(numeric)))]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Column 0 is the cost, then one column per feature.
        sizes, sums = np.zeros(len(cells), int), np.zeros((len(cells), 1 + len(numeric)))
        held: dict[tuple, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array([c.to_numpy(zero_copy_only=False) for c in b.columns[: len(numeric)]]).reshape(len(numeric), -1)
            squares = (x * x).sum(axis=0) if len(numeric) else np.zeros(b.num_rows)
            far = squares[:, None] - 2 * (x.T @ centers.T) + (centers * centers).sum(axis=1)
            coded = []
            for j in range(len(categorical)):
                column = b.column(len(numeric) + j).dictionary_encode(null_encoding="encode")
                codes, values = column.indices.to_numpy(), np.array(column.dictionary.to_pylist(), object)
                far += gamma * (values[:, None] != picks[j][None, :]).astype(float)[codes]
                coded.append((codes, values))
            at = 0
            for r, k in widths:
                own = far[:, at : at + k]
                label = own.argmin(axis=1)
                sizes[at : at + k] += np.bincount(label, minlength=k)
                for i, v in enumerate((np.maximum(own.min(axis=1), 0), *x)):
                    sums[at : at + k, i] += np.bincount(label, v, k)
                at += k
                for name, (codes, values) in zip(categorical, coded, strict=True):
                    counts = np.bincount(label * len(values) + codes, minlength=k * len(values))
                    for p in np.flatnonzero(counts).tolist():
                        of = r, p // len(values), name, values[p % len(values)]
                        held[of] = held.get(of, 0) + int(counts[p])
            if len(held) > HELD_COUNTS:
                yield table([(*of, n, *[0.0] * (1 + len(numeric))) for of, n in held.items()])
                held = {}
        places = [(r, i) for r, k in widths for i in range(k)]
        rows = [(*places[c], None, None, int(sizes[c]), *sums[c].tolist()) for c in np.flatnonzero(sizes).tolist()]
        rows += [(*of, n, *[0.0] * (1 + len(numeric))) for of, n in held.items()]
        if rows:
            yield table(rows)

    return run


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _updates(ready: DataFrame, found: Sequence[Clustering], live: Sequence[int]) -> tuple[dict, dict]:
    """New means and modes of every run by one job over all points.

    Shuffles add the partial sums of the tasks, and clusters x (1 + categories) rows reach the driver.
    """
    numeric, keys = found[0].numeric, ["run", "label", "feature"]
    sums = ["cost", *(f"s{i}" for i in range(len(numeric)))]
    schema = "run int, label int, feature string, value string, n long, " + ", ".join(f"{c} double" for c in sums)
    parts = ready.mapInArrow(_partial_sums(found, live), schema)
    counted = parts.groupBy(*keys, "value").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
    rows = counted.groupBy(*keys).agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"), *(F.sum(c).alias(c) for c in ["n", *sums])
    ).collect()
    means, modes = {}, {}
    for r in rows:
        of = r["run"], r["label"]
        if r["feature"] is None:
            means[of] = {"size": r["n"], "cost": r["cost"], **{c: r[f"s{i}"] / r["n"] for i, c in enumerate(numeric)}}
        else:
            modes.setdefault(of, {})[r["feature"]] = r["value"]
    return means, modes


class _Cells:
    """The centroids of the live runs, one after the other, and the distances of a block of points to them."""

    def __init__(self, found: Sequence[Clustering], runs: Sequence[int]):
        first = found[runs[0]]
        self.numeric, self.categorical, self.gamma = first.numeric, first.categorical, first.gamma
        cells = [c for r in runs for c in found[r].centroids]
        self.centers = np.array([c.numeric for c in cells], float).reshape(len(cells), len(self.numeric))
        self.picks = [np.array([_as_text(c.categorical[j]) for c in cells], object) for j in range(len(self.categorical))]
        self.places = [(r, i) for r in runs for i in range(len(found[r].centroids))]
        ends = np.cumsum([0, *(len(found[r].centroids) for r in runs)]).tolist()
        self.spans = {r: slice(a, b) for r, a, b in zip(runs, ends, ends[1:], strict=False)}

    def distances(self, x: np.ndarray, coded: Sequence[tuple], of: slice) -> np.ndarray:
        """A row per centroid of a run; numbers of points come as a row per feature, categories as codes and their values."""
        centers = self.centers[of]
        far = (x * x).sum(axis=0) - 2 * (centers @ x)
        far += (centers * centers).sum(axis=1)[:, None]
        for (codes, values), picks in zip(coded, self.picks, strict=True):
            far += (self.gamma * (values[None, :] != picks[of][:, None]).astype(float))[:, codes]
        return far

    def drifts(self, later: _Cells) -> np.ndarray:
        """How far each centroid went: in the metric whose square is the mixed distance."""
        moved = ((later.centers - self.centers) ** 2).sum(axis=1)
        for a, b in zip(self.picks, later.picks, strict=True):
            moved += self.gamma * (a != b)
        return np.sqrt(moved) * (1 + 1e-9) + 1e-12

    def part(self, runs: Sequence[int]) -> _Cells:
        """The same for some of the runs."""
        out = object.__new__(_Cells)
        at = [i for i, (r, _) in enumerate(self.places) if r in set(runs)]
        out.numeric, out.categorical, out.gamma = self.numeric, self.categorical, self.gamma
        out.centers, out.picks, out.places = self.centers[at], [p[at] for p in self.picks], [self.places[i] for i in at]
        widths = [self.spans[r].stop - self.spans[r].start for r in runs]
        ends = np.cumsum([0, *widths]).tolist()
        out.spans = {r: slice(a, b) for r, a, b in zip(runs, ends, ends[1:], strict=False)}
        return out


class _Sums:
    """Sizes, squares, sums and category counts of the clusters, of one task."""

    SCHEMA = pa.schema([("run", pa.int32()), ("label", pa.int32()), ("feature", pa.string()), ("value", pa.string()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])
    DDL = "run int, label int, feature string, value string, n long, sums array<double>"

    def __init__(self, cells: _Cells):
        self.cells, self.sizes = cells, np.zeros(len(cells.places), int)
        self.sums = np.zeros((len(cells.places), 1 + len(cells.numeric)))
        self.counts: dict[tuple, int] = {}

    def add(self, run: int, label: np.ndarray, x: np.ndarray, coded: Sequence[tuple], sign: int = 1) -> None:
        span = self.cells.spans[run]
        k = span.stop - span.start
        self.sizes[span] += sign * np.bincount(label, minlength=k)
        for i, v in enumerate(((x * x).sum(axis=0), *x)):
            self.sums[span, i] += sign * np.bincount(label, v, k)
        for name, (codes, values) in zip(self.cells.categorical, coded, strict=True):
            counts = np.bincount(label * len(values) + codes, minlength=k * len(values))
            for p in np.flatnonzero(counts).tolist():
                of = run, p // len(values), name, values[p % len(values)]
                self.counts[of] = self.counts.get(of, 0) + sign * int(counts[p])

    def held(self) -> pa.RecordBatch:
        """What was counted so far, to be handed on."""
        rows, self.counts = [(*of, n, None) for of, n in self.counts.items()], {}
        return self.table(rows)

    def rest(self) -> pa.RecordBatch:
        moved = np.flatnonzero((self.sizes != 0) | self.sums.any(axis=1)).tolist()
        rows = [(*self.cells.places[c], None, None, int(self.sizes[c]), self.sums[c].tolist()) for c in moved]
        return self.table(rows + [(*of, n, None) for of, n in self.counts.items()])

    @classmethod
    def table(cls, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(cls.SCHEMA.names, r, strict=True)) for r in rows], cls.SCHEMA)


class _Bounds:
    """Sums of the clusters from pass to pass, looking only at points whose label can have changed.

    A full pass gives every point its label under each run and the margin by which the next centroid is farther.
    The square root of the mixed distance is a metric, so the label stands as long as the margin exceeds what its
    own centroid and the fastest of the others have moved since. Later passes compute the distances of the other
    points and add what those that changed take from one cluster to another. Blocks of points are persisted with
    labels and margins; when a pass has looked at many labels, or many runs are settled, a full pass makes new ones.
    Margins are lessened by what rounding can add to them.
    """

    BLOCK = pa.schema([
        ("n", pa.int32()), ("least", pa.list_(pa.float32())), ("x", pa.binary()), ("labels", pa.binary()), ("margins", pa.binary()),
        ("codes", pa.list_(pa.binary())), ("values", pa.list_(pa.list_(pa.string()))),
    ])
    DDL = "n int, least array<float>, x binary, labels binary, margins binary, codes array<binary>, values array<array<string>>"

    def __init__(self, ready: DataFrame, rows: int):
        self.ready, self.rows = ready, rows
        self.blocks: DataFrame | None = None
        self.begin: _Cells | None = None
        self.base: dict[tuple, tuple[int, np.ndarray | None]] = {}
        self.looked = 0.0

    def updates(self, found: Sequence[Clustering], live: Sequence[int]) -> tuple[dict, dict]:
        """New means and modes of every live run by one job."""
        cells = _Cells(found, live)
        if self.blocks is None or self.looked > LOOKED_AT or 2 * len(live) <= len(self.begin.spans):
            self._look_at_all(cells)
            totals = self.base
        else:
            totals = self._changed(cells, live)
        return self._of(totals, cells)

    def end(self) -> None:
        if self.blocks is not None:
            self.blocks.unpersist()
            self.blocks = None

    def _look_at_all(self, cells: _Cells) -> None:
        self.end()
        self.blocks = self.ready.mapInArrow(_blocks(cells), self.DDL).persist(StorageLevel.MEMORY_AND_DISK)
        self.begin, self.looked = cells, 0.0
        self.base = _added({}, self.blocks.mapInArrow(_sums_of_all(cells), _Sums.DDL).toArrow().to_pylist())

    def _changed(self, cells: _Cells, live: Sequence[int]) -> dict:
        begin = self.begin.part(live)
        drifts = begin.drifts(cells)
        needed = {}
        for r, span in cells.spans.items():
            own = drifts[span]
            others = [np.delete(own, i).max(initial=0.0) for i in range(len(own))]
            needed[r] = own + others
        places = {r: i for i, r in enumerate(self.begin.spans)}
        near = reduce(Column.__or__, [~(F.get("least", F.lit(places[r])) > F.lit(float(n.max()))) for r, n in needed.items()])
        parts = self.blocks.filter(near).mapInArrow(_sums_of_changed(cells, needed, places, _label_type(self.begin)), _Sums.DDL)
        rows = parts.toArrow().to_pylist()
        self.looked = sum(r["n"] for r in rows if r["run"] < 0) / max(1, self.rows * len(live))
        return _added({of: t for of, t in self.base.items() if of[0] in cells.spans}, [r for r in rows if r["run"] >= 0])

    def _of(self, totals: Mapping, cells: _Cells) -> tuple[dict, dict]:
        """Means, sizes, costs under the centroids of the pass, and modes, of sums."""
        means, modes, best = {}, {}, {}
        texts = {of: [p[i] for p in cells.picks] for i, of in enumerate(cells.places)}
        equal: dict[tuple, int] = {}
        for (run, label, feature, value), (n, _) in totals.items():
            if feature is None or n <= 0:
                continue
            of = run, label
            if texts[of][cells.categorical.index(feature)] == value:
                equal[of] = equal.get(of, 0) + n
            rank = -n, value is not None, value or ""  # null before the least
            if (*of, feature) not in best or rank < best[*of, feature]:
                best[*of, feature] = rank
                modes.setdefault(of, {})[feature] = value
        for i, of in enumerate(cells.places):
            n, sums = totals.get((*of, None, None), (0, None))
            if n > 0:
                center = cells.centers[i]
                inside = sums[0] - 2 * (center @ sums[1:]) + n * (center @ center)
                differ = n * len(cells.categorical) - equal.get(of, 0)
                named = {c: float(s / n) for c, s in zip(cells.numeric, sums[1:], strict=True)}
                means[of] = {"size": n, "cost": max(float(inside), 0.0) + cells.gamma * differ, **named}
        return means, modes


def _points(b: pa.RecordBatch, features: int) -> tuple[np.ndarray, list[tuple]]:
    """A row per number, and codes and their values per category, of a batch of points."""
    x = np.array([c.to_numpy(zero_copy_only=False) for c in b.columns[:features]]).reshape(features, b.num_rows)
    columns = [c.dictionary_encode(null_encoding="encode") for c in b.columns[features:]]
    return x, [(c.indices.to_numpy().astype(np.int32), np.array(c.dictionary.to_pylist(), object)) for c in columns]


def _label_type(cells: _Cells) -> np.dtype:
    return np.min_scalar_type(max(s.stop - s.start for s in cells.spans.values()))


def _blocks(cells: _Cells):
    """Blocks of points with their labels and margins under every run, those near to another label first."""
    kind = _label_type(cells)
    # What rounding may add to a squared distance, as a share of the squared norms it is computed from.
    share = np.finfo(float).eps * (2 * len(cells.numeric) + 16)
    largest = (cells.centers**2).sum(axis=1).max(initial=0.0) + cells.gamma * len(cells.categorical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, coded = _points(b, len(cells.numeric))
            rounding = share * ((x * x).sum(axis=0) + largest)
            labels, margins = np.empty((len(cells.spans), b.num_rows), kind), np.empty((len(cells.spans), b.num_rows), np.float32)
            for i, span in enumerate(cells.spans.values()):
                own = cells.distances(x, coded, span)
                label, best, second = np.zeros(b.num_rows, kind), own[0].copy(), np.full(b.num_rows, np.inf)
                for j in range(1, len(own)):
                    np.putmask(label, own[j] < best, j)
                    second = np.minimum(second, np.maximum(best, own[j]))
                    best = np.minimum(best, own[j])
                margin = np.sqrt(np.maximum(second - rounding, 0)) - np.sqrt(np.maximum(best, 0) + rounding)
                labels[i] = label
                margins[i] = np.nextafter(np.where(np.isnan(margin), -1, margin).astype(np.float32), np.float32(-np.inf))
            order = np.argsort(margins.min(axis=0), kind="stable")
            rows = []
            for at in np.split(order, [int(c * len(order)) for c in CUTS]):
                if len(at):
                    held = margins[:, at]
                    rows.append({
                        "n": len(at), "least": held.min(axis=1).tolist(), "x": x[:, at].tobytes(), "labels": labels[:, at].tobytes(),
                        "margins": held.tobytes(), "codes": [c[at].tobytes() for c, _ in coded], "values": [v.tolist() for _, v in coded],
                    })
            yield pa.RecordBatch.from_pylist(rows, _Bounds.BLOCK)

    return run


def _opened(batches: Iterator[pa.RecordBatch], features: int, kind: np.dtype):
    """Points, categories, labels and margins of each block."""
    for b in batches:
        for r in b.to_pylist():
            n = r["n"]
            coded = [(np.frombuffer(c, np.int32), np.array(v, object)) for c, v in zip(r["codes"], r["values"], strict=True)]
            labels, margins = np.frombuffer(r["labels"], kind).reshape(-1, n), np.frombuffer(r["margins"], np.float32).reshape(-1, n)
            yield np.frombuffer(r["x"]).reshape(features, n), coded, labels, margins


def _sums_of_all(cells: _Cells):
    kind = _label_type(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(cells)
        for x, coded, labels, _ in _opened(batches, len(cells.numeric), kind):
            for r, label in zip(cells.spans, labels, strict=True):
                sums.add(r, label.astype(int), x, coded)
            if len(sums.counts) > HELD_COUNTS:
                yield sums.held()
        yield sums.rest()

    return run


def _sums_of_changed(cells: _Cells, needed: Mapping[int, np.ndarray], places: Mapping[int, int], kind: np.dtype):
    """What the points whose labels changed add to the sums; a row of run -1 counts the labels looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, looked = _Sums(cells), 0
        for x, coded, labels, margins in _opened(batches, len(cells.numeric), kind):
            for r, span in cells.spans.items():
                label = labels[places[r]]
                at = np.flatnonzero(~(margins[places[r]] > needed[r][label]))
                if not len(at):
                    continue
                looked += len(at)
                new = cells.distances(x[:, at], [(c[at], v) for c, v in coded], span).argmin(axis=0)
                changed = new != label[at]
                if changed.any():
                    at, new = at[changed], new[changed]
                    moved, codes = x[:, at], [(c[at], v) for c, v in coded]
                    sums.add(r, label[at].astype(int), moved, codes, -1)
                    sums.add(r, new, moved, codes)
            if len(sums.counts) > HELD_COUNTS:
                yield sums.held()
        yield sums.rest()
        yield sums.table([(-1, -1, None, None, looked, None)])

    return run


def _added(base: Mapping[tuple, tuple], rows: Sequence[Mapping]) -> dict[tuple, tuple[int, np.ndarray | None]]:
    """Count and sums of each run, label, feature and value."""
    total = dict(base)
    for r in rows:
        of = r["run"], r["label"], r["feature"], r["value"]
        n, sums = total.get(of, (0, None))
        own = None if r["sums"] is None else np.array(r["sums"])
        total[of] = n + r["n"], own if sums is None else sums if own is None else sums + own
    return total


def _farthest(ready: DataFrame, short: Sequence[int], found: Sequence[Clustering]) -> dict[int, list[Centroid]]:
    """Points farthest from their centroid, for runs that lost a cluster (at most k per run)."""
    out: dict[int, list[Centroid]] = {}
    for r in short:
        numeric, categorical = found[r].numeric, found[r].categorical
        rows = (
            found[r].assign(ready)
            .orderBy(F.col("cost").desc(), *numeric, *categorical)
            .limit(len(found[r].centroids))
            .collect()
        )
        out[r] = [Centroid([float(x[c]) for c in numeric], [x[c] for c in categorical]) for x in rows]
    return out


def cluster_shares(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Size and percentage of each cluster; the division runs over one row per cluster."""
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def cluster_memberships(
    profiles: DataFrame, labelled: DataFrame, key: str = "account", label: str = "label"
) -> DataFrame:
    """Cluster number from 1 next to the unscaled profile."""
    numbers = labelled.select(key, (F.col(label) + 1).alias("cluster"))
    return numbers.join(profiles, key, "left")


def centroid_report(
    profiles: DataFrame,
    labelled: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    booleans: Sequence[str] = (),
    key: str = "account",
    label: str = "label",
) -> DataFrame:
    """One row per cluster in original units: share, mean numbers, modal categories, rounded flags."""
    members = cluster_memberships(profiles, labelled, key, label).withColumn("cost", F.lit(0.0))
    means = numeric_update(members, ["cluster"], numeric)
    percent = F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy())
    report = means.withColumn("percent", percent).select("cluster", "percent", *numeric)
    if categorical:
        modes = category_update(members, ["cluster"], categorical)
        wide = modes.groupBy("cluster").agg(
            *[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in categorical]
        )
        report = report.join(wide, "cluster")
    return report.withColumns({b: F.round(F.col(b).cast("double")) for b in booleans}) if booleans else report


def _cluster_totals(labelled: DataFrame, numeric: Sequence[str], label: str) -> dict[int, dict]:
    """Size, sums and sum of squared norms of every cluster: k rows."""
    norm = mixed.squared_norm([mixed.name(c) for c in numeric])
    rows = labelled.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.expr(norm)).alias("_q"), *[F.sum(c).alias(c) for c in numeric]
    )
    return {r[label]: r.asDict() for r in rows.collect()}


def silhouette_rows(
    labelled: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    gamma: float,
    label: str = "label",
) -> DataFrame:
    """A (mean distance inside), b (least mean distance outside) and score of every point.

    Category counts per cluster come by one salted join per categorical feature
    with a table of its distinct values; Catalyst broadcasts it while it is small.
    """
    totals = _cluster_totals(labelled, numeric, label)
    labels = sorted(totals)
    out = labelled
    for i, c in enumerate(categorical):
        same = labelled.groupBy(c).agg(
            *[F.count_if(F.col(label) == g).cast("double").alias(f"_same{i}_{g}") for g in labels]
        )
        out = joins.salted(out, same, [c], null_safe=True)
    norm = mixed.squared_norm([mixed.name(c) for c in numeric])
    out = out.withColumn("_norm", F.expr(norm))

    def total_distance(g: int) -> str:
        t = totals[g]
        n = mixed.number(t["_n"])
        cross = " + ".join(f"`{c}` * {mixed.number(t[c])}" for c in numeric) or "0D"
        miss = " + ".join(f"({n} - _same{i}_{g})" for i in range(len(categorical))) or "0D"
        inner = f"greatest(_norm * {n} - 2D * ({cross}) + {mixed.number(t['_q'])}, 0D)"
        return f"({inner} + {mixed.number(gamma)} * ({miss}))"

    own, others = [], []
    for g in labels:
        n = totals[g]["_n"]
        if n > 1:
            own.append(f"WHEN `{label}` = {g} THEN {total_distance(g)} / {mixed.number(n - 1)}")
        others.append(f"CASE WHEN `{label}` <> {g} THEN {total_distance(g)} / {mixed.number(n)} END")
    inside = f"CASE {' '.join(own)} END" if own else "CAST(NULL AS DOUBLE)"
    outside = f"least({', '.join(others)})" if len(others) > 1 else "CAST(NULL AS DOUBLE)"
    scored = out.withColumns({"a": F.expr(inside), "b": F.expr(outside)})
    score = "CASE WHEN a IS NULL THEN 0D ELSE coalesce(try_divide(b - a, greatest(a, b)), 0D) END"
    return scored.select(*labelled.columns, "a", "b", F.expr(score).alias("silhouette"))


def silhouette(
    labelled: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    gamma: float,
    label: str = "label",
) -> DataFrame:
    """The mean over all points, one row."""
    return silhouette_rows(labelled, numeric, categorical, gamma, label).agg(
        F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n")
    )


def silhouettes(points: DataFrame, found: Sequence[Clustering]) -> list[float]:
    """The mean over all points under the labels of each clustering, by two passes for all of them.

    The first sums what every cluster holds, the second scores the points with these sums. If the sums are many,
    each clustering has passes of its own instead (:func:`silhouette`).
    """
    numeric, categorical, gamma = found[0].numeric, found[0].categorical, found[0].gamma
    cells = _Cells(found, range(len(found)))
    ready, rows, few = in_passes(filled(points, numeric, categorical), categorical, len(cells.places))
    if not few:
        of = [silhouette(f.assign(points), numeric, categorical, gamma).first() for f in found]
        return [float(r["silhouette"]) for r in of]
    totals = _added({}, ready.mapInArrow(_sums_of_labels(cells), _Sums.DDL).toArrow().to_pylist())
    means = [0.0] * len(found)
    for r in ready.mapInArrow(_scores(cells, totals), "run int, total double").collect():
        means[r["run"]] += r["total"] / rows
    return means


def _sums_of_labels(cells: _Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(cells)
        for b in filter(len, batches):
            x, coded = _points(b, len(cells.numeric))
            for r, span in cells.spans.items():
                sums.add(r, cells.distances(x, coded, span).argmin(axis=0), x, coded)
            if len(sums.counts) > HELD_COUNTS:
                yield sums.held()
        yield sums.rest()

    return run


def _scores(cells: _Cells, totals: Mapping[tuple, tuple]):
    """Sum of the scores of a task's points under each clustering; as in :func:`silhouette_rows`."""
    places = [(*of, None, None) for of in cells.places]
    sizes = np.array([totals[p][0] if p in totals else 0 for p in places], float)
    held = np.array([totals[p][1] if p in totals else np.zeros(1 + len(cells.numeric)) for p in places])
    counts = {of: n for of, (n, _) in totals.items() if of[2] is not None}

    def distances(x: np.ndarray, coded: Sequence[tuple], r: int, span: slice) -> np.ndarray:
        """From every point to all points of each cluster of a run."""
        n, sums = sizes[span, None], held[span]
        out = np.maximum((x * x).sum(axis=0) * n - 2 * (sums[:, 1:] @ x) + sums[:, :1], 0)
        for name, (codes, values) in zip(cells.categorical, coded, strict=True):
            same = np.array([[counts.get((r, i, name, v), 0) for v in values] for i in range(len(n))], float)
            out += (cells.gamma * (n - same))[:, codes]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = np.zeros(len(cells.spans))
        for b in filter(len, batches):
            x, coded = _points(b, len(cells.numeric))
            every = np.arange(b.num_rows)
            for i, (r, span) in enumerate(cells.spans.items()):
                label, n = cells.distances(x, coded, span).argmin(axis=0), sizes[span]
                total = distances(x, coded, r, span)
                inside = total[label, every] / np.maximum(n[label] - 1, 1)
                total /= np.maximum(n, 1)[:, None]
                total[n == 0] = np.inf
                total[label, every] = np.inf
                outside = total.min(axis=0)
                most = np.maximum(inside, outside)
                scored = (n[label] > 1) & np.isfinite(outside) & (most > 0)
                scores[i] += ((outside - inside)[scored] / most[scored]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(cells.spans), pa.int32()), pa.array(scores)], names=["run", "total"])

    return run


def best_k(
    points: DataFrame,
    ks: Sequence[int],
    numeric: Sequence[str],
    categorical: Sequence[str],
    key: str = "account",
    starts: Mapping[int, Sequence[Sequence[Centroid]]] | None = None,
    **options,
) -> DataFrame:
    """(k, clusters, cost, silhouette, is_best) for each k; one-cluster results score null.

    All starts of all k share the jobs of an iteration. Only one score per k comes back to the driver.
    """
    spark = points.sparkSession
    runs, seed = options.pop("runs", 1), options.pop("seed", 0)
    gamma = options.pop("gamma", None) or default_gamma(points, numeric)
    of = {k: (starts or {}).get(k) or seed_centroids(points, k, runs, numeric, categorical, key, seed) for k in ks}
    every = iter(k_prototypes_runs(points, [s for k in ks for s in of[k]], numeric, categorical, gamma, **options))
    found = [_cheapest([next(every) for _ in of[k]]) for k in ks]
    filled_of = [sum(1 for s in f.sizes if s) for f in found]
    several = [i for i, n in enumerate(filled_of) if n > 1]
    scores = dict(zip(several, silhouettes(points, [found[i] for i in several]), strict=True)) if several else {}
    rows = [(k, n, f.cost, scores.get(i)) for i, (k, n, f) in enumerate(zip(ks, filled_of, found, strict=True))]
    known = [r for r in rows if r[3] is not None and not math.isnan(r[3])]
    top = max(known, key=lambda r: (r[3], -r[0]))[0] if known else None
    return spark.createDataFrame(
        [(*r, r[0] == top) for r in rows], "k int, clusters int, cost double, silhouette double, is_best boolean"
    )
