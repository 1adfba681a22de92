"""Registered queries: mixed-type clustering of the client table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from usage_ts.operators import clustering as CL
from usage_ts.plans.ingest import profiles, profiles_cte

NUMERIC = ["num_a", "num_b", *[f"cons_{m}m_ago" for m in range(12)]]
CATEGORICAL = ["cat_a", "cat_b", "flag_raw"]
K, ITERATIONS, GAMMA = 4, 3, 0.5
SWEEP = (2, 3, 4)
#: What the SQL twins follow: a fixed number of updates.
UPDATES = {"max_iter": ITERATIONS + 1, "tolerance": -1.0}
#: Until nothing but the order of summation still moves the cost; for the queries named ``_settled``.
SETTLED = {"tolerance": 1e-12}
SETTLED_SWEEP = tuple(range(3, 13))


def scaled_profiles(spark, sf):
    """(profiles, scaler, scaled points); both tables are persisted, as every iteration reads the points."""
    p = profiles(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    scaler = CL.fit_scaler(p, NUMERIC)
    points = scaler.transform(p).select("account", *NUMERIC, *CATEGORICAL)
    return p, scaler, points.persist(StorageLevel.MEMORY_AND_DISK)


def first_accounts(points, k):
    """The k accounts with the smallest number as start centroids."""
    rows = points.orderBy("account").limit(k).collect()
    return [CL.Centroid([r[c] for c in NUMERIC], [r[c] for c in CATEGORICAL]) for r in rows]


def clustered(spark, sf, k=K, until=UPDATES):
    p, scaler, points = scaled_profiles(spark, sf)
    found = CL.k_prototypes(
        points, k, NUMERIC, CATEGORICAL, gamma=GAMMA, starts=[first_accounts(points, k)], **until
    )
    return p, scaler, points, found


def _start_labels(spark, sf):
    _, _, points = scaled_profiles(spark, sf)
    return CL.assign(points, first_accounts(points, K), NUMERIC, CATEGORICAL, GAMMA)


def mixed_nearest(spark, sf):
    return _start_labels(spark, sf).select("account", "label", F.round("cost", 6).alias("cost"))


def centroid_update(spark, sf):
    labelled = _start_labels(spark, sf)
    means = CL.numeric_update(labelled, ["label"], NUMERIC)
    numbers = means.select(
        "label",
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 6).cast("double").alias("mean")) for c in NUMERIC])
        ),
        F.lit(None).cast("string").alias("value"),
    )
    modes = CL.category_update(labelled, ["label"], CATEGORICAL)
    return numbers.unionByName(modes.withColumn("mean", F.lit(None).cast("double")))


def _shares(labelled):
    return CL.cluster_shares(labelled).select("label", "n", F.round("percent", 6).alias("percent"))


def _scores(labelled):
    rows = CL.silhouette_rows(labelled, NUMERIC, CATEGORICAL, GAMMA)
    return rows.select("account", "label", *[F.round(c, 6).alias(c) for c in ("a", "b", "silhouette")])


def cluster_shares(spark, sf):
    """Shares of the labels by the start rows, without an update, as in its twin."""
    return _shares(_start_labels(spark, sf))


def silhouette(spark, sf):
    """Scores of the labels by the start rows, without an update, as in its twin."""
    return _scores(_start_labels(spark, sf))


def _settled_labels(spark, sf):
    _, _, points, found = clustered(spark, sf, until=SETTLED)
    return found.assign(points)


def cluster_shares_settled(spark, sf):
    return _shares(_settled_labels(spark, sf))


def silhouette_settled(spark, sf):
    return _scores(_settled_labels(spark, sf))


def kprototypes(spark, sf, until=UPDATES):
    _, _, _, found = clustered(spark, sf, until=until)
    cells = [
        (i, f, float(v), None) for i, c in enumerate(found.centroids) for f, v in zip(NUMERIC, c.numeric)
    ] + [(i, f, None, v) for i, c in enumerate(found.centroids) for f, v in zip(CATEGORICAL, c.categorical)]
    table = spark.createDataFrame(cells, "label int, feature string, mean double, value string")
    return table.withColumn("mean", F.round("mean", 6))


def kprototypes_restarts(spark, sf):
    """Three seeded starts to convergence; the cost of the winner per iteration."""
    _, _, points = scaled_profiles(spark, sf)
    found = CL.k_prototypes(points, K, NUMERIC, CATEGORICAL, runs=3, seed=3)
    rows = [(i, float(c)) for i, c in enumerate(found.costs)]
    return spark.createDataFrame(rows, "iteration int, cost double")


def cluster_assignments(spark, sf, until=UPDATES):
    p, _, points, found = clustered(spark, sf, until=until)
    members = CL.cluster_memberships(p, found.assign(points))
    return members.select("account", "cluster", "rate_class", *CATEGORICAL, *NUMERIC)


def centroid_report(spark, sf, until=UPDATES):
    p, _, points, found = clustered(spark, sf, until=until)
    flags = p.withColumn("flag", (F.col("flag_raw") == "X").cast("double"))
    report = CL.centroid_report(
        flags, found.assign(points), NUMERIC, ["cat_a", "cat_b", "flag"], booleans=["flag"]
    )
    return report.select("cluster", F.round("percent", 6).alias("percent"), *[F.round(c, 9).alias(c) for c in NUMERIC], "cat_a", "cat_b", "flag")


def best_k(spark, sf, ks=SWEEP, until=UPDATES):
    _, _, points = scaled_profiles(spark, sf)
    starts = {k: [first_accounts(points, k)] for k in ks}
    table = CL.best_k(points, ks, NUMERIC, CATEGORICAL, gamma=GAMMA, starts=starts, **until)
    return table.select("k", "clusters", F.round("silhouette", 6).alias("silhouette"), "is_best")


def kprototypes_settled(spark, sf):
    return kprototypes(spark, sf, SETTLED)


def cluster_assignments_settled(spark, sf):
    return cluster_assignments(spark, sf, SETTLED)


def centroid_report_settled(spark, sf):
    return centroid_report(spark, sf, SETTLED)


def best_k_settled(spark, sf):
    return best_k(spark, sf, SETTLED_SWEEP, SETTLED)


# --- SQL twins -------------------------------------------------------------

NS = [f"n{i}" for i in range(len(NUMERIC))]
CS = [f"c{i}" for i in range(len(CATEGORICAL))]


def points_cte() -> str:
    scaled = ", ".join(
        f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {n}" for c, n in zip(NUMERIC, NS)
    )
    names = ", ".join(f"{c} AS {n}" for c, n in zip(CATEGORICAL, CS))
    return f"{profiles_cte()},\npts AS (SELECT account, {scaled}, {names} FROM profiles)"


def _distance(a: str, b: str) -> str:
    num = " + ".join(f"pow({a}.{n} - {b}.{n}, 2)" for n in NS)
    cat = " + ".join(f"CAST({a}.{c} <> {b}.{c} AS DOUBLE)" for c in CS)
    return f"({num} + {GAMMA} * ({cat}))"


def _start(tag: str, k: int) -> str:
    cols = ", ".join([*NS, *CS])
    return f"""s{tag}_0 AS (SELECT CAST(row_number() OVER (ORDER BY account) - 1 AS INTEGER) AS label, {cols}
  FROM (SELECT * FROM pts ORDER BY account LIMIT {k}))"""


def _assign(tag: str, i: int) -> str:
    return f"""l{tag}_{i} AS (SELECT * EXCLUDE (pick) FROM (SELECT p.*, s.label, {_distance('p', 's')} AS cost,
  row_number() OVER (PARTITION BY p.account ORDER BY {_distance('p', 's')}, s.label) AS pick
  FROM pts p CROSS JOIN s{tag}_{i} s) WHERE pick = 1)"""


def _mode(col: str, tag: str, i: int) -> str:
    return f"""(SELECT label, v FROM (SELECT label, {col} AS v, row_number() OVER (PARTITION BY label
    ORDER BY count(*) DESC, {col}) AS r FROM l{tag}_{i} GROUP BY label, {col}) WHERE r = 1)"""


def _update(tag: str, i: int) -> str:
    means = ", ".join(f"avg({n}) AS {n}" for n in NS)
    joins = " ".join(f"JOIN {_mode(c, tag, i)} m{j} USING (label)" for j, c in enumerate(CS))
    modes = ", ".join(f"m{j}.v AS {c}" for j, c in enumerate(CS))
    return f"""s{tag}_{i + 1} AS (SELECT label, {', '.join(NS)}, {modes}
  FROM (SELECT label, {means} FROM l{tag}_{i} GROUP BY label) a {joins})"""


def cluster_ctes(k: int = K, tag: str = "a", iterations: int = ITERATIONS) -> str:
    parts = [_start(tag, k)]
    for i in range(iterations):
        parts += [_assign(tag, i), _update(tag, i)]
    parts.append(_assign(tag, iterations))
    return ",\n".join(parts)


def _centroid_rows(source: str) -> str:
    rows = [
        f"SELECT label, '{c}' AS feature, round({n}, 6) AS mean, NULL AS value FROM {source}"
        for c, n in zip(NUMERIC, NS)
    ]
    rows += [f"SELECT label, '{c}', NULL, {n} FROM {source}" for c, n in zip(CATEGORICAL, CS)]
    return " UNION ALL ".join(rows)


def _silhouette_cte(labels: str, out: str) -> str:
    return f"""{out}_d AS (SELECT x.account, x.label, y.label AS other, sum({_distance('x', 'y')}) AS s, count(*) AS n
  FROM {labels} x JOIN {labels} y ON true GROUP BY x.account, x.label, y.label),
{out}_ab AS (SELECT account, label, max(CASE WHEN other = label AND n > 1 THEN s / (n - 1) END) AS a,
  min(CASE WHEN other <> label THEN s / n END) AS b FROM {out}_d GROUP BY account, label),
{out} AS (SELECT *, CASE WHEN a IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS silhouette
  FROM {out}_ab)"""


def _report_sql() -> str:
    final = f"la_{ITERATIONS}"
    means = ", ".join(f"round(avg({c}), 9) AS {c}" for c in NUMERIC)

    def mode(expr):
        return f"""(SELECT cluster, v FROM (SELECT cluster, {expr} AS v, row_number() OVER (PARTITION BY cluster
          ORDER BY count(*) DESC, {expr}) AS r FROM mem GROUP BY cluster, {expr}) WHERE r = 1)"""

    flag = "CASE WHEN flag_raw = 'X' THEN 1.0 ELSE 0.0 END"
    return f"""WITH {points_cte()}, {cluster_ctes()},
mem AS (SELECT l.label + 1 AS cluster, p.* FROM {final} l JOIN profiles p USING (account)),
agg AS (SELECT cluster, round(count(*) * 100.0 / (SELECT count(*) FROM mem), 6) AS percent, {means} FROM mem GROUP BY cluster)
SELECT agg.*, x.v AS cat_a, y.v AS cat_b, CAST(z.v AS DOUBLE) AS flag FROM agg JOIN {mode('cat_a')} x USING (cluster)
JOIN {mode('cat_b')} y USING (cluster) JOIN {mode(flag)} z USING (cluster)"""


def _best_k_sql() -> str:
    parts = [points_cte()]
    for k in SWEEP:
        parts += [cluster_ctes(k, f"k{k}"), _silhouette_cte(f"lk{k}_{ITERATIONS}", f"sil{k}")]
    rows = " UNION ALL ".join(
        f"SELECT {k} AS k, (SELECT count(DISTINCT label) FROM lk{k}_{ITERATIONS}) AS clusters, avg(silhouette) AS s FROM sil{k}"
        for k in SWEEP
    )
    return f"""WITH {', '.join(parts)}, t AS ({rows})
SELECT CAST(k AS INTEGER) AS k, CAST(clusters AS INTEGER) AS clusters, round(s, 6) AS silhouette,
       row_number() OVER (ORDER BY s DESC, k) = 1 AS is_best FROM t"""


QUERIES = {
    "mixed_nearest": mixed_nearest,
    "centroid_update": centroid_update,
    "cluster_shares": cluster_shares,
    "silhouette": silhouette,
    "kprototypes": kprototypes,
    "kprototypes_restarts": kprototypes_restarts,
    "cluster_assignments": cluster_assignments,
    "centroid_report": centroid_report,
    "best_k": best_k,
    "cluster_shares_settled": cluster_shares_settled,
    "silhouette_settled": silhouette_settled,
    "kprototypes_settled": kprototypes_settled,
    "cluster_assignments_settled": cluster_assignments_settled,
    "centroid_report_settled": centroid_report_settled,
    "best_k_settled": best_k_settled,
}

_FIRST = f"WITH {points_cte()}, {_start('a', K)}, {_assign('a', 0)}"
ORACLES = {
    "mixed_nearest": f"{_FIRST} SELECT account, label, round(cost, 6) AS cost FROM la_0",
    "centroid_update": f"{_FIRST}, {_update('a', 0)} {_centroid_rows('sa_1')}",
    "cluster_shares": f"""{_FIRST} SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM la_0 GROUP BY label""",
    "silhouette": f"""{_FIRST}, {_silhouette_cte('la_0', 'sil')}
SELECT account, label, round(a, 6) AS a, round(b, 6) AS b, round(silhouette, 6) AS silhouette FROM sil""",
    "kprototypes": f"WITH {points_cte()}, {cluster_ctes()} {_centroid_rows(f'sa_{ITERATIONS}')}",
    "cluster_assignments": f"""WITH {points_cte()}, {cluster_ctes()}
SELECT account, label + 1 AS cluster, rate_class, {', '.join(CATEGORICAL)}, {', '.join(NUMERIC)}
FROM la_{ITERATIONS} JOIN profiles USING (account)""",
    "centroid_report": _report_sql(),
    "best_k": _best_k_sql(),
}
