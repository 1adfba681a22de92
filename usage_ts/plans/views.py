"""SQL text shared by the oracles: the billing views written out for DuckDB."""

BILLING = """billing AS (
  SELECT o_custkey AS account, concat('W&S_', upper(c_mktsegment)) AS rate_class,
         CAST(l_shipdate AS DATE) AS start_d,
         CAST(l_shipdate AS DATE) + CAST(20 + 3 * l_linenumber AS INTEGER) AS end_d,
         CAST(l_quantity AS DECIMAL(18,2)) AS consumption,
         abs(l_discount) AS num_a, abs(l_tax) AS num_b,
         CASE WHEN l_returnflag = 'R' THEN 'X' ELSE ' ' END AS flag_raw,
         l_linestatus AS cat_a, o_orderpriority AS cat_b,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

DEDUP = (
    BILLING
    + """,
dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, start_d, end_d
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM billing) WHERE rn = 1)"""
)

DAYS = (
    DEDUP
    + """,
days AS (
  SELECT *, CAST(consumption / (date_diff('day', start_d, end_d) + 1) AS DECIMAL(18,6)) AS rate,
         CAST(unnest(generate_series(CAST(start_d AS TIMESTAMP), CAST(end_d AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d
  FROM dedup)"""
)

# One daily series per rate class: series_key, ds, y.
SERIES = (
    DAYS
    + """,
series AS (
  SELECT rate_class AS series_key, d AS ds, CAST(sum(rate) AS DOUBLE) AS y,
         row_number() OVER (PARTITION BY rate_class ORDER BY d) AS rn,
         count(*) OVER (PARTITION BY rate_class) AS n
  FROM days GROUP BY rate_class, d)"""
)
