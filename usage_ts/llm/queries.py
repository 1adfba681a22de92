"""Registered queries of the text operators, with SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_ts.llm import (
    embedding_dedup,
    fill_middle,
    html_extract,
    importance,
    language_id,
    packing,
    quality_gam,
    quality_rules,
    sentencepiece_codec,
    simhash,
    slack_packing,
    substring_dedup,
    url_tree,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.learn(docs, _table(spark, sf_dir, "labels")))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remaining(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = slack_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    output, back = F.col("output"), fill_middle.restored(F.col("output"), F.col("form"))
    return written.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_packing,
        op3_sentencepiece,
        op4_html_extraction,
        op5_quality_classifier,
        op6_url_filters,
        op7_quality_rules,
        op8_substring_dedup,
        op9_embedding_near_dedup,
        op10_language_id,
        op11_importance_resampling,
        op12_best_fit_packing,
        op13_fill_in_middle,
    )
}
_WORDS = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
e AS (SELECT rid, doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w)"""

ORACLES: dict[str, str] = {
    "op7_quality_rules": _WORDS
    + r""",
g AS (SELECT rid, i, x || ' ' || lead(x, 1) OVER v || ' ' || lead(x, 2) OVER v || ' ' || lead(x, 3) OVER v || ' ' || lead(x, 4) OVER v AS five
      FROM e WINDOW v AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM g WHERE five IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
c AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) - i AS gap FROM r),
n AS (SELECT rid, CAST(sum(least(5, coalesce(gap, 5))) AS BIGINT) AS rep FROM c GROUP BY rid),
m AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM w),
a AS (SELECT m.*, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words
      FROM m LEFT JOIN n USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * len(ls))
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_words > 100000) AS kept
FROM b""",
    "op8_substring_dedup": _WORDS
    + r""",
g AS (SELECT rid, doc_id, i, string_agg(x, ' ') OVER v AS span, count(*) OVER v AS n
      FROM e WINDOW v AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
h AS (SELECT rid, i FROM g WHERE n = 50 QUALIFY doc_id > min(doc_id) OVER (PARTITION BY span)),
k AS (SELECT e.rid, e.i, e.x, max(h.i) OVER (PARTITION BY e.rid ORDER BY e.i) AS last FROM e LEFT JOIN h ON h.rid = e.rid AND h.i = e.i),
s AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 50) AS kept,
        count(*) FILTER (WHERE i - last < 50) AS gone FROM k GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (rid)""",
    "op13_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS same,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
        CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
k AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b,
        CASE WHEN same OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
s AS (SELECT *, coalesce(array_to_string(ls[1:a], ''), '') AS p, coalesce(array_to_string(ls[a + 1:b], ''), '') AS m,
        coalesce(array_to_string(ls[b + 1:n], ''), '') AS x FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
         ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s""",
}
