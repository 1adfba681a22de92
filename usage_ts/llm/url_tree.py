"""Verdicts on urls by rules and, where no rule fits, by a tree of path templates per host.

Level by level a path segment stays as it is if its labelled verdicts differ from those of its siblings (test
of two proportions, ``LEAST`` labelled urls on either side; without labels there is no evidence of a
difference), and is merged into a wildcard otherwise. A template is divided further as long as its labels
are mixed and enough for two sides, however deep its paths. Rows that a rule fits are the labels: each template's share of blocked rows, smoothed towards its host's and
that towards the share of all, decides for rows without a rule.

Defined cases: a url that is null or has no ``://`` has empty host and path; repeated rows count and are
judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import settle

#: Fixed rules: verdict, host and path in one text.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
LEAST, SMOOTH, CRITICAL = 5, 5.0, 1.96


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    clean = lambda c: F.coalesce(c, F.lit(""))
    return clean(F.translate(host, ascii_uppercase, ascii_lowercase)), clean(path)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]


def templates(urls: DataFrame) -> DataFrame:
    """``host, path`` (different ones, with counts ``n, labelled, blocked``) with the ``template`` of each."""
    pieces = F.split(F.expr("substring(path, 2)"), "/")
    rows = urls.withColumn("segments", pieces).withColumn("template", F.lit(""))
    done, level = [], 0
    while True:
        seg = F.get("segments", level)
        open_rows = rows.where(F.size("segments") > level).withColumn("segment", seg)
        child = settle(open_rows.groupBy("host", "template", "segment").agg(*_sums()), "branches")
        parent = child.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")))
        other, other_blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
        rate = F.try_divide("all_blocked", "all_labelled")
        spread = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), F.col("labelled")) + F.try_divide(F.lit(1), other)))
        apart = F.abs(F.try_divide("blocked", "labelled") - F.try_divide(other_blocked, other)) > CRITICAL * spread
        stays = (F.col("labelled") >= LEAST) & (other >= LEAST) & F.coalesce(apart, F.lit(False))
        named = child.join(parent, ["host", "template"]).select(
            "host", "template", "segment", F.when(stays, F.col("segment")).otherwise("*").alias("token")
        )
        kept = settle(named, "tokens")
        longer = F.concat("template", F.lit("/"), "token")
        joined = rows.withColumn("segment", F.coalesce(seg, F.lit(""))).join(kept, ["host", "template", "segment"], "left")
        rows = joined.withColumn("template", F.when(F.size("segments") > level, longer).otherwise(F.col("template")))
        rows = settle(rows.drop("segment", "token"), "templates")
        level += 1
        # Only templates with mixed labels, and enough of them below, can be divided further.
        below = F.size("segments") > level
        held = [F.sum(F.when(below, F.col(c)).otherwise(0)).alias(f"below_{c}") for c in ("labelled", "blocked")]
        mixed = rows.groupBy("host", "template").agg(*held)
        mixed = settle(mixed.where((F.col("below_labelled") >= 2 * LEAST) & F.col("below_blocked").between(1, F.col("below_labelled") - 1)), "mixed")
        keys = ["host", "template"]
        done.append(rows.join(mixed, keys, "left_anti").drop("segments"))
        rows = settle(rows.join(mixed.select(*keys), keys, "left_semi"), "open")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, template, blocked_share``."""
    host, path = parts(F.col("url").cast("string"))
    split = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "ruled": verdict})
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    urls = ruled.groupBy("host", "path").agg(
        F.count("*").alias("n"), one(F.col("rule").isNotNull()).alias("labelled"), one(F.col("ruled") == "block").alias("blocked")
    )
    of = templates(settle(urls, "urls"))
    total = of.agg(*_sums()).first()
    base = ((total["blocked"] or 0) + 1) / ((total["labelled"] or 0) + 2)
    smooth = lambda prior: (F.col("blocked") + SMOOTH * prior) / (F.col("labelled") + SMOOTH)
    by_host = settle(of.groupBy("host").agg(*_sums()).select("host", smooth(F.lit(base)).alias("host_share")), "hosts")
    leaves = of.groupBy("host", "template").agg(*_sums()).join(by_host, "host")
    leaves = settle(leaves.select("host", "template", smooth(F.col("host_share")).alias("blocked_share")), "leaves")
    known = settle(of.join(leaves, ["host", "template"]).select("host", "path", "template", "blocked_share"), "judged")
    learned = F.when(F.col("blocked_share") > 0.5, "block").otherwise("allow")
    return ruled.join(known, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "blocked_share"
    )
