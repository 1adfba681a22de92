"""Quality rules as a ledger of failure bits, with versioned policies. DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit for each failed
rule. A policy is a mask of rules: what it rejects, and what each of its rules rejects alone, follow from
the bits without reading a text again.

Defined cases: null text counts as no words; repeated rows and null ids keep one row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
#: Name and condition of each rule; its place is its bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("endless", "n_words > 100000"),
)
#: Rules of each version of the policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words", "endless"),
}


def mask_of(policy: str) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return reduce(int.__or__, (bits[n] for n in POLICIES[policy]), 0)


def _repeated(places: str) -> Column:
    """Words covered by windows that start at the sorted places."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(places), i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _fixed(df: DataFrame, **exprs: Column) -> DataFrame:
    """``df`` with new columns that later steps and filters read as values, never as copied expressions.

    A one-element generator does this: neither projections nor filters are moved through it.
    """
    made = F.explode(F.array(F.struct(*(e.alias(n) for n, e in exprs.items())))).alias("made")
    return df.select("*", made).select(*df.columns, *(F.col(f"made.{n}").alias(n) for n in exprs))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (bit i set: rule i failed). No shuffle.

    The sort by fingerprint runs only for texts in which a window occurs again.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    step = _fixed(
        step,
        words=F.array_remove(F.split("text", _SPACE), ""),
        lines=F.filter(F.split("text", "\n"), lambda line: line.rlike(_WORD)),
        n_symbols=(F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long"),
    ).drop("text")
    print_at = lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(WINDOW)))
    step = _fixed(
        step,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        prints=F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), print_at)),
    ).drop("words", "lines")
    again = F.size(F.array_distinct("prints")) < F.size("prints")
    pairs = F.array_sort(F.transform("prints", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = _fixed(step, pairs=F.when(again, pairs)).drop("prints")
    same = lambda x, j: F.coalesce(F.get(F.col("pairs"), j)["h"] == x["h"], F.lit(False))
    places = F.transform("pairs", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
    step = _fixed(step, places=F.array_sort(F.array_compact(places))).drop("pairs")
    step = _fixed(step, n_repeat_words=F.coalesce(_repeated("places"), F.lit(0)).cast("long")).drop("places")
    bits = reduce(Column.__add__, (F.when(F.expr(rule), 1 << i).otherwise(0) for i, (_, rule) in enumerate(RULES)))
    return step.withColumn("failed", bits.cast("long"))


def judge(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; what fails the base is never kept."""
    fails = lambda name: F.col("failed").bitwiseAND(mask_of(name)) != 0
    return ledger.withColumn("base_failed", fails("base")).withColumn("kept", ~(fails("base") | fails(policy)))


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those kept if it alone were left out.

    Documents are first counted by failure pattern (at most one row for each pattern of bits).
    """
    names = POLICIES[policy]
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(mask_of(policy)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(bits[n]).alias("bit")) for n in names))).alias("r")
    each = patterns.select("failed", "n", rules).select("failed", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )
