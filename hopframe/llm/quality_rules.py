"""Quality rules whose cutoffs are chosen under a guarantee on false rejections.

``measure`` counts what the rules look at.  ``calibrate`` takes every labelled
good document as a holdout: for each stratum and rule, cutoffs from lenient to
strict are tested with the exact binomial tail.  A cutoff passes if so few
good documents exceed it that a true rejection rate above the rule's share of
``risk`` has at most probability ``delta`` over all strata and rules
(Bonferroni).  Within a rule cutoffs are nested and tested in fixed order, so
no further correction is due.  ``judge`` rejects what exceeds a chosen cutoff.

Nulls: a null text has no words and fails the base.  A null language is a
stratum of its own.  Labels that repeat an id count once, as bad if any row
says so.  Strata without enough labels get no cutoff and reject nothing
beyond the base.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm._store import join_small, let, source_key, stored

BLANK = r"[\x20\x09-\x0D]"
# Each rule is a ratio of two measures; its cutoffs fall from `top` by `step`.
RULES = {
    "symbols": ("n_symbols", "n_words", 2.0, 0.85),
    "repeats": ("n_repeat_words", "n_words", 1.0, 0.9),
    "same_lines": ("n_dup_lines", "n_words", 0.5, 0.85),
    "capitals": ("n_capitals", "word_chars", 1.0, 0.9),
    "marks": ("n_marks", "n_words", 2.0, 0.85),
}
STEPS = 40
RISK = 0.05
DELTA = 0.05


def _repeat_words(words: Column, window: int) -> Column:
    """Words within windows that occur twice or more; windows meet by a 64-bit hash inside the row."""

    def covered(starts: Column) -> Column:
        spans = F.transform(
            starts,
            lambda x, k: F.when(k < F.size(starts) - 1, F.least(F.lit(window), F.get(starts, k + 1) - x)).otherwise(window),
        )
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        hit = F.filter(
            pairs,
            lambda s, j: F.get(pairs, j - 1)["h"].eqNullSafe(s["h"]) | F.get(pairs, j + 1)["h"].eqNullSafe(s["h"]),
        )
        return let(F.sort_array(F.transform(hit, lambda s: s["i"])), covered)

    def paired(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, repeated))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, paired))


def measure(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """One row per document with its counts; ``docs`` columns other than the text stay."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, f"{BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, window).cast("long").alias("n_repeat_words")),
    )
    rest = [c for c in docs.columns if c != text]
    return docs.select(
        *rest,
        counts.alias("__c"),
        (F.length(body) - F.regexp_count(body, F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.regexp_count(body, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(body, F.lit("[!?]")).cast("long").alias("n_marks"),
    ).select(*rest, "__c.*", "word_chars", "n_symbols", "n_dup_lines", "n_capitals", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def _ratio(rule: str) -> Column:
    part, whole, _, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def cutoffs(rule: str) -> list[float]:
    """From lenient to strict."""
    _, _, top, step = RULES[rule]
    return [round(top * step**j, 6) for j in range(STEPS)]


def _first_exceeded(rule: str) -> Column:
    """Number of the most lenient cutoff that a document exceeds; all stricter ones are exceeded too."""
    return F.size(F.filter(F.array(*map(F.lit, cutoffs(rule))), lambda c: _ratio(rule) <= c))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, brought back by the ten factors between."""
    x = n.cast("double") + 11.0
    series = (x - 0.5) * F.log(x) - x + 0.918938533204672742 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return series - reduce(lambda a, b: a + b, [F.log(n.cast("double") + i) for i in range(1, 11)])


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), exact to double precision; 1 where k reaches the mean.

    Below the mean the terms fall from k downwards, each by more than the one
    before, and are added until 12 standard deviations on; the rest is below
    the precision of a double.
    """
    log_top = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * float(_ln(rate)) + (n - k) * float(_ln(1 - rate))
    )
    depth = F.least(k, (F.lit(12.0) * F.sqrt(n * rate) + 60).cast("long"))
    steps = F.transform(F.sequence(F.lit(0).cast("long"), depth), lambda i: (k - i).cast("double"))
    start = F.struct(F.exp(log_top).alias("term"), F.lit(0.0).alias("total"))
    summed = F.aggregate(
        steps,
        start,
        lambda a, i: F.struct(
            (a["term"] * i * (1 - rate) / ((n.cast("double") - i + 1) * rate)).alias("term"),
            (a["total"] + a["term"]).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(summed, F.lit(1.0)))


def _ln(x: float) -> float:
    import math

    return math.log(x)


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "stratum", key: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the chosen cutoff of each rule, null where none passed.

    Only counts per stratum, rule and cutoff are shuffled; they do not grow with the documents.
    """
    good = labels.groupBy(key).agg(F.min("quality").alias("quality")).where("quality = 1").select(key)
    held = measured.where(~base_failed()).join(good, key, "left_semi")
    places = [F.struct(F.lit(r).alias("rule"), _first_exceeded(r).alias("step")) for r in RULES]
    counts = (
        held.select(stratum, F.explode(F.array(*places)).alias("p"))
        .groupBy(stratum, F.col("p.rule").alias("rule"), F.col("p.step").alias("step"))
        .agg(F.count("*").alias("n"))
    )
    grid = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(j).alias("step"), F.lit(c).alias("cutoff")) for r in RULES for j, c in enumerate(cutoffs(r))
    ])
    strata = counts.where(F.col("rule") == next(iter(RULES))).groupBy(stratum).agg(F.sum("n").alias("total"))
    every = strata.select(stratum, "total", F.explode(grid).alias("g")).select(stratum, "total", "g.*")
    nested = Window.partitionBy(stratum, "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = every.join(counts, [stratum, "rule", "step"], "left").withColumn(
        "rejected", F.sum(F.coalesce("n", F.lit(0))).over(nested)
    )
    share = delta / len(RULES)
    n_strata = strata.agg(F.count("*").alias("n_strata"))
    passed = (
        tested.join(F.broadcast(n_strata))  # one row
        .where(binomial_tail(F.col("rejected"), F.col("total"), risk / len(RULES)) <= F.lit(share) / F.col("n_strata"))
    )
    return passed.groupBy(stratum).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])


def judge(measured: DataFrame, chosen: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Add ``base_failed`` and ``kept``; ``chosen`` is a stored table."""
    within = reduce(lambda a, b: a & b, [F.coalesce(_ratio(r) <= F.col(f"max_{r}"), F.lit(True)) for r in RULES])
    return join_small(measured, chosen, [stratum]).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Measure, calibrate and judge; the counts are stored so that texts are read once."""
    measured = stored(measure(docs.select(key, "text", source_key("lang").alias("stratum"))), "quality-rules")
    return judge(measured, stored(calibrate(measured, labels, key=key, risk=risk, delta=delta), "quality-cutoffs"))
