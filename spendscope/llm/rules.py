"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

Statistics of a text (shares of symbols, repeated lines, repeated words, capitals, and the
mean length of words) each give a rule: a document is rejected where the statistic exceeds
a cutoff. Cutoffs are chosen on documents labelled good, for each stratum (a range of word
counts), such that no more than ``risk`` of the good documents of the stratum are rejected by
all rules together, with a probability of at least ``1 - failure`` for all strata at once:

* All cutoffs are tightened together along one fixed path, a step for each place in their
  lists (a shorter list stays at its last). What a step rejects, every later one rejects.
* A step passes if the exact binomial tail says so: of n good documents its rules together
  reject k, and P(Bin(n, risk) <= k) <= failure / strata, which is the one-sided
  Clopper-Pearson bound with Bonferroni's correction over the strata.
* Steps are tested from the loosest to the strictest and the last before the first failure
  is taken (fixed-sequence testing, which needs no further correction). If the loosest
  fails, for instance for want of labels, nothing is rejected in that stratum.

The bound is on the union of the rules, so it needs no share of the risk for each: about
410 labelled good documents in each of three strata are enough for a first step.

Statistics and tests cover all rows. The tail is summed from its largest term; beyond
``_TERMS`` terms a geometric series bounds the rest from above, so a test errs to the safe
side only.

Defined cases: a NULL text has no words and fails the base rule; a document counts as good
if it has labels and all of them are 1; repeated rows count as often as they occur; a value
equal to a cutoff is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames

_SPACE = "[ \\t-\\r]"
_TERMS = 2000


@dataclass(frozen=True)
class Plan:
    risk: float = 0.01
    failure: float = 0.05
    #: strata are word counts below the first bound, from it to the second, ...
    bounds: tuple[int, ...] = (200, 1000)
    #: cutoffs by statistic, loosest first
    cutoffs: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("symbol_share", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
        ("dup_line_share", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
        ("repeat_share", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
        ("capital_share", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
        ("mean_word", (30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more."""

    def hashed(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    places = F.sequence(F.lit(0), F.size(words) - 3)

    def covered(found: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            return (x["h"] == F.get(found, i - 1)["h"]) | (x["h"] == F.get(found, i + 1)["h"])

        starts = F.array_sort(F.transform(F.filter(found, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"]))
        return let(starts, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, b: a + b)))

    sorted_windows = F.array_sort(F.transform(places, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))
    all_new = let(F.transform(places, hashed), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((F.size(words) < 3) | all_new, F.lit(0)).otherwise(let(sorted_windows, covered)).cast("long")


def statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of every row, ``base_failed``, and the statistics the rules use."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    words = F.filter(F.split(body, f"{_SPACE}+"), lambda w: w != "")

    def without(characters: str) -> Column:
        return F.length(F.translate(body, characters, ""))

    counted = docs.select(
        F.col(key),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        without(" \t\n\x0b\f\r").cast("long").alias("word_chars"),
        (F.length(body) - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length(body) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("capitals"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        key, F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"), "capitals", F.col("l.n_lines").alias("n_lines"),
    ).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("capitals") / chars).alias("capital_share"),
        (F.col("word_chars") / n).alias("mean_word"),
    )


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, and back by the recurrence; x is at least 1."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.ln(x + i)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """An upper bound of P(Bin(n, p) <= k), exact up to ``_TERMS`` terms; 1 where k >= n * p."""
    k, n = k.cast("double"), n.cast("double")
    largest = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))

    def ratio(j: Column) -> Column:
        return (k - j) * (1 - p) / ((n - k + j + 1) * p)

    steps = F.least(k.cast("int"), F.lit(_TERMS))
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, j: F.struct((s["term"] * ratio(j)).alias("term"), (s["sum"] + s["term"] * ratio(j)).alias("sum")),
        lambda s: F.when(k > _TERMS, s["sum"] + s["term"] * ratio(steps) / (1 - ratio(steps))).otherwise(s["sum"]),
    )
    return F.when((n == 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), largest * summed))


def stratum(plan: Plan) -> Column:
    out = F.lit(len(plan.bounds))
    for i, bound in reversed(list(enumerate(plan.bounds))):
        out = F.when(F.col("n_words") < bound, F.lit(i)).otherwise(out)
    return out


def cutoffs(stats: DataFrame, labels: DataFrame, plan: Plan = Plan(), key: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per stratum with labelled good documents: the chosen cutoff of each
    statistic, NULL where the rules may reject nothing."""
    good = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_good")).agg(F.min(label).alias("_least")).where("_least = 1")
    held = stats.where(~F.col("base_failed")).join(good.select("_good"), F.col(key) == F.col("_good"), "left_semi")
    steps = max(len(values) for _, values in plan.cutoffs)

    def rejected(step: int) -> Column:
        out = F.lit(False)
        for name, values in plan.cutoffs:
            out = out | (F.col(name) > values[min(step, len(values) - 1)])
        return out

    counts = held.groupBy(stratum(plan).alias("stratum")).agg(
        F.count("*").alias("n"), F.array(*[F.count_if(rejected(i)) for i in range(steps)]).alias("k"))
    level = plan.failure / (len(plan.bounds) + 1)
    tested = counts.select("stratum", "n", F.posexplode("k").alias("step", "k"))
    failed = F.when(binomial_tail(F.col("k"), F.col("n"), plan.risk) > level, F.col("step"))
    stops = tested.groupBy("stratum", "n").agg(F.coalesce(F.min(failed), F.lit(steps)).alias("stop"))

    def chosen(name: str, values: tuple[float, ...]) -> Column:
        path = [values[min(i, len(values) - 1)] for i in range(steps)]
        return F.get(F.array(*map(F.lit, path)), F.col("stop") - 1).alias(f"{name}_cutoff")

    return stops.select("stratum", "n", *[chosen(name, values) for name, values in plan.cutoffs])


def judged(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The statistics of every row, and ``kept``. The table of cutoffs that is broadcast
    has one row for each stratum of the plan."""
    stats = frames.checkpointed(statistics(docs, text, key))
    limits = frames.checkpointed(cutoffs(stats, labels, plan, key))
    joined = stats.withColumn("stratum", stratum(plan)).join(F.broadcast(limits.drop("n")), "stratum", "left")
    rejected = F.lit(False)
    for name, _ in plan.cutoffs:
        rejected = rejected | F.coalesce(F.col(name) > F.col(f"{name}_cutoff"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected)
