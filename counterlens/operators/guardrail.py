"""Benchmark accuracy with ties, edit decisions, sample-size planning and probe-size rules."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.operators.resampling import replicate_sums


def best_of_n(completions: DataFrame, by: list[str], score: str, correct: str) -> DataFrame:
    """Per item: 1/k if its correct completion shares the top score with k - 1 others, else 0. Equal scores of an item
    are counted first, so no list of completions is built."""
    tied = completions.groupBy(*by, score).agg(F.count(F.lit(1)).alias("__k"), F.bool_or(correct).alias("__right"))
    return tied.groupBy(*by).agg(F.max(F.struct(F.col(score).alias("s"), "__k", "__right")).alias("t")).select(
        *by, F.when(F.col("t.__right"), 1.0 / F.col("t.__k")).otherwise(0.0).alias("value"))


def tie_stats(completions: DataFrame, by: list[str], score: str, correct: str) -> DataFrame:
    """Per item with several correct completions: accurate, spread of the correct scores (null with one), gap."""
    c = F.col(correct)
    a = completions.groupBy(*by).agg(F.min(F.when(c, F.col(score))).alias("__lo"), F.max(F.when(c, F.col(score))).alias("__hi"),
                                     F.max(F.when(~c, F.col(score))).alias("__wrong"), F.count_if(c).alias("__n"))
    gap = F.col("__lo") - F.col("__wrong")
    return a.select(*by, (gap > 0).cast("double").alias("accurate"), F.when(F.col("__n") > 1, F.col("__hi") - F.col("__lo")).alias("spread"), gap.alias("gap"))


def question_values(stats: DataFrame, question: str, kind: str) -> DataFrame:
    """One value per question with a tied and a ref item; their mean is the weighted ties score
    .30 tied + .30 ref + .20 preferred + .20 preferred on the harder + .01 margin."""
    s = stats.groupBy(question).agg(*[F.max(F.when(F.col(kind) == k, F.col(c))).alias(f"{k}_{c}") for k in ("tied", "ref") for c in ("accurate", "spread", "gap")])
    s = s.filter(F.col("tied_gap").isNotNull() & F.col("ref_gap").isNotNull())
    spread, hard = F.col("tied_spread"), F.least("tied_gap", "ref_gap")
    margin = F.when(spread.isNull(), 0.0).when(spread == 0, F.signum(hard)).otherwise(F.tanh(hard / F.when(spread != 0, spread) - 1))
    over = lambda g: F.coalesce((g > spread).cast("double"), F.lit(0.0))
    return s.select(question, (0.30 * F.col("tied_accurate") + 0.30 * F.col("ref_accurate") + 0.20 * over(F.col("tied_gap"))
                               + 0.20 * over(hard) + 0.01 * margin).alias("value"))


def subset_scores(values: DataFrame, subset: str, value: str = "value") -> DataFrame:
    """Mean per subset and their unweighted mean as ``overall``."""
    per = values.groupBy(subset).agg(F.avg(value).alias("score"), F.count(F.lit(1)).alias("items"))
    return per.unionByName(per.agg(F.lit("overall").alias(subset), F.avg("score").alias("score"), F.sum("items").alias("items")))


def edit_changes(values: DataFrame, subset: str, key: str, replicates: int, seed: int, level: float = 0.05) -> DataFrame:
    """Paired change (edit - base) per subset and overall: rows are resampled inside their subset with the same draws
    for base and edit. Gives the two-sided interval and the one-sided lower bound at ``level``."""
    d = values.select(subset, key, "base", "edit", (F.col("edit") - F.col("base")).alias("d"), F.lit(1.0).alias("one"))
    point = d.groupBy(subset).agg(F.avg("edit").alias("score"), F.avg("d").alias("change"))
    point = point.unionByName(point.agg(F.lit("overall").alias(subset), F.avg("score").alias("score"), F.avg("change").alias("change")))
    boot = replicate_sums(d, key, ["d", "one"], [subset], replicates, seed).select(subset, "b", (F.col("d") / F.col("one")).alias("x"))
    boot = boot.unionByName(boot.groupBy("b").agg(F.avg("x").alias("x")).select(F.lit("overall").alias(subset), "b", "x"))
    ci = boot.groupBy(subset).agg(F.percentile("x", F.lit(0.025)).alias("ci_low"), F.percentile("x", F.lit(0.975)).alias("ci_high"),
                                  F.percentile("x", F.lit(level)).alias("lower_bound"), F.count("x").alias("n_boot"))
    return point.join(ci, subset)


def non_inferior(changes: DataFrame, margin: float) -> Column:
    """The lower bound stays above the margin."""
    return F.col("lower_bound") > -margin


def fixed_sequence(decisions: DataFrame, by: list[str], alpha: str, ok: str) -> DataFrame:
    """Strongest edit claimed in a fixed sequence: strengths in rising order pass until the first failure."""
    w = Window.partitionBy(*by).orderBy(alpha).rowsBetween(Window.unboundedPreceding, 0)
    passed = decisions.withColumn("__ok", F.min(F.col(ok).cast("int")).over(w))
    return passed.groupBy(*by).agg(F.max(F.when(F.col("__ok") == 1, F.col(alpha))).alias("claimed"))


# ---- planning -----------------------------------------------------------------------------------------------------------
def required_n(ratio: Column, delta: Column, comparisons: int = 1, level: float = 0.05, power: float = 0.8) -> Column:
    """ceil(((z1 + z2) r / delta)^2), two-sided at ``level / comparisons``."""
    z = NormalDist().inv_cdf(1 - level / comparisons / 2) + NormalDist().inv_cdf(power)
    return F.ceil(F.pow(F.lit(z) * ratio / delta, F.lit(2.0)) - 1e-9).cast("long")


def size_contrasts(contrasts: DataFrame, by: list[str], deltas: list[float], comparisons: int = 1) -> DataFrame:
    """Per group and effect size: the binding contrast (largest r = sd / scale_sd), n for it, and whether it exceeds
    what is available. ``contrasts`` has (by, contrast, sd, scale_sd, available); a contrast without a scale is listed
    as unsized. Means are never read."""
    r = F.col("sd") / F.when(F.col("scale_sd") > 0, F.col("scale_sd"))
    per = contrasts.withColumn("r", r).groupBy(*by).agg(
        F.max_by("contrast", "r").alias("binding"), F.max("r").alias("r"), F.count_if(F.col("r").isNull()).alias("unsized"), F.max("available").alias("available"))
    grid = per.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    n = grid.withColumn("n", required_n(F.col("r"), F.col("delta"), comparisons))
    return n.withColumn("exceeds_available", F.col("n") > F.col("available"))


def max_or_null(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """The maximum over models, null as soon as one model has none."""
    return df.groupBy(*by).agg(F.when(F.count(n) == F.count(F.lit(1)), F.max(n)).alias(n))


def smallest_passing(points: DataFrame, by: list[str], n: str, ok: str) -> DataFrame:
    """The smallest size from which every larger size passes; null when the largest fails."""
    w = Window.partitionBy(*by).orderBy(F.col(n).desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = points.withColumn("__ok", F.min(F.col(ok).cast("int")).over(w))
    return s.groupBy(*by).agg(F.min(F.when(F.col("__ok") == 1, F.col(n))).alias("smallest"))
