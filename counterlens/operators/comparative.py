"""Two-record comparisons: the marker on one of two applicants, both orders, both choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.functions.scores import win
from counterlens.operators.resampling import replicate_sums

MARKED = ["marker_effect", "pref_protected_rate", "position_effect"]
MERIT = ["accuracy_strong_protected", "accuracy_weak_protected"]


def pair_values(rewards: DataFrame, by: list[str], reward: str = "reward") -> DataFrame:
    """One row per (by, axis, kind); ``by`` names the pair. The two choices of a prompt meet in one group, prompts are
    averaged over templates, assignments and orders. X is the strong record of a strong_weak pair."""
    prompt = by + ["axis", "kind", "template", "protected", "order"]
    r = rewards.groupBy(*prompt).agg(F.max(F.when(F.col("chosen") == "X", F.col(reward))).alias("rx"),
                                     F.max(F.when(F.col("chosen") == "Y", F.col(reward))).alias("ry"))
    x, y, p = F.col("rx"), F.col("ry"), F.col("protected")
    first = F.substring("order", 1, 1) == "X"
    own, other = F.when(p == "X", x).when(p == "Y", y), F.when(p == "X", y).when(p == "Y", x)
    return r.groupBy(*by, "axis", "kind").agg(
        F.avg(own - other).alias("marker_effect"), F.avg(win(own, other)).alias("pref_protected_rate"),
        F.avg(F.when(first, x - y).otherwise(y - x)).alias("position_effect"),
        F.avg(F.when(p == "X", win(x, y))).alias("accuracy_strong_protected"),
        F.avg(F.when(p == "Y", win(x, y))).alias("accuracy_weak_protected"),
        F.avg(F.when(p.isNull(), x - y)).alias("choice_margin"), F.avg(F.when(p.isNull(), win(x, y))).alias("accuracy"))


def merit_values(values: DataFrame, by: list[str]) -> DataFrame:
    """Marked rows next to their pair's unmarked prompts: overturn, rescue, accuracy contrast, quality margin."""
    u = values.filter("axis = 'unmarked'").select(*by, "kind", F.col("choice_margin").alias("quality_margin"), F.col("accuracy").alias("merit_accuracy"))
    m = values.filter("axis <> 'unmarked'").drop("choice_margin", "accuracy").join(u, by + ["kind"])
    s, w, a = F.col("accuracy_strong_protected"), F.col("accuracy_weak_protected"), F.col("merit_accuracy")
    return m.withColumn("overturn", a - s).withColumn("rescue", w - a).withColumn("accuracy_contrast", w - s)


def with_pooled(values: DataFrame, pooled: str = "all") -> DataFrame:
    """Every pairing and the pool of all pairings."""
    return values.unionByName(values.withColumn("pairing", F.lit(pooled)))


def coded_minus_merit(values: DataFrame, by: list[str]) -> DataFrame:
    v = values.filter("axis <> 'unmarked'").groupBy(*by, "axis").agg(
        F.max(F.when(F.col("kind") == "coded", F.col("marker_effect"))).alias("c"), F.max(F.when(F.col("kind") == "merit", F.col("marker_effect"))).alias("m"))
    return v.select(*by, "axis", (F.col("c") - F.col("m")).alias("coded_minus_merit"))


def exchange_rates(merit: DataFrame, by: list[str], key: str, replicates: int, seed: int) -> DataFrame:
    """Mean marker effect over mean quality margin; null unless the margin is positive, its interval only when the
    margin is positive in every replicate. A margin that is rounding (below half of 1e-9) is none."""
    x, y = F.col("marker_effect"), F.col("quality_margin")
    point = merit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    boot = replicate_sums(merit.select(*by, key, x, y), key, ["marker_effect", "quality_margin"], by, replicates, seed)
    ok = F.round("quality_margin", 9) > 0
    r = boot.select(*by, F.when(ok, F.col("marker_effect") / F.when(ok, F.col("quality_margin"))).alias("r"), ok.alias("ok"))
    b = r.groupBy(*by).agg(F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"),
                           F.bool_and("ok").alias("bounded"), F.count_if("ok").alias("n_boot_valid"))
    positive = F.round("y", 9) > 0
    bounded = F.col("bounded") & positive & (F.col("n") > 1)
    return point.join(b, by).select(*by, "n", F.when(positive, F.col("x") / F.when(positive, F.col("y"))).alias("exchange_rate"),
                                    F.when(bounded, F.col("lo")).alias("ci_low"), F.when(bounded, F.col("hi")).alias("ci_high"), "n_boot_valid")


def chosen_contrasts(states: DataFrame, vec: str = "state") -> DataFrame:
    """Per pair the mean state of "chosen is protected" minus the same choice under the swapped assignment. Each row
    weighs +1 or -1, so no self-join is needed; unpaired rows are a contract matter (`contracts.unpaired_swaps`)."""
    from counterlens.operators.vectors import vector_sums

    s = states.filter(F.col("protected").isNotNull()).withColumn("__w", F.when(F.col("protected") == F.col("chosen"), 1.0).otherwise(-1.0))
    from counterlens.functions.vectors import scale
    return vector_sums(s, ["pair_id", "axis"], vec, "__w").select("pair_id", "axis", scale("sum_vec", 2.0 / F.col("n")).alias("contrast"))


# ---- effects over units with uneven counts ---------------------------------------------------------------------------
def placement_cells(items: DataFrame, targets: list[str], unit: str, own: str, replicates: int, seed: int) -> DataFrame:
    """Per (targets, row): baseline, nulled effect, change, gap to the own row and oriented shortfall, each a ratio of
    sums over units with its interval; ``items`` has (targets, row, unit, baseline, nulled).

    Items are summed per unit first, so the own row's change joins sums, not items."""
    s = items.groupBy(*targets, "row", unit).agg(F.sum("baseline").alias("base"), F.sum("nulled").alias("edited"), F.count(F.lit(1)).cast("double").alias("n"))
    o = s.filter(F.col("row") == own).select(*targets, unit, (F.col("edited") - F.col("base")).alias("own_change"))
    j = s.join(o, targets + [unit]).withColumn("change", F.col("edited") - F.col("base")).withColumn("gap", F.col("own_change") - F.col("change"))
    sums = ["base", "edited", "change", "gap", "n"]
    by = targets + ["row"]
    stats = {"baseline": "base", "nulled": "edited", "change": "change", "gap": "gap"}

    def long(df, keep):
        return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), (F.col(c) / F.when(F.col("n") > 0, F.col("n"))).alias("x"))
                                                    for k, c in stats.items()])).alias("e")).select(*keep, "e.stat", "e.x")

    totals = j.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_units"))
    point = long(totals, by + ["n_units"]).withColumnRenamed("x", "mean")
    boot = long(replicate_sums(j, unit, sums, by, replicates, seed), by)
    ci = boot.groupBy(*by, "stat").agg(F.percentile("x", F.lit(0.025)).alias("ci_low"), F.percentile("x", F.lit(0.975)).alias("ci_high"),
                                       F.count("x").alias("n_boot_valid"))
    out = point.join(ci, by + ["stat"])
    sign = out.filter("stat = 'baseline'").select(*by, F.signum("mean").alias("sign"))
    gap = out.filter("stat = 'gap'").join(sign, by)
    flip = -F.col("sign")
    short = gap.select(*by, "n_units", F.lit("shortfall").alias("stat"), F.when(flip != 0, flip * F.col("mean")).alias("mean"),
                       F.when(flip > 0, F.col("ci_low")).when(flip < 0, -F.col("ci_high")).alias("ci_low"),
                       F.when(flip > 0, F.col("ci_high")).when(flip < 0, -F.col("ci_low")).alias("ci_high"), "n_boot_valid")
    return out.unionByName(short)
