"""Statistics of the decision table: one score per (record, template, encoding, cell, response).

The linear statistics of a record (template means, margins, factorial effects) are one weighted sum over its
rows, so the long table is shuffled once, by record, with map-side partial sums. Threshold statistics
(accuracy, AUC) are taken per template and cell and averaged afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.functions.scores import decision_correct
from counterlens.operators.design import INTERSECTION, Design
from counterlens.operators.ranking import auc, null_safe_join
from counterlens.operators.resampling import auc_replicates, intervals, replicate_sums
from counterlens.session import cut_lineage

# --- fixed values: margin name -> (favoured response, other response) -----------------------------------------
MARGINS = {
    "D": ("approve", "decline"),
    "D_coded": ("approve", "coded"),
    "E": ("coded", "decline"),
    "D_overt": ("approve", "overt"),
    "O": ("overt", "decline"),
    "V": ("evasive", "approve"),
}


def sign_columns() -> tuple[Column, Column, Column]:
    return F.col("s1"), F.col("s2"), F.col("s3")


def contrast_weights(design: Design) -> dict[str, Column]:
    """Effect name -> weight of a cell's value, from the three sign columns (all zero for the unmarked row)."""
    a, b, c = design.axes
    S1, S2, S3 = sign_columns()
    return {
        f"main:{a}": S1 / 4.0, f"main:{b}": S2 / 4.0, f"main:{c}": S3 / 4.0,
        f"interaction:{a}_x_{b}": S1 * S2 / 2.0, f"interaction:{a}_x_{c}": S1 * S3 / 2.0,
        f"interaction:{b}_x_{c}": S2 * S3 / 2.0,
        "three_way": (S1 * S2 * S3).cast("double"),
        "corner": F.when((S1 + S2 + S3) == 3, 1.0).when((S1 + S2 + S3) == -3, -1.0).otherwise(0.0),
        "level_marked": F.when(S1 != 0, 0.125).otherwise(0.0),
        "unmarked": F.when(S1 == 0, 1.0).otherwise(0.0),
    }


def record_effects(rewards: DataFrame, design: Design, by: list[str],
                   margins: dict[str, tuple[str, str]] = MARGINS, reward: str = "reward") -> DataFrame:
    """One row per ``by`` (which names the record) and one column ``<margin>:<effect>`` per linear statistic,
    averaged over the record's templates, plus ``<margin>:additivity_gap``."""
    weights = contrast_weights(design)
    used = sorted({r for pair in margins.values() for r in pair})
    value = F.col(reward)
    sums = [F.sum(F.when(F.col("response") == r, w * value).otherwise(0.0)).alias(f"{r}|{k}")
            for r in used for k, w in weights.items()]
    S1, S2, S3 = sign_columns()
    one_cell = (F.col("response") == used[0]) & (S1 == 1) & (S2 == 1) & (S3 == 1)
    wide = rewards.groupBy(*by).agg(*sums, F.sum(one_cell.cast("double")).alias("__t"))
    cols = []
    for m, (hi, lo) in margins.items():
        parts = {k: (F.col(f"`{hi}|{k}`") - F.col(f"`{lo}|{k}`")) / F.col("__t") for k in weights}
        cols += [v.alias(f"{m}:{k}") for k, v in parts.items()]
        mains = [parts[f"main:{x}"] for x in design.axes]
        cols.append((parts["corner"] - (mains[0] + mains[1] + mains[2])).alias(f"{m}:additivity_gap"))
    return wide.select(*by, *cols)


def effect_names(design: Design, margins=MARGINS) -> list[str]:
    keys = list(contrast_weights(design)) + ["additivity_gap"]
    return [f"{m}:{k}" for m in margins for k in keys]


def to_long(wide: DataFrame, by: list[str], names: list[str], stat: str = "stat", value: str = "value") -> DataFrame:
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(n).alias(stat), F.col(f"`{n}`").cast("double").alias(value)) for n in names])).alias("e")
    ).select(*by, f"e.{stat}", f"e.{value}")


def summaries(wide: DataFrame, by: list[str], key: str, names: list[str], scale: str | None = None,
              replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Per group and statistic: n, mean, sd, d_z, share_negative and the percentile interval over records; with
    ``scale`` also the mean in units of that column's SD, re-estimated in every replicate."""
    safe = {n: f"v{i}" for i, n in enumerate(names)}
    base = wide.select(*by, key, *[F.col(f"`{n}`").alias(a) for n, a in safe.items()],
                       *([F.col(f"`{scale}`").alias("u")] if scale else []), F.lit(1.0).alias("one"))
    point = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *([F.stddev_samp("u").alias("scale_sd")] if scale else []),
        *[F.struct(F.avg(a).alias("mean"), F.stddev_samp(a).alias("sd"),
                   F.avg((F.round(a, 9) < 0).cast("double")).alias("neg")).alias(a) for a in safe.values()])
    point = point.select(*by, "n", *(["scale_sd"] if scale else []), F.explode(F.array(*[
        F.struct(F.lit(n).alias("stat"), F.col(a).alias("p")) for n, a in safe.items()])).alias("e"))
    point = point.select(*by, "n", *(["scale_sd"] if scale else []), "e.stat", F.col("e.p.mean").alias("mean"),
                         F.col("e.p.sd").alias("sd"), F.col("e.p.neg").alias("share_negative"))
    point = point.withColumn("d_z", F.col("mean") / F.when(F.round("sd", 12) > 0, F.col("sd")))
    sums = list(safe.values()) + ["one"] + (["u", "u2"] if scale else [])
    boot_in = base.withColumn("u2", F.col("u") * F.col("u")) if scale else base
    boot = replicate_sums(boot_in, key, sums, by, replicates, seed)
    n = F.col("one")
    if scale:
        var = (F.col("u2") - F.col("u") * F.col("u") / n) / F.when(n > 1, n - 1)
        sd = F.sqrt(F.when(F.round(var, 12) > 0, var))
    rows = boot.select(*by, F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), (F.col(a) / n).alias("m"),
                 ((F.col(a) / n / sd) if scale else F.lit(None).cast("double")).alias("r"))
        for s, a in safe.items()])).alias("e")).select(*by, "e.stat", "e.m", "e.r")
    bounds = rows.groupBy(*by, "stat").agg(
        F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"),
        *([F.percentile("r", F.lit(0.025)).alias("scaled_ci_low"),
           F.percentile("r", F.lit(0.975)).alias("scaled_ci_high")] if scale else []))
    out = null_safe_join(point, bounds, by + ["stat"], "left")
    out = out.withColumn("ci_low", F.when(F.col("n") > 1, F.col("ci_low"))).withColumn(
        "ci_high", F.when(F.col("n") > 1, F.col("ci_high")))
    if scale:
        out = out.withColumn("scaled_mean", F.col("mean") / F.when(F.round("scale_sd", 12) > 0, F.col("scale_sd")))
    return out


def cell_margins(rewards: DataFrame, by: list[str], margins: dict[str, tuple[str, str]] = MARGINS,
                 reward: str = "reward") -> DataFrame:
    """One column per margin for every (by, cell) block; ``by`` names record, template and encoding."""
    used = sorted({r for pair in margins.values() for r in pair})
    wide = rewards.groupBy(*by, "cell", "s1", "s2", "s3").agg(*[
        F.max(F.when(F.col("response") == r, F.col(reward))).alias(f"__{r}") for r in used])
    return wide.select(*by, "cell", "s1", "s2", "s3",
                       *[(F.col(f"__{hi}") - F.col(f"__{lo}")).alias(m) for m, (hi, lo) in margins.items()])


def stratum_means(margin: DataFrame, pairs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean pole-A minus pole-B value per axis and held-level suffix. Each cell row carries its signed place in
    every pair (``pairs`` is fixed by the design), so no cell is joined to another."""
    signed = pairs.select("encoding", "axis", "suffix", F.explode(F.array(
        F.struct(F.col("cell_a").alias("cell"), F.lit(1.0).alias("sign")),
        F.struct(F.col("cell_b").alias("cell"), F.lit(-1.0).alias("sign")))).alias("p")
    ).select("encoding", "axis", "suffix", "p.cell", "p.sign")
    return (margin.join(F.broadcast(signed), ["encoding", "cell"]).groupBy(*by, "axis", "suffix")
            .agg((F.sum(F.col("sign") * F.col(value)) / (F.count(F.lit(1)) / 2)).alias("mean_difference")))


def accuracy_values(margin: DataFrame, design: Design, by: list[str], value: str = "D") -> DataFrame:
    """Per record (``by``): accuracy on marked cells, on the unmarked control, the cost of any marking, and the
    accuracy at pole B minus pole A per axis. ``margin`` carries ``strong``."""
    ok = decision_correct(F.col(value), F.col("strong"))
    d = margin.withColumn("ok", ok)
    S1, S2, S3 = sign_columns()
    signs = {a: s for a, s in zip(design.axes, (S1, S2, S3))}
    total = S1 + S2 + S3
    aggs = [F.avg(F.when(S1 != 0, F.col("ok"))).alias("acc_marked"),
            F.avg(F.when(S1 == 0, F.col("ok"))).alias("acc_unmarked")]
    for a, s in signs.items():
        aggs.append((F.avg(F.when(s == -1, F.col("ok"))) - F.avg(F.when(s == 1, F.col("ok")))
                     ).alias(f"cross_influence:{a}"))
    aggs.append((F.avg(F.when(total == -3, F.col("ok"))) - F.avg(F.when(total == 3, F.col("ok")))
                 ).alias(f"cross_influence:{INTERSECTION}"))
    out = d.groupBy(*by).agg(*aggs)
    return out.withColumn("generic_marking", F.col("acc_unmarked") - F.col("acc_marked"))


def balanced_summaries(wide: DataFrame, by: list[str], key: str, strong: str, names: list[str],
                       replicates: int = 2000, seed: int = 0) -> DataFrame:
    """The mean of the strong-record and weak-record means, with each group resampled on its own."""
    safe = {n: f"v{i}" for i, n in enumerate(names)}
    base = wide.select(*by, key, strong, *[F.col(f"`{n}`").alias(a) for n, a in safe.items()],
                       F.lit(1.0).alias("one"))
    s = F.col(strong)

    def halves(frame: DataFrame, groups: list[str]) -> DataFrame:
        return frame.groupBy(*groups).agg(*[
            ((F.sum(F.when(s, F.col(a))) / F.sum(F.when(s, F.col("one")))
              + F.sum(F.when(~s, F.col(a))) / F.sum(F.when(~s, F.col("one")))) / 2).alias(a)
            for a in safe.values()],
            F.sum(F.when(s, F.col("one")).otherwise(0)).cast("long").alias("n_strong"),
            F.sum(F.when(~s, F.col("one")).otherwise(0)).cast("long").alias("n_weak"))

    renamed = {a: n for n, a in safe.items()}
    point = to_long(halves(base, by), by + ["n_strong", "n_weak"], list(safe.values()), value="mean")
    parts = []
    for flag, salt in ((True, 1), (False, 2)):
        parts.append(replicate_sums(base.filter(s == F.lit(flag)), key, list(safe.values()) + ["one"],
                                    by + [strong], replicates, seed, salt))
    boot = halves(parts[0].unionByName(parts[1]), by + ["b"])
    bounds = intervals(boot, by, list(safe.values())).drop("n_boot_valid")
    out = null_safe_join(point, bounds, by + ["stat"], "left")
    names_map = F.create_map(*[x for a, n in renamed.items() for x in (F.lit(a), F.lit(n))])
    spread = (F.col("n_strong") > 1) & (F.col("n_weak") > 1)
    return out.select(*by, names_map[F.col("stat")].alias("stat"), "n_strong", "n_weak", "mean",
                      F.when(spread, F.col("ci_low")).alias("ci_low"),
                      F.when(spread, F.col("ci_high")).alias("ci_high"))


def auc_by_cell(margin: DataFrame, by: list[str], value: str = "D", buckets: int = 16) -> DataFrame:
    """AUC of the margin between strong and weak records per (by, cell)."""
    return auc(margin.select(*by, "cell", value, "strong"), list(by) + ["cell"], value, "strong", buckets)


def auc_cross_influence(margin: DataFrame, design: Design, replicates: int = 2000, seed: int = 0,
                        value: str = "D", buckets: int = 1) -> DataFrame:
    """AUC at pole B minus pole A per encoding and axis, with strong and weak records resampled separately and
    paired over cells. ``margin`` has (record_id, strong, template, encoding, cell, D)."""
    marked = cut_lineage(margin.filter(F.col("s1") != 0).select("record_id", "strong", "template", "encoding", "cell", value))     # read by several plans
    n_templates = marked.groupBy("encoding").agg(F.count_distinct("template").alias("__k"))
    complete = (marked.groupBy("encoding", "record_id").agg(F.count_distinct("template").alias("__t"))
                .join(F.broadcast(n_templates), "encoding").filter(F.col("__t") == F.col("__k"))
                .select("encoding", "record_id"))
    marked = marked.join(complete, ["encoding", "record_id"], "left_semi")
    signed = pair_signs(design)
    grid = margin.sparkSession.createDataFrame(signed, "encoding string, axis string, cell string, sign double, half double")
    point = auc(marked, ["encoding", "template", "cell"], value, "strong", buckets)
    boot = auc_replicates(marked, ["encoding", "template", "cell"], "record_id", value, "strong", replicates, seed)
    est = point.groupBy("encoding", "cell").agg(F.avg("auc").alias("auc"), F.max("n_pos").alias("n_pos"),
                                                F.max("n_neg").alias("n_neg"))
    est = (est.join(F.broadcast(grid), ["encoding", "cell"]).groupBy("encoding", "axis")
           .agg(F.sum(-F.col("sign") * F.col("auc") * F.col("half")).alias("mean"),
                F.sum(F.when(F.col("sign") > 0, F.col("auc") * F.col("half"))).alias("auc_protected"),
                F.sum(F.when(F.col("sign") < 0, F.col("auc") * F.col("half"))).alias("auc_reference"),
                F.max("n_pos").cast("long").alias("n_strong"), F.max("n_neg").cast("long").alias("n_weak")))
    per_b = (boot.groupBy("encoding", "cell", "b").agg(F.avg("auc").alias("auc"))
             .join(F.broadcast(grid), ["encoding", "cell"]).groupBy("encoding", "axis", "b")
             .agg(F.sum(-F.col("sign") * F.col("auc") * F.col("half")).alias("d")))
    bounds = per_b.groupBy("encoding", "axis").agg(
        F.percentile("d", F.lit(0.025)).alias("ci_low"), F.percentile("d", F.lit(0.975)).alias("ci_high"))
    return est.join(bounds, ["encoding", "axis"])


def pair_signs(design: Design) -> list[tuple]:
    """(encoding, axis, cell, +1 at pole A, 1 / number of pairs) for every marked axis."""
    out = []
    for e in ("explicit", "proxy"):
        for axis in design.marked_axes(e):
            pairs = design.pairs(axis, e)
            for p in pairs:
                out += [(e, axis, p.a.key, 1.0, 1.0 / len(pairs)), (e, axis, p.b.key, -1.0, 1.0 / len(pairs))]
    return out


def length_bins(margin: DataFrame, by: list[str], length: str, bins: int = 5) -> DataFrame:
    """Adds ``bin``: quantile strata of length per group, edges linearly interpolated, right-closed search."""
    edges = margin.groupBy(*by).agg(
        F.percentile(length, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("__edges"))
    joined = null_safe_join(margin, edges, by)
    return joined.withColumn("bin", F.size(F.filter("__edges", lambda e: e <= F.col(length)))).drop("__edges")


def residualised(margin: DataFrame, by: list[str], y: str, x: str, out: str = "residual") -> DataFrame:
    """``y`` minus its least-squares line on ``x`` per group; a constant ``x`` removes only the mean."""
    fit = margin.groupBy(*by).agg(F.avg(y).alias("__my"), F.avg(x).alias("__mx"),
                                  F.covar_pop(x, y).alias("__c"), F.var_pop(x).alias("__v"))
    joined = null_safe_join(margin, fit, by)
    slope = F.when(F.col("__v") > 0, F.col("__c") / F.col("__v")).otherwise(0.0)
    return joined.withColumn(out, (F.col(y) - F.col("__my")) - slope * (F.col(x) - F.col("__mx"))
                             ).drop("__my", "__mx", "__c", "__v")


def quality_tracking(margin: DataFrame, by: list[str], value: str, length: str, bins: int = 5,
                     buckets: int = 16) -> DataFrame:
    """Per group: AUC of the margin, of length alone, their difference, the AUC inside length strata with its
    coverage, and the AUC after regressing the margin on length."""
    plain = auc(margin, by, value, "strong", buckets).select(*by, F.col("auc").alias("auc_d"), "n_pos", "n_neg")
    length_only = auc(margin, by, length, "strong", buckets).select(*by, F.col("auc").alias("auc_length"))
    strata = auc(length_bins(margin, by, length, bins), list(by) + ["bin"], value, "strong", buckets)
    pairs = F.col("n_pos") * F.col("n_neg")
    within = strata.groupBy(*by).agg(
        (F.sum(F.col("auc") * pairs) / F.sum(F.when(pairs > 0, pairs))).alias("auc_d_within_length_strata"),
        F.sum(pairs).alias("__same"))
    resid = residualised(margin, by, value, length)
    resid = resid.withColumn("residual", F.round("residual", 12))
    res = auc(resid, by, "residual", "strong", buckets).select(*by, F.col("auc").alias("auc_d_length_residualised"))
    out = null_safe_join(null_safe_join(null_safe_join(plain, length_only, by), within, by), res, by)
    return (out.withColumn("coverage", F.col("__same") / (F.col("n_pos") * F.col("n_neg")))
            .withColumn("auc_d_minus_length", F.col("auc_d") - F.col("auc_length"))
            .drop("__same"))


def placement_effects(direct: DataFrame, decisions: DataFrame, design: Design, by: list[str],
                      reward: str = "reward") -> DataFrame:
    """Axis effects of the same cells with the marker in the response (``direct_gap``), in the prompt with the
    response fixed (``prompt_effect:<response>``) and in the decision margin (``did``), one row per ``by``.

    Both tables are reduced to the record before they meet."""
    weights = contrast_weights(design)
    keep = [f"main:{a}" for a in design.axes] + ["corner"]
    S1, S2, S3 = sign_columns()
    one = (S1 == 1) & (S2 == 1) & (S3 == 1)
    d = direct.groupBy(*by).agg(
        *[F.sum(weights[k] * F.col(reward)).alias(f"direct_gap|{k}") for k in keep],
        F.sum(one.cast("double")).alias("__t"))
    d = d.select(*by, *[(F.col(f"`direct_gap|{k}`") / F.col("__t")).alias(f"direct_gap|{k}") for k in keep])
    responses = ("approve", "decline", "coded", "overt", "evasive")
    r = decisions.groupBy(*by).agg(
        *[F.sum(F.when(F.col("response") == s, weights[k] * F.col(reward)).otherwise(0.0)).alias(f"prompt_effect:{s}|{k}")
          for s in responses for k in keep],
        F.sum((one & (F.col("response") == "approve")).cast("double")).alias("__t"))
    cols = [(F.col(f"`prompt_effect:{s}|{k}`") / F.col("__t")).alias(f"prompt_effect:{s}|{k}")
            for s in responses for k in keep]
    cols += [((F.col(f"`prompt_effect:approve|{k}`") - F.col(f"`prompt_effect:decline|{k}`")) / F.col("__t")
              ).alias(f"did|{k}") for k in keep]
    return d.join(r.select(*by, *cols), by)
