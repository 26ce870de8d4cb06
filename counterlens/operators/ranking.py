"""Ranks and running totals that never sort one whole group in one task.

A group that holds a third of all rows would make a plain ``row_number() over (partition by group ...)``
run in a single task. Here each group is cut into ordered buckets first: rows are ranked inside
(group, bucket), and the bucket offsets come from a small table of bucket sizes. The result equals the
plain window's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                   plain: tuple[str, ...] = ()) -> DataFrame:
    """Equi-join in which a null key equals a null key; keeps the left side's key columns. Keys in ``plain`` are
    never null and compare as they are."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    if not keys:
        return left.crossJoin(F.broadcast(renamed))
    on = reduce(lambda a, b: a & b, [
        (left[k] == renamed[f"__r_{k}"]) if k in plain else left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _bucketed(df: DataFrame, by: list[str]) -> DataFrame:
    """One struct key for (group, bucket): null groups keep their rows, and the window, the bucket sizes and the
    join share one hash partitioning."""
    return df.withColumn("__k", F.struct(*by, "__b"))


def _offsets(cut: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Per (group, bucket) the totals of the group's earlier buckets."""
    sizes = cut.groupBy("__k").agg(*[c.alias(n) for n, c in totals.items()])
    group = F.struct(*[F.col(f"__k.{k}") for k in by]) if by else F.lit(0)
    before = Window.partitionBy(group).orderBy("__k.__b").rowsBetween(*BEFORE)
    return sizes.select("__k", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals])


def hash_rank(df: DataFrame, digest: Column, ties: list[str], by: list[str] = (), out: str = "rank",
              digits: int = 3) -> DataFrame:
    """1-based rank by a hex digest inside ``by``; equals ``row_number`` over (digest, ties).

    The leading ``digits`` hex digits cut a group into up to ``16 ** digits`` equal buckets."""
    keyed = df.withColumn("__d", digest).withColumn("__b", F.substring("__d", 1, digits))
    return _two_level_rank(_bucketed(keyed, list(by)), list(by), ["__d", *ties], out).drop("__d")


def first_and_next(df: DataFrame, digest: Column, ties: list[str], by: list[str], value: str, size: DataFrame) -> DataFrame:
    """Rows (by, value, first, next): of each ``value`` the rows among the first ``k`` of the group by (digest, ties), and among the next ``k``.
    ``size`` is one row (k). Only the buckets of the digest in which a border lies are ranked; all other rows are counted where they are."""
    cut = df.withColumn("__d", digest).withColumn("__b", F.substring("__d", 1, 2))
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edges = cut.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    edges = edges.withColumn("__o", F.coalesce(F.sum("__n").over(w), F.lit(0))).crossJoin(F.broadcast(size.select("k")))
    low, high, k = F.col("__o"), F.col("__o") + F.col("__n"), F.col("k")
    edges = edges.select(*by, "__b", "__o", "k", (high <= k).alias("__first"), ((low >= k) & (high <= 2 * k)).alias("__next"),
                         (((low < k) & (high > k)) | ((low < 2 * k) & (high > 2 * k))).alias("__border"))
    placed = cut.join(F.broadcast(edges), [*by, "__b"])                              # 256 rows a group
    inside = placed.filter(~F.col("__border")).groupBy(*by, value).agg(F.count_if("__first").alias("first"), F.count_if("__next").alias("next"))
    rank = F.col("__o") + F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__d", *ties))
    border = placed.filter("__border").withColumn("__r", rank).groupBy(*by, value).agg(
        F.count_if(F.col("__r") <= k).alias("first"), F.count_if((F.col("__r") > k) & (F.col("__r") <= 2 * k)).alias("next"))
    both = inside.unionByName(border).groupBy(*by, value).agg(F.sum("first").alias("first"), F.sum("next").alias("next"))
    return both.filter("first + next > 0")


def _two_level_rank(cut: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    local = cut.withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(*order)))
    offsets = _offsets(cut, by, {"__o": F.count(F.lit(1))})
    return (local.join(offsets, "__k").withColumn(out, (F.col("__r") + F.col("__o")).cast("long"))
            .drop("__k", "__b", "__r", "__o"))


def order_bounds(df: DataFrame, by: list[str], order: str, buckets: int) -> DataFrame:
    """Cut points that split each group's values of ``order`` into near-equal buckets."""
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return df.groupBy(*by).agg(F.percentile_approx(order, cuts, 10000).alias("__cuts"))


def count_below(cuts: str, value: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` (``most`` or fewer) are below ``value``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(cuts, n + step - 1) < value, step).otherwise(0))


def with_bucket(df: DataFrame, by: list[str], order: str, buckets: int) -> DataFrame:
    """Adds ``__b``, non-decreasing in ``order`` inside each group."""
    if buckets <= 1:
        return df.withColumn("__b", F.lit(0))
    bounds = order_bounds(df, by, order, buckets)
    marked = null_safe_join(df, bounds, by)
    return marked.withColumn("__b", count_below("__cuts", F.col(order), buckets - 1)).drop("__cuts")


def ordered_rank(df: DataFrame, by: list[str], order: str, ties: list[str], out: str = "rank",
                 buckets: int = 16) -> DataFrame:
    """1-based ``row_number`` by a numeric column inside ``by``, in two levels."""
    return _two_level_rank(_bucketed(with_bucket(df, by, order, buckets), by), by, [order, *ties], out)


def running_totals(df: DataFrame, by: list[str], order: str, values: list[str], buckets: int = 16,
                   bucket: str | None = None) -> DataFrame:
    """Adds ``<v>_below``: the sum of ``v`` over the group's rows with a smaller ``order``.

    ``df`` holds one row per (group, order): aggregate equal values first, which also merges a hot value
    into one row. ``bucket`` names an existing order-preserving bucket column."""
    cut = df.withColumn("__b", F.col(bucket)) if bucket else with_bucket(df, by, order, buckets)
    if not bucket and buckets <= 1:                  # the caller knows the groups are small
        plain = Window.partitionBy(*by).orderBy(order).rowsBetween(*BEFORE)
        for v in values:
            df = df.withColumn(f"{v}_below", F.coalesce(F.sum(v).over(plain), F.lit(0.0)))
        return df
    cut = _bucketed(cut, by)
    inside = Window.partitionBy("__k").orderBy(order).rowsBetween(*BEFORE)
    local = cut
    for v in values:
        local = local.withColumn(f"__i_{v}", F.coalesce(F.sum(v).over(inside), F.lit(0.0)))
    offsets = _offsets(cut, by, {f"__o_{v}": F.sum(v) for v in values})
    joined = local.join(offsets, "__k")
    for v in values:
        joined = joined.withColumn(f"{v}_below", F.col(f"__i_{v}") + F.col(f"__o_{v}"))
    return joined.drop("__k", "__b", *[f"__i_{v}" for v in values], *[f"__o_{v}" for v in values])


def exact_percentiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float], buckets: int = 16) -> DataFrame:
    """Interpolated percentiles (name -> fraction) of ``value`` per group: rows (by, names...). Nulls take no part.

    Equal values merge into counts first, and the two order statistics around each place are read off running totals, so a
    group is never one sorted buffer; the result equals a percentile over the whole group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).cast("double").alias("__c"))
    totals = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    below = running_totals(counts, by, "__v", ["__c"], buckets)
    placed = null_safe_join(below, totals, by)
    at = lambda rank: F.max(F.when((F.col("__c_below") <= rank) & (rank < F.col("__c_below") + F.col("__c")), F.col("__v").cast("double")))
    found, out = [], []
    for i, (name, q) in enumerate(fractions.items()):
        place = F.lit(float(q)) * (F.col("__n") - 1)
        found += [at(F.floor(place)).alias(f"__lo{i}"), at(F.ceil(place)).alias(f"__hi{i}"), F.max(place - F.floor(place)).alias(f"__f{i}")]
        out.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(name))
    return placed.groupBy(*by).agg(*found).select(*by, *out)


def average_rank(df: DataFrame, by: list[str], order: str, out: str = "avg_rank",
                 buckets: int = 16) -> DataFrame:
    """Ranks with ties sharing their mean rank (1-based)."""
    distinct = df.groupBy(*by, order).agg(F.count(F.lit(1)).cast("double").alias("__c"))
    below = running_totals(distinct, by, order, ["__c"], buckets)
    ranks = below.select(*by, order, (F.col("__c_below") + (F.col("__c") + 1) / 2).alias(out))
    return null_safe_join(df, ranks, list(by) + [order])


def auc(df: DataFrame, by: list[str], score: str, positive: str, buckets: int = 16) -> DataFrame:
    """Mann-Whitney AUC of ``score`` between positive and other rows per group, ties one half.

    Equal scores are merged before anything is ordered; no pair of rows is ever formed."""
    hist = (df.filter(F.col(score).isNotNull()).groupBy(*by, score)
            .agg(F.sum(F.col(positive).cast("double")).alias("__p"),
                 F.sum((~F.col(positive)).cast("double")).alias("__q")))
    below = running_totals(hist, by, score, ["__q"], buckets)
    return (below.groupBy(*by)
            .agg(F.sum(F.col("__p") * (F.col("__q_below") + 0.5 * F.col("__q"))).alias("__u"),
                 F.sum("__p").alias("n_pos"), F.sum("__q").alias("n_neg"))
            .select(*by, (F.col("__u") / F.when(F.col("n_pos") * F.col("n_neg") > 0,
                                                F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                    "n_pos", "n_neg"))


def largest_remainder(sizes: DataFrame, stratum: str, size: str, n: int) -> DataFrame:
    """``quota`` per stratum: the floor of its exact share of ``n``, the rest to the largest remainders
    (ties by the stratum's name). ``sizes`` has one row per stratum."""
    everything = Window.partitionBy(F.lit(0))
    exact = (F.lit(float(n)) * F.col(size)) / F.sum(size).over(everything)
    s = sizes.withColumn("__x", exact).withColumn("__f", F.floor("__x"))
    s = s.withColumn("__left", F.lit(n) - F.sum("__f").over(everything))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("__x") - F.col("__f")).desc(),
                                                 F.col(stratum).cast("string"))
    s = s.withColumn("__k", F.row_number().over(order))
    return s.withColumn("quota", (F.col("__f") + (F.col("__k") <= F.col("__left")).cast("long")).cast("long")
                        ).drop("__x", "__f", "__left", "__k")
