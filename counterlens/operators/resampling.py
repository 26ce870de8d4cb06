"""Bootstrap and permutation intervals from cluster sums.

Every statistic here is a function of weighted sums over clusters, so items are summed per cluster once and
a replicate only re-weights those sums. The draws are counter-based: draw ``j`` of replicate ``b`` is a fixed
function of (seed, b, j), the same for every statistic and every cluster layout, in plain long arithmetic.

Clusters are ranked and dealt to blocks of ``BLOCK``. How many of a replicate's draws fall into a block is settled by
binomial splits of the ranks (each split's generator is keyed by its range, so all blocks agree without talking), and
a block's own draws are made and counted beside its clusters: no draw is ever a row, and only one partial sum per
(group, block, replicate) is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.operators.ranking import hash_rank, null_safe_join
from counterlens.session import shuffle_partitions

DEFAULT_REPLICATES = 2000
MODULUS = 2147483647                       # a prime; x -> x^5 permutes its residues
ROUND_KEYS = (715827883, 1431655765, 178956971, 1073741827)
BLOCK = 4096                               # clusters whose draws are made together
AT_ONCE = 250                              # replicates of a block that one task makes
SPAN = 1 << 20                             # draws of a replicate that one row of `drawn_places` stands for
HELD = 32 << 10                            # records whose draw counts a task of `auc_replicates` merges by score

Sums = Mapping[str, Column]
Stat = Callable[[Sums], Column]


def _fifth_power(df: DataFrame, value: Column) -> DataFrame:
    """One mixing round: ``__x`` becomes value^5 modulo the prime, each product inside a long."""
    return (df.withColumn("__y", value % MODULUS)
            .withColumn("__y2", (F.col("__y") * F.col("__y")) % MODULUS)
            .withColumn("__y4", (F.col("__y2") * F.col("__y2")) % MODULUS)
            .withColumn("__x", (F.col("__y4") * F.col("__y")) % MODULUS))


def draw_number(df: DataFrame, seed: int, words: list[str], out: str) -> DataFrame:
    """Adds ``out`` in [0, MODULUS): the words are absorbed one per round, then one closing round."""
    df = df.withColumn("__x", F.lit(seed % MODULUS).cast("long"))
    for k, word in zip(ROUND_KEYS, list(words) + [None]):
        step = F.col("__x") + F.lit(k).cast("long")
        df = _fifth_power(df, step + F.col(word).cast("long") if word else step)
    # Not nullable: an inferred "is not null" filter would otherwise be pushed below the rounds and repeat them.
    return df.withColumn(out, F.coalesce(F.col("__x"), F.lit(0).cast("long"))).drop("__x", "__y", "__y2", "__y4")


def index_clusters(clusters: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Adds the 0-based ``idx`` of each cluster inside ``by``, in the order of its key's digest."""
    ranked = hash_rank(clusters, F.sha2(F.col(key).cast("string"), 256), [key], by, "__rank")
    return ranked.withColumn("idx", F.col("__rank") - 1).drop("__rank")


def block_draws(n: int, block: int, replicates: int, seed: int) -> np.ndarray:
    """How many of the ``n`` draws of each replicate fall into a block of ranks, by halving the range of blocks."""
    low, high = 0, -(-n // BLOCK)
    count = np.full(replicates, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left, whole = (mid - low) * BLOCK, min(n, high * BLOCK) - low * BLOCK
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed % MODULUS, low, high])))
        first = rng.binomial(count, left / whole)
        count, low, high = (first, low, mid) if block < mid else (count - first, mid, high)
    return count


def draws_in_block(size: int, b: np.ndarray, draws: int, seed: int, first: int = 0) -> np.ndarray:
    """``draws`` positions below ``size`` for each replicate number in ``b``; the arithmetic of `draw_number`."""
    x = np.int64(seed % MODULUS)
    for k, word in zip(ROUND_KEYS, (b[:, None], np.arange(first, first + draws)[None, :], 0)):
        y = (x + k + word) % MODULUS
        y4 = y * y % MODULUS
        y4 = y4 * y4 % MODULUS
        x = y4 * y % MODULUS
    return x * size // MODULUS


def block_counts(n: int, block: int, size: int, b: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each of a block's ``size`` ranks is drawn in the replicates ``b``: one row per replicate."""
    count = block_draws(n, block, replicates, seed)[b]
    out = np.empty((len(b), size))
    for at in range(0, len(b), 25):
        c = count[at:at + 25]
        idx = draws_in_block(size, b[at:at + 25], int(c.max(initial=0)), seed + 104729 * block)
        idx = np.where(np.arange(idx.shape[1])[None, :] < c[:, None], idx + 1, 0)
        flat = idx + (np.arange(len(c)) * (size + 1))[:, None]
        out[at:at + 25] = np.bincount(flat.reshape(-1), minlength=len(c) * (size + 1)).reshape(len(c), size + 1)[:, 1:]
    return out


def draw_counts(levels: DataFrame, key: str, by: list[str], replicates: int, seed: int, salt: int = 0) -> DataFrame:
    """How often every level is drawn in every replicate, inside ``by``: rows (by, key, w), ``w`` one byte per replicate. Levels are
    dealt to blocks as in `replicate_sums`, so there is no limit to their number; a replicate is never a row."""
    levels = levels.select(*by, key).distinct()
    groups = levels.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ranked = index_clusters(levels, key, by).withColumn("__block", F.expr(f"idx div {BLOCK}"))
    blocks = ranked.groupBy(*by, "__block").agg(F.sort_array(F.collect_list(F.struct("idx", F.col(key).alias("k")))).alias("__rows"))
    blocks = null_safe_join(blocks, groups, by) if by else blocks.crossJoin(F.broadcast(groups))
    schema = levels.schema.add("w", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("__rows")[i].values.field("k")
                n, block = batch.column("__n")[i].as_py(), batch.column("__block")[i].as_py()
                w = np.empty((len(keys), replicates), np.uint8)
                for at in range(0, replicates, AT_ONCE):
                    found = block_counts(n, block, len(keys), np.arange(at, min(at + AT_ONCE, replicates)), replicates, seed + 7919 * salt)
                    if found.max(initial=0) > 255:
                        raise ValueError("a level was drawn more than 255 times")       # one in 10 ** 500
                    w[:, at:at + AT_ONCE] = found.T
                same = batch.select(by).take(pa.array(np.full(len(keys), i))).columns if by else []
                yield pa.RecordBatch.from_arrays([*same, keys, pa.array([x.tobytes() for x in w], pa.binary())], names=[*by, key, "w"])

    return blocks.mapInArrow(run, schema)


def drawn_places(size: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Every draw of every replicate over the ``n`` ranks of ``size`` (one row), as in SQL for any number of blocks: rows (__block, b, places),
    ``places`` two bytes a draw, counted from the block's first rank. A row is made of at most ``SPAN`` draws."""
    spark = size.sparkSession
    grid = spark.range(0, replicates, 1, min(replicates, 4 * shuffle_partitions(spark))).crossJoin(F.broadcast(size.select("n").filter("n > 0")))
    grid = grid.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPAN).cast("long"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, first in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "first"))):
                idx = np.sort(draws_in_block(n, np.array([b]), min(SPAN, n - first), seed, first)[0])
                block = idx // BLOCK
                cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(idx))
                places = (idx - block * BLOCK).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, b)),
                                                  pa.array([places[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())],
                                                 names=["__block", "b", "places"])

    return grid.mapInArrow(run, "__block long, b long, places binary")


def weight_matrix(column) -> np.ndarray:
    """Rows x replicates of `draw_counts` bytes in a pandas column."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def run_sums(w: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run ``order[first[i]:first[i + 1]]`` (none is empty) the sum of these rows of ``w``: the runs' k-th rows are added at once."""
    size = np.diff(first)
    long_first = np.argsort(-size, kind="stable")
    start, left = first[:-1][long_first], -size[long_first]
    total = w[order[start]].astype(np.uint32)
    for k in range(1, int(size.max(initial=0))):
        more = int(np.searchsorted(left, -k))
        total[:more] += w[order[start[:more] + k]]
    out = np.empty_like(total)
    out[long_first] = total
    return out


def _block_sums(by: list[str], sums: list[str], replicates: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("__rows")[i].values
                values = np.stack([rows.field(c).to_numpy(zero_copy_only=False) for c in sums], axis=1).astype(float)
                known = ~np.isnan(values)
                values = np.where(known, values, 0.0)
                first = batch.column("__first")[i].as_py()
                b = np.arange(first, min(first + AT_ONCE, replicates))
                w = block_counts(batch.column("__n")[i].as_py(), batch.column("__block")[i].as_py(), len(values), b, replicates, seed)
                total, some = w @ values, w @ known > 0
                keys = batch.select(by).take(pa.array(np.full(len(b), i))).columns if by else []
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(b), *[pa.array(total[:, k], mask=~some[:, k]) for k in range(len(sums))]], names=[*by, "b", *sums])

    return run


def replicate_sums(clusters: DataFrame, key: str, sums: list[str], by: list[str],
                   replicates: int, seed: int, salt: int = 0) -> DataFrame:
    """Per group and replicate the sums of ``sums`` over the drawn clusters: rows (by, b, sums...)."""
    clusters = clusters.select(*by, key, *[F.col(s).cast("double").alias(s) for s in sums])
    groups = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ranked = index_clusters(clusters, key, by).withColumn("__block", F.expr(f"idx div {BLOCK}"))
    blocks = ranked.groupBy(*by, "__block").agg(F.sort_array(F.collect_list(F.struct("idx", *sums))).alias("__rows"))
    blocks = null_safe_join(blocks, groups, by) if by else blocks.crossJoin(F.broadcast(groups))
    starts = F.array(*[F.lit(i) for i in range(0, replicates, AT_ONCE)])
    tasks = blocks.select(*by, "__n", "__block", F.explode(starts).alias("__first"), "__rows").repartition(
        shuffle_partitions(clusters.sparkSession), *by, "__block", "__first")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in clusters.select(*by).schema.fields]
    schema = ", ".join([*kinds, "b long", *[f"`{s}` double" for s in sums]])
    partial = tasks.mapInArrow(_block_sums(by, sums, replicates, seed + 7919 * salt), schema)
    return partial.groupBy(*by, "b").agg(*[F.sum(s).alias(s) for s in sums])


def intervals(boot: DataFrame, by: list[str], names: list[str], low: float = 0.025,
              high: float = 0.975) -> DataFrame:
    """Percentile bounds of each statistic column over the replicates where it is defined: rows
    (by, stat, ci_low, ci_high, n_boot_valid)."""
    long = boot.select(*by, F.explode(F.array(*[
        F.struct(F.lit(n).alias("stat"), F.col(n).alias("v")) for n in names])).alias("e")
    ).select(*by, "e.stat", "e.v")
    return long.groupBy(*by, "stat").agg(
        F.percentile("v", F.lit(low)).alias("ci_low"), F.percentile("v", F.lit(high)).alias("ci_high"),
        F.count("v").alias("n_boot_valid"))


def cluster_bootstrap(items: DataFrame, cluster: str, sums: Mapping[str, Column], stats: Mapping[str, Stat],
                      by: list[str] = (), replicates: int = DEFAULT_REPLICATES, seed: int = 0) -> DataFrame:
    """Each statistic on all items and its 95% percentile interval over resamples of whole clusters.

    ``sums`` are additive expressions over items; ``stats`` maps a name to an expression over their totals.
    Rows: (by, stat, estimate, ci_low, ci_high, n_clusters, n_items, n_boot_valid). With fewer than two
    clusters the interval is null."""
    by = list(by)
    names = list(sums)
    collapsed = items.groupBy(*by, cluster).agg(
        *[F.sum(e).alias(s) for s, e in sums.items()], F.count(F.lit(1)).alias("__items"))
    totals = collapsed.groupBy(*by).agg(
        *[F.sum(s).alias(s) for s in names], F.count(F.lit(1)).alias("n_clusters"),
        F.sum("__items").alias("n_items"))
    point = _long_stats(totals, by + ["n_clusters", "n_items"], names, stats, "estimate")
    boot = replicate_sums(collapsed, cluster, names, by, replicates, seed)
    values = boot.select(*by, "b", *[fn({s: F.col(s) for s in names}).alias(k) for k, fn in stats.items()])
    bounds = intervals(values, by, list(stats))
    out = null_safe_join(point, bounds, by + ["stat"], "left")
    enough = F.col("n_clusters") >= 2
    return out.select(*by, "stat", "estimate", F.when(enough, F.col("ci_low")).alias("ci_low"),
                      F.when(enough, F.col("ci_high")).alias("ci_high"), "n_clusters", "n_items",
                      F.when(enough, F.col("n_boot_valid")).otherwise(F.lit(0)).alias("n_boot_valid"))


def _long_stats(totals: DataFrame, keep: list[str], names: list[str], stats: Mapping[str, Stat],
                out: str) -> DataFrame:
    cols = {s: F.col(s) for s in names}
    return totals.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(k).alias("stat"), fn(cols).cast("double").alias("v")) for k, fn in stats.items()])
    ).alias("e")).select(*keep, "e.stat", F.col("e.v").alias(out))


def crossed_bootstrap(items: DataFrame, key_a: str, key_b: str, sums: Mapping[str, Column],
                      stats: Mapping[str, Stat], replicates: int = DEFAULT_REPLICATES,
                      seed: int = 0) -> DataFrame:
    """Items crossed in two random factors: both are resampled, an item weighs the product of its two levels'
    draw counts. Items are summed per (a, b) cell first; a cell meets the counts of its two levels, all replicates of a level in
    one value, and each task sums its cells for all replicates at once."""
    names = list(sums)
    cells = items.groupBy(key_a, key_b).agg(*[F.sum(e).alias(s) for s, e in sums.items()],
                                            F.count(F.lit(1)).alias("__items"))
    w_a = draw_counts(cells.select(key_a), key_a, [], replicates, seed, 1).withColumnRenamed("w", "w_a")
    w_b = draw_counts(cells.select(key_b), key_b, [], replicates, seed, 2).withColumnRenamed("w", "w_b")

    def partial(frames):
        total = None
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                own = pdf.iloc[at:at + 1000]
                w = weight_matrix(own["w_a"]).astype(float) * weight_matrix(own["w_b"])
                part = w.T @ own[names].to_numpy(float)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"b": np.arange(len(total)), **{s: total[:, k] for k, s in enumerate(names)}})

    both = cells.select(key_a, key_b, *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in names]).join(w_a, key_a).join(w_b, key_b)
    weighted = (both.select(*names, "w_a", "w_b").mapInPandas(partial, ", ".join(["b long", *[f"`{s}` double" for s in names]]))
                .groupBy("b").agg(*[F.sum(s).alias(s) for s in names]))
    totals = cells.agg(*[F.sum(s).alias(s) for s in names], F.sum("__items").alias("n_items"),
                       F.count_distinct(key_a).alias("n_clusters"), F.count_distinct(key_b).alias("n_clusters_b"))
    point = _long_stats(totals, ["n_clusters", "n_clusters_b", "n_items"], names, stats, "estimate")
    values = weighted.select("b", *[fn({s: F.col(s) for s in names}).alias(k) for k, fn in stats.items()])
    bounds = intervals(values, [], list(stats))
    enough = (F.col("n_clusters") >= 2) & (F.col("n_clusters_b") >= 2)
    return (point.join(bounds, "stat", "left")
            .select("stat", "estimate", F.when(enough, F.col("ci_low")).alias("ci_low"),
                    F.when(enough, F.col("ci_high")).alias("ci_high"), "n_clusters", "n_clusters_b", "n_items",
                    F.when(enough, F.col("n_boot_valid")).otherwise(F.lit(0)).alias("n_boot_valid")))


def auc_replicates(scored: DataFrame, by: list[str], key: str, score: str, positive: str,
                   replicates: int, seed: int, block: int = 2000) -> DataFrame:
    """The AUC of every replicate from multiplicities: positives and negatives are resampled separately, with
    the same draws in every group of ``by``. Rows (by, b, auc).

    ``scored`` has one row per (by, key). A record's scores meet its draw counts (all replicates in one value) in one row; a task adds up
    the counts of equal scores of one side before they move. Ranges of about ``block`` scores are reduced on their own to three numbers per
    replicate (weights of both sides, and wins inside), and the ranges of a group add up in order: wins inside, plus a range's positives
    against the negatives of the ranges below."""
    from counterlens.operators.ranking import with_bucket

    scored = scored.select(*by, key, F.col(score).alias("__s"), F.col(positive).cast("boolean").alias("__y"))
    people = scored.select(key, "__y").distinct()
    weights = None
    for flag, salt in ((True, 1), (False, 2)):
        side = draw_counts(people.filter(F.col("__y") == F.lit(flag)), key, [], replicates, seed, salt)
        weights = side if weights is None else weights.unionByName(side)
    buckets = max(1, -(-people.count() // block))
    few = min(shuffle_partitions(scored.sparkSession), max(scored.sparkSession.sparkContext.defaultParallelism, buckets * block // HELD))
    own = with_bucket(scored, by, "__s", buckets).repartition(few, key).groupBy(key).agg(
        F.collect_list(F.struct(*by, F.col("__b").alias("__bk"), F.col("__s").cast("double").alias("__s"), "__y")).alias("__rows"))
    joined = own.join(weights.repartition(few, key), key).select("__rows", "w")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.select(*by).schema.fields)
    names = [*by, "__bk", "__s", "__y"]

    def summed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        lists, w = whole.column("__rows").chunk(0), weight_matrix(whole.column("w").to_pylist())
        rows = pa.Table.from_arrays([lists.flatten().field(c) for c in names], names=names)
        at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        codes = [pd.factorize(rows.column(c).to_numpy(zero_copy_only=False), use_na_sentinel=False)[0] for c in names]
        order = np.lexsort(codes)
        fresh = np.append(True, np.any([np.diff(c[order]) != 0 for c in codes], axis=0))
        first = np.append(np.flatnonzero(fresh), len(order))
        lo = 0
        while lo < len(first) - 1:                         # the counts of an eighth of the records at once
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + HELD // 8, "right")) - 1)
            total = run_sums(w, at[order[first[lo]:first[hi]]], first[lo:hi + 1] - first[lo])
            packed = [x.astype(np.uint8 if m < 1 << 8 else np.uint16 if m < 1 << 16 else np.uint32).tobytes() for x, m in zip(total, total.max(axis=1))]
            yield from rows.take(pa.array(order[first[lo:hi]])).append_column("w", pa.array(packed, pa.binary())).combine_chunks().to_batches()
            lo = hi

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, HELD):
                held.append(batch.slice(lo, HELD))
                if sum(x.num_rows for x in held) >= HELD:
                    yield from summed(held)
                    held = []
        if held:
            yield from summed(held)

    def unpacked(column) -> np.ndarray:
        return np.stack([np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // replicates]) for x in column])

    def reduced(pdf):
        w, y = unpacked(pdf["w"]), pdf["__y"].to_numpy(bool)
        value, at = np.unique(pdf["__s"].to_numpy(), return_inverse=True)
        p, q = (np.zeros((len(value), replicates)) for _ in range(2))
        for side, total in ((y, p), (~y, q)):
            order = np.flatnonzero(side)
            order = order[np.argsort(at[order], kind="stable")]
            if len(order):
                first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
                total[at[order[first]]] = run_sums(w, order, np.append(first, len(order)))
        wins = np.einsum("ij,ij->j", p, np.cumsum(q, axis=0) - 0.5 * q)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "low": [float(value[0])], "p": [p.sum(axis=0)], "q": [q.sum(axis=0)], "u": [wins]})

    def added(pdf):
        pdf = pdf.sort_values("low")
        p, q, u = (np.stack(pdf[c].to_numpy()) for c in ("p", "q", "u"))
        wins = (u + p * (np.cumsum(q, axis=0) - q)).sum(axis=0)
        n = p.sum(axis=0) * q.sum(axis=0)
        auc = np.where(n > 0, wins / np.where(n > 0, n, 1), np.nan)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "b": np.arange(len(auc)), "auc": auc})

    counts = joined.mapInArrow(merged, f"{keys}, __bk int, __s double, __y boolean, w binary")
    ranges = counts.groupBy(*by, "__bk").applyInPandas(reduced, f"{keys}, low double, p array<double>, q array<double>, u array<double>")
    out = ranges.groupBy(*by).applyInPandas(added, f"{keys}, b long, auc double")
    return out.withColumn("auc", F.when(~F.isnan("auc"), F.col("auc")))


def sign_flips(flips: int, units: DataFrame, unit: str, seed: int) -> DataFrame:
    """A random sign per (flip, unit index): rows (flip, unit, sign)."""
    spark = units.sparkSession
    grid = units.select(unit).crossJoin(F.broadcast(spark.range(flips).withColumnRenamed("id", "flip")))
    grid = draw_number(grid, seed, ["flip", unit], "__u")
    return grid.select("flip", unit, F.when(F.col("__u") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
