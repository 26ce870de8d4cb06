"""Seeded splits, quotas, folds, balanced labels, derangements and one-to-one matching.

Every order here is the order of a digest of (seed, key), ranked in two levels (`ranking.hash_rank`), so no group
is sorted in one task and the result does not depend on the cluster layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.functions.keyed import coin, digest
from counterlens.operators.ranking import hash_rank, null_safe_join, ordered_rank

NO_GROUP: list[str] = []


def probe_split(records: DataFrame, key: str, stratum: str, n_probe: int, seed: int) -> DataFrame:
    """Adds ``probe``: the first records of each stratum in hashed order up to its quota of ``n_probe`` (largest
    remainder). At least a fifth, at most 50, of the records stay outside. One row per record."""
    sizes = records.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))
    sizes = sizes.withColumn("__all", total)
    min_test = F.least(F.greatest(F.floor(F.col("__all") / 5), F.lit(1)), F.lit(50))
    sizes = sizes.withColumn("__n", F.least(F.lit(n_probe), F.greatest(F.col("__all") - min_test, F.lit(1))))
    quotas = _remainder_quota(sizes, stratum)
    ranked = hash_rank(records, digest(seed, F.col(key)), [key], [stratum], "__rank")
    out = null_safe_join(ranked, F.broadcast(quotas), [stratum])
    return out.withColumn("probe", F.col("__rank") <= F.col("quota")).drop("__rank", "quota")


def _remainder_quota(sizes: DataFrame, stratum: str) -> DataFrame:
    """Largest-remainder quotas where the amount to share is the column ``__n`` of the strata table."""
    exact = F.col("__n") * F.col("size") / F.col("__all")
    s = sizes.withColumn("__x", exact).withColumn("__f", F.floor("__x"))
    left = F.col("__n") - F.sum("__f").over(Window.partitionBy(F.lit(0)))
    s = s.withColumn("__left", left).withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(
        (F.col("__x") - F.col("__f")).desc(), F.col(stratum).cast("string"))))
    return s.select(stratum, (F.col("__f") + (F.col("__k") <= F.col("__left")).cast("long")).cast("long").alias("quota"))


def interleaved(members: DataFrame, record: str, member: str, seed: int) -> DataFrame:
    """Test order: a record's members are rotated by the record's position, then taken round-robin. Adds
    ``turn`` (round) and ``record_pos``; order by (turn, record_pos)."""
    positions = hash_rank(members.select(record).distinct(), digest(seed, F.col(record)), [record], NO_GROUP, "__p")
    per = Window.partitionBy(record)
    m = (members.withColumn("__i", F.row_number().over(per.orderBy(member)) - 1)
         .withColumn("__n", F.count(F.lit(1)).over(per)))
    out = m.join(positions.select(record, (F.col("__p") - 1).alias("record_pos")), record)
    return out.withColumn("turn", F.pmod(F.col("__i") - F.col("record_pos"), F.col("__n")).cast("long")).drop("__i", "__n")


def first_in_turns(ordered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of an interleaved order."""
    ranked = ordered_rank(ordered, NO_GROUP, "turn", ["record_pos"], "__n")
    return ranked.filter(F.col("__n") <= n).drop("__n")


def split_report(df: DataFrame, record: str, stratum: str, side: str) -> DataFrame:
    """Rows and distinct records per side and stratum."""
    per_record = df.groupBy(side, stratum, record).agg(F.count(F.lit(1)).alias("__n"))
    return per_record.groupBy(side, stratum).agg(F.sum("__n").alias("pairs"), F.count(F.lit(1)).alias("records"))


def deal_folds(records: DataFrame, key: str, group: str, k: int, seed: int, label: str = "folds",
               out: str = "fold") -> DataFrame:
    """Folds 0..k-1 dealt round-robin in hashed order inside each group."""
    ranked = hash_rank(records, digest(seed, label, F.col(group), F.col(key)), [key], [group], "__rank")
    return ranked.withColumn(out, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def half_labels(records: DataFrame, key: str, group: str, seed: int, out: str = "head") -> DataFrame:
    """True for exactly half of every group in hashed order; an odd group's middle record decides by its coin."""
    ranked = hash_rank(records, digest(seed, F.col(key)), [key], [group], "__rank")
    sizes = ranked.groupBy(group).agg(
        F.count(F.lit(1)).alias("__n"))
    r = null_safe_join(ranked, sizes, [group])
    half = F.floor(F.col("__n") / 2)
    middle = (F.col("__n") % 2 == 1) & (F.col("__rank") == half + 1)
    return r.withColumn(out, (F.col("__rank") <= half) | (middle & coin(seed, F.col(key)))).drop("__rank", "__n")


def cap_groups(records: DataFrame, group: str, order: Column, key: str, cap: float) -> DataFrame:
    """The first records of each group in ``order`` (a digest), so that no group exceeds ``cap`` of the result."""
    from counterlens.operators.rules import cap_limit

    limit = cap_limit(records.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), "__n", cap)
    ranked = hash_rank(records, order, [key], [group], "__rank")
    return (ranked.crossJoin(F.broadcast(limit)).filter(F.col("limit").isNull() | (F.col("__rank") <= F.col("limit")))
            .drop("__rank", "limit"))


def balanced_couples(records: DataFrame, key: str, prompt: str, strong: str, seed: int, n: int | None = None
                     ) -> DataFrame:
    """Equal strong and weak counts within each prompt: the i-th strong meets the i-th weak; couples are ordered by
    their earlier member and the first ``n // 2`` kept. Adds ``couple`` (its place in the order)."""
    placed = hash_rank(records, digest(seed, F.col(key)), [key], NO_GROUP, "__pos")
    ranked = hash_rank(placed, digest(seed, F.col(key)), [key], [prompt, strong], "__i")
    couples = (ranked.groupBy(prompt, "__i").agg(F.count(F.lit(1)).alias("__c"), F.min("__pos").alias("__first"))
               .filter("__c = 2"))
    kept = null_safe_join(ranked, couples.select(prompt, "__i", "__first"), [prompt, "__i"])
    if n:
        from counterlens.operators.ranking import ordered_rank
        order = ordered_rank(couples.withColumn("__first", F.col("__first").cast("double")), [], "__first", [], "__k")
        keep = order.filter(F.col("__k") <= n // 2).select(F.col("__first").cast("long").alias("__first"))
        kept = kept.join(keep, "__first", "left_semi")
    return kept.withColumnRenamed("__first", "couple").drop("__i", "__pos")


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per non-blank key: the earliest by position. An aggregate, so a hot key is combined map-side."""
    others = [c for c in df.columns if c != key]
    return (df.filter(F.col(key).isNotNull() & (F.trim(key) != ""))
            .groupBy(key).agg(F.min_by(F.struct(*others), position).alias("__s"))
            .select(*[F.col(key) if c == key else F.col(f"__s.{c}").alias(c) for c in df.columns]))


def seeded_order(df: DataFrame, key: str, seed, n: int | None = None) -> DataFrame:
    """Seeded shuffle, optionally its first ``n`` by a two-level rank, so neither all rows nor ``n`` meet in one task."""
    order = digest(seed, F.col(key))
    return hash_rank(df, order, [key], NO_GROUP, "__n").filter(F.col("__n") <= n).drop("__n") if n else df.orderBy(order, key)


def select_per_class(df: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` of each class in hashed order."""
    return hash_rank(df, digest(seed, F.col(key)), [key], [label], "__rank").filter(F.col("__rank") <= n).drop("__rank")


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """``ceil(n / strata)`` per stratum by hashed order."""
    k = df.agg(F.ceil(F.lit(n) / F.count_distinct(stratum)).alias("__k"))
    ranked = hash_rank(df, digest(seed, F.col(key)), [key], [stratum], "__rank")
    return ranked.crossJoin(F.broadcast(k)).filter(F.col("__rank") <= F.col("__k")).drop("__rank", "__k")


def even_split(available: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``total`` spread over the keys as evenly as their sizes allow; leftovers go to the first keys by name among
    those with room. ``available`` is a small table, one row per key: ``alloc`` is added.

    Filling from the smallest: a key is full when its size is at most the even share of what the others leave."""
    everything = Window.partitionBy(F.lit(0))
    up = everything.orderBy(F.col(size), F.col(key))
    a = available.withColumn("__k", F.row_number().over(up)).withColumn("__m", F.count(F.lit(1)).over(everything))
    a = a.withColumn("__below", F.coalesce(F.sum(size).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    share = F.floor((F.lit(total) - F.col("__below")) / (F.col("__m") - F.col("__k") + 1))
    # shares assume that every smaller key is full, so the first key that is not sets the level for the rest
    a = a.withColumn("__stop", F.min(F.when(F.col(size) > share, F.struct(F.col("__k").alias("k"), share.alias("share")))).over(everything))
    a = a.withColumn("__full", F.col("__stop").isNull() | (F.col("__k") < F.col("__stop.k"))).withColumn("__level", F.col("__stop.share"))
    a = a.withColumn("alloc", F.when(F.col("__full"), F.col(size)).otherwise(F.col("__level")))
    left = F.lit(total) - F.sum("alloc").over(everything)
    by_name = everything.orderBy((F.col(size) <= F.col("alloc")).cast("int"), F.col(key))
    a = a.withColumn("__left", left).withColumn("__n", F.row_number().over(by_name))
    room = F.col(size) > F.col("alloc")
    return a.withColumn("alloc", (F.col("alloc") + (room & (F.col("__n") <= F.col("__left"))).cast("long")).cast("long")
                        ).drop("__k", "__m", "__below", "__stop", "__full", "__level", "__left", "__n")


def pool_shares(records: DataFrame, key: str, strong: str, seed: int) -> DataFrame:
    """Adds ``pool``: strong_strong, weak_weak, strong_weak:strong, strong_weak:weak or unused, by exact quotas that
    give the three pairings equal capacity."""
    n = records.agg(F.count_if(F.col(strong)).alias("__s"), F.count_if(~F.col(strong)).alias("__w"))
    small = F.least("__s", "__w")
    own_s = F.bround(2.0 * small / (3.0 * F.col("__s")) * F.col("__s")).cast("long")
    own_w = F.bround(2.0 * small / (3.0 * F.col("__w")) * F.col("__w")).cast("long")
    q = n.select(own_s.alias("__os"), own_w.alias("__ow"),
                 F.least(F.col("__s") - own_s, F.col("__w") - own_w).alias("__cross"))
    ranked = hash_rank(records, digest(seed, "pool", F.col(key)), [key], [strong], "__rank").crossJoin(F.broadcast(q))
    s = F.col(strong)
    own = F.when(s, F.col("__os")).otherwise(F.col("__ow"))
    return ranked.withColumn("pool", F.when(F.col("__rank") <= own, F.when(s, "strong_strong").otherwise("weak_weak"))
                             .when(F.col("__rank") <= own + F.col("__cross"),
                                   F.when(s, "strong_weak:strong").otherwise("strong_weak:weak"))
                             .otherwise("unused")).drop("__rank", "__os", "__ow", "__cross")


def draw_pairs(pooled: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """Record pairs inside each match group: consecutive ranks of the same pool, equal ranks across the two sides of
    strong_weak. Each record is used at most once. Rows (pairing, group, x, y, index); ``index`` counts a pairing's
    pairs in the order of their anchors."""
    used = pooled.filter("pool <> 'unused'")
    r = hash_rank(used, digest(seed, "order", F.col(key)), [key], ["pool", group], "__i")
    same = r.filter(F.col("pool").isin("strong_strong", "weak_weak")).withColumn("__p", F.floor((F.col("__i") + 1) / 2))
    same = same.withColumn("__side", F.pmod(F.col("__i") + 1, F.lit(2))).withColumn("pairing", F.col("pool"))
    cross = (r.filter(F.col("pool").startswith("strong_weak")).withColumn("__p", F.col("__i"))
             .withColumn("__side", (F.col("pool") == "strong_weak:weak").cast("long"))
             .withColumn("pairing", F.lit("strong_weak")))
    cols = ["pairing", group, "__p", "__side", key]
    both = same.select(*cols).unionByName(cross.select(*cols))
    pairs = (both.groupBy("pairing", group, "__p")
             .agg(F.max(F.when(F.col("__side") == 0, F.col(key))).alias("x"),
                  F.max(F.when(F.col("__side") == 1, F.col(key))).alias("y"))
             .filter(F.col("x").isNotNull() & F.col("y").isNotNull()))
    out = hash_rank(pairs, digest(seed, "order", F.col("x")), ["x"], ["pairing"], "__n")
    return out.select("pairing", group, "x", "y", (F.col("__n") - 1).alias("index"))


def _class_order(df: DataFrame, by: list[str], clash: str, key: str, seed: int) -> DataFrame:
    """Adds ``__i`` (1-based rank in the group, one clash class after the other, the largest first), ``__n`` rows and
    ``__m`` rows of the largest class. A null class is a class."""
    sizes = df.groupBy(*by, clash).agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    order = group.orderBy(F.desc("__c"), clash)                                   # one row per class
    sizes = sizes.select(*by, clash, F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
                         F.sum("__c").over(group).alias("__n"), F.max("__c").over(group).alias("__m"))
    inside = hash_rank(df, digest(seed, "order", F.col(key)), [key], by + [clash], "__place")
    placed = null_safe_join(inside, sizes, by + [clash])
    return placed.withColumn("__i", F.col("__place") + F.coalesce("__before", F.lit(0))).drop("__place", "__before")


def _spread_halves(rows: DataFrame, by: list[str], clash: str, key: str, seed: int) -> DataFrame:
    """Adds ``__p`` and ``__second``: ranks run class after class, rank i meets rank i + h, h being half the group or its largest class,
    whichever is more, so that no two of one class meet. ``__p`` is null for the ranks between, which are all of the largest class, or one."""
    r = _class_order(rows, by, clash, key, seed)
    h = F.greatest(F.ceil(F.col("__n") / 2), F.col("__m"))
    second = F.col("__i") > h
    place = F.when(second, F.col("__i") - h).when(F.col("__i") <= F.col("__n") - h, F.col("__i"))
    return r.withColumn("__p", place).withColumn("__second", second).drop("__i", "__n", "__m")


def _met(rows: DataFrame, by: list[str], what: Column) -> DataFrame:
    """``what`` of the first and the second side of each place, as x and y."""
    one = rows.filter(F.col("__p").isNotNull()).groupBy(*by, "__p").agg(
        F.max(F.when(~F.col("__second"), what)).alias("x"), F.max(F.when(F.col("__second"), what)).alias("y"))
    return one.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def _across(pooled: DataFrame, key: str, group: str, seed: int, clash: str) -> DataFrame:
    """Pairs (group, x, y) of the strong and the weak side, as many as classes allow: the shorter side, or all that is
    not of one class on both sides, whichever is fewer.

    Ranks meet first. Pairs of one class then swap partners with such pairs of another class. What still clashes is of one class per
    group (or a single pair): each swaps with a pair that has that class on neither side, or takes a record of the longer side
    that met none. If those run out, every pair has that class on one side, and none can be added."""
    from counterlens.session import cut_lineage

    weak = F.col("pool") == "strong_weak:weak"
    ranked = hash_rank(pooled.withColumn("__weak", weak), digest(seed, "order", F.col(key)), [key], [group, "__weak"], "__p")
    who = F.struct(F.col(key).alias("k"), F.col(clash).alias("c"))
    one = ranked.groupBy(group, "__p").agg(F.max(F.when(~F.col("__weak"), who)).alias("x"), F.max(F.when(F.col("__weak"), who)).alias("y"))
    one = cut_lineage(one.withColumn("__clash", F.coalesce(F.col("x.c").eqNullSafe(F.col("y.c")) & F.col("x").isNotNull() & F.col("y").isNotNull(), F.lit(False))))
    id_ = F.coalesce("x.k", "y.k").alias("id")
    bad = one.filter("__clash").select(group, "x", "y", F.col("x.c").alias("kind"), id_)
    halves = cut_lineage(_spread_halves(bad, [group], "kind", "id", seed + 1))
    met = _met(halves, [group], F.struct("x", "y"))
    swapped = met.select(group, F.explode(F.array(F.struct(F.col("x.x").alias("x"), F.col("y.y").alias("y")),
                                                  F.struct(F.col("y.x").alias("x"), F.col("x.y").alias("y")))).alias("e")).select(group, "e.*")
    left = halves.filter(F.col("__p").isNull()).select(group, "x", "y", "kind", "id")
    free = one.filter(~F.col("__clash")).select(group, "x", "y").unionByName(swapped)
    named = cut_lineage(free.withColumn("id", F.coalesce("x.k", "y.k")))
    of = left.groupBy(group).agg(F.max(F.struct("kind")).alias("__of"))                 # one class per group
    apart = lambda side: F.col(side).isNull() | ~F.col(f"{side}.c").eqNullSafe(F.col("__of.kind"))
    able = null_safe_join(named, of, [group]).filter(apart("x") & apart("y")).drop("__of")
    a = hash_rank(left, digest(seed + 2, "left", F.col("id")), ["id"], [group], "lane").select(group, "lane", F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = hash_rank(able, digest(seed + 3, "able", F.col("id")), ["id"], [group], "lane").select(group, "lane", "x", "y", "id")
    both = cut_lineage(null_safe_join(a, b, [group, "lane"]))
    mended = both.select(group, F.explode(F.array(F.struct(F.col("lx").alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), F.col("ly").alias("y")))).alias("e")).select(group, "e.*")
    rest = named.join(both.select("id"), "id", "left_anti").select(group, "x", "y")
    done = rest.unionByName(mended).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return done.select(group, F.col("x.k").alias("x"), F.col("y.k").alias("y"))


def settle_pairs(pooled: DataFrame, key: str, group: str, seed: int, clash: str, want: dict[str, int] | None = None) -> DataFrame:
    """Record pairs inside each match group under a condition: two records with the same ``clash`` value may not meet (a null
    value is a value). Rows (pairing, group, x, y, index); as many pairs as the condition allows, settled by ranks and class counts,
    so that a match group's records are never gathered in one task. ``index`` orders a pairing's pairs by their first
    record's hash; with ``want`` (pairing -> pairs asked for) a smaller request gives a prefix of a larger one's. ``key`` is unique."""
    rows = pooled.select(key, group, clash, "pool")
    same = _spread_halves(rows.filter(F.col("pool").isin("strong_strong", "weak_weak")), ["pool", group], clash, key, seed)
    inside = _met(same, ["pool", group], F.col(key)).select(F.col("pool").alias("pairing"), group, "x", "y")
    across = _across(rows.filter(F.col("pool").startswith("strong_weak")), key, group, seed, clash)
    pairs = inside.unionByName(across.select(F.lit("strong_weak").alias("pairing"), group, "x", "y"))
    out = hash_rank(pairs, digest(seed, "pair", F.col("x")), ["x"], ["pairing"], "index").withColumn("index", F.col("index") - 1)
    if want is None:
        return out
    asked = F.create_map(*[F.lit(v) for item in want.items() for v in item]) if want else F.create_map().cast("map<string,int>")
    return out.filter(F.col("index") < F.coalesce(F.element_at(asked, F.col("pairing")), F.lit(0)))


def unpaired(pooled: DataFrame, pairs: DataFrame, key: str, group: str | None = None, clash: str | None = None, drawn: DataFrame | None = None) -> DataFrame:
    """Records left over by a pairing, with the reason: outside the pools; beyond the request (``drawn``: all pairs, of which ``pairs`` is
    the part asked for); with ``group`` and ``clash``, of the class that most of the group's pool is of; or no partner left. Reasons and
    pairs add up to the records."""
    ids = lambda p: p.select(F.col("x").alias(key)).union(p.select(F.col("y").alias(key)))
    rest = pooled.join(ids(pairs), key, "left_anti")
    reason = F.when(F.col("pool") == "unused", "outside the pools")
    if drawn is not None:
        rest = rest.join(ids(drawn).withColumn("__drawn", F.lit(True)), key, "left")
        reason = reason.when(F.col("__drawn"), "beyond the request")
    if clash is not None:
        side = F.split("pool", ":")[0]
        counts = pooled.withColumn("__pool", side).groupBy("__pool", group, clash).agg(F.count(F.lit(1)).alias("__c"))
        top = counts.groupBy("__pool", group).agg(F.max_by(F.struct(F.col(clash).alias("c")), F.struct("__c", F.col(clash).isNull(), clash)).alias("__top"))
        rest = null_safe_join(rest.withColumn("__pool", side), top, ["__pool", group], "left")
        reason = reason.when(F.col(clash).eqNullSafe(F.col("__top.c")), "same class")
    return rest.withColumn("reason", reason.otherwise("no partner left")).select(*pooled.columns, "reason")


def match_one_to_one(treated: DataFrame, pool: DataFrame, keys: list[str], key: str, seed: int) -> DataFrame:
    """Exact matching without replacement: the i-th treated record of a key tuple gets its i-th pool record in hashed
    order. Rows (keys, treated, control); control is null for an unmatched record."""
    t = hash_rank(treated, digest(seed, "treated", F.col(key)), [key], keys, "__i").select(
        *keys, "__i", F.col(key).alias("treated"))
    p = hash_rank(pool, digest(seed, "pool", F.col(key)), [key], keys, "__i").select(
        *keys, "__i", F.col(key).alias("control"))
    return null_safe_join(t, p, keys + ["__i"], "left").drop("__i")


def derangement(records: DataFrame, key: str, label: str, seed: int, forbidden: list[tuple[str, str]] = (), patience: int = 4) -> DataFrame:
    """Adds ``target``: a permutation of the labels in which nobody keeps their own or gets a forbidden partner's.

    A hashed permutation first. Each row that it leaves in conflict then proposes a swap of targets to a row at a hashed place; of the
    proposals that would leave neither in conflict, each row takes part in the one that hashes lowest at both its rows. If nothing was
    swapped for ``patience`` rounds, rows in conflict are sent to a kind (label, target) that can swap with theirs. No label or
    kind passes the driver. ``key`` is unique; no solution by swaps is an error."""
    from counterlens.session import cut_lineage

    src = hash_rank(records, digest(seed, "own", F.col(key)), [key], NO_GROUP, "__i")
    tgt = hash_rank(records, digest(seed, "target", F.col(key)), [key], NO_GROUP, "__i").select("__i", F.col(label).alias("target"))
    state = cut_lineage(src.join(tgt, "__i"))
    total = state.count()
    barred = sorted({"\0".join(sorted(p)) for p in forbidden})

    def clash(a: Column, b: Column) -> Column:
        met = F.concat(F.least(a, b), F.lit("\0"), F.greatest(a, b)).isin(barred) if barred else F.lit(False)
        return a.eqNullSafe(b) | F.coalesce(met, F.lit(False))

    own, idle, step = clash(F.col(label), F.col("target")), 0, 0
    while True:
        bad = state.filter(own).select(F.col("__i").alias("i"), F.col(label).alias("l"), F.col("target").alias("t"))
        if bad.isEmpty():
            return state.drop("__i")
        if idle > patience:
            raise ValueError("no derangement found: one label dominates the group")
        other = state.select(F.col("__i").alias("j"), F.col(label).alias("l2"), F.col("target").alias("t2"))
        fits = ~clash(F.col("l"), F.col("t2")) & ~clash(F.col("l2"), F.col("t"))
        if idle < patience:
            place = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "i"), F.lit(total)) + 1
            offers = bad.withColumn("j", place).join(other, "j").filter((F.col("i") != F.col("j")) & fits)
        else:                                       # the few kinds in conflict meet the kinds there are
            kinds = bad.select("l", "t").distinct().crossJoin(other.select("l2", "t2").distinct()).filter(fits)
            kinds = kinds.groupBy("l", "t").agg(F.min_by(F.struct("l2", "t2"), F.xxhash64(F.lit(step), "l2", "t2")).alias("k")).select("l", "t", "k.*")
            a = hash_rank(bad, digest(seed, "i", F.col("i")), ["i"], ["l", "t"], "r")
            b = hash_rank(other, digest(seed, "j", F.col("j")), ["j"], ["l2", "t2"], "r")
            offers = null_safe_join(null_safe_join(a, kinds, ["l", "t"]), b, ["l2", "t2", "r"])
        offers = cut_lineage(offers.select("i", "j", "t", "t2", F.xxhash64(F.lit(seed), F.lit(step), "i", "j").alias("h")))
        at = offers.select("h", F.col("i").alias("p")).union(offers.select("h", F.col("j").alias("p")))
        least = at.groupBy("p").agg(F.min("h").alias("h"))
        taken = least.groupBy("h").count().filter("count = 2").select("h")
        swaps = offers.join(taken, "h")
        moved = swaps.select(F.col("i").alias("__i"), F.col("t2").alias("__new")).union(swaps.select("j", "t"))
        moved = cut_lineage(moved)
        idle, step = (idle + 1 if moved.isEmpty() else 0), step + 1
        if not idle:
            state = cut_lineage(state.join(moved.withColumn("__moved", F.lit(True)), "__i", "left").withColumn(
                "target", F.when(F.col("__moved"), F.col("__new")).otherwise(F.col("target"))).drop("__new", "__moved"))
