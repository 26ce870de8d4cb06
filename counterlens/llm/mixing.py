"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every document has an expected number of copies. Its whole part is allocated for certain; for the rest the
document competes with inclusion probability ``p`` (the fractional part): a uniform ``u`` hashed from its id
gives the rank ``(u / (1 - u)) / (p / (1 - p))``, that is random odds divided by inclusion odds, and the
smallest ranks of a sampling group are taken, as many as the group's fixed size says. Groups are (source,
size class): within a class sizes differ by at most a fifth, so a fixed number of documents is also a nearly
fixed number of words. Fixed sizes are settled from the largest class down, each class carrying the words it
is over or short to the next one, so a source ends near its target.

Scale: texts are read once, and what is kept per document is three numbers. Only a table of one row per
(source, class) is ordered; ranks are settled by a histogram of rank buckets, and only the bucket at a group's
border is sorted, so a source with a third of all rows spreads over all tasks.

Edge cases: a null text has size 0; documents of size 0 are taken once per certain copy and never sampled; a
null source is a source of its own and the last in order; rows with the same id each count (their ties are
settled by size and position); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm.common import SPACE_WORD, stored

PER_OCTAVE = 4           # size classes per doubling of the size
BUCKETS = 1024           # rank buckets of a group
WEIGHTS = (5.0, 2.0, 1.0)


def sizes(docs: DataFrame, measure: Column | None = None) -> DataFrame:
    """doc_id, source, size in words, and the document's relative preference (1 unless given)."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"),
                       (F.lit(1.0) if measure is None else measure.cast("double")).alias("measure"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight; no target above ``most`` times its
    source, the excess going to the others by weight. One row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(kinds, ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most))
    # Sources fill up in the order of cap / weight; the level is what the others share once no more of them fill up.
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    per = per.withColumn("level", left / heavy)
    # Capping one more source raises the level exactly while that source is below it, so the level is the maximum.
    per = per.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _fixed_sizes(groups: DataFrame) -> DataFrame:
    """Adds ``take``: how many documents of a (source, class) are sampled. A fold from the largest class down carries
    the words taken beyond, or short of, what was due. A class rounds to the nearer number if the smaller classes can
    still make up for it (take fewer words than their due, or find as many more), else to the other one."""
    start = F.struct(F.lit(0.0).alias("carry"), F.col("all_due").alias("due"), F.col("all_words").alias("words"),
                     F.array().cast("array<struct<class:int,take:bigint>>").alias("out"))

    def settle(acc, g):
        due, mean = g["due"] + acc["carry"], g["words"] / g["n"]
        below_due, below_words = acc["due"] - g["due"], acc["words"] - g["words"]
        low = F.greatest(F.lit(0), F.least(g["n"], F.floor(due / mean)))
        high = F.least(g["n"], low + 1)
        over, under = high * mean - due, due - low * mean
        slack = mean * 1e-9
        nearer, fits_over, fits_under = over < under, over <= below_due + slack, under <= below_words - below_due + slack
        take = F.when(nearer & (fits_over | ~fits_under), high).when(fits_under, low).when(fits_over, high).otherwise(
            F.when(nearer, high).otherwise(low)).cast("bigint")
        return F.struct((due - take * mean).alias("carry"), below_due.alias("due"), below_words.alias("words"),
                        F.concat(acc["out"], F.array(F.struct(g["class"].alias("class"), take.alias("take")))).alias("out"))

    per = groups.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("class", "n", "words", "due")), asc=False).alias("classes"),
        F.sum("due").alias("all_due"), F.sum("words").cast("double").alias("all_words"))
    per = per.withColumn("classes", F.transform("classes", lambda g: F.struct(
        g["class"].alias("class"), g["n"].alias("n"), g["words"].cast("double").alias("words"), g["due"].alias("due"))))
    taken = per.select("source", F.explode(F.aggregate("classes", start, settle, lambda a: a["out"])).alias("g"))
    return taken.select("source", "g.class", "g.take")


def pareto_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
               seed: int = 17, measure: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per input row.

    ``measure`` (not negative; null counts as 0) makes some documents of a source likelier than others: expected
    copies are proportional to it, up to ``most``."""
    sized = stored(sizes(docs, measure), "sizes")
    goal = source_targets(sized, weights, share, most)
    total = sized.groupBy("source").agg(F.sum(F.col("size") * F.coalesce("measure", F.lit(0.0))).alias("mass"))
    goal = goal.join(total, goal["source"].eqNullSafe(total["source"])).drop(total["source"])
    rate = goal.select(F.col("source").alias("s"), "source_size", "target",
                       F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0).alias("rate"))
    d = sized.join(rate, sized["source"].eqNullSafe(rate["s"])).drop("s")
    expected = F.least(F.lit(float(most)), F.col("rate") * F.coalesce("measure", F.lit(0.0)))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    d = d.withColumn("whole", F.floor(expected + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), expected - F.col("whole")))
    d = d.withColumn("class", F.when((F.col("size") > 0) & (F.col("p") > 0),
                                     F.floor(F.log2(F.col("size").cast("double")) * PER_OCTAVE)).cast("int"))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    d = d.withColumn("rank", F.when(F.col("class").isNotNull(), odds))
    d = d.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))

    hist = (d.filter("class is not null").groupBy("source", "class", "bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.sum(F.col("size") * F.col("p")).alias("due")))
    hist = stored(hist, "ranks")
    groups = hist.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.sum("due").alias("due"))
    sizes_ = _fixed_sizes(groups).withColumnRenamed("source", "s").withColumnRenamed("class", "c")
    below = Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = hist.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    edges = edges.join(sizes_, edges["source"].eqNullSafe(sizes_["s"]) & (edges["class"] == sizes_["c"]))
    edges = (edges.filter((F.col("below") < F.col("take")) & (F.col("below") + F.col("n") >= F.col("take")))
             .select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("edge"),
                     (F.col("take") - F.col("below")).alias("rest"), F.col("n").alias("edge_rows")))
    d = d.join(edges, d["source"].eqNullSafe(edges["s"]) & (d["class"] == edges["c"]), "left").drop("s", "c")
    at_edge = (F.col("bucket") == F.col("edge")) & (F.col("rest") < F.col("edge_rows"))
    inside = F.col("bucket") <= F.col("edge")
    plain = d.filter(F.coalesce(~at_edge, F.lit(True))).withColumn("extra", F.coalesce(inside, F.lit(False)))
    order = Window.partitionBy("source", "class").orderBy("rank", "doc_id", "size")
    border = d.filter(at_edge).withColumn("extra", F.row_number().over(order) <= F.col("rest"))
    d = plain.unionByName(border)
    copies = (F.col("whole") + F.col("extra").cast("long")).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken"))
