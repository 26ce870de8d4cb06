"""Writers: manifests, review samples, score exports, named numbers and run metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlens.operators.splits import stratified_sample


def write_manifest(pairs: DataFrame, cells: DataFrame, reports: dict[str, DataFrame], path: str, seed: int) -> None:
    """Pairs and cells partitioned by (axis, encoding); counts, template hashes and reports; the manifest row is written
    last, so a folder without it is an unfinished write."""
    spark = pairs.sparkSession
    remove_tree(spark, f"{path}/_manifest")                # a failed rewrite must not look finished
    pairs.write.mode("overwrite").partitionBy("varied_axis", "encoding").parquet(f"{path}/pairs")
    cells.write.mode("overwrite").partitionBy("encoding").parquet(f"{path}/cells")
    for name, report in reports.items():
        report.write.mode("overwrite").parquet(f"{path}/reports/{name}")
    stored = spark.read.parquet(f"{path}/pairs")
    counts = stored.groupBy("varied_axis", "encoding").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("template_id").alias("templates"),
                                                           F.bit_xor(F.xxhash64("id")).alias("ids_hash"))
    counts.withColumn("seed", F.lit(seed)).coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_manifest")


def write_review_sample(pairs: DataFrame, stratum: str, n: int, seed: int, path: str, key: str = "id") -> None:
    """A stratified sample for reading by hand, as CSV."""
    flat = [c for c, t in pairs.dtypes if not t.startswith(("array", "map", "struct"))]
    stratified_sample(pairs.select(*flat), key, stratum, n, seed).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_scores(scores: DataFrame, path: str, ids: list[str], columns: list[str]) -> None:
    """Identifiers and numbers, never texts; an existing result is not overwritten."""
    texts = {"text", "text_a", "text_b", "prompt", "document"} & set(ids + columns)
    if texts:
        raise ValueError(f"score exports carry no texts: {sorted(texts)}")
    scores.select(*ids, *columns).write.mode("errorifexists").parquet(path)


def named_numbers(metrics: DataFrame, source: str) -> DataFrame:
    """Long (name, value, source) with ``Lo`` and ``Hi`` for the bounds of ``metrics`` (name, value, lo, hi)."""
    rows = F.array(*[F.struct(F.concat(F.col("name"), F.lit(s)).alias("name"), F.col(c).alias("value")) for s, c in (("", "value"), ("Lo", "lo"), ("Hi", "hi"))])
    return metrics.select(F.explode(rows).alias("e")).select("e.name", "e.value", F.lit(source).alias("source")).filter("value is not null")


def variant_suffix(settings: dict, defaults: dict) -> str:
    """The part of a result's name that states the settings differing from the defaults."""
    changed = {k: v for k, v in settings.items() if defaults.get(k) != v}
    return "".join(f"-{k}={str(v).replace('/', '_').replace(' ', '_')}" for k, v in sorted(changed.items()))


def run_metadata(spark: SparkSession, run_id: str, config: dict, inputs: DataFrame) -> DataFrame:
    """One row per input file with the run's configuration and application id."""
    return inputs.withColumn("run_id", F.lit(run_id)).withColumn("config", F.lit(json.dumps(config, sort_keys=True))).withColumn(
        "application", F.lit(spark.sparkContext.applicationId))
