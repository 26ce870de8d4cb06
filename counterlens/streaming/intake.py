"""Incremental intake of scored texts: the first score of a text wins, repeats and replays change nothing."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

PREFIX = 2                                       # leading hex digits of a key's hash that name its folder
STATE_SCHEMA = "text_key string, score double, state array<float>, gates array<float>"


def worklist(rows: DataFrame, scored: DataFrame, key: str = "text_key") -> DataFrame:
    """Unique texts without a score yet."""
    return rows.dropDuplicates([key]).join(scored.select(key).distinct(), key, "left_anti")


def score_missing(rows: DataFrame, scored: DataFrame, scorer, schema: str = STATE_SCHEMA) -> DataFrame:
    """Run a user's ``mapInPandas`` scorer over the worklist, similar lengths together. ``rows`` has (text_key, text)."""
    todo = worklist(rows, scored).withColumn("__n", F.length("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return todo.repartitionByRange(parts, "__n").sortWithinPartitions("__n").drop("__n").mapInPandas(scorer, schema)


def append_new(batch: DataFrame, path: str, key: str = "text_key", writer: str | None = None) -> None:
    """Append the batch's unseen keys to the state table, which lies in folders by the key's leading digits: a batch reads
    only the folders that it touches. Every append has a folder of its own (``writer``, unique), so writers do not disturb each
    other; two at once may both append a key, and `read_states` keeps the first."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key]).withColumn("prefix", F.substring(F.sha2(key, 256), 1, PREFIX))
    if path_exists(spark, path):
        touched = [r["prefix"] for r in fresh.select("prefix").distinct().collect()]           # 16 ** PREFIX at most
        held = spark.read.schema(_stored_schema(batch)).option("basePath", path).parquet(path).filter(F.col("prefix").isin(touched))
        fresh = fresh.join(held.select(key), key, "left_anti")
    fresh.withColumn("written", F.lit(time.time_ns())).write.partitionBy("prefix").parquet(f"{path}/writer={writer or uuid.uuid4().hex}")


def _stored_schema(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields]).add("written", "long").add("writer", "string").add("prefix", "string")


def read_states(spark: SparkSession, path: str, schema: str = STATE_SCHEMA, key: str = "text_key") -> DataFrame:
    """The state table with one row per key: the first that was written, whoever wrote it."""
    wide = StructType.fromDDL(f"{schema}, written long, writer string, prefix string")
    columns = [c for c in wide.names if c not in ("written", "writer", "prefix")]
    rows = spark.read.schema(wide).option("basePath", path).parquet(path)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("written", "writer")).alias("r"))
    return first.select("r.*")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def start_intake(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = STATE_SCHEMA,
                 files_per_batch: int = 1000) -> StreamingQuery:
    """Read new files once each (checkpointed), keep the first row per key, append unseen keys. A restarted query goes
    on after the last finished batch; a batch that is replayed finds its keys already present."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (stream.writeStream.foreachBatch(lambda df, _: append_new(df, target))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
