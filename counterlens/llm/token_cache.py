"""Token counts through a digest cache.

A text's digest (SHA-256 of its normalised content) and the tokenizer's (SHA-256 of its file) are joined to the
stored counts; only distinct texts that have none are encoded, and their counts are appended to the cache. The
normalised content is the UTF-8 text itself, null as empty: counts depend on every byte, so nothing else may be
folded.

Scale: the shuffle of misses carries each distinct text once per task at most (partial aggregation by digest), so
copies of a text never meet in one task; looking counts up moves digests only. The cache is a Parquet table in the
shared folder; a lost job leaves no half-written rows in it, and rows written twice by two jobs at once agree.

Edge cases: null and empty texts count 0 tokens; repeated rows and rows without an id each get their count; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlens.llm.common import text_chunks
from counterlens.llm.tokens import encoder
from counterlens.session import checkpoint_dir

SCHEMA = "digest binary, version string, n_tokens long"


def new_cache(spark: SparkSession) -> str:
    """Path of an empty cache in the shared folder."""
    path = f"{checkpoint_dir(spark)}/llm/token-counts-{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return path


def cached_counts(spark: SparkSession, path: str, version: str) -> DataFrame:
    kept = spark.read.schema(SCHEMA).parquet(path).filter(F.col("version") == version)
    return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _count(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(spec)
        for rows, data, offsets in text_chunks(batches, "content"):
            yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array(known.counts(data, offsets), pa.int64())],
                                             names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per input row. ``cache``: path of a cache table, extended by
    what this call had to encode."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    version = hashlib.sha256(spec.encode()).hexdigest()
    content = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", content.alias("content"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"))
    misses = (keyed.join(cached_counts(spark, cache, version), "digest", "left_anti")
              .groupBy("digest").agg(F.first("content").alias("content")))
    fresh = misses.mapInArrow(_count(spec), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(SCHEMA).parquet(cache).filter(F.col("version") == version).select("digest", "n_tokens").distinct()
    looked_up = keyed.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "digest").join(counts, "digest")
    return looked_up.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
