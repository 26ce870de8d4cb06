"""One query per corpus operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlens.llm import (huffman, language, licenses, mixing, packing, parsing, positions, repeats, simhash, spelling, sql, token_cache,
                             vector_tree, whitening)
from counterlens.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
WORD_TOKENIZER = "word_bpe_49k.json"
WORD_END_ID = 1


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighted 5, 2, 1 share 150 % of all words."""
    mixed = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op2_window_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-word windows that start earlier elsewhere lose their words."""
    return repeats.drop_repeated_windows(table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, through a cache that starts empty."""
    return token_cache.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                                    token_cache.new_cache(spark))


@query
def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written in Huffman-coded files and read back."""
    return huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


@query
def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    return language.predictions(docs, language.train(docs))


@query
def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints within four bits of each other, as components."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and wordings in every text."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query
def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every text."""
    found = positions.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


@query
def op4_triggered_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hundred-byte strings that start twice lose their bytes."""
    return parsing.drop_repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op10_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of every twentieth vector."""
    return vector_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened components of every vector."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in pieces of at most 4096 tokens, packed."""
    pieces = packing.encoded_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), WORD_END_ID)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row")
    return packing.place(digests).drop("row")


@query
def op13_edit_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, one in 97 occurrences damaged, with their more frequent near words."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), damage=97))


ORACLES["op2_window_repeats"] = sql.WINDOW_REPEATS
ORACLES["op7_license_diagonals"] = sql.LICENSES
ORACLES["op9_positional_index"] = sql.CONTAMINATION
