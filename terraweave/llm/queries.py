"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.llm import feistel, language, line_quality, mixing, oracles, packing, simhash, suffix_dedup, token_store, topk, url_filter
from terraweave.llm.common import Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept")


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", mixing.words_in("text").alias("size"), "source")
    return mixing.mix(sized, "size", "source").select("doc_id", "size", "source_size", "target", "taken")


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_rans_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    token_store.write(table(spark, sf_dir, "documents"), f"{tables.root}/store", TOKENIZER)
    tables.keep_until_exit()
    return token_store.read(spark, f"{tables.root}/store")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract fixes shingles of three words."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op8_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    vectors = rows.select(F.col("vec_id").alias("id"), whole.alias("v"))
    return topk.top_k(vectors, vectors.filter("id % 50 = 0"), 5)


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = language.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


SHARDS = 8
SEED = 20


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = feistel.shard_rows(sized, SHARDS, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_pivotal_mix, op2_cost_packing, op3_url_filter, op4_suffix_dedup, op5_line_quality, op6_rans_store, op7_simhash, op8_threshold_topk, op9_string_kernel, op10_feistel_shards)}
ORACLES = {"op4_suffix_dedup": oracles.suffix_dedup(), "op5_line_quality": oracles.line_rules(), "op8_threshold_topk": oracles.TOP_K, "op10_feistel_shards": oracles.shards(SHARDS, SEED)}
