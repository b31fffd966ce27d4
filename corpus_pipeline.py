"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before it kept.

1. Quality rules: rejected documents go; failing lines leave the texts of the others.
2. Near-duplicates, of a similarity of 0.8 on shingles of five words: the smallest doc_id of each group stays.
3. Byte strings of 50 bytes that an earlier document holds leave the texts; a document with no
   word left goes.
4. Sources are mixed to their target weights: a document comes as often as the mix takes it.
5. Packing into sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.llm import line_quality, mixing, packing, simhash, suffix_dedup
from terraweave.llm.common import WORD, Tables
from terraweave.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_quality.only_kept(line_quality.judge(docs.select(*COLUMNS)))
    text = F.col("clean_text")
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), texts=True).filter(F.rlike("text", F.lit(WORD)))
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER, ids=True)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("suffix_dedup", repeats), ("mixing", mix), ("packing", pack)]

#: The near-duplicate stage hashes words, the mix draws random numbers and the last stage tokenizes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark)
    tables.keep_until_exit()
    for i, (name, stage) in enumerate(STAGES):
        docs = tables.save(stage(spark, docs, sf_dir), name)
        if i:
            tables.drop(STAGES[i - 1][0])
    return docs
