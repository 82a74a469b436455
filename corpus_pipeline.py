"""From raw documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolin.llm import decontamination, jaccard_join, mixing, quality, token_files
from tempolin.llm.common import clean, cut, mark
from tempolin.llm.queries import MIX_EPOCHS, MIX_PERCENT, MIX_SEED, MIX_WEIGHTS, mix_domain, tokenizer_path

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
#: Decontamination: every hit span goes, and documents that are hit over half go whole.
WINDOW, MAX_SPAN, MAX_COVERAGE = 10, 0, 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are close to their language's references."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return jaccard_join.keep_one(docs, NEAR_SHINGLE, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontamination.decontaminate(docs, items, WINDOW, MAX_SPAN, MAX_COVERAGE)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of the target weights, once for each epoch that takes them."""
    return mixing.mix(docs, MIX_PERCENT, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED, domain_of=mix_domain)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, read back: where each document's ids are, and their checksum."""
    return token_files.encode_to_files(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token output", token_output),
]

#: SQL has no tokenizer for the last stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``.

    When a stage has been written, what it and the ones before it left in the shared
    folder is deleted, but for its result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = cut(made, name.replace(" ", "-"))
        clean(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
