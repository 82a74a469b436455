"""Queries of this subpackage, their SQL, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, clustering, decontamination, filter_audit, jaccard_join, language_model, license_scan, mixing, quality, sharding, sql, token_counts, token_files, toxicity
from .common import scratch_path

LIMIT_TOKENS = 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_by_table(_table(spark, sf_dir, "documents"))
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), scratch_path(spark, "token-count-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT_TOKENS).alias("over_limit"))


#: Target weights among siblings; a node that isn't named weighs 1.
MIX_WEIGHTS = {
    "domain": {"web": 4, "books": 5, "forums": 3},
    "language": {"en": 6, "fr": 3, "de": 3, "es": 2},
    "source": {"src0": 2, "src1": 3, "src7": 2},
}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 2, 7


def mix_domain(source: Column) -> Column:
    """The domains of the test corpus: by the number at the end of a source."""
    number = F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("int")
    return F.when(number % 5 == 0, "web").when(number % 5 < 3, "books").when(number % 5 < 5, "forums").otherwise("other")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = mixing.light_rows(_table(spark, sf_dir, "documents"), domain_of=mix_domain)
    plan = mixing.plan_mix(light, MIX_PERCENT, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)
    return mixing.take(light, plan, MIX_SEED).select("doc_id", "domain", "language", "source", "tokens", "epoch")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_to_files(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link_components(_table(spark, sf_dir, "documents"), shingle=3, threshold=90)
    return linked.select("doc_id", "n_shingles", "component_id")


#: The two turns that are added to the conversations, to show that control strings come back.
_ADDED = r"\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-7, 0, "user", _ADDED), (-7, 1, "assistant", _ADDED)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.digest_formatted(chat_format.format_conversations(turns))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Clusters, rounds, components and their scale, and the seed of the first centroids.
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SIZE, CLUSTER_SCALE, CLUSTER_SEED = 40, 5, 64, 256, "2"


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(clustering.lloyd(_table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SIZE, CLUSTER_SCALE, CLUSTER_SEED))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.learn_and_score(_table(spark, sf_dir, "documents"), language_model.held_out())[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": sql.decontamination(),
    "op3_license_scan": sql.license_scan_sql(),
    "op4_quality_rules": sql.quality_sql(),
    "op6_mixing": sql.mixing_sql(MIX_PERCENT, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED),
    "op8_jaccard_join": sql.jaccard_sql(),
    "op9_chat_format": sql.chat_sql(_ADDED),
    "op11_filter_audit": sql.filter_audit_sql(),
    "op12_centroid_clustering": sql.clustering_sql(CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SIZE, CLUSTER_SCALE, CLUSTER_SEED),
    "op13_lm_scoring": sql.lm_scoring_sql(),
}
