"""Token counts through a digest cache.

A count belongs to the digest of a normalised content together with the digest of the
tokenizer's file and version.  Documents are reduced to digests, known digests are
joined to the stored counts, only distinct missing contents are encoded, and their
counts are appended to the cache, a table in a shared folder.

Normalisation changes nothing that the tokenizer sees: null becomes the empty text and
all else stays.  Hence counts are those of the library for the whole text, without
begin, end or added special tokens.

Defined results: null and empty text have 0 bytes and the tokenizer's count of the
empty text; repeated rows each get a row; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, spread_join, trimmed


_CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer's file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = __import__(library).__version__
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library} {version}\n".encode() + file.read()).hexdigest()


def counter(path: str):
    """A function from a list of texts to their token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop contents that this task has passed on already, by their digests."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for digest in batch.column(0).to_pylist():
            fresh.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _encoder(path: str, tokenizer: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        seen: set[bytes] = set()
        for batch in batches:
            fresh = []
            for digest in batch.column(0).to_pylist():
                fresh.append(digest not in seen)
                seen.add(digest)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            counts: list[int] = []
            for start in range(0, batch.num_rows, 64):
                counts += count(batch.column(1).slice(start, 64).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokenizer] * len(counts), pa.string()), batch.column(0), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"]
            )

    return encode


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that isn't there yet is begun empty."""
    spark.createDataFrame([], _CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(_CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs``; extends the cache at ``cache_path``.

    Copies meet twice only as digests: each task passes on a content once, so a text
    that a third of the rows hold crosses the shuffle once a task, and rows of a digest
    that very many hold meet its count by broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text_col), F.lit("")).alias("content")
    keyed = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content, F.col(id_col).alias("doc_id"))
    known = open_cache(spark, cache_path).where(F.col("tokenizer") == tokenizer).select("digest")
    once = keyed.select("digest", "content").mapInArrow(trimmed(_first_of_each), "digest binary, content string")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    misses = once.repartition(partitions, "digest").join(known.hint("shuffle_hash"), "digest", "left_anti")
    misses.mapInArrow(trimmed(_encoder(tokenizer_path, tokenizer)), _CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    counts = spark.read.schema(_CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == tokenizer)
    # two runs may append the same count at the same time
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    light = cut(keyed.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes")), "token-count-rows")
    return spread_join(light, counts, "digest", light.count(), "left").select("doc_id", "n_bytes", "n_tokens")
