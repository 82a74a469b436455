"""Sharding by a keyed permutation of global row numbers.

Rows get gapless numbers that depend on the rows alone, not on how they are
partitioned.  A Feistel network over the next even power of two, walked until it
falls below the row count, permutes the numbers; the shard is the position modulo
the number of shards and the slot the quotient.  Both can be computed from a row
number, and the row number from both, without touching the data.

Defined results: null text counts as empty (size 1, crc 0); null ids sort first;
equal rows (same id, size and crc) are interchangeable and get consecutive
numbers; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

ROUNDS = 6
_CHUNK = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(n: int, seed: int) -> tuple[np.uint64, np.uint64, np.ndarray]:
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys = _mix(np.arange(ROUNDS, dtype=np.uint64) + _mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)))
    return np.uint64(half), np.uint64((1 << half) - 1), keys


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of the row numbers ``rows`` in the seeded permutation of 0..n-1."""
    half, mask, keys = _network(n, seed)

    def once(x):
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right ^ key) & mask)
        return (left << half) | right

    return _walk(once, rows, n)


def unpermute(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers at ``positions``: the inverse of :func:`permute`."""
    half, mask, keys = _network(n, seed)

    def once(x):
        left, right = x >> half, x & mask
        for key in keys[::-1]:
            left, right = right ^ (_mix(left ^ key) & mask), left
        return (left << half) | right

    return _walk(once, positions, n)


def _walk(once, values: np.ndarray, n: int) -> np.ndarray:
    out = once(np.asarray(values, dtype=np.uint64))
    outside = np.flatnonzero(out >= np.uint64(n))
    while outside.size:
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(row_number: int, n: int, n_shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of one row number, computed without the data."""
    position = int(permute(np.array([row_number]), n, seed)[0])
    return position % n_shards, position // n_shards


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int) -> int:
    """The row number that is stored at (shard, slot)."""
    return int(unpermute(np.array([slot * n_shards + shard]), n, seed)[0])


def shard_rows(
    docs: DataFrame, n_shards: int = 8, seed: int = 20240917, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8192
) -> DataFrame:
    """One row per row of ``docs`` with its size, row number, shard and slot.

    The text is scanned once for its size and checksum; only those travel.  Equal rows
    are counted before the shuffle, so that a row repeated many times is one record
    there.  Row numbers: hash buckets of the id in order, by (id, size, crc) within.
    ``buckets`` bounds the only table that is broadcast.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
    )
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    counted = cut(sized.groupBy(bucket, "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "shard-rows")

    ordered = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bucket = counted.groupBy("bucket").agg(F.sum("copies").alias("rows"))
    offsets = per_bucket.select("bucket", (F.sum("rows").over(ordered) - F.col("rows")).alias("offset"))
    n = counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    within = (
        Window.partitionBy("bucket")
        .orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = (
        counted.withColumn("first", F.sum("copies").over(within) - F.col("copies"))
        .join(F.broadcast(offsets), "bucket")
        .withColumn("first", F.col("first") + F.col("offset"))
        # in two steps, so that no single array is as long as the number of copies
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_CHUNK}"))))
        .withColumn("begin", F.col("first") + F.col("chunk") * _CHUNK)
        .withColumn("row_number", F.explode(F.sequence("begin", F.least(F.col("begin") + _CHUNK, F.col("first") + F.col("copies")) - 1)))
    )

    @F.pandas_udf(T.LongType())
    def position(rows):
        import pandas as pd

        return pd.Series(permute(rows.to_numpy(), n, seed))

    return numbered.select("doc_id", "size", "text_crc32", "row_number", position("row_number").alias("position")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.pmod("position", F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"position div {n_shards}").cast("long").alias("slot"),
        "row_number",
    )
