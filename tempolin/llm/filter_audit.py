"""Filter interaction audit: what each of five filters removes, in every order of them.

The filters fail a document

* A with under 100 words,
* B with fewer than 80 different words in 100,
* C with more than 10 capitals A-Z in 100 code points,
* D with any of ``#$%&*|``,
* E whose text is identical to that of a document with a smaller id, removed or not.

A to D come from one scan of the texts' Arrow buffers: byte classes are looked up in
numpy, prefix sums at the texts' ends count words, capitals, code points and symbols, and
each document's word hashes are sorted; equal neighbours are compared byte by byte, so
the numbers of different words are exact.  Memory is a small multiple of a batch, or of
one text where that is longer.

For E no text is shuffled but its 128-bit digest.  Rows are first added up by (id, digest,
masks), then, with their labels, by (digest, part, masks): a text that a third of all rows
share is one row by then, and only such rows of one digest meet for its least id.  Last,
the counts of a part by mask (at most 128 numbers) are reduced for all 120 orders.

Defined results: null text is empty, and identical to other empty texts; a null ``lang`` is
the part ``''``; a row with a null id never fails E and makes no other row fail it; repeated
ids with one text fail E only if a smaller id has it; of repeated labels of an id the largest
counts; documents without a label lose nothing by ``good_lost`` and ``toxic_lost``; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, trimmed
from .word_scan import column_bytes, hash_words, same_bytes, word_places

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
_CAPITAL, _SYMBOL, _POINT = 1, 2, 4
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[list(b"#$%&*|")] |= _SYMBOL
_CLASS[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT  # continuation bytes begin no code point
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Different words of each value; ``before`` counts the words of the values before it."""
    out = np.zeros(len(before) - 1, dtype=np.int64)
    for low in range(0, len(out), 1 << 16):  # the value's number and 48 bits of a hash make one key
        some = slice(before[low], before[min(low + (1 << 16), len(out))])
        s, e, n = starts[some], ends[some], np.diff(before[low : low + (1 << 16) + 1])
        owner = np.repeat(np.arange(len(n)), n)
        key = (owner.astype(np.uint64) << np.uint64(48)) | (hash_words(data, s, e) >> np.uint64(16))
        order = np.argsort(key)
        key = key[order]
        again = np.flatnonzero(key[1:] == key[:-1])
        a, b = order[again], order[again + 1]
        same = same_bytes(data, s[a], (e - s)[a], s[b], (e - s)[b])
        counts = n - np.bincount(owner[b], minlength=len(n))
        for doc in np.unique(owner[b[~same]]):  # two words with one hash: count the words themselves
            counts[doc] = len({data[i:j].tobytes() for i, j in zip(s[owner == doc], e[owner == doc])})
        out[low : low + len(n)] = counts
    return out


def failed(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Filters A to D that each text fails, as bits."""
    starts, ends, before = word_places(data, places)
    words, distinct = np.diff(before), distinct_words(data, starts, ends, before)
    kinds = _CLASS[data]
    capitals, symbols, points = (np.diff(np.append(0, np.cumsum(kinds & kind > 0))[places]) for kind in (_CAPITAL, _SYMBOL, _POINT))
    tests = (words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points, symbols > 0)
    return sum(t.astype(np.int32) << k for k, t in enumerate(tests))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, places = column_bytes(batch.column("body"))
        digests = [hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(places[:-1], places[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(failed(data, places), pa.int32())], names=["doc_id", "part", "digest", "mask"]
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, digest, mask) of every row; bit k of ``mask`` says that the filter k of ABCD fails it."""
    bound_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")
    )
    return rows.mapInArrow(trimmed(_scan), "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters of ABCDE that they fail, table-wide copies in bit 4."""
    rows = scan(docs, **columns).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    verdict = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias("good" if c == "quality" else c)
    no = F.lit(False)
    # rows without an id have no label, and would all wait for one in the same task
    met = rows.where("doc_id is not null").join(known, "doc_id", "left").select(*rows.columns, verdict("quality"), verdict("toxic"))
    met = met.unionByName(rows.where("doc_id is null").select("*", no.alias("good"), no.alias("toxic")))
    texts = met.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    # an id holds its text once in a group: the rows of the least id are in ``first``
    free = F.col("n_null") + F.when(F.col("least") == F.col("_least"), F.col("first.n")).otherwise(F.lit(0))
    parted = texts.withColumn("_least", least).select("part", "mask", "good", "toxic", "n", F.coalesce(free, F.lit(0)).alias("free"))
    either = F.array(F.struct(F.col("mask").alias("mask"), F.col("free").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("free")).alias("n")))
    return parted.select("part", "good", "toxic", F.inline(either)).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def reduce_masks(masks: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> list[tuple]:
    """(order, step, counts...) of every step of every order, from counts by mask."""
    rows, total = [], np.zeros(len(FILTERS), dtype=np.int64)
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            bit, alive, fails = 1 << k, masks & before == 0, masks & (1 << k) > 0
            here = alive & fails
            removed = int(n[here].sum())
            total[k] += removed
            rows.append((
                "".join(FILTERS[f] for f in order), step, int(n[alive & ~fails].sum()), removed, int(n[fails & ~alive].sum()), int(n[masks == bit].sum()), int(n[here & good].sum()), int(n[here & toxic].sum()), k,
            ))
            before |= bit
    return [(*row[:-1], int(total[row[-1]])) for row in rows]


def _reduce(table: pa.Table) -> pa.Table:
    masks, good, toxic, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "good", "toxic", "n"))
    columns = list(zip(*reduce_masks(masks, good.astype(bool), toxic.astype(bool), n)))
    part = pa.array([table.column("part")[0].as_py()] * len(columns[0]), pa.string())
    return pa.table([part, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], names=["part", "filter_order", "step", *_COUNTS])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the filters and step; see the module."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return mask_counts(docs, labels, **columns).groupBy("part").applyInArrow(_reduce, schema)
