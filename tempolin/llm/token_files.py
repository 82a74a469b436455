"""Token ids in files of fixed-width packed bits.

A file holds documents in ascending order.  Every id takes the fewest bits that the
vocabulary needs, packed without gaps inside a block of ``BLOCK_IDS`` ids.  Each block
starts at a byte, and an index at the end has the block offsets and the documents'
first ids, so that numpy unpacks any range of ids from the blocks that hold it.

Layout, little-endian: ``TPK1``, u32 width, then blocks; then the index: u64 block
offsets (one more than blocks), u64 first ids of documents (one more than documents),
i64 document ids, u8 flags (1: the document has an id); at last u64 numbers of blocks,
documents and ids, and u64 place of the index.

Writers run where the sorted rows are.  A task writes a file under a name of its own
and reports it; only reported files are in the manifest, so a lost or repeated task
leaves at most a file that nothing refers to.

Defined results: null text counts as empty; null ids come first; rows with one id are
ordered by the checksum and then by the bytes of their text; an empty table has no
files; other columns are not carried.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, open_fs, scratch_path, trimmed

MAGIC = b"TPK1"
BLOCK_IDS = 4096


def width_for(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 to vocabulary - 1."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` as consecutive fields of ``width`` bits, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` fields of ``width`` bits as unsigned 32-bit integers."""
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: count * width].reshape(count, width)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file block by block; holds one block of ids and the index."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.blocks, self.firsts, self.docs, self.flags = [8], [0], [], bytearray()
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = 0
        out.write(MAGIC + struct.pack("<I", width))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.flags.append(doc_id is not None)
        self.total += len(ids)
        self.firsts.append(self.total)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            self._flush(BLOCK_IDS)

    def _flush(self, least: int) -> None:
        ids, at = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32), 0
        while len(ids) - at >= least and at < len(ids):
            data = pack(ids[at : at + BLOCK_IDS], self.width)
            self.out.write(data)
            self.blocks.append(self.blocks[-1] + len(data))
            at += BLOCK_IDS
        self.rest = [ids[at:]]
        self.waiting = max(0, len(ids) - at)

    def close(self) -> None:
        self._flush(1)
        place = self.blocks[-1]
        for values, kind in ((self.blocks, "<u8"), (self.firsts, "<u8"), (self.docs, "<i8")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(bytes(self.flags))
        self.out.write(struct.pack("<QQQQ", len(self.blocks) - 1, len(self.docs), self.total, place))


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_blocks, n_docs, self.total, place = struct.unpack("<QQQQ", self._at(size - 32, 32))
        magic, self.width = struct.unpack("<4sI", self._at(0, 8))
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        index, at = self._at(place, size - 32 - place), 0
        out = []
        for count, kind in ((n_blocks + 1, "<u8"), (n_docs + 1, "<u8"), (n_docs, "<i8"), (n_docs, "u1")):
            out.append(np.frombuffer(index, dtype=kind, count=count, offset=at))
            at += out[-1].nbytes
        self.blocks, self.firsts, self.docs, self.flags = out

    def _at(self, place: int, count: int) -> bytes:
        self.source.seek(place)
        return self.source.read(count)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at the positions start to end of the file, from the blocks that hold them."""
        if start >= end:
            return np.empty(0, dtype="<u4")
        first, last = start // BLOCK_IDS, (end - 1) // BLOCK_IDS
        data = self._at(int(self.blocks[first]), int(self.blocks[last + 1] - self.blocks[first]))
        parts = []
        for block in range(first, last + 1):
            begin = int(self.blocks[block] - self.blocks[first])
            count = min(BLOCK_IDS, self.total - block * BLOCK_IDS)
            parts.append(unpack(data[begin : begin + int(self.blocks[block + 1] - self.blocks[block])], self.width, count))
        return np.concatenate(parts)[start - first * BLOCK_IDS : end - first * BLOCK_IDS]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.firsts[number]), int(self.firsts[number + 1]))

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, ids) in order; reads some blocks at a time."""
        number = 0
        while number < len(self.docs):
            end = max(number + 1, int(np.searchsorted(self.firsts, int(self.firsts[number]) + 64 * BLOCK_IDS, "right")) - 1)
            low = int(self.firsts[number])
            chunk = self.ids(low, int(self.firsts[end]))
            for k in range(number, end):
                yield (int(self.docs[k]) if self.flags[k] else None), chunk[int(self.firsts[k]) - low : int(self.firsts[k + 1]) - low]
            number = end


class WordEncoder:
    """Ids of whole texts as the library gives them, with words that recur encoded once a worker.

    A tokenizer whose steps are known (see :func:`splits_at_space`) gives the words between
    spaces their own ids, and a stop, comma or the like after a plain letter or digit
    begins a token of its own; so texts are cut there and the pieces' ids joined.  Pieces
    that were not met yet go through the library together, those of letters only as one
    text, cut again after each token that ends a word.  Pieces of Latin-1 characters are
    lower-cased, which nothing composes with; others stay as they are, since the library
    composes characters before it lower-cases them.  Added tokens are matched as they are
    written: a text that holds one, in any case, goes whole.  Other tokenizers get every
    text whole.
    """

    _MARK = re.compile("[.,;:!?](?<=[A-Za-z0-9\xe0-\xf6\xf8-\xff].)")
    _BEYOND_LATIN = re.compile("[^\x00-\xff]")
    _PLAIN = re.compile("[a-z\xe0-\xf6\xf8-\xff]+")
    CACHED = 300_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=0) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.by_word = splits_at_space(self.tokenizer)
        self.ends = np.zeros(self.size, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = sorted({form for a in added for form in (a, a.lower())})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self._whole(texts)
        whole = [k for k, t in enumerate(texts) if self._holds_added(t)]
        if whole:
            out = dict(zip(whole, self._whole([texts[k] for k in whole])))
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in out]))
            return [out[k] if k in out else next(rest) for k in range(len(texts))]
        pieces = [self._pieces(t) for t in texts]
        every = set().union(*pieces)
        fresh = every.difference(self.known)
        known = self.known
        if fresh:
            encoded = self._encode_pieces(sorted(fresh))
            if len(known) < self.CACHED:
                known.update(encoded)
            else:  # full: what recurs was met early
                known = {w: known[w] for w in every.difference(fresh)} | encoded
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), dtype=self.kind) for p in pieces]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _holds_added(self, text: str) -> bool:
        lower = text.lower()
        return any(a in lower or a in text for a in self.added)

    def _pieces(self, text: str) -> list[str]:
        beyond = self._BEYOND_LATIN.search
        latin = beyond(text) is None
        pieces = self._MARK.sub(r" \g<0>", (text.lower() if latin else text).replace("\n", " ")).split(" ")
        return pieces if latin else [p if beyond(p) else p.lower() for p in pieces]

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        plain = [p for p in pieces if self._PLAIN.fullmatch(p)]
        ids = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, dtype=self.kind)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
        if len(cuts) != len(plain):  # a tokenizer that marks no ends of words
            plain, cuts = [], []
        data, out, begin = ids.tobytes(), {}, 0
        for piece, end in zip(plain, cuts):
            out[piece] = data[begin:end]
            begin = end
        rest = [p for p in pieces if p not in out]
        for piece, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            out[piece] = np.array(e.ids, dtype=self.kind).tobytes()
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker, with the words that it met."""
    return WordEncoder(path)


# The steps for which texts may be cut at spaces, and at stops after a plain
# letter or digit: characters are composed, white space made one space, all lower-cased,
# and tokens are certain endings, runs of letters, single digits, or runs of anything else.
_NORMAL_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_TOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_space(tokenizer) -> bool:
    """Whether a tokenizer's steps are those that are known, and its added tokens stand for themselves only."""
    import json

    settings = json.loads(tokenizer.to_str())
    normal = (settings["normalizer"] or {}).get("normalizers")
    steps = (settings["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    splits = {"type": "Split", "pattern": {"Regex": _TOKEN_PATTERN}, "behavior": "Removed", "invert": True}
    bytes_only = [s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in steps[1:]]
    plain = [not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"[\s.,;:!?]", t["content"]) for t in settings["added_tokens"]]
    return normal == _NORMAL_STEPS and steps[0] == splits and all(bytes_only) and all(plain) and not settings["truncation"] and not settings["padding"]


def _write_part(path: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = open_fs(path)
        name, writer, out, part = f"{uuid.uuid4().hex}.tpk", None, None, None
        encoder = word_encoder(tokenizer_path)
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            if writer is None:
                out, part = filesystem.open_output_stream(f"{folder}/{name}"), batch.column(0)[0].as_py()
                writer = Writer(out, width_for(max(encoder.size, end_id + 1)))
            for doc_id, ids in zip(batch.column(1).to_pylist(), encoder.encode(batch.column(2).to_pylist())):
                writer.add(doc_id, np.append(ids.astype(np.uint32), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.total]}, schema=_MANIFEST_ARROW)

    return write


_MANIFEST = "part int, file string, n_docs long, n_ids long"
_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs``, write packed files under ``path``; return the manifest of files in order.

    Rows are dealt to ranges of (id, checksum) so that one id with many rows is spread,
    sorted, and encoded where they are written: ids never cross a shuffle.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    filesystem, folder = open_fs(path)
    filesystem.create_dir(folder, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    key = [F.col("doc_id").asc_nulls_first(), F.crc32("content").asc()]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, F.col("content").asc())
    numbered = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "content")
    return cut(numbered.mapInArrow(trimmed(_write_part(path, tokenizer_path, end_id)), _MANIFEST), "token-manifest")


def _read_part(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = open_fs(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with filesystem.open_input_file(f"{folder}/{name}") as source:
                    out: list[tuple] = []
                    for doc_id, ids in Reader(source):
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _digests(out)
                            out = []
                    yield _digests(out)

    return read


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Read the files back: doc_id, global start, n_tokens and ids_crc32 of each document.

    The manifest has one row a file (as many as shuffle partitions); a running sum over
    it gives each file's first position.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = manifest.select("file", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("start"), "n_docs")
    files = placed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return files.select("file", "start").mapInArrow(trimmed(_read_part(path)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    return read_token_files(spark, write_token_files(docs, path, tokenizer_path, end_id), path)
