"""Language-model scoring with an n-gram trie of Elias-Fano levels.

Tokens are words (A-Z lower-cased, runs of characters other than space and U+0009 to
U+000D), then one end for each text.  With counts c in the training texts, N tokens and
V different ones,

* level 1: p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
* level 2: p(w | v) = (c(v w) + m p(w)) / (c(v) + m), Dirichlet smoothing of strength m.

A text's first token is scored by level 1, each other one in the context of the token
before it.  Level 1 keeps, in the order of 64-bit hashes, the words with their counts.
Level 2 keeps contexts, monotone pointers to their successors, and the successors as
context-relative numbers, all as Elias-Fano sequences, with log10 p(w | v) in steps of
2^-7.  A level is cut into shards of about ``SHARD_TOKENS`` tokens, each a file in the
shared folder that is memory-mapped where it is asked.  A pair is looked up by a
successor search between its context's pointers; where it is missing, what the
context leaves over, m / (c(v) + m), times p(w) counts.

Nothing that grows with the corpus reaches the driver, is broadcast or is held by one
task.  Texts become *blocks* of bounded size, with a dictionary of their own.  Each block
sends its different words, and then its different pairs with their training counts, to the shards
that keep them, packed into one row for each shard; a shard merges counts of all blocks,
writes its level, looks all blocks' questions up in it and sends the answers back.
Repeated words and pairs are added up within a block first.  A frequent context is dealt
to several shards by its successors: smoothing needs its count alone, which blocks
know from level 1, so no shard needs to see the whole context.  Words are told apart by
their bytes, never by hashes alone.

Defined results: null text is empty and has the end token only; a null id counts as the
empty text where held-out rows are told; repeated rows each get a row and each
train; long texts are cut into several blocks; with no training text N = V = 0, every
token has p = 1 as nothing is known to be rarer; an empty table gives an empty
result; other columns are not carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, scratch_path, trimmed
from .elias_fano import encode, encode_fixed, fixed_at, map_arrays, nested, sequence, write_arrays
from .word_scan import LOWER, column_bytes, hash_words, ranges, same_bytes, word_places

PRIOR = 0.1
#: Weight of level 1 against the counts of a context: by held-out texts, where words are many and each pair is rare.
STRENGTH = 1024.0
#: log10 of a probability in these steps.
STEP = 2.0**-7
_MISSING = 0xFFFF
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Tokens of the corpus for each shard of a level.
SHARD_TOKENS = 1 << 20

_codec = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed planes of bytes, lowest first."""
    wide = np.ascontiguousarray(values, dtype="<u8")
    planes = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    data = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return struct.pack("<QB", len(wide), planes) + _codec.compress(data, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, planes = struct.unpack_from("<QB", data)
    raw = np.frombuffer(_codec.decompress(memoryview(data)[9:], n * planes, asbytes=True), dtype=np.uint8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :planes] = raw.reshape(planes, n).T
    return out.view("<u8").ravel()


def pack_bytes(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + _codec.compress(data, asbytes=True)


def unpack_bytes(data: bytes) -> bytes:
    return _codec.decompress(memoryview(data)[8:], struct.unpack_from("<Q", data)[0], asbytes=True)


def _lines(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words that each end with a line end, and where each begins and ends."""
    array = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(array == 10)
    return array, np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends, ends


def _gather(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, order: np.ndarray) -> bytes:
    """The words in an order, each with its line end."""
    return data[ranges(begins[order], ends[order] - begins[order] + 1)].tobytes()


def group_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, one place of each number); numbers ascend with the hashes, equal words share one."""
    order = np.argsort(hashes, kind="stable")
    a, b = order[:-1], order[1:]
    new = np.append(True, hashes[a] != hashes[b]) if len(order) else np.zeros(0, dtype=bool)
    again = np.flatnonzero(~new)
    a, b = order[again - 1], order[again]
    same = same_bytes(data, begins[a], (ends - begins)[a], begins[b], (ends - begins)[b])
    if not same.all():  # different words with one hash, side by side: order those by their bytes
        for h in np.unique(hashes[b[~same]]):
            at = np.flatnonzero(hashes[order] == h)
            words = [data[begins[k] : ends[k]].tobytes() for k in order[at]]
            ranked = sorted(range(len(at)), key=words.__getitem__)
            order[at] = order[at][ranked]
            new[at] = [i == 0 or words[ranked[i]] != words[ranked[i - 1]] for i in range(len(at))]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


# --- blocks -------------------------------------------------------------------------

_BLOCK = "block long, row array<long>, doc_id array<long>, held array<boolean>, n array<long>, lead boolean, words binary, tokens binary"


@dataclass
class _Piece:
    """A text, or a part of one: ``lead`` is the word before it, ``ends`` tells whether the text ends with it."""

    row: int
    doc_id: int | None
    held: bool
    text: bytes
    lead: bytes | None = None
    ends: bool = True


def _cut(piece: _Piece) -> Iterator[_Piece]:
    """Parts of a text of up to about ``BLOCK_BYTES``, cut in front of words."""
    text, at, lead = piece.text, 0, None
    while len(text) - at > BLOCK_BYTES:
        end = at + BLOCK_BYTES
        space = max(text.rfind(s, at, end) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        if space <= at:  # one word: it ends with the first space there is
            places = [p for p in (text.find(s, end) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if p >= 0]
            if not places:
                break
            space = min(places)
        part = text[at:space]
        yield _Piece(piece.row, piece.doc_id, piece.held, part, lead, False)
        words = part.rsplit(None, 1)
        lead, at = words[-1] if words else lead, space
    yield _Piece(piece.row, piece.doc_id, piece.held, text[at:], lead, True)


def _block(number: int, pieces: list[_Piece]) -> tuple:
    """A row of the table of blocks: the different words, most frequent first, and the tokens as their numbers."""
    lead = pieces[0].lead
    texts = [p.text if p.lead is None else p.lead + b" " + p.text for p in pieces]
    places = np.cumsum([0, *map(len, texts)])
    data = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    begins, ends, before = word_places(data, places)
    number_of, one = group_words(data, begins, ends, hash_words(data, begins, ends))
    # the end token is the empty word, with number 0
    ordered = np.argsort(-np.bincount(number_of, minlength=len(one)), kind="stable")
    rank = np.empty(len(one), dtype=np.int64)
    rank[ordered] = np.arange(1, len(one) + 1)
    closed = np.array([p.ends for p in pieces])
    tokens = np.insert(rank[number_of], before[1:][closed], 0)
    n = np.diff(before) + closed
    n[0] -= lead is not None
    lines = np.append(data, np.uint8(10))  # what follows a word becomes its line end
    words = one[ordered]
    out = lines[np.minimum(ranges(begins[words], ends[words] - begins[words] + 1), len(data))]
    out[np.cumsum(ends[words] - begins[words] + 1) - 1] = 10
    return (
        number, [p.row for p in pieces], [p.doc_id for p in pieces], [p.held for p in pieces], n.tolist(), lead is not None, pack_bytes(b"\n" + out.tobytes()), pack(tokens.astype(np.uint64)),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() << 36
    held: list[_Piece] = []
    size = rows = made = 0

    def out() -> pa.RecordBatch:
        nonlocal held, size, made
        columns = [[x] for x in _block(task + made, held)]
        held, size, made = [], 0, made + 1
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.bool_(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _BLOCK.split(", ")])

    for batch in batches:
        ids, hold = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
        body = batch.column("body")
        for k in range(batch.num_rows):
            for piece in _cut(_Piece(task + rows, ids[k], hold[k], body[k].as_py())):
                if held and (piece.lead is not None or not held[-1].ends or size + len(piece.text) > BLOCK_BYTES):
                    yield out()
                held.append(piece)
                size += len(piece.text)
            rows += 1
    if held:
        yield out()


def make_blocks(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as blocks, in the shared folder; ``held`` tells the rows that are scored but not learned from."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    return cut(rows.mapInArrow(trimmed(_blocks), _BLOCK), "blocks")


@dataclass
class _Read:
    """A block in memory: its words and its tokens, with the piece that each token is of."""

    words: tuple[np.ndarray, np.ndarray, np.ndarray]
    tokens: np.ndarray
    piece: np.ndarray
    learned: np.ndarray
    first: np.ndarray
    lead: bool

    @staticmethod
    def of(row: dict) -> _Read:
        n = np.array(row["n"], dtype=np.int64)
        sizes = n.copy()
        sizes[0] += row["lead"]
        piece = np.repeat(np.arange(len(n)), sizes)
        learned = ~np.array(row["held"], dtype=bool)[piece]
        first = np.append(True, piece[1:] != piece[:-1])
        return _Read(_lines(unpack_bytes(row["words"])), unpack(row["tokens"]).astype(np.int64), piece, learned, first, row["lead"])

    @property
    def scored(self) -> np.ndarray:
        """Tokens that count here: all but a word that only leads in the next one."""
        out = np.ones(len(self.tokens), dtype=bool)
        out[0] = not self.lead
        return out

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(left and right word of each different pair, pair of each token that has a context, training counts), pairs in the order of the ids."""
        size, order = len(ids), np.argsort(ids, kind="stable")
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.arange(size)
        at = np.flatnonzero(~self.first)
        key, inverse = np.unique(rank[self.tokens[at - 1]] * size + rank[self.tokens[at]], return_inverse=True)
        return order[key // size], order[key % size], inverse, np.bincount(inverse[self.learned[at]], minlength=len(key))


# --- the shards ----------------------------------------------------------------------


@dataclass(frozen=True)
class LanguageModel:
    """Levels in ``path``: counts of training tokens and of different ones, the number of shards, and the tokens for each."""

    path: str
    n_shards: int
    n_tokens: int
    n_types: int
    strength: float
    shard_tokens: int

    def log_unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + PRIOR) - np.log10(self.n_tokens + PRIOR * (self.n_types + 1)) if self.n_tokens else np.zeros(len(count))

    def log_left(self, context: np.ndarray) -> np.ndarray:
        return np.log10(self.strength / (context + self.strength))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


_ASKED = "shard int, block long, a binary, b binary, c binary, d binary, e binary"
_TOLD = "block long, kind int, shard int, a binary, b binary, n_tokens long, n_types long"


def _shard_of_words(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return (_mixed(hashes) % np.uint64(n_shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) for an order that goes by shard."""
    begins = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]))
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b > a:
            yield int(shard[order[a]]), order[a:b]


def _ask_words(n_shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Read.of(row)
                data, begins, ends = block.words
                counts = np.bincount(block.tokens[block.learned & block.scored], minlength=len(begins))
                hashes = hash_words(data, begins, ends)
                shard = _shard_of_words(hashes, n_shards)
                out = [
                    (s, row["block"], pack_bytes(_gather(data, begins, ends, at)), pack(counts[at].astype(np.uint64)))
                    for s, at in _by_shard(shard, np.lexsort((hashes, shard)))
                ]
                yield _batch([*zip(*out), [None] * len(out), [None] * len(out), [None] * len(out)], _ASKED)

    return ask


def _batch(columns, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _level_path(path: str, level: int, shard: int) -> str:
    return f"{path}/level-{level}/{shard:07d}"


def _joined(parts: list[bytes]) -> tuple[bytes, list[int]]:
    sizes = [p.count(b"\n") for p in parts]
    return b"".join(parts), sizes


def build_words(path: str, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
    """Write a shard of level 1: words in the order of their hashes, and their counts."""
    hashes = hash_words(data, begins, ends)
    number, one = group_words(data, begins, ends, hashes)
    total = np.zeros(len(one), dtype=np.int64)
    np.add.at(total, number, counts)
    text = _gather(data, begins, ends, one)
    stops = np.cumsum(ends[one] - begins[one] + 1)
    write_arrays(path, {**nested("hash", encode(hashes[one])), **nested("stop", encode(stops.astype(np.uint64))), "text": np.frombuffer(text, dtype=np.uint8), "count": total})


def find_words(level: dict[str, np.ndarray], data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in the shard or -1, training count) of each word; words that share a hash are told apart by their bytes."""
    stored, stops, text, counts = sequence(level, "hash"), sequence(level, "stop"), level["text"], level["count"]
    hashes = hash_words(data, begins, ends)
    order = np.argsort(hashes, kind="stable")
    out = np.full(len(order), -1, dtype=np.int64)
    at, value = stored.successor(hashes[order])
    open_ = np.flatnonzero((at < len(stored)) & (value == hashes[order]))
    both = np.concatenate([data, text])  # the words of the question and of the level, to be compared
    while len(open_):
        k, word = at[open_], order[open_]
        stop = stops.at(k).astype(np.int64) - 1
        start = np.where(k > 0, stops.at(np.maximum(k - 1, 0)).astype(np.int64), 0)
        same = same_bytes(both, begins[word], (ends - begins)[word], start + len(data), stop - start)
        out[word[same]] = k[same]
        at[open_] += 1
        open_ = open_[~same & (at[open_] < len(stored))]
        if len(open_):
            open_ = open_[stored.at(at[open_]) == hashes[order[open_]]]
    return out, np.where(out >= 0, counts[np.maximum(out, 0)] if len(counts) else 0, 0)


def _words_of_shard(path: str, learn: bool):
    def serve(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        text, sizes = _joined([unpack_bytes(x) for x in table.column("a").to_pylist()])
        data, begins, ends = _lines(text)
        file = _level_path(path, 1, shard)
        if learn:
            build_words(file, data, begins, ends, np.concatenate([unpack(x) for x in table.column("b").to_pylist()]).astype(np.int64))
        level = map_arrays(file)
        number, count = find_words(level, data, begins, ends) if level else (np.full(len(begins), -1), np.zeros(len(begins), dtype=np.int64))
        # one row a block with numbers (from 1; 0 is unknown) and counts, and one with the sums of the level
        at = np.concatenate(([0], np.cumsum(sizes)))
        rows = [(b, 1, shard, pack((number[i:j] + 1).astype(np.uint64)), pack(count[i:j].astype(np.uint64)), None, None) for b, i, j in zip(blocks, at[:-1], at[1:])]
        if level:
            rows.append((-1, 0, shard, None, None, int(level["count"].sum()), int((level["count"] > 0).sum())))
        return pa.Table.from_batches([_batch(list(zip(*rows)), _TOLD)])

    return serve


def _known(block: _Read, told: dict[int, tuple], n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, training count) of each word of a block from the answers of level 1; id 0 is unknown."""
    data, begins, ends = block.words
    hashes = hash_words(data, begins, ends)
    shard = _shard_of_words(hashes, n_shards)
    ids, counts = np.zeros(len(begins), dtype=np.uint64), np.zeros(len(begins), dtype=np.int64)
    for s, at in _by_shard(shard, np.lexsort((hashes, shard))):
        number, count = (unpack(x) for x in told[s])
        ids[at] = np.where(number > 0, (np.uint64(s) << np.uint64(32)) | number, np.uint64(0))
        counts[at] = count
    return ids, counts


def _pair_order(ids: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of each pair, pairs by shard, whether their context is dealt out); pairs with an unknown word are asked nowhere."""
    # a context of many tokens is dealt out by its successors
    spread = (1 + counts[left] // model.shard_tokens).astype(np.uint64)
    place = _mixed(ids[left]) + (_mixed(ids[right]) % spread) * np.uint64(0x9E3779B97F4A7C15)
    shard = (_mixed(place) % np.uint64(model.n_shards)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16 if model.n_shards < 1 << 16 else np.int64), kind="stable")
    return shard, order[(ids[left[order]] > 0) & (ids[right[order]] > 0)], spread > 1


def _told(table: pa.Table, kind: int) -> dict[int, tuple]:
    at = table.column("kind").to_pylist()
    return {s: (a, b) for k, s, a, b in zip(at, *(table.column(c).to_pylist() for c in ("shard", "a", "b"))) if k == kind}


def _ask_pairs(model: LanguageModel):
    def ask(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.Table.from_batches([_batch([[]] * 7, _ASKED)])
        (row,) = blocks.to_pylist()
        block = _Read.of(row)
        ids, counts = _known(block, _told(answers, 1), model.n_shards)
        left, right, _, learned = block.pairs(ids)
        shard, order, dealt = _pair_order(ids, counts, left, right, model)
        out = []
        for s, at in _by_shard(shard, order):
            begins = np.flatnonzero(np.append(True, left[at][1:] != left[at][:-1]))
            contexts = left[at][begins]
            # a shard that sees a whole context counts it itself
            of_left = np.where(dealt[at][begins], counts[contexts], 0)
            out.append((
                s, row["block"], pack(np.diff(ids[contexts], prepend=np.uint64(0))), pack(np.diff(np.append(begins, len(at))).astype(np.uint64)), pack(of_left.astype(np.uint64)),
                pack(ids[right[at]]), pack(np.concatenate([learned[at], counts[right[at]]]).astype(np.uint64)),
            ))
        return pa.Table.from_batches([_batch(list(zip(*out)) or [[]] * 7, _ASKED)])

    return ask


def build_pairs(path: str, left: np.ndarray, right: np.ndarray, counts: np.ndarray, of_left: np.ndarray, of_right: np.ndarray, model: LanguageModel) -> None:
    """Write a shard of level 2 from partial counts of pairs and the counts of their words; a context's count is 0 where it is the sum of its pairs'."""
    some = counts > 0
    left, right, counts, of_left, of_right = (x[some] for x in (left, right, counts, of_left, of_right))
    contexts, l = np.unique(left, return_inverse=True)
    words, r = np.unique(right, return_inverse=True)
    key, one, inverse = np.unique(l * max(len(words), 1) + r, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(key))
    lower = 10.0 ** model.log_unigram(of_right[one])
    context = np.maximum(np.bincount(l[one], weights=total, minlength=len(contexts)), np.bincount(l[one], weights=of_left[one], minlength=len(contexts)) / np.maximum(np.bincount(l[one], minlength=len(contexts)), 1))
    log = np.log10((total + model.strength * lower) / (context[l[one]] + model.strength))
    pointers = np.searchsorted(l[one], np.arange(len(contexts) + 1)).astype(np.uint64)
    write_arrays(path, {
        **nested("context", encode(contexts)), **nested("word", encode(words)), **nested("pointer", encode(pointers)), **nested("successor", encode(key.astype(np.uint64))),
        **nested("code", encode_fixed(np.minimum(np.rint(-log / STEP), _MISSING - 1).astype(np.uint64))),
    })


def find_pairs(level: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The code of each pair, given in any order, or ``_MISSING``."""
    contexts, words, pointers, successors = (sequence(level, k) for k in ("context", "word", "pointer", "successor"))
    out = np.full(len(left), _MISSING, dtype=np.uint16)

    def places(in_: object, values: np.ndarray) -> np.ndarray:
        asked, back = np.unique(values, return_inverse=True)
        at, value = in_.successor(asked)
        return np.where((at < len(in_)) & (value == asked), at, -1)[back]

    node, word = places(contexts, left), places(words, right)
    known = np.flatnonzero((node >= 0) & (word >= 0))
    # successors of a context: its number times the words, plus the word's, between its pointers
    target = node[known] * len(words) + word[known]
    order = np.argsort(target, kind="stable")
    known, target = known[order], target[order]
    at, value = successors.successor(target.astype(np.uint64))
    begin, end = pointers.at(node[known]), pointers.at(node[known] + 1)
    hit = (at >= begin) & (at < end) & (value == target)
    out[known[hit]] = fixed_at(level, "code", at[hit])
    return out


def _pairs_of_shard(model: LanguageModel, learn: bool):
    def serve(table: pa.Table) -> pa.Table:
        shard, blocks = table.column("shard")[0].as_py(), table.column("block").to_pylist()
        read = [[unpack(x) for x in table.column(c).to_pylist()] for c in "abcde"]
        sizes = [int(n.sum()) for n in read[1]]
        repeats = np.concatenate(read[1]).astype(np.int64)
        left = np.repeat(np.concatenate([np.cumsum(x) for x in read[0]]), repeats)
        of_left = np.repeat(np.concatenate(read[2]), repeats)
        right = np.concatenate(read[3])
        file = _level_path(model.path, 2, shard)
        if learn:
            counts, of_right = (np.concatenate([x[n * k : n * (k + 1)] for x, n in zip(read[4], sizes)]).astype(np.int64) for k in (0, 1))
            build_pairs(file, left, right, counts, of_left.astype(np.int64), of_right, model)
        level = map_arrays(file)
        code = find_pairs(level, left, right) if level else np.full(len(left), _MISSING, dtype=np.uint16)
        at = np.concatenate(([0], np.cumsum(sizes)))
        rows = [(b, 2, shard, pack(code[i:j].astype(np.uint64)), None, None, None) for b, i, j in zip(blocks, at[:-1], at[1:])]
        return pa.Table.from_batches([_batch(list(zip(*rows)), _TOLD)])

    return serve


_SCORED = "row long, doc_id long, held boolean, n_tokens long, n_known long, base double, score double"


def _score_block(model: LanguageModel):
    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.Table.from_batches([_batch([[]] * 7, _SCORED)])
        (row,) = blocks.to_pylist()
        block = _Read.of(row)
        ids, counts = _known(block, _told(answers, 1), model.n_shards)
        left, right, inverse, _ = block.pairs(ids)
        shard, order, _ = _pair_order(ids, counts, left, right, model)
        code, told = np.full(len(left), _MISSING, dtype=np.int64), _told(answers, 2)
        for s, at in _by_shard(shard, order):
            code[at] = unpack(told[s][0]).astype(np.int64)
        base = model.log_unigram(counts)
        log = np.where(code == _MISSING, model.log_left(counts[left]) + base[right], -code * STEP)
        per_token = base[block.tokens]
        per_token[~block.first] = log[inverse]
        scored, n = block.scored, len(row["n"])
        add = lambda values: np.bincount(block.piece[scored], weights=values[scored], minlength=n)
        known = np.bincount(block.piece[scored & (counts > 0)[block.tokens]], minlength=n)
        return pa.Table.from_batches([_batch([row["row"], row["doc_id"], row["held"], row["n"], known, add(base[block.tokens]), add(per_token)], _SCORED)])

    return score


def _asked_of(blocks: DataFrame, answers: DataFrame, body, schema: str) -> DataFrame:
    theirs = answers.where("block >= 0").select(F.col("block").alias("block_"), "kind", "shard", "a", "b")
    return blocks.groupBy("block").cogroup(theirs.groupBy("block_")).applyInArrow(body, schema)


def _through(blocks: DataFrame, path: str, n_shards: int, learn: bool) -> DataFrame:
    """Answers of level 1 to all blocks, in the shared folder."""
    asked = blocks.mapInArrow(trimmed(_ask_words(n_shards)), _ASKED)
    return cut(asked.groupBy("shard").applyInArrow(_words_of_shard(path, learn), _TOLD), "word-answers")


def _scores(blocks: DataFrame, words: DataFrame, model: LanguageModel, learn: bool) -> DataFrame:
    pairs = _asked_of(blocks, words, _ask_pairs(model), _ASKED).groupBy("shard").applyInArrow(_pairs_of_shard(model, learn), _TOLD)
    scored = _asked_of(blocks, words.unionByName(pairs), _score_block(model), _SCORED)
    # the parts of a text that was cut come together
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return whole.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the model does not learn from: one in ten, by the CRC-32 of the id as text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def learn_and_score(
    docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH, shard_tokens: int = SHARD_TOKENS
) -> tuple[LanguageModel, DataFrame]:
    """A model of the rows that are not ``held``, and the scores of all rows under it.

    Counting and asking share one exchange each level: a block's pairs are both what it adds
    to the counts and what it wants to know.
    """
    blocks = make_blocks(docs, held, id_col, text_col)
    tokens = blocks.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()[0]
    path, n_shards = scratch_path(docs.sparkSession, "language-model"), -(-tokens // shard_tokens) or 1
    words = _through(blocks, path, n_shards, True)
    n_tokens, n_types = words.where("block < 0").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    model = LanguageModel(path, n_shards, n_tokens, n_types, strength, shard_tokens)
    return model, _scores(blocks, words, model, True)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of other rows under a model that was learned before, once its scores have been computed."""
    blocks = make_blocks(docs, F.lit(True), id_col, text_col)
    return _scores(blocks, _through(blocks, model.path, model.n_shards, False), model, False)
