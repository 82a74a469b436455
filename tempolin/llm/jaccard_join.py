"""N-gram Jaccard join with signature trees, and its components.

Documents become sets of 64-bit hashes of word shingles; equal sets are one class, named
by 128 bits of its hashes.  Two classes link when 100 * intersection >= threshold * union.

Which classes can meet: both ways give sets which link a key in common, so neither
loses a link.  Above ``PARTS_ABOVE`` percent hash space is cut into so many parts that
the two must agree on a whole part (they differ in at most D elements, and there are
more than D parts; parts with few elements are left out where enough others remain);
sizes are in classes of the ratio of the threshold, so that sets which link share one.
Below, parts would be too small to tell sets apart, and keys are the prefix of each set
in one order of all shingles, rare ones first; the order comes from a sketch of counts
over all documents, whose size follows the number of shingles up to a bound.  Any order is
exact.  Beyond the bound several shingles share a counter and counters are rounded, but
they never stop, so shingles that are common still come last.  Parts in common join
classes to the least one there.  Prefixes are so long that sets which link share ``SHARED``
keys: pairs are counted over keys of few classes, and a key of more than ``PAIRED``
joins all to the least one; so a single shingle in common, which a crowded sketch lets through
in very many texts, does not chain them up.  The connected components of all that are the
groups that can hold links at all.

Within a group, signature trees: sets sorted by size and signature form leaves, nodes
hold OR-combined bitmaps of tokens and the range of sizes, and a traversal of two trees
goes down only in pairs of nodes whose maximum possible overlap reaches what their
sizes demand.  What remains is compared exactly.  Nodes whose sets are all in one
component need no comparing among themselves, so thousands of near copies cost about as
many comparisons as sets.  A group above ``BLOCK_SHINGLES`` is cut into blocks and all
pairs of its blocks are traversed, each in a task of known size.

Names have 128 bits: among N classes two agree by chance with probability N * N / 2 ** 129.
A text is fetched by a 64-bit hash and taken only if its set has the name asked for.

Defined results: texts without words are empty sets, linked with nothing, and their
component is their own id; texts of fewer words than a shingle are one shingle; rows
with null ids take part, but a component's id is its least id that is not null; rows
that share an id are separate rows; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, spread_join, trimmed
from .graph import components

#: Shingles of the sets in one block: about 32 MB.
BLOCK_SHINGLES = 4_000_000
#: Thresholds (percent) from which keys are parts; a part then has about five shingles or more.
PARTS_ABOVE = 88
#: Bits of the sketch's index: counters of two bits up to 32 MB, beyond that rounded ones of a byte in 64 MB.
PACKED_BITS, SKETCH_BITS = 27, 26
#: Keys of prefixes that two sets which link have in common at least.
SHARED = 3
#: Classes that a key has at most for its pairs to be counted; those of one that has more are all joined.
PAIRED = 32
_CHUNK = 1 << 16
#: Buckets of hashes in the coarse filter of texts, each with 64 parts: a broadcast of at most 8 MB of numbers.
BUCKETS = 1 << 19
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FANOUT = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles of ``size`` words."""
    from xxhash import xxh3_64_intdigest

    words = text.translate(_LOWER).split()  # bytes.split() parts at 0x20 and 0x09 to 0x0D
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = hashes[:n] + np.uint64(width)
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return np.unique(_mix(out))


def node_of(hashes: np.ndarray) -> bytes:
    """Name of a set: 16 bytes."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


@lru_cache(maxsize=None)
def _bounds(threshold: int) -> list[int]:
    """Least sizes of the size classes: a set and one that links with it are in the same or in adjacent ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // threshold + 1))
    return out


@lru_cache(maxsize=None)
def _scheme(threshold: int, label: int) -> tuple[int, int, int]:
    """(parts, most differing elements, least elements of a usable part) for a size class and the one below it."""
    largest = _bounds(threshold)[label + 1] - 1
    differ = 2 * largest * (100 - threshold) // (100 + threshold)
    parts = differ + differ * 3 // 20 + 4
    mean, least, chance, below = 0.85 * largest / parts, 1, exp(-0.85 * largest / parts), 0.0
    while least < 5:  # a larger least leaves out more parts; they must stay few beside the spare ones
        below += chance
        if (below + chance * mean / least) * parts > 0.6 * (parts - differ):
            break
        chance *= mean / least
        least += 1
    return parts, differ, least


def part_keys(hashes: np.ndarray, threshold: int) -> np.ndarray:
    """Keys of a set; two different sets that link have one in common."""
    label = int(np.searchsorted(_bounds(threshold), len(hashes), side="right")) - 1
    out = []
    for at in (label, label + 1):
        parts, differ, least = _scheme(threshold, at)
        part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(hashes)])))
        sums = np.add.reduceat(_mix(hashes + np.uint64(at)), starts)
        keys = _mix(sums + _mix((part[starts] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at << 8)))
        usable = sizes >= least
        if parts - int(usable.sum()) < parts - differ:
            out.append(keys[usable])
        else:
            out.append(keys)
            if parts - len(starts) >= parts - differ:  # it may agree with another in empty parts alone
                out.append(_mix(np.array([at + (1 << 50)], np.uint64)))
    return np.concatenate(out)


class Sketch:
    """Counts of shingles in ``2 ** bits`` counters: of two bits (up to 3), or of 16 while one
    task counts and, as :func:`rounded` bytes, where the counts of all tasks are added up."""

    def __init__(self, bits: int, packed: bool, data: np.ndarray | None = None):
        self.bits, self.packed = bits, packed
        if data is None:
            data = np.zeros((1 << bits) // 4, np.uint8) if packed else np.zeros(1 << bits, np.uint16)
        self.data = data

    @classmethod
    def plan(cls, total: int) -> tuple[int, bool]:
        """Size for ``total`` shingles: two bits for each while that is within bounds, else bytes."""
        bits = max(max(total, 1).bit_length(), 16)
        return (min(bits, PACKED_BITS), True) if bits <= PACKED_BITS + 1 else (SKETCH_BITS, False)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        """Count the shingles of one set; those that share a counter count once."""
        place = self.place(hashes)
        if not self.packed:
            now = self.data[place]
            self.data[place] = now + (now < 65_535)
            return
        for k in range(4):  # the counters of a byte one after the other, so that no update is lost
            at, shift = place[(place & 3) == k] >> 2, np.uint8(2 * k)
            now = self.data[at]
            self.data[at] = now + (((now >> shift) & np.uint8(3)) < 3).astype(np.uint8) * np.uint8(1 << (2 * k))

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        place = self.place(hashes)
        if not self.packed:
            return self.data[place]
        return (self.data[place >> 2] >> ((place & 3) * 2).astype(np.uint8)) & np.uint8(3)


def rounded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: exact up to 15, then three bits after the highest one, up to 15 * 2 ** 30."""
    counts = np.minimum(counts.astype(np.uint64), np.uint64(15 << 30))
    up = np.maximum(np.frexp(counts.astype(np.float64))[1] - 4, 0).astype(np.uint64)
    return np.where(up == 0, counts, (up << np.uint64(3)) + (counts >> up)).astype(np.uint8)


def unrounded(codes: np.ndarray) -> np.ndarray:
    """The least count of each byte of :func:`rounded`."""
    up = np.maximum(codes >> 3, 1).astype(np.uint64) - np.uint64(1)
    return np.where(codes < 16, codes, (codes & 7) | 8).astype(np.uint64) << up


def _added(a: np.ndarray, b: np.ndarray, packed: bool) -> np.ndarray:
    """Sums of counters; those of two bits stop at 3."""
    if not packed:
        return a.astype(np.uint64) + b.astype(np.uint64)
    out = np.zeros_like(a)
    for shift in (0, 2, 4, 6):
        out |= np.minimum(((a >> shift) & 3) + ((b >> shift) & 3), 3).astype(np.uint8) << np.uint8(shift)
    return out


def _small(threshold: int) -> int:
    """Most elements of a set that links with one of which fewer than ``SHARED`` need be shared."""
    return (SHARED - 1) * 100 // threshold * 100 // threshold


def prefix_keys(hashes: np.ndarray, threshold: int, sketch: Sketch) -> np.ndarray:
    """The rarest shingles of a set, by a sketch; two sets that link have ``SHARED`` keys in common.

    Of what they share, the first ones in the order are in the prefixes of both.  Sets too small
    to share so many shingles have each of theirs as so many keys, and so do all that can link with them.
    """
    length = len(hashes) - (-(-threshold * len(hashes) // 100)) + SHARED
    keys = hashes[np.lexsort((hashes, sketch.counts(hashes)))[:length]]
    if len(hashes) > _small(threshold):
        return keys
    return np.concatenate([keys, *[_mix(keys + np.uint64(k)) for k in range(1, SHARED)]])


def _sketched(size: int, bits: int, packed: bool):
    """Counts of a task's shingles, in chunks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(bits, packed)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                sketch.add(shingle_set(text or b"", size))
        for chunk in range(0, len(sketch.data), _CHUNK):
            part = sketch.data[chunk : chunk + _CHUNK]
            if part.any():
                part = part if packed else rounded(part)
                yield pa.RecordBatch.from_arrays([pa.array([chunk // _CHUNK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    return make


def _merge_sketch(packed: bool):
    def merge(table: pa.Table) -> pa.Table:
        total = None
        for data in table.column("counts"):
            part = np.frombuffer(zlib.decompress(data.as_py()), np.uint8)
            part = part if packed else unrounded(part)
            total = part if total is None else _added(total, part, packed)
        total = total if packed else rounded(total)
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    return merge


def rarity_sketch(body: DataFrame, shingle: int, total: int) -> Sketch:
    """How often shingles occur, about, over all rows of ``body``.

    Tasks count on their own; chunks of their counters are added up where they meet.  What
    reaches the driver is one array of at most 64 MB.
    """
    bits, packed = Sketch.plan(total)
    chunks = body.mapInArrow(trimmed(_sketched(shingle, bits, packed)), "chunk int, counts binary").groupBy("chunk").applyInArrow(_merge_sketch(packed), "chunk int, counts binary")
    sketch = Sketch(bits, packed, np.zeros((1 << bits) // (4 if packed else 1), np.uint8))
    for row in chunks.toLocalIterator():
        sketch.data[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["counts"], np.uint8)
    return sketch


def _nodes(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts = [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text or b"", size)
                counts.append(len(hashes))
                nodes.append(node_of(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64())], names=["doc_id", "text_hash", "node", "n_shingles"]
            )

    return make


def _keys(size: int, threshold: int, sketch=None):
    """``sketch`` is the broadcast :class:`Sketch`, or None for parts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, nodes, held = [], [], 0
            for text in batch.column(0).to_pylist():
                hashes = shingle_set(text or b"", size)
                if not len(hashes) or (node := node_of(hashes)) in seen:
                    continue
                seen.add(node)
                keys.append(part_keys(hashes, threshold) if sketch is None else prefix_keys(hashes, threshold, sketch.value))
                nodes.append((node, len(keys[-1])))
                held += len(keys[-1])
                if held > 500_000:
                    yield _key_batch(keys, nodes)
                    keys, nodes, held = [], [], 0
            if keys:
                yield _key_batch(keys, nodes)

    return make


def _key_batch(keys: list[np.ndarray], nodes: list[tuple[bytes, int]]) -> pa.RecordBatch:
    names = np.frombuffer(b"".join(n for n, _ in nodes), np.uint8).reshape(-1, 16)
    repeated = np.repeat(names, [c for _, c in nodes], axis=0)
    places = pa.py_buffer(np.arange(0, 16 * len(repeated) + 1, 16, dtype=np.int32))
    column = pa.BinaryArray.from_buffers(pa.binary(), len(repeated), [None, places, pa.py_buffer(repeated.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), column], names=["key", "node"])


def _texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave out texts that this task has passed on already, by 128 bits of their bytes."""
    from xxhash import xxh3_128_digest

    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for text in batch.column(1).to_pylist():
            name = xxh3_128_digest(text or b"")
            fresh.append(name not in seen)
            seen.add(name)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _sets(size: int):
    """The sets of the nodes asked for; a text that only shares its hash with the one meant gives none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh, sets = [], []
            blocks, nodes, names, texts = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
            for block, node, name, text in zip(blocks, nodes, names, texts):
                hashes = shingle_set(text or b"", size) if (block, node) not in seen else None
                fresh.append(hashes is not None and node_of(hashes) == name)
                if fresh[-1]:
                    seen.add((block, node))
                    sets.append(hashes.tobytes())
            kept = batch.filter(pa.array(fresh, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.array(sets, pa.binary())], names=["block", "group", "node", "hashes"])

    return make


class SignatureTree:
    """The sets of one group or of two blocks of it, and the components of their links."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.sets, self.threshold = sets, threshold
        n = len(sets)
        self.root = np.arange(n)
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = 256
        while bits < min(4 * int(sizes.max(initial=1)), 1 << 15):
            bits *= 2
        words = bits // 64
        maps = np.zeros((n, words), np.uint64)
        for row, hashes in enumerate(sets):
            place = hashes & np.uint64(bits - 1)
            np.bitwise_or.at(maps[row], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        excess = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        #: By level, from single sets up: bitmaps, least and most elements, most elements beyond the bits.
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > _FANOUT:
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(maps), _FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    def join(self) -> np.ndarray:
        """Component of each set, named by a member's number."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        for k in range(n):
            self._visit(top, np.array([k]), np.array([k]))
        for k in range(n):
            self._visit(top, np.full(n - k - 1, k), np.arange(k + 1, n))
        return self.root

    def _visit(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self._possible(level, a, b)
        if level == 0:
            for x, y in zip(a.tolist(), b.tolist()):
                if self.root[x] != self.root[y] and self._linked(x, y):
                    low, high = sorted((self.root[x], self.root[y]))
                    self.root[self.root == high] = low
            return
        below = len(self.levels[level - 1][0])
        for start in range(0, len(a), 32):
            if start:
                left, right = self._possible(level, a[start : start + 32], b[start : start + 32])
            else:
                left, right = a[:32], b[:32]
            if not len(left):
                continue
            step = np.arange(_FANOUT)
            x = np.repeat(left[:, None] * _FANOUT + step, _FANOUT, axis=1).ravel()
            y = np.tile(right[:, None] * _FANOUT + step, (1, _FANOUT)).ravel()
            inside = (x < below) & (y < below) & ((x <= y) if level > 1 else (x < y))
            x, y = x[inside], y[inside]
            own = x == y
            if own.any():
                self._visit(level - 1, x[own], y[own])
            self._visit(level - 1, x[~own], y[~own])

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that can hold a link between components."""
        if not len(a):
            return a, b
        maps, low, high, excess = self.levels[level]
        t = self.threshold
        if level:
            at = np.arange(0, len(self.root), _FANOUT**level)
            least, most = np.minimum.reduceat(self.root, at), np.maximum.reduceat(self.root, at)
            open_ = (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
        else:
            open_ = self.root[a] != self.root[b]
        open_ &= (100 * high[a] >= t * low[b]) & (100 * high[b] >= t * low[a])
        a, b = a[open_], b[open_]
        out_a, out_b = [], []
        step = max(1, (1 << 19) // maps.shape[1])
        for start in range(0, len(a), step):
            x, y = a[start : start + step], b[start : start + step]
            most = np.bitwise_count(maps[x] & maps[y]).sum(axis=1).astype(np.int64) + np.minimum(excess[x], excess[y])
            fit = (100 + t) * most >= t * (low[x] + low[y])
            out_a.append(x[fit])
            out_b.append(y[fit])
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (a, b)

    def _linked(self, x: int, y: int) -> bool:
        a, b = self.sets[x], self.sets[y]
        if len(a) > len(b):
            a, b = b, a
        place = np.searchsorted(b, a)
        place[place == len(b)] = 0
        common = int((b[place] == a).sum())
        return 100 * common >= self.threshold * (len(a) + len(b) - common)


def _join_block(threshold: int):
    def join(table: pa.Table) -> pa.Table:
        groups: dict[int, dict[int, bytes]] = {}
        for group, node, hashes in zip(*(table.column(c).to_pylist() for c in ("group", "node", "hashes"))):
            groups.setdefault(group, {})[node] = hashes
        nodes_out, roots_out = [], []
        for group in list(groups):
            members = groups.pop(group)
            sets = {node: np.frombuffer(data, np.uint64) for node, data in members.items()}
            # near copies next to each other: by size within a tenth, then by the least hash
            order = sorted(sets, key=lambda n: (len(sets[n]).bit_length(), int(sets[n][0]), len(sets[n]), n))
            root = SignatureTree([sets[n] for n in order], threshold).join()
            nodes_out += order
            roots_out += [order[r] for r in root.tolist()]
        return pa.table({"id": pa.array(nodes_out, pa.int64()), "root": pa.array(roots_out, pa.int64())})

    return join


def link_components(docs: DataFrame, shingle: int = 3, threshold: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, node and root (null for an empty set), n_shingles and component_id of every row.

    ``node`` is the name of a row's class, ``root`` the number of a class of its component.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).cast("long").alias("text_hash"), F.col(text_col).cast("binary").alias("body"))
    rows = cut(body.mapInArrow(trimmed(_nodes(shingle)), f"doc_id {dict(body.dtypes)['doc_id']}, text_hash long, node binary, n_shingles long"), "join-rows")
    # numbers are given where the classes are written, so they stay
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("text_hash").alias("text_hash"), F.max("n_shingles").alias("n"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "join-classes")
    groups = cut(components(_candidates(body, rows, classes, shingle, threshold)).select(F.col("node").alias("id"), F.col("root").alias("group")), "join-groups")
    roots = _verified(body, groups, classes, shingle, threshold)

    members = cut(roots.join(classes.select("id", "least_id"), "id"), "join-members")
    least = members.groupBy("root").agg(F.min("least_id").alias("least"))
    met = spread_join(members, least, "root", members.count()).select("id", "root", "least")
    of_node = classes.join(met, "id", "left").select("node", F.coalesce("root", "id").alias("root"), F.coalesce("least", "least_id").alias("least"))
    out = spread_join(rows, of_node, "node", rows.count(), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "text_hash", "node", "root", "n_shingles", component.alias("component_id"))


#: Pairs of classes that share ``SHARED`` keys, or one that has too many classes for pairs: each of those meets the least one.
_PAIRS = f"""
    select x, met.y as y from (
        select node as x, explode(case when n > {PAIRED} then array(named_struct('y', least, 'n', {SHARED})) else transform(others, o -> named_struct('y', o, 'n', 1)) end) as met from (
            select *, first_value(node) over (partition by key order by node rows between unbounded preceding and current row) as least,
                collect_list(node) over (partition by key order by node rows between {PAIRED - 1} preceding and 1 preceding) as others from (
                select *, count(*) over (partition by key) as n from (
                    select *, lag(node) over (partition by key order by node) as same from {{view}}) where same is null or same <> node)
            where n > 1)) where x <> met.y group by x, met.y having sum(met.n) >= {SHARED}"""


def _candidates(body: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """(a, b): numbers of classes that share a key, each joined to the least one of the key."""
    spark = body.sparkSession
    sketch = None
    if threshold < PARTS_ABOVE:
        total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
        sketch = spark.sparkContext.broadcast(rarity_sketch(body.select("body"), shingle, total))
    keys = body.select("body").mapInArrow(trimmed(_keys(shingle, threshold, sketch)), "key long, node binary")
    # sorted by key and node, the first node of a key is its least: no group is ever held
    keys.createOrReplaceTempView(view := f"keys_{abs(hash(id(keys)))}")
    if sketch is None:
        found = spark.sql(f"select node as x, first_value(node) over (partition by key order by node rows between unbounded preceding and current row) as y from {view}")
        links = found.where("x <> y").distinct()
    else:
        links = spark.sql(_PAIRS.format(view=view))
    spark.catalog.dropTempView(view)
    links = cut(links, "join-links")
    # the least one of very many classes is met by broadcast
    a, b = (classes.select(F.col("node").alias(name), F.col("id").alias(new)) for name, new in (("x", "a"), ("y", "b")))
    return spread_join(links.join(a, "x"), b, "y", links.count()).select("a", "b")


def _verified(body: DataFrame, groups: DataFrame, classes: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """(id, root) of the classes in ``groups``: components of links that hold, by signature trees."""
    spark = body.sparkSession
    placed = groups.join(classes.select("id", "node", "text_hash", "n"), "id")
    sizes = groups.join(classes.select("id", "n"), "id").groupBy("group").agg(F.sum("n").alias("total"))
    sizes = cut(sizes.select("group", "total", (F.expr(f"total div {BLOCK_SHINGLES}") + 1).alias("blocks")), "join-sizes")
    total = sizes.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // BLOCK_SHINGLES + 1)
    placed = spread_join(cut(placed, "join-placed"), sizes, "group", groups.count())
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # small groups share blocks; of a large one, each pair of its blocks is a block
    block = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(n_buckets))).otherwise(
        F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    )
    placed = cut(placed.select("text_hash", "id", "node", "group", block.alias("block"), "blocks"), "join-blocks")
    wanted = placed.select("text_hash", "id", "node", "group", "block").hint("shuffle_hash")
    near = bucketed(body.select("text_hash", "body"), "text_hash", wanted, "text_hash", "left_semi").mapInArrow(trimmed(_texts_once), "text_hash long, body binary")
    texts = near.join(wanted, "text_hash").select("block", "group", F.col("id").alias("number"), "node", "body")
    sets = texts.mapInArrow(trimmed(_sets(shingle)), "block long, group long, node long, hashes binary")
    joined = cut(sets.groupBy("block").applyInArrow(_join_block(threshold), "id long, root long"), "join-verified")
    split = placed.where("blocks > 1").select("id").distinct()
    if split.isEmpty():
        return joined
    across = components(joined.join(split, "id", "left_semi").select(F.col("id").alias("a"), F.col("root").alias("b")))
    return joined.join(split, "id", "left_anti").unionByName(across.select(F.col("node").alias("id"), "root"))


def bucketed(rows: DataFrame, key: str, others: DataFrame, other_key: str, how: str) -> DataFrame:
    """``rows`` whose key falls (``left_semi``) or doesn't fall (``left_anti``) in a bucket with a key of ``others``.

    A coarse filter without a shuffle: what is broadcast has at most ``BUCKETS`` rows,
    however many keys there are.  Each row has a bit for each of the 64 parts of its bucket,
    so a few million keys still leave nearly all parts empty.
    """
    bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(shiftrightunsigned({c}, 58) as int))")
    taken = others.select(bucket(other_key).alias("_taken"), bit(other_key).alias("_bit")).groupBy("_taken").agg(F.bit_or("_bit").alias("_bits"))
    return rows.join(F.broadcast(taken), (bucket(key) == F.col("_taken")) & (F.col("_bits").bitwiseAND(bit(key)) != 0), how)


def keep_one(docs: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the least id (then the least text hash); same columns.

    Texts without words are in no component and stay.  Only ids and hashes decide.  Rows
    in no bucket of a dropped one stay where they are; only the others are shuffled, to
    be held against the dropped ones exactly.
    """
    linked = cut(link_components(docs, shingle, threshold, id_col, text_col).select("doc_id", "text_hash", "root"), "join-linked").where("root is not null")
    first = linked.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"), F.count("*").alias("n")).where("n > 1").select("root", F.col("k.doc_id").alias("k_i"), F.col("k.text_hash").alias("k_h"))
    others = spread_join(linked, first, "root", linked.count()).groupBy("doc_id", "text_hash").agg(
        F.max((F.col("doc_id").eqNullSafe(F.col("k_i")) & (F.col("text_hash") == F.col("k_h"))).cast("int")).alias("first"), F.count("*").alias("n")
    )
    # what goes, and equal rows under one id of which one stays
    others = cut(others.where("first = 0 or n > 1").select(F.col("doc_id").alias("k_i"), F.col("text_hash").alias("k_h"), "first"), "join-dropped")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("i"), F.coalesce(F.xxhash64(text_col), F.lit(0)).cast("long").alias("h"))
    same = (F.col("h") == F.col("k_h")) & F.col("i").eqNullSafe(F.col("k_i"))
    clear, doubtful = bucketed(rows, "h", others, "k_h", "left_anti"), bucketed(rows, "h", others, "k_h", "left_semi")
    kept = clear.unionByName(doubtful.join(others, same, "left_anti"))
    again = others.where("first = 1")
    if not again.isEmpty():
        kept = kept.unionByName(doubtful.join(again, same, "left_semi").dropDuplicates(["i", "h"]))
    return kept.select("doc.*")
