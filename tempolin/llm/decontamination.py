"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of the items build one automaton (in blocks of bounded size).
Documents stream through it word by word; the automaton gives the longest match that
ends at each word.  A match of at least ``window`` words marks the last ``window``
words, and an item shorter than that is marked where the whole of it occurs.

Items of up to ``BLOCK_WORDS`` words are one automaton, and the documents are read once.
More items are cut into blocks of that size.  Hashes of all their windows, in filters of
bounded size, tell in one pass over the documents (one for every ``FILTER_WINDOWS``
windows) which blocks a document can hold a window of; only documents that have any go to
the automata of those blocks, with the block's items in front of them.

Normalisation: A-Z become a-z; a word is a run of 0-9, a-z or characters from U+0080.

Defined results: null or empty text has no words; an item without words never
matches; items with a null id mark words but are neither listed nor counted; items
that share an id count once; no items or no documents give clean or empty results.
Documents keep one result row each, repeated or not; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, trimmed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD_BYTES = bytes(b"0123456789abcdefghijklmnopqrstuvwxyz") + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and makes every byte outside words a space.
_NORMAL = bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))

#: Words of test items in one automaton: about 50 MB of a worker's memory at most.
BLOCK_WORDS = 60_000
#: Windows of items in one filter: a broadcast of about 100 MB at most.
FILTER_WINDOWS = 8_000_000
#: Documents that meet one block in one task, about.
BLOCK_DOCS = 2_000


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of UTF-8 bytes."""
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items below each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        ends: list[set[int]] = [set()]
        self.ids: list[str | None] = []
        wholes: list[tuple[int, int, int]] = []
        for item_id, words in items:
            if not words:
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            last = 0
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)), ends)
                ends[last].add(number)
            if len(words) < window:
                wholes.append((last, len(words), number))
        self._order(ends)
        #: For each state, the short items that end there as a whole: (length, number).
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state, size, number in wholes:
            self.short.setdefault(state, []).append((size, number))
        self.least = min([size for _, size, _ in wholes], default=window)
        #: Whether a short item ends at this state or at one that its links lead to.
        self.any_short = bytearray(len(self.length))
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.any_short[state] = state in self.short or (state > 0 and self.any_short[self.link[state]])

    def _extend(self, last: int, symbol: int, ends: list[set[int]]) -> int:
        nxt, length, link = self.next, self.length, self.link
        if symbol in nxt[last]:
            there = nxt[last][symbol]
            return there if length[there] == length[last] + 1 else self._clone(last, symbol, there, ends)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        ends.append(set())
        state = last
        while state >= 0 and symbol not in nxt[state]:
            nxt[state][symbol] = new
            state = link[state]
        if state >= 0:
            there = nxt[state][symbol]
            link[new] = there if length[there] == length[state] + 1 else self._clone(state, symbol, there, ends)
        return new

    def _clone(self, state: int, symbol: int, there: int, ends: list[set[int]]) -> int:
        nxt, length, link = self.next, self.length, self.link
        twin = len(length)
        length.append(length[state] + 1)
        link.append(link[there])
        nxt.append(dict(nxt[there]))
        ends.append(set())
        link[there] = twin
        while state >= 0 and nxt[state].get(symbol) == there:
            nxt[state][symbol] = twin
            state = link[state]
        return twin

    def _order(self, ends: list[set[int]]) -> None:
        """Lay the tree of links out flat: the items below a state are one slice."""
        children: list[list[int]] = [[] for _ in self.length]
        for state in range(1, len(self.length)):
            children[self.link[state]].append(state)
        self.begin, self.end = [0] * len(self.length), [0] * len(self.length)
        flat: list[int] = []
        stack = [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                self.end[state] = len(flat)
                continue
            self.begin[state] = len(flat)
            flat.extend(ends[state])
            stack.append((state, True))
            stack.extend((child, False) for child in children[state])
        self.flat = np.array(flat, dtype=np.int64)

    def names(self, numbers: set[int]) -> list[str]:
        """Ids of the items with these numbers, in order."""
        return sorted({self.ids[i] for i in numbers if self.ids[i] is not None})

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) of word positions, merged and in order, and the items."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        hits: set[tuple[int, int]] = set()
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist()):
            if stop - start >= self.least:  # a shorter run of known words holds no window
                self._run(ids[start:stop].tolist(), start, spans, hits)
        items: set[int] = set()
        for state, _ in (x for x in hits if x[1] < 0):
            items.update(self.flat[self.begin[state] : self.end[state]].tolist())
        items.update(number for _, number in hits if number >= 0)
        return _merged(spans), items

    def _run(self, ids: list[int], start: int, spans: list, hits: set) -> None:
        nxt, length, link, window, any_short = self.next, self.length, self.link, self.window, self.any_short
        state = matched = 0
        for at, symbol in enumerate(ids, start + 1):
            while state and symbol not in nxt[state]:
                state = link[state]
                matched = length[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                matched += 1
            else:
                matched = 0
            if matched >= window:
                spans.append((at - window, at))
                node = state
                while length[link[node]] >= window:
                    node = link[node]
                hits.add((node, -1))
            if any_short[state]:
                node = state
                while node > 0:
                    for size, number in self.short.get(node, ()):
                        if size <= matched:
                            spans.append((at - size, at))
                            hits.add((node, number))
                    node = link[node]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": x, "end": y} for x, y in one] for one in spans], _SPANS)


def _matcher(items: list[tuple[str | None, list[bytes]]], window: int, with_body: bool):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(items, window)
        for batch in batches:
            counts, spans, found = [], [], []
            for text in batch.column("body").to_pylist():
                words = words_of(text or b"")
                new_spans, new_items = automaton.scan(words) if words else ([], set())
                counts.append(len(words))
                spans.append(new_spans)
                found.append(automaton.names(new_items))
            out = {"doc": batch.column(0), "n_words": pa.array(counts, pa.int64()), "spans": _spans_array(spans), "items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(out | ({"body": batch.column("body")} if with_body else {}))

    return match


def _cleaner(items: list[tuple[str | None, list[bytes]]], window: int, max_span: int, max_coverage: float):
    """Match and clean in one pass: (doc, body) of the documents that stay."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(items, window)
        for batch in batches:
            stays, bodies = [], []
            for text in batch.column("body").to_pylist():
                words = words_of(text or b"")
                spans = automaton.scan(words)[0] if words else []
                stays.append(sum(end - start for start, end in spans) <= max_coverage * len(words))
                if stays[-1]:
                    long = [x for x in spans if x[1] - x[0] > max_span]
                    bodies.append(without(text, long) if long else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc").filter(pa.array(stays, pa.bool_())), pa.array(bodies, pa.binary())], names=["doc", "body"])

    return clean


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive words."""
    from xxhash import xxh3_64_intdigest

    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    out = hashes[:n] + np.uint64(width)
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return out ^ (out >> np.uint64(32))


def _windows(window: int):
    """(hash, block, width) of the windows of items; a short item is one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, blocks, widths = [np.empty(0, np.uint64)], [], []
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                width = min(window, len(words))
                if width:
                    hashes.append(np.unique(window_hashes(words, width)))
                    blocks += [block] * len(hashes[-1])
                    widths += [width] * len(hashes[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(blocks, pa.int32()), pa.array(widths, pa.int32())], names=["hash", "block", "width"])

    return make


def _screen(known):
    """Add the blocks whose windows a document may hold; ``known`` is a broadcast (hashes, blocks, widths), by hash."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, blocks, widths = known.value
        rough = np.zeros(1 << 24, dtype=bool)  # most windows are told apart by 24 bits
        rough[hashes >> np.uint64(40)] = True
        for batch in batches:
            counts, found = [], []
            for text, old in zip(batch.column("body").to_pylist(), batch.column("blocks").to_pylist()):
                words = words_of(text or b"")
                counts.append(len(words))
                met = set(old)
                for width in widths:
                    mine = window_hashes(words, width)
                    mine = mine[rough[mine >> np.uint64(40)]]
                    for low, high in zip(np.searchsorted(hashes, mine, "left").tolist(), np.searchsorted(hashes, mine, "right").tolist()):
                        met.update(blocks[low:high].tolist())
                found.append(sorted(met))
            yield pa.RecordBatch.from_pydict({"doc": batch.column(0), "body": batch.column("body"), "n_words": pa.array(counts, pa.int64()), "blocks": pa.array(found, pa.list_(pa.int32()))})

    return screen


def _by_block(window: int):
    """Items of a block in front of the documents that meet it: (rid, spans, items) of each of these."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, automaton, items = None, None, []
        for batch in batches:
            rids, spans, found = [], [], []
            for block, salt, rid, item, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (block, salt) != place:
                    place, automaton, items = (block, salt), None, []
                if rid is None:
                    items.append((item, words_of(text)))
                    continue
                automaton = SuffixAutomaton(items, window) if automaton is None else automaton
                new_spans, new_items = automaton.scan(words_of(text))
                rids.append(rid)
                spans.append(new_spans)
                found.append(automaton.names(new_items))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), _spans_array(spans), pa.array(found, pa.list_(pa.string()))], names=["rid", "spans", "items"])

    return match


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several blocks found in one document."""
    for batch in batches:
        spans = [_merged([(s["start"], s["end"]) for one in x for s in one]) for x in batch.column(1).to_pylist()]
        items = [sorted(set().union(*x)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), _spans_array(spans), pa.array(items, pa.list_(pa.string()))], names=["rid", "spans", "items"])


def find_spans(
    docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, with_body: bool = False,
) -> DataFrame:
    """Per document: ``doc`` (a struct of ``keep``), ``n_words``, hit ``spans`` of word
    positions (merged, in order), the ids of the ``items`` found, and its UTF-8 ``body``
    if asked for.

    Items are cut into blocks of about ``block_words`` words, so one automaton has a known
    size however many items there are.
    """
    bound_batches(docs.sparkSession)
    state = docs.select(F.struct(*[F.col(c) for c in keep]).alias("doc"), F.col(text_col).cast("binary").alias("body"))
    kind, body = state.schema["doc"].dataType, [T.StructField("body", T.BinaryType())] * with_body
    spans, ids = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("doc", kind), T.StructField("n_words", T.LongType()), T.StructField("spans", spans), T.StructField("items", ids), *body])
    blocks = _blocks(items, item_id_col, item_text_col, block_words)
    listed = _one_block(blocks)
    if listed is not None:
        return state.mapInArrow(trimmed(_matcher(listed, window, with_body)), schema)

    state = state.withColumn("n_words", F.lit(0).cast("long")).withColumn("blocks", F.array().cast("array<int>"))
    for known in _filters(blocks, window):
        screened = state.mapInArrow(trimmed(_screen(known)), T.StructType([schema["doc"], T.StructField("body", T.BinaryType()), schema["n_words"], T.StructField("blocks", T.ArrayType(T.IntegerType()))]))
        state = cut(screened.withColumn("rid", F.monotonically_increasing_id()), "decontamination-screened")
    met = state.where(F.size("blocks") > 0)
    places = met.select("rid", F.explode("blocks").alias("block"))
    salts = cut(places.groupBy("block").agg((F.expr(f"count(*) div {BLOCK_DOCS}") + 1).cast("int").alias("salts")), "decontamination-blocks")
    front = blocks.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("rid"), "item", "text")
    few = F.broadcast(salts)  # one row a block: a million blocks are 60 billion words of items
    texts = met.select("rid", "body", F.explode("blocks").alias("block")).join(few, "block")
    texts = texts.select("block", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"), "rid", F.lit(None).cast("string").alias("item"), F.col("body").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = front.unionByName(texts).repartition(n, "block", "salt").sortWithinPartitions("block", "salt", F.col("rid").asc_nulls_first())
    pieces = T.StructType([T.StructField("rid", T.LongType()), schema["spans"], schema["items"]])
    found = cut(dealt.mapInArrow(trimmed(_by_block(window)), pieces), "decontamination-found")
    # a document's blocks are few: those that it holds a window of
    found = found.groupBy("rid").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).mapInArrow(_merge, pieces)
    clean = state.where(F.size("blocks") == 0).select("doc", "n_words", F.array().cast(spans).alias("spans"), F.array().cast(ids).alias("items"), *(["body"] * with_body))
    return clean.unionByName(met.join(found, "rid").select(*clean.columns))


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> DataFrame:
    """(block, item, text) of the items with words, in the shared folder: blocks are numbered from 0."""
    n_words = F.size(F.array_remove(F.split(F.translate(F.col("_t"), _UPPER, _LOWER), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), "")).cast("long")
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("_t")).select("item", F.col("_t").cast("binary").alias("text"), n_words.alias("n")).where("n > 0")
    numbered = cut(rows.withColumn("at", F.monotonically_increasing_id()), "decontamination-items")
    # three numbers a row are put in order in one task: items, not documents
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    block = F.expr(f"cast(coalesce(_before, 0) div {int(block_words)} as int)")
    placed = numbered.select("at", F.sum("n").over(before).alias("_before")).select("at", block.alias("block"))
    return cut(numbered.join(placed, "at").select("block", "item", "text"), "decontamination-items")


def _one_block(blocks: DataFrame) -> list[tuple[str | None, list[bytes]]] | None:
    """The items, if one block holds them all."""
    if blocks.agg(F.max("block")).first()[0]:
        return None
    return [(r["item"], words_of(bytes(r["text"]))) for r in blocks.select("item", "text").collect()]


def _filters(blocks: DataFrame, window: int) -> Iterator:
    """Broadcasts of (hashes, blocks, widths), sorted by hash, of at most about ``FILTER_WINDOWS`` windows each."""
    spark = blocks.sparkSession
    windows = cut(blocks.select("block", "text").mapInArrow(_windows(window), "hash long, block int, width int").distinct(), "decontamination-windows")
    parts = windows.count() // FILTER_WINDOWS + 1
    for part in range(parts):
        table = windows.where(F.pmod("hash", F.lit(parts)) == part).toArrow()
        hashes = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        yield spark.sparkContext.broadcast((hashes[order], table.column("block").to_numpy()[order], sorted(set(table.column("width").to_pylist()))))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 0, max_coverage: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """``docs`` without contaminated text: same columns.

    A document of which more than ``max_coverage`` of the words are hit goes.  From the
    others, spans of more than ``max_span`` words are taken out of the text (from the
    first byte of the first word to the last byte of the last one).
    """
    columns = list(docs.columns)
    unnamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{columns.index(text_col)}"
    out = [(F.col("body").cast("string") if c == text else F.col(f"doc.{c}")).alias(c) for c in unnamed.columns]
    listed = _one_block(_blocks(items, "item_id", "text", BLOCK_WORDS))
    if listed is not None:  # one pass, and one worker a task
        bound_batches(docs.sparkSession)
        whole = unnamed.select(F.struct(*unnamed.columns).alias("doc"), F.col(text).cast("binary").alias("body"))
        return whole.mapInArrow(trimmed(_cleaner(listed, window, max_span, max_coverage)), whole.schema).select(*out).toDF(*columns)
    found = find_spans(unnamed, items, window, text, tuple(unnamed.columns), with_body=True)
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    kept = found.where(hit <= F.lit(max_coverage) * F.col("n_words")).select(
        "doc", "body", F.expr(f"filter(spans, s -> s.end - s.start > {int(max_span)})").alias("spans")
    )
    cleaned = kept.mapInArrow(_remove, kept.select("doc", "body").schema)
    return cleaned.select(*out).toDF(*columns)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [b if not s else without(b, [(x["start"], x["end"]) for x in s]) for b, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["doc", "body"])


def without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``body`` without the words at the positions of ``spans`` and what lies between them."""
    plain = np.frombuffer(body.translate(_NORMAL), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for first, last in spans:
        out.append(body[at : starts[first]])
        at = int(ends[last - 1])
    return b"".join([*out, body[at:]])
