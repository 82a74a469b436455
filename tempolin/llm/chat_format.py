"""Chat formatting by columnar byte assembly.

Each turn becomes ``### Role:\\n`` text ``\\n</turn>\\n``.  Control strings inside texts
are escaped so that the format can be read back: a backslash becomes two, and ``###``
and ``</turn>`` get a backslash in front.  Role names are escaped in the same way, and
a line end or colon in one is written ``\\n`` or ``\\:``.

Turns are assembled by columns: the places of backslashes, the lengths of all segments and
their cumulative offsets are computed in numpy over the Arrow buffers of a batch, and
headers and contents are scattered from those buffers into one preallocated buffer, which
becomes the Arrow column.  The loss mask covers assistant texts, given as byte ranges of
the escaped text.

A conversation is one row, or where it is longer than ``PART_BYTES`` several, numbered by
``part``, each of whole turns: a worker holds one part and never a whole conversation.
All turns of one conversation are still put in order and read back by one task, because
a digest of it is one sequence.

Defined results: null text and null role count as empty; turns are ordered by turn
(null first), then role, then text; repeated turns stay; rows with a null conv_id form
one conversation; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, trimmed

LOSS_ROLE = b"assistant"
_HEAD, _COLON, _TAIL = b"### ", b":\n", b"\n</turn>\n"
_MARK, _STOP, _BACK = b"###", b"</turn>", ord("\\")
_SCHEMA = "conv_id long, part int, formatted binary, mask array<struct<start: long, end: long>>"
_MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Bytes of turns that are assembled at a time, and from which a conversation is cut.
PART_BYTES = 8 << 20


def escape(text: bytes) -> bytes:
    return text.replace(b"\\", b"\\\\").replace(b"###", b"\\###").replace(b"</turn>", b"\\</turn>")


def unescape(text: bytes) -> bytes:
    out, at = [], 0
    while (place := text.find(b"\\", at)) >= 0:
        out.append(text[at:place])
        out.append(text[place + 1 : place + 2])
        at = place + 2
    return b"".join([*out, text[at:]])


def _escape_role(role: bytes) -> bytes:
    return escape(role).replace(b"\n", b"\\n").replace(b":", b"\\:")


def _unescape_role(role: bytes) -> bytes:
    out, at = [], 0
    while (place := role.find(b"\\", at)) >= 0:
        following = role[place + 1 : place + 2]
        out += [role[at:place], b"\n" if following == b"n" else following]
        at = place + 2
    return b"".join([*out, role[at:]])


def assemble(segments: list[bytes], counts: list[int]) -> tuple[pa.Array, np.ndarray]:
    """Concatenate ``counts[i]`` segments for each row i, in one preallocated buffer.

    Returns the binary column and the segments' offsets in the buffer.
    """
    lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    buffer = pa.allocate_buffer(int(offsets[-1]))
    target = np.frombuffer(buffer, dtype=np.uint8)
    # headers and tails repeat: each different segment is scattered to all its places at once
    places: dict[bytes, list[int]] = {}
    for number, segment in enumerate(segments):
        if segment:
            places.setdefault(segment, []).append(number)
    for segment, numbers in places.items():
        source = np.frombuffer(segment, dtype=np.uint8)
        starts = offsets[numbers]
        if len(starts) == 1:
            target[starts[0] : starts[0] + len(source)] = source
        else:
            step = max(1, (4 << 20) // len(source))
            for low in range(0, len(starts), step):
                target[starts[low : low + step, None] + np.arange(len(source))] = source
    rows = offsets[np.concatenate(([0], np.cumsum(np.asarray(counts, dtype=np.int64))))]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(rows.astype(np.int64)), buffer])
    return column, offsets


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value begins and the last one ends, without copies."""
    places = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[places[0] : places[-1]]
    return data, places - places[0]


def _escaped_places(data: np.ndarray, places: np.ndarray, names: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where each byte goes when backslashes are put in, and where each value begins then.

    ``###`` is looked for from the left without overlaps, as :func:`escape` does; nothing
    is found across values.
    """
    before = data == _BACK
    if names:
        before |= (data == ord(":")) | (data == ord("\n"))
    ends = places[1:]
    last = lambda at: ends[np.searchsorted(ends, at, side="right")]  # noqa: E731  the end of the value that holds a byte
    sharp = np.flatnonzero(data == ord("#"))
    if len(sharp):
        inside = np.zeros(len(sharp), dtype=bool)  # the byte before it is in the same run
        inside[1:] = (np.diff(sharp) == 1) & (last(sharp[1:]) == last(sharp[:-1]))
        begins = np.flatnonzero(~inside)
        run = np.cumsum(~inside) - 1
        step = np.arange(len(sharp)) - begins[run]
        length = np.diff(np.append(begins, len(sharp)))[run]
        before[sharp[(step % len(_MARK) == 0) & (step + len(_MARK) <= length)]] = True
    stops = np.flatnonzero(data == _STOP[0])
    stops = stops[stops + len(_STOP) <= last(stops)] if len(stops) else stops
    for k in range(1, len(_STOP)):
        stops = stops[data[stops + k] == _STOP[k]]
    before[stops] = True
    put = np.cumsum(before, dtype=np.int64)
    return np.arange(len(data)) + put, places + np.concatenate(([0], put))[places]


def _turns(role: pa.Array, text: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted turns in one buffer: where each begins (and the last one ends), and where its text begins and ends."""
    (names, name_places), (texts, text_places) = _bytes_of(role), _bytes_of(text)
    name_at, name_new = _escaped_places(names, name_places, True)
    text_at, text_new = _escaped_places(texts, text_places, False)
    n = len(role)
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:] = (len(_HEAD), 0, len(_COLON), 0, len(_TAIL))
    lengths[:, 1], lengths[:, 3] = np.diff(name_new), np.diff(text_new)
    offsets = np.concatenate(([0], np.cumsum(lengths.ravel())))
    buffer = pa.allocate_buffer(int(offsets[-1]))
    target = np.frombuffer(buffer, dtype=np.uint8)
    target[:] = _BACK  # what nothing else is put on
    begins = offsets[:-1].reshape(n, 5)
    for column, segment in ((0, _HEAD), (2, _COLON), (4, _TAIL)):
        target[begins[:, column, None] + np.arange(len(segment))] = np.frombuffer(segment, dtype=np.uint8)
    names = np.where(names == ord("\n"), ord("n"), names).astype(np.uint8)
    for data, at, old, new, column in ((names, name_at, name_places, name_new, 1), (texts, text_at, text_places, text_new, 3)):
        target[at + np.repeat(begins[:, column] - new[:-1], np.diff(old))] = data
    return buffer, np.append(begins[:, 0], offsets[-1]), begins[:, 3], begins[:, 4]


def _one_turn(role: bytes, text: bytes) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """The same for a turn that is long itself: its segments are copied as they are."""
    column, offsets = assemble([_HEAD, _escape_role(role), _COLON, escape(text), _TAIL], [5])
    return column.buffers()[2], offsets[[0, 5]], offsets[[3]], offsets[[4]]


def _rows(convs: pa.Array, new: np.ndarray, part: int, turns: tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray], loss: np.ndarray) -> pa.RecordBatch:
    """Conversations that begin at the turns ``new``; the first one is its part number ``part``."""
    buffer, begins, text_begins, text_ends = turns
    first = np.flatnonzero(new)
    rows = begins[np.append(first, len(begins) - 1)]
    origin = np.repeat(rows[:-1], np.diff(np.append(first, len(new))))
    spans = pa.StructArray.from_arrays([pa.array((text_begins - origin)[loss]), pa.array((text_ends - origin)[loss])], names=["start", "end"])
    masks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(loss))[np.append(first, len(new))].astype(np.int32)), spans)
    parts = np.zeros(len(first), dtype=np.int32)
    parts[0] = part
    column = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(rows.astype(np.int32)), buffer])
    return pa.RecordBatch.from_arrays([convs.take(pa.array(first)), pa.array(parts), column, masks.cast(_MASK)], names=["conv_id", "part", "formatted", "mask"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, conversations out, cut where the turns at hand reach ``PART_BYTES``."""
    held: list[pa.RecordBatch] = []
    size, part = 0, 0
    last: list[int | None] = []  # the conversation that the last part belongs to, if it may go on

    def out(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, part, last
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        convs, role, text = (table.column(k) for k in range(3))
        number, known = convs.fill_null(0).to_numpy(zero_copy_only=False), convs.is_valid().to_numpy(zero_copy_only=False)
        new = np.append(True, (number[1:] != number[:-1]) | (known[1:] != known[:-1]))
        # the last conversation waits for its other turns, unless it is all there is
        upto = len(new) if final else int(np.flatnonzero(new)[-1]) or len(new)
        part = part + 1 if last == [convs[0].as_py()] else 0
        loss = pc.equal(role, LOSS_ROLE).to_numpy(zero_copy_only=False)
        one = upto == 1 and len(text[0].as_buffer()) + len(role[0].as_buffer()) > PART_BYTES
        turns = _one_turn(role[0].as_py(), text[0].as_py()) if one else _turns(role.slice(0, upto), text.slice(0, upto))
        yield _rows(convs, new[:upto], part, turns, loss[:upto])
        held = [table.slice(upto)] if upto < len(new) else []
        if np.flatnonzero(new[:upto])[-1]:  # it ends a conversation that begins in it
            part = 0
        last = [convs[upto - 1].as_py()]
        size = _size(held[0]) if held else 0

    for batch in batches:
        small = [batch.column(0), *(batch.column(k).cast(pa.binary()) for k in (1, 2))]
        for piece in _pieces(pa.RecordBatch.from_arrays(small, names=batch.schema.names)):
            held.append(piece)
            size += _size(piece)
            while held and size >= PART_BYTES:
                yield from out(False)
    if held:
        yield from out(True)


def _size(batch: pa.RecordBatch) -> int:
    """Bytes of the roles and texts, and of their frames."""
    sizes = (np.frombuffer(batch.column(k).buffers()[1], dtype=np.int32)[[batch.column(k).offset, batch.column(k).offset + batch.num_rows]] for k in (1, 2))
    return sum(int(end) - int(begin) for begin, end in sizes) + batch.num_rows * (len(_HEAD) + len(_COLON) + len(_TAIL))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that stay below ``PART_BYTES``, or are one turn."""
    if _size(batch) < PART_BYTES or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    middle = batch.num_rows // 2
    yield from _pieces(batch.slice(0, middle))
    yield from _pieces(batch.slice(middle))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, ``part``, ``formatted`` (UTF-8) and the loss ``mask`` of each conversation.

    The turns of a conversation are brought together by its id and sorted on disk if
    need be.  Parts of one conversation come one after the other.
    """
    bound_batches(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).cast("binary").alias("role"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"),
    )
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "content"]
    return rows.repartition(n, "conv_id").sortWithinPartitions(*order).select("conv_id", "role", "content").mapInArrow(trimmed(_format), _SCHEMA)


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if formatted[at : at + 4] != _HEAD:
            raise ValueError("a turn begins with its header")
        colon = _find(formatted, _COLON, at + 4)
        tail = _find(formatted, _TAIL, colon + 2)
        out.append((_unescape_role(formatted[at + 4 : colon]), unescape(formatted[colon + 2 : tail])))
        at = tail + len(_TAIL)
    return out


def _find(data: bytes, mark: bytes, at: int) -> int:
    """The first ``mark`` from ``at`` of which no byte is escaped."""
    while True:
        place = data.find(mark, at)
        if place < 0:
            raise ValueError("a turn has an end")
        # marks begin with ':' or a line end; only in role names is ':' escaped, after an odd run of backslashes
        if mark[:1] != b":" or (place - len(data[:place].rstrip(b"\\"))) % 2 == 0:
            return place
        at = place + 1


class _Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self, conv: int | None):
        self.conv, self.part, self.n_turns, self.chars, self.loss_chars = conv, -1, 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, conv: int | None, part: int, data: bytes, mask: list[dict]) -> None:
        if (conv, part) != (self.conv, self.part + 1):
            raise ValueError("the parts of a conversation come one after the other: read a stored table with ordered=False")
        self.part = part
        for role, text in read_turns(data):
            self.n_turns += 1
            for piece in (role, b"\n", text, b"\n"):
                self.whole.update(piece)
        for span in mask:
            text = unescape(data[span["start"] : span["end"]])
            self.loss.update(text)
            self.loss_chars += len(text.decode())
        self.chars += len(data.decode())

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)
    now: _Digest | None = None
    for batch in batches:
        rows = []
        for conv, part, data, mask in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if now is not None and not part:
                rows.append(now.row())
            now = _Digest(conv) if now is None or not part else now
            now.add(conv, part, data, mask)
        yield told(rows)
    if now is not None:
        yield told([now.row()])


def digest_formatted(formatted: DataFrame, ordered: bool = True) -> DataFrame:
    """Read formatted conversations back and sum them up.

    :func:`format_conversations` gives the parts of each one after the other; a table that was
    written and read again may not, and is put in order with ``ordered=False``.
    """
    rows = formatted.select("conv_id", "part", "formatted", "mask")
    if not ordered:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
