"""Elias-Fano sequences and files of named arrays that are memory-mapped.

A sequence of n non-decreasing numbers below u keeps the low ``log2(u / n)`` bits of each
as they are and the high bits in unary, about 2 + log2(u / n) bits a number.  Numbers are
decoded in chunks; queries that fall into one chunk decode it once.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyarrow import fs

from .common import open_fs

CHUNK = 1 << 12
_ALIGN = 64


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, lowest first, in one row of bytes after the other."""
    if not width:
        return np.zeros(0, dtype=np.uint8)
    bits = np.unpackbits(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little")


def _fixed(data: np.ndarray, k: int, count: int, width: int) -> np.ndarray:
    """``count`` numbers of ``width`` bits of chunk ``k``, which is a whole number of bytes."""
    wide = np.zeros((count, 64), dtype=np.uint8)
    at = k * CHUNK * width // 8
    wide[:, :width] = np.unpackbits(data[at : at + -(-count * width // 8)], bitorder="little")[: count * width].reshape(count, width)
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()


def encode_fixed(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of unsigned numbers in any order, each in the bits that the largest takes."""
    width = int(np.max(values, initial=0)).bit_length()
    low = [_bits(values[k : k + CHUNK], width) for k in range(0, len(values), CHUNK)]
    return {"head": np.array([len(values), width], dtype=np.uint64), "low": np.concatenate([np.zeros(0, dtype=np.uint8), *low])}


def fixed_at(arrays: Mapping[str, np.ndarray], prefix: str, index: np.ndarray) -> np.ndarray:
    """Numbers of :func:`encode_fixed` at ascending places."""
    n, width = (int(x) for x in arrays[f"{prefix}.head"])
    out = np.empty(len(index), dtype=np.uint64)
    for k, some in _runs(np.asarray(index) // CHUNK):
        out[some] = _fixed(arrays[f"{prefix}.low"], k, min(CHUNK, n - k * CHUNK), width)[index[some] - k * CHUNK]
    return out


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a non-decreasing sequence of unsigned numbers."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    places = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
    # of each chunk: where its first mark is, and its first value
    marks = np.zeros(int(places[-1]) + 1 if n else 0, dtype=bool)
    marks[places.astype(np.int64)] = True
    low = [_bits(values[k : k + CHUNK], width) for k in range(0, n, CHUNK)]
    return {
        "head": np.array([n, width], dtype=np.uint64), "low": np.concatenate([np.zeros(0, dtype=np.uint8), *low]), "high": np.packbits(marks, bitorder="little"),
        "mark": places[::CHUNK].copy(), "first": values[::CHUNK].copy(),
    }


class EliasFano:
    """A sequence over arrays that may be memory-mapped."""

    def __init__(self, arrays: Mapping[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["head"])
        self.low, self.high, self.mark, self.first = (arrays[k] for k in ("low", "high", "mark", "first"))

    def __len__(self) -> int:
        return self.n

    def chunk(self, k: int) -> np.ndarray:
        """The values ``k * CHUNK`` and following."""
        count = min(CHUNK, self.n - k * CHUNK)
        begin = int(self.mark[k])
        end = int(self.mark[k + 1]) if k + 1 < len(self.mark) else len(self.high) * 8
        marks = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :])[:count]
        out = (marks + begin - k * CHUNK - np.arange(count)).astype(np.uint64) << np.uint64(self.width)
        return out | _fixed(self.low, k, count, self.width)

    def at(self, index: np.ndarray) -> np.ndarray:
        """The values at ascending places."""
        out = np.empty(len(index), dtype=np.uint64)
        for k, some in _runs(np.asarray(index) // CHUNK):
            out[some] = self.chunk(k)[index[some] - k * CHUNK]
        return out

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending values: the place of the first number that is not smaller (n without one), and that number."""
        values = np.asarray(values, dtype=np.uint64)
        place, found = np.full(len(values), self.n, dtype=np.int64), np.zeros(len(values), dtype=np.uint64)
        if not self.n:
            return place, found
        # the answer is in the last chunk that begins below the value, or begins the next one
        chunk = np.maximum(np.searchsorted(self.first, values, side="left") - 1, 0)
        for k, some in _runs(chunk):
            here = self.chunk(k)
            at = np.searchsorted(here, values[some], side="left")
            inside = at < len(here)
            place[some] = k * CHUNK + at
            found[some] = np.where(inside, here[np.minimum(at, len(here) - 1)], self.first[k + 1] if k + 1 < len(self.first) else 0)
        return place, found


def _runs(ascending: np.ndarray):
    """(value, slice) of each run of equal values."""
    if len(ascending):
        begins = np.concatenate(([0], np.flatnonzero(np.diff(ascending)) + 1, [len(ascending)]))
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            yield int(ascending[a]), slice(a, b)


def write_arrays(path: str, arrays: Mapping[str, np.ndarray]) -> None:
    """One file: a length, a head in JSON, and the arrays, each at a multiple of 64 bytes.

    It is written under a name of its own and moved in place, so that tasks that run twice
    leave one whole file.
    """
    import uuid

    head, at = {}, 0
    for name, values in arrays.items():
        head[name] = (values.dtype.str, len(values), at)
        at += -(-values.nbytes // _ALIGN) * _ALIGN
    told = json.dumps(head).encode()
    told += b" " * (-(len(told) + 8) % _ALIGN)
    place, name = open_fs(path)
    place.create_dir(name.rsplit("/", 1)[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with place.open_output_stream(draft) as out:
        out.write(len(told).to_bytes(8, "little") + told)
        for values in arrays.values():
            out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
            out.write(b"\0" * (-values.nbytes % _ALIGN))
    try:
        place.move(draft, name)
    except OSError:  # a store that does not replace files: another attempt has left the same file
        if place.get_file_info(name).type != fs.FileType.File:
            raise
        place.delete_file(draft)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped into memory where the folder is mounted, else read; none if there is no file."""
    place, name = open_fs(path)
    if place.get_file_info(name).type != fs.FileType.File:
        return {}
    if isinstance(place, fs.LocalFileSystem):
        buffer = pa.memory_map(name).read_buffer()
    else:
        with place.open_input_file(name) as source:
            buffer = source.read_buffer()
    begin = 8 + int.from_bytes(buffer[:8].to_pybytes(), "little")
    head = json.loads(buffer[8:begin].to_pybytes())
    return {k: np.frombuffer(buffer, dtype=np.dtype(kind), count=n, offset=begin + at) if n else np.zeros(0, dtype=np.dtype(kind)) for k, (kind, n, at) in head.items()}


def nested(prefix: str, arrays: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def sequence(arrays: Mapping[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k: arrays[f"{prefix}.{k}"] for k in ("head", "low", "high", "mark", "first")})
