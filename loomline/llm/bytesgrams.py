"""Words of UTF-8 text columns as 64-bit hashes, by whole-array numpy steps over the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time; one longer text is taken alone.
CHUNK = 512 << 10

_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
BASE = 0xA0761D6478BD642F
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII character but letters and digits ends a term.
NO_TERM = np.zeros(256, dtype=bool)
NO_TERM[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NO_TERM[_a:_b] = False


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    steps = np.full(max(n, 1), base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Words(NamedTuple):
    hash: np.ndarray
    #: Index of the text, in the chunk.
    doc: np.ndarray
    #: First byte and length, in the chunk's data.
    start: np.ndarray
    length: np.ndarray


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)), offsets


def chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about limit bytes."""
    data, offsets = buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACE, lower: bool = True, prefixes: tuple[int, ...] = ()) -> Words | tuple[Words, list[np.ndarray]]:
    """Maximal runs of bytes that are not in ends; no run crosses a text's border. With prefixes, also the hashes of the words cut to so many bytes."""
    none = np.zeros(0, np.int64)
    inside = np.flatnonzero(~ends[data])
    if not len(inside):
        nothing = Words(np.zeros(0, np.uint64), none, none, none)
        return (nothing, [nothing.hash for _ in prefixes]) if prefixes else nothing
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(np.diff(inside), 1, out=first[1:])
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    first |= border[inside]
    at = np.flatnonzero(first)
    start = inside[at]
    length = np.diff(at, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(at, length)
    value = BYTE_VALUE[LOWER[data[inside]] if lower else data[inside]]
    value *= powers(int(length.max()))[place]
    found = Words(mix(np.add.reduceat(value, at)), np.searchsorted(offsets, start, "right") - 1, start, length)
    return (found, [mix(np.add.reduceat(np.where(place < k, value, 0), at)) for k in prefixes]) if prefixes else found


#: Odd multipliers of the places in a shingle.
_PLACE = mix(np.arange(101, 133, dtype=np.uint64)) | _ONE


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of width words; a text with fewer words has all its words as one shingle."""
    counts = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate(([0], np.cumsum(counts)))
    out, of = [], []
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        acc = hashes[:n] * _PLACE[0]
        for k in range(1, width):
            acc += hashes[k : k + n] * _PLACE[k]
        whole = doc[:n] == doc[width - 1 :]
        out.append(mix(acc[whole]))
        of.append(doc[:n][whole])
    for k in range(1, width):
        few = np.flatnonzero(counts == k)
        if len(few):
            acc = np.full(len(few), k, np.uint64)
            for j in range(k):
                acc += hashes[begin[few] + j] * _PLACE[j]
            out.append(mix(acc ^ np.uint64(0x5BD1E995)))
            of.append(few)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(out), np.concatenate(of)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]
