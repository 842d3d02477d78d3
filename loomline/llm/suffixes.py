"""Induced suffix sorting of byte strings, with queues on disk, and the common prefixes of neighbours.

Suffixes that are smaller than the next one are of type S, the others of type L. The S suffixes that follow an L suffix are
sorted first: the strings between them are named, and the string of names is sorted by doubling. All other suffixes are
induced: L suffixes in one pass up, S suffixes in one pass down, each entering the queue of its first byte in the order of
the suffix that follows it. The queues form a priority queue by first byte, first in, first out, whose arrays are written to
a scratch file beyond a bound; the passes take a queue at a time. Common prefixes are compared only where the bytes before
two neighbours differ; everywhere else they are one less than at the position before.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes that the queues hold in memory before they are written to disk.
QUEUE_BYTES = 64 << 20
#: Bytes of text up to which all its runs of eight bytes are laid out for comparisons.
PACKED = 16 << 20


class Queues:
    """Positions by byte, first in, first out. Beyond `memory` bytes the fullest queue goes to an unnamed scratch file, which is gone with the task."""

    def __init__(self, memory: int = QUEUE_BYTES) -> None:
        self.memory, self.held, self.spilled = memory, 0, 0
        self.parts: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(256)]
        self.sizes = np.zeros(256, np.int64)
        self.file = None

    def push(self, first: np.ndarray, at: np.ndarray) -> None:
        """Adds positions to the queues of their first bytes, in order."""
        order = np.argsort(first, kind="stable")
        at, counts = at[order], np.bincount(first, minlength=256)
        end = np.cumsum(counts)
        for c in np.flatnonzero(counts).tolist():
            self.parts[c].append(at[end[c] - counts[c] : end[c]])
        self.sizes += counts * at.itemsize
        self.held += at.nbytes
        while self.held > self.memory:
            self._spill(int(self.sizes.argmax()))

    def _spill(self, c: int) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        begin = self.file.seek(0, 2)
        for part in self.parts[c]:
            if isinstance(part, np.ndarray):
                self.file.write(part.tobytes())
        end = self.file.tell()
        self.parts[c] = [p for p in self.parts[c] if isinstance(p, tuple)] + [(begin, end)]
        self.held -= int(self.sizes[c])
        self.spilled += end - begin
        self.sizes[c] = 0

    def pop(self, c: int) -> np.ndarray | None:
        """All positions of a queue, which is empty then; None if it was."""
        parts, self.parts[c] = self.parts[c], []
        self.held -= int(self.sizes[c])
        self.sizes[c] = 0
        got = []
        for p in parts:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                p = np.frombuffer(self.file.read(p[1] - p[0]), np.int32)
            got.append(p)
        return None if not got else got[0] if len(got) == 1 else np.concatenate(got)


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the empty one at the end is."""
    n = len(t)
    up = np.zeros(n + 1, np.int8)
    up[: n - 1] = np.sign(np.diff(t.astype(np.int16)))
    up[n - 1], up[n] = -1, 1
    known = np.where(up != 0, np.arange(n + 1, dtype=np.int32), np.int32(n))
    return up[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _names(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the strings from each of lms up to the next, in their order. Bytes with their types compare such strings to the end."""
    n, end = len(t), np.append(lms[1:], lms[-1])
    symbol = np.zeros(n + 2, np.uint16)
    symbol[:n] = (t.astype(np.uint16) << np.uint16(1) | is_s[:n]) + np.uint16(1)
    names = np.zeros(len(lms), np.int64)
    todo, at = np.arange(len(lms)), 0
    while len(todo):
        key, begin, stop = np.zeros(len(todo), np.uint64), lms[todo] + np.int32(at), end[todo]
        for k in range(7):
            place = np.minimum(begin + np.int32(k), stop + np.int32(1))
            key <<= np.uint64(9)
            key |= np.where(place <= stop, symbol[place], np.uint16(0))
        # names of equal strings so far are places in the order, so refining a group moves no other
        order = np.lexsort((key, names[todo])) if at else np.argsort(key)
        own, k2 = names[todo[order]], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (own[1:] != own[:-1]) | (k2[1:] != k2[:-1])
        group = np.ones(len(order), bool)
        group[1:] = own[1:] != own[:-1]
        place = np.arange(len(order))
        rank = own + (np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0)))
        names[todo[order]] = rank
        at += 7
        first = np.flatnonzero(new)
        several = np.repeat(np.diff(first, append=len(order)) > 1, np.diff(first, append=len(order)))
        left = todo[order][several]
        todo = np.sort(left[lms[left] + at <= end[left]])
    return names


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, whose last is the least. Only suffixes that are still tied are sorted again."""
    m = len(names)
    order = np.argsort(names)
    sorted_ = names[order]
    new = np.ones(m, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    step = 1
    while True:
        first = np.flatnonzero(new)
        size = np.diff(first, append=m)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        own = order[tied]
        ahead = own + step
        both = rank[own] * np.int64(m + 1) + np.where(ahead < m, rank[np.minimum(ahead, m - 1)] + 1, 0)
        inner = np.argsort(both)
        own, both = own[inner], both[inner]
        order[tied] = own
        split = np.ones(len(own), bool)
        split[1:] = both[1:] != both[:-1]
        new[tied] = split
        rank[own] = tied[np.maximum.accumulate(np.where(split, np.arange(len(own)), 0))]
        step *= 2


def suffix_array(t: np.ndarray, memory: int = QUEUE_BYTES) -> np.ndarray:
    """Positions of all suffixes of the bytes t but the empty one, in order; a suffix comes before those it begins."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    is_s = _types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    inner = lms[:-1]  # without the empty suffix, which is the least
    if len(inner):
        names = _names(t, is_s, lms)
        names[-1] = -1
        order = _doubled(names + 1)
        inner = lms[order[1:]]
    starts = np.searchsorted(t[inner], np.arange(257)) if len(inner) else np.zeros(257, np.int64)
    queues = Queues(memory)

    def induce(at: np.ndarray, to_s: bool) -> None:
        before = at[at > 0] - 1
        before = before[is_s[before] == to_s]
        queues.push(t[before], before)

    lows: list[np.ndarray] = []
    induce(np.array([n], np.int32), False)
    for c in range(256):
        own = []
        while (got := queues.pop(c)) is not None:
            own.append(got)
            induce(got, False)
        lows.append(np.concatenate(own) if own else np.zeros(0, np.int32))
        induce(inner[starts[c] : starts[c + 1]], False)
    out, end = np.empty(n, np.int32), n
    for c in range(255, -1, -1):
        while (got := queues.pop(c)) is not None:
            out[end - len(got) : end] = got[::-1]
            end -= len(got)
            induce(got, True)
        out[end - len(lows[c]) : end] = lows[c]
        end -= len(lows[c])
        induce(lows[c][::-1], True)
    return out


def common_prefixes(t: np.ndarray, order: np.ndarray, least: int = 0) -> np.ndarray:
    """By position: how many bytes its suffix shares with the one before it in the order; 0 for the first. Where it is less than `least` it may be understated."""
    n = len(t)
    other = np.empty(n, np.int32)
    other[order[1:]], other[order[0]] = order[:-1], -1
    apart = other <= 0
    apart[0] = True
    apart[1:] |= t[:-1] != t[np.maximum(other[1:], 1) - 1]
    i = np.flatnonzero(apart).astype(np.int32)
    j = other[i]
    padded = np.concatenate((t, np.zeros(16, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    packed = np.ascontiguousarray(rows).view("<u8").ravel() if n <= PACKED else None
    word = (lambda at: packed[at]) if packed is not None else (lambda at: np.ascontiguousarray(rows[at]).view("<u8").ravel())
    shared = np.zeros(len(i), np.int32)
    todo = np.flatnonzero(j >= 0)
    a, b, at = i[todo], j[todo], 0
    while len(todo) and at + 8 <= least:  # short ones need no count
        same = (word(a) == word(b)) & (np.maximum(a, b) + 8 <= n)
        todo, a, b, at = todo[same], a[same] + np.int32(8), b[same] + np.int32(8), at + 8
    shared[todo] = at
    while len(todo):
        differ = word(a) ^ word(b)
        low = np.maximum(differ & (~differ + np.uint64(1)), np.uint64(1)).astype(np.float64)
        same = np.minimum(np.where(differ == 0, 8, np.log2(low).astype(np.int32) >> 3), n - np.maximum(a, b)).astype(np.int32)
        shared[todo] += same
        more = same == 8
        todo, a, b = todo[more], a[more] + np.int32(8), b[more] + np.int32(8)
    place = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(apart, place, 0))
    full = np.zeros(n, np.int32)
    full[i] = shared
    return np.maximum(full[last] - (place - last), 0)


def classes(t: np.ndarray, at: np.ndarray, length: int, memory: int = QUEUE_BYTES) -> np.ndarray:
    """A class for each position: the same where the next `length` bytes are. Every position has so many."""
    order = suffix_array(t, memory)
    apart = common_prefixes(t, order, length)[order] < length
    of = np.empty(len(t), np.int64)
    of[order] = np.cumsum(apart)
    return np.unique(of[at], return_inverse=True)[1]
