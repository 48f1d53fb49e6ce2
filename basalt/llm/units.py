"""Cutting UTF-8 text into units and finding their ids without a Python object for each.

A unit is what stands between two single spaces that have no white space on
their other sides. The bytes of a whole Arrow batch are cut at once. Units of
at most :data:`LONG` bytes are looked up by their own bytes (three words of
eight) in an open-addressing table, so a match is exact; the ids of those that
are found are put together by gathers. New units, long units and the first
unit of each text are handed to a function that encodes strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

LONG = 24
SLOTS = 1 << 20
#: Units in the table before it starts anew; ids that it holds.
FULL, FULL_IDS = 600_000, 4_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes with which a white-space character above ASCII can begin; a space beside one is no cut.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, with room before and behind, and where each begins in them (and the last ends). Nulls are empty."""
    col = col.cast(pa.large_string()) if pa.types.is_string(col.type) else col
    col = col.fill_null("") if col.null_count else col
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if len(col) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return np.concatenate([np.zeros(8, np.uint8), raw, np.zeros(LONG + 16, np.uint8)]), at - at[0] + 8


def cut(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings and ends of units, without the space between them, and the number of units of each text."""
    p = np.flatnonzero(buf[: at[-1]] == 32)
    p = p[p >= at[0]]
    before, after = buf[p - 1], buf[p + 1]
    ok = ~_SPACE[before] & ~_SPACE[after] & ~_LEAD[after]
    high = before >= 128
    ok &= ~(high & (_LEAD[buf[p - 2]] | _LEAD[buf[p - 3]]))
    doc = np.searchsorted(at, p, "right") - 1
    ok &= (p > at[doc]) & (p + 1 < at[doc + 1])
    p, doc = p[ok], doc[ok]
    n = np.bincount(doc, minlength=len(at) - 1) + 1
    first = np.cumsum(n) - n
    begin, end = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
    inner = np.ones(len(begin), bool)
    inner[first] = False
    begin[first], begin[inner] = at[:-1], p + 1
    inner = np.ones(len(begin), bool)
    inner[first + n - 1] = False
    end[first + n - 1], end[inner] = at[1:], p
    return begin, end, n


class UnitTable:
    """Ids of units, found by their bytes. ``encode``: strings, each with its leading space or none, to their ids as bytes.

    ``joined``, if there is one, encodes many units that stand one after the
    other in one byte string, each with its leading space and no other: from
    that string and their lengths to the ids of all and the number of each.
    ``times`` (a power of two) makes the table larger than the usual size.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], dtype: str, joined: Callable[[bytes, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, times: int = 1):
        self.encode, self.dtype, self.joined = encode, np.dtype(dtype), joined
        self.slots, self.full, self.full_ids = SLOTS * times, FULL * times, FULL_IDS * times
        self.size = self.dtype.itemsize
        self._clear()
        self.strings: dict[str, bytes] = {}

    def _clear(self) -> None:
        self.key = np.zeros((3, self.slots), np.uint64)
        self.value = np.full(self.slots, -1, np.int32)
        self.start, self.count, self.n = np.zeros(self.full + 1, np.int64), np.zeros(self.full + 1, np.int32), 0
        self.flat, self.used = np.zeros(self.full_ids, self.dtype), 0

    @staticmethod
    def _keys(buf: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))  # the eight bytes from each place on
        return [words[begin + 8 * j] & _MASK[np.clip(length - 8 * j, 0, 8)] for j in range(3)]

    def _slot(self, k: list[np.ndarray]) -> np.ndarray:
        h = k[0] * _MIX[0] ^ (k[1] + _MIX[1]) * _MIX[2] ^ (k[2] + _MIX[2]) * _MIX[1]
        h ^= h >> np.uint64(32)
        return (h * _MIX[0] >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def find(self, k: list[np.ndarray]) -> np.ndarray:
        """Entry of each key, -1 where there is none. A zero byte ends a key, so lengths need not be compared."""
        at = self._slot(k)
        out = self.value[at]
        same = (self.key[0][at] == k[0]) & (self.key[1][at] == k[1]) & (self.key[2][at] == k[2])
        todo = np.flatnonzero((out >= 0) & ~same)
        out[todo] = -1
        at = at[todo]
        while len(todo):
            at = at + 1 & self.slots - 1
            v = self.value[at]
            same = (self.key[0][at] == k[0][todo]) & (self.key[1][at] == k[1][todo]) & (self.key[2][at] == k[2][todo]) & (v >= 0)
            out[todo[same]] = v[same]
            on = (v >= 0) & ~same
            todo, at = todo[on], at[on]
        return out

    def _flat(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings one after the other, and how many each has."""
        return np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.size

    def _fresh(self, k: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of units that are not known yet: the units in another order, all their ids, the number of each."""
        raw = np.stack(k, 1).view(np.uint8)
        first = raw[:, 0]
        plain = ~_SPACE[first] & ~_LEAD[first] & ~(raw == 32).any(1) if self.joined else np.zeros(len(raw), bool)
        order = np.argsort(~plain, kind="stable")
        k, spaced = [x[order] for x in k], np.full((len(raw), LONG + 1), 32, np.uint8)
        spaced[:, 1:] = raw[order]
        size, raw = np.count_nonzero(spaced, 1), spaced[spaced != 0].tobytes()  # no unit holds a zero byte
        n = int(plain.sum())
        at = np.cumsum(size) - size
        ids, counts = self.joined(raw, size[:n]) if n else self._flat([])
        more, others = self._flat(self.encode([raw[a : a + m].decode() for a, m in zip(at[n:].tolist(), size[n:].tolist(), strict=True)]) if n < len(order) else [])
        return k, np.concatenate([ids, more]), np.concatenate([counts, others])

    def _add(self, k: list[np.ndarray], ids: np.ndarray, lengths: np.ndarray) -> None:
        """New distinct keys with their ids."""
        n, total = len(lengths), len(ids)
        entry = np.arange(self.n, self.n + n, dtype=np.int32)
        self.start[entry] = self.used + np.cumsum(lengths) - lengths
        self.count[entry] = lengths
        self.flat[self.used : self.used + total] = ids
        self.n, self.used = self.n + n, self.used + total
        at, todo = self._slot(k), np.arange(n)
        while len(todo):
            free = self.value[at] < 0
            self.value[at[free]] = entry[todo[free]]  # of several, the last stays
            won = self.value[at] == entry[todo]
            for j in range(3):
                self.key[j][at[won]] = k[j][todo[won]]
            todo, at = todo[~won], at[~won] + 1 & self.slots - 1

    def _strings(self, texts: list[str]) -> list[bytes]:
        """Ids of strings that are not kept in the table."""
        new = [t for t in dict.fromkeys(texts) if t not in self.strings]
        if len(self.strings) + len(new) > 100_000:
            self.strings.clear()
            new = list(dict.fromkeys(texts))
        self.strings.update(zip(new, self.encode(new), strict=True))
        return [self.strings[t] for t in texts]

    def _without_table(self, raw: bytes, begin: np.ndarray, end: np.ndarray, head: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with more new units than the table holds, some units at a time."""
        spans, parts, counts = list(zip(head.tolist(), begin.tolist(), end.tolist(), strict=True)), [], []
        for i in range(0, len(spans), 50_000):
            ids = self._strings([("" if h else " ") + raw[a:b].decode() for h, a, b in spans[i : i + 50_000]])
            parts.append(b"".join(ids))
            counts += map(len, ids)
        upto = np.cumsum(np.array(counts, np.int64) // self.size)[np.cumsum(n) - 1]
        return np.frombuffer(b"".join(parts), self.dtype), np.diff(upto, prepend=0)

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        buf, at = text_bytes(col)
        begin, end, n = cut(buf, at)
        length = end - begin
        head = np.zeros(len(begin), bool)
        head[np.cumsum(n) - n] = True
        # a key ends at its first zero byte, so units that hold one are not for the table
        short = ~head & (length <= LONG) & (length > 0)
        if not buf[at[0] : at[-1]].all():
            zeros = np.concatenate([[0], np.cumsum(buf[: at[-1]] == 0)])
            short &= zeros[end] == zeros[begin]
        short = np.flatnonzero(short)
        raw = buf.tobytes()
        k = self._keys(buf, begin[short], length[short])
        entry = self.find(k)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            order = miss[np.lexsort([k[j][miss] for j in range(3)])]
            same = np.zeros(len(order), bool)
            same[1:] = True
            for j in range(3):
                same[1:] &= k[j][order[1:]] == k[j][order[:-1]]
            fresh, ids, lengths = self._fresh([x[order[~same]] for x in k])
            if self.n + len(lengths) > self.full or self.used + len(ids) > self.full_ids:
                self._clear()
                if len(lengths) > self.full or len(ids) > self.full_ids:
                    return self._without_table(raw, begin, end, head, n)
                self._add(fresh, ids, lengths)
                return self.ids(col)
            self._add(fresh, ids, lengths)
            entry[miss] = self.find([x[miss] for x in k])
        counts, source = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        counts[short], source[short] = self.count[entry], self.start[entry]
        rest = np.ones(len(begin), bool)
        rest[short] = False
        rest = np.flatnonzero(rest)
        texts = [("" if h else " ") + raw[a:b].decode() for h, a, b in zip(head[rest].tolist(), begin[rest].tolist(), end[rest].tolist(), strict=True)]
        more, counts[rest] = self._flat(self._strings(texts))
        source[rest] = self.used + np.cumsum(counts[rest]) - counts[rest]
        if self.used + len(more) <= self.full_ids:
            self.flat[self.used : self.used + len(more)] = more  # for this call, as they are not counted as used
            pool = self.flat
        else:
            pool = np.concatenate([self.flat[: self.used], more])
        place = np.cumsum(counts)
        out = pool[np.repeat(source - place + counts, counts) + np.arange(place[-1] if len(place) else 0)]
        last = np.cumsum(n) - 1
        upto = place[last] if len(last) else place
        return out, np.diff(upto, prepend=0)
