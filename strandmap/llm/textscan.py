"""Vectorised scans over the bytes of a batch of texts.

Texts arrive as one Arrow string array; everything below works on its value buffer with numpy, so no Python
object is made per word.  Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# The primes of the public XXH64 specification.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)

#: Windows hashed at a time; bounds the scratch memory whatever a text's length.
WINDOWS = 1 << 17


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and row offsets of a string array; nulls are empty rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    # The array's own buffers are read; only the offsets are copied.
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = texts.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return values, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        out.append((lo, hi))
        lo = hi
    return out


class Words:
    """Words of a batch, each followed by one space in ``buf``; ``row_first[r]`` is the index of row r's first word."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n_rows = len(offsets) - 1
        if lower:
            values = np.where((values >= 65) & (values <= 90), values + np.uint8(32), values)
        is_word = ~((values == 32) | ((values >= 9) & (values <= 13)))
        starts_here = is_word.copy()
        starts_here[1:] &= ~is_word[:-1]
        edges = offsets[:-1][(offsets[:-1] < len(values))]
        starts_here[edges] = is_word[edges]
        src_start = np.flatnonzero(starts_here)
        # A word ends before the next separator, the next row, or the end.
        stop = np.ones(len(values) + 1, bool)
        stop[:-1] = ~is_word
        stop[offsets] = True
        stops = np.flatnonzero(stop)
        src_end = stops[np.searchsorted(stops, src_start, "right")] if len(src_start) else src_start
        self.src_start, self.src_end = src_start, src_end
        length = src_end - src_start
        self.start = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1] + 1, out=self.start[1:])
        self.end = self.start + length
        total = int(self.end[-1]) + 1 if len(length) else 0
        self.buf = np.full(total + 16, 32, np.uint8)
        keep = np.ones(total, bool)
        keep[self.end] = False
        self.buf[:total][keep] = values[is_word]
        self.row_first = np.searchsorted(src_start, offsets).astype(np.int64)
        self.counts = np.diff(self.row_first)
        self.n_rows = n_rows

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each k-word shingle in ``buf``, and shingles per row (a shorter row is one shingle, an empty row none)."""
        per_row = np.where(self.counts >= k, self.counts - k + 1, (self.counts > 0).astype(np.int64))
        row = np.repeat(np.arange(self.n_rows), per_row)
        base = np.zeros(self.n_rows + 1, np.int64)
        np.cumsum(per_row, out=base[1:])
        first = self.row_first[:-1][row] + (np.arange(base[-1]) - base[:-1][row])
        last = first + np.minimum(self.counts[row], k) - 1
        return self.start[first], self.end[last], per_row


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each window ``buf[start:end]``; buf must have 16 spare bytes at its end."""
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(start), WINDOWS):
            out[lo : lo + WINDOWS] = _xxh64(buf, start[lo : lo + WINDOWS], end[lo : lo + WINDOWS], np.uint64(seed))
    return out


def _xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64) -> np.ndarray:
    w8 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    w4 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    length = (end - start).astype(np.int64)
    pos = start.astype(np.int64).copy()
    h = np.full(len(start), seed + P5, np.uint64)

    big = np.flatnonzero(length >= 32)
    if len(big):
        p, left = pos[big], length[big] // 32
        acc = [np.full(len(big), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        act = np.arange(len(big))
        while len(act):
            for j in range(4):
                acc[j][act] = _rot(acc[j][act] + w8[p[act] + 8 * j] * P2, 31) * P1
            p[act] += 32
            left[act] -= 1
            act = act[left[act] > 0]
        hb = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for a in acc:
            hb = (hb ^ (_rot(a * P2, 31) * P1)) * P1 + P4
        h[big], pos[big] = hb, p
    h += length.astype(np.uint64)

    rest = end - pos
    for _ in range(3):
        m = np.flatnonzero(rest >= 8)
        if not len(m):
            break
        h[m] = _rot(h[m] ^ (_rot(w8[pos[m]] * P2, 31) * P1), 27) * P1 + P4
        pos[m] += 8
        rest[m] -= 8
    m = np.flatnonzero(rest >= 4)
    if len(m):
        h[m] = _rot(h[m] ^ (w4[pos[m]].astype(np.uint64) * P1), 23) * P2 + P3
        pos[m] += 4
        rest[m] -= 4
    for _ in range(3):
        m = np.flatnonzero(rest >= 1)
        if not len(m):
            break
        h[m] = _rot(h[m] ^ (buf[pos[m]].astype(np.uint64) * P5), 11) * P1
        pos[m] += 1
        rest[m] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


def simhash(values: np.ndarray, offsets: np.ndarray, k: int, words: int = 1) -> np.ndarray:
    """64-bit SimHash of each row: a bit is 1 if set in over half of the row's k-word shingle hashes.

    With more ``words`` the result is (rows, words): the first is as above, others are of the same hashes mixed anew.
    """
    out = np.zeros((len(offsets) - 1, words), np.uint64)
    for lo, hi in slices(offsets):
        scan = Words(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        start, end, per_row = scan.shingles(k)
        ones = np.zeros((hi - lo, words, 64), np.int64)
        base = np.zeros(hi - lo + 1, np.int64)
        np.cumsum(per_row, out=base[1:])
        for a in range(0, len(start), WINDOWS):
            b = min(a + WINDOWS, len(start))
            h = xxh64(scan.buf, start[a:b], end[a:b])
            r0, r1 = int(np.searchsorted(base, a, "right")) - 1, int(np.searchsorted(base, b, "left"))
            rows = np.flatnonzero(per_row[r0:r1]) + r0
            at = np.maximum(base[rows], a) - a
            for w in range(words):
                bits = np.unpackbits(_mixed(h, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[rows, w] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        on = 2 * ones > per_row[:, None, None]
        out[lo:hi] = np.packbits(on, axis=2, bitorder="little").view("<u8")[:, :, 0]
    return out[:, 0] if words == 1 else out


def _mixed(h: np.ndarray, w: int) -> np.ndarray:
    """The w-th hash made of a hash; the 0th is itself."""
    if not w:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ (np.uint64(w) * P1)) * P2
        h ^= h >> np.uint64(31)
        h *= P3 | np.uint64(1)
        return h ^ (h >> np.uint64(29))


def shingle_sets(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingle hashes of each row, sorted, end to end; and their number in each row."""
    sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(offsets):
        scan = Words(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        start, end, per_row = scan.shingles(k)
        h = xxh64(scan.buf, start, end)
        ends = np.cumsum(per_row)
        for a, b in zip(ends - per_row, ends, strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[(ends - per_row)[per_row > 0]] = True
        sets.append(h[new])
        total = np.concatenate([[0], np.cumsum(new)])
        sizes.append(total[ends] - total[ends - per_row])
    return np.concatenate(sets), np.concatenate(sizes)


def majority(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each set of hashes, laid end to end: a bit is 1 if set in over half of them; 0 for an empty set."""
    out = np.zeros(len(sizes), np.uint64)
    rows = np.flatnonzero(sizes)
    ones = np.zeros((len(rows), 64), np.int64)
    ends = np.cumsum(sizes[rows])
    for a in range(0, len(sets), WINDOWS):
        b = min(a + WINDOWS, len(sets))
        bits = np.unpackbits(sets[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r0, r1 = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1
        starts = np.maximum(ends[r0:r1] - sizes[rows[r0:r1]], a) - a
        ones[r0:r1] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[rows] = np.packbits(2 * ones > sizes[rows][:, None], axis=1, bitorder="little").view("<u8")[:, 0] if len(rows) else out[rows]
    return out


def minima(sets: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The least value of each non-empty set, which begin at ``starts``, under each of ``count`` orders: (sets, count)."""
    out = np.empty((len(starts), count), np.uint64)
    with np.errstate(over="ignore"):
        for i, odd in enumerate(_mixed(np.arange(1, count + 1, dtype=np.uint64), 1) | np.uint64(1)):
            out[:, i] = np.minimum.reduceat(sets * odd, starts)
    return out
