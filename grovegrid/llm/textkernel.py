"""Vectorised word splitting and hashing of Arrow text columns.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes with A-Z lower-cased. A word's 64-bit hash is a
polynomial over random byte codes modulo 2**64, then mixed; a shingle's hash mixes those of its words.
Equal words have equal hashes always; different ones collide with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_WORD_CODE = _CODES[LOWER].copy()
_WORD_CODE[SPACE] = 0
_RAW_CODE = _CODES.copy()
_RAW_CODE[SPACE] = 0
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64-bit words."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class Words:
    """Words of some texts: data (bytes), start, end (byte bounds), hash, off (a text's first word, and the end)."""

    __slots__ = ("data", "start", "end", "hash", "off", "byte_off")

    def __init__(self, data, start, end, hashes, off, byte_off):
        self.data, self.start, self.end, self.hash, self.off, self.byte_off = data, start, end, hashes, off, byte_off


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def split(data: np.ndarray, off: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """Words of the texts data[off[i]:off[i+1]]; off starts at 0. A longer text than CHUNK is worked on in parts cut at white space."""
    if len(data) > 2 * CHUNK:
        cuts = [0]
        while len(data) - cuts[-1] > 2 * CHUNK:
            gap = np.flatnonzero(SPACE[data[cuts[-1] + CHUNK : cuts[-1] + 2 * CHUNK]])
            if not len(gap):
                break
            cuts.append(cuts[-1] + CHUNK + int(gap[0]))
        if len(cuts) > 1:
            parts = []
            for lo, hi in zip(cuts, [*cuts[1:], len(data)], strict=True):
                inner = off[(off > lo) & (off < hi)] - lo
                w = split(data[lo:hi], np.concatenate(([0], inner, [hi - lo])), lower, hashed)
                parts.append((w.start + lo, w.end + lo, w.hash))
            start, end = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            return Words(data, start, end, np.concatenate([p[2] for p in parts]) if hashed else None, np.searchsorted(start, off), off)
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = None
    if hashed:
        if len(start):
            up, down = _powers(n)
            h = mix(np.add.reduceat((_WORD_CODE if lower else _RAW_CODE)[data] * up[:n], start) * down[start])
        else:
            h = np.zeros(0, np.uint64)
    return Words(data, start, end, h, np.searchsorted(start, off), off)


def texts(column: pa.Array, lower: bool = True, hashed: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) for chunks of a text column."""
    data, off = flat(column)
    for lo, hi in chunks(off):
        yield lo, hi, split(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower, hashed)


_STEP = [U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(64)]


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and each text's bounds in them.

    A text of fewer than k words has one shingle, its whole sequence; a text without words has none.
    """
    h, off = words.hash, words.off
    count = np.diff(off)
    total = np.zeros(len(h), np.uint64)
    for j in range(k):
        m = len(h) - j
        if m <= 0:
            break
        total[:m] += h[j:] * _STEP[j]
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    first = np.repeat(off[:-1] - bounds[:-1], made) + np.arange(bounds[-1])
    out = total[first]
    for i in np.flatnonzero((count > 0) & (count < k)):
        seq = h[off[i] : off[i + 1]]
        out[bounds[i]] = np.add.reduce(seq * np.array(_STEP[: len(seq)], np.uint64), dtype=np.uint64)
        out[bounds[i] : bounds[i] + 1] += np.full(1, count[i], np.uint64) * U(0xA0761D6478BD642F)
    return mix(out), bounds


def unique_sorted(h: np.ndarray) -> np.ndarray:
    s = np.sort(h)
    if len(s) > 1:
        s = s[np.concatenate(([True], s[1:] != s[:-1]))]
    return s
