"""Vectorised work on the bytes of many texts at once (numpy, per Arrow batch).

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; UTF-8 never uses those
bytes inside a character, so byte runs and character runs are the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Odd multipliers of the places of a window of words, by rule.
_PLACES = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1) ** 3) & (2**64 - 1) | 1 for i in range(64)], dtype=np.uint64)
_STEP = np.uint64(0xBF58476D1CE4E5B9)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_HELD = np.array([2 ** (8 * i) - 1 for i in range(9)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    found = _powers.get(name)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        found[0] = 1
        found = np.cumprod(found, dtype=np.uint64)
        _powers[name] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, most: int = 1 << 20):
    """(first row, bytes, starts) of runs of rows that hold about ``most`` bytes.

    ``starts`` has a last entry, the length of the bytes.  A null text is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    column = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


#: Letters, digits and every byte of a character beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def words(raw: np.ndarray, starts: np.ndarray, inks: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of every word, in order.

    ``inks`` tells which bytes are within words.
    """
    if len(raw) == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    ink = inks[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[starts] = True  # a word does not go on into the next row
    before = np.concatenate([[False], ink[:-1]])
    first = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.concatenate([ink[1:], [False]])
    last = np.flatnonzero(ink & (~after | edge[1:])) + 1
    row = np.searchsorted(starts, first, side="right") - 1
    return first, last, row


def spans_hash(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by their content alone.

    Eight bytes at a time go through ``mix``, so no algebra of the bytes makes
    two spans alike; spans of more than 512 bytes are hashed by BLAKE2.
    """
    size = last - first
    out = mix(size.astype(np.uint64) + _BASE)
    if not len(out):
        return out
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    out = mix(out ^ (eights[first] & _HELD[np.minimum(size, 8)]))
    at = np.flatnonzero((size > 8) & (size <= 512))
    done = 8
    while len(at):
        out[at] = mix(out[at] * _STEP ^ (eights[first[at] + done] & _HELD[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > 512).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def every_hash(raw: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes (a multiple of 8) from each place on, by pairs of halves."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    level, have, left, out, at = mix(np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,)).copy()), 8, size // 8, None, 0
    while True:
        if left & 1:
            part = level[at:]
            out = part if out is None else mix(out[: len(part)] * _STEP ^ part[: len(out)])
            at += have
        left >>= 1
        if not left:
            return out[: len(raw) - size + 1]
        level = mix(level[:-have] * _STEP ^ level[have:])
        have *= 2


def rolling(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and powers that :func:`rolled` takes; ``h`` are numbers that are mixed already."""
    n = len(h) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(h * _power(_BASE, "up", n)[:-1], out=total[1:])
    return total, _power(_INVERSE, "down", n)


def rolled(sums: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the ranges lo .. hi - 1, by their entries alone."""
    total, down = sums
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def windows_hash(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each window of ``k`` words within a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n] * _PLACES[0]
    for j in range(1, k):
        out = out + h[j : j + n] * _PLACES[j]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(out[at]), at


def shingle_sets(raw: np.ndarray, starts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``k``-word shingles of each row, ordered.

    A row with 1 to k-1 words has one shingle, its whole sequence.
    """
    raw = LOWER[raw]
    first, last, row = words(raw, starts)
    h = spans_hash(raw, first, last)
    sh, at = windows_hash(h, row, k)
    own = row[at]
    count = np.bincount(row, minlength=len(starts) - 1)
    if len(few := np.flatnonzero((count > 0) & (count < k))):
        begin = np.cumsum(count) - count
        extra = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = count[few] > j
            extra[has] += h[begin[few[has]] + j] * _PLACES[j]
        extra = mix(extra + _PLACES[k + 8] * count[few].astype(np.uint64))
        sh, own = np.concatenate([sh, extra]), np.concatenate([own, few])
    order = np.lexsort((sh, own))
    sh, own = sh[order], own[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])
    return own[new], sh[new]


def frequent(h: np.ndarray, most: int) -> np.ndarray:
    """Which entries have a value that is there more than ``most`` times.

    A small table of counts, by some bits of the values, rules out nearly all
    others before any are sorted.
    """
    small = (h & np.uint64(0xFFFFF)).astype(np.int32)
    at = np.flatnonzero((np.bincount(small) > most)[small])
    found = np.zeros(len(h), bool)
    if len(at):
        _, name, count = np.unique(h[at], return_inverse=True, return_counts=True)
        found[at] = count[name] > most
    return found


def ragged(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... size[0] of them, then those of lo[1], and so on."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) - np.repeat(ends - size - lo, size)
