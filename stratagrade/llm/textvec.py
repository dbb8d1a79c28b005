"""Words and hashes of whole Arrow batches of text, computed with numpy.

A batch is handled as one byte buffer; no Python loop runs over words.  Words are
identified by 64-bit polynomial hashes over random byte values, finished with a
multiplicative mixer, so that equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

np.seterr(over="ignore")

CHUNK = 1 << 20
_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64) | _U(1)

#: Bytes that separate words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside [0-9A-Za-z\x80-\xff].
NOT_ALNUM = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, CHUNK + 1)
        _power, _inverse = (np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, r, np.uint64)))) for r in (_R, _R_INV))
    return _power, _inverse


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h + _U((salt * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Texts:
    """Some whole texts, back to back in one buffer; `at` holds n + 1 offsets."""

    def __init__(self, buffer: np.ndarray, at: np.ndarray, first: int):
        self.buffer, self.at, self.first = buffer, at, first

    def __len__(self) -> int:
        return len(self.at) - 1

    def runs(self, inside: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of True, never across texts, and
        for each text the index of its first run (n + 1 values).

        `cut` marks bytes before which a run ends as well.
        """
        n = len(inside)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.at), np.int64)
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = ~inside[:-1]
        fresh[self.at] = True
        if cut is not None:
            fresh[:n] |= cut
        start = np.flatnonzero(inside & fresh[:n])
        ends = fresh[1:].copy()
        ends[: n - 1] |= ~inside[1:]
        end = np.flatnonzero(inside & ends) + 1
        return start, end, np.searchsorted(start, self.at)

    def words(self, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~separators[self.buffer])


def hashed(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        part = buffer[base : end[j - 1]]
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * power[: len(part)], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * inverse[s], 0) + (e - s).astype(np.uint64)
        i = j
    return mix(out, 1)


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[Texts]:
    """The texts of a string or binary column (null: empty), in blocks of about
    `most` bytes; a longer text is a block of its own."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield Texts(buffer[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def windows(words: np.ndarray, at: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and n_texts + 1 offsets.

    With `whole`, a text of 1 to n - 1 words gives one hash of all its words.
    """
    count = np.diff(at)
    full = np.maximum(count - n + 1, 0)
    short = (count > 0) & (count < n) if whole else np.zeros(len(count), bool)
    kept = np.where(short, 1, full)
    out_at = np.concatenate(([0], np.cumsum(kept)))
    if len(words) >= n:
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h += words[k : k + len(h)] * _U(mult(k))
        owner = np.repeat(np.arange(len(count)), count)[: len(h)]
        inside = np.arange(len(h)) - at[:-1][owner] < full[owner]
        dense = h[inside]
    else:
        dense = np.zeros(0, np.uint64)
    if not short.any():
        return mix(dense, n), out_at
    out = np.empty(out_at[-1], np.uint64)
    is_short = np.repeat(short, kept)
    out[~is_short] = mix(dense, n)
    for i in np.flatnonzero(short):
        w = words[at[i] : at[i + 1]]
        out[out_at[i]] = mix(sum((w[k : k + 1] * _U(mult(k)) for k in range(len(w))), np.zeros(1, np.uint64)), len(w))[0]
    return out, out_at


def mult(k: int) -> int:
    """The odd factor of the k-th word of a window."""
    return (0xC2B2AE3D27D4EB4F * (2 * k + 1) + 0x27D4EB2F165667C5 * k * k * 2) & 0xFFFFFFFFFFFFFFFF | 1


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the slices values[at[i]:at[i+1]] (0 for empty ones)."""
    total = np.cumsum(values, dtype=values.dtype)
    total = np.concatenate((np.zeros(1, total.dtype), total))
    return total[at[1:]] - total[at[:-1]]
