"""Vectorised byte-level text work on Arrow batches: words, hashes, n-grams.

Everything runs on numpy arrays over a slice of an Arrow string column, whole
texts at a time; a slice holds about SLICE_BYTES, so memory stays bounded
however large a batch is (one text longer than that is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_bytes: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _tables.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 4096)
        base = _BASES[which]
        inv = pow(base, -1, 1 << 64)
        up, down = np.full(n, base, np.uint64), np.full(n, inv, np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= 8 * SLICE_BYTES:
            _tables[which] = have
    return have


def byte_values(which: int = 0) -> np.ndarray:
    """A pseudo-random 64-bit value per byte."""
    if which not in _bytes:
        _bytes[which] = mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * which)) * _GOLD)
    return _bytes[which]


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of values weighted by powers; range_hash() reads ranges off them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values) + 1, which)[0][: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of values, the same wherever it stands."""
    return mix((sums[end] - sums[start]) * _powers(len(sums), which)[1][start])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that [^\x00-\x2F\x3A-\x60\x7B-\x7F] excludes: what is not a digit, a-z or beyond ASCII.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Slice:
    """Whole texts of consecutive rows: buf holds their bytes, off[k]:off[k+1] those of row lo + k."""

    def __init__(self, lo: int, buf: np.ndarray, off: np.ndarray):
        self.lo, self.buf, self.off = lo, buf, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words in buf, and for each row the index of its first word (and the end)."""
        word = ~separators[self.buf]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        inner = self.off[:-1][self.off[:-1] < len(word)]
        before[inner] = False
        start = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        last = self.off[1:][self.off[1:] > 0] - 1
        after[last] = False
        end = np.flatnonzero(word & ~after) + 1
        return start, end, np.searchsorted(start, self.off)

    def hashes(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return range_hash(prefix_sums(byte_values(which)[self.buf], which), start, end, which)


def slices(column: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string (or binary) column into slices of about size bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        part = buf[off[lo] : off[hi]]
        yield Slice(lo, LOWER[part] if lower else part, off[lo : hi + 1] - off[lo])
        lo = hi


def gram_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive values (those across texts are the caller's to leave out)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - n + 1)
    return range_hash(prefix_sums(words, which), at, at + n, which)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the signed 64-bit integers that Spark has."""
    return x.view(np.int64)


#: Low bits of a hash that give way to the position where runs are compared.
_PLACE = 20


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """For each run of w consecutive hashes the index of its smallest one by all but the last 20 bits, the first on ties."""
    n = len(v)
    if n < w:
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << _PLACE) - 1)
    out = np.empty(n - w + 1, np.int64)
    # hash and place in one number, so that a minimum is all it takes; in pieces whose places fit
    step = max(1, (1 << _PLACE) - w)
    for lo in range(0, n - w + 1, step):
        x = (v[lo : min(n, lo + step + w - 1)] & ~mask) | np.arange(min(n - lo, step + w - 1), dtype=np.uint64)
        m, have = len(x) - w + 1, 1
        while have * 2 <= w:
            x = np.minimum(x[: len(x) - have], x[have:])
            have *= 2
        x = np.minimum(x[:m], x[w - have : w - have + m])
        out[lo : lo + m] = (x & mask).astype(np.int64) + lo
    return out


def window_starts(first: np.ndarray, w: int) -> np.ndarray:
    """Marks the positions (over all rows of a slice) at which a run of w values stays in its row."""
    ok = np.ones(int(first[-1]), bool)
    for end in first[1:]:
        ok[max(0, int(end) - w + 1) : int(end)] = False
    return ok
