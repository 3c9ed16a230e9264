"""Array hashing of words, byte strings and runs of them.

Every function takes the values buffer of an Arrow string column and works on a
whole slice of rows at once.  Hashes are polynomials modulo 2**64 with an odd
base over randomly drawn symbols, so the hash of any run is a difference of two
prefix sums; a final mix spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once; only the work space depends on it.
SLICE_BYTES = 1 << 19

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def symbols(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, np.uint64, endpoint=False)


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; the argument may be overwritten."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Runs:
    """Hashes of runs of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power("up", _BASE, n + 1)[:n], out=self.sums[1:])
        self.down = _power("down", _INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the runs [start, end), lengths taken in."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def sliding(self, length: int) -> np.ndarray:
        """Of every run of this length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64((length * 0xD6E8FEB86659FD93) % (1 << 64)))


def values_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column's rows, end to end, and the rows' offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32, len(column) + 1, column.offset * (8 if large else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in runs of about `limit` bytes of text, a longer text alone: the rows, their bytes and offsets."""
    for batch in batches:
        data, at = values_of(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def words_of(data: np.ndarray, at: np.ndarray, space: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends in the bytes, and the number of words before each row (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[1:n] |= ~inside[: n - 1]
    starts = np.flatnonzero(inside & edge[:n])
    edge[:] = False
    edge[at] = True
    edge[1:n] |= ~inside[1:]
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    return Runs(symbols(seed)[data]).of(starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Anchors:
    """Runs of windows that agree on their least k-gram, over a slice of rows.

    A window is `length` consecutive symbols of one row.  Its anchor is the
    k-gram inside it of the least hash, the leftmost of equal ones.  Equal
    windows have equal anchors at equal distances, and different places of a
    window have different places of its anchor, so a window occurs no more
    often than its anchor does.  All windows of one anchor start side by side.
    Attributes, one entry for each anchor: row, first (of its windows' starts,
    in symbols of the slice), count (of windows), place (of the k-gram), key
    (its hash) and whole (hash of the symbols that its windows cover, and of
    their number).
    """

    def __init__(self, values: np.ndarray, begins: np.ndarray, length: int, k: int):
        self.runs = Runs(values)
        grams = self.runs.sliding(k)
        n = len(values) - length + 1
        empty = np.zeros(0, np.int64)
        self.row = self.first = self.count = self.place = empty
        self.key = self.whole = empty.astype(np.uint64)
        if n <= 0:
            return
        place = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least = (sliding_min(place, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
        # windows that leave their row are none
        sizes = np.diff(begins)
        row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
        windows = np.maximum(sizes - length + 1, 0)
        start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begins[:-1], windows)
        if not len(start):
            return
        anchor = least[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        self.row, self.first, self.place = row[head], start[head], anchor[head]
        self.count = np.diff(np.append(head, len(start)))
        self.key = grams[anchor[head]]
        self.whole = self.runs.of(self.first, self.first + self.count - 1 + length)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
