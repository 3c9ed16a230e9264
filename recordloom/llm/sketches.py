"""A count-min sketch over all partitions, held as one bit for each cell: counted twice or more.

Each task sketches its own keys; the tasks' cells meet in Spark by block of
cells and are added there, in work space that does not depend on the rows.
What is left of it, `rows * 2**log2_width` bits at most, is of a size that is
fixed before any row is read, so it can be broadcast, compressed and without
the blocks that hold no bit.  An estimate is never below the count: a key that
occurs twice has all its cells counted twice.  With more keys than cells the
sketch only filters less, so what follows it must not rely on it for its size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .stages import partitions

_BLOCK = 16
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_PARTS = pa.schema([("block", pa.int64()), ("cells", pa.binary())])
_BITS = pa.schema([("block", pa.int64()), ("bits", pa.binary())])
_opened: dict[str, np.ndarray] = {}


def cells(keys: np.ndarray, row: int, log2_width: int) -> np.ndarray:
    return (keys * np.uint64(_MULTIPLIERS[row])) >> np.uint64(64 - log2_width)


def _gaps(low: np.ndarray) -> bytes:
    """Ascending cells of a block as gaps of one byte; 255 means go on by 255 without a cell."""
    gap = np.diff(low.astype(np.int64), prepend=0)
    ends = np.cumsum(gap // 255 + 1)
    out = np.full(int(ends[-1]), 255, np.uint8)
    out[ends - 1] = gap % 255
    return out.tobytes()


def _cells_of(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


class PartSketch:
    """One task's counts, kept as its cells; a cell's third and later counts are not needed."""

    def __init__(self, rows: int, log2_width: int):
        self.rows, self.log2_width = rows, log2_width
        self.kept: list[list[np.ndarray]] = [[] for _ in range(rows)]
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        for row in range(self.rows):
            self.kept[row].append(cells(keys, row, self.log2_width).astype(np.uint32))
        self.size += len(keys)

    def batches(self):
        """The counted cells by block; empties the sketch."""
        for row in range(self.rows):
            at = np.sort(np.concatenate(self.kept[row])) if self.kept[row] else np.zeros(0, np.uint32)
            if len(at) > 2:
                at = at[np.append([True, True], at[2:] != at[:-2])]
            block = at >> np.uint32(_BLOCK)
            heads = np.flatnonzero(np.append([True], block[1:] != block[:-1])) if len(at) else np.zeros(0, int)
            low = at.astype(np.uint16)
            ends = np.append(heads[1:], len(at))
            ids = block[heads].astype(np.int64) + (row << (self.log2_width - _BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([_gaps(low[s:e]) for s, e in zip(heads, ends)], pa.binary())], schema=_PARTS)
        self.kept, self.size = [[] for _ in range(self.rows)], 0


def merged(parts: DataFrame, rows: int, log2_width: int, least: int = 2) -> "Sketch":
    """Add the tasks' cells and keep, for each cell, whether its count reaches `least`."""

    def bits_of(block, count):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([zstandard.compress(np.packbits(count >= least, bitorder="little").tobytes(), 1)])], schema=_BITS)

    def add(batches):
        count, now = np.zeros(1 << _BLOCK, np.uint8), None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now:
                    if (count >= least).any():
                        yield bits_of(now, count)
                    count[:] = 0
                now = block
                at = _cells_of(np.frombuffer(data.as_buffer(), np.uint8))
                first = np.append([True], at[1:] != at[:-1])
                once, twice = at[first], at[~first]
                count[once] = np.minimum(count[once] + 1, 2)
                count[twice] = 2
        if (count >= least).any():
            yield bits_of(now, count)

    spark = parts.sparkSession
    dealt = parts.repartition(partitions(spark), "block").sortWithinPartitions("block")
    blocks = [(r.block, bytes(r.bits)) for r in dealt.mapInArrow(add, "block long, bits binary").collect()]
    return Sketch(spark.sparkContext.broadcast(blocks), rows, log2_width)


class Sketch:
    """The merged sketch on the executors: blocks that hold a bit, compressed, opened once in each task.

    A task closes what it has opened: a worker that waits for its next task
    would else hold the bits through stages that don't read them.
    """

    def __init__(self, blocks, rows: int, log2_width: int):
        self.blocks, self.rows, self.log2_width, self.name = blocks, rows, log2_width, uuid.uuid4().hex

    def bits(self) -> np.ndarray:
        if self.name not in _opened:
            # pages without a bit are never touched, so they take no memory
            bits, step = np.zeros((self.rows << self.log2_width) >> 3, np.uint8), (1 << _BLOCK) >> 3
            for block, data in self.blocks.value:
                bits[block * step : (block + 1) * step] = np.frombuffer(zstandard.decompress(data), np.uint8)
            _opened[self.name] = bits
        return _opened[self.name]

    def close(self) -> None:
        """Gives up the bits that this worker has opened."""
        _opened.pop(self.name, None)

    def reaches(self, keys: np.ndarray) -> np.ndarray:
        """Where the estimated count reaches the limit that the sketch was merged with."""
        bits, out = self.bits(), np.ones(len(keys), bool)
        for row in range(self.rows):
            at = cells(keys, row, self.log2_width) + np.uint64(row << self.log2_width)
            out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def free(self) -> None:
        """To be called when the last query that reads the sketch has run."""
        self.blocks.destroy()
