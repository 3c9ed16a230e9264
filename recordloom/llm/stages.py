"""Reading sorted partitions in groups, and texts that travel compressed; intermediate tables come from sources.stored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import forget, shared_dir, stored

__all__ = ["forget", "groups_of", "new_groups", "partitions", "shared_dir", "squeezed", "stored", "unsqueezed"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_groups(*keys: np.ndarray) -> np.ndarray:
    """True where a row's keys differ from the row before; the first row is True."""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        out[0] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def groups_of(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `keys`: each but the last ends where a group ends.

    A group larger than a batch is gathered first, so use this only where groups are bounded.
    """
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        heads = np.flatnonzero(new_groups(*cols))
        first = tuple(c[0] for c in cols)
        if kept and first != last:
            yield pa.Table.from_batches(kept)
            kept = []
        cut = int(heads[-1])
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
        last = tuple(c[-1] for c in cols)
    if kept:
        yield pa.Table.from_batches(kept)


def squeezed(df: DataFrame, text_col: str) -> DataFrame:
    """df with its text column compressed row by row (null stays null), for a shuffle that texts have to take; see `unsqueezed`."""
    names = df.columns

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if x is None else press.compress(x) for x in batch.column(at).cast(pa.binary()).to_pylist()]
            arrays = [pa.array(texts, pa.binary()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, fields)


def unsqueezed(batches, text_col: str, limit: int = 8 << 20):
    """Batches with the text column's texts again, some `limit` bytes of them at a time."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        texts, size, begin = [], 0, 0
        for row, x in enumerate(batch.column(at)):
            data = x.as_py()
            texts.append(None if data is None else press.decompress(data))
            size += len(texts[-1] or b"")
            if size >= limit or row + 1 == batch.num_rows:
                part = batch.slice(begin, row + 1 - begin)
                arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
                texts, size, begin = [], 0, row + 1
