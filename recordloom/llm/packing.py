"""Packing of token sequences: patterns of few documents fitted to the length histogram, then best fit.

Only the histogram of piece lengths, of at most CAPACITY entries, reaches the
driver.  There, patterns of one to four lengths that fill a sequence (nearly)
are enumerated, non-negative least squares fits how often each is used, counts
are rounded down to what is there, and what is left, a few pieces of each
length, is placed by best fit, longest first, into the gaps and new sequences.
The plan says, for each length, which run of its pieces goes where; it is as
long as there are patterns and lengths, not pieces.  Spark numbers the pieces
of each length and looks their places up.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices
from .sharding import numbered
from .stages import forget, stored

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
ROUNDS = 400

_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_coders: dict = {}


def coder(vocabulary: str | None = None, ranks: str | None = None):
    """texts -> arrays of ids, as encode(text, add_special_tokens=False) of the tokenizer file `vocabulary` gives them.

    With a file of the same vocabulary as `ranks`, a faster library does texts
    of characters on which the two libraries' splitting agrees.  A text that
    holds an added token of the file, such as an end marker, gets that token's
    id there, so it goes to the tokenizer itself.
    """
    key = (vocabulary, ranks)
    if key not in _coders:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(vocabulary or public_tokenizers.path(VOCABULARY))
        added = [t.content for t in exact.get_added_tokens_decoder().values()]
        path = ranks or public_tokenizers.path(RANKS)
        with open(path, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        plain = regex.compile(r"[\t\n\r\x20-\x7E¡-¬®-ɏ]*")

        def encode(text: str) -> np.ndarray:
            if plain.fullmatch(text) and not any(t in text for t in added):
                return np.array(fast.encode_ordinary(text), np.uint32)
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

        _coders.clear()
        _coders[key] = encode
    return _coders[key]


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32: each text's ids and an id 0, whole, or cut into full pieces behind a shorter first one.

    A null text counts as empty, which is one piece of the id 0; repeated rows
    are cut as often as they come, a null id stays null, an empty table stays
    empty.  No other columns come out, so none can clash.
    """

    def run(batches):
        encode = coder(vocabulary, ranks)
        for batch, data, at in slices(batches, "text"):
            columns: tuple = ([], [], [], [], [])
            raw = data.tobytes()
            for i in range(batch.num_rows):
                ids = np.append(encode(raw[at[i] : at[i + 1]].decode()), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    for c, v in zip(columns, (batch.column(0)[i].as_py(), piece, start, end - start, zlib.crc32(ids[start:end].tobytes()))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, most: int = 24) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill a sequence as far as the lengths at hand allow.

    counts: pieces of each length, from 0 to the capacity.
    """
    capacity = len(counts) - 1
    have = np.flatnonzero(counts)
    below = np.zeros(capacity + 1, np.int64)  # the largest length at hand up to each size
    below[have] = have
    below = np.maximum.accumulate(below)
    frequent = have[np.argsort(-counts[have] * have, kind="stable")[: 8 * most]]
    out = [np.array([[a, below[capacity - a], 0, 0] for a in have])]
    for a in have:
        room = capacity - a
        others = frequent[frequent <= room]
        if not len(others):
            continue
        b = others[np.unique(np.linspace(0, len(others) - 1, min(most, len(others))).astype(int))]
        c = below[room - b]
        d = below[room - b - c]
        out.append(np.stack([np.full(len(b), a), b, c, d], 1))
    found = np.unique(np.sort(np.concatenate(out), axis=1)[:, ::-1], axis=0)
    return found


def fitted(found: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with the least squared error of their lengths' histogram, by multiplicative steps."""
    want = counts.astype(float).copy()
    want[0] = 0
    x = np.full(len(found), want.sum() / max(1, 2 * len(found)))
    gain = want[found].sum(1)
    for _ in range(rounds):
        made = np.bincount(found.ravel(), np.repeat(x, found.shape[1]), len(counts))
        made[0] = 0
        x *= gain / np.maximum(made[found].sum(1), 1e-12)
    return x


class Plan:
    """Runs of pieces of one length: length, begin (the first one's number within its length), count, sequence (of the first; the next ones go to the next), offset."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.copy()
        self.left[0] = 0
        self.used = np.zeros_like(self.left)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        self.some = np.zeros(self.capacity + 1, bool)

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def gap(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            self.gaps[room].append((sequence, count))
            self.some[room] = True

    def repeat(self, pattern: np.ndarray, times: int) -> None:
        offset = 0
        for length in pattern[pattern > 0].tolist():
            self.place(length, times, self.sequences, offset)
            offset += length
        self.gap(self.capacity - offset, self.sequences, times)
        self.sequences += times

    def best_fit(self) -> None:
        for length in range(self.capacity, 0, -1):
            while (n := int(self.left[length])) > 0:
                room = length + int(self.some[length:].argmax())
                if self.some[room]:
                    sequence, count = self.gaps[room].pop()
                    self.some[room] = bool(self.gaps[room])
                    k = min(n, count)
                    self.place(length, k, sequence, self.capacity - room)
                    self.gap(room, sequence + k, count - k)
                    self.gap(room - length, sequence, k)
                else:
                    each = self.capacity // length
                    times = max(1, n // each)
                    self.repeat(np.full(min(each, n), length), times)


def planned(counts: np.ndarray) -> Plan:
    plan = Plan(counts)
    if counts[1:].any():
        found = patterns(counts)
        times = fitted(found, counts)
        for i in np.argsort(-times, kind="stable").tolist():
            lengths, each = np.unique(found[i][found[i] > 0], return_counts=True)
            n = min(int(times[i]), int((plan.left[lengths] // each).min()))
            if n > 0:
                plan.repeat(found[i], n)
    plan.best_fit()
    return plan


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; length must be 1 to capacity, other columns stay.

    Equal rows each get a place of their own; an empty table stays empty.  A
    length that is null or outside 1 to capacity is an error.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = np.zeros(capacity + 1, np.int64)
    kept = stored(pieces, "pieces")
    lengths = {r.length: r["count"] for r in kept.groupBy("length").count().where("length BETWEEN 1 AND %d" % capacity).collect()}
    if sum(lengths.values()) != kept.count():
        raise ValueError(f"pieces must be 1 to {capacity} long")
    for length, n in lengths.items():
        counts[length] = n
    plan = planned(counts)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    before = np.cumsum(counts) - counts
    # pieces are numbered by length, so a run's first number tells it apart
    shared = kept.sparkSession.sparkContext.broadcast((before[rows[:, 0]] + rows[:, 1], rows[:, 3], rows[:, 4]))
    ordered = numbered(kept, ["length", "id", "piece"], "__number")
    names = kept.columns
    forget(kept)

    def find(batches):
        begin, sequence, offset = shared.value
        for batch in batches:
            number = batch.column(batch.schema.get_field_index("__number")).to_numpy()
            at = np.searchsorted(begin, number, "right") - 1
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence[at] + number - begin[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return ordered.mapInArrow(find, f"{fields}, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(pieces_of(docs)).withColumnRenamed("id", "doc_id")
