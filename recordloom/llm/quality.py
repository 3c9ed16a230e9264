"""Quality scores from a byte-level convolutional network, trained and applied in numpy.

Each byte of a text is an embedding plus LAGS flags, one for each distance at
which the byte before equals it.  Filters of WIDTH bytes slide over the whole
text by STRIDE, rectified, and are max-pooled over overlapping chunks (each
chunk shares half of itself with the next).  Each chunk's pooled filters give a
logit; their mean over the document, squashed, is the probability.  Embedding,
filters and output layer are learned together by Adam on the log loss.

Training uses a bounded sample: SAMPLE labelled rows of either class, those
whose ids hash least, and up to SEGMENTS chunks of each, evenly spaced over its
text.  Scoring always reads whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import slices, values_of

#: Most training rows of each class, and most chunks of each row.
SAMPLE, SEGMENTS = 800, 4
EMBEDDING, LAGS, WIDTH, STRIDE, FILTERS = 8, 16, 7, 3, 16
#: Filter places in half a chunk.
HALF = 128
LEFT = 18
EPOCHS, BATCH, RATE = 14, 96, 0.01
LIMIT = 0.3
SEED = 5
CHUNK = 2 * HALF * STRIDE

CHANNELS = EMBEDDING + LAGS


def _channels(data: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """Channels of padded bytes, along the last axis but one of the result."""
    x = np.zeros((*data.shape, CHANNELS), np.float32)
    x[..., :EMBEDDING] = embedding[data]
    for lag in range(1, LAGS + 1):
        x[..., lag:, EMBEDDING + lag - 1] = (data[..., lag:] == data[..., :-lag]) & (data[..., lag:] != 0)
    return x


def _windows(x: np.ndarray, places: int) -> np.ndarray:
    """The channels that each filter place sees, from LEFT on."""
    x = np.ascontiguousarray(x)[..., LEFT:, :]
    *lead, _, b = x.strides
    shape = (*x.shape[:-2], places, WIDTH * CHANNELS)
    return np.lib.stride_tricks.as_strided(x, shape, (*lead[: x.ndim - 2], STRIDE * CHANNELS * b, b), writeable=False)


class Network:
    def __init__(self, prior: float = 0.5):
        draw = np.random.default_rng(SEED)
        self.embedding = draw.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = draw.normal(0, (WIDTH * CHANNELS) ** -0.5, (WIDTH * CHANNELS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = draw.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32)
        prior = min(max(prior, 0.01), 0.99)
        self.level = np.array([np.log(prior / (1 - prior))], np.float32)

    @property
    def parts(self):
        return self.embedding, self.filters, self.bias, self.out, self.level

    def fit(self, chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray) -> "Network":
        """chunks: padded bytes, one row for each; doc: each one's document, ascending; label and weight: of documents."""
        draw = np.random.default_rng(SEED)
        first = np.searchsorted(doc, np.arange(len(label) + 1))
        places = CHUNK // STRIDE
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parts]
        step = 0
        for epoch in range(EPOCHS):
            order = draw.permutation(len(label))
            for begin in range(0, len(order), BATCH):
                docs = order[begin : begin + BATCH]
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                owner = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                data, n = chunks[rows], np.bincount(owner, minlength=len(docs))
                windows = _windows(_channels(data, self.embedding), places)
                act = windows.reshape(-1, WIDTH * CHANNELS) @ self.filters
                act = act.reshape(len(rows), places, FILTERS)
                best = act.argmax(axis=1)
                pooled = np.take_along_axis(act, best[:, None, :], 1)[:, 0] + self.bias
                live = pooled > 0
                pooled = np.where(live, pooled, 0)
                logit = np.bincount(owner, pooled @ self.out, len(docs)) / n + self.level[0]
                error = (1 / (1 + np.exp(-logit)) - label[docs]) * weight[docs]
                d_chunk = (error / n)[owner].astype(np.float32) / len(docs)
                d_pooled = d_chunk[:, None] * self.out * live
                seen = windows[np.arange(len(rows))[:, None], best]
                d_filters = np.einsum("cf,cfw->wf", d_pooled, seen)
                d_seen = (d_pooled[:, :, None] * self.filters.T).reshape(len(rows), FILTERS, WIDTH, CHANNELS)[..., :EMBEDDING]
                at = LEFT + best[:, :, None] * STRIDE + np.arange(WIDTH)
                d_embedding = np.zeros_like(self.embedding)
                np.add.at(d_embedding, data[np.arange(len(rows))[:, None, None], at].ravel(), d_seen.reshape(-1, EMBEDDING))
                grads = d_embedding, d_filters, d_pooled.sum(0), (d_chunk[:, None] * pooled).sum(0), np.array([error.mean()], np.float32)
                step += 1
                for p, g, (m, v) in zip(self.parts, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of every text of a slice, over all its chunks."""
        sizes = np.maximum(np.diff(at), 1)
        places = -(-sizes // STRIDE)
        room = -(-(LEFT + places * STRIDE + WIDTH) // STRIDE) * STRIDE
        begin = np.cumsum(room) - room
        padded = np.zeros(int(room.sum()) + WIDTH, np.uint8)
        target = np.arange(len(data)) + np.repeat(begin + LEFT - at[:-1], np.diff(at))
        padded[target] = data
        halves = -(-places // HALF)
        ends = np.cumsum(halves)
        pooled = np.zeros((int(ends[-1]), FILTERS), np.float32)
        # filter places of all texts, in runs of half a chunk
        start = np.repeat((begin + LEFT) // STRIDE, halves) + (np.arange(ends[-1]) - np.repeat(ends - halves, halves)) * HALF
        count = np.minimum(HALF, np.repeat(places, halves) - (np.arange(ends[-1]) - np.repeat(ends - halves, halves)) * HALF)
        group = 64
        for lo in range(0, len(start), group):
            s, c = start[lo : lo + group], count[lo : lo + group]
            first, last = int(s[0]), int(s[-1] + c[-1])
            x = _channels(padded[first * STRIDE - LEFT : last * STRIDE + WIDTH], self.embedding)
            act = _windows(x, last - first).reshape(-1, WIDTH * CHANNELS) @ self.filters
            # places between texts see padding and belong to no run: even entries of the cuts are runs
            cuts = np.stack([s - first, s - first + c], 1).ravel()
            act = np.concatenate([act, np.full((1, FILTERS), -np.inf, np.float32)])
            pooled[lo : lo + group] = np.maximum.reduceat(act, cuts, axis=0)[::2]
        # a chunk is a half and the next one; the last half of a longer text is in the chunk before
        last = np.zeros(len(pooled), bool)
        last[ends - 1] = True
        chunk = pooled.copy()
        chunk[:-1] = np.where(last[:-1, None], pooled[:-1], np.maximum(pooled[:-1], pooled[1:]))
        logits = np.maximum(chunk + self.bias, 0) @ self.out
        used = ~last | np.repeat(halves == 1, halves)
        logit = np.add.reduceat(np.where(used, logits, 0), ends - halves) / np.maximum(halves - 1, 1) + self.level[0]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _segments(batches):
    """Evenly spaced chunks of each text, padded as in training."""
    for batch in batches:
        data, at = values_of(batch.column(2))
        ids, labels, chunks = [], [], []
        for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            n = max(1, min(SEGMENTS, -(-(hi - lo) // CHUNK)))
            for k in range(n):
                begin = lo if n == 1 else lo + (hi - lo - CHUNK) * k // (n - 1)
                part = data[begin : min(begin + CHUNK, hi)].tobytes()
                chunks.append(bytes(LEFT) + part + bytes(CHUNK - len(part) + WIDTH))
                ids.append(batch.column(0)[i])
                labels.append(batch.column(1)[i])
        yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in ids], pa.int64()), pa.array([x.as_py() for x in labels], pa.int32()), pa.array(chunks, pa.binary())], ["id", "label", "chunk"])


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network fitted to `sample` rows of each class outside the held-out fifth; the classes' weights are those of all labelled rows.

    Without labelled rows the score is one half, with one class only its prior.
    Labels that are null or not 0 or 1 and rows without an id don't count;
    a label that is given twice counts once, and repeated rows of a text are
    learned from as often as they come.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    network = Network(counts.get(1, 0) / total if total else 0.5)
    if len(counts) < 2:
        network.out[:] = 0
        return network
    picked = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = some if picked is None else picked.unionAll(some)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = texts.select("id", "label", "text").mapInArrow(_segments, "id long, label int, chunk binary").collect()
    if not rows:
        network.out[:] = 0
        return network
    rows.sort(key=lambda r: (r.id, r.label, bytes(r.chunk)))
    keys = [(r.id, r.label) for r in rows]
    distinct = sorted(set(keys))
    place = {k: i for i, k in enumerate(distinct)}
    label = np.array([k[1] for k in distinct], np.float32)
    share = np.array([(label == v).sum() / max(1, counts[v]) for v in (0, 1)])
    weight = 1 / np.maximum(share[label.astype(int)], 1e-9)
    chunks = np.frombuffer(b"".join(bytes(r.chunk) for r in rows), np.uint8).reshape(len(rows), -1)
    return network.fit(chunks, np.array([place[k] for k in keys]), label, (weight / weight.mean()).astype(np.float32))


def scored(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1); a null text is scored as an empty one; a column named score is replaced.

    Rows stay as they are, repeated ones too; equal texts have equal scores; an empty table stays empty.
    """
    names = [f for f in docs.schema if f.name != "score"]

    def run(batches):
        for batch, data, at in slices(batches, text_col, 1 << 20):
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(network.score(data, at))], names=[*(f.name for f in names), "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    return docs.select(*[F.col(f"`{f.name}`") for f in names]).mapInArrow(run, f"{fields}, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    network = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, network).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
