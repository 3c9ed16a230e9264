"""Ranked lexical search: accumulator-limited term-at-a-time scoring over an index of parts.

Texts are scanned once for the queries' terms.  Each task turns its documents
into index parts of bounded size: document ids and lengths, and for each term
the places and counts of its documents.  What scores need of the whole corpus
(documents, terms, document frequencies) is summed over the parts.

Then every part answers every query term-at-a-time, rarest term first.  A
document gets an accumulator from the first of its terms that is looked at.
Once the sum of what the remaining terms can add at most, by their greatest
contributions in the part, is less than the k-th greatest partial score, no
document without an accumulator can reach the first k, so none is made any
more; the survivors' scores go on to be updated exactly, and those that can no
longer reach the k-th drop out.  A task carries its k best of each query, and
so the k-th score, from part to part.  The tasks' best are merged by a ranking
that is cut to k before the shuffle.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import LOWER, signed, slices, word_hashes, words_of
from .stages import forget, stored

TOP = 20
#: Postings and documents in one part of the index.
POSTINGS, DOCUMENTS = 1 << 20, 1 << 16
#: Bytes of queries that go to every task at once; more of them are searched for in turn.
BLOCK_BYTES = 4 << 20
#: Fixed values of the score.
UNIT, SPREAD, SHARE, FLOOR, SCALE = 1000000000, 1000, 25, 75, 12

#: Bytes that are in no term: all ASCII but digits and letters.
_OTHER = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
_INDEX = "ids array<long>, lengths array<int>, terms array<int>, sizes array<int>, places array<int>, counts array<int>, n_docs long, n_terms long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = words_of(LOWER[data], np.array([0, len(data)]), _OTHER)
    raw = LOWER[data].tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def _hashes(terms: list[bytes]) -> np.ndarray:
    ends = np.cumsum([0, *map(len, terms)])
    return word_hashes(np.frombuffer(b"".join(terms), np.uint8), ends[:-1], ends[1:])


class _Part:
    """Documents and postings of one part while it is filled."""

    def __init__(self):
        self.ids, self.lengths, self.postings = [], [], []
        self.documents = self.size = 0

    def add(self, ids: pa.Array, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.postings.append((doc + self.documents, term, count))
        self.documents += len(lengths)
        self.size += len(doc)

    def row(self) -> pa.RecordBatch:
        doc, term, count = (np.concatenate(x) for x in zip(*self.postings))
        order = np.lexsort((doc, term))
        terms, first = np.unique(term[order], return_index=True)
        lengths = np.concatenate(self.lengths)
        ids = pa.concat_arrays(self.ids)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        ints = lambda x: one(pa.array(np.asarray(x, np.int32)))
        arrays = [one(ids), ints(lengths), ints(terms), ints(np.diff(np.append(first, len(term)))), ints(doc[order]), ints(count[order]), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _INDEX.split(", ")])


def _index(vocabulary, postings: int, documents: int):
    """Parts of the index of the terms whose hashes, ascending, the broadcast holds."""

    def run(batches):
        known = vocabulary.value
        part = _Part()
        for batch, data, at in slices(batches):
            low = LOWER[data]
            starts, ends, begins = words_of(low, at, _OTHER)
            hashes = word_hashes(low, starts, ends)
            term = np.searchsorted(known, hashes)
            term[term == len(known)] = 0
            hit = np.flatnonzero(known[term] == hashes)
            doc = np.searchsorted(begins, hit, "right") - 1
            keys, count = np.unique(doc * len(known) + term[hit], return_counts=True)
            part.add(batch.column(0), np.diff(begins), keys // len(known), keys % len(known), count)
            if part.size >= postings or part.documents >= documents:
                yield part.row()
                part = _Part()
        if part.documents:
            yield part.row()

    return run


class Part:
    """One part of the index, with every posting's contribution to a score for one occurrence of its term in a query."""

    def __init__(self, ids: pa.Array, lengths, terms, sizes, places, counts, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.places = ids, places
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.at = {t: i for i, t in enumerate(terms.tolist())}
        m = FLOOR + SHARE * lengths.astype(np.int64) * n_docs // n_terms
        count = counts.astype(np.int64)
        self.gains = np.repeat(weights[terms], sizes) * (UNIT * count // (SPREAD * count + SCALE * m[places]))
        self.most = np.maximum.reduceat(self.gains, self.starts) if len(terms) else self.gains
        self.size = len(lengths)

    def ranked(self, query: list[tuple[int, int]], k: int, reached: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the first k, their exact scores, and how many got accumulators.

        query: its terms and their numbers, rarest first; reached: a score that k documents elsewhere have at least.
        """
        lists = [(self.at[t], n) for t, n in query if t in self.at]
        rest = np.zeros(len(lists) + 1, np.int64)
        if lists:
            rest[:-1] = np.cumsum([int(self.most[i]) * n for i, n in lists][::-1])[::-1]
        scores, least, top, step = np.zeros(self.size, np.int64), reached, 0, 0
        while step < len(lists) and rest[step] >= least:
            i, n = lists[step]
            where = self.places[self.starts[i] : self.ends[i]]
            scores[where] += self.gains[self.starts[i] : self.ends[i]] * n
            step += 1
            top = max(top, int(scores[where].max()))
            # the k-th partial score is looked for where it could end this
            if top > rest[step] and self.size >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
        made = np.flatnonzero(scores)
        alive = made[scores[made] + rest[step] >= least]
        for step in range(step, len(lists)):
            i, n = lists[step]
            where, gains = self.places[self.starts[i] : self.ends[i]], self.gains[self.starts[i] : self.ends[i]]
            found = np.minimum(np.searchsorted(where, alive), len(where) - 1)
            hit = where[found] == alive
            scores[alive[hit]] += gains[found[hit]] * n
            if len(alive) > 4 * k:
                least = max(least, int(np.partition(scores[alive], -k)[-k]))
                alive = alive[scores[alive] + rest[step + 1] >= least]
        alive = alive[scores[alive] >= least]
        return alive, scores[alive], len(made)


def _first(ids: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k greatest scores, the lesser id first among equal ones, null before all."""
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((numbers, ~np.asarray(ids.is_null()), -scores))[:k]
    return ids.take(pa.array(order)), scores[order]


def _search(shared, k: int):
    def run(batches):
        x = shared.value
        best: dict[int, tuple[pa.Array, np.ndarray]] = {}
        for batch in batches:
            column = lambda n, row: batch.column(batch.schema.get_field_index(n))[row].values
            for row in range(batch.num_rows):
                part = Part(column("ids", row), *(column(n, row).to_numpy(zero_copy_only=False) for n in ("lengths", "terms", "sizes", "places", "counts")), x["weights"], x["n_docs"], x["n_terms"])
                for q, query in enumerate(x["queries"]):
                    ids, scores = best.get(q, (None, None))
                    reached = int(scores[-1]) if ids is not None and len(ids) == k else 0
                    docs, new, _ = part.ranked(query, k, reached)
                    if len(docs):
                        own = part.ids.take(pa.array(docs))
                        best[q] = _first(own, new, k) if ids is None else _first(pa.concat_arrays([ids, own]), np.concatenate([scores, new]), k)
        for q, (ids, scores) in best.items():
            keep = scores > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), q, np.int32)), ids.filter(pa.array(keep)), pa.array(scores[keep])], names=["query", "id", "score"])

    return run


def _weights(docs_with: dict[int, int], size: int, n_docs: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for term, df in docs_with.items():
        out[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


def _block(docs: DataFrame, items: list, item_type, k: int, postings: int, documents: int) -> DataFrame:
    """The first k of each item of one block: item, rank, id, score."""
    spark = docs.sparkSession
    queries = [Counter(terms_of(r.text)) for r in items]
    known = sorted({t for q in queries for t in q})
    hashes = _hashes(known)
    order = np.argsort(hashes)
    number = {known[o]: i for i, o in enumerate(order.tolist())}
    vocabulary = spark.sparkContext.broadcast(hashes[order])
    index = stored(docs.mapInArrow(_index(vocabulary, postings, documents), _INDEX), "index")
    vocabulary.destroy()
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    with_term = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    df = {r.terms: r.df for r in with_term.collect()}
    ordered = [sorted(((number[t], n) for t, n in q.items() if number[t] in df), key=lambda x: (df[x[0]], x[0])) for q in queries]
    shared = spark.sparkContext.broadcast({"queries": ordered, "weights": _weights(df, len(known), n_docs), "n_docs": n_docs, "n_terms": max(1, n_terms)})
    found = stored(index.mapInArrow(_search(shared, k), "query int, id long, score long"), "found")
    shared.destroy()
    forget(index)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(items)], f"__query int, item {item_type}")
    return ranked.join(F.broadcast(names), F.col("query") == F.col("__query")).select("item", "rank", "id", "score")


def searched(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = TOP,
             postings: int = POSTINGS, documents: int = DOCUMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k documents of the highest scores above 0 for each item: item, rank (from 1), id, score; equal scores by id, null first.

    All documents are ranked, over their whole texts.  Terms are told apart by
    64-bit hashes.  Items are searched for in blocks of about block_bytes; what
    is collected are one block's texts and the document frequencies of their
    terms.  Null and empty texts have no terms; items without terms have no
    rows; repeated items are answered once each, repeated documents ranked once
    each.  No documents or no items, no rows.  No other columns come out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    item_type = asked.schema["item"].dataType.simpleString()
    total = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        own = [r for r in own if terms_of(r.text)]
        if own:
            some = _block(rows, own, item_type, k, postings, documents)
            out = some if out is None else out.unionAll(some)
    return docs.sparkSession.createDataFrame([], f"item {item_type}, rank int, id long, score long") if out is None else out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = searched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP12_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS rn, doc_id AS id, true AS doc, text FROM documents UNION ALL SELECT row_number() OVER (), item_id, false, text FROM benchmark),
tok AS (SELECT rn, id, doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM low),
tot AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM tok WHERE doc AND len(w) > 0),
tf AS (SELECT rn, t, count(*) AS tf FROM (SELECT rn, unnest(w) AS t FROM tok WHERE doc) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY t, n),
size AS (SELECT rn, id, 100 - 25 + ((25 * len(tok.w) * n) // l) AS m FROM tok, tot WHERE doc AND len(tok.w) > 0),
q AS (SELECT rn AS item, id AS item_id, t, count(*) AS times FROM (SELECT rn, id, unnest(w) AS t FROM tok WHERE NOT doc) GROUP BY ALL),
score AS (SELECT item, item_id, s.rn, s.id AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN size s ON s.rn = tf.rn GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
