"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    sets = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in sets), sum(sum(c.values()) for _, c in sets)
    df = Counter(t for _, c in sets for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in sets:
            score = 0
            for t, n in Counter(terms(text)).items():
                if c[t]:
                    m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
                    score += n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, rank + 1, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def text(r, n):
    words = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(n)] + [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(n)]
    r.shuffle(words)
    return "".join(w.upper() + r.choice([" ", "-", "\n", "_"]) if r.random() < 0.3 else w + " é, " for w in words)


@pytest.mark.parametrize("k,postings,documents,block", [(3, 1 << 20, 1 << 16, 4 << 20), (2, 40, 5, 150), (7, 1, 1, 400), (200, 60, 9, 4 << 20)])
def test_ranks_equal_plain_scores(spark, k, postings, documents, block):
    r = random.Random(k)
    docs = [(i, text(r, r.choice([0, 1, 5, 30, 80]))) for i in range(70)]
    docs += [(70, None), (71, ""), (72, " ,;"), (73, docs[3][1]), (3, docs[3][1]), (74, docs[5][1]), (None, docs[6][1]), (75, text(r, 4000))]
    items = [(i, text(r, r.choice([1, 3, 12, 40]))) for i in range(9)] + [(9, None), (10, "..."), (11, "unknown words only"), (None, "w1 w2 w2"), (2, "aaa bb W3")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = search.searched(table, asked, k=k, postings=postings, documents=documents, block_bytes=block).collect()
    assert sorted(map(tuple, found), key=str) == by_hand(docs, items, k)


def test_few_accumulators_and_exact_scores():
    """A part alone: rare terms decide, so common ones make no accumulators, and the k best are those of full scoring."""
    draw = np.random.default_rng(3)
    size, k = 3000, 10
    chance = np.array([0.002, 0.004, 0.01, 0.5, 0.7, 0.9])
    weights = np.array([7000, 6500, 5000, 300, 200, 100])
    places = [np.flatnonzero(draw.random(size) < c) for c in chance]
    counts = [draw.integers(1, 6, len(p)) for p in places]
    lengths = draw.integers(20, 400, size)
    part = search.Part(pa.array(np.arange(size)), lengths, np.arange(6), np.array([len(p) for p in places]), np.concatenate(places), np.concatenate(counts), weights, size, int(lengths.sum()))
    full = np.zeros(size, np.int64)
    for t in range(6):
        full[places[t]] += part.gains[part.starts[t] : part.ends[t]]
    docs, scores, made = part.ranked([(t, 1) for t in range(6)], k)
    order = np.lexsort((docs, -scores))[:k]
    want = np.lexsort((np.arange(size), -full))[:k]
    assert docs[order].tolist() == want.tolist() and scores[order].tolist() == full[want].tolist()
    assert made < size // 10
    # what others have reached already leaves no more to do
    assert not len(part.ranked([(t, 1) for t in range(6)], k, int(full.max()) + 1)[0])


def test_no_documents_or_no_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert search.searched(docs.where("false"), items).count() == 0
    empty = search.searched(docs, items.where("false"))
    assert empty.count() == 0 and empty.columns == ["item", "rank", "id", "score"]
    clash = docs.selectExpr("*", "1 AS score", "'q' AS item")
    assert [r.item for r in search.searched(clash, items).collect()] == ["x"]
    nothing = spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string")
    assert search.searched(nothing, items).count() == 0
