"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, one scan of each text.

Texts and items are normalised alike: A-Z lower-cased, words are runs of ASCII
letters, digits and all characters beyond ASCII, joined by single spaces.  The
automaton holds every distinct window of ten item words (a shorter item is one
window) with a space on either side.  A match ends at a space, whose rank among
the text's spaces is the number of words before it; words lead back to offsets
in the original text.

The automaton goes to every task, so its size is checked first: windows (and
their item ids) beyond BLOCK_BYTES are dealt into more automata, by hash, and each
text passes all of them, one after the other: what one has found is written before
the next one is built, so that a worker holds one automaton, and the driver the
windows of one.  8 MiB make an automaton of about 180 MB.
"""

from __future__ import annotations

import hashlib
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices
from .stages import forget, stored

WINDOW = 10
#: Bytes of distinct windows in one automaton.
BLOCK_BYTES = 8 << 20

_WORD = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_COLUMNS = ["n_words", "n_hit", "hits", "items"]
_automata: dict = {}


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def _windows(window: int):
    def run(batches):
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normalised((text or "").encode())
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item)
                    texts.append(b" " + b" ".join(words[i : i + window]) + b" ")
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], ["item", "window"])

    return run


def _automaton(shared):
    """Built once in each worker."""
    key = shared.value["digest"]
    if key not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        for n, window in enumerate(shared.value["windows"]):
            found.add_word(window.decode("latin-1"), (n, len(window)))
        found.make_automaton()
        _automata[key] = found
    return _automata[key]


def _scan(shared, text_col: str, first: bool):
    def run(batches):
        automaton, owners = _automaton(shared), shared.value["items"]
        for batch, data, at in slices(batches, text_col):
            raw = data.tobytes()
            n_words, hits, items = [], [], []
            for i in range(batch.num_rows):
                words = normalised(raw[at[i] : at[i + 1]])
                n_words.append(len(words))
                text = b" " + b" ".join(words) + b" "
                found = list(automaton.iter(text.decode("latin-1"))) if words and owners else []
                if not found:
                    hits.append([])
                    items.append([])
                    continue
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
                end = np.array([e for e, _ in found])
                length = np.array([n for _, (_, n) in found])
                lo, hi = np.searchsorted(spaces, end - length + 1), np.searchsorted(spaces, end)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
                hits.append(np.flatnonzero(np.cumsum(edge)[:-1] > 0).tolist())
                items.append(sorted({o for w in {w for _, (w, _) in found} for o in owners[w]}))
            names = [n for n in batch.schema.names if n not in ("__n", "__hits", "__items")]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            if not first:
                hits = [a + b for a, b in zip(batch.column(batch.schema.get_field_index("__hits")).to_pylist(), hits)]
                items = [a + b for a, b in zip(batch.column(batch.schema.get_field_index("__items")).to_pylist(), items)]
            arrays += [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "__n", "__hits", "__items"])

    return run


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hits (numbers of the words inside any occurrence of a window) and items (ids as sorted strings).

    Null texts have no words; items of null id hit but aren't listed; repeated
    items count once; no items, no hits.  Columns of docs with the new names
    are replaced.  Rows and their other columns stay as they are; an empty table stays empty.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).mapInArrow(_windows(window), "item string, window binary")
    listed = stored(listed.groupBy("window").agg(F.collect_set("item").alias("items")), "benchmark")
    total = listed.agg(F.sum(F.length("window") + 48 + F.aggregate("items", F.lit(0), lambda n, i: n + F.length(i) + 56))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    names = [f for f in docs.schema if f.name not in _COLUMNS]
    out = docs.select(*[F.col(f"`{f.name}`") for f in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    held = None
    for block in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).orderBy("window").collect()
        windows = [bytes(r.window) for r in rows]
        shared = spark.sparkContext.broadcast({"digest": hashlib.sha256(b"\n".join(windows)).hexdigest(), "windows": windows, "items": [r["items"] for r in rows]})
        out = out.mapInArrow(_scan(shared, text_col, block == 0), f"{fields}, __n long, __hits array<int>, __items array<string>")
        if block + 1 < blocks:
            out = stored(out, "scanned")
            shared.destroy()
            if held is not None:
                forget(held)
            held = out
    forget(listed)
    hits, ids = F.array_sort(F.array_distinct("__hits")), F.array_sort(F.array_distinct("__items"))
    return out.select(*[F.col(f"`{f.name}`") for f in names], F.col("__n").alias("n_words"), F.size(hits).cast("long").alias("n_hit"), hits.alias("hits"), ids.alias("items"))


def spans_of(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """Start and end, in characters of the original text, of the runs of hit words."""
    data = text.encode()
    inside = np.frombuffer(data.translate(_WORD), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    chars = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))
    starts, ends = chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]
    out: list[tuple[int, int]] = []
    last = None
    for h in hits:
        if last is not None and h == last + 1:
            out[-1] = (out[-1][0], int(ends[h]))
        else:
            out.append((int(starts[h]), int(ends[h])))
        last = h
    return out


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH low AS (SELECT doc_id AS id, true AS doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
tok AS (SELECT id, doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
item AS (SELECT id, least(10, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p, w FROM tok WHERE NOT doc AND len(w) > 0),
pat AS (SELECT DISTINCT id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM item),
ks AS (SELECT DISTINCT k FROM pat),
win AS (SELECT t.id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM tok t, ks WHERE doc AND len(w) >= k),
occ AS (SELECT w.id, w.p, w.k, pat.id AS item FROM (SELECT id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM win) w JOIN pat USING (k, s)),
hit AS (SELECT id, count(DISTINCT i) AS n_hit FROM (SELECT id, unnest(range(p, p + k)) AS i FROM occ) GROUP BY id),
its AS (SELECT id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT id, item::VARCHAR AS x FROM occ) GROUP BY id)
SELECT t.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tok t LEFT JOIN hit USING (id) LEFT JOIN its USING (id) WHERE doc
"""
