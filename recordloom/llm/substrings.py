"""Removal of repeated word windows: count-min prefilter, then exact grouping.

Method.  A first pass hashes every window of every text and counts the windows'
anchors (least k-grams, see hashing.Anchors) in sketches, one for each task,
which are added up.  A window never occurs more often than its anchor, so the
merged sketch overestimates every window's count.  A second pass drops windows
whose estimate is one and groups the rest exactly: first all windows of an
anchor as one string (`whole`), since repeats are mostly long, then, where an
anchor has more than one such string, window by window.  Groups are told apart
by two 64-bit hashes of the words.
"""

from __future__ import annotations

import hashlib
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import Anchors, signed, slices, word_hashes, words_of
from .sketches import PartSketch, merged
from .stages import forget, new_groups, squeezed, stored, unsqueezed

WINDOW = 35
GRAM = 12
LOG2_WIDTH = 27
ROWS = 2

_FOUND = pa.schema([("id", pa.int64()), ("bare", pa.int64()), ("key", pa.int64()), ("whole", pa.int64()), ("firsts", pa.list_(pa.int32())), ("count", pa.int32()), ("windows", pa.list_(pa.int64()))])
_KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _anchors(data, at, window, gram):
    starts, ends, begins = words_of(data, at)
    return Anchors(word_hashes(data, starts, ends), begins, window, gram), begins


def _owner(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The key of a row, never null: its id, or another hash of its text without one, and a hash of its text, even with an id and odd without."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    bare = F.shiftleft(F.xxhash64(text), 1)
    return F.coalesce(id_, F.xxhash64(F.lit(1), text)), F.when(id_.isNull(), bare + 1).otherwise(bare)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, log2_width: int = LOG2_WIDTH) -> DataFrame:
    """Word spans covered by windows that start in more than one place: id, bare, firsts (words at which such a span begins), length.

    Its attribute `reads` names the stored tables that it reads.  id and bare are the key that `_owner` gives a row, so texts that share an
    id are documents of their own, and equal rows count as copies.  Null and empty texts, and texts of fewer words than a window, have none.
    """
    id_, bare = _owner(id_col, text_col)
    rows = docs.select(id_.alias("id"), bare.alias("bare"), F.col(text_col).alias("text"))

    def count(batches):
        sketch = PartSketch(ROWS, log2_width)
        for _, data, at in slices(batches):
            sketch.add(_anchors(data, at, window, gram)[0].key)
            if sketch.size > 4 << 20:
                yield from sketch.batches()
        yield from sketch.batches()

    sketch = merged(rows.mapInArrow(count, "block long, cells binary"), ROWS, log2_width)

    def find(batches):
        with closing(sketch):
            for batch, data, at in slices(batches):
                a, begins = _anchors(data, at, window, gram)
                hit = np.flatnonzero(sketch.reaches(a.key))
                if not len(hit):
                    continue
                # the places of one string in one text go together, so that text which runs in a circle makes no hot key
                hit = hit[np.lexsort((a.first[hit], a.whole[hit], a.key[hit], a.row[hit]))]
                heads = np.flatnonzero(new_groups(a.row[hit], a.key[hit], a.whole[hit]))
                firsts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(hit)).astype(np.int32)), pa.array((a.first[hit] - begins[a.row[hit]]).astype(np.int32)))
                one = hit[heads]
                n = a.count[one]
                ends = np.cumsum(n)
                start = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(a.first[one], n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(signed(a.runs.of(start, start + window))))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(a.row[one])) for i in (0, 1)), pa.array(signed(a.key[one])), pa.array(signed(a.whole[one])), firsts, pa.array(n.astype(np.int32)), lists], schema=_FOUND)

    written = stored(rows.mapInArrow(find, "id long, bare long, key long, whole long, firsts array<int>, count int, windows array<long>"), "windows")
    sketch.free()
    found = written.withColumn("first", F.col("firsts")[0])
    wholes = found.groupBy("key", "whole").agg(F.sum(F.size("firsts")).alias("n"), F.min(F.struct("id", "bare", "first")).alias("at"))
    wholes = stored(wholes, "wholes")
    spans = found.select("id", "bare", "key", "whole", "firsts", "count").join(wholes.where("n > 1").select("key", "whole"), ["key", "whole"], "left_semi")
    spans = spans.select("id", "bare", "firsts", (F.col("count") + (window - 1)).alias("length"))
    # one place of each string is enough where an anchor has several; it stands for all n of them
    several = wholes.groupBy("key").agg(F.count("*").alias("strings")).where("strings > 1").select("key")
    open_ = wholes.join(several, "key", "left_semi").select("key", "whole", "n", "at.*")
    single = found.join(open_, ["key", "whole", "id", "bare", "first"]).select("id", "bare", "key", "first", "n", F.posexplode("windows").alias("place", "hash"))
    # sums are combined before the shuffle, and the join back may be split, so that a window of very many texts makes no hot task
    again = single.groupBy("key", "hash").agg(F.sum("n").alias("times")).where("times > 1").select("key", "hash")
    more = single.where("n = 1").join(again, ["key", "hash"], "left_semi").select("id", "bare", F.array(F.col("first") + F.col("place")).alias("firsts"), F.lit(window).alias("length"))
    out = spans.unionAll(more)
    out.reads = written, wholes
    return out


def without(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept_text (words outside the spans, joined by one space) and kept_sha256.

    Other columns stay; columns of docs with one of these names are replaced.
    """
    names = [f.name for f in docs.schema if f.name not in _KEPT.names[1:]]
    packed = spans.groupBy(F.col("id").alias("__id"), F.col("bare").alias("__bare")).agg(F.collect_list(F.struct("firsts", "length")).alias("__spans"))
    id_, bare = _owner(id_col, text_col)
    keyed = docs.select(*[F.col(f"`{n}`") for n in names], id_.alias("__id"), bare.alias("__bare"))
    work = squeezed(keyed, text_col).join(packed, ["__id", "__bare"], "left").drop("__id", "__bare")
    work = work.withColumn("__first", F.col("__spans.firsts")).withColumn("__length", F.col("__spans.length")).drop("__spans")
    out = "n_words long, n_removed long, kept_text string, kept_sha256 string"

    def cut(batches):
        for batch, data, at in slices(unsqueezed(batches, text_col), text_col):
            starts, ends, begins = words_of(data, at)
            first, length = batch.column(batch.schema.get_field_index("__first")), batch.column(batch.schema.get_field_index("__length"))
            n_words, n_removed, texts, shas = [], [], [], []
            raw = data.tobytes()
            for i in range(batch.num_rows):
                lo, hi = int(begins[i]), int(begins[i + 1])
                keep = np.ones(hi - lo, bool)
                if first[i].is_valid:
                    places = first[i].values
                    f, n = places.flatten().to_numpy(), np.repeat(length[i].values.to_numpy(), places.value_lengths().to_numpy())
                    edge = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(edge, f, 1)
                    np.add.at(edge, f + n, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                at_kept = np.flatnonzero(keep) + lo
                text = b" ".join(raw[s:e] for s, e in zip(starts[at_kept].tolist(), ends[at_kept].tolist()))
                n_words.append(hi - lo)
                n_removed.append(hi - lo - len(at_kept))
                texts.append(text)
                shas.append(hashlib.sha256(text).hexdigest())
            plain = [n for n in names]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in plain]
            arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(shas)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*plain, *_KEPT.names[1:]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return work.mapInArrow(cut, f"{fields}, {out}")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the words of windows that start in more than one place, the same document included.

    Words are maximal runs outside ASCII white space.  Windows are judged on
    the input.  Null texts count as no words; equal rows are copies of each
    other, so all their windows go; each of several texts of one id is searched
    and cut by itself.  Each row without an id is a document of its own, searched and cut as those
    with ids are (OP6_SQL, which joins on ids, counts its windows but leaves it
    whole); an empty table stays empty.  Columns named like the added ones are replaced.
    """
    # written first, so that the files of its joins are gone before texts are shuffled
    found = repeated_windows(docs, id_col, text_col, window)
    spans = stored(found, "spans")
    forget(*found.reads)
    return without(docs, spans, id_col, text_col)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH tok AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM tok WHERE len(w) >= 35),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM pos),
rep AS (SELECT doc_id, p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM rep),
agg AS (SELECT doc_id, list(i) AS gone FROM hit GROUP BY doc_id),
kept AS (SELECT t.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN w ELSE (
  list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1])) END AS k
  FROM tok t LEFT JOIN agg USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
