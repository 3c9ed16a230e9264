"""Removal of byte strings that an earlier document holds, by prefix doubling over the suffixes that may repeat.

Method.  Positions of the texts stand for their suffixes.  Spark sorts them by
the names of their first START bytes; the number of the first of equal ones in
the sorted order becomes their rank, and positions whose rank is theirs alone
drop out.  Then, until ranks tell `length` bytes apart, a position's rank is
paired with the rank of the position that lies an offset further in the same
text, Spark sorts the pairs, equal pairs get a new rank, and unique ones drop
out.  The offset doubles with the ranked length; the last one is cut so that
ranks stand for exactly `length` bytes.  Behind the least id of equal ranks
stand the repeats.

Sorting every position of every text at each offset would write the input some
thirty times over, so two steps before it take out, without loss, what need not
be ranked:

* Of the `length - GRAM + 1` suffixes that start inside a window of `length`
  bytes, the one whose first GRAM bytes hash least is the window's anchor.  A
  window never occurs more often than its anchor, so windows whose anchor a
  count-min sketch counts once are unique.
* Spark sorts what is left by anchor and by the name of the bytes that all
  windows of an anchor cover.  Where these are equal, all windows repeat: one
  place is enough for the rest, also of those in its own text.  Where all of an
  anchor's are equal, nothing is left to rank.  Where no other text has the same
  bytes before or behind the anchor, no other holds the windows that reach so far.

The sketch has a fixed width.  On a corpus with far more anchors than cells it
lets all of them through, and the sort by anchor takes about three times the
input; what is ranked after that sort does not depend on the sketch.
"""

from __future__ import annotations

import hashlib
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import Anchors, Runs, signed, slices, symbols
from .sketches import PartSketch, merged
from .stages import forget, new_groups, partitions, squeezed, stored, unsqueezed

LENGTH = 50
GRAM = 18
#: Bytes that the first ranks stand for.
START = 25
LOG2_WIDTH = 28
ROWS = 1
#: Bytes of text that are hashed at once: their 64-bit hashes stay in a core's own cache.
SLICE_BYTES = 1 << 17

_RANK = pa.schema([("key", pa.int64()), ("whole", pa.int64()), ("id", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("more", pa.list_(pa.int32())), ("lead", pa.int32()), ("near", pa.int64())])
_MARK = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("source", pa.int32())])
_STRING = pa.schema([("id", pa.int64()), ("first", pa.int32()), ("string", pa.binary())])
_NAME = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("name", pa.int64())])
_CUT = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]


def _anchors(data, at, length, gram):
    return Anchors(symbols(3)[data], at, length, gram)


def _levels(span: int) -> list[int]:
    """Numbers of bytes beside an anchor that tell its places apart: the farther one is half of what its windows cover there."""
    return sorted({d for d in (span // 4 + 1, span // 2) if d})


def _near(a: Anchors, hit: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A hash of 16 bits for each level of bytes before and behind the anchor."""
    place, lead = a.place[hit], a.place[hit] - a.first[hit]
    behind = a.first[hit] + a.count[hit] - 1 + length - place - gram
    out, at = np.zeros(len(hit), np.uint64), 0
    for far, start, end in ((lead, -1, 0), (behind, 0, 1)):
        origin = place if start else place + gram
        for d in _levels(length - gram):
            some = np.flatnonzero(far >= d)
            out[some] |= (a.runs.of(origin[some] + start * d, origin[some] + end * d) >> np.uint64(48)) << np.uint64(at)
            at += 16
    return out


def _shared(group: np.ndarray, ids: np.ndarray, before: np.ndarray, near: np.ndarray, count: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places of different wholes by group: how many first windows to skip, and how many then another text of the group may hold.

    A window that reaches d bytes before the anchor, where no other text of the
    group has the same d bytes, is in no other text; so too behind it.
    """
    levels = _levels(span)
    least = before - count + 1  # bytes before the anchor in the last window
    reach = []
    for side, far in enumerate((before, span - least)):
        upto = np.full(len(group), span, np.int64)  # the most bytes on this side in a window that may be shared
        for n, d in reversed(list(enumerate(levels))):
            some = np.flatnonzero(far >= d)
            named = group[some] << 16 | near[some] >> 16 * (side * len(levels) + n) & 0xFFFF
            order = np.lexsort((ids[some], named))
            heads = np.flatnonzero(new_groups(named[order]))
            sizes = np.diff(np.append(heads, len(order)))
            own = ids[some][order]
            upto[some[order[np.repeat(own[heads] == own[heads + sizes - 1], sizes)]]] = d - 1
        reach.append(upto)
    most, least = np.minimum(before, reach[0]), np.maximum(least, span - reach[1])
    return before - most, np.maximum(most - least + 1, 0)


def _marked(kinds, ids, first, count, source) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip((kinds, ids, first, count, source), _MARK.types)], schema=_MARK)


def _further(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The further places of the given rows, and which of them each belongs to."""
    more = batch.column(5).take(pa.array(rows))
    return more.flatten().to_numpy(), np.repeat(np.arange(len(rows)), more.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _repeated(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    """All places of the given rows, to be removed."""
    ids, first, count = (batch.column(i).to_numpy() for i in (2, 3, 4))
    further, of = _further(batch, rows)
    first, rows = np.concatenate([first[rows], further]), np.concatenate([rows, rows[of]])
    return _marked(np.zeros(len(rows), np.int32), ids[rows], first, count[rows], np.full(len(rows), -1, np.int32))


def _opened(batch: pa.RecordBatch, rows: np.ndarray, skip: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """The first place of each of the given rows, to be opened without its first `skip` windows and for `counts` of them; of its further places, what they are copies of."""
    ids, first = batch.column(2).to_numpy()[rows], batch.column(3).to_numpy()[rows] + skip
    further, of = _further(batch, rows)
    kinds = np.repeat(np.array([1, 2], np.int32), [len(rows), len(of)])
    source = np.concatenate([np.full(len(rows), -1, np.int32), first[of]])
    return _marked(kinds, np.concatenate([ids, ids[of]]), np.concatenate([first, further + skip[of]]), np.concatenate([counts, counts[of]]), source)


def _compare(batches, span: int = LENGTH - GRAM):
    """Of rows sorted by key, whole and id: repeats (kind 0) and, where a key has more than one whole, places to open (kind 1) and their copies (kind 2).

    A whole's place to open is the first in the text of the least id.  `more`
    holds a row's further places in the same text, null for none: what is found
    at the first holds for them.  Of a key whose rows all are in one batch, only
    windows that another text may hold are opened.
    """
    seen = False
    key0 = whole0 = id0 = 0  # the row before
    lead = lead_key = None  # the first row of the last key's first whole, until its key is known to be shared
    least = 0  # least id of the last whole
    for batch in batches:
        if not batch.num_rows:
            continue
        key, whole, ids = (batch.column(i).to_numpy() for i in range(3))
        new_key = np.ones(len(key), bool)
        new_whole = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_whole[1:] = new_key[1:] | (whole[1:] != whole[:-1])
        if seen:
            new_key[0] = key[0] != key0
            new_whole[0] = new_key[0] or whole[0] != whole0
        head = np.maximum.accumulate(np.where(new_whole, np.arange(len(key)), -1))
        leasts = np.where(head >= 0, ids[np.maximum(head, 0)], least)
        again = leasts < ids
        # heads of wholes; that of a key's first whole is opened once a second one comes
        later = np.flatnonzero(new_whole & ~new_key)
        starts = np.flatnonzero(new_key)
        owner = np.searchsorted(starts, later, "right") - 1
        shared = starts[np.unique(owner[owner >= 0])] if len(starts) else starts
        opened = np.concatenate([later, shared])
        if lead is not None and len(later) and (owner < 0).any() and lead_key == key[later[0]]:
            yield _opened(lead, np.zeros(1, int), np.zeros(1, np.int32), lead.column(4).to_numpy())
            lead = None
        if len(starts):
            s = int(starts[-1])
            lead = None if s in shared else batch.slice(s, 1)
            lead_key = key[s]
        yield _repeated(batch, np.flatnonzero(again))
        skip, counts = np.zeros(len(opened), np.int32), batch.column(4).to_numpy()[opened]
        group = np.searchsorted(starts, opened, "right") - 1
        inside = np.flatnonzero((group >= 0) & (group < len(starts) - 1))
        if len(inside):
            before, near = (batch.column(i).to_numpy()[opened[inside]].astype(np.int64) for i in (6, 7))
            skip[inside], counts[inside] = _shared(group[inside], ids[opened[inside]], before, near, counts[inside].astype(np.int64), span)
        some = np.flatnonzero(counts)
        yield _opened(batch, opened[some], skip[some], counts[some])
        seen, key0, whole0, least = True, key[-1], whole[-1], leasts[-1]


def _sorted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def reranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """id, pos, rank of rows that are not alone with their keys; a rank is the first of equal rows, by number in the sorted order."""
    equal = Window.partitionBy(*keys)
    numbered = _sorted(rows, keys).withColumn("__at", F.monotonically_increasing_id())
    return numbered.select("id", "pos", F.min("__at").over(equal).alias("rank"), F.max("__at").over(equal).alias("__last")).where("rank < __last").drop("__last")


def repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """id, pos of rows whose keys a row of a smaller id has too: the last round's ranks need no numbers."""
    equal = Window.partitionBy(*keys)
    return _sorted(rows, keys).select("id", "pos", F.min("id").over(equal).alias("__least")).where("__least < id").drop("__least")


def paired(ranks: DataFrame, offset: int) -> DataFrame:
    """Ranks with the rank that the position `offset` further has; positions without one drop out."""
    ahead = Window.partitionBy("id").orderBy("pos").rangeBetween(offset, offset)
    return ranks.select("id", "pos", "rank", F.max("rank").over(ahead).alias("next")).where("next IS NOT NULL")


def doubled(names: DataFrame, start: int, length: int) -> DataFrame:
    """Prefix doubling: id and pos of strings of `length` bytes that a smaller id has too.

    names: id, pos, name of the `start` bytes from there.  Each round's ranks
    are written before the next one, so a lost executor costs no earlier round.
    """
    if start == length:
        return repeats(names, ["name"])
    now = stored(reranked(names, ["name"]), "ranks")
    while True:
        offset = min(start, length - start)
        pairs, start = paired(now, offset), start + offset
        if start == length:
            found = stored(repeats(pairs, ["rank", "next"]), "repeats")
            forget(now)
            return found
        ranks = stored(reranked(pairs, ["rank", "next"]), "ranks")
        forget(now)
        now = ranks


def earlier_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, start: int = START, log2_width: int = LOG2_WIDTH
) -> DataFrame:
    """Places of `length`-byte strings that also start in a row of a smaller id: id, first (byte), count (of starts).

    Texts count as UTF-8; null and shorter ones have none, nor has a null id.
    Rows of one id count as one document; they must be equal.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    p = partitions(docs.sparkSession)

    def count(batches):
        sketch = PartSketch(ROWS, log2_width)
        for _, data, at in slices(batches, limit=SLICE_BYTES):
            sketch.add(_anchors(data, at, length, gram).key)
            if sketch.size > 4 << 20:
                yield from sketch.batches()
        yield from sketch.batches()

    sketch = merged(rows.mapInArrow(count, "block long, cells binary"), ROWS, log2_width)

    def sample(batches):
        with closing(sketch):
            for batch, data, at in slices(batches, limit=SLICE_BYTES):
                a = _anchors(data, at, length, gram)
                hit = np.flatnonzero(sketch.reaches(a.key))
                # the places of one string in one text go together, so that text which runs in a circle makes no hot key
                hit = hit[np.lexsort((a.first[hit], a.whole[hit], a.key[hit], a.row[hit]))]
                row, key, whole, first = a.row[hit], a.key[hit], a.whole[hit], (a.first[hit] - at[a.row[hit]]).astype(np.int32)
                heads = np.flatnonzero(new_groups(row, key, whole))
                sizes = np.diff(np.append(heads, len(hit)))
                rest = np.ones(len(hit), bool)
                rest[heads] = False
                more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes - 1)), pa.int32(), mask=np.append(sizes == 1, False)), pa.array(first[rest]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key[heads])), pa.array(signed(whole[heads])), batch.column(0).take(pa.array(row[heads])), pa.array(first[heads]), pa.array(a.count[hit[heads]].astype(np.int32)), more, pa.array((a.place[hit] - a.first[hit])[heads].astype(np.int32)), pa.array(signed(_near(a, hit[heads], length, gram)))], schema=_RANK)

    sampled = rows.mapInArrow(sample, "key long, whole long, id long, first int, count int, more array<int>, lead int, near long")
    sampled = sampled.repartition(p, "key").sortWithinPartitions("key", "whole", "id")
    marks = stored(sampled.mapInArrow(lambda batches: _compare(batches, length - gram), "kind int, id long, first int, count int, source int"), "marks")
    sketch.free()

    begin = min(start, length)
    # where nothing is settled, runs of the positions whose ranks the open windows take part with; the texts' rows meet them by id,
    # never by broadcast: texts would be opened in the task that has packed them, with two workers for each core
    open_ = marks.where("kind = 1").groupBy("id").agg(F.collect_list("first").alias("__first"), F.collect_list("count").alias("__count"))
    texts = squeezed(rows, "text").join(open_.hint("merge"), "id")

    def cover(batches):
        for batch, data, at in slices(unsqueezed(batches, "text")):
            first, count = (batch.column(batch.schema.get_field_index(n)) for n in ("__first", "__count"))
            ids, begins, strings = [], [], []
            for i, id_ in enumerate(batch.column(batch.schema.get_field_index("id")).to_pylist()):
                text = data[at[i] : at[i + 1]]
                f, n = first[i].values.to_numpy(), count[i].values.to_numpy()
                if 2 * begin < length:  # several doublings: all positions up to the last one's
                    e = f + n + (length - begin)
                else:  # the windows' own and those that the only one pairs them with
                    f, e = np.concatenate([f, f + (length - begin)]), np.concatenate([f + n, f + n + (length - begin)])
                e = np.minimum(e, max(len(text) - begin + 1, 0))
                edge = np.zeros(len(text) + 2, np.int32)
                np.add.at(edge, f[f < e] + 1, 1)
                np.add.at(edge, e[f < e] + 1, -1)
                turn = np.flatnonzero(np.diff((np.cumsum(edge) > 0).view(np.int8)))
                for s, t in turn.reshape(-1, 2).tolist():
                    ids.append(id_)
                    begins.append(s)
                    strings.append(text[s : t + begin - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int32()), pa.array(strings, pa.binary())], schema=_STRING)

    covered = stored(texts.mapInArrow(cover, "id long, first int, string binary"), "covered")

    def name(batches):
        for batch, data, at in slices(batches, "string", SLICE_BYTES):
            n = np.maximum(np.diff(at) - begin + 1, 0)
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) - np.repeat(ends - n, n)
            byte = place + np.repeat(at[:-1], n)
            row = np.repeat(np.arange(len(n)), n)
            names = Runs(symbols(3)[data]).of(byte, byte + begin)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((batch.column(1).to_numpy()[row] + place).astype(np.int32)), pa.array(signed(names))], schema=_NAME)

    found = doubled(covered.mapInArrow(name, "id long, pos int, name long"), begin, length)
    # the places that hold the same string as an opened one in the same text
    copies = marks.where("kind = 2").groupBy("id").agg(*[F.collect_list(n).alias(n) for n in ("first", "count", "source")])
    places = found.groupBy("id").agg(F.collect_list("pos").alias("pos"))

    def copied(batches):
        for batch in batches:
            for row in range(len(batch)):
                first, count, source, pos = (batch.column(i)[row].values.to_numpy() for i in (1, 2, 3, 4))
                pos = np.sort(pos)
                low = np.searchsorted(pos, source, "left")
                n = np.searchsorted(pos, source + count, "left") - low
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                first = pos[at] - np.repeat(source, n) + np.repeat(first, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(first), row))), pa.array(first, pa.int32())], names=["id", "first"])

    again = copies.join(places.hint("merge"), "id").select("id", "first", "count", "source", "pos").mapInArrow(copied, "id long, first int")
    single = found.select("id", F.col("pos").alias("first")).unionAll(again).withColumn("count", F.lit(1))
    spans = stored(marks.where("kind = 0").select("id", "first", "count").unionAll(single), "spans")
    forget(marks, covered)
    return spans


def without(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept (binary) and kept_sha256; columns of these names are replaced."""
    names = [f.name for f in docs.schema if f.name not in _CUT]
    packed = spans.groupBy(F.col("id").alias("__id")).agg(F.collect_list("first").alias("__first"), F.collect_list("count").alias("__count"))
    work = squeezed(docs.select(*[F.col(f"`{n}`") for n in names]), text_col).join(packed.hint("merge"), F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")

    def cut(batches):
        for batch, data, at in slices(unsqueezed(batches, text_col), text_col):
            first, count = (batch.column(batch.schema.get_field_index(n)) for n in ("__first", "__count"))
            n_removed, n_spans, kept, shas = [], [], [], []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]]
                removed = spanned = 0
                if first[i].is_valid:
                    f, n = first[i].values.to_numpy(), count[i].values.to_numpy()
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, f[f < len(text)], 1)
                    np.add.at(edge, np.minimum(f + n + (length - 1), len(text))[f < len(text)], -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed = int(gone.sum())
                    spanned = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                text = text.tobytes()
                n_removed.append(removed)
                n_spans.append(spanned)
                kept.append(text)
                shas.append(hashlib.sha256(text).hexdigest())
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            arrays += [pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(shas)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *_CUT])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return work.mapInArrow(cut, f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without the bytes of `length`-byte strings that also start in a document of a smaller id.

    Matches never cross documents and are judged on the input; a null text
    counts as empty.  Rows of one id are one document and don't match each
    other.  A null id is neither searched nor found.  Kept bytes may cut
    characters in two, so they are binary.  An empty table stays empty.
    Where rows of one id hold different texts, a place found in one of them is
    cut from all.  Columns named like the added ones are replaced.
    """
    return without(docs, earlier_strings(docs, id_col, text_col, length), id_col, text_col, length)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_earlier(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP10_SQL = r"""
WITH hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
part AS (SELECT doc_id, c, n, substr(x, 2 * c + 1, 354) AS y FROM (SELECT doc_id, x, n, unnest(range(0, n - 49, 128)) AS c FROM hx WHERE n >= 50)),
win AS (SELECT doc_id, c + o AS p, hash(substr(y, 2 * o + 1, 100)) AS h FROM (SELECT doc_id, c, y, unnest(range(0, least(128, n - 49 - c))) AS o FROM part)),
least_ AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING count(*) > 1),
rep AS (SELECT doc_id, p FROM win JOIN least_ USING (h) WHERE m < doc_id),
edge AS (SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM rep),
grp AS (SELECT doc_id, p, sum(CASE WHEN e IS NULL OR p > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edge),
runs AS (SELECT doc_id, g, min(p) AS s, max(p) + 50 AS e FROM grp GROUP BY doc_id, g),
tot AS (SELECT doc_id, sum(e - s) AS r, count(*) AS k, list({'s': s, 'e': e} ORDER BY s) AS l FROM runs GROUP BY doc_id),
gaps AS (SELECT t.doc_id, array_to_string(list_transform(range(0, len(l) + 1), lambda i: x[CASE WHEN i = 0 THEN 1 ELSE 2 * l[i].e + 1 END : CASE WHEN i = len(l) THEN 2 * n ELSE 2 * l[i + 1].s END]), '') AS k FROM hx t JOIN tot USING (doc_id))
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(t.k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(g.k, h.x))) AS kept_sha256
FROM hx h LEFT JOIN tot t USING (doc_id) LEFT JOIN gaps g USING (doc_id)
"""
