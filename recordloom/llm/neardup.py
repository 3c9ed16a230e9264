"""Near-duplicate groups: MinHash bands for candidates, odd sketches to sift them, full sets to confirm.

Method.  A document's set holds its distinct runs of five words.  One pass
gives each document MinHash values, their bands, and an odd sketch: the MinHash
samples folded into a bitmap where each sample flips one bit, so that the
number of ones in the XOR of two sketches estimates how many samples differ,
precisely where few do.  Equal sets are one class from here on.  Inside a band
bucket, sketches decide in blocks which members may be similar, and what leaves
a block is a forest over those, never its pairs.  Full sets then decide on each
edge of the forests: an edge's star, a few members to a task, compares its
centre with them, so this grows with the documents.  What the true edges tie
together is settled.  Only where an edge proved false may a link have been left
out for it; there, the groups that false edges connect (a family) are compared
over full sets, in blocks and between groups alone.  The components of all true
links are the answer.  A family of S shingles takes (S / FAMILY_BLOCK)**2 / 2
blocks: large ones need many false edges, that is texts which are similar, but
mostly less so than asked for.

Recall: a pair at the limit shares a band with probability 1 - (1 - s**6)**40,
which is 1 - 6e-9 at 0.85 and 1 - 5.2e-6 at 0.8.  All its bands share one
sketch, which sifts it out with probability 1.3e-10 at 0.85 and 1.2e-8 at 0.8
(samples that differ and their bits in the sketch both counted), so bands and
sketches together miss at most 6.1e-9 and 5.3e-6 of such pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import LOWER, Runs, mix, signed, slices, word_hashes, words_of
from .stages import forget, groups_of, new_groups, partitions, stored

SHINGLE = 5
PERCENT = 80
BANDS, BAND_ROWS = 40, 6
SKETCH_BITS = 512
MARGIN = 0.2
#: Members of a bucket that one task compares with as many others.
BUCKET_BLOCK = 2048
#: Shingles of a star's members that one task compares with the centre.
STAR_BLOCK = 1 << 16
#: Shingles of a family that one task compares with as many others.
FAMILY_BLOCK = 1 << 18
SLICE = 1 << 19

_SIGNATURE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and their offsets."""
    data = LOWER[data]
    starts, ends, begins = words_of(data, at)
    runs = Runs(word_hashes(data, starts, ends))
    n = np.diff(begins)
    several, few = runs.sliding(size), np.flatnonzero((n > 0) & (n < size))
    short = dict(zip(few.tolist(), runs.of(begins[few], begins[few + 1])))
    parts, sizes = [], np.zeros(len(n), np.int64)
    for i, (lo, words) in enumerate(zip(begins.tolist(), n.tolist())):
        if words >= size:
            h = np.sort(several[lo : lo + words - size + 1])
            new = np.empty(len(h), bool)
            new[0] = True
            np.not_equal(h[1:], h[:-1], out=new[1:])
            h = h[new]
        elif words:
            h = np.array([short[i]], np.uint64)
        else:
            continue
        parts.append(h)
        sizes[i] = len(h)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.append(0, np.cumsum(sizes))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    n = BANDS * BAND_ROWS
    return draw.integers(0, 1 << 32, n, np.uint32, endpoint=False), draw.integers(0, 1 << 32, n, np.uint32, endpoint=False) | np.uint32(1)


def minhashes(sets: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A row of MinHash values for each non-empty set; heads are the sets' offsets."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    flips, factors = _permutations()
    out = np.empty((len(heads), len(flips)), np.uint32)
    work = np.empty_like(x)
    for i, (flip, factor) in enumerate(zip(flips, factors)):
        np.bitwise_xor(x, flip, out=work)
        np.multiply(work, factor, out=work)
        out[:, i] = np.minimum.reduceat(work, heads)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS)).copy()
    for r in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r::BAND_ROWS])
    return keys


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """The samples' parity bitmaps, as rows of 64-bit words."""
    place = mix(values.astype(np.uint64) + (np.arange(values.shape[1], dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    bits = np.zeros((len(values), SKETCH_BITS), np.uint8)
    row = np.arange(len(values))
    for i in range(values.shape[1]):
        bits[row, place[:, i]] ^= 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def most_ones(similarity: float) -> int:
    """The most ones that the XOR of two sketches may have where the sets may be so similar."""
    differ = 2 * BANDS * BAND_ROWS * (1 - max(0.0, similarity - MARGIN))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * differ / SKETCH_BITS))))


def _sign(batches):
    for batch, data, at in slices(batches, limit=SLICE):
        sets, offsets = shingle_sets(data, at)
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        rows = batch.num_rows
        one, two = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        keys, sketch = [None] * rows, [None] * rows
        if len(full):
            heads = offsets[full]
            one[full] = np.add.reduceat(mix(sets), heads)
            two[full] = np.bitwise_xor.reduceat(mix(sets + np.uint64(0x632BE59BD9B4E019)), heads)
            values = minhashes(sets, heads)
            bands, odd = signed(band_keys(values)), odd_sketches(values)
            for k, i in enumerate(full.tolist()):
                keys[i], sketch[i] = bands[k], odd[k].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(signed(one)), pa.array(signed(two)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], schema=_SIGNATURE)


class Forest:
    """Which members of a block hang together."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.trees = n

    def join(self, i: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.of[others], self.of[i]))
        if len(labels) > 1:
            self.of[np.isin(self.of, labels)] = labels[0]
            self.trees -= len(labels) - 1

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hang = np.flatnonzero(self.of != np.arange(len(self.of)))
        return ids[self.of[hang]], ids[hang]


def _edge_batch(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in edges]) if edges else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in edges]) if edges else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)


def _sift(percent: int):
    limit = most_ones(percent / 100)

    def run(batches):
        for table in groups_of(batches, ["key", "i", "j"]):
            key = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            ids, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
            data = table.column("sketch").combine_chunks()
            data = data.cast(pa.binary()) if not isinstance(data, pa.ChunkedArray) else pa.concat_arrays(data.chunks)
            sketches = np.frombuffer(data.buffers()[2], np.uint8)
            lo = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
            sketches = sketches[lo : lo + len(ids) * (SKETCH_BITS >> 3)].view(np.uint64).reshape(len(ids), -1)
            new = np.ones(len(ids), bool)
            new[1:] = False
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], len(ids))
            out = []
            sizes = ends - heads
            # pairs, which are most of the buckets, all at once
            two = heads[sizes == 2]
            if len(two):
                ones = np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(axis=1)
                ok = (ones <= limit) & (np.minimum(n[two], n[two + 1]) * 100 >= percent * np.maximum(n[two], n[two + 1]))
                out.append((ids[two[ok]], ids[two[ok] + 1]))
            for h, e in zip(heads[sizes > 2].tolist(), ends[sizes > 2].tolist()):
                s, size, forest = sketches[h:e], n[h:e], Forest(e - h)
                for i in range(e - h - 1):
                    rest = np.flatnonzero(forest.of[i + 1 :] != forest.of[i]) + i + 1
                    if not len(rest):
                        continue
                    ok = np.bitwise_count(s[rest] ^ s[i]).sum(axis=1) <= limit
                    ok &= np.minimum(size[rest], size[i]) * 100 >= percent * np.maximum(size[rest], size[i])
                    if ok.any():
                        forest.join(i, rest[ok])
                        if forest.trees == 1:
                            break
                out.append(forest.edges(ids[h:e]))
            yield _edge_batch(out)

    return run


def confirmed(sets: np.ndarray, offsets: np.ndarray, percent: int, group: np.ndarray | None = None) -> Forest:
    """Which sets hang together by links of 100 * |intersection| >= percent * |union|, over every pair; those of one group do from the start."""
    m, sizes = len(offsets) - 1, np.diff(offsets)
    forest = Forest(m)
    if group is not None:
        _, first, at = np.unique(group, return_index=True, return_inverse=True)
        forest.of, forest.trees = first[at], len(first)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(sets, kind="stable")
    ranked, owners = sets[order], owner[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    shared = np.empty(len(sets), np.int64)
    shared[order] = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(ranked))
    for i in range(m - 1):
        if forest.trees == 1:
            break
        if not (forest.of[i + 1 :] != forest.of[i]).any():
            continue
        mine = shared[offsets[i] : offsets[i + 1]]
        lo, n = begin[mine], begin[mine + 1] - begin[mine]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo, n)
        both = np.bincount(owners[at], minlength=m)
        ok = 100 * both >= percent * (sizes + sizes[i] - both)
        ok[: i + 1] = False
        if ok.any():
            forest.join(i, np.flatnonzero(ok))
    return forest


def _sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of rows, end to end, and their offsets, worked through by slices."""
    parts, sizes = [], [np.zeros(0, np.int64)]
    for _, data, at in slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
        s, o = shingle_sets(data, at)
        parts.append(s)
        sizes.append(np.diff(o))
    return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))


def _judge(percent: int):
    """Edges of stars, and whether they are links: rows of one centre and block, the centre first."""

    def run(batches):
        for table in groups_of(batches, ["centre", "block"]):
            key = [table.column(c).to_numpy() for c in ("centre", "block")]
            ids = table.column("rep").to_numpy()
            heads = np.flatnonzero(new_groups(*key))
            out = []
            for h, e in zip(heads.tolist(), np.append(heads[1:], len(ids)).tolist()):
                sets, offsets = _sets_of(table.column("text").slice(h, e - h).combine_chunks())
                sizes = np.diff(offsets)
                shared = np.isin(sets, sets[: sizes[0]], kind="sort")
                both = np.add.reduceat(shared.astype(np.int64), offsets[:-1])[1:]
                out.append((np.full(e - h - 1, ids[h]), ids[h + 1 : e], 100 * both >= percent * (sizes[0] + sizes[1:] - both)))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "link"])

    return run


def _confirm(percent: int):
    def run(batches):
        for table in groups_of(batches, ["family", "i", "j"]):
            key = [table.column(c).to_numpy() for c in ("family", "i", "j")]
            ids, group = table.column("rep").to_numpy(), table.column("group").to_numpy()
            heads = np.flatnonzero(new_groups(*key))
            out = []
            for h, e in zip(heads.tolist(), np.append(heads[1:], len(ids)).tolist()):
                sets, offsets = _sets_of(table.column("text").slice(h, e - h).combine_chunks())
                out.append(confirmed(sets, offsets, percent, group[h:e]).edges(group[h:e]))
            yield _edge_batch(out)

    return run


def _blocked(df: DataFrame, group: str, blocks, member: str) -> DataFrame:
    """df with i and j: a group of c blocks is dealt out as pairs of blocks, a member going to all pairs of its own."""
    df = df.withColumn("__c", blocks).withColumn("__own", F.pmod(F.xxhash64(member), F.col("__c")).cast("int"))
    df = df.withColumn("__to", F.explode(F.sequence(F.lit(0), F.col("__c") - 1)))
    return df.withColumns({"i": F.least("__own", "__to"), "j": F.greatest("__own", "__to")}).drop("__c", "__own", "__to")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of docs.

    Documents are linked where 100 * |intersection| >= percent * |union| of
    their shingle sets; component_id is the least id reachable over links, and
    kept says that it is the row's own.  Words are lower-cased (A-Z) runs
    outside ASCII white space; fewer than five form one shingle.  Null and
    empty texts have empty sets and link with nothing.  Ids must be unique;
    equal repeated rows come out as often as they went in, and a null id is a
    component of its own (null, kept).  An empty table stays empty.  No other
    columns come out, so none can clash; of different texts under one id, one
    stands for the id where links are confirmed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signatures = stored(rows.mapInArrow(_sign, "id long, n long, set1 long, set2 long, bands array<long>, sketch binary"), "signatures")
    classes = stored(signatures.where("n > 0").groupBy("set1", "set2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = signatures.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    bands = stored(reps.select(F.col("id").alias("rep"), "bands"), "bands")
    banded = bands.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = banded.join(buckets, "key")
    members = _blocked(members, "key", F.ceil(F.col("m") / BUCKET_BLOCK).cast("int"), "rep")
    members = members.join(signatures.select(F.col("id").alias("rep"), "n", "sketch").dropDuplicates(["rep"]), "rep")
    p = partitions(spark)
    dealt = members.select("key", "i", "j", "rep", "n", "sketch").repartition(p, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    sifted = dealt.mapInArrow(_sift(percent), "a long, b long").select(F.least("a", "b").alias("centre"), F.greatest("a", "b").alias("rep")).distinct()
    sifted = stored(sifted, "sifted")
    sizes = signatures.select(F.col("id").alias("rep"), "n").dropDuplicates(["rep"])
    members = stored(sifted.select("rep").unionAll(sifted.select(F.col("centre").alias("rep"))).distinct(), "members")
    # the few texts that full sets are needed of, once for both comparisons
    texts = stored(rows.withColumnRenamed("id", "rep").join(members, "rep", "left_semi").dropDuplicates(["rep"]), "texts")

    # every edge against full sets
    stars = sifted.join(sizes, "rep")
    stars = stars.join(stars.groupBy("centre").agg(F.ceil(F.sum("n") / STAR_BLOCK).cast("int").alias("blocks")), "centre")
    stars = stars.select("centre", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep")
    placed = stars.withColumn("place", F.lit(1)).unionAll(stars.select("centre", "block", F.col("centre").alias("rep"), F.lit(0).alias("place")).distinct())
    whole = placed.join(texts, "rep").select("centre", "block", "place", "rep", "text").repartition(p, "centre", "block").sortWithinPartitions("centre", "block", "place")
    judged = stored(whole.mapInArrow(_judge(percent), "a long, b long, link boolean"), "judged")
    groups = components(judged.where("link"))

    # groups that false edges connect, against each other
    grouped = lambda c: F.coalesce(f"{c}_label", c)
    side = lambda c: groups.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    doubts = judged.where("NOT link").join(side("a"), "a", "left").join(side("b"), "b", "left").select(grouped("a").alias("a"), grouped("b").alias("b"))
    connected = components(doubts)
    families = connected.withColumnsRenamed({"node": "group", "label": "family"})
    placed = members.join(groups.withColumnsRenamed({"node": "rep", "label": "group"}), "rep", "left").withColumn("group", F.coalesce("group", "rep")).join(families, "group").join(sizes, "rep")
    totals = placed.groupBy("family").agg(F.sum("n").alias("total"))
    blocks = _blocked(placed.join(totals, "family"), "family", F.ceil(F.col("total") / FAMILY_BLOCK).cast("int"), "rep")
    whole = blocks.join(texts, "rep").select("family", "i", "j", "rep", "group", "text").repartition(p, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    ties = components(whole.mapInArrow(_confirm(percent), "a long, b long")).withColumnsRenamed({"node": "group", "label": "tied"})
    forget(bands, sifted, members, texts, judged, connected)

    out = signatures.select("id", "n", "set1", "set2").join(classes, ["set1", "set2", "n"], "left")
    out = out.join(groups.withColumnsRenamed({"node": "rep", "label": "own"}), "rep", "left").withColumn("group", F.coalesce("own", "rep")).join(ties, "group", "left")
    label = F.coalesce("tied", "group", "id")
    return out.select("id", F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(True)).alias("kept"))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85).withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH RECURSIVE tok AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM tok WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
least_ AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT l.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c::BIGINT AS component_id, l.doc_id = c AS kept FROM least_ l LEFT JOIN sz USING (doc_id)
"""
