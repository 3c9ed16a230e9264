import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import hashing, sharding, sketches, stages, substrings, suffixes


class Session:  # stands for one that names no checkpoint folder
    class conf:
        @staticmethod
        def get(name, *default):
            return {"spark.sql.warehouse.dir": "file:/shared/warehouse/"}[name] if not default else default[0]


def test_shared_folder_falls_back_to_the_warehouse():
    assert stages.shared_dir(Session) == "file:/shared/warehouse"


def test_stored_tables_hold_a_partition_in_a_file_and_go_when_forgotten(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        df = stages.stored(spark.range(100).repartition(2), "t")
        assert len(df.inputFiles()) == 2 and df.count() == 100
        found = sharding.numbered(spark.range(50).select((F.col("id") * 3).alias("k")), ["k"]).collect()
        assert sorted((r.row_number, r.k) for r in found) == [(i, 3 * i) for i in range(50)]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    stages.forget(df)
    assert not os.path.exists(df.stored_at.removeprefix("file://"))


@pytest.mark.parametrize("size", [1, 3, 100])
def test_groups_stay_whole(size):
    keys = np.sort(np.random.default_rng(1).integers(0, 12, 200))
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(200))], ["k", "v"])
    tables = list(stages.groups_of((batch.slice(i, size) for i in range(0, 200, size)), ["k"]))
    assert pa.concat_tables(tables).column("v").to_pylist() == list(range(200))
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert all(not a & b for a, b in zip(seen, seen[1:]))


@pytest.mark.parametrize("texts", [[], [None, ""], ["a b", None, "  c\n", "dé f"]])
def test_words_and_their_rows(texts):
    array = pa.array(["skipped", *texts], pa.string()).slice(1)
    data, at = hashing.values_of(array)
    starts, ends, begins = hashing.words_of(data, at)
    raw = data.tobytes()
    found = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(begins[:-1], begins[1:])]
    assert found == [(t or "").split() for t in texts]


def test_run_hashes_depend_on_content_only():
    words = np.random.default_rng(2).integers(0, 1 << 64, 50, np.uint64)
    twice = hashing.Runs(np.concatenate([words, words]))
    assert (twice.sliding(7)[:44] == twice.sliding(7)[50:94]).all()
    a, b = np.arange(0, 40), np.arange(0, 40) + 9
    assert (twice.of(a, b) == twice.of(a + 50, b + 50)).all() and len(np.unique(twice.of(a, b))) == 40


def test_gaps_round_trip():
    r = np.random.default_rng(3)
    for cells in ([0], [65535], [5, 5], [0, 255, 510, 511, 65000], np.sort(r.integers(0, 65536, 500))):
        cells = np.array(cells, np.uint16)
        assert (sketches._cells_of(np.frombuffer(sketches._gaps(cells), np.uint8)) == cells).all()


def test_estimates_are_never_below_counts(spark):
    r = np.random.default_rng(4)
    keys = r.integers(0, 1 << 63, 3000).astype(np.int64)
    keys = np.concatenate([keys, keys[:700]])
    rows = spark.createDataFrame([(int(k),) for k in r.permutation(keys)], "k long").repartition(5)

    def count(batches):
        sketch = sketches.PartSketch(2, 18)
        for b in batches:
            sketch.add(b.column(0).to_numpy().view(np.uint64))
        yield from sketch.batches()

    found = sketches.merged(rows.mapInArrow(count, "block long, cells binary"), 2, 18)
    assert found.reaches(keys[:700].view(np.uint64)).all()
    assert found.reaches(keys[700:3000].view(np.uint64)).mean() < 0.01


@pytest.mark.parametrize("job", [lambda d: suffixes.earlier_strings(d, log2_width=18), lambda d: substrings.repeated_windows(d, window=12, gram=6, log2_width=18)])
def test_workers_hold_no_sketch_after_their_task(spark, job):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 5) * 100 + j}" for j in range(60))) for i in range(200)], "doc_id long, text string").repartition(8)
    assert job(docs).count()

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sketches._opened)], pa.int64())], names=["n"])

    # as many tasks as workers may wait, a few times over
    assert {r.n for r in spark.range(32, numPartitions=32).mapInArrow(held, "n long").collect()} == {0}


def test_squeezed_texts_come_back(spark):
    rows = [(1, "é" * 5000), (2, None), (3, ""), (4, "x")]
    df = spark.createDataFrame(rows, "i long, t string")
    back = stages.squeezed(df, "t").mapInArrow(lambda b: stages.unsqueezed(b, "t", 100), "i long, t string")
    assert sorted(tuple(r) for r in back.collect()) == rows
