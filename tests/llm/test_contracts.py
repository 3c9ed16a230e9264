"""Whole small tables against plain recomputation, where SQL has no say."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import ogg, quality

from .helpers import corpus

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def plain_ogg(payload, checksum):
    """The stored form by its definition: packets dealt to two streams, lacing values dealt to pages of 255."""
    packets = [payload[i : i + 4000] for i in range(0, len(payload), 4000)]
    streams = []
    for k, serial in enumerate((0x52454331, 0x52454332)):
        head = struct.pack("<8sBBII", b"8bitPCM\0", 1, k, 8000, 4000)
        pieces = [(p, i * 255, min(255, len(p) - i * 255)) for p in packets[k::2] for i in range(len(p) // 255 + 1)]
        total, ends = 0, []
        for p, at, n in pieces:
            total += len(p) if n < 255 else 0
            ends.append(total if n < 255 else None)
        chunks = [range(i, min(i + 255, len(pieces))) for i in range(0, len(pieces), 255)] or [range(0)]
        pages = [(2, 0, bytes([len(head)]), head)]
        for c in chunks:
            done = [ends[i] for i in c if ends[i] is not None]
            flags = (1 if len(c) and c[0] and pieces[c[0] - 1][2] == 255 else 0) | (4 if c is chunks[-1] else 0)
            pages.append((flags, done[-1] if done else (1 << 64) - 1, bytes(pieces[i][2] for i in c), b"".join(pieces[i][0][pieces[i][1] :][: pieces[i][2]] for i in c)))
        made = []
        for number, (flags, granule, lacing, body) in enumerate(pages):
            page = struct.pack("<4sBBQIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
            made.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
        streams.append(made)
    a, b = streams
    return b"".join([a[0], b[0], *(p for i in range(1, max(len(a), len(b))) for s in (a, b) for p in s[i : i + 1])])


@needs_data
def test_ogg_contract_over_a_whole_table(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = ogg.op3_ogg_media(spark, DATA).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for k, r in enumerate(sorted(found, key=lambda r: r.n_bytes)):
        text = texts[r.doc_id]
        payload = text + bytes(-len(text) % 64 or (64 if not text else 0))
        media = plain_ogg(payload, slow_crc if k < 4 else ogg.checksum)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"packets={-(-len(payload) // 4000)} " in r.feature


def naive_score(network, text):
    """The network's definition, place by place."""
    data = text.encode()
    places = -(-max(len(data), 1) // quality.STRIDE)
    byte = lambda i: data[i] if 0 <= i < len(data) else 0
    acts = []
    for p in range(places):
        x = []
        for i in range(p * quality.STRIDE, p * quality.STRIDE + quality.WIDTH):
            x += [*network.embedding[byte(i)], *(float(byte(i) != 0 and byte(i) == byte(i - lag)) for lag in range(1, quality.LAGS + 1))]
        acts.append(np.array(x) @ network.filters)
    halves = [np.max(acts[i : i + quality.HALF], axis=0) for i in range(0, places, quality.HALF)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    logit = np.mean([np.maximum(c + network.bias, 0) @ network.out for c in chunks]) + network.level[0]
    return 1 / (1 + np.exp(-logit))


def test_quality_scores_equal_the_definition(spark):
    network = quality.Network(0.3)
    texts = [t for _, t in corpus(9, 12, 5, 60)] + [None, "", "a", "ab" * 700, "x" * 384, "y" * 385, "é" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in quality.scored(docs, network).collect():
        assert r.score == pytest.approx(naive_score(network, texts[r.doc_id] or ""), abs=1e-5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_quality_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    rows = quality.op4_quality(spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(rows) > 40 and auc > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.9


@needs_data
@pytest.mark.parametrize("stage", range(5))
def test_stages_take_rows_of_every_kind(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    few = docs.limit(12)
    passage = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "a text without an id", "en", "s", 20), (9001, "", "en", "s", 0), (9002, None, "en", "s", None), (9003, passage, "en", "s", 9), (9004, f"before {passage} after", None, None, None), (9005, "long " * 60000, "en", "s", 300000),
         (9006, " ".join(f"v{i}" for i in range(90)) + f" {passage}", "en", "s", 9), (9006, "another text of this id", "en", "s", 9)],
        docs.schema)
    table = few.unionByName(odd).unionByName(odd.where("doc_id = 9003"))
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, table, DATA)
    rows = out.collect()
    empty = function(spark, table.where("false"), DATA)
    assert empty.count() == 0 and empty.columns == out.columns
    if name != "packing":
        assert out.columns == docs.columns
    if name == "near_dedup":
        assert sorted(r.doc_id for r in rows if (r.doc_id or 0) > 9000) == [9001, 9002, 9003, 9003, 9005, 9006, 9006]
    if name == "substring_dedup":
        assert {r.text for r in rows if r.doc_id == 9003} == {""} and [r.text for r in rows if r.doc_id == 9004] == ["before after"]
        assert sorted(r.text for r in rows if r.doc_id == 9006) == ["another text of this id", " ".join(f"v{i}" for i in range(90))]
    if name == "packing":
        assert sum(r.length for r in rows if r.doc_id == 9005) > 60000 and sorted(r.length for r in rows if r.doc_id in (9001, 9002)) == [1, 1]
    if name == "decontamination":
        assert len([r for r in rows if r.doc_id is None]) == 2
