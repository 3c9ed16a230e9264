import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import decontaminate, ogg, packing, preferences, quality, sharding, urlrules

from .helpers import corpus


@pytest.mark.parametrize("block_bytes", [32 << 20, 2000])
def test_contamination_equals_brute_force(spark, block_bytes):
    docs = corpus(5, 60)
    r = random.Random(1)
    items = [(7, "alpha1"), (8, None), (9, "--"), (None, docs[3][1])]
    for k in range(25):
        w = (r.choice(docs)[1] or "x").split()
        at = r.randrange(max(1, len(w)))
        items.append((k % 20 + 10, " , ".join(x.upper() for x in w[at : at + r.randint(1, 16)])))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            patterns.setdefault(tuple(w[p : p + 10]), set()).add(i)
    want = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for pattern, owners in patterns.items():
            for p in range(len(w) - len(pattern) + 1):
                if tuple(w[p : p + len(pattern)]) == pattern:
                    hit |= set(range(p, p + len(pattern)))
                    found |= {str(o) for o in owners if o is not None}
        want[i] = (len(w), sorted(hit), sorted(found))
    table = spark.createDataFrame([(i, t, "old") for i, t in docs], "doc_id long, text string, hits string")
    got = decontaminate.contamination(table, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert {r.doc_id: (r.n_words, r.hits, r["items"]) for r in got.collect()} == want


def test_contamination_without_items_or_documents(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(docs, none).collect()] == [(2, 0)]
    assert decontaminate.contamination(docs.where("false"), none).count() == 0


def test_spans_lead_back_to_the_text():
    text = "Été -- one, TWO three; four"
    assert [text[a:b] for a, b in decontaminate.spans_of(text, [1, 2, 4])] == ["one, TWO", "four"]


@pytest.mark.parametrize("block", [100, 1])
def test_url_rules(spark, block):
    rows = [
        (1, "http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "http://a.example.net/de/1", "a.example.net", "/de/1", "net/", "block"),
        (3, "http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        (4, "http://example.com/de", "example.com", "/de", None, "allow"),
        (5, "http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
        (6, "ftp://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme net/", "", "", None, "allow"),
        (9, "http://net", "net", "", None, "allow"),
        (10, "http://net/", "net", "/", "net/", "block"),
        (11, "http://a.net#/x", "a.net", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u, *_ in rows], "page_id long, url string, host string")
    found = urlrules.filter_urls(pages, block_rules=block).collect()
    assert sorted((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in found) == rows
    assert urlrules.filter_urls(pages.where("false")).count() == 0


def test_partial_segments_and_equal_rules():
    root = urlrules.trie([("allow", "a.b", "/x/pre"), ("block", "a.b", "/x/pre"), ("allow", "b", "/x/prefix/long")])
    assert urlrules.match(root, "c.a.b", "/x/prefix/long/y")[2:] == ("a.b/x/pre", "block")
    assert urlrules.match(root, "b", "/x/prefix/longer")[2:] == ("b/x/prefix/long", "allow")
    assert urlrules.match(root, "b", "/x/prefix")[2:] == (None, None)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 64, 100, 1009])
def test_shards_are_a_permutation(spark, n):
    rows = spark.range(n).select((F.col("id") * 7).alias("doc_id"), F.lit("x").alias("shard"))
    found = sharding.shuffled_shards(rows, ["doc_id"], 8).collect()
    assert sorted(r.place for r in found) == list(range(n))
    assert sorted((r.row_number, r.doc_id) for r in found) == [(i, 7 * i) for i in range(n)]
    assert all((r.shard, r.slot) == (r.place % 8, r.place // 8) for r in found)
    if n > 60:
        assert [r.place for r in sorted(found, key=lambda r: r.row_number)] != list(range(n))


def test_shards_of_null_and_equal_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (4, 3), (4, 3), (4, 3)], "doc_id long, v int")
    found = sharding.shuffled_shards(rows, ["doc_id", "v"], 2).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.row_number)] == [None, None, 4, 4, 4]
    assert sorted((r.shard, r.slot) for r in found) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


@pytest.mark.parametrize("n", [1, 64, 254, 255, 256, 3999, 4000, 4001, 8000, 66000, 200000])
def test_ogg_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    streams = ogg.read(ogg.write(payload))
    assert ogg.payload_of(streams) == payload and list(streams) == list(ogg.SERIALS)
    for s in streams.values():
        done = 0
        for p in s.packets:
            done += len(p.data)
            assert p.end == pytest.approx(done / ogg.RATE)


def test_ogg_checksum_by_hand():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"a", b"OggS" + bytes(range(256))):
        assert ogg.checksum(data) == slow(data)


def test_ogg_damage_is_told():
    good = ogg.write(bytes(range(256)) * 1000)
    pages = [m.start() for m in re.finditer(b"OggS", good)]
    for bad in (good[:-1], good[: pages[-1]], good[: pages[3]] + good[pages[4] :], good[:100] + bytes([good[100] ^ 1]) + good[101:], b"x" + good):
        with pytest.raises(ValueError):
            ogg.read(bad)


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, None), (2, "a" * 64), (3, "é" * 40), (4, "z" * 9000)], "doc_id long, text string")
    media = ogg.write_media(docs).unionByName(spark.createDataFrame([(5, 0, b"junk"), (6, 0, None)], "id long, n_bytes long, media binary"))
    found = {r.id: r for r in ogg.read_media(media.withColumn("feature", F.lit(1))).collect()}
    assert [(found[i].n_bytes, found[i].payload_bytes) for i in (1, 2, 3, 4)] == [(0, 64), (64, 64), (80, 128), (9000, 9024)]
    assert found[1].tail_crc32 == zlib.crc32(bytes(64)) and found[5].error and found[5].media_bytes == 4 and found[6].error is None and found[6].media_bytes is None
    assert ogg.read_media(media.where("false")).count() == 0


def test_quality_learns_and_scores_whole_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(word() + ("$$$" if bad and r.random() < 0.6 else "") for _ in range(r.randint(5, 700)))
        rows.append((i, text))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    network = quality.trained(docs, known)
    found = {r.doc_id: r for r in quality.scored(docs, network).withColumn("held", quality.held_out()).drop("text").collect()}
    held = [(found[i].score >= quality.LIMIT) == bool(label) for i, label in labels if found[i].held]
    assert len(held) > 80 and np.mean(held) > 0.95
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == found[i].held for i, _ in labels)
    assert found[1000].score == found[1001].score and 0 <= found[1000].score <= 1
    data = [t.encode() for _, t in rows[:50]] + [b"", b"x", b"y" * 50000]
    at = np.cumsum([0, *map(len, data)])
    together = network.score(np.frombuffer(b"".join(data), np.uint8), at)
    alone = [network.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in data]
    assert np.allclose(together, alone, atol=1e-5)


def test_quality_without_labels(spark):
    docs, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.scored(docs, quality.trained(docs, none)).collect()] == [0.5]
    assert quality.scored(docs.where("false"), quality.trained(docs, none)).count() == 0


def test_preference_segments_by_hand(spark):
    u, a = "user", "assistant"
    rows = [
        (1, 0, u, "hi"), (1, 1, a, "yes"), (1, 2, u, "more"), (1, 3, a, "good"),
        (2, 0, u, "hi"), (2, 1, a, "yes"), (2, 2, u, "more"), (2, 3, a, "bad"), (2, 4, u, "why"),
        (3, 0, u, "hi"), (3, 1, a, "no"), (4, 0, u, None), (4, None, a, "early"), (None, 0, u, "lost"), (2, 4, u, "why"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(9))
    pairs = preferences.pairs_of(table)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 2), (2, 3)]
    segments = preferences.preference_segments(table, pairs.unionByName(spark.createDataFrame([(1, 1), (4, 77)], "chosen long, rejected long")))
    found = sorted((r.chosen, r.rejected, r.part, -1 if r.turn is None else r.turn, r.place, r.text, r.loss) for r in segments.collect())
    t = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    first = [(0, t(u, "hi")), (1, t(a, "yes")), (2, t(u, "more")), (3, t(a, "good"))]
    want = [(1, 1, "prompt", n, 1, x, False) for n, x in first] + [(1, 2, "prompt", n, 1, x, False) for n, x in first[:3]]
    want += [(1, 2, "chosen", 3, 1, t(a, "good"), True), (1, 2, "rejected", 3, 1, t(a, "bad"), True), (1, 2, "rejected", 4, 1, t(u, "why"), False), (1, 2, "rejected", 4, 2, t(u, "why"), False)]
    want += [(2, 3, "prompt", 0, 1, t(u, "hi"), False), (2, 3, "chosen", 1, 1, t(a, "yes"), True), (2, 3, "chosen", 2, 1, t(u, "more"), False), (2, 3, "chosen", 3, 1, t(a, "bad"), True)]
    want += [(2, 3, "chosen", 4, 1, t(u, "why"), False), (2, 3, "chosen", 4, 2, t(u, "why"), False), (2, 3, "rejected", 1, 1, t(a, "no"), True)]
    want += [(4, 77, "chosen", -1, 1, t(a, "early"), True), (4, 77, "chosen", 0, 1, t(u, ""), False)]
    assert found == sorted(want)
    none = table.where("false")
    assert preferences.preference_segments(none, preferences.pairs_of(none)).count() == 0


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = [*corpus(6, 120), (200, "word " * 5000), (201, "日本語 <|endoftext|>\x85 mixed"), (202, None), (203, "a" * 30000), (204, "a <|endoftext|> b"), (205, "<|endoftext|>")]
    assert exact.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    found = packing.packed(packing.pieces_of(docs)).collect()
    texts = dict(rows)
    places: dict = {}
    for r in found:
        ids = np.append(exact.encode(texts[r.id] or "", add_special_tokens=False).ids, 0).astype("<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 2048 or r.piece == 0
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(r.length for r in found) // 2048) + 1
    assert len([r for r in found if r.id == 0]) == 2
    assert packing.packed(packing.pieces_of(docs.where("false"))).count() == 0


@pytest.mark.parametrize("length", [0, 2049, None])
def test_packing_of_wrong_lengths(spark, length):
    pieces = spark.createDataFrame([(1, 0, 5), (2, 0, length)], "id long, piece int, length long")
    with pytest.raises(ValueError, match="1 to 2048"):
        packing.packed(pieces)


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(2049, np.int64)
    lengths = np.clip((r.lognormal(6, 1.2, 3000)).astype(int), 1, 2048) if seed else np.full(3000, 1500)
    np.add.at(counts, lengths, 1)
    plan = packing.planned(counts)
    fill, seen = np.zeros(plan.sequences, int), np.zeros(2049, int)
    for length, begin, count, sequence, offset in sorted(plan.rows, key=lambda x: x[4]):
        assert begin >= 0 and (fill[sequence : sequence + count] == offset).all()
        fill[sequence : sequence + count] += length
        seen[length] += count
    assert (seen == counts).all() and fill.max() <= 2048
    least = max(-(-lengths.sum() // 2048), (lengths > 1024).sum())
    assert plan.sequences <= 1.01 * least + 2
