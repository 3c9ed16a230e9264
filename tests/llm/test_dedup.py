import hashlib
import math
import random
import re

import numpy as np
import pytest

from recordloom.llm import neardup, substrings, suffixes
from recordloom.llm.components import components

from .helpers import corpus


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_duplicates_by_hand(rows, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            if label[i] != m or label[j] != m:
                label[i] = label[j] = m
                changed = True
    return {rows[i][0]: (len(sets[i]), rows[label[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_near_duplicates_equal_brute_force(spark, seed, percent):
    rows = corpus(seed, 160, 20, 120)
    docs = spark.createDataFrame([(i, t, "a", 3) for i, t in rows], "doc_id long, text string, n string, family int")
    found = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent=percent).collect()}
    assert found == near_duplicates_by_hand(rows, percent)


def test_near_duplicates_split_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 150)
    monkeypatch.setattr(neardup, "STAR_BLOCK", 200)
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(30)] + [(99, "quite another text of its own here")]
    found = {r.id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert found == {i: c for i, (_, c) in near_duplicates_by_hand(rows, 80).items()}


@pytest.mark.parametrize("blocks", [(1 << 16, 1 << 18), (60, 200)])
def test_near_duplicates_of_chains_below_and_above_the_limit(spark, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "STAR_BLOCK", blocks[0])
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", blocks[1])
    r = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(60)]
    for k in range(60):  # each text is some words away from the one before, now less and now more than the limit allows
        for _ in range(r.choice([1, 1, 2, 3])):
            words[r.randrange(60)] = f"n{k}x{r.randint(0, 9999)}"
        rows.append((k, " ".join(words)))
    for percent in (70, 80):
        found = {x.id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
        by_hand = {i: c for i, (_, c) in near_duplicates_by_hand(rows, percent).items()}
        assert found == by_hand and 1 < len(set(by_hand.values())) < 60


def test_near_duplicates_of_nothing_and_of_equal_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(none).count() == 0
    rows = neardup.near_duplicates(spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f g h"), (4, None)], "doc_id long, text string")).collect()
    assert sorted((r.id, r.component_id, r.kept) for r in rows if r.id is not None) == [(3, 3, True), (3, 3, True), (4, 4, True)]
    assert [r.n_shingles for r in rows if r.id is None] == [4]


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_sketches_lose_less_than_bands(similarity):
    samples, bits = neardup.BANDS * neardup.BAND_ROWS, neardup.SKETCH_BITS
    most = neardup.most_ones(similarity)
    ones = [1.0] + [0.0] * bits  # how likely so many ones are after so many flips of random bits
    sifted = 0.0
    for differ in range(samples + 1):
        sifted += math.comb(samples, differ) * (1 - similarity) ** differ * similarity ** (samples - differ) * sum(ones[most + 1 :])
        for _ in range(2):
            ones = [(ones[k - 1] * (bits - k + 1) if k else 0) / bits + (ones[k + 1] * (k + 1) if k < bits else 0) / bits for k in range(bits + 1)]
    assert sifted < 0.1 * (1 - similarity**neardup.BAND_ROWS) ** neardup.BANDS


def lost_pairs(similarity, pairs, seed):
    """Random pairs of sets just at a similarity: how many share no band, and how many of the others the sketches sift out."""
    r = np.random.default_rng(seed)
    bands = sifted = 0
    for _ in range(pairs):
        n = int(r.integers(60, 600))
        shared = int(np.ceil(similarity * 2 * n / (1 + similarity)))
        pool = np.sort(r.integers(0, 1 << 64, 2 * n - shared, np.uint64, endpoint=False))
        order = r.permutation(len(pool))
        a, b = np.sort(pool[order[:n]]), np.sort(pool[order[n - shared :]])
        values = neardup.minhashes(np.concatenate([a, b]), np.array([0, len(a)]))
        keys, sketches = neardup.band_keys(values), neardup.odd_sketches(values)
        if not (keys[0] == keys[1]).any():
            bands += 1
        elif np.bitwise_count(sketches[0] ^ sketches[1]).sum() > neardup.most_ones(similarity):
            sifted += 1
    return bands, sifted


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_pairs_at_the_limit_are_found(similarity):
    assert lost_pairs(similarity, 1500, 17) == (0, 0)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def windows_by_hand(rows, size):
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen = {}
    for i, w in docs.items():
        for p in range(len(w) - size + 1):
            seen.setdefault(tuple(w[p : p + size]), []).append((i, p))
    gone = {(i, p + k) for places in seen.values() if len(places) > 1 for i, p in places for k in range(size)}
    out = {}
    for i, w in docs.items():
        kept = [x for k, x in enumerate(w) if (i, k) not in gone]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,width", [(1, 27), (2, 16)])
def test_repeated_windows_equal_brute_force(spark, seed, width):
    rows = corpus(seed, 120) + [(500, "a b c " * 30), (501, "q " * 9)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    spans = substrings.repeated_windows(docs, window=8, gram=3, log2_width=width)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without(docs, spans).collect()}
    assert found == windows_by_hand(rows, 8)


def test_repeated_windows_of_poor_texts(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(40)] + [(50, "a b " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = substrings.repeated_windows(docs, window=9, gram=3)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without(docs, spans).collect()}
    assert found == windows_by_hand(rows, 9)


def test_repeated_windows_of_nothing_and_of_equal_rows(spark):
    assert substrings.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = substrings.remove_repeated(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows) == [(1, 40, 40, ""), (1, 40, 40, ""), (2, 0, 0, "")]


def test_repeated_window_of_many_texts_is_summed_before_the_shuffle(spark):
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(50)]
    spans = substrings.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), window=8, gram=3)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and "Aggregate [key" in plan
    assert sorted((r.id, r.firsts[0]) for r in spans.collect()) == [(i, p) for i in range(50) for p in (2, 3)]


def test_repeated_windows_of_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(9))
    own = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    texts = [f"{own('a', 30)} {passage}", f"{passage} {own('b', 3)}", own("c", 50), own("d", 12), own("d", 12), "short", None]
    # an id whose only repeat lies in a text without an id, in other words around it, so that it is judged window by window
    rows = [(None, t) for t in texts] + [(5, f"{own('e', 4)} {passage} {own('f', 6)}"), (6, f"{own('g', 20)} {own('c', 50).split(' c20 ')[0]} {own('h', 3)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = substrings.without(docs, substrings.repeated_windows(docs, window=8, gram=3))
    found = sorted((r.doc_id or 0, r.text or "", r.n_words, r.n_removed, r.kept_sha256) for r in cut.collect())
    by_hand = windows_by_hand([(k, t) for k, (_, t) in enumerate(rows)], 8)
    assert found == sorted((i or 0, t or "", *by_hand[k]) for k, (i, t) in enumerate(rows))


def test_repeated_windows_of_texts_that_share_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(9))
    own = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, f"{own('a', 30)} {passage}"), (1, "short"), (1, f"{passage} {own('b', 3)}"), (2, passage), (2, None), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = substrings.without(docs, substrings.repeated_windows(docs, window=8, gram=3))
    found = sorted((r.doc_id or 0, r.text or "", r.n_words, r.n_removed, r.kept_sha256) for r in cut.collect())
    by_hand = windows_by_hand([(k, t) for k, (_, t) in enumerate(rows)], 8)
    assert found == sorted((i or 0, t or "", *by_hand[k]) for k, (i, t) in enumerate(rows))


def strings_by_hand(rows, size):
    docs = {i: (t or "").encode() for i, t in rows}
    least = {}
    for i, t in docs.items():
        for p in range(len(t) - size + 1):
            least[t[p : p + size]] = min(least.get(t[p : p + size], i), i)
    out = {}
    for i, t in docs.items():
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if least[t[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len([1 for run in bytes(gone).split(b"\0") if run]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("start,width", [(8, 28), (3, 28), (20, 28), (2, 16)])
def test_earlier_strings_equal_brute_force(spark, start, width):
    rows = corpus(4, 90) + [(500, "-" * 70), (501, "é" * 40), (502, "-" * 30 + "x" + "-" * 33)]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, kept binary")
    spans = suffixes.earlier_strings(docs, length=20, gram=8, start=start, log2_width=width)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without(docs, spans, length=20).collect()}
    assert found == strings_by_hand(rows, 20)


@pytest.mark.parametrize("start", [1, 6, 25])
def test_earlier_strings_of_poor_texts(spark, start):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 150))) + r.choice(["", "ab" * 20, "abb" * 15]) * 2) for i in range(60)]
    rows += [(70, "xyz" + rows[3][1][:30] + "q" + rows[3][1][:30] + "w" + rows[3][1][5:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = suffixes.earlier_strings(docs, length=14, gram=6, start=start)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without(docs, spans, length=14).collect()}
    assert found == strings_by_hand(rows, 14)


@pytest.mark.parametrize("start", [2, 5, 13])
def test_prefix_doubling_of_every_position(spark, start):
    r = random.Random(6)
    texts = {i: bytes(r.choice(b"abc") for _ in range(r.randint(0, 70))) for i in range(20)}
    names = [(i, p, int.from_bytes(t[p : p + start], "little", signed=True) if start < 8 else hash(t[p : p + start])) for i, t in texts.items() for p in range(len(t) - start + 1)]
    found = {(x.id, x.pos) for x in suffixes.doubled(spark.createDataFrame(names, "id long, pos int, name long"), start, 13).collect()}
    seen = {}
    for i, t in texts.items():
        for p in range(len(t) - 12):
            seen.setdefault(t[p : p + 13], []).append((i, p))
    assert found == {(i, p) for places in seen.values() for i, p in places if i > places[0][0]}


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_earlier_strings_of_lines_that_come_again_in_one_text(spark, batch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    lines = [" ".join(word() for _ in range(6)) for _ in range(8)]
    cut = lambda: (x := r.choice(lines))[r.randint(0, 12) : len(x) - r.randint(0, 12)]
    rows = [(i, "\n".join(r.choice([r.choice(lines), cut(), word()]) for _ in range(r.randint(1, 12)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        spans = suffixes.earlier_strings(docs, length=20, gram=8, start=10)
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without(docs, spans, length=20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == strings_by_hand(rows, 20)


def ranked(monkeypatch, docs, **how):
    """How many positions are ranked."""
    counts, real = [], suffixes.doubled
    monkeypatch.setattr(suffixes, "doubled", lambda names, *rest: (counts.append(names.count()), real(names, *rest))[1])
    suffixes.earlier_strings(docs, **how)
    return counts[0]


def test_strings_told_apart_beside_their_anchor_are_not_ranked(spark, monkeypatch):
    """Phrases that many texts hold, shorter than a string, each time with other bytes around them."""
    r = random.Random(5)
    other = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrases = [other(34) for _ in range(60)]
    docs = spark.createDataFrame([(i, other(60) + phrases[i % 60] + other(60)) for i in range(600)], "doc_id long, text string").coalesce(1)
    assert ranked(monkeypatch, docs, gram=32) < 2000


def test_a_line_that_one_text_repeats_is_ranked_once(spark, monkeypatch):
    r = random.Random(6)
    other = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    line = other(200)
    docs = spark.createDataFrame([(1, "\n".join(line for _ in range(100))), (2, line[:120] + other(50)), (3, other(50) + line[60:])], "doc_id long, text string").coalesce(1)
    assert 0 < ranked(monkeypatch, docs) < 3000


def test_only_positions_that_windows_are_paired_with_are_ranked(spark, monkeypatch):
    """Texts that share 52 bytes with one other: three windows, and the positions half a string further."""
    r = random.Random(7)
    other = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = spark.createDataFrame([(i, other(60) + line + other(60)) for k in range(40) for line in [other(52)] for i in (2 * k, 2 * k + 1)], "doc_id long, text string").coalesce(1)
    assert 2 * 3 * 80 <= ranked(monkeypatch, docs) < 80 * 40


def test_earlier_strings_of_one_id_and_clashing_names(spark):
    text = "".join(f"{i}," for i in range(40))
    rows = [(1, text, 7), (2, text, 8), (2, "short", 9), (None, None, None)]
    cut = suffixes.remove_earlier(spark.createDataFrame(rows, "doc_id long, text string, n_removed int"))
    assert cut.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in cut.collect()) == [(0, 0, 0, 0), (1, len(text), 0, 0), (2, 5, 5, 1), (2, len(text), len(text), 1)]


def test_earlier_strings_of_nothing_and_of_equal_rows(spark):
    assert suffixes.remove_earlier(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(f"{i}," for i in range(40))
    rows = suffixes.remove_earlier(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in rows) == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, len(text), 1), (3, 0, 0)]
