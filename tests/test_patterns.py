"""Many patterns by the literals that they need, against each pattern on its own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.operators import patterns, rules


@pytest.mark.parametrize("pattern,want", [
    ("abc", ["abc"]), ("ab+cde", ["cde"]), ("a(bc)d", ["abcd"]), ("(foo|bars)x?", ["bars", "foo"]), ("(foo|b*)", None), ("x*", None), ("[a-z]+", None), (r"\bword\b", ["word"]), ("(?i)abc", None),
    ("(ab){2,3}", ["ab"]), ("(ab)?cd", ["cd"]), ("a.c", ["a"]), ("本科(?:及|以)上", ["本科"]), ("^$", None), ("(", None), (r"\Qa.b\E", None), (r"\p{L}abc", None), ("(?:one|two|three)four", ["four"]), (r"a\.b", ["a.b"]), ("(?=look)x", ["x"]), ("(?i:ab)c", None)])
def test_literals(pattern, want):
    assert patterns.literals(pattern) == want


def test_many_rules_equal_each_on_its_own(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé本") for _ in range(r.randint(2, 5)))
    texts = [(i % 30, r.choice([None, "", " ".join(word() for _ in range(r.randint(1, 30)))])) for i in range(60)]
    made = lambda: r.choice([word(), f"{word()} {word()}", f"{word()[:2]}(a|b|cd){word()[:1]}", f"({word()}|{word()})", f"{word()[0]}.{{2}}{word()[:2]}", f"(?i){word().replace(chr(233), chr(97)).upper()}", "[ab]{4}", "a*", f"^{word()[:1]}", f"{word()}$"])
    asked = [(r.choice("xy"), f"r{i % 250}", made()) for i in range(300)] + [("x", "none", None)]
    want = sorted({(k, i, c, n) for k, (i, t) in enumerate(texts) if t is not None for c, n, p in asked if p is not None and re.search(p, t)})
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    table = spark.createDataFrame(asked, "category string, rule string, pattern string")
    monkeypatch.setattr(patterns, "RULES", 40)
    for block in (4 << 20, 3000):
        found = patterns.many_findings(docs, "id", "text", table, block).collect()
        assert sorted(map(tuple, found)) == sorted((i, c, n) for _, i, c, n in want)
    plain = docs.join(table, F.expr("text rlike pattern")).select("id", "category", "rule").distinct()
    assert {tuple(x) for x in found} == {tuple(x) for x in plain.collect()}
    assert patterns.many_findings(docs, "id", "text", table.where("false")).count() == 0


def test_texts_are_not_repeated_for_each_pattern():
    """Ten texts of 100,000 characters that may match 3000 patterns: batches stay small, and each text comes three times."""
    import pyarrow as pa

    class Shared:
        value = {"digest": "texts", "patterns": [(n, f"{n}.*ed", ["ed"]) for n in range(3000)] + [(3000, "d[a-e]d", ["d"])]}

    texts = ["ed" * 50000] * 10
    batch = pa.RecordBatch.from_pydict({"__id": list(range(10)), "__text": texts, "__row": list(range(10))})
    made = list(patterns._candidates(Shared)([batch]))
    tried = [b for b in made if b.column("__text").null_count == 0]
    assert sum(map(len, tried)) == 30 and sum(len(m) for b in tried for m in b.column("__may")) == 30000
    assert max(b.nbytes for b in made) < 6 << 20
    assert [m.as_py() for b in made if b not in tried for m in b.column("__may")] == [[{"rule": 3000, "pattern": None}]] * 10


@pytest.mark.parametrize("pattern,want", [
    ("ab(?s:.)c[a-z]*(ed|ly)[ .,]", True), ("a.c", False), ("a(?s:.(?:.b|[^x])+?)", True), (r"a\.b", True), (r"a\sb", False), ("^ab", False), ("ab$", False), (r"\bab", False), ("(?i)ab", False), ("(a)\\1", False),
    ("a{2,3}", True), ("a{,3}", False), ("[]a]b", False), ("[a&&b]c", False), ("(?=a)a", False), ("a++b", False), ("本(?:科|é)", True), ("(", False)])
def test_plain(pattern, want):
    assert patterns.plain(pattern) == want


def test_fifty_thousand_rules(spark):
    asked = [("c", f"n{i}", f"key{i:05d}[a-z]+z") for i in range(50000)]
    texts = [(1, "key00007abcz key49999z"), (2, "key12345xz, key123"), (3, "nothing"), (1, None)]
    found = rules.findings(spark.createDataFrame(texts, "id int, text string"), "id", "text", asked)
    assert sorted(map(tuple, found.collect())) == [(1, "c", "n7"), (2, "c", "n12345")]


def test_heads_before_shared_tails_equal_each_on_its_own(spark, monkeypatch):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdé😀\0 .") for _ in range(n))
    texts = [(i % 40, r.choice([None, "", "ab", "".join(word(1) for _ in range(r.randint(1, 80)))])) for i in range(90)]
    tails = ["[a-c]*(d|ab)[ .]", "(?s:.)?[^a ]{2,3}", "(?:ab){0,2}c", "[a-b]+", "(a|(b|cd)(?s:.))[^b]"]
    head = lambda: "".join(r.choice([re.escape(word(1)).replace("\0", "a").replace("\\ ", " "), "(?s:.)"]) for _ in range(r.randint(0, 3)))
    asked = [(r.choice("xy"), f"r{i % 700}", head() + r.choice(tails)) for i in range(900)] + [("x", None, "ab[a-b]+"), (None, None, "[a-b]+")]
    assert sum(patterns.shaped(p) is not None for _, _, p in asked) == len(asked)
    want = sorted({(k, i, str(c), str(n)) for k, (i, t) in enumerate(texts) if t is not None for c, n, p in asked if re.search(p, t)})
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    table = spark.createDataFrame(asked, "category string, rule string, pattern string")
    monkeypatch.setattr(patterns, "SHARED", 2)
    for block in (4 << 20, 2000):
        found = patterns.many_findings(docs, "id", "text", table, block).collect()
        assert sorted((i, str(c), str(n)) for i, c, n in found) == sorted((i, c, n) for _, i, c, n in want)


def test_few_findings_at_a_time(monkeypatch):
    """However small the parts: the same pairs, no text in two parts."""
    import numpy as np
    import pyarrow as pa

    heads = [[97], [98], [97, -1], [-1], []]
    rules = pa.table({"__rule": pa.array(range(5), pa.int64()), "__head": pa.array(heads, pa.list_(pa.int32())), "__tail": [patterns.shaped("[b-c]+")[1]] * 5, "category": ["c"] * 5, "rule": list("vwxyz")})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rules.schema) as out:
        out.write_table(rules)

    class Shared:
        value = {"digest": "few", "rules": sink.getvalue().to_pybytes()}

    texts = ["abc", "", "ba", "c", "aab", "xxb", "aa"] * 3
    batch = pa.RecordBatch.from_pydict({"__id": list(range(len(texts))), "__text": texts, "__row": list(range(len(texts)))})
    want = {(i, r) for i, t in enumerate(texts) for r, p in zip("vwxyz", ["a[bc]+", "b[bc]+", "a.[bc]+", ".[bc]+", "[bc]+"]) if re.search(p, t)}
    for most, size in ((1 << 20, 1 << 20), (1, 1 << 20), (3, 4), (1, 1)):
        monkeypatch.setattr(patterns, "MOST_MADE", most)
        monkeypatch.setattr(patterns, "SLICE_BYTES", size)
        made = list(patterns._named(Shared)([batch]))
        got = [x for b in made for x in zip(b.column("__id").to_pylist(), b.column("rule").to_pylist())]
        assert sorted(got) == sorted(want)
        assert sum(len(np.unique(b.column("__id"))) for b in made) == len({i for i, _ in want})


def test_long_runs_take_a_few_passes():
    """A text of one character, from each place of which the tail could read to the end."""
    import numpy as np

    chars = np.append(np.full(1000000, 97, np.uint32), patterns._END)
    steps = [("run", 0, None, ("in", False, ((97, 97),))), ("run", 2, None, ("in", False, ((97, 98),))), ("in", False, ((98, 98),))]
    assert not patterns._places(steps, chars, np.ones(len(chars), bool), {}).any()
    chars[-2] = 98
    assert patterns._places(steps, chars, np.ones(len(chars), bool), {}).sum() == 1000000 - 2


def test_findings_of_rules_with_one_pattern_are_not_shuffled(spark):
    """The result of the query grows with texts times rules: only texts are dealt out."""
    from recordloom.plans import catalog

    plan = catalog.QUERIES["q_many_rules"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("pattern,want", [
    ("ab(?s:.)c[a-z]*(ed|ly)[ .,]", [97, 98, -1, 99]), ("[a-z]*b", []), ("abc", None), ("a(?:bc)*", None), ("a(?:bc){2}", [97]), ("a.b", None), ("a((?:b{9}){8})", [97]), ("a((?:(?:bc|cd|db){9}){8})", None)])
def test_shaped(pattern, want):
    assert (patterns.shaped(pattern) or [None])[0] == want
