import itertools

import pytest
from pyspark.sql import functions as F

from recordloom.operators import capture, expressions, rules


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("text", ["a", "a and b or c", "not a and (b or not (c and d))", "(a)", "a 或 b 且 非 c"])
def test_trees_mean_what_they_say(spark, text):
    nodes = expressions.tree_of(text)
    names = [r[3] for r in nodes if r[2] == "LEAF"]
    words = {"且": " and ", "或": " or ", "非": " not "}
    python = "".join(words.get(c, c) for c in text)

    def value(n, known):
        _, _, operator, leaf = nodes[n]
        below = [value(m, known) for m, p, *_ in nodes if p == n]
        return known[leaf] if operator == "LEAF" else not below[0] if operator == "NOT" else (all if operator == "AND" else any)(below)

    for truth in itertools.product([True, False], repeat=len(names)):
        known = dict(zip(names, truth))
        assert value(0, known) == eval(python, {}, known)


@pytest.mark.parametrize("text", ["", "a and", "not not a", "a and a", "(a", "a)", "a b", "and a", "()"])
def test_unresolved(text):
    with pytest.raises(expressions.Unresolved):
        expressions.tree_of(text)


def test_trees_are_evaluated(spark):
    df = spark.createDataFrame([(1, "a and not b"), (2, "a or b"), (3, "a a"), (4, None)], "id int, e string")
    nodes, bad = expressions.trees(df, "id", "e")
    assert rows(bad, "tree") == [(3,), (4,)]
    leaves = nodes.where("operator = 'LEAF'").select("tree", "node", F.when(F.col("leaf") == "a", 2).otherwise(0).alias("level"))
    assert rows(rules.tree_levels(nodes, leaves, 2).where("node = 0"), "tree", "level") == [(1, 2), (2, 2)]


def test_paging_stops(spark):
    pages = [("a", 1, "/1", "x", 5, True, 1), ("a", 2, "/2", "y", 5, True, 1), ("a", 3, "/1", "z", 5, True, 1), ("b", 1, "/1", "x", 5, True, 1), ("b", 2, "/2", "x", 5, True, 1), ("c", 1, "/1", "x", 0, True, 1), ("d", 1, "/1", "x", 5, False, 1), ("e", 1, "/1", "x", 5, True, 100), ("f", 1, "/1", "p", 5, True, 1), ("f", 2, "/2", "q", 5, True, 1), ("f", 3, "/3", "r", 5, True, 1), ("f", 4, "/4", "s", 5, True, 1)]
    df = spark.createDataFrame(pages, "run string, n int, loc string, h string, items int, more boolean, size long")
    found = capture.paging_stops(df, "run", "n", "loc", "h", "items", "more", 4, 50, "size")
    assert rows(found, "run", "n", "stop") == [("a", 3, "REPEATED_LOCATOR"), ("b", 2, "REPEATED_CONTENT"), ("c", 1, "EXPLICIT_EMPTY"), ("d", 1, "LAST_PAGE"), ("e", 1, "BUDGET"), ("f", 4, "MAX_PAGES")]


def test_blobs_are_stored_once(spark):
    responses = spark.createDataFrame([(1, b"a", False), (2, b"a", False), (3, b"b", False), (4, b"x", True), (5, None, False)], "id int, body binary, failed boolean")
    held = responses.where("id = 3").select(F.sha2("body", 256).alias("content_hash"))
    snapshots, blobs = capture.captured(responses, held, "body", "failed")
    assert [r.content_hash is None for r in snapshots.orderBy("id").collect()] == [False, False, False, True, True]
    assert [(bytes(r.body), r.byte_length) for r in blobs.collect()] == [(b"a", 1)]
    assert capture.corrupted(blobs, "body").count() == 0 and capture.corrupted(blobs.withColumn("body", F.lit(b"z")), "body").count() == 1


def test_compositions(spark):
    surfaces = spark.createDataFrame([("p", "s1", True), ("p", "s2", False), ("q", "s1", True), ("r", "s1", True), ("t", "s1", False)], "k string, s string, m boolean")
    bindings = spark.createDataFrame([("p", "s1"), ("r", "s1"), ("r", "s1")], "k string, s string")
    assert rows(capture.composition(surfaces, bindings, ["k"], "s", "m"), "k", "status") == [("p", "COMPLETE"), ("q", "BLOCKED"), ("r", "AMBIGUOUS"), ("t", "INVENTORY_EMPTY")]
    assert rows(capture.blockers(spark.createDataFrame([("x", "r", 3), ("x", "r", 2)], "k string, r string, i int"), "k", "r", "i"), "n", "first_id") == [(2, 2)]
