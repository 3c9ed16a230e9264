"""Logic trees of any depth, and where nodes lead, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import logic, rules, structured

NODES = "tree int, node int, parent int, operator string"


def value(nodes, leaves, node, seen=()):
    operator, below = nodes[node][1], [k for k, (p, _) in nodes.items() if p == node]
    if operator == "LEAF":
        return leaves.get(node, 1)
    if not below:
        return 1
    found = [value(nodes, leaves, k) for k in below]
    return min(found) if operator == "AND" else max(found) if operator == "OR" else 2 - min(found)


def test_levels_of_random_trees(spark):
    r = random.Random(3)
    trees, leaves = {}, {}
    for t in range(25):
        n = r.choice([1, 2, 7, 25])
        nodes = {i: (None if i == 0 else max(0, i - r.choice([1, 1, 1, 2, 3])), "") for i in range(n)}
        parents = {p for p, _ in nodes.values()}
        trees[t] = {i: (p, r.choice(["AND", "OR", "NOT"]) if i in parents else r.choice(["LEAF", "LEAF", "LEAF", "OR"])) for i, (p, _) in nodes.items()}
        leaves[t] = {i: r.choice([0, 1, 2]) for i in nodes if r.random() < 0.8}
    rows = spark.createDataFrame([(t, i, p, o) for t, nodes in trees.items() for i, (p, o) in nodes.items()], NODES)
    known = spark.createDataFrame([(t, i, v) for t, some in leaves.items() for i, v in some.items()], "tree int, node int, level int")
    found = {(x.tree, x.node): x.level for x in logic.levels(rows, known).collect()}
    assert found == {(t, i): value(nodes, leaves[t], i) for t, nodes in trees.items() for i in nodes}
    # the former name with a number of storeys that is too small
    assert {(x.tree, x.node): x.level for x in rules.tree_levels(rows, known, 1).collect()} == found


def test_levels_of_a_chain_deeper_than_one_gathering(spark):
    n = 2 * logic.GATHER + 5
    rows = spark.range(n).select(F.lit(1).alias("tree"), F.col("id").cast("int").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("int")).alias("parent"), F.when(F.col("id") == n - 1, "LEAF").otherwise("NOT").alias("operator"))
    known = spark.createDataFrame([(1, n - 1, 2)], "tree int, node int, level int")
    assert {x.node: x.level for x in logic.levels(rows, known).collect()} == {i: 2 if (n - 1 - i) % 2 == 0 else 0 for i in range(n)}


def test_levels_of_wide_nodes_cycles_and_nothing(spark):
    wide = [(1, 0, None, "OR")] + [(1, i, 0, "LEAF") for i in range(1, 3000)]
    odd = [(2, 0, None, "AND"), (2, 1, 0, "LEAF"), (2, 2, 3, "OR"), (2, 3, 2, "AND"), (2, 4, 0, "OR"), (2, 5, 99, "LEAF"), (None, 1, None, "LEAF"), (3, None, None, "LEAF")]
    rows = spark.createDataFrame(wide + odd, NODES)
    known = spark.createDataFrame([(1, i, int(i == 2999) * 2) for i in range(1, 3000)] + [(2, 1, 2), (2, 5, 0), (None, 1, 2)], "tree int, node int, level int")
    found = {(x.tree, x.node): x.level for x in logic.levels(rows, known).where("tree IS NULL OR tree > 1 OR node = 0").collect()}
    assert found == {(1, 0): 2, (2, 0): 1, (2, 1): 2, (2, 2): 1, (2, 3): 1, (2, 4): 1, (2, 5): 0, (None, 1): 1, (3, None): 1}
    assert logic.levels(rows.where("false"), known).count() == 0


def test_chains_of_a_thousand_are_sound_and_cycles_named(spark):
    rows = [("chain", i, i - 1 if i else None) for i in range(1000)]
    for size in (1, 2, 3, 64, 65, 1000):
        rows += [(f"cycle{size}", i, (i + 1) % size) for i in range(size)] + [(f"cycle{size}", 5000 + i, 5000 + i - 1 if i else 0) for i in range(40)]
    rows += [("dangling", 1, 2), ("root", 1, None)]
    nodes = spark.createDataFrame(rows, "tree string, node int, parent int")
    found = {}
    for x in logic.endless(nodes).collect():
        found.setdefault(x.tree, {})[x.node] = x.on_cycle
    assert found == {f"cycle{n}": {**{i: True for i in range(n)}, **{5000 + i: False for i in range(40)}} for n in (1, 2, 3, 64, 65, 1000)}
    assert logic.endless(nodes.where("false")).count() == 0


def test_deep_sound_trees_have_no_faults(spark):
    n = 300
    plain = "tree int, node string, parent string, operator string, owner string, position int"
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None, "NOT" if i < n - 1 else "LEAF", "o", i) for i in range(n)]
    held = spark.createDataFrame([(f"n{n - 1}", "o")], "node string, owner string")
    assert structured.set_faults(spark.createDataFrame(rows, plain), held).collect() == []


def test_shapes(spark):
    rows = [
        (1, 0, None, "AND", None, 0), (1, 1, 0, "LEAF", 7, 1), (1, 2, 0, "LEAF", 7, 2), (1, 3, 0, "NOT", None, 3), (1, 4, 3, "NOT", None, 4), (1, 5, 4, "LEAF", 8, 5),
        (2, 0, None, "OR", None, 0), (2, 1, 0, "LEAF", 1, 0), (2, 9, None, "LEAF", 2, -1), (2, 5, 6, "AND", None, 5), (2, 6, 5, "AND", None, 6), (2, 7, 6, "LEAF", 3, None), (2, 8, 77, "LEAF", 4, 8),
        (3, 0, None, "NOT", None, 0), (3, 1, 0, "LEAF", 1, 1), (3, 2, 0, "LEAF", 2, 2), (3, 3, 0, "OR", None, 3), (3, 2, 0, "LEAF", 2, 2)]
    nodes = spark.createDataFrame(rows, NODES + ", fact int, position int")
    assert sorted(map(tuple, logic.shape_faults(nodes).collect())) == sorted([
        (1, 2, "DUPLICATE_LEAF"), (1, 4, "DOUBLE_NEGATION"), (2, 0, "INVALID_UNARY_GROUP"), (2, 0, "SOURCE_ORDER"), (2, 1, "SOURCE_ORDER"), (2, 9, "DISCONNECTED"), (2, 9, "SOURCE_ORDER"), (2, 5, "CYCLE_DETECTED"),
        (2, 5, "INVALID_UNARY_GROUP"), (2, 6, "CYCLE_DETECTED"), (2, 7, "DISCONNECTED"), (2, 7, "SOURCE_ORDER"), (2, 8, "DANGLING_REFERENCE"), (3, 0, "INVALID_NOT"), (3, 2, "DUPLICATE_ID"), (3, 3, "NO_CHILDREN")])


@pytest.mark.parametrize("seed", [1, 2])
def test_branches_and_modality(spark, seed):
    r = random.Random(seed)
    roots = {f"t{i}": r.choice([0, 1, 2]) for i in range(12)}
    pick = lambda *more: r.choice([*roots, "gone", *more])
    branches = {f"b{i}": (pick(), pick(), pick(None)) for i in range(20)}
    rows = [(i // 3, i, r.random() < 0.9, r.choice(["MANDATORY", "MANDATORY", "PREFERRED", None]), pick(None, None, None, None, None, None, None, None, None, None), *r.choice([(pick(), None), (None, r.choice([*branches, "gone"]))])) for i in range(90)]
    conditions = spark.createDataFrame(rows, "owner int, condition int, resolved boolean, modality string, applies string, tree string, branch string")
    table = spark.createDataFrame(list(roots.items()), "tree string, level int")
    sets = spark.createDataFrame([(k, *v) for k, v in branches.items()], "branch string, when_tree string, then_tree string, else_tree string")

    def plain(row):
        _, _, resolved, modality, applies, tree, branch = row
        level = lambda t: roots.get(t, 1)
        if not resolved:
            return 1
        if modality != "MANDATORY":
            return 2
        if applies is not None and level(applies) != 2:
            return 2 if level(applies) == 0 else 1
        if branch is None:
            return level(tree)
        if branch not in branches:
            return 1
        when, then, other = branches[branch]
        return level(then) if level(when) == 2 else 1 if level(when) == 1 else 2 if other is None else level(other)

    found = logic.condition_outcomes(conditions, table, sets)
    assert {x.condition: (x.level, x.has_unknown) for x in found.collect()} == {row[1]: (plain(row), plain(row) == 1) for row in rows}
    owners = spark.createDataFrame([(i,) for i in range(31)], "owner int")
    results = {x.owner: x.result for x in logic.set_results(found, owners, "owner").collect()}
    for owner in range(31):
        own = [plain(row) for row in rows if row[0] == owner]
        assert results[owner] == ("INSUFFICIENT" if 1 in own else "NOT_MATCH" if 0 in own else "MATCH")


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """Joins of rounds grow with the trees, whatever few bytes their files take."""
    plans, write = [], logic.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(logic, "stored", seen)
    nodes = spark.createDataFrame([(1, "r", None, "AND"), (1, "a", "r", "OR"), (1, "b", "a", "LEAF")], "tree int, node string, parent string, operator string")
    assert logic.levels(nodes, spark.createDataFrame([(1, "b", 2)], "tree int, node string, level int")).count() == 3
    assert logic.endless(nodes).count() == 0
    assert len(plans) == 6 and not any("Broadcast" in p for p in plans)


def test_walks_that_have_ended_are_not_written_again(spark, monkeypatch):
    """A star of 1000 leaves, a chain of five and a cycle: rounds hold what still points anywhere."""
    sizes, write = [], logic.stored

    def counted(df, name):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(logic, "stored", counted)
    rows = [(1, "r", None), *[(1, f"n{i}", "r") for i in range(1000)], (2, "a", None), (2, "b", "a"), (2, "c", "b"), (2, "d", "c"), (2, "e", "d"), (3, "x", "y"), (3, "y", "x"), (3, "z", "x"), (4, "q", "gone")]
    found = logic.endless(spark.createDataFrame(rows, "tree int, node string, parent string")).collect()
    assert sorted(map(tuple, found)) == [(3, "x", True), (3, "y", True), (3, "z", False)]
    assert sizes[:4] == [1007, 6, 4, 3]
