"""Complete-link groups by rounds against the greedy order itself."""

import random

import pytest

from recordloom.operators import resolve

PAIR = "component string, l long, r long"


def greedy(ids, pairs):
    friends = {}
    for a, b in pairs:
        friends.setdefault(a, set()).add(b)
        friends.setdefault(b, set()).add(a)
    groups = []
    for i in sorted(ids):
        home = next((g for g in groups if friends.get(i, set()).issuperset(g)), None)
        if home is None:
            groups.append(home := [])
        home.append(i)
    return {i: g[0] for g in groups for i in g}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    ids, pairs, want = [], [], {}
    for c in range(12):
        own = r.sample(range(c * 1000, c * 1000 + 900), r.choice([1, 2, 6, 14]))
        edges = [(a, b) for a in own for b in own if a < b and r.random() < r.choice([0.3, 0.6, 0.9])]
        name = None if c == 5 else str(c)
        ids += [(name, i) for i in own]
        pairs += [(name, *r.choice([(a, b), (b, a)])) for a, b in edges] + [(name, a, b) for a, b in edges[:2]]
        want |= greedy(own, edges)
    pairs += [("0", 1, 777777), ("1", 1000, None), ("2", 2000, 2000)]
    found = resolve.complete_link(spark.createDataFrame(ids, "component string, id long").repartition(3), spark.createDataFrame(pairs, PAIR), "id", "component").collect()
    assert len(found) == len(ids) and {x.id: x.group_id for x in found} == want


def test_a_component_of_more_rows_than_a_task_should_hold(spark):
    r = random.Random(9)
    n = 5600
    names = r.sample(range(100000), n)
    pairs = {tuple(sorted((names[i], names[j]))) for i in range(1, n) for j in [r.randrange(max(0, i - 40), i)]}
    pairs |= {tuple(sorted(r.sample(names, 2))) for _ in range(2000)}
    # one row that merges with very many
    pairs |= {tuple(sorted((names[0], x))) for x in names[1:3000]}
    found = resolve.complete_link(spark.createDataFrame([("a", i) for i in names], "component string, id long"), spark.createDataFrame([("a", *p) for p in pairs], PAIR), "id", "component")
    assert {x.id: x.group_id for x in found.collect()} == greedy(names, pairs)


def test_nothing(spark):
    ids, pairs = spark.createDataFrame([], "component string, id long"), spark.createDataFrame([], PAIR)
    assert resolve.complete_link(ids, pairs, "id", "component").count() == 0
