"""Pages by rank against slices of the sorted rows."""

import random

from pyspark.sql import functions as F

from recordloom.operators import query


def test_pages_by_rank(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1.5, 2.5, 3.5]), r.choice("abc")) for i in range(700)]
    order = [F.desc("x"), "s", "i"]
    index = query.RankIndex(spark.createDataFrame(rows, "i int, x double, s string").repartition(6), order, 9)
    ordered = sorted(rows, key=lambda t: (t[1] is None, -(t[1] or 0), t[2], t[0]))
    for offset, limit in [(0, 5), (3, 200), (77, 1), (350, 300), (690, 40), (699, 1), (700, 5), (10**9, 5)]:
        found = index.page(offset, limit)
        assert [tuple(x)[:3] for x in found.collect()] == ordered[offset : offset + limit]
        assert {x.total for x in found.collect()} <= {700}
    plan = index.page(350, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan or "SinglePartition" in plan or "rangepartitioning" in plan
    index.close()


def test_both_ways_to_a_page_agree(spark, monkeypatch):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 101).alias("k"))
    near = [tuple(x) for x in query.page(df, ["k", "id"], 130, 50).collect()]
    monkeypatch.setattr(query, "FIRST_ROWS", 100)
    assert [tuple(x) for x in query.page(df, ["k", "id"], 130, 50).collect()] == near and len(near) == 50
    assert query.page(df.where("false"), ["k", "id"], 130, 50).count() == 0
