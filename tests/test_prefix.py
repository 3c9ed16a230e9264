"""Running values over histories cut into pieces, against a walk along each key."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import diff, ledger, prefix, versioning


def history(seed, n):
    r = random.Random(seed)
    keys = [None, 1, 1, 1, 1, 1, 2, 3, 4, 5]
    return [(r.choice(keys), i, r.choice([0, 1, 1, 2]), r.choice([None, "a", "b", "c"]), r.random() < 0.15) for i in range(n)]


@pytest.mark.parametrize("seed,n,pieces", [(1, 400, 9), (2, 400, 40), (3, 30, 30), (4, 60, 1), (5, 300, None)])
def test_steps_equal_a_walk(spark, seed, n, pieces):
    rows = history(seed, n)
    df = spark.createDataFrame(rows, "k int, at int, x int, v string, reset boolean").repartition(5)
    cut = prefix.pieced(df, ["k"], ["at"], pieces)
    if pieces is None:
        assert cut.select(prefix.PIECE).distinct().count() == 1
    elif pieces > 1:
        # the key of half of all rows is read by many tasks
        assert cut.where("k = 1").select(prefix.PIECE).distinct().count() > min(pieces, n) // 4
    counted, reset = (F.col("x") > 0).cast("int") * (~F.col("reset")).cast("int"), F.col("reset").cast("int")
    steps = [prefix.running_sum("total", F.col("x")), prefix.last_value("last", F.col("v")), prefix.last_before("prior", F.col("v")), prefix.value_before("before", F.col("v")), prefix.first_value("first", F.col("v")), prefix.since("streak", counted, reset)]
    found = {(r.k, r.at): (r.total, r["last"], r.prior, r.before and (r.before.value,), r["first"].value, r.streak) for r in prefix.scanned(cut, ["k"], steps).collect()}
    want, state = {}, {}
    for k, at, x, v, again in rows:
        s = state.setdefault(k, {"total": 0, "last": None, "before": None, "first": v, "streak": 0})
        prior = s["last"]
        s["total"] += x
        s["last"] = v if v is not None else s["last"]
        s["streak"] = 0 if again else s["streak"] + int(x > 0)
        want[k, at] = (s["total"], s["last"], prior, s["before"], s["first"], s["streak"])
        s["before"] = (v,)
    assert found == want


def test_no_rows_and_columns_that_are_there_already(spark):
    empty = spark.createDataFrame([], "k int, at int, c string, revision int")
    assert versioning.versions_latest(empty, ["k"], "c", ["at"]).count() == 0
    df = spark.createDataFrame([(1, 1, "a", 9), (1, 2, "a", 9), (1, 3, None, 9), (None, 1, None, 9)], "k int, at int, c string, revision int")
    out = versioning.versions_latest(df, ["k"], "c", ["at"])
    assert out.columns == ["k", "at", "c", "revision"] and sorted(map(tuple, out.collect()), key=str) == [(1, 1, "a", 1), (1, 2, "a", 1), (1, 3, None, 2), (None, 1, None, 1)]


@pytest.mark.parametrize("pieces", [None, 7])
def test_histories_of_one_key_alone(spark, pieces):
    """Chains, health, pages and streaks where all rows have one key, whole and in pieces."""
    n = 300
    df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("at"), (F.col("id") % 7 != 3).alias("ok"), F.concat(F.lit("h"), F.floor(F.col("id") / 5)).alias("h"), F.col("id").cast("string").alias("p"), F.when(F.col("id") == 200, "other").otherwise("one").alias("scope"))
    health = {r.at: r for r in ledger.source_health(df, ["k"], ["at"], F.col("ok"), "h", F.lit(False), pieces=pieces).collect()}
    assert all(health[i].consecutive_success == ((i - 4) % 7 + 1 if i > 3 else i + 1) * (i % 7 != 3) for i in range(n)) and health[3].last_hash == "h0"
    chain = ledger.chained(df, ["k"], ["at"], F.col("p"), pieces)
    assert [r.sequence for r in chain.orderBy("at").collect()] == list(range(1, n + 1))
    assert [(r.at, r.fault) for r in ledger.chain_faults(chain, ["k"], "sequence", "record_hash", "previous_hash", F.col("p"), "scope", pieces).collect()] == [(200, "SCOPE")]
    broken = chain.withColumn("previous_hash", F.when(F.col("at") == 150, "x").otherwise(F.col("previous_hash")))
    assert [(r.at, r.fault) for r in ledger.chain_faults(broken, ["k"], "sequence", "record_hash", "previous_hash", pieces=pieces).collect()] == [(150, "LINK")]
    pages = {r.at: r.change for r in diff.page_diff(df, ["k"], ["at"], "h", ~F.col("ok"), pieces).collect()}
    assert pages[0] == "NO_PREVIOUS" and pages[3] == "CURRENT_UNAVAILABLE" and pages[4] == "UNCHANGED" and pages[5] == "CHANGED" and pages[11] == "CHANGED" and pages[12] == "UNCHANGED"
    streaks = {r.at: r.streak for r in diff.missing_streaks(df, ["k"], ["at"], F.lit(True), F.col("at") % 100 == 0, pieces).collect()}
    assert streaks[299] == 99 and streaks[100] == 0 and streaks[150] == 50
