"""Ledgers as streams with state variables against the same ledgers in one go, across restarts."""

import random
import uuid

from pyspark.sql import functions as F

from recordloom.operators import folds
from recordloom.sources.stored import shared_dir
from recordloom.streaming import ledgers

EVENTS = "k long, n int, kind string, at long, run string, success boolean, risk boolean, eligible boolean"


def events(seed, n):
    r = random.Random(seed)
    kinds = ["REGISTER", "RECONCILE", "WHAT"] + 8 * ["CLAIM"] + 8 * ["COMPLETE"]
    flag = lambda: r.random() < 0.97
    return [(r.choice([1, 1, 1, 2, 3]), i, r.choice(kinds), i * 10, r.choice([None, f"r{i // 9}", f"r{i // 9}", f"r{i // 9}"]), r.choice([True, False, None]), False, flag()) for i in range(n)]


def run(spark, parts, schema, follow):
    """One stream over the parts as they come, started anew for each."""
    spark.conf.set(*ledgers.STORE)
    base = f"{shared_dir(spark)}/flows-{uuid.uuid4().hex}"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def test_schedules_across_restarts(spark):
    rows = events(1, 240) + [(9, 240 + i, kind, 5000 + i * 10, run, True, False, True) for i, (kind, run) in enumerate([("REGISTER", None), ("CLAIM", "x"), ("COMPLETE", "x"), ("CLAIM", "x")])]
    batch = folds.schedules(spark.createDataFrame(rows, EVENTS), "k", ["n"], 5)
    found = run(spark, [rows[:100], rows[100:]], EVENTS, lambda e: ledgers.stream_schedules(e, "k", ["n"], 5))
    pick = lambda df: sorted(map(tuple, df.select("n", "fault", "status", "next_run", "failures").collect()), key=str)
    assert pick(found) == pick(batch)
    faults = {r.fault for r in batch.collect()}
    assert {"RUN_USED", "RUN_OPEN", "KIND", None} <= faults


class Handle:
    """State variables in memory, in place of the store."""

    def __init__(self):
        self.ttl = {}

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value, ttl):
        self.ttl[name] = ttl
        return Map()


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held):
        self.held = held


class Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value


def test_state_goes_on_and_ids_have_a_time_to_live():
    import pandas as pd

    names = [f.split()[0] for f in EVENTS.split(", ")]
    flow = ledgers.Replay(folds.schedule_step(10), folds.schedule_start(), {"used": 60000}, ["n"], ["fault", "status", "next_run", "failures"])
    handle = Handle()
    flow.init(handle)
    assert handle.ttl == {"used": 60000}
    rows = [(1, 1, "CLAIM", 1, "r", None, False, True), (1, 0, "REGISTER", 0, None, None, False, True), (1, 2, "COMPLETE", 2, "r", True, False, True)]
    assert [f.fault.tolist() for f in flow.handleInputRows((1,), iter([pd.DataFrame(rows[:1], columns=names), pd.DataFrame(rows[1:], columns=names)]), None)] == [[None, None, None]]
    again = pd.DataFrame([(1, 3, "CLAIM", 900, "r", None, False, True), (1, 4, "CLAIM", 901, "s", None, False, True)], columns=names)
    assert [f.fault.tolist() for f in flow.handleInputRows((1,), iter([again]), None)] == [["RUN_USED", None]]


def test_ids_that_occur_once_need_not_be_remembered(spark):
    """Used runs as a plain set of all of them gives the same faults."""
    rows = events(7, 400)
    found = {r.n: r.fault for r in folds.schedules(spark.createDataFrame(rows, EVENTS), "k", ["n"], 20).collect()}
    step, states = folds.schedule_step(20), {}
    names = [f.split()[0] for f in EVENTS.split(", ")]
    for row in rows:
        e = dict(zip(names, row))
        assert found[e["n"]] == step(states.setdefault(e["k"], folds.schedule_start()), e)["fault"]
    repeated = folds._with_repeats(spark.createDataFrame(rows, EVENTS), "k", "run", "CLAIM").where(F.col("kind") == "CLAIM")
    assert 0 < repeated.where(f"NOT {folds.AGAIN}").count() < repeated.count()


def test_budget_across_a_restart(spark):
    schema = "k long, n int, kind string, intent string, organization string, target string, at long, status string, bytes long"
    r = random.Random(5)
    rows = [(n % 2, n, r.choice(["RESERVE", "SENT", "OBSERVE"]), f"i{n // 6}", f"o{r.randint(0, 2)}", f"t{r.randint(0, 3)}", n * 50, r.choice(["SUCCESS", "NETWORK_FAILURE"]), r.choice([None, 10, 400])) for n in range(160)]
    caps = (9, 3, 3, 2000, 450, 3, 100, 600)
    batch = folds.request_budget(spark.createDataFrame(rows, schema), "k", ["n"], *caps)
    found = run(spark, [rows[:70], rows[70:]], schema, lambda e: ledgers.stream_budget(e, "k", ["n"], *caps))
    pick = lambda df: sorted(map(tuple, df.select("n", "fault", "used_bytes").collect()), key=str)
    assert pick(found) == pick(batch)


def test_a_batch_asks_the_store_once_for_an_entry():
    """A key's events of one batch read its requests once and write each once."""
    import pandas as pd

    calls = []

    class Counted(Map):
        def containsKey(self, key):
            calls.append("contains")
            return key in self

        def updateValue(self, key, value):
            calls.append("update")
            self[key] = value

        def iterator(self):
            calls.append("iterator")
            return iter(list(self.items()))

    class CountedHandle(Handle):
        def getMapState(self, name, key, value, ttl):
            return Counted()

    step = folds.budget_step(100, 9, 9, 10**9, 450, 100, 0, 0)
    kinds = ["RESERVE", "SENT", "OBSERVE"]
    rows = [(n, kinds[n % 3], f"i{n // 3}", "o", "t", n, "SUCCESS", 10) for n in range(60)]
    names = ["n", "kind", "intent", "organization", "target", "at", "status", "bytes"]
    flow, whole, found = ledgers.Replay(step, folds.budget_start(), {"requests": None}, ["n"], ["fault", "used_bytes"]), folds.budget_start(), []
    flow.init(CountedHandle())
    for part in (rows[:31], rows[31:]):
        found += [r for f in flow.handleInputRows((1,), iter([pd.DataFrame(part, columns=names)]), None) for r in zip(f.fault, f.used_bytes)]
    assert found == [tuple(step(whole, dict(zip(names, r))).values()) for r in rows]
    assert calls.count("iterator") == 2 and calls.count("update") == 21 and calls.count("contains") <= 21
