"""Checkpoints, the artifacts that they cover, and expected heads, against plain walks."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from recordloom.operators import folds, journal, versioning


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_checkpoints(spark):
    r = random.Random(3)
    rows, artifacts, marks, want = [], [], [], {}
    for stream, n in (("hot", 900), ("a", 30), ("late", 20), ("none", 5)):
        rows += [(stream, i, sha(f"{stream}{i}")) for i in range(1, n + 1)]
        own = [(stream, r.randint(1, n), r.choice(["x", "y"]), f'id"{k}é', sha(str(k))) for k in range(n)]
        artifacts += own
        if stream == "none":
            continue
        places = [0] * (stream != "late") + sorted(r.sample(range(1, n + 1), 7)) + [n + 50] * (stream == "a")
        before, last = None, -1
        for k, s in enumerate(places):
            inside = sorted(json.dumps({"artifact_id": i, "artifact_type": t, "seal": h}, separators=(",", ":"), ensure_ascii=False) for _, f, t, i, h in own if last < f <= s)
            made = sha("[" + ",".join(inside) + "]")
            head = "0" * 64 if s == 0 else sha(f"{stream}{s}")
            faults = ["GENESIS"] if k == 0 and s else ["POSITION"] if s > n else []
            if k in (2, 4, 6):
                faults = [{2: "CHAIN", 4: "HEAD", 6: "ARTIFACT_SET"}[k]] + faults
            marks.append((stream, s, "bad" if k == 4 else head, "bad" if k == 6 else made, sha(f"c{stream}{s}"), "bad" if k == 2 else before))
            want[stream, s] = (len(inside), made, faults)
            before, last = sha(f"c{stream}{s}"), s
    table = lambda x, s: spark.createDataFrame(x, s).repartition(5)
    found = journal.checkpoint_faults(
        table(marks, "stream string, sequence int, head_hash string, artifact_set_hash string, checkpoint_hash string, previous_checkpoint_hash string"),
        table(rows, "stream string, sequence int, record_hash string"), table(artifacts, "stream string, first_sequence int, artifact_type string, artifact_id string, seal string"))
    assert {(x.stream, x.sequence): (x.artifacts, x.set_hash, x.faults) for x in found.collect()} == want


def test_expected_heads(spark):
    rows = [("p", 1, None, "a"), ("p", 2, 0, "a"), ("p", 3, 0, "b"), ("p", 4, 1, "a"), ("p", 5, 1, "b"), ("p", 6, 1, "c"), ("p", 7, 2, "c"), ("q", 1, 3, "a"), ("q", 2, 0, None), ("q", 3, 1, None)]
    found = folds.expected_heads(spark.createDataFrame(rows, "k string, n int, seen int, content string"), "k", ["n"], "seen", "content").collect()
    assert {(x.k, x.n): (x.outcome, x.revision, x["head"]) for x in found} == {
        ("p", 1): ("LACKS_HEAD", None, 0), ("p", 2): ("ISSUED", 1, 1), ("p", 3): ("STALE", None, 1), ("p", 4): ("SAME", 1, 1), ("p", 5): ("ISSUED", 2, 2),
        ("p", 6): ("STALE", None, 2), ("p", 7): ("ISSUED", 3, 3), ("q", 1): ("STALE", None, 0), ("q", 2): ("ISSUED", 1, 1), ("q", 3): ("SAME", 1, 1)}


def test_checkpoints_are_signed_without_comparing_ranges(spark, monkeypatch):
    """No checkpoint is compared with all artifacts of its stream."""
    from recordloom.plans import history

    plans, write = [], history.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(history, "stored", seen)
    found = history.q_checkpoint_faults(spark, "/root/testdata/sf0.001")
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) == 3 and not any("Join" in line and "=" in line and "<" in line for p in plans for line in p.splitlines())


def test_rows_of_one_revision_and_id_stand_by_content(spark):
    rows = [(1, 1, 7, "B"), (1, 1, 7, "A"), (1, 2, 7, "B"), (2, 1, 7, "A"), (2, 1, 7, "B"), (2, 2, 7, "B")]
    for some in (rows, rows[::-1]):
        lines = spark.createDataFrame(some, "k int, n int, id int, c string").coalesce(1).withColumn("before", F.when((F.col("n") > 1) | (F.col("c") == "B"), F.col("id")))
        found = versioning.chain_breaks(lines, ["k"], "n", "c", "before", "id").select("k", "n", "c", "reason").collect()
        assert sorted(map(tuple, found)) == [(k, n, "B", r) for k in (1, 2) for n, r in ((1, "DUPLICATE"), (2, "NO_OP"))]
