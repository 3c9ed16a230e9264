"""Source health as a stream: the same figures as operators.ledger.source_health, run by run as they arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, at timestamp, run long, consecutive_success int, consecutive_failure int, last_hash string, status string"


def stream_health(runs: DataFrame, key: str, at: str, run: str, success: Column, hash_col: str, risk: Column, fails: int = 2) -> DataFrame:
    """A streaming frame of runs to their health.

    Each key keeps two counters and the last hash.  A key's runs of one
    micro-batch are taken in order of time and id, so they are in memory
    together: the source must bound a micro-batch, by maxFilesPerTrigger or the
    like, with files in the order of time.  A run that comes in a later batch
    than a younger one counts when it comes.
    """
    rows = runs.select(
        F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(run).cast("long").alias("run"),
        F.coalesce(success, F.lit(False)).alias("ok"), F.col(hash_col).alias("hash"), F.coalesce(risk, F.lit(False)).alias("risk"))

    def step(_, batches, state: GroupState):
        good, bad, last = state.get if state.exists else (0, 0, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "run"], kind="stable").itertuples(index=False):
            good, bad = (good + 1, 0) if r.ok else (0, bad + 1)
            last = r.hash if r.ok and r.hash is not None else last
            status = "REVIEW_REQUIRED" if r.risk else "HEALTHY" if r.ok else "FAILED" if bad >= fails else "DEGRADED"
            out.append((r.key, r.at, r.run, good, bad, last, status))
        state.update((good, bad, last))
        yield pd.DataFrame(out, columns=["key", "at", "run", "consecutive_success", "consecutive_failure", "last_hash", "status"])

    return rows.groupBy("key").applyInPandasWithState(step, OUT, "good int, bad int, last string", "append", GroupStateTimeout.NoTimeout)


def stream_missing(sightings: DataFrame, key: str, run: str, counts: Column, seen: Column) -> DataFrame:
    """A streaming frame of (key, run) sightings to their missing streaks, as operators.diff.missing_streaks has them."""
    rows = sightings.select(F.col(key).cast("long").alias("key"), F.col(run).cast("long").alias("run"), counts.alias("counts"), seen.alias("seen"))

    def step(_, batches, state: GroupState):
        (streak,) = state.get if state.exists else (0,)
        out = []
        for r in pd.concat(list(batches)).sort_values("run", kind="stable").itertuples(index=False):
            missed = bool(r.counts and not r.seen)
            streak = 0 if r.counts and r.seen else streak + missed
            out.append((r.key, r.run, streak, missed))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["key", "run", "streak", "missing_event"])

    return rows.groupBy("key").applyInPandasWithState(step, "key long, run long, streak int, missing_event boolean", "streak int", "append", GroupStateTimeout.NoTimeout)
