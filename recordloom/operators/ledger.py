"""Ordered operators: health, cadence, hash chains, journals, quotas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import first_value, last_value, pieced, running_sum, scanned, since, value_before


def source_health(runs: DataFrame, keys: list[str], order: list[str], success: Column, hash_col: str, risk: Column, fails: int = 2, pieces: int | None = None) -> DataFrame:
    """runs with consecutive_success, consecutive_failure, last_hash and status after each run.

    The last hash of a successful run carries over failures.  A risk asks for
    review whatever the outcome; else success is HEALTHY, `fails` failures on
    end are FAILED, fewer DEGRADED.  A key of very many runs is read by many
    tasks (see operators.prefix; pieces: how many, whatever their number);
    order must tell them apart.
    """
    ok = F.coalesce(success, F.lit(False))
    rows = runs.withColumns({"__ok": ok.cast("int"), "__bad": (~ok).cast("int"), "__risk": F.coalesce(risk, F.lit(False)), "__hash": F.when(ok, F.col(hash_col))})
    good, bad = F.col("__ok"), F.col("__bad")
    out = scanned(pieced(rows, keys, order, pieces), keys, [since("consecutive_success", good, bad), since("consecutive_failure", bad, good), last_value("last_hash", F.col("__hash"))])
    out = out.withColumns({"consecutive_success": F.col("consecutive_success").cast("int"), "consecutive_failure": F.col("consecutive_failure").cast("int")})
    status = F.when(F.col("__risk"), "REVIEW_REQUIRED").when(good == 1, "HEALTHY").when(F.col("consecutive_failure") >= fails, "FAILED").otherwise("DEGRADED")
    return out.withColumn("status", status).select(*runs.columns, "consecutive_success", "consecutive_failure", "last_hash", "status")


def cadence_gate(events: DataFrame, key: str, at: str, order: str, gap_s: int) -> DataFrame:
    """key, at, order of the events that pass: at least gap_s after the last one that passed.

    What passes depends on what passed before, so no window function gives it.
    Sorted partitions are read once; a task keeps one row of state and jumps
    from one event that passes to the next, so a key of any size takes no
    memory.  Rows with a null key or time don't pass.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(order).cast("long").alias("order"))
    rows = rows.where("key IS NOT NULL AND at IS NOT NULL").repartition("key").sortWithinPartitions("key", "at", "order")
    gap = gap_s * 1_000_000

    def run(batches):
        now, last = None, 0
        for batch in batches:
            keys, times = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            passed, i = [], 0
            while i < len(keys):
                if keys[i] != now:
                    now, last = keys[i], times[i]
                    passed.append(i)
                    i += 1
                    continue
                end = int(np.searchsorted(keys, now, "right"))
                i += int(np.searchsorted(times[i:end], last + gap))
                if i < end:
                    last = times[i]
                    passed.append(i)
                    i += 1
            yield batch.take(pa.array(passed, pa.int64()))

    out = rows.mapInArrow(run, "key long, at long, order long")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(at), F.col("order").alias(order))


def chained(df: DataFrame, keys: list[str], order: list[str], payload: Column, pieces: int | None = None) -> DataFrame:
    """df with sequence, record_hash and previous_hash (64 zeros at first); a record's hash covers its own payload."""
    rows = pieced(df.withColumn("record_hash", F.sha2(payload, 256)), keys, order, pieces)
    out = scanned(rows, keys, [running_sum("sequence", F.lit(1)), value_before("previous_hash", F.col("record_hash"))])
    out = out.withColumns({"sequence": F.col("sequence").cast("int"), "previous_hash": F.coalesce(F.col("previous_hash.value"), F.lit("0" * 64))})
    return out.select(*[c for c in df.columns if c not in ("record_hash", "sequence", "previous_hash")], "record_hash", "sequence", "previous_hash")


def chain_faults(df: DataFrame, keys: list[str], sequence: str, record: str, previous: str, payload: Column | None = None, scope: str | None = None, pieces: int | None = None) -> DataFrame:
    """Rows that break a hash chain, with fault: SEQUENCE, LINK, PAYLOAD or SCOPE; a key of very many rows is read by many tasks."""
    steps = [running_sum("__number", F.lit(1)), value_before("__link", F.col(record))]
    rows = scanned(pieced(df, keys, [sequence, record], pieces), keys, steps + ([first_value("__scope", F.col(scope))] if scope is not None else []))
    fault = F.when(F.col(sequence) != F.col("__number"), "SEQUENCE").when(F.col(previous) != F.coalesce(F.col("__link.value"), F.lit("0" * 64)), "LINK")
    if payload is not None:
        fault = fault.when(F.col(record) != F.sha2(payload, 256), "PAYLOAD")
    if scope is not None:
        fault = fault.when(~F.col(scope).eqNullSafe(F.col("__scope.value")), "SCOPE")
    return rows.withColumn("fault", fault).where("fault IS NOT NULL").select(*df.columns, "fault")


def batch_status(statuses: DataFrame, batch: str, status: str, deferred: str) -> DataFrame:
    """batch, status: DEFERRED if nothing ran and only the cadence held runs back, SUCCESS if all that ran is acceptable and nothing else was held back, PARTIAL if some is, else FAILED.

    A row is a run (status set) or a deferral (deferred set to its reason).
    """
    g = statuses.groupBy(batch).agg(
        F.count(status).alias("ran"),
        F.count_if(F.col(status).isin("SUCCESS", "NOT_MODIFIED", "CONFIRMED_EMPTY")).alias("ok"),
        F.count(deferred).alias("held"),
        F.count_if(F.col(deferred).isNotNull() & (F.col(deferred) != "CADENCE_DENIED")).alias("blocked"),
    )
    out = (
        F.when((F.col("ran") == 0) & (F.col("held") > 0) & (F.col("blocked") == 0), "DEFERRED")
        .when((F.col("ok") == F.col("ran")) & (F.col("blocked") == 0) & (F.col("ok") > 0), "SUCCESS")
        .when(F.col("ok") > 0, "PARTIAL")
        .otherwise("FAILED")
    )
    return g.select(batch, out.alias("status"))


def quota_top(df: DataFrame, flag: Column, order: list, limit: int, share: float = 0.3) -> DataFrame:
    """`limit` rows: first up to ceil(share * limit) flagged ones in order, then the first of all others, flagged or not.

    Both picks are top-k aggregations; no more than 2 * limit rows meet in a task.
    """
    quota = -(-int(round(limit * share * 1000)) // 1000)
    flagged = df.where(flag).orderBy(*order).limit(quota).withColumn("__turn", F.lit(0))
    some = df.orderBy(*order).limit(limit).withColumn("__turn", F.lit(1))
    both = flagged.unionByName(some)
    once = both.groupBy(*df.columns).agg(F.min("__turn").alias("__turn"))
    return once.orderBy("__turn", *order).limit(limit).drop("__turn")


def budget_faults(use: DataFrame, key: str, caps: dict[str, int]) -> DataFrame:
    """Rows of use that pass a cap: key, budget, used, cap."""
    items = F.array(*[F.struct(F.lit(n).alias("budget"), F.col(n).cast("long").alias("used"), F.lit(c).cast("long").alias("cap")) for n, c in caps.items()])
    return use.select(key, F.inline(items)).where("used > cap")
