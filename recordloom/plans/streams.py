"""Queries that run as streams until their input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.stored import shared_dir
from ..streaming import health, ledgers as flows
from . import ledgers
from .history import q_health
from .tables import ORACLES, query


#: Files of one micro-batch: what bounds the rows of a key that are in memory at once.
FILES = 8


def _drained(stream, name: str):
    """What a stream writes for the input that is there now; state and output lie in the folder that the session shares."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    job = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query(ORACLES[q_health.__name__])
def q_stream_health(spark, d):
    """q_health as a stream over the same events (M1)."""
    path = f"{d}/events.parquet"
    # a pattern, since a stream takes a plain path for a folder
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES).parquet(path + "*")
    out = _drained(health.stream_health(events, "user_id", "ts", "event_id", F.col("event_type") != "error", "props", F.col("value") > 200), "health")
    return out.select(F.col("key").alias("user_id"), F.col("run").alias("event_id"), "consecutive_success", "consecutive_failure", "last_hash", "status")


def _restarted(events, name: str, follow):
    """What a stream writes for the first half of the events and, started anew from its checkpoint, for the rest."""
    spark = events.sparkSession
    spark.conf.set(*flows.STORE)
    base = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    half = events.stat.approxQuantile("n", [0.5], 0.01)[0] if not events.isEmpty() else 0
    for part in (events.where(F.col("n") <= half), events.where(F.col("n") > half)):
        part.write.mode("append").parquet(f"{base}/in")
        stream = follow(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(f"{base}/in"))
        job = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query(ORACLES[ledgers.q_schedules.__name__])
def q_stream_schedules(spark, d):
    """q_schedules as a stream that is restarted half way (M2)."""
    return _restarted(ledgers.schedule_events(spark, d), "schedules", lambda e: flows.stream_schedules(e, "k", ["n"], 7200)).select("k", "id", "fault", "status", "next_run", "failures")


@query(ORACLES[ledgers.q_grant_ledger.__name__])
def q_stream_grants(spark, d):
    """q_grant_ledger as a stream that is restarted half way (M4)."""
    return _restarted(ledgers.grant_records(spark, d), "grants", lambda e: flows.stream_grants(e, "k", ["n"])).select("k", "id", "fault", "version")


@query(ORACLES[ledgers.q_request_budget.__name__])
def q_stream_budget(spark, d):
    """q_request_budget as a stream that is restarted half way."""
    return _restarted(ledgers.budget_events(spark, d), "budget", lambda e: flows.stream_budget(e, "k", ["n"], *ledgers.CAPS)).select("k", "id", "fault", "used_bytes")
