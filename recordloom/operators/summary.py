"""Aggregations: run audits, board figures, artifact sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_audit(requests: DataFrame, run: str, size: str, retries: Column, error: Column) -> DataFrame:
    """run, requests, bytes, retries, errors (distinct codes in order, comma-joined)."""
    codes = F.array_join(F.array_sort(F.collect_set(error)), ",")
    return requests.groupBy(run).agg(F.count("*").alias("requests"), F.sum(size).alias("bytes"), F.sum(retries).alias("retries"), codes.alias("errors"))


def board(rows: DataFrame, top: Column, open_: Column, unit: str, updated: Column) -> DataFrame:
    """One row: total, top, open, units, updated."""
    return rows.agg(F.count("*").alias("total"), F.count_if(top).alias("top"), F.count_if(open_).alias("open"), F.countDistinct(unit).alias("units"), F.max(updated).alias("updated"))


def cardinality(sets: DataFrame, owner: str, items: Column) -> DataFrame:
    """owner, n, n_distinct of array items; owners without items have none of either."""
    rows = sets.select(owner, F.explode_outer(items).alias("item"))
    return rows.groupBy(owner).agg(F.count("item").alias("n"), F.countDistinct("item").alias("n_distinct"))


def assertion_status(rows: DataFrame, keys: list[str], status: str, value: str) -> DataFrame:
    """keys, state of a set of assertions: REVIEW if one is or values differ, INSUFFICIENT if one is unknown or none is there, else COMPLETE."""
    g = rows.groupBy(*keys).agg(F.count(status).alias("n"), F.count_if(F.col(status) == "REVIEW").alias("review"), F.countDistinct(value).alias("values"), F.count_if(F.col(status) == "UNKNOWN").alias("unknown"))
    state = F.when((F.col("review") > 0) | (F.col("values") > 1), "REVIEW").when((F.col("unknown") > 0) | (F.col("n") == 0), "INSUFFICIENT").otherwise("COMPLETE")
    return g.select(*keys, state.alias("state"))


def sync_totals(crawled: DataFrame, existing: DataFrame, run: str, key: str, closes: Column) -> DataFrame:
    """run, discovered, added, updated, closed of a synchronisation (F3): what a crawl found, by whether the table had it; and what the table closes by itself.

    A key that a run finds twice is discovered twice, and added or updated as often.
    """
    held = existing.select(key).distinct().withColumn("__held", F.lit(True))
    g = crawled.join(held, key, "left").groupBy(run).agg(F.count("*").alias("discovered"), F.count_if(F.col("__held").isNull()).alias("added"), F.count("__held").alias("updated"))
    # one row, since the table is one
    return g.crossJoin(F.broadcast(existing.agg(F.count_if(closes).alias("closed"))))
