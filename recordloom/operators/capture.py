"""Captured runs: where paging stopped and why, blobs by content, and what several sources add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paging_stops(pages: DataFrame, run: str, number: str, locator: str, hash_col: str, items: str, more: str, most_pages: int, most_bytes: int, size: str) -> DataFrame:
    """run, number, stop: the page at which a run had to stop, by the first reason that holds.

    REPEATED_LOCATOR and REPEATED_CONTENT name the page that repeats an earlier
    one; EXPLICIT_EMPTY one without items; MAX_PAGES and BUDGET the first page
    at a limit; LAST_PAGE the one that no other follows.
    """
    w = Window.partitionBy(run).orderBy(number)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda c: F.row_number().over(Window.partitionBy(run, c).orderBy(number)) > 1
    stop = (
        F.when(seen(locator), "REPEATED_LOCATOR")
        .when(seen(hash_col), "REPEATED_CONTENT")
        .when(F.col(items) == 0, "EXPLICIT_EMPTY")
        .when(F.sum(size).over(so_far) >= most_bytes, "BUDGET")
        .when(F.row_number().over(w) >= most_pages, "MAX_PAGES")
        .when(~F.col(more), "LAST_PAGE")
    )
    stops = pages.withColumn("stop", stop).where("stop IS NOT NULL")
    return stops.groupBy(run).agg(F.min_by(F.struct(number, "stop"), number).alias("s")).select(run, "s.*")


def captured(responses: DataFrame, store: DataFrame, content: str, failed: str) -> tuple[DataFrame, DataFrame]:
    """(snapshots, new blobs): each response with the hash of its bytes, null if it failed; blobs that the store lacks, once each."""
    hashed = responses.withColumn("content_hash", F.when(~F.col(failed), F.sha2(F.col(content), 256)))
    blobs = hashed.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.any_value(content).alias(content), F.any_value(F.octet_length(content)).alias("byte_length"))
    return hashed.drop(content), blobs.join(store.select("content_hash"), "content_hash", "left_anti")


def corrupted(blobs: DataFrame, content: str) -> DataFrame:
    """Blobs whose bytes don't have the hash that names them."""
    return blobs.where(F.sha2(F.col(content), 256) != F.col("content_hash"))


def composition(surfaces: DataFrame, bindings: DataFrame, keys: list[str], surface: str, material: str) -> DataFrame:
    """keys, status of a position's sources: BLOCKED if one of its material surfaces is bound to nothing, AMBIGUOUS if to several, INVENTORY_EMPTY without any, else COMPLETE."""
    bound = bindings.groupBy(*keys, surface).agg(F.count("*").alias("n"))
    g = surfaces.join(bound, [*keys, surface], "left").groupBy(*keys)
    g = g.agg(F.count_if(material).alias("material"), F.count_if(F.col(material) & F.col("n").isNull()).alias("unbound"), F.count_if(F.col(material) & (F.col("n") > 1)).alias("several"))
    status = F.when(F.col("material") == 0, "INVENTORY_EMPTY").when(F.col("unbound") > 0, "BLOCKED").when(F.col("several") > 0, "AMBIGUOUS").otherwise("COMPLETE")
    return g.select(*keys, status.alias("status"))


def blockers(rows: DataFrame, kind: str, reason: str, id_col: str) -> DataFrame:
    """kind, reason, n, first_id: how often each blocker occurs, and one row that shows it."""
    return rows.groupBy(kind, reason).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
