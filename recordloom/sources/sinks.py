"""Sinks: CSV, public snapshots, static mirrors, index rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical_json, sha256
from ..functions.text import csv_cell


def csv_lines(df: DataFrame, columns: list[str], guard: bool = True) -> DataFrame:
    """One `line` of quoted cells for each row; write it with a header line and a byte order mark by write_csv."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c), guard) for c in columns]).alias("line"))


def write_csv(df: DataFrame, columns: list[str], path: str, guard: bool = True) -> None:
    """CSV files of quoted cells; every file begins with the column names, the first of them behind a byte order mark."""
    named = df.select(*[F.when(F.col(c).cast("string").rlike("^[=+@\\-\\t\\r]") & F.lit(guard), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(("﻿" if i == 0 else "") + c) for i, c in enumerate(columns)])
    named.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def public_snapshot(df: DataFrame, status: str, reasons: str, public: list[str], fields: list[str]) -> DataFrame:
    """payload and its hash for each row that may be shown; reasons outside the public ones are left out."""
    shown = df.where(F.col(status) != "NOT_DISPLAY")
    kept = F.array_sort(F.array_intersect(F.coalesce(reasons, F.array().cast("array<string>")), F.array(*map(F.lit, public))))
    payload = canonical_json({**{f: F.col(f) for f in fields}, status: F.col(status), reasons: kept})
    return shown.select(payload.alias("payload")).withColumn("hash", sha256(F.col("payload")))


def oversized(snapshot: DataFrame, most_bytes: int) -> DataFrame:
    """One row (bytes, most) if the snapshot is larger than it may be."""
    return snapshot.agg(F.sum(F.octet_length("payload")).alias("bytes")).where(F.col("bytes") > most_bytes).withColumn("most", F.lit(most_bytes))


def index_rebuild(df: DataFrame, keys: list[str], path: str) -> str:
    """Write the rows by key and return a hash of the content that does not depend on their order or files.

    The hash adds up row hashes in four lanes, so nothing is gathered.
    """
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    row = canonical_json({c: F.col(c) for c in df.columns})
    lanes = [F.sum(F.conv(F.substring(sha256(row), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    got = df.agg(F.count("*"), *lanes).first()
    return df.sparkSession.range(1).select(sha256(F.lit("|".join(map(str, got))))).first()[0]
