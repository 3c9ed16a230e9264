"""A reproducible shuffle into shards: a Feistel permutation of global row numbers, by DataFrame operations alone.

Rows are numbered from 0 in the order of their keys.  The numbers are permuted
by a Feistel network on a grid of a x b >= n cells, a and b about the root of
n; a number that leaves 0..n-1 goes round again until it is back (cycle
walking), which keeps this a permutation of 0..n-1.  Row p of the shuffle is in
shard p mod k at slot p div k, so shard sizes differ by one at most, slots have
no gaps, and both follow from a row's number without a look at other rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import partitions, stored

SHARDS = 8
SEED = 20
ROUNDS = 6
#: Times that a number may go round.  At most min(a, (1/a)**WALKS of all) go further; the query fails if one does.
WALKS = 64
#: Fixed values of the round function: a prime and factors below it.
PRIME, FACTOR, STEP = 2147483647, 48271, 69621


def numbered(df: DataFrame, keys: list[str], name: str = "row_number") -> DataFrame:
    """df with the rows' numbers, from 0, in the order of the keys, nulls first; equal keys in any order.

    The rows are dealt out by range, sorted and written; a row's number is its
    place in its file plus the rows in the files before.  A key that many rows
    share should be followed by others that tell them apart, so that ranges can.
    The result's attribute `reads` names the stored table that it reads.
    """
    order = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    written = stored(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order), "ranges")
    rows = written.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    # one row for each file, of which there are as many as ranges
    files = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("__file", (F.sum("__n").over(files) - F.col("__n")).alias("__before"))
    out = rows.join(F.broadcast(before), "__file").withColumn(name, F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")
    out.reads = (written,)
    return out


def grid(n: int) -> tuple[int, int]:
    a = max(2, math.isqrt(max(n, 1) - 1) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


def permuted(number: str, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """Where the permutation of 0..n-1 sends a number."""
    a, b = grid(n)
    t = f"((x * {FACTOR} + i * {STEP} + {seed}) % {PRIME})"
    f = f"aggregate(array({t}), 0L, (acc, t) -> ((t * t) % {PRIME} * {FACTOR} + t) % {PRIME})"
    half = lambda side: f.replace("(x *", f"(s.{side} *")
    once = (
        f"aggregate(sequence(1L, {rounds}L), named_struct('l', START % {a}L, 'r', START div {a}L), (s, i) -> "
        f"CASE WHEN i % 2 = 1 THEN named_struct('l', (s.l + {half('r')}) % {a}L, 'r', s.r) "
        f"ELSE named_struct('l', s.l, 'r', (s.r + {half('l')}) % {b}L) END, s -> s.r * {a}L + s.l)"
    )
    first = once.replace("START", f"`{number}`")
    walk = f"aggregate(sequence(0, {WALKS}), CAST(NULL AS BIGINT), (w, k) -> CASE WHEN w IS NULL THEN {first} WHEN w < {n}L THEN w ELSE {once.replace('START', 'w')} END)"
    return F.expr(f"aggregate(array({walk}), 0L, (acc, w) -> CASE WHEN w < {n}L THEN w ELSE CAST(raise_error('a row number walked too far') AS BIGINT) END)")


def shuffled_shards(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with row_number, place (in the shuffle), shard and slot.

    Rows are told apart by the keys; rows that agree in all of them may swap
    places.  Null keys come first; an empty table stays empty.  Columns of df
    with the new names are replaced.
    """
    df = df.drop("row_number", "place", "shard", "slot")
    rows = numbered(df, keys)
    n = rows.count()
    out = rows.withColumn("place", permuted("row_number", n, seed))
    return out.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}L")})


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffled_shards(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc32_sql(value: str) -> str:
    """CRC-32 of a blob's hex digits, by table: DuckDB has none."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    byte = f"('0x' || substr({value}, 2 * i + 1, 2))::BIGINT"
    step = f"xor(acc >> 8, ({table}::BIGINT[])[(xor(acc, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform(range(0, length({value}) // 2), lambda i: {byte}), lambda acc, b: {step}, 4294967295::BIGINT), 4294967295)"


OP2_SQL = f"""
WITH RECURSIVE hx AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
base AS (SELECT doc_id, size, {_crc32_sql('x')} AS text_crc32 FROM hx),
num AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rn FROM base),
dim AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, CASE WHEN count(*) > 1 THEN greatest(2, ceil(sqrt(count(*)))::BIGINT) ELSE 1 END AS a FROM base)),
walk(rn, l, r, i) AS (
  SELECT rn, rn % a, rn // a, 0::BIGINT FROM num, dim
  UNION ALL
  SELECT rn, CASE WHEN k % 2 = 1 THEN (l + f) % a ELSE l END, CASE WHEN k % 2 = 1 THEN r ELSE (r + f) % b END, i + 1
  FROM (SELECT rn, l, r, i, k, a, b, ((t * t) % {PRIME} * {FACTOR} + t) % {PRIME} AS f FROM (
    SELECT rn, l, r, i, k, a, b, ((CASE WHEN k % 2 = 1 THEN r ELSE l END) * {FACTOR} + k * {STEP} + {SEED}) % {PRIME} AS t
    FROM (SELECT w.*, i % {ROUNDS} + 1 AS k, a, b FROM walk w, dim WHERE NOT (i > 0 AND i % {ROUNDS} = 0 AND r * a + l < n))))),
done AS (SELECT rn, r * a + l AS place FROM walk, dim WHERE i > 0 AND i % {ROUNDS} = 0 AND r * a + l < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {SHARDS})::INTEGER AS shard, (place // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM num JOIN done USING (rn)
"""
