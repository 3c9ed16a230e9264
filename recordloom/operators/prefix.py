"""Running values along keys' histories by segmented parallel prefix, so that a key of any size is read by many tasks.

Rows are dealt out by ranges of key and order, so a long history is cut into
pieces.  Each piece is summed up on its own as what it does to a running value
(add this much, start anew with that much, leave the last value as this).
These sums, at most one for each key and piece, are composed in order, which
gives the value that comes into each piece; only a piece's first key has one
that comes in, so they are as many as pieces and go to every task.  A second
pass applies them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

PIECE, ROW = "__piece", "__row"
#: Rows of a key up to which its history is left whole: one task sorts that many at once, and pieces cost a second shuffle.
MOST_WHOLE = 1_000_000


@dataclass(frozen=True)
class Step:
    """A running value: what it is within a piece, what a piece hands on, how that is composed, and the two put together.

    mark: a running count whose changes start `local` anew, or None.  `local`
    takes a window up to the row; `handed` is the value at a piece's end from
    local and mark; `composed` takes it over a window of the pieces before;
    `final` takes local, mark and what comes in.
    """

    name: str
    local: Callable[[Window], Column]
    composed: Callable[[Column, Window, Window], Column]
    final: Callable[[Column, Column, Column], Column]
    mark: Callable[[Window], Column] | None = None


def running_sum(name: str, column: Column) -> Step:
    """The sum of a column up to the row."""
    return Step(name, lambda w: F.sum(column).over(w), lambda x, w, _: F.sum(x["local"]).over(w), lambda own, _, before: own + F.coalesce(before, F.lit(0)))


def last_value(name: str, column: Column) -> Step:
    """The last value up to the row that isn't null."""
    return Step(name, lambda w: F.last(column, ignorenulls=True).over(w), lambda x, w, _: F.last(x["local"], ignorenulls=True).over(w), lambda own, _, before: F.coalesce(own, before))


def first_value(name: str, column: Column) -> Step:
    """struct(value) of a key's first row; the value itself may be null."""
    return Step(name, lambda w: F.first(F.struct(column.alias("value"))).over(w), lambda x, w, _: F.first(x["local"]).over(w), lambda own, _, before: F.coalesce(before, own))


def last_before(name: str, column: Column) -> Step:
    """The last value before the row that isn't null."""
    last = lambda w: F.last(column, ignorenulls=True).over(w)
    return Step(name, lambda w: F.struct(last(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), last(w).alias("own")), lambda x, w, _: F.last(x["local"]["own"], ignorenulls=True).over(w), lambda own, _, before: F.coalesce(own["before"], before))


def since(name: str, counted: Column, reset: Column) -> Step:
    """How many rows were counted since the last one that reset (0 or 1 each)."""

    def composed(x: Column, w: Window, resets: Window) -> Column:
        # of the pieces before, those from the last one that has a reset
        return F.sum(x["local"]).over(resets)

    return Step(name, lambda w: F.sum(counted).over(w), composed, lambda own, mark, before: own + F.when(mark == 0, F.coalesce(before, F.lit(0))).otherwise(0), lambda w: F.sum(reset).over(w))


def value_before(name: str, column: Column) -> Step:
    """struct(value) of the row before, null at a key's first row; the value itself may be null."""
    one = F.struct(column.alias("value"))
    return Step(name, lambda w: F.struct(F.lag(one).over(w.rowsBetween(-1, -1)).alias("before"), one.alias("own")), lambda x, w, _: F.last(x["local"]["own"]).over(w), lambda own, _, before: F.coalesce(own["before"], before))


def pieced(df: DataFrame, keys: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """df, dealt out by ranges of keys and order (nulls first), with the piece and the place of each row in it.

    Rows are counted by key first.  Where no key has more than MOST_WHOLE each
    history is one piece as it is, and nothing is written; values are the same
    either way.  A number of pieces that is asked for is always made.
    """
    if pieces is None and (df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= MOST_WHOLE:
        return df.select("*", F.lit(0).alias(PIECE, metadata={"whole": True}), F.struct(*order).alias(ROW))
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    written = stored(df.repartitionByRange(n, *by).sortWithinPartitions(*by), "history")
    return written.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias(PIECE), F.col("_metadata.row_index").alias(ROW))


def scanned(rows: DataFrame, keys: list[str], steps: list[Step]) -> DataFrame:
    """rows of `pieced` with the steps' values."""
    up = Window.partitionBy(*keys, PIECE).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    marks = {f"__m{i}": s.mark(up) for i, s in enumerate(steps) if s.mark}
    out = rows.withColumns(marks) if marks else rows
    inside = lambda i: Window.partitionBy(*keys, PIECE, f"__m{i}").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0) if steps[i].mark else up
    for i, s in enumerate(steps):
        out = out.withColumn(f"__l{i}", s.local(inside(i)))
    made = {s.name: i for i, s in enumerate(steps)}
    names = [c for c in rows.columns if c not in made]
    mark = lambda i: F.col(f"__m{i}") if steps[i].mark else F.lit(0)
    if rows.schema[PIECE].metadata.get("whole"):
        return out.select(*names, *[steps[i].final(F.col(f"__l{i}"), mark(i), F.lit(None)).alias(n) for n, i in made.items()])
    handed = [F.struct(F.col(f"__l{i}").alias("local"), mark(i).alias("mark")).alias(f"__h{i}") for i in range(len(steps))]
    ends = out.groupBy(*keys, PIECE).agg(F.max_by(F.struct(*handed), ROW).alias("__end"))
    order = Window.partitionBy(*keys).orderBy(PIECE)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = ends.withColumn("__n", F.row_number().over(order))
    for i, s in enumerate(steps):
        if s.mark:
            sums = sums.withColumn(f"__r{i}", F.sum((F.col(f"__end.__h{i}.mark") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    for i, s in enumerate(steps):
        # the value at each piece's end, then the one that comes into the next piece
        if s.mark:
            own = Window.partitionBy(*keys, f"__r{i}").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, 0)
            sums = sums.withColumn(f"__e{i}", s.composed(F.col(f"__end.__h{i}"), before, own))
        else:
            sums = sums.withColumn(f"__e{i}", s.composed(F.col(f"__end.__h{i}"), order.rowsBetween(Window.unboundedPreceding, 0), before))
    coming = sums.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col(PIECE).alias("__piece_at"), *[F.lag(f"__e{i}").over(order).alias(f"__c{i}") for i in range(len(steps))], "__n").where("__n > 1").drop("__n")
    match = out[PIECE] == coming["__piece_at"]
    for j, k in enumerate(keys):
        match = match & out[k].eqNullSafe(coming[f"__k{j}"])
    # only the first key of a piece has something coming in
    joined = out.join(F.broadcast(coming), match, "left")
    return joined.select(*names, *[steps[i].final(F.col(f"__l{i}"), mark(i), F.col(f"__c{i}")).alias(n) for n, i in made.items()])
