"""Connected components of an undirected edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import forget, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 32))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (least node reachable) for every node of an edge; a node that is its own label is there too.

    Each round replaces a node's edges by edges to its least neighbour; only
    minima are aggregated, no neighbourhood is gathered.  Rounds grow with the
    logarithm of the longest path.  Nulls and loops are dropped; an empty table
    gives an empty table.  The result is a stored table; those of the rounds are deleted.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = stored(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that the join below may split the edges of a node that very many share
        nearest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done = now
        now = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        forget(done, nearest, large)
        before, state = state, _state(now)
        if before == state:
            break
    labels = stored(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
    forget(now)
    return labels
