"""Latest rows, first-wins duplicates, and revision numbers. Every window has a total order: name a column that breaks ties last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canonical_json, sha256
from .prefix import pieced, running_sum, scanned, value_before


def _w(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in the order columns; aggregated before the shuffle, so a hot key costs a row for each task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, aggregated before the shuffle; order must tell all rows of a key apart."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def shortest(df: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """The row of the shortest text of each key, the first of equally short ones."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.length(text), *order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def versions_any(df: DataFrame, keys: list[str], content: str, order: list[str]) -> DataFrame:
    """df with revision: content seen before for the key takes its old revision again (A, B, A: 1, 2, 1).

    Revisions count distinct contents by first arrival; null is a content.
    """
    first = df.groupBy(*keys, content).agg(F.min(F.struct(*order)).alias("__first"))
    numbered = first.withColumn("revision", F.row_number().over(_w(keys, ["__first"])))
    on = [*keys, content]
    numbered = numbered.select(*[F.col(k).alias(f"__{k}") for k in on], "revision")
    joined = df.join(numbered, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on])
    return joined.select(*df.columns, "revision")


def versions_latest(df: DataFrame, keys: list[str], content: str, order: list[str], pieces: int | None = None) -> DataFrame:
    """df with revision: only the row before counts (A, B, A: 1, 2, 3).  A key of very many rows is read by many tasks (see operators.prefix)."""
    rows = scanned(pieced(df, keys, order, pieces), keys, [value_before("__before", F.col(content))])
    changed = F.col("__before").isNull() | ~F.col(content).eqNullSafe(F.col("__before.value"))
    out = scanned(rows.withColumn("__new", changed.cast("int")), keys, [running_sum("revision", F.col("__new"))])
    return out.select(*[c for c in df.columns if c != "revision"], F.col("revision").cast("int").alias("revision"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with the rows' numbers within their key, from 1."""
    return df.withColumn(name, F.row_number().over(_w(keys, order)))


def first_seen(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, first_seen: the least instant of each (F8)."""
    return df.groupBy(*keys).agg(F.min(at).alias("first_seen"))


def snapshots(versions: DataFrame, keys: list[str], revision: str, id_col: str, fields: dict[str, str], order: list[str]) -> DataFrame:
    """keys, revision, current (id), snapshot (hash of the fields and the revision) of each key's current version.

    The current version is the one of the greatest revision; of its rows, the first in order stands for it.
    """
    first = F.min_by(F.struct(id_col, *fields.values()), F.struct(*order)).alias("__row")
    one = versions.groupBy(*keys, revision).agg(first)
    last = one.groupBy(*keys).agg(F.max(revision).alias(revision), F.max_by("__row", revision).alias("__row"))
    content = canonical_json({revision: F.col(revision), **{n: F.col(f"__row.`{c}`") for n, c in fields.items()}})
    return last.select(*keys, revision, F.col(f"__row.`{id_col}`").alias("current"), sha256(content).alias("snapshot"))


def graph_versions(edges: DataFrame, keys: list[str], at: str, edge: str) -> DataFrame:
    """keys, at, graph, revision (H7): a graph is the set of its edges at an instant, its version counts up where that set differs from the one before."""
    graphs = edges.groupBy(*keys, at).agg(sha256(F.to_json(F.array_sort(F.collect_set(edge)))).alias("graph"))
    return versions_latest(graphs, keys, "graph", [at])


def superseding(df: DataFrame, keys: list[str], id_col: str, order: list[str]) -> DataFrame:
    """df with supersedes: the id of the revision before."""
    return df.withColumn("supersedes", F.lag(id_col).over(_w(keys, order)))


def chain_breaks(df: DataFrame, keys: list[str], revision: str, content: str, supersedes: str, id_col: str) -> DataFrame:
    """Rows that break a revision chain, with reason: GAP, SUPERSEDES, NO_OP or DUPLICATE; an intact chain gives none.

    Rows stand in order of revision, id and content (nulls first).
    """
    w = _w(keys, [revision, id_col, content])
    before = F.lag(revision).over(w)
    reason = (
        F.when(before.isNull() & (F.col(revision) != 1), "GAP")
        .when(before == F.col(revision), "DUPLICATE")
        .when(before.isNotNull() & (F.col(revision) != before + 1), "GAP")
        .when(~F.col(supersedes).eqNullSafe(F.lag(id_col).over(w)), "SUPERSEDES")
        .when(before.isNotNull() & F.col(content).eqNullSafe(F.lag(content).over(w)), "NO_OP")
    )
    return df.withColumn("reason", reason).where("reason IS NOT NULL")


def conflicting_history(stored: DataFrame, incoming: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Keys that both sides hold with different content: a history must never change."""
    other = incoming.select(*keys, F.col(content).alias("incoming_content"))
    return stored.join(other, keys).where(~F.col(content).eqNullSafe(F.col("incoming_content"))).select(*keys, content, "incoming_content")


def one_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose rows disagree in a value that has to be one, with the number of values."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")
