"""Boolean expressions in text to tree rows, which operators.rules.tree_levels evaluates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and signs of the three connectives; NOT binds closest, then AND, then OR.
WORDS = {"并且": "AND", "且": "AND", "同时": "AND", "and": "AND", "&": "AND", "或者": "OR", "或": "OR", "or": "OR", "|": "OR", "不得": "NOT", "非": "NOT", "not": "NOT", "!": "NOT"}
_TOKEN = re.compile(r"\s*([()（）]|" + "|".join(sorted(map(re.escape, WORDS), key=len, reverse=True)) + r"|[^()（）\s&|!且或非]+)", re.IGNORECASE)
_NODE = T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("operator", T.StringType()), T.StructField("leaf", T.StringType())]))


class Unresolved(Exception):
    pass


def tree_of(text: str) -> list[tuple[int, int | None, str, str | None]]:
    """(node, parent, operator, leaf) rows, the root first; Unresolved for a doubled NOT, a repeated leaf or anything unbalanced."""
    tokens = [t.strip() for t in _TOKEN.findall(text)]
    if "".join(tokens) != re.sub(r"\s+", "", text) or not tokens:
        raise Unresolved(text)
    rows: list[tuple[int, int | None, str, str | None]] = []
    leaves: set[str] = set()
    at = 0

    def kind() -> str | None:
        return WORDS.get(tokens[at].lower(), tokens[at]) if at < len(tokens) else None

    def level(parent: int | None, names: tuple[str, ...]) -> None:
        nonlocal at
        if not names:
            return single(parent)
        here, begin = len(rows), at
        level(parent, names[1:])
        if kind() != names[0]:
            return
        # a connective after all: read its operands again below a node of its own
        for row in rows[here:]:
            leaves.discard(row[3])
        del rows[here:]
        at = begin
        rows.append((here, parent, names[0], None))
        level(here, names[1:])
        while kind() == names[0]:
            at += 1
            level(here, names[1:])

    def single(parent: int | None) -> None:
        nonlocal at
        k = kind()
        at += 1
        if k == "NOT":
            if kind() == "NOT":
                raise Unresolved(text)
            here = len(rows)
            rows.append((here, parent, "NOT", None))
            single(here)
        elif k in ("(", "（"):
            level(parent, ("OR", "AND"))
            if kind() not in (")", "）"):
                raise Unresolved(text)
            at += 1
        elif k is None or k in (")", "）", "AND", "OR") or k in leaves:
            raise Unresolved(text)
        else:
            leaves.add(k)
            rows.append((len(rows), parent, "LEAF", k))

    level(None, ("OR", "AND"))
    if at != len(tokens):
        raise Unresolved(text)
    return rows


def tree_nodes(expression: Column) -> Column:
    """array<struct<node, parent, operator, leaf>>; null where the expression is null or unresolved."""

    @F.pandas_udf(_NODE)
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else [{"node": n, "parent": p, "operator": o, "leaf": f} for n, p, o, f in tree_of(t)]
            except Unresolved:
                return None

        return texts.map(one)

    return run(expression)


def trees(rows: DataFrame, id_col: str, expression: str) -> tuple[DataFrame, DataFrame]:
    """(nodes as tree_levels takes them, with leaf; ids of unresolved expressions)."""
    # each expression is parsed once, however many rows have it
    parsed = rows.select(F.col(expression).alias("__e")).distinct().withColumn("nodes", tree_nodes(F.col("__e")))
    made = rows.select(F.col(id_col).alias("tree"), F.col(expression).alias("__x")).join(parsed, F.col("__x").eqNullSafe(F.col("__e"))).select("tree", "nodes")
    nodes = made.where("nodes IS NOT NULL").select("tree", F.inline("nodes"))
    return nodes, made.where("nodes IS NULL").select("tree")
