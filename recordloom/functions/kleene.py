"""Three-valued logic over columns and groups.

Row by row, AND, OR and NOT of nullable booleans already are Kleene's.  Groups
are not (`bool_and` skips nulls), so there a truth value is a number: FALSE 0,
UNKNOWN 1, TRUE 2; AND is the least, OR the greatest, NOT is 2 - x.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALSE, UNKNOWN, TRUE = 0, 1, 2


def level(truth: Column) -> Column:
    """0, 1 or 2 of a nullable boolean."""
    return F.when(truth, F.lit(TRUE)).when(~truth, F.lit(FALSE)).otherwise(F.lit(UNKNOWN))


def truth(level_: Column) -> Column:
    """The nullable boolean of 0, 1 or 2."""
    return F.when(level_ == TRUE, F.lit(True)).when(level_ == FALSE, F.lit(False))


def negated(level_: Column) -> Column:
    return F.lit(TRUE) - level_


def all_of(level_: Column, empty: int = TRUE) -> Column:
    """AND over a group; `empty` where there is nothing to aggregate (some rules want UNKNOWN there)."""
    return F.coalesce(F.min(level_), F.lit(empty))


def any_of(level_: Column, empty: int = FALSE) -> Column:
    return F.coalesce(F.max(level_), F.lit(empty))


def array_all(levels: Column, empty: int = TRUE) -> Column:
    return F.coalesce(F.array_min(levels), F.lit(empty))


def array_any(levels: Column, empty: int = FALSE) -> Column:
    return F.coalesce(F.array_max(levels), F.lit(empty))
