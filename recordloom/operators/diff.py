"""Change detection between captures, and judgements on runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical_json, sha256
from .prefix import last_before, pieced, scanned, since


def record_diff(previous: DataFrame, current: DataFrame, pair: list[str], identity: str, content: str, failed: DataFrame | None = None) -> DataFrame:
    """pair columns, identity, change: NEW, UPDATED, UNCHANGED, MISSING_OBSERVED or IDENTITY_UNCERTAIN.

    A pair is one comparison (an endpoint at a time).  Rows without an identity,
    or with one that their side holds more than once, are IDENTITY_UNCERTAIN;
    one such row on either side leaves the pair without MISSING_OBSERVED.
    Pairs in `failed` (pair columns) give no rows.
    """

    def side(df: DataFrame, missing_is_doubt: bool):
        n = df.groupBy(*pair, identity).agg(F.count("*").alias("n"), F.min(content).alias("content"))
        doubt = F.col("n") > 1
        doubt = (doubt | F.col(identity).isNull()) if missing_is_doubt else (doubt & F.col(identity).isNotNull())
        return n.withColumn("doubt", doubt)

    if failed is not None:
        previous, current = previous.join(failed, pair, "left_anti"), current.join(failed, pair, "left_anti")
    old, new = side(previous, False), side(current, True)
    unsure = old.where("doubt").select(*pair).unionByName(new.where("doubt").select(*pair)).distinct().withColumn("unsure", F.lit(True))
    keys = [*pair, identity]
    joined = old.where(F.col(identity).isNotNull()).select(*keys, F.col("content").alias("old"), F.col("doubt").alias("old_doubt")).join(
        new.where(F.col(identity).isNotNull()).select(*keys, F.col("content").alias("new"), F.col("doubt").alias("new_doubt"), F.col("n").alias("copies")), keys, "full_outer")
    joined = joined.join(unsure, pair, "left")
    change = (
        F.when(F.col("new_doubt").isNotNull() & (F.col("new_doubt") | F.coalesce("old_doubt", F.lit(False))), "IDENTITY_UNCERTAIN")
        .when(F.col("new_doubt").isNull() & F.col("unsure").isNull(), "MISSING_OBSERVED")
        .when(F.col("new_doubt").isNull(), None)
        .when(F.col("old_doubt").isNull(), "NEW")
        .when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED")
        .otherwise("UPDATED")
    )
    known = joined.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", F.coalesce("copies", F.lit(1)).alias("rows"))
    nameless = new.where(F.col(identity).isNull()).select(*keys, F.lit("IDENTITY_UNCERTAIN").alias("change"), F.col("n").alias("rows"))
    return known.unionByName(nameless)


def page_diff(pages: DataFrame, keys: list[str], order: list[str], hash_col: str, failed: Column, pieces: int | None = None) -> DataFrame:
    """pages with change: CURRENT_UNAVAILABLE, NO_PREVIOUS, UNCHANGED or CHANGED against the last page that was there; a key of very many pages is read by many tasks."""
    rows = pages.withColumns({"__failed": failed, "__there": F.when(~failed, F.col(hash_col))})
    out = scanned(pieced(rows, keys, order, pieces), keys, [last_before("__before", F.col("__there"))])
    change = F.when(F.col("__failed"), "CURRENT_UNAVAILABLE").when(F.col("__before").isNull(), "NO_PREVIOUS").when(F.col("__before") == F.col(hash_col), "UNCHANGED").otherwise("CHANGED")
    return out.select(*[c for c in pages.columns if c != "change"], change.alias("change"))


def empty_reasons(v: str) -> Column:
    """What keeps a run without rows from counting as proven empty; `v` is a struct column, null if nothing was validated.

    A null flag proves nothing: a required one counts as false, a detection as true, a comparison as unavailable.
    """
    c = lambda f: F.col(f"{v}.{f}")
    lacks = lambda f: ~F.coalesce(c(f), F.lit(False))
    found = lambda f: F.coalesce(c(f), F.lit(True))
    history = F.coalesce(c("historical_comparison"), F.lit("UNAVAILABLE"))
    tests = [
        (lacks("response_structure_valid"), "EMPTY_RESPONSE_STRUCTURE_INVALID"),
        (lacks("pagination_complete"), "EMPTY_PAGINATION_INCOMPLETE"),
        (lacks("explicit_empty_signal") & ~c("official_result_count").eqNullSafe(0), "EMPTY_SIGNAL_MISSING"),
        (found("authentication_wall_detected"), "EMPTY_AUTHENTICATION_WALL_DETECTED"),
        (found("captcha_detected"), "EMPTY_CAPTCHA_DETECTED"),
        (found("error_page_detected"), "EMPTY_ERROR_PAGE_DETECTED"),
        (found("structure_drift_detected"), "EMPTY_STRUCTURE_DRIFT_DETECTED"),
        (history == "ANOMALOUS", "EMPTY_HISTORY_ANOMALOUS"),
        (history == "UNAVAILABLE", "EMPTY_HISTORY_UNAVAILABLE"),
    ]
    named = F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in tests]), lambda r: r.isNotNull())
    return F.when(F.col(v).isNull(), F.array(F.lit("ZERO_RESULT_REQUIRES_VALIDATION"))).otherwise(named)


def run_status(snapshots: Column, failed: Column, completeness: Column, not_modified: Column, observed: Column, empty_proof: Column) -> Column:
    """SUCCESS, PARTIAL, FAILED, NOT_MODIFIED, CONFIRMED_EMPTY or SUSPICIOUS_EMPTY; the first rule that holds decides.

    empty_proof: the array of empty_reasons.
    """
    return (
        F.when(snapshots == 0, "FAILED")
        .when(failed > 0, "FAILED")
        .when(completeness == "FAILED", "FAILED")
        .when(completeness == "PARTIAL", "PARTIAL")
        .when(not_modified, "NOT_MODIFIED")
        .when((observed > 0) & (completeness != "COMPLETE"), "PARTIAL")
        .when(observed > 0, "SUCCESS")
        .when(F.size(empty_proof) == 0, "CONFIRMED_EMPTY")
        .otherwise("SUSPICIOUS_EMPTY")
    )


def missing_streaks(grid: DataFrame, keys: list[str], order: list[str], counts: Column, observed: Column, pieces: int | None = None) -> DataFrame:
    """grid (a row for each key and run) with streak and missing_event.

    Only runs that count move a streak: seen resets it to 0, not seen adds one
    and is an event.  Other runs leave it as it was.  A key of very many runs is read by
    many tasks (see operators.prefix).
    """
    rows = grid.withColumns({"__seen": (counts & observed).cast("int"), "__missed": (counts & ~observed).cast("int")})
    out = scanned(pieced(rows, keys, order, pieces), keys, [since("streak", F.col("__missed"), F.col("__seen"))])
    return out.select(*[c for c in grid.columns if c not in ("streak", "missing_event")], F.col("streak").cast("int").alias("streak"), (F.col("__missed") == 1).alias("missing_event"))


def missing_event(run: Column, occurrence: Column, status: Column) -> Column:
    """struct(event_id, kind, reason) of an occurrence that a run did not see (G6): the id follows from what it is about."""
    basis = canonical_json({"event_kind": F.lit("MISSING_OBSERVED"), "source_occurrence_id": occurrence, "source_run_id": run})
    return F.struct(F.concat(F.lit("lifecycle-event:"), sha256(basis)).alias("event_id"), F.lit("MISSING_OBSERVED").alias("kind"), F.concat(F.lit("SOURCE_RUN_"), status).alias("reason"))


def explicit_empty(json: Column, items: str = "jobs") -> Column:
    """Whether a JSON text says outright that there is nothing (G9): exactly the keys items, next and total, an empty list, total 0 and next null.

    Texts that are no JSON object are not empty lists: false, as null is.
    """
    parsed = F.try_parse_json(json)
    keys = F.array_sort(F.json_object_keys(json))
    listed, total, following = (F.get_json_object(json, f"$.{k}") for k in (items, "total", "next"))
    same = (keys == F.array_sort(F.array(F.lit(items), F.lit("next"), F.lit("total")))) & (F.regexp_replace(listed, r"\s", "") == "[]") & (total.try_cast("double") == 0) & following.isNull()
    return parsed.isNotNull() & F.coalesce(same, F.lit(False))


def acquisition(current: DataFrame, previous: DataFrame, run: str, position: str, locator: str, hash_col: str) -> DataFrame:
    """run, status: NOT_MODIFIED where every page has the locator and hash of the page at its place before, and none is missing."""
    a = current.select(run, position, F.struct(locator, hash_col).alias("now"))
    b = previous.select(run, position, F.struct(locator, hash_col).alias("before"))
    same = a.join(b, [run, position], "full_outer").groupBy(run).agg(F.min(F.coalesce((F.col("now") == F.col("before")).cast("int"), F.lit(0))).alias("same"), F.count("now").alias("pages"))
    return same.select(run, F.when((F.col("same") == 1) & (F.col("pages") > 0), "NOT_MODIFIED").otherwise("MODIFIED").alias("status"))
