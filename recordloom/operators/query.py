"""Read-model queries: filters, keyword search, provenance joins, pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import forget, stored

#: Presentation statuses that can be read, and the others.
READABLE = ("DISPLAY", "DISPLAY_WITH_REVIEW", "EVIDENCE_BLOCKED")
HIDDEN = ("NOT_DISPLAY",)


def keyword_any(keyword: str | None, *fields: str) -> Column:
    """A trimmed, lower-cased keyword as a substring of any one field; a blank one filters nothing. % and _ are plain characters."""
    word = (keyword or "").strip().lower()
    if not word:
        return F.lit(True)
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.contains(F.lower(f), F.lit(word)), F.lit(False))
    return out


def keyword_joined(keyword: str | None, *fields: str) -> Column:
    """As keyword_any over the fields joined by spaces, so that a match may reach from one into the next."""
    word = (keyword or "").strip().lower()
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(word)) if word else F.lit(True)


def organisation_is(value: str | None, id_col: str, name_col: str) -> Column:
    return F.lit(True) if value is None else (F.col(id_col) == value) | (F.col(name_col) == value)


def status_in(wanted: list[str] | None, status_col: str) -> Column:
    """Rows of readable statuses, all by default; an unknown status is an error, a hidden one never comes out."""
    wanted = list(READABLE) if wanted is None else wanted
    if unknown := [s for s in wanted if s not in READABLE + HIDDEN]:
        raise ValueError(f"unknown status: {', '.join(unknown)}")
    return F.col(status_col).isin([s for s in wanted if s in READABLE])


def page_parameter(text: str | None, default: int, low: int, high: int) -> int:
    if text is None:
        return default
    if not re.fullmatch(r"\d{1,15}", text) or not low <= int(text) <= high:
        raise ValueError(f"not a whole number from {low} to {high}: {text}")
    return int(text)


class RankIndex:
    """The rows of a total order, dealt out by range, sorted and written once, so that any page is read from where it lies.

    A page's files follow from their numbers of rows, of which there are as many
    as ranges, and its rows from their places in them: nothing is sorted or
    skipped row by row again, whatever the offset.
    """

    def __init__(self, df: DataFrame, order: list, ranges: int | None = None):
        spark = df.sparkSession
        self.order, self.columns = order, df.columns
        dealt = df.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        self.table = stored(dealt, "ranks")
        rows = self.table.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"))
        counts = sorted((r.file, r["count"]) for r in rows.groupBy("file").count().collect())
        self.starts, self.total = [], 0
        for file, n in counts:
            self.starts.append((file, self.total, n))
            self.total += n

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit, each with `total`."""
        place = F.col("_metadata.row_index")
        file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
        wanted, files = F.lit(False), []
        for number, start, n in self.starts:
            low, high = max(offset, start), min(offset + limit, start + n)
            if low < high:
                wanted = wanted | ((file == number) & place.between(low - start, high - start - 1))
                files.append(number)
        # said once more for files alone, so that the others are not opened
        wanted = wanted & (file.isin(files) if files else F.lit(False))
        names = [F.col(f"`{c}`") for c in self.columns]
        return self.table.where(wanted).select(*names, F.lit(self.total).cast("long").alias("total")).orderBy(*self.order)

    def close(self) -> None:
        forget(self.table)


#: Rows up to which a page is taken from the first rows of the whole, and not from an index of ranks.
FIRST_ROWS = 10_000


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    """Rows offset to offset + limit in a total order, each with `total`, the number of rows before the cut.

    The rows are written once, and counted and cut from there; beyond
    FIRST_ROWS by their ranks, so that no task and no driver holds what lies
    before a page.
    """
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most}, offset 0 or more")
    if offset + limit > FIRST_ROWS:
        return RankIndex(df, order).page(offset, limit)
    df = stored(df, "page")
    total = df.agg(F.count("*").alias("total")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def page_in(df: DataFrame, order: list, parameters: dict[str, str], prefix: str = "", default: int = 20, most: int = 100) -> DataFrame:
    """A page by the parameters `<prefix>offset` and `<prefix>limit` as text, for pages within a page."""
    offset = page_parameter(parameters.get(f"{prefix}offset"), 0, 0, 10**9)
    return page(df, order, offset, page_parameter(parameters.get(f"{prefix}limit"), default, 1, most), most)


def bounded(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` rows of a total order: a scan with a stated bound."""
    return df.orderBy(*order).limit(most)


def scan(table: DataFrame, columns: list[str], equal: dict[str, object], order: list, most: int) -> DataFrame:
    """Some columns of the rows that equal the given values, in order, no more than `most` (A16); filters and columns reach the scan of any source."""
    rows = table
    for name, value in equal.items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return rows.orderBy(*order).limit(most).select(*columns)


def mapped(value: Column, names: dict[str, str], what: str) -> Column:
    """An enum by another's names; an unknown value is an error, null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for a, b in names.items():
        out = out.when(value == a, b)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)).cast("string"))


def required_json(payload: Column, schema: str, required: list[str]) -> Column:
    """A payload parsed to a struct; a missing required field is an error."""
    parsed = F.from_json(payload, schema)
    missing = F.filter(F.array(*[F.when(parsed[f].isNull(), F.lit(f)) for f in required]), lambda f: f.isNotNull())
    return F.when(F.size(missing) == 0, parsed).otherwise(F.raise_error(F.concat(F.lit("missing: "), F.array_join(missing, ", "))))


def available(value: Column, reason: str) -> Column:
    """struct(state, value, reason): AVAILABLE, or NOT_YET_AVAILABLE for the reason."""
    return F.struct(
        F.when(value.isNull(), "NOT_YET_AVAILABLE").otherwise("AVAILABLE").alias("state"), value.alias("value"), F.when(value.isNull(), F.lit(reason)).alias("reason"))


def deadline_tone(deadline: Column, now: Column, zone: str = "Asia/Shanghai") -> Column:
    """closed, urgent (7 days or less), open, or neutral without a deadline; a deadline's day lasts to 23:59:59 local time."""
    end = F.to_utc_timestamp(F.to_timestamp(F.date_add(deadline, 1)), zone)
    days = F.ceil((F.unix_seconds(end) - 1 - F.unix_seconds(now)) / 86400)
    return F.when(deadline.isNull(), "neutral").when(days < 0, "closed").when(days <= 7, "urgent").otherwise("open")


def valid_at(at: Column, observed: Column, begins: Column, ends: Column) -> Column:
    """Observed by then, and then within begins and ends, both included, null for open."""
    return (observed <= at) & (begins.isNull() | (begins <= at)) & (ends.isNull() | (ends >= at))


def validity_join(facts: DataFrame, events: DataFrame, key: str, begins: str, ends: str, at: str, width_s: int) -> DataFrame:
    """events with the facts of their key that hold at their instant, both ends included; a null begin or end is open.

    A plain range join would pair all facts and events of a key.  Facts are
    dealt out by the stretches of width_s seconds that they touch, events by
    their own, so a key's rows spread over its stretches.  Facts are clipped to
    the stretches that events have, so an open one makes no more rows than that.
    """
    stretch = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width_s)
    low, high = events.agg(F.min(stretch(at)), F.max(stretch(at))).first()
    if low is None:
        low, high = 0, -1
    dealt = facts.withColumns({"__low": F.greatest(stretch(begins), F.lit(low)), "__high": F.least(stretch(ends), F.lit(high))}).where("__low <= __high")
    dealt = dealt.withColumn("__stretch", F.explode(F.sequence("__low", "__high"))).drop("__low", "__high")
    found = events.withColumn("__stretch", stretch(at)).join(dealt, [key, "__stretch"])
    return found.where((F.col(begins).isNull() | (F.col(begins) <= F.col(at))) & (F.col(ends).isNull() | (F.col(at) <= F.col(ends)))).drop("__stretch")


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """parents with their children as a list of structs in order; without any, an empty list. For children that are few to a parent."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    out = parents.join(rows, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))


def by_name_or_alias(names: DataFrame, organisations: DataFrame, name_col: str) -> DataFrame:
    """names with organization_id: that of the one organisation of that name or alias, null if none or several have it."""
    known = organisations.select("organization_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("known"))
    one = known.groupBy("known").agg(F.countDistinct("organization_id").alias("n"), F.min("organization_id").alias("organization_id")).where("n = 1")
    return names.join(one.select(F.col("known").alias(name_col), "organization_id"), name_col, "left")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children without a parent; an intact relation gives none."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def sources_with_endpoints(sources: DataFrame, organizations: DataFrame, endpoints: DataFrame, health: DataFrame, source: str, organization: str, endpoint: str) -> DataFrame:
    """sources with their organisation and a list of their endpoints, each with its health or null (E4): one join where a query for each source would be."""
    known = endpoints.join(health, endpoint, "left")
    fields = [c for c in known.columns if c not in (source, endpoint)]
    return nested(sources.join(organizations, organization), known, source, [endpoint], fields, "endpoints")


def coverage(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Blockers: the expected keys that nothing covers, and one NOTHING_EXPECTED row if nothing was expected."""
    missing = expected.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti").withColumn("blocker", F.lit("NOT_COVERED"))
    none = expected.agg(F.count("*").alias("n")).where("n = 0").select(*[F.lit(None).cast(expected.schema[k].dataType).alias(k) for k in keys], F.lit("NOTHING_EXPECTED").alias("blocker"))
    return missing.unionByName(none)


def set_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: what only one of two sets holds; equal sets give none."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("right")))


def vanished(published: DataFrame, active: DataFrame, source: str, key: str) -> DataFrame:
    """Published rows of a source that its last crawl didn't find; a source whose crawl found nothing at all loses none."""
    crawled = active.select(source).distinct()
    return published.join(crawled, source, "left_semi").join(active.select(source, key), [source, key], "left_anti")


def fallback_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """first, and those rows of second whose keys first lacks."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table after rows replaced those of their keys and the new ones were added."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_ignored(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first of each key that the table lacks."""
    from .versioning import first_wins

    return first_wins(rows, keys, order).join(table.select(*keys), keys, "left_anti")


def append_only(table: DataFrame, rows: DataFrame, id_col: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, collisions): the same id with the same content is there already, with other content a collision."""
    held = table.select(id_col, F.col(content).alias("__held"))
    both = rows.join(held, id_col, "left")
    return both.where("__held IS NULL").drop("__held"), both.where(F.col("__held") != F.col(content)).drop("__held")
