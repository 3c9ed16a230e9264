"""Scans: HTML, JSON, labelled text and spreadsheets to rows. Parsing a page is a small helper; Spark reads, splits and joins."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RECORDS = "id long, place int, name string, value string"


class _Fields(HTMLParser):
    """(record number, field, text or link) of nodes marked as records and fields."""

    def __init__(self, record: str, field: str, links: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.record, self.field, self.links = record, field, links
        self.depth = self.count = 0
        self.inside: int | None = None
        self.open: list[tuple[int, str, list[str]]] = []
        self.found: list[tuple[int, str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in VOID:
            self.depth += 1
        if self.record in a and self.inside is None:
            self.inside, self.count = self.depth, self.count + 1
        if self.inside is not None and (name := a.get(self.field)):
            if name in self.links:
                self.found.append((self.count, name, a.get("href") or ""))
            else:
                self.open.append((self.depth, name, []))

    def handle_data(self, data):
        for _, _, parts in self.open:
            parts.append(data)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        while self.open and self.open[-1][0] >= self.depth:
            _, name, parts = self.open.pop()
            self.found.append((self.count, name, " ".join("".join(parts).split())))
        if self.inside == self.depth:
            self.inside = None
        self.depth -= 1


def html_fields(pages: DataFrame, id_col: str, html_col: str, record: str = "data-record", field: str = "data-field", links: tuple[str, ...] = ()) -> DataFrame:
    """id, place (of the record in its page, from 1), name, value: the fields of every record; repeated fields are rows of their own.

    A site is a row of these parameters, not a class.  Pages without records give no rows.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = _Fields(record, field, links)
                parser.feed(html or "")
                parser.close()
                out += [(i, *f) for f in parser.found]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["id", "place", "name", "value"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(run, RECORDS)


def records_of(fields: DataFrame, scalars: list[str], lists: list[str] = []) -> DataFrame:
    """id, place, one column for each scalar (its first value) and list (all values in order); fields as html_fields gives them.

    The order of values is that of their text where rows carry none of their own.
    """
    order = F.col("line") if "line" in fields.columns else F.col("value")
    one = [F.min_by(F.when(F.col("name") == s, F.col("value")), F.when(F.col("name") == s, order)).alias(s) for s in scalars]
    many = [F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == s, F.struct(order.alias("o"), F.col("value").alias("v"))))), lambda x: x["v"]).alias(s) for s in lists]
    return fields.groupBy("id", "place").agg(*one, *many)


def shape_faults(pages: DataFrame, found: DataFrame, id_col: str, required: list[str], least: int = 1) -> DataFrame:
    """id, place, fault: pages that don't have the shape their site's parameters expect.

    found: what records_of gives for them.  RECORDS (place 0) for a page of
    fewer than `least` records, MISSING_<field> for a record without a required one.
    """
    n = found.groupBy("id").agg(F.count("*").alias("n"))
    few = pages.select(F.col(id_col).cast("long").alias("id")).join(n, "id", "left").where(F.coalesce("n", F.lit(0)) < least).select("id", F.lit(0).alias("place"), F.lit("RECORDS").alias("fault"))
    lacks = F.filter(F.array(*[F.when(F.coalesce(F.col(f"`{r}`"), F.lit("")) == "", F.lit(f"MISSING_{r}")) for r in required]), lambda f: f.isNotNull())
    return few.unionByName(found.select("id", "place", F.explode(lacks).alias("fault")))


def shape_checked(pages: DataFrame, found: DataFrame, id_col: str, required: list[str], least: int = 1) -> DataFrame:
    """found as it is; a page of another shape is an error, not an empty result. The check is one pass that ends at the first fault."""
    if fault := shape_faults(pages, found, id_col, required, least).first():
        raise ValueError(f"page {fault.id} has another shape: {fault.fault}")
    return found


def links_of(pages: DataFrame, id_col: str, html_col: str, most_text: int = 14_000, most_links: int = 4) -> DataFrame:
    """id, href, label, context: anchors with the text of the nearest block around them that holds no more than most_links different links."""

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack = [["root", [], set(), []]]
            self.found = []

        def handle_starttag(self, tag, attrs):
            if tag not in VOID:
                self.stack.append([tag, [], set(), []])
                if tag == "a" and (href := dict(attrs).get("href")):
                    self.stack[-1][2].add(href)
                    self.stack[-1].append(href)

        def handle_data(self, data):
            self.stack[-1][1].append(data)

        def handle_endtag(self, tag):
            if tag in VOID or not any(s[0] == tag for s in self.stack[1:]):
                return
            while True:
                name, parts, hrefs, waiting, *href = self.stack.pop()
                text = " ".join("".join(parts).split())
                if href:
                    waiting = [(href[0], text)]
                elif name in ("li", "tr", "p", "article", "section", "div", "td") and len(hrefs) <= most_links and len(text) <= most_text:
                    self.found += [(h, label, text) for h, label in waiting]
                    waiting = []
                up = self.stack[-1]
                up[1].append(" " + "".join(parts) + " ")
                up[2] |= hrefs
                up[3] += waiting
                if name == tag:
                    return

    def run(batches):
        for batch in batches:
            out = []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = Blocks()
                parser.feed(html or "")
                parser.close()
                out += [(i, *f) for f in parser.found]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["id", "href", "label", "context"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(run, "id long, href string, label string, context string")


def json_records(docs: DataFrame, id_col: str, json_col: str, record_schema: str) -> DataFrame:
    """id, place (from 1) and the fields of every entry of `records`; a text without that list is an error, a field of another type null."""
    parsed = F.from_json(json_col, f"records array<struct<{record_schema}>>", {"mode": "PERMISSIVE"})
    rows = docs.select(F.col(id_col).alias("id"), parsed["records"].alias("records"))
    checked = F.when(F.col("records").isNull(), F.raise_error(F.lit("records[] is missing")).cast(rows.schema["records"].dataType)).otherwise(F.col("records"))
    return rows.select("id", F.posexplode(checked).alias("place", "r")).select("id", (F.col("place") + 1).alias("place"), "r.*")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\r?\n")).alias("line", "text"))


def block_fields(docs: DataFrame, id_col: str, text_col: str, marker: str) -> DataFrame:
    """id, place, line, name, value of the `name: value` lines behind each line that matches the marker."""
    order = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(docs, id_col, text_col).withColumn("place", F.sum(F.col("text").rlike(marker).cast("int")).over(order).cast("int"))
    pair = r"^\s*([^:：]+?)\s*[:：]\s*(.*?)\s*$"
    rows = lines.where((F.col("place") > 0) & ~F.col("text").rlike(marker) & F.col("text").rlike(pair))
    return rows.select("id", "place", "line", F.regexp_extract("text", pair, 1).alias("name"), F.regexp_extract("text", pair, 2).alias("value"))


def labelled_blocks(docs: DataFrame, id_col: str, text_col: str, opener: str, most: int = 35) -> DataFrame:
    """id, place, title, text: blocks from a line that matches the opener (its first group is the title) to the next one or `most` lines on."""
    order = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("text").rlike(opener)
    lines = _lines(docs, id_col, text_col).withColumn("start", F.last(F.when(opens, F.col("line")), ignorenulls=True).over(order))
    inside = lines.where((F.col("line") - F.col("start")) < most)
    title = F.min_by(F.regexp_extract("text", opener, 1), "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    place = F.row_number().over(Window.partitionBy("id").orderBy("start"))
    return inside.groupBy("id", "start").agg(title.alias("title"), text.alias("text")).withColumn("place", place).select("id", "place", "title", "text")


#: Fixed values of the format: namespaces of a workbook's parts.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            part = targets[sheet.get(_REL)].lstrip("/")
            tree = ET.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}"))
            merged = [m.get("ref") for m in tree.iter(f"{_MAIN}mergeCell")]
            hidden_columns = {n for c in tree.iter(f"{_MAIN}col") if c.get("hidden") in ("1", "true") for n in range(int(c.get("min")), int(c.get("max")) + 1)}
            for row in tree.iter(f"{_MAIN}row"):
                for cell in row.iter(f"{_MAIN}c"):
                    letters, number = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                    column = 0
                    for c in letters:
                        column = column * 26 + ord(c) - 64
                    raw, formula = cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}f")
                    if cell.get("t") == "s":
                        value = shared[int(raw.text)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    else:
                        value = raw.text if raw is not None else None
                    range_ = next((m for m in merged if m.split(":")[0] == cell.get("r")), None)
                    yield sheet.get("name"), int(number), column, value, None if formula is None else formula.text or "", range_, row.get("hidden") in ("1", "true") or column in hidden_columns


def xlsx_cells(files: DataFrame, id_col: str = "path", data_col: str = "content") -> DataFrame:
    """id, sheet, row, column (both from 1), value, formula, merged (the range that begins here), hidden: all cells of workbooks as binaryFile gives them."""

    def run(batches):
        for batch in batches:
            out = [(i, *c) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if data is not None for c in _cells(data)]
            columns = list(zip(*out)) or [()] * 8
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "sheet", "row", "column", "value", "formula", "merged", "hidden"])

    return files.select(F.col(id_col).cast("string"), F.col(data_col)).mapInArrow(run, "id string, sheet string, row int, column int, value string, formula string, merged string, hidden boolean")


def table_records(cells: DataFrame, headers: list[str], required: list[str], sheet_pattern: str = ".*") -> DataFrame:
    """id, sheet, row, one column for each header, missing (required fields without a value), empty: the rows below each sheet's header row.

    The header row is the one row that holds all headers; a sheet with none or
    several is an error.
    """
    cells = cells.where(F.col("sheet").rlike(sheet_pattern)).withColumn("value", F.trim("value"))
    wanted = F.array(*map(F.lit, headers))
    full = cells.groupBy("id", "sheet", "row").agg(F.collect_set("value").alias("v")).where(F.size(F.array_except(wanted, F.col("v"))) == 0)
    heads = cells.select("id", "sheet").distinct().join(full.groupBy("id", "sheet").agg(F.count("*").alias("n"), F.min("row").alias("head")), ["id", "sheet"], "left")
    heads = heads.withColumn("head", F.when(F.col("n") == 1, F.col("head")).otherwise(F.raise_error(F.concat(F.lit("header rows: "), F.coalesce("n", F.lit(0)))).cast("int"))).select("id", "sheet", "head")
    placed = cells.join(heads, ["id", "sheet"])
    names = placed.where("row = head").where(F.col("value").isin(headers)).select("id", "sheet", "column", F.col("value").alias("name"))
    body = placed.where("row > head").join(names, ["id", "sheet", "column"]).groupBy("id", "sheet", "row").pivot("name", headers).agg(F.first(F.nullif("value", F.lit("")), ignorenulls=True))
    missing = F.filter(F.array(*[F.when(F.col(f"`{r}`").isNull(), F.lit(r)) for r in required]), lambda x: x.isNotNull())
    return body.withColumn("missing", missing).withColumn("empty", F.forall(F.array(*[F.col(f"`{h}`") for h in headers]), lambda v: v.isNull()))


def cell_evidence(cells: DataFrame, records: DataFrame, facts: dict[str, str]) -> DataFrame:
    """id, sheet, row, name, state, cell, dimension: where each field of each record is from, and which fact it may state.

    state: PRESENT, or MISSING for a field without a value, which is evidence of
    nothing.  facts: what dimension a field bears on; other fields have none.
    """
    names = [c for c in records.columns if c not in ("id", "sheet", "row", "missing", "empty")]
    dimension = F.coalesce(*[F.when(F.col("name") == n, F.lit(d)) for n, d in facts.items()], F.lit(None).cast("string"))
    heads = cells.where(F.trim("value").isin(names)).groupBy("id", "sheet", "row").agg(F.map_from_entries(F.collect_set(F.struct(F.trim("value"), "column"))).alias("at")).where(F.size("at") == len(names)).select("id", "sheet", "at")
    fields = records.select("id", "sheet", "row", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in names])).alias("f")).select("id", "sheet", "row", "f.*")
    n = F.col("column")
    last, over = F.char((n - 1) % 26 + 65), n - 703
    letter = (
        F.when(n <= 26, last)
        .when(n <= 702, F.concat(F.char(F.floor((n - 1) / 26) + 64), last))
        .otherwise(F.concat(F.char(F.floor(over / 676) + 65), F.char(F.floor(over % 676 / 26) + 65), last))
    )
    placed = fields.join(heads, ["id", "sheet"]).withColumn("column", F.col("at")[F.col("name")])
    return placed.select("id", "sheet", "row", "name", F.when(F.col("value").isNull(), "MISSING").otherwise("PRESENT").alias("state"), F.concat(letter, "row").alias("cell"), dimension.alias("dimension"))
