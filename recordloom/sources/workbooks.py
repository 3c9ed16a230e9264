"""Workbooks (XLSX) as a data source of Spark's own: a partition for each sheet, and filters that keep sheets, rows and files from being read (A4)."""

from __future__ import annotations

import fnmatch
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id string, sheet string, row int, column int, value string, formula string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Fixed values of the format: namespaces of a workbook's parts.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Sheet(InputPartition):
    def __init__(self, path: str, name: str, part: str, low: int, high: int | None):
        super().__init__(name)
        self.path, self.name, self.part, self.low, self.high = path, name, part, low, high


def _opened(path: str):
    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    else:
        store, inner = fs.LocalFileSystem(), path
    return store, inner


def _files(path: str) -> list[str]:
    """A file, or the .xlsx files of a folder, by name."""
    store, inner = _opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        return sorted(prefix + f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if fnmatch.fnmatch(f.base_name, "*.xlsx"))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        part = targets[sheet.get(_REL)].lstrip("/")
        yield sheet.get("name"), part if part.startswith("xl/") else f"xl/{part}"


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.names: dict[str, set | None] = {"id": None, "sheet": None}
        self.low, self.high = 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists on id and sheet, and bounds on row; all others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.names and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names[column] = values if self.names[column] is None else self.names[column] & values
            elif column == "row" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return self.names[column] is None or value in self.names[column]

    def partitions(self) -> list[InputPartition]:
        """One for each sheet; only the workbooks' tables of contents are read here."""
        out: list[InputPartition] = []
        for path in _files(self.path):
            if self._wanted("id", path):
                store, inner = _opened(path)
                with store.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                    out += [Sheet(path, name, part, self.low, self.high) for name, part in _sheets(z) if self._wanted("sheet", name)]
        return out

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        """A sheet's cells, row by row as they are parsed; a row is forgotten when it has been read.  Without partitions Spark asks for None."""
        if partition is None:
            return
        store, inner = _opened(partition.path)
        with store.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
            with z.open(partition.part) as body:
                parents: list[ET.Element] = []
                for event, element in ET.iterparse(body, ("start", "end")):
                    if event == "start":
                        parents.append(element)
                        continue
                    parents.pop()
                    if element.tag != f"{_MAIN}row":
                        continue
                    number = int(element.get("r"))
                    if partition.high is not None and number > partition.high:
                        return
                    if number >= partition.low:
                        for cell in element.iter(f"{_MAIN}c"):
                            yield (partition.path, partition.name, number, *_cell(cell, shared))
                    if parents:
                        parents[-1].remove(element)


def _cell(cell: ET.Element, shared: list[str]) -> tuple[int, str | None, str | None]:
    column = 0
    for c in re.match("[A-Z]+", cell.get("r"))[0]:
        column = column * 26 + ord(c) - 64
    raw, formula = cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}f")
    if cell.get("t") == "s":
        value = shared[int(raw.text)]
    elif cell.get("t") == "inlineStr":
        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    else:
        value = raw.text if raw is not None else None
    return column, value, None if formula is None else formula.text or ""


class WorkbookSource(DataSource):
    """`workbook`: id (the file), sheet, row, column (both from 1), value, formula of every cell."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options["path"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a workbook, or of all in a folder, of any store that pyarrow opens; `records.xlsx_cells` reads those of other stores from binaryFile."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)
