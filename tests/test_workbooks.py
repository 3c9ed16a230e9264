"""Workbooks as a data source: a partition for each sheet, and filters that reach it."""

import io
import zipfile

from pyspark.sql import functions as F

from recordloom.plans.records import _MAIN, _OFFICE
from recordloom.sources import records, workbooks

MAIN = _MAIN


def book(sheets, shared=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f'<row r="{r}">{cells}</row>' for r, cells in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def files(tmp_path):
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xlsx").write_bytes(book({"One": [(1, text("A1", "x") + '<c r="AB1"><f>1+1</f><v>2</v></c>'), (7, '<c r="C7" t="s"><v>1</v></c><c r="D7"/>')], "Two": [(2, text("B2", "y"))]}, ("p", "q")))
    (tmp_path / "sub" / "b.xlsx").write_bytes(book({"One": [(r, text(f"A{r}", r)) for r in range(1, 400)], "Empty": []}))
    (tmp_path / "other.txt").write_text("no workbook")
    return f"file://{tmp_path}"


def test_cells_of_all_sheets(spark, tmp_path):
    path = files(tmp_path)
    cells = workbooks.read_workbooks(spark, path)
    assert cells.rdd.getNumPartitions() == 4
    got = sorted((r.id.rsplit("/", 1)[1], r.sheet, r.row, r.column, r.value, r.formula) for r in cells.where("id LIKE '%a.xlsx'").collect())
    assert got == [("a.xlsx", "One", 1, 1, "x", None), ("a.xlsx", "One", 1, 28, "2", "1+1"), ("a.xlsx", "One", 7, 3, "q", None), ("a.xlsx", "One", 7, 4, None, None), ("a.xlsx", "Two", 2, 2, "y", None)]
    plain = records.xlsx_cells(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path))
    key = lambda df: sorted((r.id.rsplit("/", 1)[1], r.sheet, r.row, r.column, r.value or "", r.formula or "") for r in df.collect())
    assert key(cells) == key(plain)


def test_filters_reach_the_source(spark, tmp_path):
    path = files(tmp_path)
    cells = workbooks.read_workbooks(spark, path)
    some = cells.where("sheet = 'One' AND row > 390 AND row <= 395 AND value <> '392'")
    assert some.rdd.getNumPartitions() == 2
    assert sorted(r.row for r in some.collect()) == [391, 393, 394, 395]
    plan = some._jdf.queryExecution().executedPlan().toString()
    # what the source has taken is no filter of Spark's any more
    left = next(line for line in plan.split("\n") if "Filter" in line)
    assert "value" in left and "One" not in left and "390" not in left and "395" not in left, plan
    assert cells.where(F.col("sheet").isin("Two", "Empty")).rdd.getNumPartitions() == 2
    assert cells.where("sheet = 'none'").count() == 0
    reader = workbooks.WorkbookReader(path)
    left = list(reader.pushFilters([workbooks.EqualTo(("sheet",), "One"), workbooks.GreaterThan(("row",), 5), workbooks.LessThan(("row",), 9), workbooks.EqualTo(("value",), "q")]))
    assert len(left) == 1 and (reader.low, reader.high) == (6, 8)
    assert [c for p in reader.partitions() if "a.xlsx" in p.path for c in reader.read(p)][0][2:5] == (7, 3, "q")


def test_letters_of_columns(spark):
    cells = spark.createDataFrame([("b", "s", 1, c, f"h{c}") for c in (1, 26, 27, 702, 703, 704, 1378, 1379, 16384)] + [("b", "s", 2, c, "v") for c in (1, 26, 27, 702, 703, 704, 1378, 1379, 16384)], "id string, sheet string, row int, column int, value string")
    names = [f"h{c}" for c in (1, 26, 27, 702, 703, 704, 1378, 1379, 16384)]
    found = records.table_records(cells, names, [])
    proof = {r.name: r.cell for r in records.cell_evidence(cells, found, {"h1": "d"}).collect()}
    assert proof == dict(zip(names, ["A2", "Z2", "AA2", "ZZ2", "AAA2", "AAB2", "AZZ2", "BAA2", "XFD2"]))
