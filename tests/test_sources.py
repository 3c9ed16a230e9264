import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from recordloom.operators import ledger
from recordloom.sources import records, sinks
from recordloom.streaming import health


def test_html_records(spark):
    html = '<ul><li data-record><b data-field="title">A <i>b</i></b><span data-field="place">x</span><span data-field="place">y</span><a data-field="url" href="/1">go</a></li><li data-record><b data-field="title">C</b><br></li></ul>'
    fields = records.html_fields(spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "id long, html string"), "id", "html", links=("url",))
    assert sorted(tuple(r) for r in fields.collect()) == [(1, 1, "place", "x"), (1, 1, "place", "y"), (1, 1, "title", "A b"), (1, 1, "url", "/1"), (1, 2, "title", "C")]
    found = records.records_of(fields.withColumn("name", F.when(F.col("name") == "place", "spot").otherwise(F.col("name"))), ["title", "url"], ["spot"]).orderBy("place").collect()
    assert [tuple(r) for r in found] == [(1, 1, "A b", "/1", ["x", "y"]), (1, 2, "C", None, [])]


def test_json_records(spark):
    docs = spark.createDataFrame([(1, '{"records":[{"a":"x","n":1},{"a":2,"n":"bad"}]}'), (2, '{"records":[]}')], "id long, j string")
    assert sorted((r.id, r.place, r.a, r.n) for r in records.json_records(docs, "id", "j", "a string, n int").collect()) == [(1, 1, "x", 1), (1, 2, "2", None)]
    with pytest.raises(Exception, match="records"):
        records.json_records(spark.createDataFrame([(1, '{"x":1}')], "id long, j string"), "id", "j", "a string").collect()


def test_block_text(spark):
    text = "head\n[RECORD]\nid: 1\ntitle：T\nlocation: a\nlocation: b\n[RECORD]\nid: 2\nnoise\n"
    fields = records.block_fields(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", r"^\[RECORD\]$")
    found = sorted(tuple(r) for r in fields.select("place", "name", "value").collect())
    assert found == [(1, "id", "1"), (1, "location", "a"), (1, "location", "b"), (1, "title", "T"), (2, "id", "2")]


def test_labelled_blocks(spark):
    text = "x\njob: A\n1\n2\n3\njob: B\n4"
    found = records.labelled_blocks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", r"^job: (.*)$", 3).orderBy("place").collect()
    assert [(r.place, r.title, r.text) for r in found] == [(1, "A", "job: A\n1\n2"), (2, "B", "job: B\n4")]


def workbook(rows, second=None):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: list[str] = []

    def cell(r, c, v):
        ref = f"{chr(64 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, int):
            return f'<c r="{ref}"><v>{v}</v></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    body = "".join(f'<row r="{r}"{" hidden=\"1\"" if r == 5 else ""}>' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Jobs" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Notice"], ["unit", "job", "n"], ["U", "J", 3], ["V", None, 1], [None, " ", None]]))
    cells = records.xlsx_cells(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [(r.value, r.merged) for r in cells.where("row = 1").collect()] == [("Notice", "A1:C1")]
    assert cells.where("hidden").count() == 1
    found = records.table_records(cells, ["unit", "job", "n"], ["unit", "job"], "^Jobs$").orderBy("row").collect()
    assert [(r.row, r.unit, r.job, r.n, r.missing, r.empty) for r in found] == [(3, "U", "J", "3", [], False), (4, "V", None, "1", ["job"], False), (5, None, None, None, ["unit", "job"], True)]
    with pytest.raises(Exception, match="header rows: 0"):
        records.table_records(cells, ["unit", "other"], ["unit"]).collect()


def test_links(spark):
    html = '<div><ul><li>Job one <a href="/1">more</a></li><li><a href="/2">two</a> x</li></ul><a href="/3">out</a></div>'
    found = records.links_of(spark.createDataFrame([(1, html)], "id long, h string"), "id", "h").collect()
    assert sorted((r.href, r.label, r.context) for r in found) == [("/1", "more", "Job one more"), ("/2", "two", "two x"), ("/3", "out", "Job one more two x out")]


def test_snapshots_and_indexes(spark, tmp_path):
    df = spark.createDataFrame([("a", "DISPLAY", ["ok", "secret"]), ("b", "NOT_DISPLAY", ["ok"])], "k string, s string, r array<string>")
    snap = sinks.public_snapshot(df, "s", "r", ["ok"], ["k"])
    assert [r.payload for r in snap.collect()] == ['{"k":"a","r":["ok"],"s":"DISPLAY"}']
    assert sinks.oversized(snap, 5).count() == 1 and sinks.oversized(snap, 5000).count() == 0
    one = sinks.index_rebuild(df, ["k"], str(tmp_path / "x"))
    assert one == sinks.index_rebuild(df.orderBy(F.desc("k")).repartition(3), ["k"], str(tmp_path / "y")) and one != sinks.index_rebuild(df.limit(1), ["k"], str(tmp_path / "z"))
    sinks.write_csv(spark.createDataFrame([('=1"', None)], "a string, b string").coalesce(1), ["a", "b"], str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8")
    assert text.splitlines()[0] == '"﻿a","b"' and text.splitlines()[1].startswith('"\'=1""",')


def test_streams_equal_batches(spark, tmp_path):
    data = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(data):
        pytest.skip("no test data")
    events = spark.read.parquet(data).where("user_id < 6")
    for i in range(3):
        events.where(f"event_id >= {i * 400} AND event_id < {(i + 1) * 400}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = health.stream_health(stream, "user_id", "ts", "event_id", F.col("event_type") != "error", "props", F.col("value") > 200)
    job = out.writeStream.format("memory").queryName("health").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    job.awaitTermination()
    columns = ["consecutive_success", "consecutive_failure", "last_hash", "status"]
    batch = ledger.source_health(events, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", "props", F.col("value") > 200)
    assert sorted(tuple(r) for r in spark.table("health").select("run", *columns).collect()) == sorted(tuple(r) for r in batch.select("event_id", *columns).collect())


def test_another_shape_is_an_error(spark):
    pages = spark.createDataFrame([(1, '<p data-record><b data-field="title">x</b></p>'), (2, "<p>gone</p>")], "id long, html string")
    found = records.records_of(records.html_fields(pages, "id", "html"), ["title"])
    with pytest.raises(ValueError, match="page 2 has another shape: RECORDS"):
        records.shape_checked(pages, found, "id", ["title"])
    assert records.shape_checked(pages.where("id = 1"), found, "id", ["title"]).count() == 1
