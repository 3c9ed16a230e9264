"""Records of HTML, text blocks and workbooks; captures, sinks and versions that they go through."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import canon
from ..functions import text as tx
from ..operators import capture, gates, query as q, versioning
from ..sources import records, workbooks
from ..sources.stored import dealt, shared_dir, stored
from .tables import query, table


@query("""
SELECT o_orderkey AS id, 1 AS place, 'c' || o_custkey || '|' || o_orderstatus || '|' || '/o/' || o_orderkey || '|' || o_orderpriority || '+' || CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'zz & more' END AS record FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT o_orderkey, 2, 'only a title|||' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 10 <> 0
""")
def q_html_records(spark, d):
    """Marked records of pages, repeated fields as lists."""
    o = table(spark, d, "orders")
    second = F.when(F.col("o_orderkey") % 4 == 0, F.lit('<li data-record><b data-field="title">only  a<br>\ntitle</b></li>')).otherwise("")
    html = F.concat(
        F.lit('<ul><li data-record><h2 data-field="title">c<i>'), "o_custkey", F.lit('</i></h2><img src="x"><span data-field="state">'), "o_orderstatus", F.lit('</span><a data-field="link" href="/o/'), "o_orderkey", F.lit('">go</a><p data-field="spot">'), "o_orderpriority",
        F.lit('</p><p data-field="spot">'), F.when(F.col("o_orderkey") % 3 == 0, "second").otherwise("zz &amp; more"), F.lit("</p></li>"), second, F.lit("</ul>"))
    pages = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, html).otherwise("<p>no records</p>").alias("html"))
    found = records.records_of(records.html_fields(pages, "o_orderkey", "html", links=("link",)), ["title", "state", "link"], ["spot"])
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("title", "state", "link")], F.array_join("spot", "+"))
    return found.select("id", "place", text.alias("record"))


@query("""
SELECT o_orderkey AS id, 0 AS place, 'RECORDS' AS fault FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 1, 'MISSING_state' FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 10 <> 0
""")
def q_page_shapes(spark, d):
    """Pages that don't have the shape that their site is known for."""
    html = F.concat(F.lit('<div data-record><b data-field="title">t'), "o_custkey", F.lit("</b>"), F.when(F.col("o_orderkey") % 6 != 0, F.lit('<i data-field="state">open</i>')).otherwise('<i data-field="state"> </i>'), F.lit("</div>"))
    pages = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, html).alias("html"))
    # written once: both kinds of fault read it, and pages are parsed for the one table
    found = stored(records.records_of(records.html_fields(dealt(pages, "o_orderkey"), "o_orderkey", "html"), ["title", "state"]), "records")
    return records.shape_faults(pages, found, "o_orderkey", ["title", "state"])


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100
""")
def q_table_scan(spark, d):
    """A scan by equality, in order, with a bound."""
    return q.scan(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, [F.col("o_orderdate").desc(), "o_orderkey"], 100)


@query("""
WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS n FROM pages)
SELECT page_id, CASE WHEN n > 0 THEN 1 ELSE 0 END AS has_links, page_id % 7 AS wide, CASE WHEN page_id % 7 <= 4 THEN 'near ' || page_id || ' l0' || CASE WHEN page_id % 7 > 1 THEN ' l1' ELSE '' END || CASE WHEN page_id % 7 > 2 THEN ' l2' ELSE '' END || CASE WHEN page_id % 7 > 3 THEN ' l3' ELSE '' END ELSE 'l0' END AS context FROM c WHERE page_id % 7 > 0
""")
def q_link_containers(spark, d):
    """Links with the nearest block around them that holds few others."""
    pages = table(spark, d, "pages")
    wide = F.col("page_id") % 7
    items = F.array_join(F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.concat(F.lit('<p><a href="/own/'), i, F.lit('">l'), i, F.lit("</a></p>"))), " ")
    inner = F.regexp_replace(items, "</?p>", "")
    html = F.concat(F.lit("<div>near "), F.col("page_id"), F.lit(" "), F.when(wide <= 4, inner).otherwise(items), F.lit("</div>"), F.col("html"))
    found = records.links_of(pages.where(wide > 0).select("page_id", html.alias("html")), "page_id", "html")
    g = found.groupBy(F.col("id").alias("page_id")).agg(F.max((~F.startswith("href", F.lit("/own/"))).cast("int")).alias("has_links"), F.max(F.when(F.col("href") == "/own/0", F.col("context"))).alias("context"))
    return g.select("page_id", "has_links", (F.col("page_id") % 7).alias("wide"), "context")


@query("""
WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag AS f, l_partkey AS p FROM lineitem), s AS (SELECT id, n, f, p, row_number() OVER (PARTITION BY id ORDER BY n, p, f) AS place FROM l)
SELECT id, place::INTEGER AS place, 'part' AS name, p::VARCHAR AS value FROM s UNION ALL SELECT id, place::INTEGER, 'flag', f FROM s
""")
def q_block_records(spark, d):
    """Blocks of `name: value` lines behind a marker (A3)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("l"))
    blocks = dealt(lines, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("l"))
    block = lambda x: F.concat(F.lit("[RECORD]\nnote without a value\npart : "), x["l_partkey"], F.lit("\n flag： "), x["l_returnflag"])
    docs = blocks.select("l_orderkey", F.concat(F.lit("a: head line\n"), F.array_join(F.transform("l", block), "\n")).alias("t"))
    return records.block_fields(docs, "l_orderkey", "t", r"^\[RECORD\]$").select("id", "place", "name", "value")


_MAIN, _OFFICE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbooks(batches):
    """A small workbook of each row (id, cells: rows of texts), as bytes."""
    for batch in batches:
        made = []
        for rows in batch.column(1).to_pylist():
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row, 1) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Jobs" sheetId="1" r:id="r1"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
                z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
            made.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])


@query("""
SELECT 'w' || c_nationkey AS id, (3 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INTEGER AS "row", c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment, CASE WHEN c_acctbal >= 0 THEN '' ELSE 'segment' END AS missing,
  CASE WHEN c_acctbal >= 0 THEN 'PRESENT' ELSE 'MISSING' END || ':C' || (3 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)) AS evidence FROM customer
""")
def q_workbook_records(spark, d):
    """Workbooks to records below the one header row, with the cell that each value is from."""
    people = table(spark, d, "customer")
    row = F.struct("c_custkey", F.array(F.lit("x"), "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))).alias("cells"))
    books = people.groupBy(F.concat(F.lit("w"), "c_nationkey").alias("path")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))
    head = F.array(F.array(F.lit("Title")), F.array(F.lit(" name"), F.lit("other")), F.array(F.lit("no"), F.lit("name"), F.lit("segment")))
    cells = records.xlsx_cells(books.select("path", F.concat(head, "rows").alias("cells")).mapInArrow(_workbooks, "path string, content binary"))
    found = records.table_records(cells, ["name", "segment"], ["segment"])
    proof = records.cell_evidence(cells, found, {"segment": "segment"}).where("name = 'segment'")
    out = found.join(proof.select("id", "row", F.concat_ws(":", "state", "cell").alias("evidence")), ["id", "row"])
    return out.select("id", "row", "name", "segment", F.array_join("missing", ",").alias("missing"), "evidence")


@query("""
WITH r AS (SELECT doc_id AS id, coalesce(text, '') AS text, source FROM documents), h AS (SELECT id, sha256(text) AS h, strlen(text) AS n FROM r WHERE source <> 'src3'), store AS (SELECT DISTINCT sha256(coalesce(text, '')) AS h FROM documents WHERE lang = 'de')
SELECT h AS content_hash, max(n)::BIGINT AS byte_length, count(*) AS snapshots FROM h WHERE h NOT IN (SELECT h FROM store) GROUP BY h
""")
def q_raw_capture(spark, d):
    """Responses to snapshots and to blobs that the store lacks, each once."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"), (F.col("source") == "src3").alias("failed"), "lang")
    store = docs.where("lang = 'de'").select(F.sha2("content", 256).alias("content_hash")).distinct()
    snapshots, blobs = capture.captured(docs.drop("lang"), store, "content", "failed")
    n = snapshots.groupBy("content_hash").agg(F.count("*").alias("snapshots"))
    return blobs.select("content_hash", F.col("byte_length").cast("long").alias("byte_length")).join(n, "content_hash")


@query("""
WITH t AS (SELECT DISTINCT l_suppkey * 3 AS k FROM lineitem), r AS (SELECT l_partkey AS k, l_suppkey AS v, l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_tax < 0.05)
SELECT k, v, o FROM r WHERE k NOT IN (SELECT k FROM t) QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, n, v) = 1
""")
def q_insert_ignored_rows(spark, d):
    """New keys only, the first write of each."""
    lines = table(spark, d, "lineitem")
    held = lines.select((F.col("l_suppkey") * 3).alias("k")).distinct()
    rows = lines.where("l_tax < 0.05").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return q.insert_ignored(held, rows, ["k"], ["o", "n", "v"]).select("k", "v", "o")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'APPENDED' ELSE 'COLLISION' END AS outcome FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderstatus <> 'F')
""")
def q_append_only_rows(spark, d):
    """An append-only table takes new ids; the same id with other content is a collision, with the same a repeat."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    held = o.where("id % 3 <> 0").select("id", F.col("o_orderstatus").alias("content"))
    rows = o.select("id", F.when(F.col("id") % 3 == 1, "F").otherwise(F.col("o_orderstatus")).alias("content"))
    new, collisions = q.append_only(held, rows, "id", "content")
    return new.select("id", F.lit("APPENDED").alias("outcome")).unionAll(collisions.select("id", F.lit("COLLISION")))


@query("""
WITH v AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), c AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY n) AS before FROM v),
r AS (SELECT *, sum(CASE WHEN n = 1 OR s <> before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS revision FROM c), h AS (SELECT k, revision, arg_min(id, n) AS id, min(s) AS s FROM r GROUP BY ALL)
SELECT k, max(revision)::INTEGER AS revision, arg_max(id, revision) AS current, sha256('{"revision":' || max(revision) || ',"status":"' || arg_max(s, revision) || '"}') AS snapshot FROM h GROUP BY k
""")
def q_current_snapshots(spark, d):
    """Versions of each key's history, and the snapshot of the current one."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), "o_orderdate")
    versions = versioning.versions_latest(o, ["k"], "s", ["o_orderdate", "id"])
    return versioning.snapshots(versions, ["k"], "revision", "id", {"status": "s"}, ["o_orderdate", "id"]).select("k", "revision", "current", "snapshot")


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
r AS (SELECT k, id, CASE WHEN n % 5 = 0 THEN n - 1 ELSE n END AS revision FROM o), b AS (SELECT *, lag(revision) OVER (PARTITION BY k ORDER BY revision, id) AS before FROM r)
SELECT k, id, CASE WHEN before = revision THEN 'DUPLICATE' ELSE 'GAP' END AS reason FROM b WHERE before = revision OR revision > before + 1
""")
def q_catalog_append(spark, d):
    """Catalog revisions: what may be appended, and what breaks the chain."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), "o_orderdate")
    n = versioning.numbered(o, ["k"], ["o_orderdate", "id"])
    rows = n.withColumn("revision", F.when(F.col("n") % 5 == 0, F.col("n") - 1).otherwise(F.col("n")))
    rows = rows.withColumn("content", F.concat_ws("/", "k", "n"))
    chain = versioning.superseding(rows, ["k"], "id", ["revision", "id"])
    return versioning.chain_breaks(chain, ["k"], "revision", "content", "supersedes", "id").where("reason <> 'SUPERSEDES'").select("k", "id", "reason")


@query("""
SELECT o_custkey AS k, min(o_orderdate) AS first_seen, max(o_orderkey) AS last_id FROM orders GROUP BY 1
""")
def q_first_seen(spark, d):
    """When a key was first seen (F8)."""
    return versioning.first_seen(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").join(table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_id")), "o_custkey").select(F.col("o_custkey").alias("k"), "first_seen", "last_id")


@query("""
WITH v AS (SELECT l_orderkey AS g, l_partkey AS p, l_suppkey AS s, l_returnflag AS f, l_linenumber AS n FROM lineitem), m AS (SELECT DISTINCT g, p || '/' || s || '/' || f AS x FROM v),
h AS (SELECT g, sha256('[' || string_agg('"' || x || '"', ',' ORDER BY x) || ']') AS h FROM m GROUP BY g)
SELECT g, (1 + g % 2)::INTEGER AS revision, h AS graph FROM h
""")
def q_graph_versions(spark, d):
    """A graph's version: the hash of its edges, a new revision where it differs from the one before (H7)."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.concat_ws("/", "l_partkey", "l_suppkey", "l_returnflag").alias("edge"))
    # every other graph had one more edge before
    before = lines.where("g % 2 = 1").unionAll(lines.where("g % 2 = 1").select("g", F.lit("old/edge")).distinct()).withColumn("at", F.lit(1))
    rows = before.unionByName(lines.withColumn("at", F.lit(2)))
    found = versioning.graph_versions(rows, ["g"], "at", "edge")
    return found.groupBy("g").agg(F.max("revision").alias("revision"), F.max_by("graph", "at").alias("graph"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'CONFIRMED' WHEN c_custkey % 3 = 1 THEN 'PROVISIONAL' ELSE 'UNRESOLVED' END AS state,
  CASE WHEN c_custkey % 3 = 0 THEN sha256('{"code":"' || c_name || '","namespace":"n' || c_nationkey || '"}') WHEN c_custkey % 3 = 1 THEN sha256('{"key":"' || c_mktsegment || '","source":"s"}') END AS identity FROM customer
""")
def q_position_identity(spark, d):
    """Positions by an official code, else by their source's key."""
    k = F.col("c_custkey") % 3
    found = gates.position_identity(F.when(k == 0, F.concat(F.lit("n"), "c_nationkey")), F.when(k != 1, F.col("c_name")), F.when(k == 1, F.col("c_mktsegment")), F.lit("s"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), found["state"].alias("state"), found["identity"].alias("identity"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'content' WHEN c_custkey % 2 = 0 THEN 'source_id' ELSE 'url' END AS kind, sha256('{"name":"' || c_name || '","nation":' || c_nationkey || ',"tags":["' || least('a', lower(substr(c_mktsegment, 1, 1))) || '"' || CASE WHEN lower(substr(c_mktsegment, 1, 1)) <> 'a' THEN ',"' || lower(substr(c_mktsegment, 1, 1)) || '"' ELSE '' END || ']}') AS content FROM customer
""")
def q_diff_fingerprints(spark, d):
    """Fingerprints of change detection: the URL before the source's id, and the content without nulls."""
    k = F.col("c_custkey")
    basis = canon.first_basis(("url", {"url": F.when(k % 2 == 1, F.concat(F.lit("/"), k))}), ("source_id", {"id": F.when(k % 4 != 0, k)}), ("content", {"name": F.col("c_name")}))
    tags = F.array(F.lower(F.substring("c_mktsegment", 1, 1)), F.lit("a"), F.lit("a"))
    content = canon.semantic_hash({"nation": F.col("c_nationkey"), "name": F.col("c_name"), "tags": tags, "spare": F.lit(None).cast("string")}, sets=("tags",), keep_nulls=False)
    return table(spark, d, "customer").select(k.alias("id"), basis["kind"].alias("kind"), content.alias("content"))


@query("""
WITH c AS (SELECT o_orderkey AS c, unnest([o_custkey, o_custkey, o_orderkey]) AS e FROM orders), u AS (SELECT DISTINCT c, e FROM c)
SELECT c AS claim, e::VARCHAR AS evidence_id, CASE WHEN k IS NULL THEN 'UNKNOWN' ELSE 'KIND' END AS fault FROM u LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS m FROM customer) ON k = e WHERE k IS NULL OR m <> 'BUILDING'
""")
def q_identity_evidence(spark, d):
    """Evidence that claims name but that is not there, or of another kind."""
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("c"), F.transform(F.array("o_custkey", "o_custkey", "o_orderkey"), lambda x: x.cast("string")).alias("ids"))
    held = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("e"), F.col("c_mktsegment").alias("kind"))
    return gates.missing_evidence(claims, held, "c", "ids", "e", "kind", ["BUILDING"]).select(F.col("c").alias("claim"), "evidence_id", "fault")


@query(r"""
WITH x AS (SELECT doc_id, 'Ａ' || lang || '（' || source || '）；  北京市　区' AS t FROM documents)
SELECT doc_id, 'A' || lang || '(' || source || '); 北京市 区' AS stable, CASE WHEN lang = 'en' THEN '北京' WHEN lang = 'de' THEN '上海' ELSE 'A' || lang || '(x)' END AS place, 'key' || (doc_id % 3)::VARCHAR AS label, CASE WHEN doc_id % 3 = 0 THEN '2026-02-31' END AS deadline FROM x JOIN documents USING (doc_id)
""")
def q_text_norms(spark, d):
    """Stable text, locations, list marks and labelled dates."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    stable = tx.stable_text(F.concat(F.lit("Ａ"), "lang", F.lit("（"), "source", F.lit("）；  北京市　区")))
    place = tx.location_name(F.when(F.col("lang") == "en", "北京 市").when(F.col("lang") == "de", "上海市").otherwise(F.concat(F.lit("Ａ"), "lang", F.lit("（ x）"))))
    marks = F.element_at(F.array(F.lit("1. "), F.lit("（二）"), F.lit("③")), (F.col("doc_id") % 3 + 1).cast("int"))
    date = F.when(F.col("doc_id") % 3 == 0, F.lit("发布日期：2026-01-05，报名至：本月 2026年2月31日。")).otherwise("报名至，2026年1月1日")
    return docs.select("doc_id", stable.alias("stable"), place.alias("place"), tx.unmarked(F.concat(marks, F.lit("key"), F.col("doc_id") % 3)).alias("label"), tx.deadline(date).alias("deadline"))


@query(r"""
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL ELSE '招聘 ' || page_id END AS text, 'http://h.example/' || page_id || '/' AS slashed, 'a' || page_id || '|(b, c)|d、e' AS parts FROM pages
""")
def q_charsets(spark, d):
    """Bytes by their charset, URLs that keep their last slash, lists cut outside parentheses and protected phrases."""
    pages = table(spark, d, "pages")
    text = F.concat(F.lit("招聘 "), F.col("page_id"))
    # the two characters in GBK, by their bytes
    gbk = F.concat(F.unhex(F.lit("D5D0C6B8")), F.concat(F.lit(" "), F.col("page_id")).cast("binary"))
    kind = F.col("page_id") % 5
    data = F.when(kind < 2, gbk).when(kind == 4, F.unhex(F.lit("FFFE41"))).otherwise(text.cast("binary"))
    charset = F.when(kind == 0, "GBK").when(kind == 1, "gb2312").when(kind == 2, "utf-8")
    url = tx.url_canonical(F.concat(F.lit("HTTP://H.example//"), F.col("page_id"), F.lit("/#x")), keep_slash=True)
    parts = tx.split_outside(F.concat(F.lit("a"), F.col("page_id"), F.lit("，(b, c)/ d、e")), ("d、e",))
    return pages.select("page_id", tx.decoded(data, charset).alias("text"), url.alias("slashed"), F.array_join(parts, "|").alias("parts"))


def _written(batches):
    """Workbooks of several sheets (path, sheets: name and rows of texts) as files; their paths."""
    from pyarrow import fs

    for batch in batches:
        for path, sheets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                listed = "".join(f'<sheet name="{s["name"]}" sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(sheets, 1))
                z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>')
                links = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
                z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
                for k, s in enumerate(sheets, 1):
                    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(s["rows"], 1))
                    z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
            store, inner = fs.FileSystem.from_uri(path)
            store.create_dir(inner.rsplit("/", 1)[0])
            with store.open_output_stream(inner) as f:
                f.write(out.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])


@query("""
WITH r AS (SELECT c_nationkey, c_mktsegment, c_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)
SELECT 'w' || c_nationkey || '.xlsx' AS book, c_mktsegment AS sheet, n::INTEGER AS "row", c_name AS name, c_custkey::VARCHAR AS key FROM r WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND n > 3
""")
def q_workbook_source(spark, d):
    """Workbooks read sheet by sheet, two sheets of each from their fourth row on (A4)."""
    base = f"{shared_dir(spark)}/recordloom/books-{uuid.uuid4().hex}"
    base = base if "://" in base else base.replace("file:", "file://", 1)
    people = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", F.array("c_name", F.col("c_custkey").cast("string")).alias("cells"))
    sheets = people.groupBy("c_nationkey", "c_mktsegment").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "cells"))), lambda x: x["cells"]).alias("rows"))
    books = sheets.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("name"), "rows")).alias("sheets"))
    books.select(F.concat(F.lit(f"{base}/w"), "c_nationkey", F.lit(".xlsx")).alias("path"), "sheets").mapInArrow(_written, "path string").count()
    cells = workbooks.read_workbooks(spark, base).where(F.col("sheet").isin("BUILDING", "MACHINERY") & (F.col("row") > 3))
    out = cells.groupBy("id", "sheet", "row").agg(F.max(F.when(F.col("column") == 1, F.col("value"))).alias("name"), F.max(F.when(F.col("column") == 2, F.col("value"))).alias("key"))
    return out.select(F.element_at(F.split("id", "/"), -1).alias("book"), "sheet", "row", "name", "key")
