"""Scans, hashes, URLs, dates and clauses of the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..functions import text as tx
from .tables import query, table


@query("""
WITH r AS (SELECT doc_id AS id, 'document' AS kind, text FROM documents UNION ALL SELECT item_id, 'benchmark', text FROM benchmark),
h AS (SELECT id, kind, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))) AS content_hash FROM r)
SELECT content_hash, arg_min(kind, (CASE kind WHEN 'benchmark' THEN 0 ELSE 1 END, id)) AS kind, arg_min(id, (CASE kind WHEN 'benchmark' THEN 0 ELSE 1 END, id)) AS id, count(*) AS copies FROM h GROUP BY content_hash
""")
def q_content_dedupe(spark, d):
    """Texts by content, each once."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "text")
    rows = rows.unionAll(table(spark, d, "benchmark").select("item_id", F.lit("benchmark"), "text"))
    hashed = rows.select("id", "kind", canon.sha256(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")))).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min_by("kind", F.struct("kind", "id")).alias("kind"), F.min_by("id", F.struct("kind", "id")).alias("id"), F.count("*").alias("copies"))


@query("""
WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^(https?)://', 1)) AS s, lower(regexp_extract(u, '^https?://([^/?]*)', 1)) AS h, regexp_replace(regexp_extract(u, '^https?://[^/?]*([^?]*)', 1), '/{2,}', '/', 'g') AS t, regexp_extract(u, '^[^?]*\\?(.*)$', 1) AS q FROM b)
SELECT page_id, s || '://' || h || CASE WHEN t IN ('', '/') THEN '/' ELSE regexp_replace(t, '/$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url FROM p
""")
def q_url_canon(spark, d):
    """Canonical URLs (D3)."""
    return table(spark, d, "pages").select("page_id", tx.url_canonical(F.col("url")).alias("url"))


@query("""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^https://([^/?#:]*)', 1)) AS h, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)
SELECT page_id, h <> '' AND NOT contains(url, '#') AS safe, NOT regexp_matches(p, '(^|/)(index|list|recruiting)\\.html?$') AND regexp_matches(p, '/job(_z)?-?\\d[\\d-]*\\.html?$') AS detail FROM u
""")
def q_url_tests(spark, d):
    """Safe URLs and URLs of single postings."""
    return table(spark, d, "pages").select("page_id", tx.safe_url(F.col("url")).alias("safe"), tx.detail_url(F.col("url")).alias("detail"))


@query(r"""
WITH a AS (SELECT page_id, html, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, html, regexp_replace(regexp_replace(x, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table|nav|header|footer|title)\s*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM b),
e AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(x, '[ \t\r\f 　]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS x FROM c)
SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, length(x) AS text_length, sha256(x) AS text_hash FROM e
""")
def q_html_fields(spark, d):
    """Title and text of pages."""
    pages = table(spark, d, "pages").select("page_id", "html", tx.html_text(F.col("html")).alias("x"))
    return pages.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.length("x").cast("long").alias("text_length"), F.sha2("x", 256).alias("text_hash"))


@query(r"""
WITH s AS (SELECT conv_id, turn, string_split_regex(text, '[;；。\n]+') AS p FROM conversations),
u AS (SELECT conv_id, turn, unnest(list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS text, unnest(range(1, len(list_filter(p, lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) + 1)) AS place FROM s)
SELECT conv_id, turn, place::INTEGER AS place, text, true AS in_place FROM u
""")
def q_clause_split(spark, d):
    """Clauses of turns, with offsets that lead back to them."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.inline(tx.clauses(F.col("text"))).alias("place", "clause", "start", "end"))
    in_place = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("clause")
    return rows.select("conv_id", "turn", "place", F.col("clause").alias("text"), in_place.alias("in_place"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_extract(text, '(?:^|[^0-9])(20[0-9]{2})(?:[^0-9]|$)', 1) <> '' THEN 1 ELSE 0 END AS has_year, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'mailto:' || regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') END AS mail FROM documents
""")
def q_text_facts(spark, d):
    """Years and mail links in texts."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.year_of(F.col("text")).isNotNull().cast("int").alias("has_year"), tx.mail_link(F.col("text")).alias("mail"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found, year(o_orderdate)::INTEGER AS y FROM orders
""")
def q_dates(spark, d):
    """Dates written in different ways."""
    written = F.concat(F.lit("due: "), F.year("o_orderdate"), F.element_at(F.array(*map(F.lit, "-/.年")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.month("o_orderdate"), F.element_at(F.array(*map(F.lit, "-/.月")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.dayofmonth("o_orderdate"), F.lit("日 end"))
    year = F.coalesce(tx.year_of(written), F.year("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", tx.iso_date(written).alias("found"), year.alias("y"))


@query("""
SELECT o_orderkey, (year(DATE '2003-02-28') - year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0228' THEN 1 ELSE 0 END)::INTEGER AS age FROM orders
""")
def q_age(spark, d):
    """Full calendar years."""
    return table(spark, d, "orders").select("o_orderkey", tx.full_years(F.col("o_orderdate"), F.lit("2003-02-28").cast("date")).alias("age"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'source_id' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'url' ELSE 'content' END AS kind,
  CASE WHEN c_acctbal > 5000 THEN '{"id":' || c_custkey || '}' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '{"url":"/' || c_mktsegment || '"}' ELSE '{"name":"' || c_name || '","nation":' || c_nationkey || '}' END AS v FROM customer)
SELECT c_custkey, kind, sha256('{"basis":{"kind":"' || kind || '","value":"' || replace(v, '"', '\\"') || '"},"scope":"s"}') AS identity, 'x-' || substr(c_name, 1, 8) || '-' || upper(substr(sha256(c_name || '|' || c_custkey), 1, 12)) AS short
FROM c JOIN customer USING (c_custkey)
""")
def q_identity(spark, d):
    """Identity by the first basis that is there, and short ids."""
    c = table(spark, d, "customer")
    basis = canon.first_basis(
        ("source_id", {"id": F.when(F.col("c_acctbal") > 5000, F.col("c_custkey"))}),
        ("url", {"url": F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.concat(F.lit("/"), F.col("c_mktsegment")))}),
        ("content", {"nation": F.col("c_nationkey"), "name": F.col("c_name")}))
    c = c.withColumn("basis", basis)
    return c.select("c_custkey", F.col("basis.kind").alias("kind"), canon.identity_hash(F.lit("s"), F.col("basis")).alias("identity"), canon.short_id("x", F.col("c_name"), [F.col("c_name"), F.col("c_custkey").cast("string")]).alias("short"))


@query("""
SELECT o_custkey, sha256('{"keys":[' || string_agg(DISTINCT '"' || o_orderpriority || '"', ',' ORDER BY '"' || o_orderpriority || '"') || '],"owner":' || o_custkey || ',"spare":null}') AS content_hash FROM orders GROUP BY o_custkey
""")
def q_semantic_hash(spark, d):
    """Content hashes in which set-like fields have one form."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    fields = {"owner": F.col("o_custkey"), "keys": F.col("p"), "spare": F.lit(None).cast("string")}
    return lists.select("o_custkey", canon.semantic_hash(fields, sets=("keys",)).alias("content_hash"))


@query("""
SELECT event_id, sha256('{"a":{"x":true,"y":null},"n":' || CASE WHEN event_id % 2 = 0 THEN event_id * 100 ELSE -event_id END || ',"p":' || replace(props, ' ', '') || ',"z":[{"a":"' || event_type || '","b":1.5},[],{}]}') AS hash FROM events
""")
def q_canonical_json(spark, d):
    """Nested JSON of shuffled keys, white space and number forms hashes alike."""
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    n = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("event_id").cast("string"), F.lit("e2"))).otherwise(F.concat(F.lit("-"), F.col("event_id").cast("string"), F.lit(".0")))
    deep = F.concat(F.lit('"z" : [{"b":1.50,"a":"'), "event_type", F.lit('"}, [ ], {}]'))
    parts = [F.concat(F.lit('"n":'), n), deep, F.lit('"a":{"y":null, "x":true}'), F.concat(F.lit('"p":'), "props")]
    turned = [F.concat_ws(", ", *parts[k:], *parts[:k]) for k in range(4)]
    text = F.concat(F.lit("{"), F.element_at(F.array(*turned), (F.col("event_id") % 4 + 1).cast("int")), F.lit("}"))
    return e.select("event_id", canon.canonical_hash(text).alias("hash"))
