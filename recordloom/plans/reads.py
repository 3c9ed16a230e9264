"""Read models: current pages, provenance, nested evidence, validity, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ledger, query as q, summary, versioning
from ..sources import sinks
from ..sources.stored import shared_dir
from .tables import query, table


@query("""
WITH latest AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
f AS (SELECT o_orderkey, o_custkey, o_orderdate, c_name, n_name, r_name FROM latest JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE contains(lower(r_name), 'a') AND (contains(lower(c_name), '1') OR contains(lower(n_name), '1'))),
p AS (SELECT *, count(*) OVER () AS total FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 10)
SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_date, c_name, n_name, r_name, total, count(l_orderkey) AS n_lines, count(DISTINCT s_nationkey) AS n_supplier_nations, min(s_name) AS first_supplier
FROM p LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
""")
def q_current_page(spark: SparkSession, d: str) -> DataFrame:
    """Current orders, one for each customer, found by keyword, paged, with their provenance."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    places = table(spark, d, "nation").join(table(spark, d, "region").where(q.keyword_any("a", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey")).where(q.keyword_any(" 1 ", "c_name", "n_name"))
    current = versioning.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).join(people, F.col("o_custkey") == F.col("c_custkey"))
    shown = q.page(current, [F.desc("o_orderdate"), "o_orderkey"], 10, 40).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_date"), "c_name", "n_name", "r_name", "total")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(F.broadcast(shown.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    evidence = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("l_orderkey")
    evidence = evidence.agg(F.count("*").alias("n_lines"), F.countDistinct("s_nationkey").alias("n_supplier_nations"), F.min("s_name").alias("first_supplier"))
    out = shown.join(evidence, shown["o_orderkey"] == evidence["l_orderkey"], "left").drop("l_orderkey")
    return out.fillna(0, ["n_lines", "n_supplier_nations"])


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey))
""")
def q_latest_anti(spark, d):
    """Rows without a later one of their key, as an aggregation."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return versioning.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(' ', lang, source)), 'n src1')
""")
def q_keyword_joined(spark, d):
    """A keyword that reaches from one field into the next."""
    return table(spark, d, "documents").select("doc_id", "lang", "source").where(q.keyword_joined("n SRC1", "lang", "source"))


@query("""
SELECT l_orderkey AS o_orderkey, o_orderstatus, string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_returnflag) AS evidence, count(*) AS n_lines
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def q_nested_evidence(spark, d):
    """Orders with their lines as an ordered list."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag")
    out = q.nested(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], ["l_returnflag"], "lines").where(F.size("lines") > 0)
    one = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_returnflag"]))
    return out.select("o_orderkey", "o_orderstatus", F.array_join(one, ";").alias("evidence"), F.size("lines").cast("long").alias("n_lines"))


@query("""
WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate AS b, o_orderdate + INTERVAL 45 DAY AS e FROM orders), v AS (SELECT o_custkey, o_orderkey AS event, o_orderdate + INTERVAL 40 DAY AS at FROM orders WHERE o_orderstatus = 'F')
SELECT v.o_custkey, v.event, count(*) AS n_valid, min(f.o_orderkey) AS first_fact FROM v JOIN f ON f.o_custkey = v.o_custkey AND v.at BETWEEN f.b AND f.e GROUP BY ALL
""")
def q_asof_validity(spark, d):
    """Facts that hold at an event's instant, both ends included."""
    orders = table(spark, d, "orders")
    facts = orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("b"), F.expr("o_orderdate + INTERVAL 45 DAY").alias("e"))
    events = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("event"), F.expr("o_orderdate + INTERVAL 40 DAY").alias("at"))
    found = q.validity_join(facts, events, "o_custkey", "b", "e", "at", 45 * 86400)
    return found.groupBy("o_custkey", "event").agg(F.count("*").alias("n_valid"), F.min("o_orderkey").alias("first_fact"))


@query("""
WITH active AS (SELECT DISTINCT c_nationkey, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000)
SELECT c.c_nationkey, c.c_custkey, c_name FROM customer c WHERE c_nationkey IN (SELECT c_nationkey FROM active) AND NOT EXISTS (SELECT 1 FROM active a WHERE a.c_custkey = c.c_custkey)
""")
def q_semi_anti(spark, d):
    """Published rows that the last crawl of their source didn't find."""
    customers = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return q.vanished(customers, customers.join(big, "c_custkey", "left_semi"), "c_nationkey", "c_custkey")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem WHERE l_quantity > 45), o AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem WHERE l_discount > 0.05)
SELECT k AS l_orderkey, s AS l_suppkey, 'NOT_COVERED' AS blocker FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = e.k AND o.s = e.s)
""")
def q_coverage(spark, d):
    """Expected pairs that no observation covers."""
    lines = table(spark, d, "lineitem")
    return q.coverage(lines.where("l_quantity > 45").select("l_orderkey", "l_suppkey"), lines.where("l_discount > 0.05").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


@query("""
SELECT e.event_id, e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderstatus = 'P')
""")
def q_orphans(spark, d):
    """Children whose parent is missing."""
    parents = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return q.orphans(table(spark, d, "events").select("event_id", "user_id"), parents, "user_id").select("event_id", "user_id")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y FROM orders WHERE o_orderpriority = '5-LOW')
SELECT c, y::INTEGER AS y, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT c, y::INTEGER, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def q_set_differences(spark, d):
    """What only one of two sets holds."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), "o_orderpriority")
    return q.set_differences(rows.where("o_orderpriority = '1-URGENT'"), rows.where("o_orderpriority = '5-LOW'"), ["c", "y"])


@query("""
WITH u AS (SELECT c_name AS name, c_nationkey AS nation, 1 AS generation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 9000),
s AS (SELECT s_name AS name, s_nationkey AS nation, 2 AS generation, NULL AS segment FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000 AND c_nationkey = s_nationkey))
SELECT * FROM u UNION ALL SELECT * FROM s
""")
def q_union_gen(spark, d):
    """Rows of two generations of a schema; the second fills in where the first has nothing."""
    first = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(1).alias("generation"), F.col("c_mktsegment").alias("segment"))
    second = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(2).alias("generation"))
    return q.fallback_union(first, second, ["nation"])


@query("""
WITH t AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1), r AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1)
SELECT coalesce(r.k, t.k) AS k, coalesce(r.v, t.v) AS v FROM t FULL JOIN r ON t.k = r.k
""")
def q_upsert(spark, d):
    """A table after rows replaced those of their keys."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderdate")
    side = lambda when: rows.where(when).groupBy("k").agg(F.max("v").alias("v"))
    return q.upserted(side("o_orderdate < '1999-01-01'"), side("o_orderdate >= '2001-01-01'"), ["k"])


@query("""
WITH t AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49), r AS (SELECT l_partkey AS k, l_suppkey AS v, l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_tax < 0.02)
SELECT k, v, o FROM r WHERE k NOT IN (SELECT k FROM t) QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, n, v) = 1
""")
def q_insert_ignore(spark, d):
    """Rows to append where the first write of a key wins."""
    lines = table(spark, d, "lineitem")
    held = lines.where("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct()
    rows = lines.where("l_tax < 0.02").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return q.insert_ignored(held, rows, ["k"], ["o", "n", "v"]).select("k", "v", "o")


@query("""
WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE n_chars > 600 OR source = 'src3' GROUP BY source)
SELECT b.source, b.n AS incoming, a.n AS held FROM a JOIN b USING (source) WHERE a.n <> b.n
""")
def q_append_only(spark, d):
    """Collisions of an append-only sink: one id, other content."""
    docs = table(spark, d, "documents")
    held = docs.groupBy("source").agg(F.count("*").alias("n"))
    incoming = docs.where("n_chars > 600 OR source = 'src3'").groupBy("source").agg(F.count("*").alias("n"))
    return versioning.conflicting_history(held, incoming, ["source"], "n").select("source", F.col("incoming_content").alias("incoming"), F.col("n").alias("held"))


@query("""
SELECT c_custkey, '"' || CASE WHEN regexp_matches(c_acctbal::VARCHAR, '^[=+@\\-\\t\\r]') THEN '''' ELSE '' END || c_acctbal::VARCHAR || '"' AS cell, '"' || replace(c_name || '"', '"', '""') || '"' AS name FROM customer
""")
def q_csv_guard(spark, d):
    """CSV cells, quoted and guarded against formulas."""
    return table(spark, d, "customer").select("c_custkey", tx.csv_cell(F.col("c_acctbal")).alias("cell"), tx.csv_cell(F.concat("c_name", F.lit('"'))).alias("name"))


@query("""
SELECT event_id, len(list_filter(['k', event_type, 'api_key', 'Session-Id'], lambda x: NOT regexp_matches(x, '(?i)authorization|cookie|token|secret|password|api[-_]?key|session'))) AS kept, event_type AS one FROM events
""")
def q_redact(spark, d):
    """Headers without the sensitive ones."""
    events = table(spark, d, "events")
    headers = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.col("event_type"), F.lit("x"), F.lit("api_key"), F.lit("x"), F.lit("Session-Id"), F.lit("x"))
    kept = tx.redacted(headers)
    return events.select("event_id", F.size(kept).cast("long").alias("kept"), F.array_max(F.filter(F.map_keys(kept), lambda k: k != "k")).alias("one"))


@query("""
WITH due AS (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01'),
u AS (SELECT * FROM due WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 15),
r AS (SELECT * FROM due WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u) ORDER BY o_orderdate, o_orderkey LIMIT 35)
SELECT o_orderkey, o_orderpriority FROM u UNION ALL SELECT o_orderkey, o_orderpriority FROM r
""")
def q_topk_quota(spark, d):
    """The 50 rows due first, 15 of them urgent if there are so many."""
    due = table(spark, d, "orders").where("o_orderdate <= '2000-01-01'").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return ledger.quota_top(due, F.col("o_orderpriority") == "1-URGENT", ["o_orderdate", "o_orderkey"], 50).drop("o_orderdate")


@query("""
SELECT l_orderkey, count(*) AS requests, sum(l_quantity)::DOUBLE AS bytes, sum(l_linenumber - 1)::BIGINT AS retries, coalesce(string_agg(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END, ',' ORDER BY CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END), '') AS errors FROM lineitem GROUP BY l_orderkey
""")
def q_run_audit(spark, d):
    """Requests, bytes, retries and error codes of each run (F1)."""
    error = F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus"))
    return summary.run_audit(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", F.col("l_linenumber") - 1, error)


@query("""
SELECT count(*) AS total, count_if(n_chars > 5000) AS top, count_if(lang = 'en') AS open, count(DISTINCT source) AS units, max(coalesce(CASE WHEN lang <> 'en' THEN n_chars END, doc_id)) AS updated FROM documents
""")
def q_kpis(spark, d):
    """The board's figures."""
    updated = F.coalesce(F.when(F.col("lang") != "en", F.col("n_chars")), F.col("doc_id"))
    return summary.board(table(spark, d, "documents").select("n_chars", "lang", "source", "doc_id"), F.col("n_chars") > 5000, F.col("lang") == "en", "source", updated)


@query("""
SELECT o_custkey, count(p) AS n, count(DISTINCT p) AS n_distinct FROM (SELECT o_custkey, unnest([o_orderpriority, o_orderstatus]) AS p FROM orders) GROUP BY o_custkey
""")
def q_cardinality(spark, d):
    """Items and distinct items of array-valued rows (F16)."""
    return summary.cardinality(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey", F.array("o_orderpriority", "o_orderstatus"))


@query("""
SELECT o_orderkey, CASE WHEN days < 0 THEN 'closed' WHEN days <= 7 THEN 'urgent' ELSE 'open' END AS tone FROM (
  SELECT o_orderkey, ceil((epoch(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY) - 8 * 3600 - 1 - epoch(TIMESTAMP '1998-06-15 12:00:00')) / 86400) AS days FROM orders)
""")
def q_deadline_tone(spark, d):
    """How near a deadline is, by local days."""
    now = F.lit("1998-06-15 12:00:00").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", q.deadline_tone(F.to_date("o_orderdate"), now).alias("tone"))


@query("""
WITH t AS (SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER () AS total FROM lineitem)
SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, total FROM t ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100 OFFSET 45000
""")
def q_deep_page(spark, d):
    """A page far behind the first rows, found by ranks."""
    lines = table(spark, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return q.page(lines, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 45000, 100)


@query("""
WITH h AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
l AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT) AS a, sum(('0x' || substr(h, 9, 8))::BIGINT) AS b, sum(('0x' || substr(h, 17, 8))::BIGINT) AS c, sum(('0x' || substr(h, 25, 8))::BIGINT) AS d FROM h)
SELECT o_custkey, count(*) AS entries, max(o_orderkey) AS last, (SELECT sha256(n || '|' || a || '|' || b || '|' || c || '|' || d) FROM l) AS content FROM orders GROUP BY o_custkey
""")
def q_index_rebuild(spark, d):
    """An index written anew by key, read back, and the hash of all that it holds."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    path = f"{shared_dir(spark)}/recordloom/index-{uuid.uuid4().hex}"
    content = sinks.index_rebuild(rows, ["o_custkey", "o_orderkey"], path)
    index = spark.read.schema(rows.schema).parquet(path)
    return index.groupBy("o_custkey").agg(F.count("*").alias("entries"), F.max("o_orderkey").alias("last")).withColumn("content", F.lit(content))
