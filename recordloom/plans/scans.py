"""Scans of the pages and texts as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import records, sinks
from .tables import query, table


@query(r"""
SELECT page_id, count(h) AS n_links, count(DISTINCT h) AS n_distinct, coalesce(min(h), '') AS first_link FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS h FROM pages) GROUP BY page_id
""")
def q_list_links(spark, d):
    """Links of list items with the text around them."""
    found = records.links_of(table(spark, d, "pages").select("page_id", "html"), "page_id", "html").where(F.col("context") == F.col("label"))
    return found.groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"), F.min("href").alias("first_link"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
o AS (SELECT *, max(CASE WHEN regexp_matches(text, '^(Th|La|De)[a-z]*') THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS start FROM l),
b AS (SELECT doc_id, start, arg_min(text, line) AS head, string_agg(text, chr(10) ORDER BY line) AS t FROM o WHERE line - start < 3 GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start))::INTEGER AS place, regexp_extract(head, '^((Th|La|De)[a-z]*)', 1) AS title, sha256(t) AS text_hash FROM b
""")
def q_labelled_blocks(spark, d):
    """Blocks from a line of a kind to the next one, three lines at most."""
    found = records.labelled_blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", "^((?:Th|La|De)[a-z]*)", 3)
    return found.select(F.col("id").alias("doc_id"), "place", "title", F.sha2("text", 256).alias("text_hash"))


@query("""
SELECT event_id, event_type || ':' || regexp_extract(props, '"k": *([0-9]+)', 1) AS found FROM events
""")
def q_json_records(spark, d):
    """Records of JSON texts."""
    events = table(spark, d, "events").select("event_id", F.concat(F.lit('{"records":[{"kind":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}]}")).alias("json"))
    rows = records.json_records(events, "event_id", "json", "kind string, props struct<k:int>")
    return rows.select(F.col("id").alias("event_id"), F.concat_ws(":", "kind", "props.k").alias("found"))


@query("""
SELECT sha256('{"lang":"' || lang || '","reasons":["' || lang || '"],"source":"' || source || '","status":"DISPLAY"}') AS hash, count(*) AS n FROM documents WHERE n_chars > 500 AND lang IN ('de', 'en') GROUP BY 1
UNION ALL SELECT sha256('{"lang":"' || lang || '","reasons":[],"source":"' || source || '","status":"DISPLAY"}'), count(*) FROM documents WHERE n_chars > 500 AND lang NOT IN ('de', 'en') GROUP BY 1
""")
def q_public_snapshot(spark, d):
    """What may be shown, with public reasons only, and its hashes."""
    docs = table(spark, d, "documents").select("lang", "source", F.when(F.col("n_chars") > 500, "DISPLAY").otherwise("NOT_DISPLAY").alias("status"), F.array("lang", F.lit("internal")).alias("reasons"))
    return sinks.public_snapshot(docs, "status", "reasons", ["de", "en"], ["lang", "source"]).groupBy("hash").agg(F.count("*").alias("n"))
