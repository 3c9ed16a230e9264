"""Versions, changes, health, cadence and hash chains over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..operators import diff, folds, journal, ledger, versioning
from ..operators.prefix import pieced, running_sum, scanned
from ..sources.stored import merged, stored
from .tables import query, table


def _day(spark, d, day: str):
    """The last event of each user and type on a day."""
    events = table(spark, d, "events").where(F.to_date("ts") == day).select("user_id", "event_type", "ts", "event_id", F.floor(F.col("value") / 50).cast("long").alias("content"))
    return versioning.latest(events, ["user_id", "event_type"], ["ts", "event_id"])


@query("""
WITH l AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type, floor(value / 50)::BIGINT AS content FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
a AS (SELECT * FROM l WHERE day = DATE '2024-01-10'), b AS (SELECT * FROM l WHERE day = DATE '2024-01-11')
SELECT coalesce(b.event_type, a.event_type) AS event_type, coalesce(b.user_id, a.user_id) AS user_id,
  CASE WHEN a.user_id IS NULL THEN 'NEW' WHEN b.user_id IS NULL THEN 'MISSING_OBSERVED' WHEN a.content = b.content THEN 'UNCHANGED' ELSE 'UPDATED' END AS change, 1::BIGINT AS rows
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type
""")
def q_snapshot_diff(spark, d):
    """What changed between two captures (E5, G1)."""
    return diff.record_diff(_day(spark, d, "2024-01-10"), _day(spark, d, "2024-01-11"), ["event_type"], "user_id", "content")


@query("""
WITH e AS (SELECT event_type, date_trunc('hour', ts) AS h, user_id, floor(value / 50)::BIGINT AS content FROM events),
n AS (SELECT event_type, h, user_id, count(*) AS n, min(content) AS c FROM e GROUP BY ALL),
cur AS (SELECT * FROM n), prev AS (SELECT event_type, h + INTERVAL 1 HOUR AS h, user_id, n, c FROM n WHERE (event_type, h + INTERVAL 1 HOUR) IN (SELECT event_type, h FROM n)),
unsure AS (SELECT DISTINCT event_type, h FROM (SELECT * FROM cur UNION ALL SELECT * FROM prev) WHERE n > 1),
j AS (SELECT coalesce(cur.event_type, prev.event_type) AS event_type, coalesce(cur.h, prev.h) AS h, coalesce(cur.user_id, prev.user_id) AS user_id, cur.n AS cn, prev.n AS pn, cur.c AS cc, prev.c AS pc
  FROM cur FULL JOIN prev ON cur.event_type = prev.event_type AND cur.h = prev.h AND cur.user_id = prev.user_id)
SELECT j.event_type, strftime(j.h, '%Y-%m-%d %H') AS hour, user_id, CASE WHEN cn IS NOT NULL AND (cn > 1 OR coalesce(pn, 1) > 1) THEN 'IDENTITY_UNCERTAIN' WHEN cn IS NULL THEN 'MISSING_OBSERVED' WHEN pn IS NULL THEN 'NEW' WHEN cc = pc THEN 'UNCHANGED' ELSE 'UPDATED' END AS change, coalesce(cn, 1) AS rows
FROM j LEFT JOIN unsure u ON u.event_type = j.event_type AND u.h = j.h WHERE NOT (cn IS NULL AND u.h IS NOT NULL)
""")
def q_snapshot_diff_raw(spark, d):
    """Changes from hour to hour, with identities that occur more than once (G1)."""
    events = table(spark, d, "events").select("event_type", F.date_trunc("hour", "ts").alias("h"), "user_id", F.floor(F.col("value") / 50).cast("long").alias("content"))
    hours = events.select("event_type", "h").distinct()
    before = events.withColumn("h", F.expr("h + INTERVAL 1 HOUR")).join(hours, ["event_type", "h"], "left_semi")
    out = diff.record_diff(before, events, ["event_type", "h"], "user_id", "content")
    return out.select("event_type", F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "user_id", "change", "rows")


@query("""
WITH p AS (SELECT user_id, event_id, ts, event_type, md5(event_type || floor(value / 20)::BIGINT) AS h FROM events)
SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'CURRENT_UNAVAILABLE' WHEN b IS NULL THEN 'NO_PREVIOUS' WHEN b = h THEN 'UNCHANGED' ELSE 'CHANGED' END AS change
FROM (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN h END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p)
""")
def q_page_diff(spark, d):
    """Each page against the last one that was there."""
    events = table(spark, d, "events").withColumn("h", F.md5(F.concat("event_type", F.floor(F.col("value") / 20).cast("long"))))
    return diff.page_diff(events, ["user_id"], ["ts", "event_id"], "h", F.col("event_type") == "error").select("user_id", "event_id", "change")


@query("""
WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS k FROM events GROUP BY ALL), r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY k) AS revision FROM f)
SELECT user_id, event_id, revision::INTEGER AS revision FROM events JOIN r USING (user_id, event_type)
""")
def q_version_any(spark, d):
    """Revisions where content seen before takes its old one again (H4, H6, H8)."""
    return versioning.versions_any(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_id", "revision")


@query("""
SELECT user_id, event_id, (sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS revision FROM (
  SELECT user_id, event_id, ts, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM events)
""")
def q_version_latest(spark, d):
    """Revisions where only the row before counts."""
    return versioning.versions_latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_id", "revision")


@query("""
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders
""")
def q_supersedes(spark, d):
    """Each revision and the one before (H9)."""
    return versioning.superseding(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, lag(l_linenumber) OVER x AS b, lag(l_returnflag) OVER x AS f FROM lineitem WINDOW x AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag NULLS FIRST))
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b IS NULL THEN 'GAP' WHEN b = l_linenumber THEN 'DUPLICATE' WHEN l_linenumber <> b + 1 THEN 'GAP' ELSE 'NO_OP' END AS reason
FROM w WHERE (b IS NULL AND l_linenumber <> 1) OR b = l_linenumber OR l_linenumber <> b + 1 OR (b IS NOT NULL AND f = l_returnflag)
""")
def q_chain_breaks(spark, d):
    """Rows that break a chain of revisions."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    lines = versioning.superseding(lines, ["l_orderkey"], "l_partkey", ["l_linenumber", "l_partkey", "l_returnflag"])
    return versioning.chain_breaks(lines, ["l_orderkey"], "l_linenumber", "l_returnflag", "supersedes", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "reason")


@query("""
SELECT l_orderkey, count(DISTINCT l_linestatus) AS n_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1
""")
def q_conflict(spark, d):
    """Keys whose rows disagree in what has to be one value."""
    return versioning.one_value(table(spark, d, "lineitem").select("l_orderkey", "l_linestatus"), ["l_orderkey"], "l_linestatus")


@query("""
SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1
""")
def q_first_wins(spark, d):
    """The first row of each key (H2)."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", (-F.col("n_chars")).alias("o"))
    return versioning.first_wins(docs, ["source"], ["o", "doc_id"]).drop("o")


@query("""
SELECT source, doc_id, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) = 1
""")
def q_shortest(spark, d):
    """The shortest text of each key (H3)."""
    return versioning.shortest(table(spark, d, "documents").select("source", "doc_id", "text"), ["source"], "text", ["doc_id"]).select("source", "doc_id", F.length("text").cast("long").alias("n"))


@query("""
WITH b AS (SELECT *, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM events),
g AS (SELECT *, sum(ok) OVER w AS good, sum(1 - ok) OVER w AS bad FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, CASE WHEN ok = 1 THEN sum(ok) OVER (PARTITION BY user_id, bad ORDER BY ts, event_id) ELSE 0 END AS cs, CASE WHEN ok = 0 THEN sum(1 - ok) OVER (PARTITION BY user_id, good ORDER BY ts, event_id) ELSE 0 END AS cf,
  last_value(CASE WHEN ok = 1 THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lh FROM g)
SELECT user_id, event_id, cs::INTEGER AS consecutive_success, cf::INTEGER AS consecutive_failure, lh AS last_hash, CASE WHEN value > 200 THEN 'REVIEW_REQUIRED' WHEN ok = 1 THEN 'HEALTHY' WHEN cf >= 2 THEN 'FAILED' ELSE 'DEGRADED' END AS status FROM h
""")
def q_health(spark, d):
    """Health of each source after each run (M1)."""
    runs = table(spark, d, "events")
    out = ledger.source_health(runs, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", "props", F.col("value") > 200)
    return out.select("user_id", "event_id", "consecutive_success", "consecutive_failure", "last_hash", "status")


@query("""
WITH grid AS (SELECT u.user_id, CAST(day AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS day)),
o AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'),
g AS (SELECT grid.*, day(grid.day) % 7 <> 0 AS counts, o.day IS NOT NULL AS seen FROM grid LEFT JOIN o ON o.user_id = grid.user_id AND o.day = grid.day),
i AS (SELECT *, sum(CASE WHEN counts AND seen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS isl FROM g)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, (sum(CASE WHEN counts AND NOT seen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY day))::INTEGER AS streak, counts AND NOT seen AS missing_event FROM i
""")
def q_missing_streak(spark, d):
    """Runs in a row that missed a record."""
    events = table(spark, d, "events")
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    grid = events.select("user_id").distinct().select("user_id", F.explode(days).alias("day"))
    seen = events.where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day"), F.lit(True).alias("seen")).distinct()
    grid = grid.join(seen, ["user_id", "day"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    out = diff.missing_streaks(grid, ["user_id"], ["day"], F.dayofmonth("day") % 7 != 0, F.col("seen"))
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "streak", "missing_event")


@query("""
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS snapshots, count_if(event_type = 'error') AS failed, count_if(value > 150) AS big, bool_and(event_type = 'view') AS same, count(DISTINCT CASE WHEN event_type IN ('click', 'purchase') THEN event_id END) AS observed FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN failed > 1 THEN 'FAILED' WHEN big > 0 THEN 'PARTIAL' WHEN same THEN 'NOT_MODIFIED' WHEN observed > 0 THEN 'SUCCESS' WHEN snapshots % 2 = 0 THEN 'CONFIRMED_EMPTY' ELSE 'SUSPICIOUS_EMPTY' END AS status,
  CASE WHEN snapshots % 3 = 0 THEN 'ZERO_RESULT_REQUIRES_VALIDATION' ELSE array_to_string(list_filter([CASE WHEN snapshots % 2 <> 0 THEN 'EMPTY_PAGINATION_INCOMPLETE' END, CASE WHEN failed > 0 THEN 'EMPTY_ERROR_PAGE_DETECTED' END, CASE WHEN big > 0 THEN 'EMPTY_HISTORY_ANOMALOUS' END], lambda x: x IS NOT NULL), ',') END AS reasons
FROM r
""")
def q_run_status(spark, d):
    """Judgement of each run and what keeps an empty one from being proven."""
    e = table(spark, d, "events")
    c = F.col
    runs = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("snapshots"), F.count_if(c("event_type") == "error").alias("failed"), F.count_if(c("value") > 150).alias("big"),
        F.min((c("event_type") == "view").cast("int")).alias("same"), F.count_if(c("event_type").isin("click", "purchase")).alias("observed"))
    proof = F.struct(
        F.lit(True).alias("response_structure_valid"), (c("snapshots") % 2 == 0).alias("pagination_complete"), F.lit(True).alias("explicit_empty_signal"), F.lit(0).alias("official_result_count"),
        F.lit(False).alias("authentication_wall_detected"), F.lit(False).alias("captcha_detected"), (c("failed") > 0).alias("error_page_detected"), F.lit(False).alias("structure_drift_detected"),
        F.when(c("big") > 0, "ANOMALOUS").otherwise("CONSISTENT").alias("historical_comparison"))
    runs = runs.withColumn("proof", F.when(c("snapshots") % 3 != 0, proof))
    even = F.when(c("snapshots") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("EMPTY_PAGINATION_INCOMPLETE")))
    status = diff.run_status(c("snapshots"), F.when(c("failed") > 1, 1).otherwise(0), F.when(c("big") > 0, "PARTIAL").otherwise("COMPLETE"), c("same") == 1, c("observed"), even)
    return runs.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), status.alias("status"), F.array_join(diff.empty_reasons("proof"), ",").alias("reasons"))


@query("""
WITH RECURSIVE k AS (SELECT user_id, min((ts, event_id)) AS e FROM events GROUP BY user_id),
g AS (SELECT user_id, e FROM k UNION ALL SELECT g.user_id, min((x.ts, x.event_id)) AS e FROM g JOIN events x ON x.user_id = g.user_id AND x.ts >= struct_extract(g.e, 1) + INTERVAL 6 HOUR GROUP BY g.user_id)
SELECT user_id, struct_extract(e, 2) AS event_id FROM g
""")
def q_cadence_gate(spark, d):
    """Events at least six hours after the last one that passed (M3)."""
    return ledger.cadence_gate(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 6 * 3600).select("user_id", "event_id")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, sha256(o_orderkey || '|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS h FROM orders)
SELECT o_custkey, o_orderkey, (row_number() OVER w)::INTEGER AS sequence, h AS record_hash, coalesce(lag(h) OVER w, repeat('0', 64)) AS previous_hash FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def q_hash_chain(spark, d):
    """A hash chain for each stream."""
    payload = F.concat_ws("|", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = ledger.chained(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], payload)
    return out.select("o_custkey", "o_orderkey", "sequence", "record_hash", "previous_hash")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, 'SEQUENCE' AS fault FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, sha256(l_partkey::VARCHAR)) AS n FROM lineitem) WHERE n <> l_linenumber
""")
def q_chain_faults(spark, d):
    """Gaps in numbered streams (M6, M7)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("h", F.sha2(F.col("l_partkey").cast("string"), 256))
    from pyspark.sql import Window

    before = F.coalesce(F.lag("h").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "h")), F.lit("0" * 64))
    return ledger.chain_faults(lines.withColumn("p", before), ["l_orderkey"], "l_linenumber", "h", "p").select("l_orderkey", "l_linenumber", "l_partkey", "fault")


@query("""
WITH s AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS batch, CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'NOT_MODIFIED' WHEN 'purchase' THEN 'CONFIRMED_EMPTY' WHEN 'error' THEN 'FAILED' END AS status, CASE WHEN event_type = 'signup' THEN CASE WHEN value > 100 THEN 'GRANT_REVOKED' ELSE 'CADENCE_DENIED' END END AS deferred FROM events),
g AS (SELECT batch, count(status) AS ran, count_if(status IN ('SUCCESS', 'NOT_MODIFIED', 'CONFIRMED_EMPTY')) AS ok, count(deferred) AS held, count(*) FILTER (deferred <> 'CADENCE_DENIED') AS blocked FROM s GROUP BY batch)
SELECT batch, CASE WHEN ran = 0 AND held > 0 AND blocked = 0 THEN 'DEFERRED' WHEN ok = ran AND blocked = 0 AND ok > 0 THEN 'SUCCESS' WHEN ok > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM g
""")
def q_batch_status(spark, d):
    """The outcome of each batch of runs."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "SUCCESS").when(F.col("event_type") == "view", "NOT_MODIFIED").when(F.col("event_type") == "purchase", "CONFIRMED_EMPTY").when(F.col("event_type") == "error", "FAILED")
    deferred = F.when(F.col("event_type") == "signup", F.when(F.col("value") > 100, "GRANT_REVOKED").otherwise("CADENCE_DENIED"))
    rows = e.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("batch"), status.alias("status"), deferred.alias("deferred"))
    return ledger.batch_status(rows, "batch", "status", "deferred")


@query("""
WITH a AS (SELECT user_id, date_trunc('day', ts) AS r, (row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id)) AS p, event_type, floor(value / 100)::BIGINT AS h FROM events),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.r, b.r) AS r, CASE WHEN a.event_type = b.event_type AND a.h = b.h THEN 1 ELSE 0 END AS same, a.p AS now FROM a FULL JOIN (SELECT user_id, r + INTERVAL 1 DAY AS r, p, event_type, h FROM a) b ON a.user_id = b.user_id AND a.r = b.r AND a.p = b.p)
SELECT user_id || '/' || strftime(r, '%Y-%m-%d') AS run, CASE WHEN min(same) = 1 AND count(now) > 0 THEN 'NOT_MODIFIED' ELSE 'MODIFIED' END AS status FROM j GROUP BY user_id, r
""")
def q_acquisition(spark, d):
    """Runs all of whose pages are as they were in the run before."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    pages = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), place.alias("p"), "event_type", F.floor(F.col("value") / 100).cast("long").alias("h"))
    run = lambda day: F.concat_ws("/", "user_id", F.date_format(day, "yyyy-MM-dd")).alias("run")
    return diff.acquisition(pages.select(run("day"), "p", "event_type", "h"), pages.select(run(F.date_add("day", 1)), "p", "event_type", "h"), "run", "p", "event_type", "h")


@query("""
SELECT o_custkey, sha256('[' || string_agg('"' || x || '"', ',' ORDER BY x) || ']') AS set_hash FROM (SELECT o_custkey, sha256(o_orderkey::VARCHAR) AS x FROM orders) GROUP BY o_custkey
""")
def q_set_hash(spark, d):
    """A hash of each group's members, whatever their order."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(canon.set_hash(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("set_hash"))


@query("""
SELECT user_id, b AS budget, used, cap FROM (SELECT user_id, unnest(['requests', 'types', 'bytes']) AS b, unnest([count(*), count(DISTINCT event_type), sum(floor(value)::BIGINT)::BIGINT]) AS used, unnest([70, 4, 3000]::BIGINT[]) AS cap FROM events GROUP BY user_id) WHERE used > cap
""")
def q_budget(spark, d):
    """Use beyond a cap."""
    use = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("requests"), F.countDistinct("event_type").alias("types"), F.sum(F.floor("value")).alias("bytes"))
    return ledger.budget_faults(use, "user_id", {"requests": 70, "types": 4, "bytes": 3000})


#: Events of which one key has half.
HOT = "CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END"


@query(f"""
WITH b AS (SELECT {HOT} AS source, event_id, ts, props, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok, value FROM events),
g AS (SELECT *, sum(ok) OVER w AS good, sum(1 - ok) OVER w AS bad FROM b WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)),
h AS (SELECT *, CASE WHEN ok = 1 THEN sum(ok) OVER (PARTITION BY source, bad ORDER BY ts, event_id) ELSE 0 END AS cs, CASE WHEN ok = 0 THEN sum(1 - ok) OVER (PARTITION BY source, good ORDER BY ts, event_id) ELSE 0 END AS cf,
  last_value(CASE WHEN ok = 1 THEN props END IGNORE NULLS) OVER (PARTITION BY source ORDER BY ts, event_id) AS lh FROM g)
SELECT source, event_id, cs::INTEGER AS consecutive_success, cf::INTEGER AS consecutive_failure, lh AS last_hash, CASE WHEN value > 200 THEN 'REVIEW_REQUIRED' WHEN ok = 1 THEN 'HEALTHY' WHEN cf >= 2 THEN 'FAILED' ELSE 'DEGRADED' END AS status FROM h
""")
def q_hot_health(spark, d):
    """Health where one source has half of all runs (M1)."""
    runs = table(spark, d, "events").withColumn("source", F.expr(HOT))
    out = ledger.source_health(runs, ["source"], ["ts", "event_id"], F.col("event_type") != "error", "props", F.col("value") > 200, pieces=12)
    return out.select("source", "event_id", "consecutive_success", "consecutive_failure", "last_hash", "status")


@query(f"""
WITH e AS (SELECT {HOT} AS record, event_id, ts, event_type, value > 20 AS counts FROM events),
i AS (SELECT *, sum(CASE WHEN counts AND event_type = 'view' THEN 1 ELSE 0 END) OVER w AS isl, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY record ORDER BY ts, event_id))
SELECT record, event_id, (sum(CASE WHEN counts AND event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY record, isl ORDER BY ts, event_id))::INTEGER AS streak, counts AND event_type <> 'view' AS missing_event,
  (sum(c) OVER (PARTITION BY record ORDER BY ts, event_id))::INTEGER AS revision FROM i
""")
def q_hot_streaks(spark, d):
    """Missing streaks and revisions where one record has half of all runs."""
    runs = table(spark, d, "events").select(F.expr(HOT).alias("record"), "event_id", "ts", "event_type", "value")
    out = diff.missing_streaks(runs, ["record"], ["ts", "event_id"], F.col("value") > 20, F.col("event_type") == "view", pieces=12)
    out = versioning.versions_latest(out, ["record"], "event_type", ["ts", "event_id"], pieces=12)
    return out.select("record", "event_id", "streak", "missing_event", "revision")


@query("""
WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS id, event_type AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 4 // 10 - event_id % 2 * (event_id % 3) // 2 END AS seen FROM events),
s(k, id, n, outcome, head, content) AS (
  SELECT DISTINCT k, NULL::BIGINT, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR FROM e
  UNION ALL
  SELECT k, id, n, outcome, CASE WHEN outcome = 'ISSUED' THEN head + 1 ELSE head END, CASE WHEN outcome = 'ISSUED' THEN new ELSE content END
  FROM (SELECT e.k, e.id, e.n, e.content AS new, s.head, s.content, CASE WHEN e.seen IS NULL THEN 'LACKS_HEAD' WHEN greatest(e.seen, 0) <> s.head THEN 'STALE' WHEN s.head > 0 AND e.content = s.content THEN 'SAME' ELSE 'ISSUED' END AS outcome FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1))
SELECT k, id, outcome, CASE WHEN outcome IN ('ISSUED', 'SAME') THEN head END::INTEGER AS revision, head::INTEGER AS head FROM s WHERE n > 0
""")
def q_expected_heads(spark, d):
    """Decisions of many writers, each against the head that it has seen: won, lost and repeated ones."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), F.col("event_type").alias("content"), n.alias("n"))
    seen = F.expr("CASE WHEN id % 13 <> 0 THEN CAST(greatest((n - 1) * 4 div 10 - (id % 2) * (id % 3) div 2, 0) AS INT) END")
    return folds.expected_heads(e.withColumn("seen", seen), "k", ["n"], "seen", "content").select("k", "id", "outcome", "revision", "head")


_JOURNAL = """
j AS (SELECT (o_custkey % 5)::VARCHAR AS stream, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS sequence, sha256(o_orderkey::VARCHAR) AS record_hash, o_orderkey, o_orderpriority FROM orders),
a AS (SELECT stream, sequence AS first_sequence, '{"artifact_id":"' || o_orderkey || '","artifact_type":"' || o_orderpriority || '","seal":"' || sha256('s' || o_orderkey) || '"}' AS entry FROM j),
c AS (SELECT stream, sequence, lag(sequence) OVER (PARTITION BY stream ORDER BY sequence) AS before FROM (SELECT DISTINCT stream, 0 AS sequence FROM j WHERE stream <> '4' UNION ALL SELECT stream, sequence FROM j WHERE sequence % 90 = 0 OR sequence % 411 = 0))"""


@query(f"""
WITH {_JOURNAL},
r AS (SELECT c.stream, c.sequence, count(entry) AS n, sha256('[' || coalesce(string_agg(entry, ',' ORDER BY entry), '') || ']') AS h FROM c LEFT JOIN a ON a.stream = c.stream AND a.first_sequence <= c.sequence AND a.first_sequence > coalesce(c.before, -1) GROUP BY ALL)
SELECT c.stream, c.sequence, r.n AS artifacts, r.h AS set_hash, concat_ws(',', CASE WHEN c.before IS NULL AND c.sequence <> 0 THEN 'GENESIS' END, CASE WHEN c.before IS NOT NULL AND c.sequence % 7 = 1 THEN 'CHAIN' END,
  CASE WHEN c.before IS NOT NULL AND c.sequence % 7 = 2 THEN 'HEAD' END, CASE WHEN c.before IS NOT NULL AND c.sequence % 7 = 3 THEN 'ARTIFACT_SET' END) AS faults
FROM c JOIN r ON r.stream = c.stream AND r.sequence = c.sequence
""")
def q_checkpoint_faults(spark, d):
    """Checkpoints against the journal rows and artifacts that they cover, some of them damaged (M7)."""
    from pyspark.sql import Window

    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 5).cast("string").alias("stream"))
    # numbered by pieces and written once: streams are few, and rows, artifacts and checkpoints all read it
    j = stored(scanned(pieced(orders, ["stream"], ["o_orderkey"]), ["stream"], [running_sum("sequence", F.lit(1))]), "journal")
    rows = j.select("stream", "sequence", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("record_hash"))
    artifacts = j.select("stream", F.col("sequence").alias("first_sequence"), F.col("o_orderpriority").alias("artifact_type"), F.col("o_orderkey").cast("string").alias("artifact_id"), F.sha2(F.concat(F.lit("s"), "o_orderkey"), 256).alias("seal"))
    marks = rows.where("sequence % 90 = 0 OR sequence % 411 = 0").select("stream", "sequence", F.col("record_hash").alias("head_hash"))
    marks = marks.unionByName(rows.where("stream <> '4'").select("stream").distinct().select("stream", F.lit(0).cast("long").alias("sequence"), F.lit(journal.ZEROS).alias("head_hash")))
    # what a signer would have written, then the damage
    w = Window.partitionBy("stream").orderBy("sequence")
    marks = marks.withColumn("checkpoint_hash", F.sha2(F.concat_ws(":", "stream", "sequence"), 256)).withColumn("previous_checkpoint_hash", F.lag("checkpoint_hash").over(w))
    entry = F.to_json(F.struct("artifact_id", "artifact_type", "seal"))
    entries = F.array_join(F.array_sort(F.collect_list(entry)), ",")
    signed = journal.covered(artifacts, marks).where("covers IS NOT NULL").groupBy("stream", F.col("covers").alias("sequence")).agg(F.sha2(F.concat(F.lit("["), entries, F.lit("]")), 256).alias("artifact_set_hash"))
    marks = stored(marks.join(merged(signed), ["stream", "sequence"], "left").withColumn("artifact_set_hash", F.coalesce("artifact_set_hash", F.lit(journal.EMPTY))), "checkpoints")
    bad = lambda c, k: F.when((F.col("sequence") % 7 == k) & (F.col("sequence") > 0), "damaged").otherwise(F.col(c)).alias(c)
    marks = marks.select("stream", "sequence", bad("head_hash", 2), bad("artifact_set_hash", 3), "checkpoint_hash", bad("previous_checkpoint_hash", 1))
    out = journal.checkpoint_faults(marks, rows, artifacts)
    return out.select("stream", F.col("sequence").cast("long").alias("sequence"), "artifacts", "set_hash", F.array_join("faults", ",").alias("faults"))
