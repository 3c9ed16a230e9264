"""Schedules, grants and budgets by replay; gates, sources and resolution over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import postings, text as tx
from ..functions.canon import canonical_json, same_set
from ..operators import diff, folds, gates, query as q, resolve, summary
from .tables import query, table

_STEPS = """e AS (SELECT user_id AS k, event_id AS id, floor(epoch(ts))::BIGINT AS sec, event_type AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


@query(f"""
WITH RECURSIVE {_STEPS},
ev AS (SELECT k, id, n, sec, v > 90 AS risk, v > 5 AS eligible, CASE WHEN n = 1 THEN 'REGISTER' WHEN t = 'signup' THEN 'PAUSE' WHEN t = 'purchase' THEN 'COMPLETE' WHEN t = 'error' THEN 'RECONCILE' WHEN n % 11 = 0 THEN 'REGISTER' ELSE 'CLAIM' END AS kind, 'r' || (n // 3) AS run, v > 40 AS success FROM e),
s(k, id, n, fault, status, nxt, failures, open, used) AS (
  SELECT k, id, n, CASE WHEN eligible THEN NULL ELSE 'NOT_ELIGIBLE' END, CASE WHEN eligible THEN 'ACTIVE' END, CASE WHEN eligible THEN sec END, CASE WHEN eligible THEN 0 END, NULL::VARCHAR, []::VARCHAR[] FROM ev WHERE n = 1
  UNION ALL
  SELECT k, id, n, fault,
    CASE WHEN fault IS NOT NULL THEN status WHEN kind = 'REGISTER' THEN 'ACTIVE' WHEN kind = 'COMPLETE' THEN CASE WHEN risk THEN 'REVIEW_REQUIRED' ELSE 'ACTIVE' END WHEN kind = 'RECONCILE' AND NOT eligible THEN 'REVIEW_REQUIRED' WHEN kind = 'PAUSE' THEN 'PAUSED' ELSE status END,
    CASE WHEN fault IS NOT NULL THEN nxt WHEN kind = 'REGISTER' THEN sec WHEN kind = 'COMPLETE' THEN sec + 7200 ELSE nxt END,
    CASE WHEN fault IS NOT NULL THEN failures WHEN kind = 'REGISTER' THEN 0 WHEN kind = 'COMPLETE' THEN CASE WHEN success THEN 0 ELSE failures + 1 END ELSE failures END,
    CASE WHEN fault IS NOT NULL THEN open WHEN kind = 'CLAIM' THEN run WHEN kind = 'COMPLETE' THEN NULL ELSE open END, CASE WHEN fault IS NULL AND kind = 'CLAIM' THEN list_append(used, run) ELSE used END
  FROM (SELECT ev.*, s.status, s.nxt, s.failures, s.open, s.used, CASE WHEN kind = 'REGISTER' THEN CASE WHEN s.status IS NOT NULL THEN 'EXISTS' WHEN NOT eligible THEN 'NOT_ELIGIBLE' END WHEN s.status IS NULL THEN 'UNKNOWN'
      WHEN kind = 'CLAIM' THEN CASE WHEN NOT eligible THEN 'NOT_ELIGIBLE' WHEN s.status <> 'ACTIVE' THEN 'NOT_ACTIVE' WHEN s.open IS NOT NULL THEN 'RUN_OPEN' WHEN sec < s.nxt THEN 'NOT_DUE' WHEN list_contains(s.used, run) THEN 'RUN_USED' END
      WHEN kind = 'COMPLETE' THEN CASE WHEN s.open IS NULL OR s.open <> run THEN 'RUN_NOT_ISSUED' END END AS fault FROM s JOIN ev ON ev.k = s.k AND ev.n = s.n + 1))
SELECT k, id, fault, status, nxt AS next_run, failures::INTEGER AS failures FROM s
""")
def q_schedules(spark, d):
    """Schedules by replay of their events (M2)."""
    return folds.schedules(schedule_events(spark, d), "k", ["n"], 7200).select("k", "id", "fault", "status", "next_run", "failures")


def schedule_events(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("n", n)
    kind = F.when(F.col("n") == 1, "REGISTER").when(F.col("event_type") == "signup", "PAUSE").when(F.col("event_type") == "purchase", "COMPLETE").when(F.col("event_type") == "error", "RECONCILE").when(F.col("n") % 11 == 0, "REGISTER").otherwise("CLAIM")
    return e.select(
        F.col("user_id").alias("k"), F.col("event_id").alias("id"), "n", kind.alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.concat(F.lit("r"), F.floor(F.col("n") / 3)).alias("run"),
        (F.col("value") > 40).alias("success"), (F.col("value") > 90).alias("risk"), (F.col("value") > 5).alias("eligible"))


@query(f"""
WITH RECURSIVE {_STEPS},
ev AS (SELECT k, id, n, sec, CASE WHEN n = 1 OR t = 'signup' THEN 'GRANT' WHEN t = 'error' THEN 'COMPLETE' WHEN n % 37 = 0 THEN 'REVOKE' ELSE 'RESERVE' END AS kind, 'h' || (n // 20) AS content, 'a' || (n // 6) AS attempt, CASE WHEN v > 80 THEN 'other' ELSE 'me' END AS holder FROM e),
s(k, id, n, fault, content, version, effective, revoked, open, open_at, holder, attempts, closed, last) AS (
  SELECT k, id, n, NULL::VARCHAR, content, 1, sec + 60, false, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[], NULL::BIGINT, NULL::BIGINT FROM ev WHERE n = 1
  UNION ALL
  SELECT k, id, n, fault, CASE WHEN ok AND kind = 'GRANT' THEN new_content ELSE content END, CASE WHEN ok AND kind = 'GRANT' THEN version + 1 ELSE version END, CASE WHEN ok AND kind = 'GRANT' THEN sec + 60 ELSE effective END, revoked OR (ok AND kind = 'REVOKE'),
    CASE WHEN ok AND kind = 'RESERVE' THEN attempt WHEN ok AND kind = 'COMPLETE' THEN NULL ELSE open END, CASE WHEN ok AND kind = 'RESERVE' THEN sec ELSE open_at END, CASE WHEN ok AND kind = 'RESERVE' THEN new_holder ELSE holder END,
    CASE WHEN ok AND kind = 'RESERVE' THEN list_append(attempts, attempt) ELSE attempts END, CASE WHEN ok AND kind = 'COMPLETE' THEN sec ELSE closed END, CASE WHEN ok AND kind <> 'GRANT' THEN sec ELSE last END
  FROM (SELECT *, fault IS NULL AS ok FROM (SELECT ev.k, ev.id, ev.n, ev.sec, ev.kind, ev.content AS new_content, ev.attempt, ev.holder AS new_holder, s.content, s.version, s.effective, s.revoked, s.open, s.open_at, s.holder, s.attempts, s.closed, s.last,
      CASE kind WHEN 'GRANT' THEN CASE WHEN s.revoked THEN 'AUTHORIZATION_REVOKED' WHEN s.content = ev.content THEN 'COLLISION' WHEN s.open IS NOT NULL THEN 'PENDING_GATE_DENIED' END
        WHEN 'REVOKE' THEN CASE WHEN s.revoked THEN 'COLLISION' WHEN s.open IS NOT NULL THEN 'PENDING_GATE_DENIED' END
        WHEN 'RESERVE' THEN CASE WHEN s.revoked THEN 'AUTHORIZATION_REVOKED' WHEN ev.sec < s.last THEN 'CLOCK_INVALID' WHEN ev.sec < s.effective THEN 'AUTHORIZATION_NOT_EFFECTIVE' WHEN s.open IS NOT NULL THEN 'PENDING_GATE_DENIED' WHEN list_contains(s.attempts, ev.attempt) THEN 'ATTEMPT_ALREADY_USED' WHEN ev.sec < s.closed + 3600 THEN 'CADENCE_EXCEEDED' END
        ELSE CASE WHEN s.open IS NULL OR s.open <> ev.attempt OR s.holder <> ev.holder THEN 'GATE_HOLDER_MISMATCH' WHEN ev.sec < s.open_at THEN 'CLOCK_INVALID' END END AS fault
      FROM s JOIN ev ON ev.k = s.k AND ev.n = s.n + 1)))
SELECT k, id, fault, version::INTEGER AS version FROM s
""")
def q_grant_ledger(spark, d):
    """A ledger of grants by replay (M4)."""
    return folds.grant_ledger(grant_records(spark, d), "k", ["n"]).select("k", "id", "fault", "version")


def grant_records(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("n", n)
    kind = F.when((F.col("n") == 1) | (F.col("event_type") == "signup"), "GRANT").when(F.col("event_type") == "error", "COMPLETE").when(F.col("n") % 37 == 0, "REVOKE").otherwise("RESERVE")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("k"), F.col("event_id").alias("id"), "n", kind.alias("kind"), F.lit("one").alias("authorization"), F.concat(F.lit("h"), F.floor(F.col("n") / 20)).alias("content"), (at + 60).alias("effective"), F.lit(3600).alias("interval_s"),
        F.concat(F.lit("a"), F.floor(F.col("n") / 6)).alias("attempt"), F.when(F.col("value") > 80, "other").otherwise("me").alias("holder"), F.lit("t").alias("target"), at.alias("at"), F.lit("SUCCESS").alias("outcome"))


BUDGET_SQL = f"""
WITH RECURSIVE {_STEPS},
ev AS (SELECT k, id, n, sec, CASE (n - 1) % 4 WHEN 1 THEN 'SENT' WHEN 2 THEN 'OBSERVE' ELSE 'RESERVE' END AS kind, CASE WHEN (n - 1) % 4 = 3 THEN 'x' || (n - 1) ELSE 'i' || ((n - 1) // 4) END AS intent, 'o' || ((n - 1) // 4) % 3 AS org, 'u' || ((n - 1) // 4) % 5 AS target,
  CASE WHEN t = 'error' THEN 'NETWORK_FAILURE' ELSE 'SUCCESS' END AS status, (v * 10)::DECIMAL(38, 6) AS raw FROM e),
s(k, id, n, fault, used, req) AS (
  SELECT DISTINCT k, NULL::BIGINT, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, []::STRUCT(i VARCHAR, o VARCHAR, t VARCHAR, w BIGINT, sent BOOLEAN, done BIGINT, st VARCHAR)[] FROM ev
  UNION ALL
  SELECT k, id, n, fault, CASE WHEN fault IS NULL AND kind = 'OBSERVE' THEN used + size ELSE used END,
    CASE WHEN fault IS NOT NULL THEN req WHEN kind = 'RESERVE' THEN list_append(req, {{'i': intent, 'o': org, 't': target, 'w': sec, 'sent': false, 'done': NULL, 'st': NULL}})
      WHEN kind = 'SENT' THEN list_transform(req, lambda r: CASE WHEN r.i = intent THEN {{'i': r.i, 'o': r.o, 't': r.t, 'w': r.w, 'sent': true, 'done': r.done, 'st': r.st}} ELSE r END)
      ELSE list_transform(req, lambda r: CASE WHEN r.i = intent THEN {{'i': r.i, 'o': r.o, 't': r.t, 'w': r.w, 'sent': r.sent, 'done': sec, 'st': status}} ELSE r END) END
  FROM (SELECT *, CASE kind WHEN 'RESERVE' THEN CASE WHEN known IS NOT NULL THEN 'INTENT_USED' WHEN len(list_filter(req, lambda r: r.done IS NULL)) > 0 THEN 'UNRESOLVED_RESERVATION'
      WHEN last IS NOT NULL AND sec - last.done < CASE WHEN last.st = 'NETWORK_FAILURE' THEN 86400 ELSE 3600 END THEN 'COOLDOWN'
      WHEN len(req) >= 8 OR len(list_distinct(list_append(list_transform(req, lambda r: r.o), org))) > 3 OR len(list_distinct(list_append(list_transform(list_filter(req, lambda r: r.o = org), lambda r: r.t), target))) > 4 OR len(list_filter(req, lambda r: r.t = target)) > 2 THEN 'BUDGET_EXHAUSTED' END
    WHEN 'SENT' THEN CASE WHEN known IS NULL OR known.sent OR known.done IS NOT NULL OR sec < known.w THEN 'SEND_INVALID' END
    ELSE CASE WHEN known IS NULL OR known.done IS NOT NULL OR sec < known.w OR NOT known.sent OR size NOT BETWEEN 0 AND 900 OR used + size > 4000 THEN 'OBSERVATION_DENIED' END END AS fault
    FROM (SELECT ev.k, ev.id, ev.n, ev.sec, ev.kind, ev.intent, ev.org, ev.target, ev.status, trunc(ev.raw)::BIGINT AS size, s.used, s.req, list_filter(s.req, lambda r: r.i = ev.intent)[1] AS known,
      list_reverse_sort(list_filter(list_transform(s.req, lambda r: CASE WHEN r.o = ev.org AND r.t = ev.target AND r.done IS NOT NULL THEN {{'done': r.done, 'st': r.st}} END), lambda r: r IS NOT NULL))[1] AS last
      FROM s JOIN ev ON ev.k = s.k AND ev.n = s.n + 1)))
SELECT k, id, fault, used AS used_bytes FROM s WHERE n > 0
"""


@query(BUDGET_SQL)
def q_request_budget(spark, d):
    """Requests against the caps of a budget, event by event."""
    return folds.request_budget(budget_events(spark, d), "k", ["n"], *CAPS).select("k", "id", "fault", "used_bytes")


#: Requests, organizations, targets of one, bytes, bytes of a response, tries of a target, seconds between two of them and after a failure.
CAPS = (8, 3, 4, 4000, 900, 2, 3600, 86400)


def budget_events(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("n", n - 1)
    kind = F.element_at(F.array(F.lit("RESERVE"), F.lit("SENT"), F.lit("OBSERVE"), F.lit("RESERVE")), (F.col("n") % 4 + 1).cast("int"))
    intent = F.when(F.col("n") % 4 == 3, F.concat(F.lit("x"), "n")).otherwise(F.concat(F.lit("i"), F.floor(F.col("n") / 4)))
    return e.select(
        F.col("user_id").alias("k"), F.col("event_id").alias("id"), "n", kind.alias("kind"), intent.alias("intent"), F.concat(F.lit("o"), F.floor(F.col("n") / 4) % 3).alias("organization"), F.concat(F.lit("u"), F.floor(F.col("n") / 4) % 5).alias("target"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") == "error", "NETWORK_FAILURE").otherwise("SUCCESS").alias("status"), (F.col("value") * 10).cast("long").alias("bytes"))


@query("""
WITH g AS (SELECT o_custkey AS a, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS b, max(o_orderkey) AS v, arg_max(epoch(o_orderdate)::BIGINT, o_orderkey) AS e FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority AS t, max(epoch(o_orderdate)::BIGINT) AS at FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
x AS (SELECT a, e, c.at AS closed, a % 7 = 0 AS pending FROM g LEFT JOIN c ON c.t = g.b WHERE s <> 'P' AND a % 10 <> 0 AND b <> '5-LOW')
SELECT a AS authorization, reason IS NULL AS eligible, reason FROM (SELECT a, CASE WHEN epoch(TIMESTAMP '2001-06-01')::BIGINT < e THEN 'AUTHORIZATION_NOT_EFFECTIVE' WHEN pending THEN 'PENDING_GATE_DENIED' WHEN epoch(TIMESTAMP '2001-06-01')::BIGINT < closed + 86400 * (a % 400) THEN 'CADENCE_DENIED' END AS reason FROM x)
""")
def q_enumerated(spark, d):
    """Which grants may run now, and what holds the others back (M5)."""
    o = table(spark, d, "orders")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    grants = o.select(
        F.col("o_custkey").alias("authorization"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") != "P", "PRODUCTION").otherwise("TEST").alias("scope"), F.col("o_orderpriority").alias("bound"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("changed").alias("current"), at.alias("effective"), (86400 * (F.col("o_custkey") % 400)).alias("interval_s"), F.col("o_orderpriority").alias("target"))
    revoked = o.where("o_custkey % 10 = 0").select(F.col("o_custkey").alias("authorization")).distinct()
    open_ = o.where("o_custkey % 7 = 0").select(F.col("o_custkey").alias("authorization")).distinct()
    closed = o.where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("target"), at.alias("at"), F.lit(0).cast("long").alias("interval_s"))
    return folds.enumerated(grants, revoked, open_, closed, 991353600, "PRODUCTION")


@query("""
SELECT c_nationkey AS endpoint, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_acctbal, c_custkey) AS targets FROM customer WHERE c_acctbal > 9000 GROUP BY 1
""")
def q_endpoint_batches(spark, d):
    """Targets by endpoint, in the order in which they run."""
    rows = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("endpoint"), "c_acctbal", "c_custkey")
    found = folds.endpoint_batches(rows, "endpoint", ["c_acctbal", "c_custkey"], ["c_custkey"])
    return found.select("endpoint", F.size("batch").cast("long").alias("n"), F.array_join(F.transform("batch", lambda b: b["c_custkey"].cast("string")), ",").alias("targets"))


@query("""
SELECT o_orderkey AS id, 'lifecycle-event:' || sha256('{"event_kind":"MISSING_OBSERVED","source_occurrence_id":' || o_orderkey || ',"source_run_id":' || o_custkey || '}') AS event_id, 'SOURCE_RUN_' || o_orderstatus AS reason FROM orders
""")
def q_missing_events(spark, d):
    """The event of an occurrence that a run did not see."""
    event = diff.missing_event(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), event["event_id"].alias("event_id"), event["reason"].alias("reason"))


@query("""
SELECT event_id, event_id % 8 IN (0, 1) AS empty FROM events
""")
def q_explicit_empty(spark, d):
    """JSON texts that say outright that there is nothing."""
    texts = ['{"jobs":[],"total":0,"next":null}', '{"next": null, "total": 0, "jobs": [ ]}', '{"jobs":[],"total":0,"next":"x"}', '{"jobs":[],"total":1,"next":null}', '{"jobs":[],"total":0}', '{"jobs":[],"total":0,"next":null,"more":1}', '{"jobs":[PROPS],"total":0,"next":null}', "[PROPS"]
    text = F.replace(F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 8 + 1).cast("int")), F.lit("PROPS"), F.col("props"))
    return table(spark, d, "events").select("event_id", diff.explicit_empty(text).alias("empty"))


@query("""
SELECT o_orderstatus AS run, count(*) AS discovered, count_if(NOT held) AS added, count_if(held) AS updated, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS closed FROM (SELECT o_orderstatus, o_orderkey % 1500 IN (SELECT c_custkey FROM customer) AS held FROM orders) GROUP BY 1
""")
def q_sync_totals(spark, d):
    """What a synchronisation found, added, updated and closed."""
    crawled = table(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), (F.col("o_orderkey") % 1500).alias("c_custkey"))
    return summary.sync_totals(crawled, table(spark, d, "customer"), "run", "c_custkey", F.col("c_acctbal") < 0)


@query("""
WITH h AS (SELECT l_suppkey % 97 AS e, min(l_returnflag) AS status FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT n_nationkey, r_name, coalesce(string_agg(s_suppkey || ':' || coalesce(h.status, '-'), ',' ORDER BY s_suppkey), '') AS endpoints FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN h ON h.e = s_suppkey GROUP BY ALL
""")
def q_source_list(spark, d):
    """Sources with their organisation and their endpoints, these with their health or without."""
    sources = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    endpoints = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("endpoint"))
    health = table(spark, d, "lineitem").where("l_suppkey % 3 = 0").groupBy((F.col("l_suppkey") % 97).alias("endpoint")).agg(F.min("l_returnflag").alias("status"))
    found = q.sources_with_endpoints(sources, table(spark, d, "region"), endpoints, health, "n_nationkey", "r_regionkey", "endpoint")
    listed = F.array_join(F.transform("endpoints", lambda e: F.concat_ws(":", e["endpoint"].cast("string"), F.coalesce(e["status"], F.lit("-")))), ",")
    return found.select("n_nationkey", "r_name", listed.alias("endpoints"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '源单位' WHEN o_orderkey % 5 = 1 THEN '标签公司' || o_custkey WHEN o_orderkey % 5 = 2 THEN '题中研究院' WHEN o_orderkey % 5 = 3 THEN '某某' || o_custkey || '银行' ELSE '源单位' END AS unit,
  CASE WHEN o_orderkey % 5 IN (0, 4) THEN '央企' WHEN o_orderkey % 5 = 1 THEN '其他企业' WHEN o_orderkey % 5 = 2 THEN '科研院所' ELSE '金融机构' END AS unit_type, CASE WHEN o_orderkey % 5 = 3 THEN '法务岗' || o_custkey WHEN o_orderkey % 5 = 2 THEN '合规岗' ELSE '岗位' || o_custkey END AS title,
  o_orderkey % 5 <> 4 AS specific, o_orderkey % 3 = 0 AND o_orderkey % 5 <> 4 AND o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 AS candidate FROM orders
""")
def q_postings(spark, d):
    """Units, their types and titles of postings, and which texts are postings to keep."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    collected = postings.from_aggregator(F.when(k == 0, "https://example.org/x").otherwise("https://www.zhaopin.com/x"))
    page_title = F.when(k == 3, F.concat(F.lit("2027届校园招聘-某某"), c, F.lit("银行 法务岗"), c, F.lit(" - 智联招聘"))).when(k == 2, "合规岗招聘_题中研究院招聘-x").otherwise(F.concat(F.lit("[急] 岗位"), c))
    text = F.when(k == 1, F.concat(F.lit("介绍\n公司名称：  标签公司"), c, F.lit("，其他"))).otherwise("无")
    o = table(spark, d, "orders").withColumns({"collected": collected, "page_title": page_title, "text": text})
    o = o.withColumn("unit", postings.unit_name(F.col("page_title"), F.col("text"), F.lit("源单位"), F.col("collected")))
    title = postings.posting_title(F.col("page_title"), F.col("unit"))
    asked = F.when(k == 4, "人才招聘").otherwise(title)
    body = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "面向27届毕业生，").otherwise("面向毕业生，"), F.when(F.col("o_orderkey") % 2 == 0, "专业要求：法学类").otherwise("专业要求：会计"))
    url = F.when(F.col("o_orderkey") % 7 != 0, "https://h.example/job/1").otherwise("https://h.example/about")
    return o.select("o_orderkey", "unit", postings.unit_type(F.col("unit"), F.lit("源单位"), F.lit("央企"), F.col("collected")).alias("unit_type"), title.alias("title"), postings.specific_title(asked).alias("specific"), postings.candidate(asked, body, url, F.lit(None).cast("string"), tx.detail_url).alias("candidate"))


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS due, o_orderstatus FROM orders WHERE (o_custkey::VARCHAR = '7' OR o_orderpriority = '1-URGENT') AND o_orderstatus IN ('F', 'O'))
SELECT o_orderkey, row_number() OVER (ORDER BY floor(o_totalprice / 10000) DESC, due ASC NULLS LAST, o_orderkey)::INTEGER AS place, CASE WHEN due IS NULL THEN 'NOT_YET_AVAILABLE:no deadline' ELSE 'AVAILABLE:' || strftime(due, '%Y-%m-%d') END AS deadline, CASE o_orderstatus WHEN 'F' THEN 'DISPLAY' ELSE 'DISPLAY_WITH_REVIEW' END AS status FROM f QUALIFY place <= 2000
""")
def q_filtered_list(spark, d):
    """Filters by organisation and status, nullable fields with their reason, nulls last, a bounded list."""
    o = table(spark, d, "orders").withColumn("status", q.mapped(F.col("o_orderstatus"), {"F": "DISPLAY", "O": "DISPLAY_WITH_REVIEW", "P": "NOT_DISPLAY"}, "status"))
    o = o.where(q.status_in(None, "status"))
    o = o.withColumn("custkey", F.col("o_custkey").cast("string")).where(q.organisation_is("7", "custkey", "o_orderpriority") | q.organisation_is("1-URGENT", "custkey", "o_orderpriority"))
    due = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.select("o_orderkey", F.floor(F.col("o_totalprice") / 10000).alias("score"), due.alias("due"), "status")
    first = q.bounded(rows, [F.col("score").desc(), F.col("due").asc_nulls_last(), "o_orderkey"], 2000)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("due").asc_nulls_last(), "o_orderkey"))
    told = q.available(F.col("due"), "no deadline")
    return first.select("o_orderkey", place.alias("place"), F.concat_ws(":", told["state"], F.coalesce(told["value"], told["reason"])).alias("deadline"), "status")


@query("""
SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_acctbal > 5000) AS total FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 20
""")
def q_audit_page(spark, d):
    """A page within a page, by its own parameters."""
    rows = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name", "c_acctbal")
    return q.page_in(rows, [F.col("c_acctbal").desc(), "c_custkey"], {"offset": "5", "audit_offset": "20", "audit_limit": "30"}, "audit_").drop("c_acctbal")


@query("""
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 HOUR + INTERVAL 8 HOUR, '%Y-%m-%d') AS local_day, (epoch(o_orderdate)::BIGINT + greatest(o_orderkey % 5 * 3600, 7200)) AS next_run, o_orderkey % 4 < 2 AS same, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a' WHEN 2 THEN 'a,b' ELSE 'a,b' END AS joined, CASE o_orderkey % 4 WHEN 3 THEN 'b' ELSE '' END AS only FROM orders
""")
def q_sets_and_times(spark, d):
    """Local days, next runs, sets compared, united and subtracted."""
    k = F.col("o_orderkey") % 4
    a = F.array(F.lit("a"), F.lit("a"))
    b = F.when(k < 2, F.array(F.lit("a"))).when(k == 2, F.array(F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    at = F.col("o_orderdate").cast("timestamp")
    run = tx.next_run(at, (F.col("o_orderkey") % 5 * 3600).cast("long"), F.lit(7200).cast("long"))
    only = F.when(k == 3, F.array_except(b, a)).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format(tx.local_date(F.timestamp_seconds(F.unix_seconds(at) + 72000)), "yyyy-MM-dd").alias("local_day"), F.unix_seconds(run).alias("next_run"), same_set(a, b).alias("same"),
        F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("joined"), F.array_join(only, ",").alias("only"))


@query("""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 9 = 0 THEN 'ENDPOINT_INVALID' END, CASE WHEN c_custkey % 11 = 0 THEN 'ENDPOINT_REFERENCE_MISSING' END, CASE WHEN c_custkey % 4 = 3 THEN 'PURPOSE_UNSUPPORTED' END, CASE WHEN c_custkey % 6 = 0 THEN 'METHOD_NOT_ALLOWED' END, CASE WHEN c_nationkey = 0 THEN 'EVIDENCE_MISSING' END,
  CASE WHEN c_acctbal > 0 AND c_nationkey < 3 THEN 'REVIEW_MISSING' END, CASE WHEN c_acctbal > 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'LEVEL_DENIED' END], lambda x: x IS NOT NULL), ',') AS faults FROM customer
""")
def q_admission_faults(spark, d):
    """All that is wrong with an admission."""
    k = F.col("c_custkey")
    purpose = F.element_at(F.array(F.lit("JOB_LIST"), F.lit("JOB_DETAIL"), F.lit("RECRUITMENT_NOTICE"), F.lit("CHAT")), (k % 4 + 1).cast("int"))
    faults = gates.admission_faults(
        F.when(k % 9 != 0, "https://h.example/list").otherwise("http://h.example"), F.when(k % 11 != 0, F.concat(F.lit("e"), k)), purpose, F.when(k % 6 != 0, "GET").otherwise("POST"), F.nullif("c_nationkey", F.lit(0)), F.floor(F.col("c_nationkey") / 3),
        F.when(F.col("c_acctbal") > 0, "APPROVED"), F.when(F.col("c_mktsegment") == "BUILDING", "A").when(F.col("c_mktsegment") == "MACHINERY", "B"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(faults, ",").alias("faults"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'REVIEW_REQUIRED/EXTENSION_UNPROVEN' WHEN doc_id % 13 = 0 THEN 'EVIDENCE_BLOCKED/SCOPE_OR_ACQUISITION' WHEN doc_id % 11 = 0 THEN 'EVIDENCE_BLOCKED/BYTES_DIFFER' WHEN source = 'src5' THEN 'EVIDENCE_BLOCKED/AUTHORITY' WHEN lang = 'fr' THEN 'EVIDENCE_BLOCKED/REFERENCES_MISSING' ELSE 'SUPPORTED' END AS state FROM documents
""")
def q_discovery_state(spark, d):
    """Whether a discovery's evidence holds."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    good = F.sha2("lang", 256)
    found = gates.discovery_state(
        F.lit(True), k % 13 != 0, F.lit(True), F.col("b"), F.sha2("b", 256), F.octet_length("b") + F.when(k % 11 == 0, 1).otherwise(0), F.lit("text/html"), F.lit("text/html"), F.when(F.col("source") == "src5", "THIRD_PARTY").otherwise("OFFICIAL"),
        F.array(good, good, good, F.when(F.col("lang") == "fr", "none").otherwise(good)), k % 17 != 0)
    return docs.select("doc_id", F.concat_ws("/", found["state"], found["reason"]).alias("state"))


@query("""
WITH m AS (SELECT c_custkey AS m, CASE WHEN c_custkey % 2 = 0 THEN 'REAL' ELSE 'SYNTHETIC' END AS c FROM customer), i AS (SELECT o_custkey AS m, o_orderkey AS i, CASE WHEN o_orderpriority = '5-LOW' THEN 'REAL' WHEN o_custkey % 2 = 0 THEN 'REAL' ELSE 'SYNTHETIC' END AS p, o_orderstatus AS s FROM orders),
f AS (SELECT m.m, CASE WHEN count(i) = 0 THEN 'NO_ITEMS' WHEN count_if(p <> c) > 0 THEN 'PROVENANCE_DIFFERS' END AS fault FROM m LEFT JOIN i ON i.m = m.m GROUP BY m.m)
SELECT f.m AS manifest, coalesce(fault, 'SEALED') AS outcome, count(e) AS items, coalesce(min(e), '') AS first_id FROM f LEFT JOIN (SELECT i.m, 'evidence:' || sha256('{"class":"' || c || '","manifest":"' || i.m || '","payload":"' || i || '/' || s || '"}') AS e FROM i JOIN m ON m.m = i.m) x ON x.m = f.m AND fault IS NULL GROUP BY ALL
""")
def q_issued_evidence(spark, d):
    """Issuances of evidence, sealed or held back as a whole."""
    kind = lambda k: F.when(k % 2 == 0, "REAL").otherwise("SYNTHETIC")
    manifests = table(spark, d, "customer").select(F.col("c_custkey").alias("m"), kind(F.col("c_custkey")).alias("c"))
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("m"), "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "REAL").otherwise(kind(F.col("o_custkey"))).alias("p"))
    sealed, faults = gates.issued_evidence(manifests, items, "m", "c", "p", F.concat_ws("/", "o_orderkey", "o_orderstatus"))
    g = sealed.groupBy(F.col("m").alias("manifest")).agg(F.lit("SEALED").alias("outcome"), F.count("*").alias("items"), F.min("evidence_id").alias("first_id"))
    return g.unionByName(faults.select(F.col("m").alias("manifest"), F.col("fault").alias("outcome"), F.lit(0).cast("long").alias("items"), F.lit("").alias("first_id")))


@query("""
WITH e AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(DISTINCT o_orderstatus) AS n, min(o_orderstatus) AS s FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'UNBOUND' WHEN n > 1 THEN 'AMBIGUOUS' WHEN s = o_orderstatus THEN 'BOUND' ELSE 'MISMATCH' END AS binding FROM orders LEFT JOIN e ON k = o_custkey AND y = year(o_orderdate)
""")
def q_campaigns(spark, d):
    """Records bound to the retained evidence of their campaign."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("s"), "o_orderpriority")
    return gates.bound_campaigns(o, o.where("o_orderpriority = '1-URGENT'").select("k", "y", "s"), ["k", "y"], ["s"]).select("o_orderkey", "binding")


@query("""
SELECT page_id, page_id % 4 IN (0, 1) AS approved, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'b' ELSE 'a,b' END AS missing FROM pages
""")
def q_query_targets(spark, d):
    """URL queries that are approved, and capabilities that are missing."""
    k = F.col("page_id")
    asked = F.element_at(F.array(F.lit("page=2&ref=x"), F.lit("ref=x&page=2"), F.lit("page=2&page=2&ref=x"), F.lit("page=2+1&ref=x")), (k % 4 + 1).cast("int"))
    has = F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"))).when(k % 3 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    gate = gates.capability_gate(F.array(F.lit("b"), F.lit("a")), has)
    return table(spark, d, "pages").select("page_id", gates.approved_query(asked, F.array(F.lit("page=2&ref=x"))).alias("approved"), F.array_join(gate["missing"], ",").alias("missing"))


@query("SELECT source, lang FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL HAVING count(DISTINCT coalesce(quality, -1)) > 1")
def q_mixed_scopes(spark, d):
    """Keys whose evidence is of more than one scope (P10)."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("scope", F.coalesce("quality", F.lit(-1)))
    return gates.mixed_scopes(rows, ["source", "lang"], "scope").select("source", "lang")


@query("""
WITH f AS (SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 20) DAY END AS b, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-05' + INTERVAL (o_orderkey % 20) DAY END AS e FROM orders WHERE o_orderstatus = 'P')
SELECT event_id, id FROM events JOIN f ON f.k = user_id WHERE (b IS NULL OR b <= ts) AND (e IS NULL OR ts <= e)
""")
def q_asof_open(spark, d):
    """Facts that hold at an event's instant, open ends included."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    day = lambda first: (F.to_timestamp_ntz(F.lit(first)) + F.make_dt_interval((F.col("o_orderkey") % 20).cast("int"))).cast("timestamp_ntz")
    facts = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 4 != 0, day("2024-01-01 00:00:00")).alias("b"), F.when(F.col("o_orderkey") % 3 != 0, day("2024-01-05 00:00:00")).alias("e"))
    return q.validity_join(facts, table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "b", "e", "ts", 86400).select("event_id", "id")


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 OR o_orderstatus <> 'F' THEN 'METHOD_DIFFERS' END, CASE WHEN o_orderkey % 7 = 0 OR c_nationkey = 3 THEN 'TIME_UNKNOWN' END, CASE WHEN o_orderkey % 7 <> 0 AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'NOT_YET_VALID' END, CASE WHEN o_orderkey % 7 <> 0 AND c_nationkey <> 3 AND o_orderdate > TIMESTAMP '2001-01-01' THEN 'EXPIRED' END], lambda x: x IS NOT NULL), ',') AS faults
FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, 'NO_PERMIT' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def q_permit_nulls(spark, d):
    """Runs against permits where a method, an instant or a limit is not known."""
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(F.struct("o_orderkey", "o_custkey").alias("id"), F.col("o_custkey").alias("k"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("method"), F.when(k % 7 != 0, F.col("o_orderdate")).alias("at"))
    permits = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("F").alias("method"), F.lit("1998-01-01").cast("timestamp_ntz").alias("f"), F.when(F.col("c_nationkey") != 3, F.lit("2001-01-01").cast("timestamp_ntz")).alias("t"))
    keyed = permits.join(runs.select("k", "id"), "k").select("id", "method", "f", "t")
    found = gates.authorization_faults(runs.select("id", "method", "at"), keyed, "id", ["method"], "at", "f", "t")
    return found.select("id.o_orderkey", F.array_join("faults", ",").alias("faults"))


@query("""
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'ZERO_RESULT_REQUIRES_VALIDATION' WHEN event_id % 6 = 1 THEN '' WHEN event_id % 6 = 2 THEN 'EMPTY_RESPONSE_STRUCTURE_INVALID,EMPTY_PAGINATION_INCOMPLETE,EMPTY_SIGNAL_MISSING,EMPTY_AUTHENTICATION_WALL_DETECTED,EMPTY_CAPTCHA_DETECTED,EMPTY_ERROR_PAGE_DETECTED,EMPTY_STRUCTURE_DRIFT_DETECTED,EMPTY_HISTORY_UNAVAILABLE'
  WHEN event_id % 6 = 3 THEN 'EMPTY_SIGNAL_MISSING' WHEN event_id % 6 = 4 THEN 'EMPTY_CAPTCHA_DETECTED' ELSE 'EMPTY_HISTORY_ANOMALOUS' END AS reasons FROM events
""")
def q_empty_proofs(spark, d):
    """What keeps an empty run from being proven so; null flags prove nothing."""
    k = F.col("event_id") % 6
    flag = lambda c: F.when(k != 2, c)
    fields = F.struct(
        flag(F.lit(True)).alias("response_structure_valid"), flag(F.lit(True)).alias("pagination_complete"), flag(k == 5).alias("explicit_empty_signal"), F.when(k.isin(1, 4, 5), F.lit(0)).alias("official_result_count"), flag(F.lit(False)).alias("authentication_wall_detected"),
        flag(k == 4).alias("captcha_detected"), flag(F.lit(False)).alias("error_page_detected"), flag(F.lit(False)).alias("structure_drift_detected"), flag(F.when(k == 5, "ANOMALOUS").otherwise("CONSISTENT")).alias("historical_comparison"))
    rows = table(spark, d, "events").select("event_id", F.when(k != 0, fields).alias("v"))
    return rows.select("event_id", F.array_join(diff.empty_reasons("v"), ",").alias("reasons"))


@query("""
WITH s AS (SELECT l_orderkey AS id, l_linenumber AS rev, l_suppkey AS p, l_returnflag AS f, l_partkey AS x FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY id, rev) AS n, first_value(p) OVER (PARTITION BY id ORDER BY rev, p, f, x) AS first FROM s),
f AS (SELECT id, rev, unnest(list_filter([CASE WHEN n > 1 THEN 'DUPLICATE' END, CASE WHEN p NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 'PUBLISHER_UNKNOWN' END, CASE WHEN p <> first THEN 'PUBLISHER_CHANGED' END, CASE WHEN f NOT IN ('A', 'N') THEN 'KIND_UNSUPPORTED' END], lambda y: y IS NOT NULL)) AS fault FROM n)
SELECT DISTINCT id, rev, fault FROM f
""")
def q_registry_all_faults(spark, d):
    """All four faults of a registry, a changed publisher among them (P5)."""
    sources = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rev"), F.col("l_suppkey").alias("p"), F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("x"))
    publishers = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("p"))
    return gates.registry_faults(sources, publishers, "id", "rev", "p", ["A", "N"], "f", ties=["p", "f", "x"])


_SIDES = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg, c_custkey % 9 AS m, c_custkey // 25 AS blk, c_custkey % 50 < 46 AS ctx FROM customer),
p AS (SELECT a.k AS l, b.k AS r, a.ctx AS lc, b.ctx AS rc, a.m AS am, b.m AS bm, a.n AS an, b.n AS bn, a.seg AS asg, b.seg AS bsg, a.k % 20 = 1 AND b.k = a.k + 1 AS rec FROM c a JOIN c b ON a.k < b.k AND a.blk = b.blk),
x AS (SELECT *, CASE WHEN am = 8 OR bm = 8 THEN 'SEP:IDENTITY_EVIDENCE_CONFLICT' WHEN am = 7 OR bm = 7 THEN 'SEP:IDENTITY_EVIDENCE_INSUFFICIENT' WHEN rec THEN 'MER:EXPLICIT_RECONCILIATION_MATCH'
  WHEN am IN (0, 1) AND bm IN (0, 1) AND am <> bm OR asg <> bsg THEN 'SEP:' || array_to_string(list_filter([CASE WHEN am IN (0, 1) AND bm IN (0, 1) AND am <> bm THEN 'OPPORTUNITY_IDENTITY_CONFLICT' END, CASE WHEN asg <> bsg THEN 'EMPLOYER_IDENTITY_CONFLICT' END], lambda y: y IS NOT NULL), ',')
  WHEN am IN (0, 1) AND am = bm THEN 'MER:OPPORTUNITY_IDENTITY_MATCH,RECRUITMENT_CONTEXT_MATCH'
  WHEN am = 2 OR bm = 2 THEN 'SEP:POSITION_IDENTITY_PROVISIONAL' WHEN am = 3 OR bm = 3 THEN 'SEP:POSITION_IDENTITY_MATCH,RECRUITMENT_PLAN_IDENTITY_UNRESOLVED' WHEN am = 4 OR bm = 4 THEN 'SEP:POSITION_IDENTITY_MATCH,RECRUITMENT_PLAN_IDENTITY_MATCH,RECRUITMENT_BATCH_IDENTITY_UNRESOLVED'
  WHEN (am = 5) <> (bm = 5) THEN 'SEP:POSITION_IDENTITY_MATCH,RECRUITMENT_PLAN_IDENTITY_MATCH,RECRUITMENT_BATCH_IDENTITY_MATCH,EMPLOYER_IDENTITY_MATCH,LOCATION_IDENTITY_DISCRIMINATOR_UNRESOLVED'
  ELSE 'MER:POSITION_IDENTITY_MATCH,RECRUITMENT_PLAN_IDENTITY_MATCH,RECRUITMENT_BATCH_IDENTITY_MATCH,EMPLOYER_IDENTITY_MATCH' || CASE WHEN am = 5 THEN '' ELSE ',LOCATION_IDENTITY_DISCRIMINATOR_MATCH' END || ',RECRUITMENT_CONTEXT_MATCH' END AS both_ FROM p)"""


@query(f"""
{_SIDES}
SELECT l, r, CASE WHEN lc AND rc THEN CASE left(both_, 3) WHEN 'MER' THEN 'MERGE' ELSE 'SEPARATE' END WHEN lc OR rc THEN CASE WHEN rec THEN 'MERGE' ELSE 'SEPARATE' END ELSE CASE WHEN an = bn THEN 'MERGE' ELSE 'SEPARATE' END END AS outcome,
  CASE WHEN lc AND rc THEN substr(both_, 5) WHEN lc OR rc THEN CASE WHEN rec THEN 'EXPLICIT_RECONCILIATION_MATCH' ELSE 'LEGACY_CONTEXT_RECONCILIATION_MISSING' END ELSE CASE WHEN an = bn THEN 'ALL_MATCH' ELSE 'NATION_DIFFERS' END END AS reasons FROM x
""")
def q_contextual_pairs(spark, d):
    """Pairs of candidates by their recruitment context, by reconciliation where only one has one, and by plain keys else."""
    k, m = F.col("c_custkey"), F.col("c_custkey") % 9
    claim = lambda state, key: F.struct(state.alias("state"), key.alias("key"))
    sure, word = F.lit("CONFIRMED"), F.lit("x")
    side = F.struct(
        (m == 8).alias("separated"), (m != 7).alias("valid"), claim(F.when(m < 2, "CONFIRMED").otherwise("UNRESOLVED"), F.concat(F.lit("o"), m)).alias("opportunity"), claim(F.when(m == 2, "PROVISIONAL").otherwise(sure), word).alias("position"),
        claim(F.when(m == 3, "UNRESOLVED").otherwise(sure), word).alias("plan"), claim(F.when(m == 4, "UNRESOLVED").otherwise(sure), word).alias("batch"), F.lit("APPLICABLE").alias("applicability"), F.col("c_mktsegment").alias("employer"),
        F.when(m == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("here"))).alias("locations"))
    rows = table(spark, d, "customer").select("c_custkey", F.floor(k / 25).alias("block"), F.col("c_nationkey").alias("nation"), side.alias("side"), (k % 50 < 46).alias("context"))
    pairs = resolve.blocked_pairs(rows, "c_custkey", ["block"]).withColumnsRenamed({"l_c_custkey": "l", "r_c_custkey": "r"})
    names = rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("POSITION:"), "c_custkey").alias("ref"))
    hundreds = rows.where("c_custkey % 20 = 1").select("c_custkey")
    moves = hundreds.select(F.array(F.concat(F.lit("POSITION:"), "c_custkey")).alias("from_refs"), F.array(F.concat(F.lit("POSITION:"), F.col("c_custkey") + 1)).alias("to_refs"), F.lit("CONFIRMED").alias("state"), F.lit("MERGE").alias("kind"), F.array(F.lit("e")).alias("evidence"))
    pairs = resolve.reconciled_pairs(pairs, names, moves)
    plain = F.struct(F.when(F.col("l_nation") == F.col("r_nation"), "MERGE").otherwise("SEPARATE").alias("outcome"), F.array(F.when(F.col("l_nation") == F.col("r_nation"), "ALL_MATCH").otherwise("NATION_DIFFERS")).alias("reasons"))
    out = resolve.candidate_decision(F.col("l_side"), F.col("r_side"), F.col("l_context"), F.col("r_context"), F.col("reconciled"), plain)
    return pairs.withColumn("d", out).select("l", "r", "d.outcome", F.array_join("d.reasons", ",").alias("reasons"))


@query("""
WITH m AS (SELECT o_custkey AS g, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank, o_orderstatus = 'F' AS c, o_orderdate AS seen, '{"nation":' || o_custkey % 25 || ',"title":"t' || o_custkey || '"}' AS basis FROM orders),
a AS (SELECT g, arg_min(id, (rank, id)) AS id, arg_min(c, (rank, id)) AS c, min(basis) AS basis, count(*) AS n, min(seen) AS first_seen, string_agg('v' || id, ',' ORDER BY 'v' || id) AS versions FROM m GROUP BY g)
SELECT g, CASE WHEN n > 1 OR c THEN sha256(basis) ELSE sha256('{"canonical_basis_hash":"' || sha256(basis) || '","source_occurrence_id":' || id || '}') END AS identity_hash, id AS selected, CASE WHEN c THEN 'CONFIRMED' ELSE 'PROVISIONAL' END AS state, n AS members, versions, first_seen FROM a
""")
def q_canonical_rows(spark, d):
    """One canonical row for each group: identity, the member of the highest authority, all its versions."""
    o = table(spark, d, "orders")
    members = o.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.concat(F.lit("v"), "o_orderkey").alias("version"), F.when(F.col("o_orderpriority") == "1-URGENT", "OFFICIAL").when(F.col("o_orderpriority") == "2-HIGH", "AUTHORIZED").otherwise("OTHER").alias("authority"), (F.col("o_orderstatus") == "F").alias("c"), "o_orderdate")
    basis = canonical_json({"title": F.concat(F.lit("t"), "g"), "nation": F.col("g") % 25})
    out = resolve.canonical_rows(members, "g", "id", "version", "authority", ["OFFICIAL", "AUTHORIZED"], basis, F.col("c"), "o_orderdate")
    return out.withColumn("versions", F.array_join("versions", ","))


@query("""
WITH s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), e AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events), u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
g AS (SELECT user_id, day, s.day IS NOT NULL AS seen FROM u CROSS JOIN r LEFT JOIN s USING (user_id, day)), i AS (SELECT *, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS island FROM g)
SELECT user_id, max(streak)::INTEGER AS longest, count(*) AS days FROM (SELECT user_id, day, sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY day) AS streak FROM i) GROUP BY user_id
""")
def q_missing_calendar(spark, d):
    """Missing streaks over all days that the table has, from its first to its last."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    ends = e.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = e.select("user_id").distinct().crossJoin(F.broadcast(days)).join(e.distinct().withColumn("seen", F.lit(True)), ["user_id", "day"], "left")
    out = diff.missing_streaks(grid, ["user_id"], ["day"], F.lit(True), F.coalesce("seen", F.lit(False)))
    return out.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count("*").alias("days"))
