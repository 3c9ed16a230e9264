"""Gates, captured runs, clause rules and expressions over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import capture, clauses, expressions, gates, logic
from .tables import query, table


@query("""
SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'DENIED' WHEN c_mktsegment = 'BUILDING' THEN 'CONTINUOUS' WHEN c_nationkey < 10 THEN 'CONTROLLED' WHEN c_custkey % 2 = 0 THEN 'ONE_RUN' ELSE 'DENIED' END AS permission FROM customer
""")
def q_admission(spark, d):
    """What a source may do."""
    c = F.col
    permission = gates.admission(F.when(c("c_acctbal") > 0, "APPROVED"), F.when(c("c_mktsegment") == "BUILDING", "CONTINUOUS").otherwise("ONCE"), F.when(c("c_nationkey") < 10, "A").otherwise("B"), c("c_custkey") % 2 == 0)
    return table(spark, d, "customer").select("c_custkey", permission.alias("permission"))


@query("""
SELECT o_custkey, array_to_string(list_filter([CASE WHEN c_custkey IS NULL THEN 'NO_PERMIT' END, CASE WHEN c_custkey IS NOT NULL AND o_orderstatus <> CASE WHEN c_nationkey < 12 THEN 'F' ELSE 'O' END THEN 'METHOD_DIFFERS' END, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' AND c_custkey IS NOT NULL THEN 'NOT_YET_VALID' END, CASE WHEN o_orderdate > TIMESTAMP '2000-01-01' AND c_custkey IS NOT NULL THEN 'EXPIRED' END], lambda x: x IS NOT NULL), ',') AS faults, count(*) AS n
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey GROUP BY ALL
""")
def q_permits(spark, d):
    """What keeps runs from their permits."""
    runs = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("method"), "o_orderdate")
    permits = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") < 12, "F").otherwise("O").alias("method"), F.lit("1996-01-01").cast("timestamp_ntz").alias("f"), F.lit("2000-01-01").cast("timestamp_ntz").alias("t"))
    found = gates.authorization_faults(runs, permits, "o_custkey", ["method"], "o_orderdate", "f", "t")
    return found.groupBy("o_custkey", F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN n > 1 THEN 'DUPLICATE' END, CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 'PUBLISHER_UNKNOWN' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'KIND_UNSUPPORTED' END], lambda x: x IS NOT NULL)) AS fault FROM s)
SELECT DISTINCT l_orderkey, l_linenumber, fault FROM f
""")
def q_registry_faults(spark, d):
    """What is wrong with entries of a registry (P5)."""
    sources = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("p"), "l_returnflag")
    publishers = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("p"))
    return gates.registry_faults(sources, publishers, "l_orderkey", "l_linenumber", "p", ["A", "N"], "l_returnflag").where("fault <> 'PUBLISHER_CHANGED'")


@query("""
WITH a AS (SELECT c_custkey AS k, c_mktsegment AS h FROM customer WHERE c_nationkey < 18), b AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'X' ELSE c_mktsegment END AS h FROM customer WHERE c_nationkey > 5)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'BLOCKED_MISSING' WHEN a.k IS NULL THEN 'BLOCKED_EXTRA' WHEN a.h = b.h THEN 'MIGRATED' ELSE 'BLOCKED_DIFFERS' END AS status FROM a FULL JOIN b ON a.k = b.k
""")
def q_migration_audit(spark, d):
    """Whether two generations agree."""
    c = table(spark, d, "customer")
    old = c.where("c_nationkey < 18").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("h"))
    new = c.where("c_nationkey > 5").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") < 0, "X").otherwise(F.col("c_mktsegment")).alias("h"))
    return gates.migration_audit(old, new, "k", "h")


@query("""
WITH f AS (SELECT source || '/' || (doc_id // 40) AS p, max(n_chars) AS s, min(lang) AS h, count(*) AS n FROM documents GROUP BY ALL), o AS (SELECT source || '/' || (doc_id // 40) AS p, max(lang) AS h FROM documents GROUP BY ALL)
SELECT p, unnest(list_filter([CASE WHEN n > 1 THEN 'DUPLICATE_PATH' END, CASE WHEN s > 6000 THEN 'TOO_LARGE' END, CASE WHEN o.h <> f.h THEN 'CHANGED' END], lambda x: x IS NOT NULL)) AS fault FROM f JOIN o USING (p)
""")
def q_release_faults(spark, d):
    """What is wrong with a release's files."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 40)).alias("p"), "n_chars", "lang")
    old = docs.groupBy("p").agg(F.max("lang").alias("lang"))
    return gates.release_faults(docs, old, "p", "n_chars", "lang", 1 << 60, 6000)


@query("""
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, floor(value)::BIGINT AS h, floor(value)::BIGINT AS size, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, event_type, h ORDER BY n) AS a, row_number() OVER (PARTITION BY user_id, day, h ORDER BY n) AS b, sum(size) OVER (PARTITION BY user_id, day ORDER BY n) AS t FROM e),
s AS (SELECT user_id, day, n, CASE WHEN a > 1 THEN 'REPEATED_LOCATOR' WHEN b > 1 THEN 'REPEATED_CONTENT' WHEN h = 0 THEN 'EXPLICIT_EMPTY' WHEN t >= 200 THEN 'BUDGET' WHEN n >= 4 THEN 'MAX_PAGES' WHEN event_type = 'error' THEN 'LAST_PAGE' END AS stop FROM w)
SELECT user_id || '/' || day AS run, min(n) AS n, arg_min(stop, n) AS stop FROM s WHERE stop IS NOT NULL GROUP BY user_id, day
""")
def q_paging_stops(spark, d):
    """Where and why paging stopped."""
    number = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")).cast("long")
    size = F.floor("value").cast("long")
    pages = table(spark, d, "events").select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("run"), number.alias("n"), F.concat_ws(":", "event_type", size).alias("locator"), size.alias("h"), size.alias("items"), (F.col("event_type") != "error").alias("more"))
    return capture.paging_stops(pages, "run", "n", "locator", "h", "items", "more", 4, 200, "h")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS s, l_returnflag <> 'N' AS m FROM lineitem), b AS (SELECT l_orderkey AS k, l_returnflag AS s, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY ALL),
g AS (SELECT k, count(*) FILTER (m) AS material, count(*) FILTER (m AND n IS NULL) AS unbound, count(*) FILTER (m AND n > 1) AS several FROM s LEFT JOIN b USING (k, s) GROUP BY k)
SELECT k, CASE WHEN material = 0 THEN 'INVENTORY_EMPTY' WHEN unbound > 0 THEN 'BLOCKED' WHEN several > 0 THEN 'AMBIGUOUS' ELSE 'COMPLETE' END AS status FROM g
""")
def q_composition(spark, d):
    """What a position's sources add up to."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("s"), "l_quantity")
    surfaces = lines.select("k", "s", (F.col("s") != "N").alias("m")).distinct()
    return capture.composition(surfaces, lines.where("l_quantity > 20").select("k", "s"), ["k"], "s", "m")


#: Clause rules for the invented prose of the conversations.
PROSE_RULES = [
    clauses.Rule("ONE_WORD", r"^([^.,]{1,12})\.$", (clauses.Fact("WORD", "EQUALS", 1),)),
    clauses.Rule("COMMA_FIRST", r"^([^,.]{1,30}),", (clauses.Fact("HEAD", "EQUALS", 1), clauses.Fact("LIST", "EXISTS", "YES")), "AMBIGUOUS"),
    clauses.Rule("SENTENCE", r"\.$", status="OBSERVATION"),
]


@query(r"""
WITH s AS (SELECT conv_id, turn, string_split_regex(text, '[;；。\n]+') AS p FROM conversations),
u AS (SELECT conv_id, turn, unnest(list_filter(list_transform(p, lambda x: regexp_replace(x, '[\s　 ]+', '', 'g')), lambda x: x <> '')) AS c FROM s)
SELECT conv_id, turn, CASE WHEN regexp_matches(c, '^([^.,]{1,12})\.$') THEN 'ONE_WORD' WHEN regexp_matches(c, '^([^,.]{1,30}),') THEN 'COMMA_FIRST' WHEN regexp_matches(c, '\.$') THEN 'SENTENCE' ELSE 'UNPARSED' END AS rule,
  coalesce(CASE WHEN regexp_matches(c, '^([^.,]{1,12})\.$') THEN 'WORD=' || regexp_extract(c, '^([^.,]{1,12})\.$', 1) WHEN regexp_matches(c, '^([^,.]{1,30}),') THEN 'HEAD=' || regexp_extract(c, '^([^,.]{1,30}),', 1) || ';LIST=YES' END, '') AS facts, count(*) AS n
FROM u GROUP BY ALL
""")
def q_clause_rules(spark, d):
    """Clauses to flat facts by a table of patterns (K1); q_requirement_facts runs the cascade K2."""
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    found = clauses.parsed(turns, "id", "text", PROSE_RULES)
    facts = F.array_join(F.transform("facts", lambda f: F.concat_ws("=", f["dimension"], f["value"])), ";")
    return found.groupBy("id.conv_id", "id.turn", "rule", facts.alias("facts")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE WHEN (lang = 'en' AND NOT (source = 'src1')) OR n_chars > 4000 THEN 2 ELSE 0 END AS level FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, CASE WHEN NOT (lang = 'de' OR source = 'src2') THEN 2 ELSE 0 END FROM documents WHERE doc_id % 3 = 0
""")
def q_expression(spark, d):
    """Boolean expressions in text, as trees, evaluated from the leaves up."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    asked = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "not (de or src2)").otherwise("en and not src1 or long").alias("e"))
    nodes, _ = expressions.trees(asked, "doc_id", "e")
    known = nodes.where("operator = 'LEAF'").join(docs, F.col("tree") == F.col("doc_id"))
    true = (F.col("leaf") == F.col("lang")) | (F.col("leaf") == F.col("source")) | ((F.col("leaf") == "long") & (F.col("n_chars") > 4000))
    leaves = known.select("tree", "node", F.when(true, 2).otherwise(0).alias("level"))
    return logic.levels(nodes, leaves).where("node = 0").select(F.col("tree").alias("doc_id"), "level")
