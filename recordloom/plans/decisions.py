"""Rules, three-valued logic, decisions and resolution over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kleene
from ..functions import text as tx
from ..operators import query as q
from ..operators import logic, patterns, resolve, rules, summary
from .tables import query, table

#: The finding rules of the query: category, name, pattern. Made for the invented prose of the documents.
RULES = [
    ("direct", "MAIL", r"[a-z0-9.]+@[a-z0-9]+\.example"),
    ("direct", "TOKEN", r"token = "),
    ("adjacent", "ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("adjacent", "TABLE", r" \| "),
    ("negative", "SHOUTING", r"!!"),
    ("negative", "MARKS", r"[$&*%#]{3}"),
]
_RULES_SQL = ", ".join(f"('{c}', '{n}', '{p}')" for c, n, p in RULES)
_FOUND_SQL = f"r(category, rule, p) AS (VALUES {_RULES_SQL}), f AS (SELECT doc_id, category, rule FROM documents, r WHERE regexp_matches(text, p))"


@query(f"WITH {_FOUND_SQL} SELECT * FROM f")
def q_rule_findings(spark, d):
    """Every rule that a text matches."""
    return rules.findings(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", RULES)


@query(f"""
WITH {_FOUND_SQL}, c AS (SELECT doc_id, count_if(category = 'direct') AS a, count_if(category = 'adjacent') AS b, count_if(category = 'negative') AS n FROM f GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(a, 0) > 0 THEN 'RELEVANT' WHEN n_chars < 300 THEN 'BLOCKED' WHEN coalesce(b, 0) > 0 THEN 'POSSIBLY_RELEVANT' WHEN coalesce(n, 0) > 0 THEN 'NOT_RELEVANT' ELSE 'REVIEW' END AS relevance FROM documents LEFT JOIN c USING (doc_id)
""")
def q_relevance(spark, d):
    """Relevance from findings and coverage."""
    docs = table(spark, d, "documents")
    found = rules.findings(docs.select("doc_id", "text"), "doc_id", "text", RULES)
    return rules.relevance(found, docs.select("doc_id", (F.col("n_chars") >= 300).alias("covered")), "doc_id", "covered")


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '!!') THEN 'shout' WHEN regexp_matches(text, ' \\| ') THEN 'table' WHEN regexp_matches(text, '^[A-ZÉÈÄÖÜ]') THEN 'prose' ELSE 'other' END AS class,
  CASE WHEN contains(text, 'ciones') THEN 'ciones' WHEN contains(text, 'ung') THEN 'ung' WHEN contains(text, 'eau') THEN 'eau' WHEN contains(text, 'th') THEN 'th' ELSE 'none' END AS direction FROM documents
""")
def q_rule_class(spark, d):
    """The first class and the first listed term that fit a text."""
    t = F.col("text")
    cascade = [("!!", "shout"), (r" \| ", "table"), ("^[A-ZÉÈÄÖÜ]", "prose")]
    return table(spark, d, "documents").select("doc_id", tx.first_class(t, cascade, "other").alias("class"), tx.first_listed(t, ["ciones", "ung", "eau", "th"], F.lit("none")).alias("direction"))


@query("""
WITH w(seg, weight) AS (VALUES ('BUILDING', 5), ('MACHINERY', 4), ('FURNITURE', 4))
SELECT c_custkey, (CASE WHEN contains(n_name || ' ' || c_name, 'NATION_7 ') OR contains(n_name || ' ' || c_name, 'NATION_9 ') THEN 0 WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 0 THEN 1
  ELSE greatest(1, least(5, coalesce(weight, 3) + CASE WHEN c_acctbal > 7000 THEN 1 ELSE 0 END - CASE WHEN c_acctbal < 500 THEN 1 ELSE 0 END)) END)::INTEGER AS score
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN w ON seg = c_mktsegment
""")
def q_score(spark, d):
    """Match scores from weights and adjustments, within bounds."""
    weights = F.create_map(*[F.lit(x) for pair in {"BUILDING": 5, "MACHINERY": 4, "FURNITURE": 4}.items() for x in pair])
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    excluded = rules.excluded_by_term(F.concat_ws(" ", "n_name", "c_name"), ["NATION_7 ", "NATION_9 "])
    rejected = (F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_acctbal") < 0)
    return rows.select("c_custkey", rules.score(F.coalesce(weights[F.col("c_mktsegment")], F.lit(3)), excluded, rejected, [F.col("c_acctbal") > 7000], [F.col("c_acctbal") < 500]).alias("score"))


@query("""
SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS excluded FROM customer
""")
def q_excluded_identity(spark, d):
    """Exclusion by exact identity."""
    named = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return rules.excluded_by_identity(table(spark, d, "customer").select("c_custkey", "c_nationkey"), named, "c_nationkey").select("c_custkey", "excluded")


_LEVEL_SQL = "SELECT source, lang, doc_id, n_chars, CASE quality WHEN 1 THEN 2 WHEN 0 THEN 0 ELSE 1 END AS level FROM documents LEFT JOIN labels USING (doc_id)"


def _labelled(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")


@query(f"SELECT source, lang, min(level)::INTEGER AS all_level, max(level)::INTEGER AS any_level, (2 - min(level))::INTEGER AS not_all, count(*) AS n FROM ({_LEVEL_SQL}) GROUP BY ALL")
def q_kleene(spark, d):
    """AND, OR and NOT over groups with unknowns."""
    level = kleene.level(F.col("good"))
    out = _labelled(spark, d).groupBy("source", "lang").agg(kleene.all_of(level).alias("all_level"), kleene.any_of(level).alias("any_level"), F.count("*").alias("n"))
    return out.withColumn("not_all", kleene.negated(F.col("all_level")))


def _eligibility_sql(unknown_first: bool) -> str:
    first = "WHEN unknown > 0 THEN 'NEEDS_REVIEW'" if unknown_first else ""
    return f"""
WITH g AS (SELECT source || '/' || (doc_id % 7) AS owner, lang, CASE WHEN lang = 'en' THEN max(level) ELSE min(level) END AS level, min(CASE WHEN n_chars > 400 THEN 1 ELSE 0 END) = 1 AS certain FROM ({_LEVEL_SQL}) GROUP BY 1, 2),
a AS (SELECT owner, count_if(level = 1) AS unknown, count_if(level = 0 AND certain) AS fails, count_if(level = 0) AS fails_some, count_if(NOT certain) AS unsure FROM g GROUP BY owner)
SELECT owner, CASE {first} WHEN fails > 0 THEN 'INELIGIBLE' WHEN fails_some > 0 THEN 'LIKELY_INELIGIBLE' WHEN unknown > 0 THEN 'NEEDS_REVIEW' WHEN unsure > 0 THEN 'LIKELY_ELIGIBLE' ELSE 'ELIGIBLE' END AS result FROM a
"""


def _eligibility(spark, d, unknown_first: bool):
    facts = _labelled(spark, d).withColumn("owner", F.concat_ws("/", "source", F.col("doc_id") % 7)).withColumn("op", F.when(F.col("lang") == "en", "OR").otherwise("AND"))
    groups = rules.group_outcomes(facts, "owner", "lang", "op", F.col("good"), F.col("n_chars") > 400)
    return rules.eligibility(groups, facts.select("owner"), "owner", None, unknown_first)


@query(_eligibility_sql(True))
def q_eligibility(spark, d):
    """Results where any unknown group asks for review (L1, L3)."""
    return _eligibility(spark, d, True)


@query(_eligibility_sql(False))
def q_eligibility_decided(spark, d):
    """Results where a failure decides before an unknown does."""
    return _eligibility(spark, d, False)


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'P') AS p, max(o_totalprice) AS top FROM orders GROUP BY o_custkey),
x AS (SELECT c_custkey, c_acctbal < -900 AS excluded, CASE WHEN p > 5 THEN 'RELEVANT' WHEN p > 3 THEN 'POSSIBLY_RELEVANT' WHEN p > 1 THEN 'BLOCKED' WHEN p > 0 THEN 'NOT_RELEVANT' END AS rel, c_mktsegment <> 'MACHINERY' AS bound, CASE WHEN top > 450000 THEN 'ELIGIBLE' WHEN top > 400000 THEN 'LIKELY_ELIGIBLE' WHEN top > 300000 THEN 'NEEDS_REVIEW' END AS el FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN excluded THEN 'NOT_DISPLAY' WHEN rel IS NULL THEN 'DISPLAY_WITH_REVIEW' WHEN NOT bound THEN 'DISPLAY_WITH_REVIEW' WHEN rel = 'NOT_RELEVANT' THEN 'NOT_DISPLAY' WHEN rel = 'BLOCKED' THEN 'EVIDENCE_BLOCKED' WHEN el IS NULL THEN 'DISPLAY_WITH_REVIEW' WHEN rel = 'RELEVANT' AND el IN ('ELIGIBLE', 'LIKELY_ELIGIBLE') THEN 'DISPLAY' ELSE 'DISPLAY_WITH_REVIEW' END AS decision FROM x
""")
def q_decision(spark, d):
    """Presentation decisions."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.max("o_totalprice").alias("top"))
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    p, top = F.col("p"), F.col("top")
    rel = F.when(p > 5, "RELEVANT").when(p > 3, "POSSIBLY_RELEVANT").when(p > 1, "BLOCKED").when(p > 0, "NOT_RELEVANT")
    el = F.when(top > 450000, "ELIGIBLE").when(top > 400000, "LIKELY_ELIGIBLE").when(top > 300000, "NEEDS_REVIEW")
    return rows.select("c_custkey", rules.decision(F.col("c_acctbal") < -900, rel, F.col("c_mktsegment") != "MACHINERY", el).alias("decision"))


@query("""
WITH g AS (SELECT l_orderkey, l_returnflag, count(CASE WHEN l_quantity > 5 THEN l_linestatus END) AS n, count_if(l_quantity > 5 AND l_discount > 0.08) AS open, count(DISTINCT CASE WHEN l_quantity > 5 THEN l_linestatus END) AS v, min(CASE WHEN l_quantity > 5 THEN l_linestatus END) AS one FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag, CASE WHEN n = 0 THEN 'MISSING' WHEN open > 0 THEN 'UNCONFIRMED' WHEN v > 1 THEN 'CONFLICT' WHEN one = 'F' THEN 'MATCH' ELSE 'NOT_MATCH' END AS status FROM g
""")
def q_predicate_status(spark, d):
    """Predicates over evidence."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.when(F.col("l_quantity") > 5, F.col("l_linestatus")).alias("value"), (F.col("l_discount") <= 0.08).alias("confirmed"), F.lit("F").alias("want"))
    return rules.resolved(rows, ["l_orderkey", "l_returnflag"], "value", "confirmed", "want")


@query("""
WITH g AS (SELECT o_custkey, year(o_orderdate) AS y, count_if(o_totalprice > 490000) AS review, count(DISTINCT o_orderstatus) AS v, count_if(o_orderpriority = '5-LOW') AS unknown FROM orders GROUP BY ALL)
SELECT o_custkey, y::INTEGER AS y, CASE WHEN review > 0 OR v > 1 THEN 'REVIEW' WHEN unknown > 0 THEN 'INSUFFICIENT' ELSE 'COMPLETE' END AS state FROM g
""")
def q_assertions(spark, d):
    """The state of sets of assertions."""
    status = F.when(F.col("o_totalprice") > 490000, "REVIEW").when(F.col("o_orderpriority") == "5-LOW", "UNKNOWN").otherwise("KNOWN")
    rows = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), status.alias("status"), F.col("o_orderstatus").alias("value"))
    return summary.assertion_status(rows, ["o_custkey", "y"], "status", "value")


@query("""
WITH t AS (SELECT doc_id, lang, regexp_extract(lower(text), '(?:^|[^a-z])(and|of|und|der|et|la|y|de)(?:[^a-z]|$)', 1) AS token FROM documents)
SELECT doc_id, CASE WHEN token = 'and' AND lang = 'en' THEN 'AND' WHEN token = 'la' AND lang = 'fr' THEN 'BOUNDARY' WHEN token = 'und' THEN 'AND' WHEN token = 'de' THEN 'OF' ELSE 'UNRESOLVED' END AS meaning FROM t
""")
def q_connector(spark, d):
    """What a connecting word means in its context (K5)."""
    token = F.regexp_extract(F.lower("text"), r"(?:^|[^a-z])(and|of|und|der|et|la|y|de)(?:[^a-z]|$)", 1)
    meanings = [("and", "en", "AND"), ("la", "fr", "BOUNDARY"), ("und", "*", "AND"), ("de", "*", "OF")]
    return table(spark, d, "documents").select("doc_id", rules.connector(token, F.col("lang"), meanings).alias("meaning"))


@query("""
WITH l AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 250000 THEN 2 ELSE 0 END END) AS a, max(CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_totalprice > 400000 THEN 2 ELSE 0 END END) AS b, max(CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice > 480000 THEN 2 ELSE 0 END END) AS c FROM orders GROUP BY o_custkey)
SELECT o_custkey AS tree, greatest(least(coalesce(a, 1), coalesce(b, 1)), 2 - coalesce(c, 1))::INTEGER AS level FROM l
""")
def q_logic_tree(spark, d):
    """(F AND O) OR NOT P for every customer, from the leaves up."""
    level = F.when(F.col("o_totalprice") > F.element_at(F.create_map(F.lit("F"), F.lit(250000.0), F.lit("O"), F.lit(400000.0), F.lit("P"), F.lit(480000.0)), F.col("o_orderstatus")), 2).otherwise(0)
    leaves = table(spark, d, "orders").select(F.col("o_custkey").alias("tree"), F.col("o_orderstatus").alias("node"), level.alias("level")).groupBy("tree", "node").agg(F.max("level").alias("level"))
    shape = [("root", None, "OR"), ("both", "root", "AND"), ("not", "root", "NOT"), ("F", "both", "LEAF"), ("O", "both", "LEAF"), ("P", "not", "LEAF")]
    one = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(p).cast("string").alias("parent"), F.lit(o).alias("operator")) for n, p, o in shape])
    nodes = leaves.select("tree").distinct().select("tree", F.inline(one))
    return logic.levels(nodes, leaves).where("node = 'root'").select("tree", "level")


@query("""
WITH c AS (SELECT *, floor(c_acctbal / 1000)::BIGINT AS band FROM customer)
SELECT a.c_custkey AS l, b.c_custkey AS r, CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'SEPARATE' WHEN a.band <> b.band THEN 'SEPARATE' ELSE 'MERGE' END AS decision,
  CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'SEGMENT_DIFFERS' WHEN a.band <> b.band THEN 'BALANCE_DIFFERS' END AS reason
FROM c a JOIN c b ON a.c_custkey < b.c_custkey AND a.c_nationkey = b.c_nationkey AND a.c_custkey // 50 = b.c_custkey // 50
""")
def q_pair_resolve(spark, d):
    """Pair decisions with their first reason, inside blocks of a nation and fifty keys."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("band"), F.floor(F.col("c_custkey") / 50).alias("fifty"))
    pairs = resolve.blocked_pairs(rows, "c_custkey", ["c_nationkey", "fifty"])
    decided, reason = resolve.pair_decision([("SEGMENT", F.col("l_c_mktsegment"), F.col("r_c_mktsegment")), ("BALANCE", F.col("l_band"), F.col("r_band"))])
    return pairs.select(F.col("l_c_custkey").alias("l"), F.col("r_c_custkey").alias("r"), decided.alias("decision"), reason.alias("reason"))


@query("""
WITH RECURSIVE m AS (SELECT c_custkey AS id, c_nationkey || '/' || (c_custkey // 50) AS c, c_acctbal AS v FROM customer),
r AS (SELECT m.id, m.c, row_number() OVER (PARTITION BY m.c ORDER BY m.id) AS n, (SELECT list(o.id) FROM m o WHERE o.c = m.c AND o.id < m.id AND abs(o.v - m.v) <= 2000) AS near FROM m),
step(c, n, groups) AS (
  SELECT DISTINCT c, 0::BIGINT, []::BIGINT[][] FROM m
  UNION ALL
  SELECT c, n, CASE WHEN k IS NULL OR k = 0 THEN list_append(groups, [id]) ELSE list_transform(groups, lambda g, i: CASE WHEN i = k THEN list_append(g, id) ELSE g END) END
  FROM (SELECT r.c, r.n, r.id, s.groups, list_position(list_transform(s.groups, lambda g: list_has_all(coalesce(r.near, []), g)), true) AS k FROM step s JOIN r ON r.c = s.c AND r.n = s.n + 1)),
whole AS (SELECT c, unnest(groups) AS g FROM step QUALIFY n = max(n) OVER (PARTITION BY c))
SELECT unnest(g) AS id, g[1] AS group_id FROM whole
""")
def q_complete_link(spark, d):
    """Complete-link groups of those pairs whose balances lie within 2000, greedy in id order."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.floor(F.col("c_custkey") / 50).alias("fifty"))
    rows = rows.withColumn("component", F.concat_ws("/", "c_nationkey", "fifty"))
    pairs = resolve.blocked_pairs(rows, "c_custkey", ["component"]).where(F.abs(F.col("l_c_acctbal") - F.col("r_c_acctbal")) <= 2000)
    return resolve.complete_link(rows, pairs.select(F.col("l_component").alias("component"), F.col("l_c_custkey").alias("l"), F.col("r_c_custkey").alias("r")), "c_custkey", "component")


@query("""
SELECT source, arg_min(doc_id, (CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, doc_id)) AS doc_id, arg_min(lang, (CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, doc_id)) AS lang FROM documents GROUP BY source
""")
def q_authority(spark, d):
    """The row of the highest authority of each group."""
    return resolve.best_by_authority(table(spark, d, "documents").select("source", "doc_id", "lang"), "source", "lang", "doc_id", ["de", "fr"])


@query("""
WITH k AS (SELECT DISTINCT s_suppkey AS id, x FROM (SELECT s_suppkey, unnest([s_name, 'N' || s_nationkey]) AS x FROM supplier)), one AS (SELECT x, min(id) AS id FROM k GROUP BY x HAVING count(*) = 1)
SELECT c_custkey, id AS organization_id FROM customer LEFT JOIN one ON x = 'N' || c_nationkey
""")
def q_alias(spark, d):
    """The one organisation of a name or alias."""
    organisations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("organization_id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("N"), "s_nationkey")).alias("aliases"))
    names = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("asked"))
    return q.by_name_or_alias(names, organisations, "asked").select("c_custkey", "organization_id")


@query("""
WITH r AS (SELECT role AS category, conv_id || '/' || turn AS rule, regexp_replace(substr(text, 3 + conv_id % 20, 7), '[^a-z]', '.', 'g') || '[a-z]*(ed|ly|en)[ .,]' AS pattern FROM conversations)
SELECT DISTINCT doc_id, category, rule FROM documents, r WHERE regexp_matches(text, pattern, 's')
""")
def q_many_rules(spark, d):
    """Texts against a table of patterns, those first whose literals occur."""
    turns = table(spark, d, "conversations")
    part = F.substr("text", (3 + F.col("conv_id") % 20).cast("int"), F.lit(7))
    made = turns.select(F.col("role").alias("category"), F.concat_ws("/", "conv_id", "turn").alias("rule"), F.concat(F.regexp_replace(part, "[^a-z]", "(?s:.)"), F.lit("[a-z]*(ed|ly|en)[ .,]")).alias("pattern"))
    return patterns.many_findings(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", made)
