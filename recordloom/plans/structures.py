"""Logic trees of any depth, branch sets, and the shape and ownership of structured sets over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import logic
from ..sources.stored import dealt, stored
from .tables import query, table


def _nodes(spark, d, owner: str, parent: str) -> DataFrame:
    """Orders as nodes: tree, i (from 1, by key), m (nodes of the tree), parent by the given rule, and the order."""
    w = Window.partitionBy("tree")
    rows = table(spark, d, "orders").select(F.expr(owner).alias("tree"), "o_orderkey", "o_orderpriority", "o_totalprice")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("o_orderkey")), "m": F.count("*").over(w)})
    return rows.withColumn("parent", F.expr(parent))


DEEP_PARENT = "CASE WHEN i > 1 THEN greatest(1, i - 1 - CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END) END"


def _deep(spark, d) -> tuple[DataFrame, DataFrame]:
    """Trees of the orders of three customers each, of up to forty storeys, and their leaves."""
    rows = _nodes(spark, d, "o_custkey div 3", DEEP_PARENT)
    below = rows.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("i")).agg(F.count("*").alias("c"))
    rows = rows.join(below, ["tree", "i"], "left")
    p = F.substring("o_orderpriority", 1, 1)
    operator = F.when(F.col("c").isNull(), "LEAF").when((p == "5") & (F.col("c") == 1), "NOT").when(p.isin("3", "4"), "OR").otherwise("AND")
    nodes = rows.select("tree", F.col("i").alias("node"), "parent", operator.alias("operator"))
    leaves = rows.where("c IS NULL AND o_orderkey % 7 <> 0").select("tree", F.col("i").alias("node"), F.when(F.col("o_totalprice") > 150000, 2).otherwise(0).alias("level"))
    return nodes, leaves


#: The same trees, folded one node after the other from the last to the first: a node comes after its parent, so its children are folded before it.
DEEP_SQL = """
WITH RECURSIVE o AS (SELECT o_custkey // 3 AS tree, o_orderkey, o_orderpriority[1] AS p, o_totalprice, row_number() OVER (PARTITION BY o_custkey // 3 ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey // 3) AS m FROM orders),
n AS (SELECT *, CASE WHEN i > 1 THEN greatest(1, i - 1 - CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END) END AS parent FROM o),
fold(tree, i, m, level, acc) AS (
  SELECT tree, m + 1, m, NULL::INTEGER, list_transform(range(m), lambda x: {'least': 2, 'most': 0, 'n': 0}) FROM n WHERE i = 1
  UNION ALL
  SELECT tree, i, m, level, CASE WHEN parent IS NULL THEN acc ELSE list_transform(acc, lambda x, k: CASE WHEN k = parent THEN {'least': least(x.least, level), 'most': greatest(x.most, level), 'n': x.n + 1} ELSE x END) END
  FROM (SELECT n.tree, n.i, n.m, n.parent, f.acc, (CASE WHEN f.acc[n.i].n = 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_totalprice > 150000 THEN 2 ELSE 0 END
    WHEN p = '5' AND f.acc[n.i].n = 1 THEN 2 - f.acc[n.i].least WHEN p IN ('3', '4') THEN f.acc[n.i].most ELSE f.acc[n.i].least END)::INTEGER AS level
    FROM fold f JOIN n ON n.tree = f.tree AND n.i = f.i - 1)),
levels AS (SELECT tree, i, level FROM fold WHERE level IS NOT NULL)
"""


@query(DEEP_SQL + "SELECT tree, i::INTEGER AS node, level FROM levels")
def q_deep_trees(spark, d):
    """Every node of trees of many storeys, from the leaves up."""
    return logic.levels(*_deep(spark, d))


@query(DEEP_SQL + """,
r AS (SELECT tree AS t, level FROM levels WHERE i = 1),
c AS (SELECT t.t, 1 AS condition, t.t % 11 <> 0 AS resolved, t.t % 5 <> 0 AS mandatory, CASE WHEN t.t % 3 = 0 THEN coalesce(a.level, 1) ELSE 2 END AS about, t.level AS own FROM r t LEFT JOIN r a ON a.t = t.t + 1
  UNION ALL SELECT t.t, 2, true, true, 2, CASE coalesce(w.level, 1) WHEN 2 THEN coalesce(y.level, 1) WHEN 0 THEN CASE WHEN t.t % 2 = 0 THEN coalesce(z.level, 1) ELSE 2 END ELSE 1 END
  FROM r t LEFT JOIN r w ON w.t = t.t + 1 LEFT JOIN r y ON y.t = t.t + 2 LEFT JOIN r z ON z.t = t.t + 3),
v AS (SELECT t, CASE WHEN NOT resolved THEN 1 WHEN NOT mandatory THEN 2 WHEN about = 0 THEN 2 WHEN about = 1 THEN 1 ELSE own END AS level FROM c)
SELECT t AS owner, CASE WHEN max(level = 1) THEN 'INSUFFICIENT' WHEN min(level) = 2 THEN 'MATCH' ELSE 'NOT_MATCH' END AS result FROM v GROUP BY t
""")
def q_branch_outcomes(spark, d):
    """Requirement sets with a plain condition and a WHEN/THEN/ELSE one each, over trees of many storeys."""
    # written once: what follows reads it nine times, and each time else every storey's table
    roots = stored(logic.levels(*_deep(spark, d)).where("node = 1").select("tree", "level"), "roots")
    t, none = F.col("tree"), F.lit(None).cast("long")
    plain = roots.select(t.alias("owner"), F.lit(1).alias("condition"), (t % 11 != 0).alias("resolved"), F.when(t % 5 != 0, "MANDATORY").otherwise("PREFERRED").alias("modality"), F.when(t % 3 == 0, t + 1).alias("applies"), "tree", none.alias("branch"))
    split = roots.select(t.alias("owner"), F.lit(2).alias("condition"), F.lit(True).alias("resolved"), F.lit("MANDATORY").alias("modality"), none.alias("applies"), none.alias("tree"), t.alias("branch"))
    branches = roots.select(t.alias("branch"), (t + 1).alias("when_tree"), (t + 2).alias("then_tree"), F.when(t % 2 == 0, t + 3).alias("else_tree"))
    outcomes = logic.condition_outcomes(plain.unionByName(split), roots, branches)
    return logic.set_results(outcomes, roots.select(t.alias("owner")), "owner").select("owner", "result")


GRAPH_PARENT = "nullif((o_orderkey * 7 + i * 3) % (m + 1), 0)"


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS t, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS m, o_orderpriority[1] AS p FROM orders),
n AS (SELECT t, i, nullif((k * 7 + i * 3) % (m + 1), 0) AS parent, CASE p WHEN '1' THEN 'AND' WHEN '2' THEN 'OR' WHEN '3' THEN 'NOT' ELSE 'LEAF' END AS op, CASE WHEN p IN ('4', '5') THEN k % 6 END AS fact, CASE WHEN k % 13 = 0 THEN -1 ELSE k % 40 END AS pos FROM o),
reach AS (SELECT t, i, parent AS at FROM n WHERE parent IS NOT NULL UNION SELECT r.t, r.i, n.parent FROM reach r JOIN n ON n.t = r.t AND n.i = r.at WHERE n.parent IS NOT NULL),
ends AS (SELECT t, i FROM n WHERE parent IS NULL UNION SELECT r.t, r.i FROM reach r JOIN n ON n.t = r.t AND n.i = r.at WHERE n.parent IS NULL),
c AS (SELECT t, parent AS i, count(*) AS c FROM n GROUP BY ALL),
x AS (SELECT n.*, coalesce(c, 0) AS c, u.op AS above, min(CASE WHEN n.op = 'LEAF' THEN n.i END) OVER (PARTITION BY n.t, n.fact) AS first, min(CASE WHEN n.parent IS NULL THEN n.i END) OVER (PARTITION BY n.t) AS root, count(*) OVER (PARTITION BY n.t, n.pos) AS placed
  FROM n LEFT JOIN c ON c.t = n.t AND c.i = n.i LEFT JOIN n u ON u.t = n.t AND u.i = n.parent),
f AS (SELECT t, i, 'DISCONNECTED' AS fault FROM x WHERE parent IS NULL AND i <> root
  UNION ALL SELECT t, i, 'NO_CHILDREN' FROM x WHERE op <> 'LEAF' AND c = 0 UNION ALL SELECT t, i, 'INVALID_UNARY_GROUP' FROM x WHERE op IN ('AND', 'OR') AND c = 1
  UNION ALL SELECT t, i, 'INVALID_NOT' FROM x WHERE op = 'NOT' AND c > 1 UNION ALL SELECT t, i, 'DOUBLE_NEGATION' FROM x WHERE op = 'NOT' AND above = 'NOT'
  UNION ALL SELECT t, i, 'DUPLICATE_LEAF' FROM x WHERE op = 'LEAF' AND i <> first UNION ALL SELECT t, i, 'SOURCE_ORDER' FROM x WHERE pos < 0 OR placed > 1
  UNION ALL SELECT t, i, CASE WHEN EXISTS (SELECT 1 FROM reach r WHERE r.t = n.t AND r.i = n.i AND r.at = n.i) THEN 'CYCLE_DETECTED' ELSE 'DISCONNECTED' END FROM n WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.t = n.t AND e.i = n.i))
SELECT t AS tree, i::INTEGER AS node, fault FROM f
""")
def q_tree_shapes(spark, d):
    """Cycles, what hangs behind them, and other faults of shape, in graphs where each node points to any other (K7)."""
    rows = _nodes(spark, d, "o_custkey", GRAPH_PARENT)
    p = F.substring("o_orderpriority", 1, 1)
    operator = F.when(p == "1", "AND").when(p == "2", "OR").when(p == "3", "NOT").otherwise("LEAF")
    fact = F.when(p.isin("4", "5"), F.col("o_orderkey") % 6)
    position = F.when(F.col("o_orderkey") % 13 == 0, -1).otherwise(F.col("o_orderkey") % 40)
    nodes = rows.select("tree", F.col("i").alias("node"), F.col("parent").cast("int").alias("parent"), operator.alias("operator"), fact.alias("fact"), position.alias("position"))
    return logic.shape_faults(nodes)


@query("""
WITH i AS (SELECT l_orderkey AS o, l_returnflag AS kind, l_partkey % 4 AS id, min(l_linenumber % 3) AS c, min(l_linestatus) AS v, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
r AS (SELECT l_orderkey AS o, l_returnflag AS kind, l_suppkey % 4 AS id, l_linenumber % 3 AS c, l_linestatus AS v, l_discount < 0.08 AS owning FROM lineitem WHERE l_linenumber >= 2),
w AS (SELECT o, kind, id, count(*) AS owners FROM r WHERE owning GROUP BY ALL),
f AS (SELECT o, kind, id, 'DUPLICATE_ID' AS fault FROM i WHERE n > 1
  UNION SELECT i.o, i.kind, i.id, 'CROSS_CONDITION_REFERENCE' FROM i LEFT JOIN w ON w.o = i.o AND w.kind = i.kind AND w.id = i.id WHERE coalesce(owners, 0) <> 1
  UNION SELECT r.o, r.kind, r.id, CASE WHEN i.n IS NULL THEN 'DANGLING_REFERENCE' ELSE 'CROSS_CONDITION_REFERENCE' END FROM r LEFT JOIN i ON i.o = r.o AND i.kind = r.kind AND i.id = r.id WHERE i.n IS NULL OR i.c <> r.c
  UNION SELECT r.o, r.kind, r.id, 'CROSS_OPPORTUNITY_REFERENCE' FROM r JOIN i ON i.o = r.o AND i.kind = r.kind AND i.id = r.id WHERE i.v <> r.v)
SELECT o AS owner, kind, id, fault FROM f
""")
def q_registry_ownership(spark, d):
    """Registries' entries and what refers to them: twice, dangling, of another condition or version, without one owner (K7)."""
    lines = table(spark, d, "lineitem")
    items = lines.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("owner"), F.col("l_linestatus").alias("version"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 4).alias("id"), (F.col("l_linenumber") % 3).alias("condition"))
    references = lines.where("l_linenumber >= 2").select(F.col("l_orderkey").alias("owner"), F.col("l_linestatus").alias("version"), F.col("l_returnflag").alias("kind"), (F.col("l_suppkey") % 4).alias("id"), (F.col("l_linenumber") % 3).alias("condition"), (F.col("l_discount") < 0.08).alias("owning"))
    return logic.registry_faults(items, references)


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS c, l_linenumber <> 3 AND l_orderkey % 3 > 0 AS due FROM lineitem),
r AS (SELECT l_orderkey AS o, CASE WHEN l_linenumber = 5 THEN 9 WHEN l_linenumber = 4 THEN 2 ELSE l_linenumber END AS c FROM lineitem WHERE l_orderkey % 3 > 0 OR l_linenumber > 3),
n AS (SELECT o, c, count(*) AS n FROM r GROUP BY ALL),
f AS (SELECT n.o, 'DANGLING_REFERENCE' AS fault FROM n LEFT JOIN c ON c.o = n.o AND c.c = n.c WHERE c.c IS NULL
  UNION SELECT n.o, 'MANDATORY_ROOT_MISMATCH' FROM n LEFT JOIN c ON c.o = n.o AND c.c = n.c WHERE n.n > 1 OR NOT due
  UNION SELECT c.o, 'MANDATORY_ROOT_MISMATCH' FROM c LEFT JOIN n ON c.o = n.o AND c.c = n.c WHERE due AND n.c IS NULL
  UNION SELECT o, 'INVALID_UNARY_GROUP' FROM r GROUP BY o HAVING count(*) < 2)
SELECT o AS owner, fault FROM f
""")
def q_mandatory_roots(spark, d):
    """Whether mandatory roots name every resolved mandatory condition once (K7)."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), "l_linenumber")
    conditions = dealt(lines, "owner", "l_linenumber").distinct().select("owner", F.col("l_linenumber").alias("condition"), F.when(F.col("owner") % 3 > 0, "MANDATORY").otherwise("PREFERRED").alias("modality"), (F.col("l_linenumber") != 3).alias("resolved"))
    named = F.when(F.col("l_linenumber") == 5, 9).when(F.col("l_linenumber") == 4, 2).otherwise(F.col("l_linenumber"))
    roots = lines.where("owner % 3 > 0 OR l_linenumber > 3").select("owner", F.lit("AND").alias("kind"), named.alias("condition"))
    return logic.root_faults(roots, conditions)
