"""Logic trees of any depth and size, by rounds over rows: what they come to (L5), and where their nodes lead (K7).

No tree is gathered in one row.  Every round writes its table and reads it
back, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kleene
from ..sources.stored import dealt, forget, merged, stored

#: Rounds after which the settled nodes of the rounds before are put together in one table.
GATHER = 16


def levels(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """tree, node, level of every node, from the leaves up, one join and one aggregation a storey until nothing is open.

    nodes: tree, node, parent (null at the root), operator (AND, OR, NOT, LEAF);
    leaves: tree, node, level.  A group waits until all of its children are
    settled; their minima and maxima are combined before the shuffle, so a node
    of very many children is no hot key.  UNKNOWN are leaves without a level,
    groups without children, and what waits for a cycle.  A null tree or node
    meets nothing.  Rounds are as many as the highest tree has storeys.
    """
    spare = nodes.select("tree", "node", "parent", "operator")
    below = spare.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("wait"))
    known = leaves.select("tree", "node", F.col("level").cast("int").alias("level"))
    leaf, none = F.col("operator") == "LEAF", F.coalesce("wait", F.lit(0)) == 0
    level = F.when(leaf, F.coalesce("level", F.lit(kleene.UNKNOWN))).when(none, F.lit(kleene.UNKNOWN))
    rows = spare.join(merged(known), ["tree", "node"], "left").join(merged(below), ["tree", "node"], "left")
    state = stored(rows.select("tree", "node", "parent", "operator", F.coalesce("wait", F.lit(0)).alias("wait"), F.lit(kleene.TRUE).alias("least"), F.lit(kleene.FALSE).alias("most"), level.alias("level")), "storey")
    settled: list[DataFrame] = []
    while True:
        counts = state.agg(F.count_if(F.col("level").isNull()), F.count_if(F.col("level").isNotNull())).first()
        if not counts[0] or not counts[1]:
            break
        settled.append(state)
        told = state.where("level IS NOT NULL AND parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node"))
        told = told.agg(F.min("level").alias("__least"), F.max("level").alias("__most"), F.count("*").alias("__n"))
        rows = state.where("level IS NULL").drop("level").join(merged(told), ["tree", "node"], "left")
        rows = rows.withColumns({"wait": F.col("wait") - F.coalesce("__n", F.lit(0)), "least": F.least("least", "__least"), "most": F.greatest("most", "__most")})
        made = F.when(F.col("operator") == "AND", F.col("least")).when(F.col("operator") == "OR", F.col("most")).otherwise(kleene.negated(F.col("least")))
        state = stored(rows.select("tree", "node", "parent", "operator", "wait", "least", "most", F.when(F.col("wait") == 0, made).alias("level")), "storey")
        if len(settled) == GATHER:
            settled = [_gathered(settled)]
    out = _settled([*settled, state])
    return out.withColumn("level", F.coalesce("level", F.lit(kleene.UNKNOWN)))


def _settled(tables: list[DataFrame]) -> DataFrame:
    """Settled nodes of all rounds and, of the last one, those that stay open."""
    out = tables[-1].select("tree", "node", "level")
    for table in tables[:-1]:
        out = out.unionAll(table.where("level IS NOT NULL").select("tree", "node", "level"))
    return out


def _gathered(tables: list[DataFrame]) -> DataFrame:
    whole = None
    for table in tables:
        part = table.where("level IS NOT NULL").select("tree", "node", "level")
        whole = part if whole is None else whole.unionAll(part)
    out = stored(whole, "settled")
    forget(*tables)
    return out


def endless(nodes: DataFrame) -> DataFrame:
    """tree, node, on_cycle of nodes from which no root is reached: those on a cycle and those that lead to one (K7).

    Pointers double: each round a node's pointer becomes that of the node it
    points to, so after k rounds it is its ancestor of 2**k steps, and a
    pointer past a root is null.  When the steps exceed the largest tree, what
    still points anywhere leads to a cycle, and exactly the nodes pointed to
    are on one.  A chain of a million nodes takes twenty rounds.  Of several
    rows of a node the least parent counts; a parent that is not there ends the
    walk as a root does.
    """
    n = nodes.where("tree IS NOT NULL AND node IS NOT NULL").groupBy("tree", "node").agg(F.min("parent").alias("to"))
    # rows whose walk has ended are left out: what points to one finds nothing, so its own walk ends
    there = n.select("tree", F.col("node").alias("to"))
    state = stored(n.where("to IS NOT NULL").join(merged(there), ["tree", "to"], "left_semi").select("tree", "node", "to"), "pointers")
    largest = (state.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) + 1
    steps = 1
    while steps < largest and not state.isEmpty():
        further = state.select("tree", F.col("node").alias("to"), F.col("to").alias("__further"))
        done = state
        state = stored(state.join(merged(further), ["tree", "to"]).select("tree", "node", F.col("__further").alias("to")), "pointers")
        forget(done)
        steps *= 2
    on = state.select("tree", F.col("to").alias("node"), F.lit(True).alias("__on")).distinct()
    return state.select("tree", "node").join(on, ["tree", "node"], "left").select("tree", "node", F.coalesce("__on", F.lit(False)).alias("on_cycle"))


def condition_outcomes(conditions: DataFrame, roots: DataFrame, branches: DataFrame) -> DataFrame:
    """conditions with `level` and `has_unknown`: what each condition of a requirement set comes to.

    conditions: owner, condition, resolved, modality, applies (tree that says
    whether it is about the candidate, null: about all), tree or branch (what it
    asks).  branches: branch, when_tree, then_tree, else_tree (null: nothing is
    asked otherwise).  roots: tree, level.  An unresolved condition is UNKNOWN;
    one that is not MANDATORY, or not about the candidate, is TRUE, and UNKNOWN
    where that is unknown.  Of a branch set WHEN picks THEN or ELSE and leaves
    UNKNOWN what it leaves open.  A tree or branch that is not there is UNKNOWN.
    """
    at = lambda name: roots.select(F.col("tree").alias(name), F.col("level").alias(f"__{name}"))
    sets = branches.select("branch", "when_tree", "then_tree", "else_tree")
    for name in ("when_tree", "then_tree", "else_tree"):
        sets = sets.join(at(name), name, "left")
    value = lambda name: F.coalesce(F.col(f"__{name}"), F.lit(kleene.UNKNOWN))
    other = F.when(F.col("else_tree").isNull(), F.lit(kleene.TRUE)).otherwise(value("else_tree"))
    asked = F.when(value("when_tree") == kleene.TRUE, value("then_tree")).when(value("when_tree") == kleene.FALSE, other).otherwise(F.lit(kleene.UNKNOWN))
    rows = conditions.join(at("tree"), "tree", "left").join(at("applies"), "applies", "left").join(sets.select("branch", asked.alias("__asked")), "branch", "left")
    about = F.when(F.col("applies").isNull(), F.lit(kleene.TRUE)).otherwise(value("applies"))
    own = F.when(F.col("branch").isNotNull(), F.coalesce("__asked", F.lit(kleene.UNKNOWN))).otherwise(value("tree"))
    level = (
        F.when(~F.coalesce("resolved", F.lit(False)), F.lit(kleene.UNKNOWN))
        .when(~F.col("modality").eqNullSafe("MANDATORY"), F.lit(kleene.TRUE))
        .when(about == kleene.FALSE, F.lit(kleene.TRUE))
        .when(about == kleene.UNKNOWN, F.lit(kleene.UNKNOWN))
        .otherwise(own)
    )
    names = [F.col(c) for c in conditions.columns if c not in ("level", "has_unknown")]
    return rows.select(*names, level.alias("level"), (level == kleene.UNKNOWN).alias("has_unknown"))


def set_results(outcomes: DataFrame, sets: DataFrame, owner: str) -> DataFrame:
    """owner, result, reasons: MATCH and NOT_MATCH only where no condition is unknown, else INSUFFICIENT; a set without conditions asks nothing."""
    g = outcomes.groupBy(owner).agg(F.min("level").alias("level"), F.max("has_unknown").alias("unknown"))
    rows = sets.select(owner).distinct().join(g, owner, "left")
    level, unknown = F.coalesce("level", F.lit(kleene.TRUE)), F.coalesce("unknown", F.lit(False))
    result = F.when((level == kleene.TRUE) & ~unknown, "MATCH").when((level == kleene.FALSE) & ~unknown, "NOT_MATCH").otherwise("INSUFFICIENT")
    reasons = F.when(result == "MATCH", F.array(F.lit("MANDATORY_REQUIREMENTS_SATISFIED"))).when(result == "NOT_MATCH", F.array(F.lit("PROVEN_MANDATORY_REQUIREMENT_NOT_SATISFIED")))
    return rows.select(owner, result.alias("result"), reasons.otherwise(F.array(F.lit("CANDIDATE_DATA_UNKNOWN"), F.lit("MAJOR_RELATION_NOT_ESTABLISHED"))).alias("reasons"))


def _named(rows: DataFrame, tests: list[tuple[Column, str]], *keys) -> DataFrame:
    found = F.filter(F.array(*[F.when(t, F.lit(f)) for t, f in tests]), lambda f: f.isNotNull())
    return rows.select(*keys, F.explode(found).alias("fault"))


def shape_faults(nodes: DataFrame) -> DataFrame:
    """tree, node, fault of trees' shapes (K7).

    nodes: tree, node, parent, operator, fact (of a leaf), position.
    DUPLICATE_ID: a node twice.  DANGLING_REFERENCE: its parent is not there.
    CYCLE_DETECTED: on a cycle; DISCONNECTED: behind one, or a root beside the
    one that sorts first.  NO_CHILDREN, INVALID_UNARY_GROUP: an AND or OR of
    one; INVALID_NOT: a NOT of several.  DOUBLE_NEGATION: a NOT right below a
    NOT.  DUPLICATE_LEAF: a fact that an earlier leaf of the tree has.
    SOURCE_ORDER: a position that is negative, null or not the only one.
    """
    n = nodes.groupBy("tree", "node").agg(*[F.min(c).alias(c) for c in ("parent", "operator", "fact", "position")], F.count("*").alias("n"))
    up = n.select("tree", F.col("node").alias("parent"), F.col("operator").alias("__above"), F.lit(True).alias("__up"))
    down = n.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("__children"))
    first = n.where("operator = 'LEAF' AND fact IS NOT NULL").groupBy("tree", "fact").agg(F.min("node").alias("__first"))
    root = n.where("parent IS NULL").groupBy("tree").agg(F.min("node").alias("__root"))
    placed = n.groupBy("tree", "position").agg(F.count("*").alias("__placed"))
    rows = n.join(up, ["tree", "parent"], "left").join(down, ["tree", "node"], "left").join(first, ["tree", "fact"], "left").join(root, "tree", "left").join(placed, ["tree", "position"], "left")
    kind, c = F.col("operator"), F.coalesce("__children", F.lit(0))
    tests = [
        (F.col("n") > 1, "DUPLICATE_ID"), (F.col("parent").isNotNull() & F.col("__up").isNull(), "DANGLING_REFERENCE"), (F.col("parent").isNull() & (F.col("node") != F.col("__root")), "DISCONNECTED"),
        ((kind != "LEAF") & (c == 0), "NO_CHILDREN"), (kind.isin("AND", "OR") & (c == 1), "INVALID_UNARY_GROUP"), ((kind == "NOT") & (c > 1), "INVALID_NOT"),
        ((kind == "NOT") & (F.col("__above") == "NOT"), "DOUBLE_NEGATION"), ((kind == "LEAF") & (F.col("node") != F.col("__first")), "DUPLICATE_LEAF"),
        (F.col("position").isNull() | (F.col("position") < 0) | (F.col("__placed") > 1), "SOURCE_ORDER"),
    ]
    lost = endless(nodes).select("tree", "node", F.when(F.col("on_cycle"), "CYCLE_DETECTED").otherwise("DISCONNECTED").alias("fault"))
    return _named(rows, tests, "tree", "node").unionByName(lost)


def registry_faults(items: DataFrame, references: DataFrame) -> DataFrame:
    """owner, kind, id, fault of registries and of what refers to their entries (K7).

    items: owner (a requirement set), version, kind, id, condition (that the
    entry belongs to; null: to none); references: owner, version (of the one
    that refers), kind, id, condition, owning (whether this reference owns).
    DUPLICATE_ID: an id twice in a registry; DANGLING_REFERENCE: no such entry;
    CROSS_CONDITION_REFERENCE: an entry of another condition, or one without
    exactly one owning reference; CROSS_OPPORTUNITY_REFERENCE: of another version.
    """
    key = ["owner", "kind", "id"]
    one = items.groupBy(*key).agg(F.count("*").alias("n"), F.min("condition").alias("__of"), F.min("version").alias("__version"))
    owners = references.where("owning").groupBy(*key).agg(F.count("*").alias("__owners"))
    entries = one.join(owners, key, "left")
    own = _named(entries, [(F.col("n") > 1, "DUPLICATE_ID"), (F.coalesce("__owners", F.lit(0)) != 1, "CROSS_CONDITION_REFERENCE")], *key)
    used = references.join(one, key, "left")
    there = F.col("n").isNotNull()
    wrong = _named(used, [(~there, "DANGLING_REFERENCE"), (there & (F.col("condition") != F.col("__of")), "CROSS_CONDITION_REFERENCE"), (there & (F.col("version") != F.col("__version")), "CROSS_OPPORTUNITY_REFERENCE")], *key)
    return own.unionByName(wrong).distinct()


def root_faults(roots: DataFrame, conditions: DataFrame) -> DataFrame:
    """owner, fault of sets' mandatory roots (K7): a root names every resolved mandatory condition once and no other.

    roots: owner, kind (AND, SINGLE, EMPTY), condition; conditions: owner,
    condition, modality, resolved.  MANDATORY_ROOT_MISMATCH, DANGLING_REFERENCE
    and INVALID_UNARY_GROUP (an AND of fewer than two).
    """
    named = dealt(roots.where("condition IS NOT NULL"), "owner", "condition").groupBy("owner", "condition").agg(F.count("*").alias("n"))
    due = F.coalesce((F.col("modality") == "MANDATORY") & F.col("resolved"), F.lit(False))
    known = conditions.select("owner", "condition", due.alias("due"))
    both = named.join(known, ["owner", "condition"], "full")
    mismatch = (F.coalesce("n", F.lit(0)) != F.when(F.col("due"), 1).otherwise(0)) & F.col("due").isNotNull()
    found = _named(both, [(F.col("due").isNull(), "DANGLING_REFERENCE"), (mismatch | (F.col("n") > 1), "MANDATORY_ROOT_MISMATCH")], "owner")
    few = roots.where("kind = 'AND'").groupBy("owner").agg(F.count("condition").alias("n")).where("n < 2").select("owner", F.lit("INVALID_UNARY_GROUP").alias("fault"))
    return found.unionByName(few).distinct()
