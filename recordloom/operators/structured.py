"""Flat facts as conditions of logic trees, and the checks that such sets must pass (K7, K8, K9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logic, requirements

# How a fact's scope selects credentials.
SCOPE_MODES = {"CANDIDATE": "CANDIDATE_WIDE", "BACHELOR": "SPECIFIC_DEGREE", "MASTER": "SPECIFIC_DEGREE", "DOCTOR": "SPECIFIC_DEGREE", "GRADUATE": "GRADUATE", "ANY_EDUCATION": "ANY_DEGREE"}
SCOPE_OTHERWISE = "ALL_DEGREES"
DEGREES = ("BACHELOR", "MASTER", "DOCTOR")


def applicability(scope: Column, cohorts: Column) -> Column:
    """struct(credential, degrees, state, cohorts): which credentials and which candidates a fact is about (K8)."""
    mode = F.coalesce(*[F.when(scope == s, F.lit(m)) for s, m in SCOPE_MODES.items()], F.lit(SCOPE_OTHERWISE))
    degrees = F.when(mode == "SPECIFIC_DEGREE", F.array(scope)).when(mode.isin("ANY_DEGREE", "ALL_DEGREES"), F.array(*map(F.lit, DEGREES)))
    return F.struct(mode.alias("credential"), degrees.alias("degrees"), F.when(cohorts.isNull(), "ALL_CANDIDATES").otherwise("COHORT_ANY_OF").alias("state"), cohorts.alias("cohorts"))


def conditions(found: DataFrame) -> DataFrame:
    """set, place, condition, fact, applicability: a condition for each fact of each clause; found is what requirements.parsed gives."""
    # the outer form: for the other one the optimiser puts the whole parse into a filter as well
    rows = found.select(F.col("id").alias("set"), "place", F.posexplode_outer("facts").alias("condition", "fact")).where("condition IS NOT NULL")
    return rows.withColumn("applicability", applicability(F.col("fact.scope"), F.col("fact.cohorts")))


def trees(conditions_: DataFrame) -> DataFrame:
    """tree, node, parent, operator: each set's root joins its clauses by AND, each clause its conditions by their own operator (K8).

    Nodes are text: r, then place, then place/condition; `logic.levels` evaluates them.
    """
    rows = conditions_.select(F.col("set").alias("tree"), F.col("place").cast("string").alias("place"), "condition", F.col("fact.logic").alias("logic"))
    groups = rows.groupBy("tree", "place").agg(F.max(F.when(F.col("logic") == "OR", "OR").otherwise("AND")).alias("operator"))
    leaves = rows.select("tree", F.concat_ws("/", "place", "condition").alias("node"), F.col("place").alias("parent"), F.lit("LEAF").alias("operator"))
    roots = groups.select("tree").distinct().select("tree", F.lit("r").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("AND").alias("operator"))
    return roots.unionByName(groups.select("tree", F.col("place").alias("node"), F.lit("r").alias("parent"), "operator")).unionByName(leaves)


def set_faults(nodes: DataFrame, registered: DataFrame) -> DataFrame:
    """tree, node, fault of sets of trees (K7).

    nodes: tree, node, parent, operator, owner, position; registered: node,
    owner of the conditions that leaves may name.  Faults: DUPLICATE_NODE,
    DANGLING_PARENT, DANGLING_LEAF, FOREIGN_OWNER (a leaf of another owner),
    NO_CHILDREN, NOT_ARITY (a NOT of several), ORDER (a child before its
    parent), and CYCLE_OR_DEPTH (its name; no depth is too great) for nodes on a
    cycle or behind one.  Trees may have any depth and size.
    """
    n = nodes.groupBy("tree", "node").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("operator").alias("operator"), F.min("owner").alias("owner"), F.min("position").alias("position"))
    up = n.select("tree", F.col("node").alias("parent"), F.col("position").alias("__before"), F.lit(True).alias("__up"))
    down = n.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("__children"))
    held = registered.select("node", F.col("owner").alias("__owner"), F.lit(True).alias("__held"))
    rows = n.join(up, ["tree", "parent"], "left").join(down, ["tree", "node"], "left").join(held, "node", "left")
    leaf, c = F.col("operator") == "LEAF", F.coalesce("__children", F.lit(0))
    tests = [
        (F.col("n") > 1, "DUPLICATE_NODE"), (F.col("parent").isNotNull() & F.col("__up").isNull(), "DANGLING_PARENT"), (leaf & F.col("__held").isNull(), "DANGLING_LEAF"),
        (leaf & (F.col("owner") != F.col("__owner")), "FOREIGN_OWNER"), (~leaf & (c == 0), "NO_CHILDREN"), ((F.col("operator") == "NOT") & (c > 1), "NOT_ARITY"), (F.col("position") < F.col("__before"), "ORDER"),
    ]
    plain = rows.select("tree", "node", F.explode(F.filter(F.array(*[F.when(t, F.lit(f)) for t, f in tests]), lambda f: f.isNotNull())).alias("fault"))
    lost = logic.endless(nodes).select("tree", "node", F.lit("CYCLE_OR_DEPTH").alias("fault"))
    return plain.unionByName(lost)


def projected(surfaces: DataFrame, bindings: DataFrame, owner: str, surface: str, material: str, text: str) -> DataFrame:
    """owner, status, conditions, blockers of approved sources (K9): material surfaces become fragments, these are parsed, and the facts conditions.

    A material surface without a binding, or with several, blocks its owner, as
    does a clause that is not understood; then no conditions are given.
    """
    bound = bindings.groupBy(owner, surface).agg(F.count("*").alias("__n"), F.min(text).alias("__text"))
    rows = surfaces.where(material).select(owner, surface).join(bound, [owner, surface], "left")
    unbound = rows.groupBy(owner).agg(F.count_if(F.coalesce("__n", F.lit(0)) != 1).alias("unbound"))
    found = requirements.parsed(rows.where("__n = 1").select(F.struct(owner, surface).alias("id"), "__text"), "id", "__text")
    g = found.groupBy(F.col(f"id.{owner}").alias(owner)).agg(F.sum(F.size("facts")).alias("facts"), F.count_if(~F.col("status").isin("FACT", "PREFERRED")).alias("unclear"))
    out = unbound.join(g, owner, "left")
    blockers = F.filter(F.array(F.when(F.col("unbound") > 0, "SURFACE_UNBOUND"), F.when(F.coalesce("unclear", F.lit(0)) > 0, "CLAUSE_UNCLEAR"), F.when(F.coalesce("facts", F.lit(0)) == 0, "NO_FACTS")), lambda b: b.isNotNull())
    status = F.when(F.size(blockers) == 0, "STRUCTURED").otherwise("BLOCKED")
    return out.select(owner, status.alias("status"), F.when(F.size(blockers) == 0, F.col("facts")).otherwise(F.lit(0)).alias("conditions"), blockers.alias("blockers"))
