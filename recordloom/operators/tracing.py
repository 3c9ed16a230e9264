"""Ids that lead from facts back to the text: facts, their evidence and the observation of every clause (K1).

Each id is the hash of what it stands for, in canonical form, so that the same
text, read again by the same rules, has the same ids, and any other has others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon

# What a clause's status is called as an observation, and the warning that goes with it.
STATUSES = {"FACT": "CONFIRMED", "FACT_AND_GAP": "CONFIRMED", "PREFERRED": "PREFERRED", "AMBIGUOUS": "AMBIGUOUS", "GAP": "UNPARSED_CLAUSE", "UNPARSED": "UNPARSED_CLAUSE", "NOT_OBSERVED": "NOT_OBSERVED"}
WARNINGS = {"NOT_OBSERVED": "EMPTY_EVIDENCE_FRAGMENT", "UNPARSED": "UNPARSED_CLAUSE", "GAP": "UNPARSED_CLAUSE", "FACT_AND_GAP": "UNPARSED_CLAUSE", "PREFERRED": "PREFERRED_QUALIFICATION_NOT_MANDATORY"}


def _id(prefix: str, **parts: Column) -> Column:
    """The hash of the parts that are there, keys in order at every level."""
    return F.concat(F.lit(f"{prefix}:"), canon.canonical_hash(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))))


def _mapped(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(value == a, F.lit(b)) for a, b in names.items()])


def facts_with_evidence(found: DataFrame, version: Column) -> DataFrame:
    """id, place, number, fact, fact_id, group_id, evidence_id, start, end, evidence_text: a row for each fact of each clause.

    found is what requirements.parsed gives; version names what the facts are
    about.  number counts a clause's facts from 0; facts of one clause that are
    joined alike share a group.  Equal texts under different ids have ids of
    their own; a fragment without an id is told from others by nothing.
    """
    rows = found.select("id", "place", "clause", "start", "end", version.cast("string").alias("__version"), F.posexplode_outer("facts").alias("number", "fact")).where("number IS NOT NULL")
    fragment, index = F.col("id").cast("string"), F.col("place") - 1
    about = {"opportunity_version_id": F.col("__version"), "evidence_fragment_id": fragment, "clause_index": index}
    rows = rows.withColumns({"fact_id": _id("requirement-fact", **about, draft_index=F.col("number"), draft=F.col("fact")), "group_id": _id("logic-group", **about, operator=F.col("fact.logic"))})
    proof = _id("requirement-evidence", requirement_fact_id=F.col("fact_id"), evidence_fragment_id=fragment, start_offset=F.col("start"), end_offset=F.col("end"))
    return rows.select("id", "place", "number", "fact", "fact_id", "group_id", proof.alias("evidence_id"), "start", "end", F.col("clause").alias("evidence_text"))


def observations(found: DataFrame, facts: DataFrame, version: Column) -> DataFrame:
    """id, place, status, fact_ids, observation_id, warning: one row for each clause, and for each fragment without text.

    facts: what facts_with_evidence gives for the same clauses and version.
    """
    ids = facts.groupBy(F.col("id").alias("__id"), F.col("place").alias("__place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "fact_id"))), lambda x: x["fact_id"]).alias("__facts"))
    rows = found.select("id", "place", "status", version.cast("string").alias("__version"))
    rows = rows.join(ids, rows["id"].eqNullSafe(ids["__id"]) & (rows["place"] == ids["__place"]), "left").withColumn("fact_ids", F.coalesce("__facts", F.array().cast("array<string>")))
    status = _mapped(F.col("status"), STATUSES)
    made = _id("requirement-observation", opportunity_version_id=F.col("__version"), evidence_fragment_id=F.col("id").cast("string"), clause_index=F.coalesce(F.col("place") - 1, F.lit(0)), status=status, fact_ids=F.col("fact_ids"))
    return rows.select("id", "place", status.alias("observed"), "fact_ids", made.alias("observation_id"), _mapped(F.col("status"), WARNINGS).alias("warning"))
