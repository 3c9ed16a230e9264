"""Ids of facts, evidence and observations."""

from pyspark.sql import functions as F

from recordloom.operators import requirements, tracing


def test_ids_follow_from_what_they_stand_for(spark):
    rows = [(1, "性别不限；限女", "v1"), (2, "性别不限；限女", "v1"), (3, None, "v1"), (4, " \n", "v1"), (5, "应届毕业生须硕士专业：法学、法律", "v1"), (None, "限女", "v1")]

    def of(version):
        found = requirements.parsed(spark.createDataFrame(rows, "id int, t string, v string"), "id", "t")
        facts = tracing.facts_with_evidence(found, F.lit(version))
        return sorted(facts.collect(), key=lambda r: (str(r.id), r.place, r.number)), sorted(tracing.observations(found, facts, F.lit(version)).collect(), key=lambda r: (str(r.id), r.place or 0))

    (facts, seen), (again, _), (other, _) = of("v1"), of("v1"), of("v2")
    assert [f.fact_id for f in facts] == [f.fact_id for f in again] and not {f.fact_id for f in facts} & {f.fact_id for f in other}
    assert len({f.fact_id for f in facts}) == len({f.evidence_id for f in facts}) == len(facts)
    text = dict((r[0], r[1]) for r in rows)
    assert all(text[f.id][f.start : f.end] == f.evidence_text for f in facts)
    two = [f for f in facts if f.id == 5]
    assert len(two) > 1 and len({f.group_id for f in two if f.fact.dimension == "MAJOR"}) == 1
    by = {(o.id, o.place): o for o in seen}
    assert by[1, 1].observed == "CONFIRMED" and by[1, 1].fact_ids == [f.fact_id for f in facts if (f.id, f.place) == (1, 1)] and by[1, 1].warning is None
    assert by[5, 1].fact_ids == [f.fact_id for f in two]
    assert {(o.id, o.observed, o.warning) for o in seen if o.id in (3, 4)} == {(3, "NOT_OBSERVED", "EMPTY_EVIDENCE_FRAGMENT"), (4, "NOT_OBSERVED", "EMPTY_EVIDENCE_FRAGMENT")}
    assert len({o.observation_id for o in seen}) == len(seen)


def test_nothing(spark):
    found = requirements.parsed(spark.createDataFrame([], "id int, t string"), "id", "t")
    facts = tracing.facts_with_evidence(found, F.lit("v"))
    assert facts.count() == 0 and tracing.observations(found, facts, F.lit("v")).count() == 0
