import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import diff, evidence, folds, gates, predicates, query, requirements, resolve, structured

DIRECTORY = "struct<namespace:string,version:string>"


def facts_of(spark, text, directory=None):
    df = spark.createDataFrame([(1, text, directory)], f"id long, t string, d {DIRECTORY}")
    return [(r.rule, r.status, [f.asDict() for f in r.facts]) for r in requirements.parsed(df, "id", "t", "d").orderBy("place").collect()]


def test_ages_need_a_reference_date(spark):
    ((rule, status, facts),) = facts_of(spark, "年龄18周岁以上至35周岁不满（计算至2026年1月1日）")
    assert (rule, status) == ("AGE_RANGE", "FACT")
    assert {k: facts[0][k] for k in ("low", "low_in", "high", "high_in", "on")} == {"low": 18, "low_in": True, "high": 35, "high_in": False, "on": "2026-01-01"}
    assert facts_of(spark, "年龄不超过35周岁") == [("AGE", "AMBIGUOUS", [])]
    assert facts_of(spark, "18-35周岁") == [("UNPARSED", "UNPARSED", [])]


def test_cohorts_go_with_the_facts_they_are_for(spark):
    found = facts_of(spark, "应届毕业生要求年龄18周岁以上至35周岁以下(截至2025年2月20日);社会人员要求年龄18周岁以上至30周岁以下(截至2025年2月20日)")
    assert [(f[0]["high"], f[0]["cohorts"]) for _, _, f in found] == [(35, ["FRESH_GRADUATE"]), (30, ["SOCIAL_CANDIDATE"])]


def test_families_and_codes_need_a_directory(spark):
    assert facts_of(spark, "硕士专业：法学类、0301法学") == [("MAJOR_SCOPED", "GAP", [])]
    ((_, status, facts),) = facts_of(spark, "硕士专业：法学类、0301法学", ("moe", "2024"))
    assert status == "FACT" and [(f["logic"], f["codes"], f["namespace"], f["code"]) for f in facts] == [("OR", ["LAW_STUDIES_FAMILY"], None, None), ("OR", None, "moe", "0301")]


def test_no_text_is_no_complete_set(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "专业不限"), (4, "须符合其他全部条件；专业不限")], "id long, t string")
    done = requirements.completeness(requirements.parsed(df, "id", "t"))
    assert sorted((r.id, r.completeness, r.blockers) for r in done.collect()) == [(1, "INCOMPLETE", []), (2, "INCOMPLETE", []), (3, "COMPLETE", []), (4, "REVIEW_REQUIRED", [1])]


def test_an_empty_profile_is_unknown_in_every_dimension(spark):
    dimensions = ["EDUCATION_LEVEL", "MAJOR", "MAJOR_SCOPE_RELATIONSHIP", "MAJOR_MATCH_RULE", "ACADEMIC_DEGREE", "AGE", "GENDER", "CANDIDATE_COHORT", "HOUSEHOLD_REGISTRATION", "STUDENT_ORIGIN", "PROFESSIONAL_QUALIFICATION", "GRADUATION_YEAR", "WORK_EXPERIENCE", "LANGUAGE", "POLITICAL_AFFILIATION", "ELSE"]
    facts = F.array(*[requirements.fact(d, kind="CODE", codes=F.array(F.lit("BACHELOR"))) for d in dimensions], requirements.fact("GENDER", "UNRESTRICTED", kind="UNRESTRICTED"))
    df = spark.range(1).select(F.inline(F.transform(facts, lambda f: F.struct(f.alias("f")))), F.lit(None).cast(predicates.PROFILE).alias("c"))
    levels = [r.v for r in df.select(predicates.outcome(F.col("f"), F.col("c"), F.lit("NEGATIVE")).alias("v")).collect()]
    assert levels == [1] * len(dimensions) + [0]


def test_facts_of_a_cohort_apply_to_it_alone(spark):
    df = spark.createDataFrame([(None, ["A"], 2), (["A"], ["A", "B"], 2), (["A"], ["B"], 0), (["A"], None, 1)], "a array<string>, b array<string>, want int")
    out = df.select("want", predicates.applies(F.struct(F.col("a").alias("cohorts")), F.struct(F.col("b").alias("cohorts"))).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_evidence_of_another_time_is_told_apart(spark):
    t = dt.datetime(2026, 1, 1)
    item = {"kind": "GENDER", "status": "CONFIRMED", "gender": "MALE", "observed": t}
    rows = [([], "INSUFFICIENT:CANDIDATE_EVIDENCE_MISSING"), ([item], "RESOLVED_MATCH:None"), ([{**item, "observed": dt.datetime(2027, 1, 1)}], "INSUFFICIENT:CANDIDATE_EVIDENCE_OUTSIDE_AS_OF"), ([item, {**item, "gender": "FEMALE"}], "REVIEW_REQUIRED:CANDIDATE_EVIDENCE_CONFLICT"), ([item, {**item, "status": None}], "INSUFFICIENT:CANDIDATE_EVIDENCE_INSUFFICIENT"), (None, "INSUFFICIENT:CANDIDATE_EVIDENCE_MISSING")]
    fields = [x.split(":")[0] for x in "kind status observed begins ends level completeness codes background program programs identity provenance year birth gender type class held".split()]
    df = spark.createDataFrame([(None if e is None else [tuple(i.get(n) for n in fields) for i in e], w) for e, w in rows], f"e array<{evidence.EVIDENCE}>, want string")
    fact = requirements.fact("GENDER", kind="CODE", codes=F.array(F.lit("MALE")))
    out = df.withColumn("f", fact).withColumn("r", evidence.resolution(F.col("f"), F.col("e"), F.lit("2026-06-01").cast("timestamp_ntz"), F.lit(2), F.lit(True))).collect()
    assert [f"{r.r.status}:{r.r.reason}" for r in out] == [w for _, w in rows]


def test_relations_between_majors(spark):
    none = F.lit(None).cast("struct<namespace:string,version:string,code:string>")
    some = F.struct(F.lit("n").alias("namespace"), F.lit("1").alias("version"), F.lit("0301").alias("code"))
    df = spark.createDataFrame([("法学", "LAW_STUDIES", "EXACT_IDENTITY"), ("法学", "LAW", "EXACT_IDENTITY"), ("专业不限", "LAW", "UNRESTRICTED"), ("法学", "LAW", "UNRESTRICTED"), ("法学", "LAW", "NOT_ESTABLISHED"), ("相近专业", "LAW", "EXPLICIT_INCLUDED"), ("法学", "LAW", "DIRECTORY_MEMBERSHIP")], "t string, m string, k string")
    df = df.withColumn("e", F.get(requirements.major_expression(F.col("t"), none, F.lit(False))["expressions"], 0))
    out = df.select(requirements.major_relation(F.col("e"), F.col("m"), F.col("k"), none).alias("r"), requirements.major_relation(F.col("e"), F.col("m"), F.col("k"), some).alias("s")).collect()
    assert [r.r.fault or r.r.state for r in out] == ["ESTABLISHED", "IDENTITY_DIFFERS", "ESTABLISHED", "SCOPE_RESTRICTED", "NOT_ESTABLISHED", "SOURCE_UNRESOLVED", "DIRECTORY_UNVERSIONED"]
    assert out[-1].s.state == "ESTABLISHED"


@pytest.mark.parametrize("seed", range(3))
def test_request_budgets_equal_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows, at = [], 0
    for n in range(300):
        at += r.choice([0, 5, 40])
        rows.append((n % 2, n, r.choice(["RESERVE", "SENT", "OBSERVE"]), f"i{r.randint(max(0, n // 8 - 1), n // 8 + 1)}", f"o{r.randint(0, 3)}", f"t{r.randint(0, 4)}", at, r.choice(["SUCCESS", "NETWORK_FAILURE", "POLICY_DENIED"]), r.choice([None, 10, 400, 5000])))
    caps = dict(most_requests=9, most_organizations=3, most_targets=3, most_bytes=1500, response_bytes=1000, retries=1, cooldown_s=60)
    df = spark.createDataFrame(rows, "k int, n int, kind string, intent string, organization string, target string, at long, status string, bytes long").repartition(3)
    found = {x.n: (x.fault, x.used_bytes) for x in folds.request_budget(df, "k", ["n"], **caps).collect()}
    state = {0: ([], 0), 1: ([], 0)}
    for k, n, kind, intent, org, target, at, status, size in rows:
        log, used = state[k]  # log: [intent, organization, target, at, sent, (done at, status)]
        mine, fault = next((q for q in log if q[0] == intent), None), None
        if kind == "RESERVE":
            ends = [q[5] for q in log if q[5] and q[1:3] == [org, target]]
            last = max(ends, key=lambda e: e[0]) if ends else None
            if mine:
                fault = "INTENT_USED"
            elif [q for q in log if not q[5]]:
                fault = "UNRESOLVED_RESERVATION"
            elif last and at - last[0] < (86400 if last[1] == "NETWORK_FAILURE" else 60):
                fault = "COOLDOWN"
            elif len(log) >= 9 or len({q[1] for q in log} | {org}) > 3 or len({q[2] for q in log if q[1] == org} | {target}) > 3 or len([q for q in log if q[2] == target]) > 1:
                fault = "BUDGET_EXHAUSTED"
            else:
                log.append([intent, org, target, at, False, None])
        elif kind == "SENT":
            if not mine or mine[4] or mine[5] or at < mine[3]:
                fault = "SEND_INVALID"
            else:
                mine[4] = True
        elif not mine or mine[5] or at < mine[3] or (not mine[4] and status != "POLICY_DENIED") or size is None or size > 1000 or used + size > 1500:
            fault = "OBSERVATION_DENIED"
        else:
            mine[5], used = (at, status), used + size
        state[k] = (log, used)
        assert found[n] == (fault, used)


def test_schedules_step_by_step(spark):
    rows = [("REGISTER", 0, None), ("CLAIM", 0, "a"), ("CLAIM", 1, "b"), ("COMPLETE", 2, "b"), ("COMPLETE", 3, "a"), ("CLAIM", 5, "c"), ("CLAIM", 13, "a"), ("CLAIM", 13, "c"), ("COMPLETE", 14, "c"), ("PAUSE", 15, None), ("CLAIM", 99, "d"), ("OTHER", 99, None)]
    df = spark.createDataFrame([("s", n, k, at, run, n != 8, False, True) for n, (k, at, run) in enumerate(rows)], "k string, n int, kind string, at long, run string, success boolean, risk boolean, eligible boolean")
    out = folds.schedules(df, "k", ["n"], 10).orderBy("n").collect()
    assert [r.fault for r in out] == [None, None, "RUN_OPEN", "RUN_NOT_ISSUED", None, "NOT_DUE", "RUN_USED", None, None, None, "NOT_ACTIVE", "KIND"]
    assert (out[4].next_run, out[8].failures, out[-1].status) == (13, 1, "PAUSED")
    assert folds.schedules(df.where("false"), "k", ["n"], 10).count() == 0


def test_open_facts_hold(spark):
    t = lambda day: dt.datetime(2026, 1, day)
    facts = spark.createDataFrame([("k", 1, None, None), ("k", 2, t(2), None), ("k", 3, None, t(2)), ("k", 4, t(3), dt.datetime(9999, 1, 1)), ("k", 5, t(9), t(8)), ("j", 6, None, None)], "k string, f int, b timestamp, e timestamp")
    events = spark.createDataFrame([("k", 1, t(1)), ("k", 2, t(2)), ("k", 9, t(9)), ("k", 0, None)], "k string, v int, at timestamp")
    found = query.validity_join(facts, events, "k", "b", "e", "at", 3600)
    assert sorted((r.v, r.f) for r in found.collect()) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (9, 1), (9, 2), (9, 4)]
    assert query.validity_join(facts, events.where("false"), "k", "b", "e", "at", 3600).count() == 0


def test_null_flags_prove_nothing(spark):
    fields = "response_structure_valid:boolean,pagination_complete:boolean,explicit_empty_signal:boolean,official_result_count:int,authentication_wall_detected:boolean,captcha_detected:boolean,error_page_detected:boolean,structure_drift_detected:boolean,historical_comparison:string"
    df = spark.createDataFrame([((None,) * 9,), ((True, True, True, None, False, False, False, False, "CONSISTENT"),)], f"v struct<{fields}>")
    assert [len(r.r) for r in df.select(diff.empty_reasons("v").alias("r")).collect()] == [8, 0]


def test_permits_name_what_is_not_known(spark):
    t = dt.datetime(2026, 1, 3)
    runs = spark.createDataFrame([("a", None, t), ("b", "GET", None), ("c", "GET", t)], "k string, method string, at timestamp")
    permits = spark.createDataFrame([("a", "GET", t, t), ("b", "GET", t, t), ("c", "GET", None, t)], "k string, method string, f timestamp, t timestamp")
    found = gates.authorization_faults(runs, permits, "k", ["method"], "at", "f", "t")
    assert {r.k: r.faults for r in found.collect()} == {"a": ["METHOD_DIFFERS"], "b": ["TIME_UNKNOWN"], "c": ["TIME_UNKNOWN"]}


def test_reconciliations_need_state_and_evidence(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "l long, r long")
    names = spark.createDataFrame([(i, f"P:{i}") for i in range(1, 5)], "id long, ref string")
    moves = spark.createDataFrame([(["P:2"], ["P:1"], "CONFIRMED", "MERGE", ["e"]), (["P:2"], ["P:3"], "PROPOSED", "MERGE", ["e"]), (["P:3"], ["P:4"], "CONFIRMED", "MERGE", [])], "from_refs array<string>, to_refs array<string>, state string, kind string, evidence array<string>")
    assert {(r.l, r.reconciled) for r in resolve.reconciled_pairs(pairs, names, moves).collect()} == {(1, True), (2, False), (3, False)}


def test_canonical_rows_of_one_and_of_several(spark):
    members = spark.createDataFrame([("a", 1, "v1", "OTHER", False, 5), ("b", 2, "v2", "OTHER", False, 7), ("c", 3, "v4", "OTHER", False, 9), ("c", 4, "v3", "OFFICIAL", True, 8)], "g string, id int, v string, a string, c boolean, at int")
    out = {r.g: r for r in resolve.canonical_rows(members, "g", "id", "v", "a", ["OFFICIAL"], F.lit("same"), F.col("c"), "at").collect()}
    assert len({r.identity_hash for r in out.values()}) == 3 and (out["c"].selected, out["c"].versions, out["c"].first_seen, out["c"].state) == (4, ["v3", "v4"], 8, "CONFIRMED")


def test_sets_with_a_cycle(spark):
    nodes = spark.createDataFrame([("t", "r", None, "AND", "o", 0), ("t", "a", "b", "OR", "o", 1), ("t", "b", "a", "OR", "o", 2), ("t", "x", "r", "LEAF", "o", 3)], "tree string, node string, parent string, operator string, owner string, position int")
    held = spark.createDataFrame([("x", "o")], "node string, owner string")
    assert sorted((r.node, r.fault) for r in structured.set_faults(nodes, held).collect()) == [("a", "CYCLE_OR_DEPTH"), ("a", "ORDER"), ("b", "CYCLE_OR_DEPTH")]


def test_blocks_that_are_too_large_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(resolve, "MOST_ROWS", 3)
    rows = spark.createDataFrame([(i, "a" if i < 4 else None) for i in range(9)], "id long, b string")
    with pytest.raises(ValueError, match="a block of 4 rows"):
        resolve.blocked_pairs(rows, "id", ["b"])
    assert resolve.blocked_pairs(rows.where("id > 0"), "id", ["b"]).count() == 3
