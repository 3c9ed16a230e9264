import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.functions import fixed
from recordloom.operators import clauses, gates, rules

CASES = [
    ("具有中华人民共和国国籍", "GENERAL_ELIGIBILITY", "GAP", []),
    ("大学本科及以上学历", "EDUCATION_AT_LEAST", "FACT", [("EDUCATION", "AT_LEAST", "本科")]),
    ("硕士研究生", "EDUCATION_EQUALS", "FACT", [("EDUCATION", "EQUALS", "硕士研究生")]),
    ("1. 取得硕士学位及以上", "DEGREE_AT_LEAST", "FACT", [("ACADEMIC_DEGREE", "AT_LEAST", "硕士")]),
    ("男女不限", "GENDER_UNRESTRICTED", "FACT", [("GENDER", "UNRESTRICTED", None)]),
    ("限女性", "GENDER", "FACT", [("GENDER", "EQUALS", "女")]),
    ("年龄18至35周岁", "AGE_RANGE", "AMBIGUOUS", [("AGE", "AT_LEAST", "18"), ("AGE", "AT_MOST", "35")]),
    ("年龄35周岁以下", "AGE_AT_MOST", "AMBIGUOUS", [("AGE", "AT_MOST", "35")]),
    ("2027届应届毕业生", "COHORT_YEAR_FRESH", "FACT", [("GRADUATION_YEAR", "EQUALS", "2027"), ("CANDIDATE_COHORT", "EQUALS", "FRESH_GRADUATE")]),
    ("2027届毕业生", "COHORT_YEAR", "FACT", [("GRADUATION_YEAR", "EQUALS", "2027")]),
    ("应届毕业生", "COHORT", "FACT", [("CANDIDATE_COHORT", "EQUALS", "FRESH_GRADUATE")]),
    ("3年以上工作经验", "EXPERIENCE_GENERIC", "AMBIGUOUS", [("WORK_EXPERIENCE", "AT_LEAST", "3")]),
    ("三年以上法务工作经验", "EXPERIENCE", "FACT", [("WORK_EXPERIENCE", "AT_LEAST", "三"), ("EXPERIENCE_FIELD", "EQUALS", "法务")]),
    ("北京市户籍", "HOUSEHOLD", "FACT", [("HOUSEHOLD_REGISTRATION", "EQUALS", "北京")]),
    ("本硕均为法学专业", "MAJOR_BOTH_LAW", "FACT", [("MAJOR", "EQUALS", "LAW/BACHELOR"), ("MAJOR", "EQUALS", "LAW/MASTER")]),
    ("专业 不限", "MAJOR_UNRESTRICTED", "FACT", [("MAJOR", "UNRESTRICTED", None)]),
    ("取得法律职业资格证书者优先", "QUALIFICATION_PREFERRED", "OBSERVATION", []),
    ("取得法律职业资格证书A类", "QUALIFICATION_CLASS", "FACT", [("PROFESSIONAL_QUALIFICATION", "EQUALS", "A")]),
    ("通过国家法律职业资格考试", "QUALIFICATION", "FACT", [("PROFESSIONAL_QUALIFICATION", "EXISTS", "LEGAL")]),
    ("法学类专业", "MAJOR_LAW", "FACT", [("MAJOR", "EQUALS", "LAW")]),
    ("有较强的沟通能力", "SUBJECTIVE", "GAP", []),
    ("会开飞机", "UNPARSED", "UNPARSED", []),
]


def test_clause_rules(spark):
    docs = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(CASES)], "id long, t string")
    found = clauses.parsed(docs, "id", "t").orderBy("id").collect()
    assert [(r.rule, r.status, [(f.dimension, f.operator, f.value) for f in r.facts]) for r in found] == [(n, s, f) for _, n, s, f in CASES]


def test_clauses_of_a_fragment(spark):
    text = "本科及以上学历；会开飞机。\n（2）专业不限"
    found = clauses.parsed(spark.createDataFrame([(1, text), (2, "专业不限"), (3, None)], "id long, t string"), "id", "t")
    assert sorted((r.id, r.place, text[r.start : r.end] if r.id == 1 else r.clause) for r in found.collect()) == [(1, 1, "本科及以上学历"), (1, 2, "会开飞机"), (1, 3, "（2）专业不限"), (2, 1, "专业不限")]
    assert sorted((r.id, r.dimension, r.certain) for r in clauses.facts_of(found).collect()) == [(1, "EDUCATION", True), (1, "MAJOR", True), (2, "MAJOR", True)]
    assert sorted(tuple(r) for r in clauses.completeness(found).collect()) == [(1, "INCOMPLETE", [2]), (2, "COMPLETE", [])]


def test_majors_and_degree_flags(spark):
    majors = {"法律硕士（非法学）": "JURIS_MASTER_NON_LAW", "法律（法学）": "JURIS_MASTER_LAW", "法律(0351)": "DIRECTORY_CODE", "法学": "LAW_ACADEMIC", "法学类": "LAW_FAMILY", "法律相关": "LAW_RELATED", "金融学": "OTHER_EXPLICIT", "专业不限": "UNRESTRICTED"}
    df = spark.createDataFrame([(m,) for m in majors], "m string")
    assert {r.m: r.c for r in df.select("m", clauses.major_class(F.col("m")).alias("c")).collect()} == majors
    flags = df.limit(1).select(clauses.degree_flags(F.lit("法律硕士（非法学）"), "法律硕士（非法学）", "法律硕士").alias("f")).first().f
    assert (flags.explicit, flags.ambiguous) == (True, False)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_admissions(spark):
    cases = [("APPROVED", "CONTINUOUS", "B", None, "CONTINUOUS"), ("APPROVED", "ONCE", "A", None, "CONTROLLED"), ("APPROVED", "ONCE", "B", True, "ONE_RUN"), ("APPROVED", "ONCE", "B", None, "DENIED"), ("PENDING", "CONTINUOUS", "A", True, "DENIED"), (None, "CONTINUOUS", "A", True, "DENIED")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, d string, s string, l string, c boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", gates.admission(F.col("d"), F.col("s"), F.col("l"), F.col("c"))).collect())


def test_permits(spark):
    t = lambda day: dt.datetime(2026, 1, day)
    runs = spark.createDataFrame([("a", "GET", t(3)), ("b", "POST", t(9)), ("c", "GET", t(3))], "k string, method string, at timestamp")
    permits = spark.createDataFrame([("a", "GET", t(1), t(5)), ("b", "GET", t(1), t(5))], "k string, method string, f timestamp, t timestamp")
    assert rows(gates.authorization_faults(runs, permits, "k", ["method"], "at", "f", "t"), "k", "faults") == [("a", []), ("b", ["METHOD_DIFFERS", "EXPIRED"]), ("c", ["NO_PERMIT"])]


@pytest.mark.parametrize("query,want", [("b=2&a=1", True), ("a=1&b=2", True), ("a=1&a=1&b=2", False), ("a=1+2", False), ("a=1", False), (None, False)])
def test_approved_queries(spark, query, want):
    df = spark.createDataFrame([(query,)], "q string")
    assert df.select(gates.approved_query(F.col("q"), F.array(F.lit("a=1&b=2"), F.lit("c=3"))).alias("x")).first().x is want


def test_registry(spark):
    sources = spark.createDataFrame([("s", 1, "p", "HTML"), ("s", 2, "q", "HTML"), ("t", 1, "x", "RSS"), ("u", 1, "p", "JSON"), ("u", 1, "p", "JSON")], "id string, rev int, pub string, kind string")
    publishers = spark.createDataFrame([("p",), ("q",)], "pub string")
    assert rows(gates.registry_faults(sources, publishers, "id", "rev", "pub", ["HTML", "JSON"], "kind"), "id", "rev", "fault") == [("s", 2, "PUBLISHER_CHANGED"), ("t", 1, "KIND_UNSUPPORTED"), ("t", 1, "PUBLISHER_UNKNOWN"), ("u", 1, "DUPLICATE")]


def test_evidence_and_identity(spark):
    claims = spark.createDataFrame([("c1", ["e1", "e2"]), ("c2", ["e9"]), ("c3", ["e1"])], "c string, ids array<string>")
    evidence = spark.createDataFrame([("e1", "BLOB"), ("e2", "NOTE")], "e string, kind string")
    assert rows(gates.missing_evidence(claims, evidence, "c", "ids", "e", "kind", ["BLOB"]), "c", "evidence_id", "fault") == [("c1", "e2", "KIND"), ("c2", "e9", "UNKNOWN")]
    df = spark.createDataFrame([(1, "n", "7", "k", "s"), (2, None, "7", "k", "s"), (3, "n", None, None, "s")], "i int, n string, c string, k string, s string")
    states = df.select("i", gates.position_identity(F.col("n"), F.col("c"), F.col("k"), F.col("s")).alias("p")).orderBy("i").collect()
    assert [r.p.state for r in states] == ["CONFIRMED", "PROVISIONAL", "UNRESOLVED"] and states[2].p.identity is None and len({r.p.identity for r in states}) == 3
    gate = df.limit(1).select(gates.capability_gate(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("b"))).alias("g")).first().g
    assert (gate.allowed, gate.missing) == (False, ["a"])


def test_releases_migrations_scopes(spark):
    files = spark.createDataFrame([("a", 1, "x"), ("b", 99, "y"), ("b", 1, "y"), ("c", 1, "new")], "p string, n long, h string")
    old = spark.createDataFrame([("c", "old"), ("a", "x")], "p string, h string")
    assert rows(gates.release_faults(files, old, "p", "n", "h", 2048, 50), "p", "fault") == [("b", "DUPLICATE_PATH"), ("b", "TOO_LARGE"), ("c", "CHANGED")]
    assert [r.fault for r in gates.release_faults(files, old, "p", "n", "h", 3, 500).where("p IS NULL").collect()] == ["TOO_MANY"]
    v1, v2 = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, h string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, h string")
    assert rows(gates.migration_audit(v1, v2, "k", "h"), "k", "status") == [("a", "MIGRATED"), ("b", "BLOCKED_DIFFERS"), ("c", "BLOCKED_MISSING"), ("d", "BLOCKED_EXTRA")]
    assert rows(gates.mixed_scopes(spark.createDataFrame([("a", "REAL"), ("a", "SYNTHETIC"), ("b", "REAL")], "k string, s string"), ["k"], "s"), "k") == [("a",)]


def test_major_scopes_and_credentials(spark):
    facts = spark.createDataFrame([("and", "BACHELOR", "AND", 2), ("and", "GRADUATE", "AND", 0), ("or", "BACHELOR", "OR", 2), ("or", "GRADUATE", "OR", 0), ("half", "BACHELOR", "AND", 2), ("top", "BACHELOR", "HIGHEST", 0), ("top", "GRADUATE", "HIGHEST", 2), ("low", "GRADUATE", "BACHELOR", 2)], "o string, s string, r string, l int")
    assert dict(rows(gates.major_scope(facts, "o", "s", F.col("r"), "l"), "o", "level")) == {"and": 0, "or": 2, "half": 1, "top": 2, "low": 1}
    people = spark.createDataFrame([([("BACHELOR", 1), ("MASTER", 2)],)], "c array<struct<level:string,rank:int>>")
    pick = lambda s: [c.level for c in people.select(gates.credentials(F.col("c"), F.lit(s)).alias("x")).first().x or []]
    assert [pick(s) for s in ("UNDERGRADUATE", "GRADUATE", "HIGHEST", "ALL", "OTHER")] == [["BACHELOR"], ["MASTER"], ["MASTER"], ["BACHELOR", "MASTER"], []]


def test_match_scores(spark):
    rows_ = [
        ("甲公司", "能源", "央企", "法务岗", "法律硕士（非法学）可报", 5),
        ("中铁一局", "基建", "央企", "法务岗", "", 0),
        ("甲公司", None, "律所", "律师助理", "不接受法律硕士（非法学）", 1),
        ("甲公司", None, "其他企业", "助理", "", 2),
        ("甲公司", None, "没有", "内控岗", "法学专业", 3),
        ("甲公司", None, "其他企业", "合规管理", "法学专业", 4),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "i int, u string, n string, t string, j string, b string, want int")
    out = df.select("i", "want", rules.match_score(F.col("u"), F.col("n"), F.col("t"), F.col("j"), F.col("b")).alias("got")).orderBy("i").collect()
    assert [r.got for r in out] == [r.want for r in out]
    named = spark.createDataFrame([("岗位名称：行 政 专员，其他",), ("无",), ("数据合规与法务",)], "t string").select(rules.direction(F.col("t")).alias("d")).collect()
    assert [r.d for r in named] == ["行政专员", fixed.DIRECTION_OTHERWISE, "法务"]


def test_legal_findings(spark):
    df = spark.createDataFrame([(1, "负责合同起草与诉讼，合同管理"), (2, "软件开发"), (3, None)], "i int, t string")
    found = rules.findings(df, "i", "t", fixed.RELEVANCE_RULES)
    assert rows(found, "i", "rule") == [(1, "CONTRACT_MANAGEMENT"), (1, "DISPUTE_RESOLUTION"), (1, "LEGAL_DOCUMENT_DRAFTING"), (2, "SOFTWARE_ENGINEERING")]
    covered = df.withColumn("c", F.lit(True))
    assert rows(rules.relevance(found, covered, "i", "c"), "i", "relevance") == [(1, "RELEVANT"), (2, "NOT_RELEVANT"), (3, "REVIEW")]
