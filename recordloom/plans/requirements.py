"""Requirement clauses, predicates, evidence and structured sets over the standard tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import evidence, logic, predicates, requirements, rules, structured, tracing
from ..sources.stored import dealt, merged, stored
from .tables import query, table

#: Clauses by number ({n}: a number of two digits that the row gives) and what each one is: rule, status, facts as dimension:operator:scope:value.
CLAUSES = [
    ("学历要求：本科及以上", "EDUCATION", "FACT", "EDUCATION_LEVEL:AT_LEAST:CANDIDATE:BACHELOR"),
    ("1.最低学历:研究生", "EDUCATION", "FACT", "EDUCATION_LEVEL:EQUALS:CANDIDATE:GRADUATE"),
    ("学位要求：硕士学位以上", "DEGREE", "FACT", "ACADEMIC_DEGREE:AT_LEAST:MASTER:MASTER_DEGREE"),
    ("性别：限女", "GENDER", "FACT", "GENDER:EQUALS:CANDIDATE:FEMALE"),
    ("性别不限", "GENDER_UNRESTRICTED", "FACT", "GENDER:UNRESTRICTED:CANDIDATE:ANY"),
    ("年龄18周岁以上{n}周岁以下（截至2026年1月1日）", "AGE_RANGE", "FACT", "AGE:EXISTS:CANDIDATE:18:true:{n}:true:2026-01-01"),
    ("18周岁以上{n}周岁以下", "AGE_RANGE", "AMBIGUOUS", ""),
    ("年龄要求：不超过{n}周岁（截至2026年12月3日）", "AGE", "FACT", "AGE:AT_MOST:CANDIDATE:{n}:2026-12-03"),
    ("{n}-60周岁", "UNPARSED", "UNPARSED", ""),
    ("招聘对象：20{n}届应届毕业生", "COHORT_YEAR", "FACT", "GRADUATION_YEAR:EQUALS:CANDIDATE:20{n}:FRESH_GRADUATE;CANDIDATE_COHORT:EQUALS:CANDIDATE:FRESH_GRADUATE"),
    ("（二）限非应届毕业生", "COHORT", "FACT", "CANDIDATE_COHORT:EQUALS:CANDIDATE:NON_FRESH_GRADUATE"),
    ("具有{n}年以上法律实践经验", "EXPERIENCE", "FACT", "WORK_EXPERIENCE:AT_LEAST:CANDIDATE:{n}:法律实践:true"),
    ("具备{n}年以上相关工作经验", "EXPERIENCE", "AMBIGUOUS", "WORK_EXPERIENCE:AT_LEAST:CANDIDATE:{n}:相关:false"),
    ("1-{n}年诉讼工作经验", "EXPERIENCE_RANGE", "FACT", "WORK_EXPERIENCE:EXISTS:CANDIDATE:1:{n}:诉讼:true"),
    ("户籍要求：北京市", "HOUSEHOLD_REGISTRATION", "FACT", "HOUSEHOLD_REGISTRATION:EQUALS:CANDIDATE:北京市"),
    ("生源地不限", "STUDENT_ORIGIN", "FACT", "STUDENT_ORIGIN:UNRESTRICTED:CANDIDATE"),
    ("本科和研究生专业均须满足", "MAJOR_RELATION", "FACT", "MAJOR_SCOPE_RELATIONSHIP:EQUALS:ALL_EDUCATION:AND"),
    ("专业代码集合：03{n}、0301", "MATCH_CODES", "FACT", "MAJOR_MATCH_RULE:EQUALS:ANY_EDUCATION:03{n}+0301:CODE_SET"),
    ("专业按外部目录匹配", "MATCH_DIRECTORY", "GAP", ""),
    ("本硕均须为法学专业", "LAW_BOTH", "FACT", "MAJOR:EQUALS:BACHELOR:LAW_STUDIES;MAJOR:EQUALS:MASTER:LAW_STUDIES"),
    ("本科专业不限，硕士：法学、法律硕士(非法学)", "MAJOR_LAYERED", "FACT", "MAJOR:UNRESTRICTED:BACHELOR;MAJOR:EQUALS:MASTER:LAW_STUDIES;MAJOR:EQUALS:MASTER:JURIS_MASTER_NON_LAW"),
    ("硕士专业：临床医学", "MAJOR_SCOPED", "GAP", ""),
    ("应届毕业生须硕士专业：法学", "MAJOR_SCOPED", "FACT", "MAJOR:EQUALS:MASTER:LAW_STUDIES:for FRESH_GRADUATE"),
    ("专业不限", "MAJOR_UNRESTRICTED", "FACT", "MAJOR:UNRESTRICTED:ANY_EDUCATION"),
    ("通过法律职业资格考试者优先", "QUALIFICATION_PREFERRED", "PREFERRED", ""),
    ("须取得A类法律职业资格证书", "QUALIFICATION", "FACT", "PROFESSIONAL_QUALIFICATION:EXISTS:CANDIDATE:LEGAL_PROFESSIONAL_QUALIFICATION:A:REQUIRED"),
    ("持有律师执业证书", "PRACTICE_CERTIFICATE", "FACT", "PROFESSIONAL_QUALIFICATION:EXISTS:CANDIDATE:LAWYER_PRACTICE_CERTIFICATE:REQUIRED"),
    ("法律专业", "MAJOR_LAW", "FACT", "MAJOR:EQUALS:ANY_EDUCATION:LAW"),
    ("身体健康", "GENERAL_ELIGIBILITY", "GAP", ""),
    ("有较强的沟通能力", "SUBJECTIVE", "GAP", ""),
    ("国内外知名院校的法学专业20{n}届及之后的在校本科生或研究生", "INTERNSHIP", "FACT_AND_GAP", "MAJOR:EQUALS:ANY_EDUCATION:LAW_STUDIES;GRADUATION_YEAR:AT_LEAST:CANDIDATE:20{n};CANDIDATE_COHORT:EQUALS:CANDIDATE:CURRENT_STUDENT;EDUCATION_LEVEL:EQUALS:CANDIDATE:BACHELOR;EDUCATION_LEVEL:EQUALS:CANDIDATE:GRADUATE"),
    ("拥有法学专业本硕学历", "LAW_BACHELOR_MASTER", "FACT", "MAJOR:EQUALS:BACHELOR:LAW_STUDIES;MAJOR:EQUALS:MASTER:LAW_STUDIES"),
    ("1-{n}年律师工作经验，并持有律师执业证", "LAWYER_YEARS", "FACT", "WORK_EXPERIENCE:EXISTS:CANDIDATE:1:{n}:律师:true;PROFESSIONAL_QUALIFICATION:EXISTS:CANDIDATE:LAWYER_PRACTICE_CERTIFICATE:REQUIRED"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CLAUSE_ROWS = ", ".join(f"({i}, {_quoted(r)}, {_quoted(s)}, {_quoted(f)})" for i, (_, r, s, f) in enumerate(CLAUSES))
_N = len(CLAUSES)


def _spoken(key: str, other: int) -> Column:
    """The clause whose number a key gives, with its {n} filled in."""
    texts = F.array(*[F.lit(t) for t, *_ in CLAUSES])
    return F.replace(F.element_at(texts, (F.col(key) * other % _N + 1).cast("int")), F.lit("{n}"), (F.col(key) % 40 + 20).cast("string"))


def _written(fact: Column) -> Column:
    parts = [fact[n].cast("string") for n in ("dimension", "operator", "scope")] + [F.array_join(fact["codes"], "+")]
    parts += [fact[n].cast("string") for n in ("low", "low_in", "high", "high_in", "number", "year", "cohort", "type", "class", "text", "on", "defined", "rule")]
    return F.concat_ws(":", *[F.nullif(p, F.lit("")) for p in parts], F.when(fact["cohorts"].isNotNull(), F.concat(F.lit("for "), F.array_join(fact["cohorts"], "+"))))


@query(f"""
WITH t(k, rule, status, facts) AS (VALUES {_CLAUSE_ROWS}), o AS (SELECT o_orderkey, (o_orderkey % 40 + 20)::VARCHAR AS n, unnest([o_orderkey % {_N}, o_orderkey * 7 % {_N}]) AS k, unnest([1, 2]) AS place FROM orders)
SELECT o_orderkey, place::INTEGER AS place, rule, status, replace(facts, '{{n}}', n) AS facts FROM o JOIN t USING (k)
""")
def q_requirement_facts(spark, d):
    """Clauses of requirement texts to typed facts by the cascade of rules."""
    texts = table(spark, d, "orders").select("o_orderkey", F.concat(_spoken("o_orderkey", 1), F.lit("；\n"), _spoken("o_orderkey", 7), F.lit("。")).alias("t"))
    found = requirements.parsed(texts, "o_orderkey", "t")
    return found.select(F.col("id").alias("o_orderkey"), "place", "rule", "status", F.array_join(F.transform("facts", _written), ";").alias("facts"))


@query(f"""
WITH t(k, rule, status, facts) AS (VALUES {_CLAUSE_ROWS}), o AS (SELECT o_orderkey, unnest([o_orderkey % {_N}, o_orderkey * 7 % {_N}]) AS k, unnest([1, 2]) AS place FROM orders WHERE o_orderkey % 50 <> 0),
g AS (SELECT o_orderkey, list(place ORDER BY place) FILTER (status NOT IN ('FACT', 'PREFERRED')) AS b FROM o JOIN t USING (k) GROUP BY o_orderkey)
SELECT o_orderkey, CASE WHEN b IS NULL THEN 'COMPLETE' ELSE 'REVIEW_REQUIRED' END AS completeness, coalesce(array_to_string(b, ','), '') AS blockers FROM g
UNION ALL SELECT o_orderkey, 'INCOMPLETE', '' FROM orders WHERE o_orderkey % 50 = 0
""")
def q_requirement_sets(spark, d):
    """Whether all clauses of a text were understood; no text at all is no complete set (K1)."""
    text = F.concat(_spoken("o_orderkey", 1), F.lit("；"), _spoken("o_orderkey", 7))
    texts = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, text).alias("t"))
    done = requirements.completeness(requirements.parsed(texts, "o_orderkey", "t"))
    return done.select(F.col("id").alias("o_orderkey"), "completeness", F.array_join(F.transform("blockers", lambda b: b.cast("string")), ",").alias("blockers"))


@query("""
WITH s AS (SELECT c_custkey, c_custkey % 6 AS k FROM customer)
SELECT c_custkey, CASE WHEN k = 3 THEN 'BLOCKED' WHEN k IN (4, 5) THEN 'BLOCKED' ELSE 'STRUCTURED' END AS status, CASE WHEN k < 3 THEN 2 ELSE 0 END::BIGINT AS conditions, CASE WHEN k = 3 THEN 'SURFACE_UNBOUND' WHEN k = 4 THEN 'CLAUSE_UNCLEAR' WHEN k = 5 THEN 'SURFACE_UNBOUND' ELSE '' END AS blockers FROM s
""")
def q_projected_requirements(spark, d):
    """Approved sources to structured requirements; a surface without its one text, or an unclear clause, blocks."""
    c = table(spark, d, "customer").select("c_custkey")
    surfaces = c.select("c_custkey", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("note"))).alias("surface")).withColumn("material", F.col("surface") != "note")
    k = F.col("c_custkey") % 6
    texts = surfaces.withColumn("t", F.when((k == 4) & (F.col("surface") == "b"), "须符合其他全部条件").when(F.col("surface") == "a", "学历要求：硕士").otherwise("性别不限"))
    bound = texts.where(~((k == 3) & (F.col("surface") == "b")))
    bound = bound.unionAll(bound.where((k == 5) & (F.col("surface") == "a")))
    out = structured.projected(surfaces, bound, "c_custkey", "surface", "material", "t")
    return out.select("c_custkey", "status", "conditions", F.array_join("blockers", ",").alias("blockers"))


@query("""
WITH s AS (SELECT o_orderkey AS k, o_orderkey % 8 AS a, CASE WHEN o_orderkey % 40 = 0 THEN NULL WHEN o_totalprice > 250000 THEN 2 ELSE 0 END AS v FROM orders)
SELECT k AS tree, least(CASE WHEN a < 4 THEN coalesce(v, 1) ELSE 2 END, 2 - CASE WHEN a % 2 = 0 THEN 0 ELSE 2 END)::INTEGER AS level, CASE WHEN a < 4 THEN 'SPECIFIC_DEGREE/MASTER/COHORT_ANY_OF' ELSE 'ANY_DEGREE/BACHELOR+MASTER+DOCTOR/ALL_CANDIDATES' END AS major FROM s
""")
def q_structured_conditions(spark, d):
    """Flat facts as conditions of trees, evaluated from the leaves."""
    a = F.col("o_orderkey") % 8
    text = F.concat(F.when(a < 4, "应届毕业生须硕士专业：法学、法律").otherwise("专业不限"), F.lit("；"), F.when(a % 2 == 0, "性别不限").otherwise("限女"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", text.alias("t"))
    # written once: trees, leaves and majors all read it
    conditions = stored(structured.conditions(requirements.parsed(orders, "o_orderkey", "t")), "conditions")
    known = conditions.join(merged(orders.select(F.col("o_orderkey").alias("set"), "o_totalprice")), "set")
    level = F.when(F.col("fact.dimension") == "GENDER", F.when(F.col("fact.operator") == "UNRESTRICTED", 2).otherwise(0)).when(F.col("fact.operator") == "UNRESTRICTED", 2).when(F.col("set") % 40 == 0, F.lit(None)).when((F.col("o_totalprice") > 250000) & (F.col("condition") == 1), 2).otherwise(0)
    level = F.when((F.col("fact.dimension") == "MAJOR") & (F.col("fact.operator") != "UNRESTRICTED") & (F.col("set") % 40 == 0), F.lit(None)).otherwise(level)
    leaves = known.select(F.col("set").alias("tree"), F.concat_ws("/", "place", "condition").alias("node"), level.alias("level"))
    levels = logic.levels(structured.trees(conditions), leaves).where("node = 'r'").select("tree", "level")
    major = conditions.where("fact.dimension = 'MAJOR'").groupBy(F.col("set").alias("tree")).agg(F.max(F.concat_ws("/", "applicability.credential", F.array_join("applicability.degrees", "+"), "applicability.state")).alias("major"))
    # "限女" is met by none here, "性别不限" by all
    return levels.join(merged(major), "tree").select("tree", "level", "major")


@query("""
WITH n AS (SELECT l_orderkey AS tree, l_linenumber AS p, l_orderkey % 9 AS k, count(*) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
x AS (SELECT tree, k, max(m) AS m FROM n GROUP BY ALL)
SELECT tree, 'r' AS node, 'NOT_ARITY' AS fault FROM x WHERE k = 1 AND m > 1
UNION ALL SELECT tree, 'n' || i, 'DANGLING_PARENT' FROM n WHERE k = 2 AND i = m
UNION ALL SELECT tree, 'n' || i, 'DANGLING_LEAF' FROM n WHERE k = 3 AND i = 1
UNION ALL SELECT tree, 'n' || i, 'FOREIGN_OWNER' FROM n WHERE k = 4 AND i = 1
UNION ALL SELECT tree, 'n' || i, 'ORDER' FROM n WHERE k = 5 AND i = m
UNION ALL SELECT tree, 'n' || i, 'DUPLICATE_NODE' FROM n WHERE k = 6 AND i = 1
UNION ALL SELECT tree, 'o', 'NO_CHILDREN' FROM x WHERE k = 7
UNION ALL SELECT tree, unnest(['c1', 'c2']), 'CYCLE_OR_DEPTH' FROM x WHERE k = 8
UNION ALL SELECT tree, 'r', 'NO_CHILDREN' FROM x WHERE k = 2 AND m = 1
""")
def q_structured_faults(spark, d):
    """What is wrong with structured sets: references, cycles, owners, order (K7)."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tree"), "l_linenumber").distinct()
    trees = lines.groupBy("tree").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines")).withColumns({"k": F.col("tree") % 9, "m": F.size("lines")})
    root = trees.select("tree", F.lit("r").alias("node"), F.lit(None).cast("string").alias("parent"), F.when(F.col("k") == 1, "NOT").otherwise("AND").alias("operator"), F.lit("own").alias("owner"), F.lit(0).alias("position"))
    leaf = trees.select("tree", "k", "m", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i"))
    last = F.col("i") == F.col("m")
    leaf = leaf.select(
        "tree", "k", "i", F.concat(F.lit("n"), "i").alias("node"), F.when((F.col("k") == 2) & last, "gone").otherwise("r").alias("parent"), F.lit("LEAF").alias("operator"),
        F.lit("own").alias("owner"), F.when((F.col("k") == 5) & last, -1).otherwise(F.col("i")).alias("position"))
    plain = ["tree", "node", "parent", "operator", "owner", "position"]
    extra = trees.where("k >= 7").select("tree", F.explode(F.when(F.col("k") == 7, F.array(F.struct(F.lit("o").alias("node"), F.lit("r").alias("parent"), F.lit("OR").alias("operator")))).otherwise(F.array(*[F.struct(F.lit(a).alias("node"), F.lit(b).alias("parent"), F.lit("AND").alias("operator")) for a, b in (("c1", "c2"), ("c2", "c1"))]))).alias("e"))
    extra = extra.select("tree", "e.node", "e.parent", "e.operator", F.lit("own").alias("owner"), F.lit(99).alias("position"))
    nodes = root.unionByName(leaf.select(*plain)).unionByName(leaf.where("k = 6 AND i = 1").select(*plain)).unionByName(extra)
    held = leaf.where(~((F.col("k") == 3) & (F.col("i") == 1))).select(F.concat_ws("/", "tree", "node").alias("node"), F.when((F.col("k") == 4) & (F.col("i") == 1), "other").otherwise("own").alias("owner"))
    # conditions are named tree by tree, so leaves look them up by a name that says so
    named = nodes.withColumn("node", F.when(F.col("operator") == "LEAF", F.concat_ws("/", "tree", "node")).otherwise(F.col("node")))
    found = structured.set_faults(named, held)
    return found.select("tree", F.regexp_replace("node", "^.*/", "").alias("node"), "fault")


def _profile() -> Column:
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    text = lambda v: F.lit(v).cast("string")
    degree = F.when(k % 5 != 0, F.array(F.when(n % 4 == 1, "MASTER_DEGREE").otherwise("BACHELOR_DEGREE")))
    program = F.when(k % 4 != 0, F.array(F.struct(F.lit("d").alias("namespace"), F.when(k % 11 == 0, "2").otherwise("1").alias("version"), F.concat(F.lit("P"), k % 3).alias("code"), text(None).alias("type"), text(None).alias("category"))))
    level = F.element_at(F.array(F.lit("BACHELOR"), F.lit("MASTER"), F.lit("DOCTOR")), (n % 4 + 1).cast("int"))
    credential = F.struct(F.when(n % 4 < 3, level).alias("level"), F.array("c_mktsegment").alias("codes"), degree.alias("degrees"), text(None).alias("type"), F.col("c_name").alias("name"), program.alias("programs"))
    return F.struct(
        F.when(n % 4 < 3, F.array(credential)).otherwise(F.array().cast(f"array<{predicates.CREDENTIAL}>")).alias("education"),
        F.element_at(F.array(F.lit("MALE"), F.lit("FEMALE"), F.lit("UNKNOWN")), (k % 3 + 1).cast("int")).alias("gender"),
        F.when(k % 13 != 0, F.concat((1960 + k % 50).cast("string"), F.lit("-06-15"))).alias("birth"),
        F.when(k % 7 != 0, F.array(F.when(k % 2 == 0, "FRESH_GRADUATE").otherwise("SOCIAL_CANDIDATE"))).alias("cohorts"),
        F.array(F.concat(F.lit("N"), n)).alias("households"), F.array().cast("array<string>").alias("origins"),
        F.when(k % 6 == 0, F.array().cast("array<struct<code:string,type:string,class:string,status:string>>")).otherwise(F.array(F.struct(F.lit("L").alias("code"), F.lit("LEGAL").alias("type"), F.when(k % 6 < 4, F.when(k % 6 == 1, "A").otherwise("B")).alias("class"), F.when(k % 6 == 5, "NOT_OBTAINED").otherwise("OBTAINED").alias("status")))).alias("qualifications"),
        F.when(k % 9 != 0, (2020 + k % 8).cast("int")).alias("graduation"), F.when(k % 10 != 0, (k % 120).cast("int")).alias("months"),
        F.array(F.struct(F.when(k % 3 == 0, "诉讼").otherwise("审计").alias("scope"), (k % 12).cast("int").alias("years"))).alias("experience"),
        F.array(F.lit("EN"), F.when(k % 2 == 0, "DE").otherwise("FR")).alias("languages"), F.when(k % 5 != 0, F.when(k % 5 == 1, "MEMBER").otherwise("NONE")).alias("politics"),
    ).cast(predicates.PROFILE)


def _facts() -> Column:
    f = requirements.fact
    codes = lambda *c: F.array(*map(F.lit, c))
    made = [
        f("EDUCATION_LEVEL", "AT_LEAST", kind="CODE", codes=codes("MASTER")), f("MAJOR", kind="CODE", codes=codes("BUILDING"), scope="ANY_EDUCATION"), f("MAJOR", "NONE_OF", kind="CODE_SET", codes=codes("BUILDING", "MACHINERY"), scope="MASTER"),
        f("MAJOR", kind="PROGRAM_REFERENCE", scope="ANY_EDUCATION", namespace="d", version="1", code="P1"), f("ACADEMIC_DEGREE", kind="CODE", codes=codes("MASTER_DEGREE"), scope="ALL_EDUCATION"),
        f("AGE", "AT_MOST", kind="AGE", number=35, on="2026-01-01"), f("AGE", "EXISTS", kind="AGE_RANGE", low=18, low_in=True, high=30, high_in=False, on="2026-01-01"), f("GENDER", kind="CODE", codes=codes("MALE")),
        f("CANDIDATE_COHORT", kind="CODE", codes=codes("FRESH_GRADUATE")), f("HOUSEHOLD_REGISTRATION", "NOT_EQUALS", kind="CODE", codes=codes("N3")), f("STUDENT_ORIGIN", "UNRESTRICTED", kind="UNRESTRICTED"), f("STUDENT_ORIGIN", kind="CODE", codes=codes("X")),
        f("PROFESSIONAL_QUALIFICATION", "EXISTS", kind="PROFESSIONAL_QUALIFICATION", type="LEGAL", text="REQUIRED", **{"class": "A"}), f("PROFESSIONAL_QUALIFICATION", "EXISTS", kind="CODE", codes=codes("L")),
        f("GRADUATION_YEAR", kind="GRADUATION_WINDOW", year=2023, cohort="FRESH_GRADUATE"), f("GRADUATION_YEAR", "AT_LEAST", kind="INTEGER", number=2024), f("WORK_EXPERIENCE", "AT_LEAST", kind="INTEGER", number=60),
        f("WORK_EXPERIENCE", "EXISTS", kind="WORK_EXPERIENCE", low=3, high=8, text="诉讼", defined=True), f("LANGUAGE", "ALL_OF", kind="CODE_SET", codes=codes("EN", "DE")), f("POLITICAL_AFFILIATION", kind="CODE", codes=codes("MEMBER")),
        f("MAJOR_MATCH_RULE", kind="MAJOR_MATCH_RULE", rule="CODE_SET", codes=codes("P2", "BUILDING")), f("MAJOR_SCOPE_RELATIONSHIP", kind="MAJOR_SCOPE_RELATIONSHIP", rule="AND"), f("MATERIALS", kind="CODE", codes=codes("X")),
    ]
    return F.array(*made)


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s, 2026 - (1960 + c_custkey % 50) - 1 AS age FROM customer),
r AS (SELECT *, unnest(range(0, 23)) AS i FROM c),
l AS (SELECT k, i, CASE i
  WHEN 0 THEN CASE WHEN n % 4 = 3 THEN 1 WHEN n % 4 = 0 THEN 0 ELSE 2 END
  WHEN 1 THEN CASE WHEN n % 4 = 3 THEN 1 WHEN s = 'BUILDING' THEN 2 ELSE 0 END
  WHEN 2 THEN CASE WHEN n % 4 <> 1 THEN 1 WHEN s IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 2 END
  WHEN 3 THEN CASE WHEN n % 4 = 3 OR k % 4 = 0 THEN 1 WHEN k % 11 = 0 THEN 0 WHEN k % 3 IN (1, 2) THEN 2 ELSE 1 END
  WHEN 4 THEN CASE WHEN n % 4 = 3 OR k % 5 = 0 THEN 1 WHEN n % 4 = 1 THEN 2 ELSE 0 END
  WHEN 5 THEN CASE WHEN k % 13 = 0 THEN 1 WHEN age <= 35 THEN 2 ELSE 0 END
  WHEN 6 THEN CASE WHEN k % 13 = 0 THEN 1 WHEN age >= 18 AND age < 30 THEN 2 ELSE 0 END
  WHEN 7 THEN CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END
  WHEN 8 THEN CASE WHEN k % 7 = 0 THEN 1 WHEN k % 2 = 0 THEN 2 ELSE 0 END
  WHEN 9 THEN CASE WHEN n = 3 THEN 0 ELSE 2 END
  WHEN 10 THEN 2 WHEN 11 THEN 1
  WHEN 12 THEN CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 1 END
  WHEN 13 THEN CASE k % 6 WHEN 0 THEN 1 WHEN 5 THEN 0 ELSE 2 END
  WHEN 14 THEN least(CASE WHEN k % 9 = 0 THEN 1 WHEN 2020 + k % 8 = 2023 THEN 2 ELSE 0 END, CASE WHEN k % 7 = 0 THEN 1 WHEN k % 2 = 0 THEN 2 ELSE 0 END)
  WHEN 15 THEN CASE WHEN k % 9 = 0 THEN 1 WHEN 2020 + k % 8 >= 2024 THEN 2 ELSE 0 END
  WHEN 16 THEN CASE WHEN k % 10 = 0 THEN 1 WHEN k % 120 >= 60 THEN 2 ELSE 0 END
  WHEN 17 THEN CASE WHEN k % 3 <> 0 THEN 1 WHEN k % 12 BETWEEN 3 AND 8 THEN 2 ELSE 0 END
  WHEN 18 THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END
  WHEN 19 THEN CASE WHEN k % 5 = 0 THEN 1 WHEN k % 5 = 1 THEN 2 ELSE 0 END
  WHEN 20 THEN CASE WHEN n % 4 = 3 THEN 1 WHEN s = 'BUILDING' OR (k % 4 <> 0 AND k % 3 = 2) THEN 2 ELSE 0 END
  ELSE 1 END AS level FROM r)
SELECT k AS c_custkey, i::INTEGER AS fact, CASE WHEN k % 17 = 0 AND level <> 1 THEN 2 - level ELSE level END::INTEGER AS level FROM l
""")
def q_predicates(spark, d):
    """Facts of all dimensions against candidates' profiles (L2); every seventeenth candidate is asked the opposite."""
    proofs = F.array(F.struct(*[F.lit(v).alias(n) for n, v in zip(("namespace", "version", "from_code", "from_type", "to_code", "to_type", "status"), ("d", "1", "P1", "UNSPECIFIED", "P2", "UNSPECIFIED", "EXPLICIT_EQUIVALENT"))]))
    rows = dealt(table(spark, d, "customer"), "c_custkey").select("c_custkey", _profile().alias("c"), F.posexplode(_facts()).alias("fact", "f"))
    level = predicates.outcome(F.col("f"), F.col("c"), F.when(F.col("c_custkey") % 17 == 0, "NEGATIVE").otherwise("POSITIVE"), proofs)
    return rows.select("c_custkey", "fact", level.alias("level"))


def _evidence() -> Column:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    names = ["kind", "status", "observed", "begins", "ends", "level", "completeness", "codes", "background", "program", "programs", "identity", "provenance", "year", "birth", "gender", "type", "class", "held"]

    def one(**v) -> Column:
        v = {"status": F.when(k % 10 == 9, "PENDING").otherwise("CONFIRMED"), "observed": F.lit("2026-01-10").cast("timestamp_ntz"), **v}
        return F.struct(*[(v[x] if isinstance(v.get(x), Column) else F.lit(v.get(x))).alias(x) for x in names]).cast(evidence.EVIDENCE)

    credential = one(kind="EDUCATION_CREDENTIAL", level=F.when(n % 3 == 0, "BACHELOR").otherwise("MASTER"), completeness="COMPLETE", codes=F.array("c_mktsegment"), background=F.when(n % 2 == 0, "LAW").otherwise("NON_LAW"),
                     program=F.when(n % 5 == 0, "LAW_MASTER_NON_LAW"), identity="c", provenance=F.when(k % 2 == 0, "COMPLETE").otherwise("PARTIAL"))
    birth = one(kind="DATE_OF_BIRTH", birth=F.concat((1980 + k % 30).cast("string"), F.lit("-06-15")), begins=F.when(k % 8 == 7, F.lit("2027-01-01").cast("timestamp_ntz")))
    genders = [one(kind="GENDER", gender=F.when(k % 4 == 0, "UNKNOWN").otherwise("FEMALE")), one(kind="GENDER", gender="MALE", ends=F.when(k % 6 != 0, F.lit("2026-01-31").cast("timestamp_ntz")))]
    held = one(kind="PROFESSIONAL_QUALIFICATION", type="LEGAL", **{"class": "A"}, held=F.when(k % 3 == 0, "OBTAINED").otherwise("NOT_OBTAINED"))
    held2 = one(kind="PROFESSIONAL_QUALIFICATION", type="LEGAL", **{"class": F.when(k % 7 == 0, "A").otherwise("B")}, held="PASSED_PENDING_CERTIFICATE")
    year = one(kind="TARGET_GRADUATION_YEAR", year=(2020 + k % 8).cast("int"), status=F.when(k % 10 == 9, "REVIEW_REQUIRED").otherwise("CONFIRMED"))
    return F.array(credential, birth, *genders, held, held2, year)


def _asked() -> Column:
    f = requirements.fact
    codes = lambda *c: F.array(*map(F.lit, c))
    return F.array(
        f("EDUCATION_LEVEL", "AT_LEAST", kind="CODE", codes=codes("MASTER")), f("EDUCATION_LEVEL", "NOT_EQUALS", kind="CODE", codes=codes("MASTER")), f("MAJOR", kind="CODE", codes=codes("BUILDING"), scope="ANY_EDUCATION"),
        f("MAJOR", kind="CODE", codes=codes("0351"), scope="ANY_EDUCATION"), f("MAJOR", kind="CODE_SET", codes=codes("LAW", "X"), scope="ANY_EDUCATION"), f("GRADUATION_YEAR", kind="GRADUATION_WINDOW", low=2022, low_in=True, high=2025, high_in=False),
        f("AGE", "AT_MOST", kind="AGE", number=35, on="2026-01-01"), f("AGE", "AT_MOST", kind="AGE", number=35, on="2030-01-01"), f("GENDER", kind="CODE", codes=codes("FEMALE")),
        f("PROFESSIONAL_QUALIFICATION", "EXISTS", kind="PROFESSIONAL_QUALIFICATION", type="LEGAL", **{"class": "A"}), f("LANGUAGE", kind="CODE", codes=codes("EN")),
    )


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s, 2026 - (1980 + c_custkey % 30) - 1 AS age, c_custkey % 10 = 9 AS weak FROM customer), r AS (SELECT *, unnest(range(0, 11)) AS i FROM c),
m AS (SELECT k, i, CASE WHEN k % 19 = 0 THEN 'REVIEW_REQUIRED:SOURCE_REQUIREMENT_UNRESOLVED' WHEN k % 19 = 1 THEN 'UNKNOWN:APPLICABILITY_UNKNOWN' WHEN k % 19 = 2 THEN 'UNKNOWN:CONDITION_NOT_APPLICABLE' ELSE CASE i
  WHEN 0 THEN CASE WHEN weak THEN 'W' WHEN n % 3 = 0 THEN 'W' ELSE 'T' END
  WHEN 1 THEN CASE WHEN weak THEN 'W' ELSE 'N' END
  WHEN 2 THEN CASE WHEN weak THEN 'W' WHEN s = 'BUILDING' THEN 'T' WHEN k % 2 = 0 THEN 'F' ELSE 'W' END
  WHEN 3 THEN CASE WHEN weak THEN 'W' WHEN n % 5 = 0 THEN 'REVIEW_REQUIRED:LAW_0351_APPLICABILITY_UNRESOLVED' WHEN k % 2 = 0 THEN 'F' ELSE 'W' END
  WHEN 4 THEN CASE WHEN weak THEN 'W' WHEN n % 2 = 0 THEN 'T' ELSE 'F' END
  WHEN 5 THEN CASE WHEN weak THEN 'C' WHEN 2020 + k % 8 BETWEEN 2022 AND 2024 THEN 'T' ELSE 'F' END
  WHEN 6 THEN CASE WHEN k % 8 = 7 THEN 'M' WHEN weak THEN 'W' WHEN age <= 35 THEN 'T' ELSE 'F' END
  WHEN 7 THEN CASE WHEN k % 8 = 7 THEN 'M' WHEN weak THEN 'W' ELSE 'REVIEW_REQUIRED:TEMPORAL_CONTEXT_UNRESOLVED' END
  WHEN 8 THEN CASE WHEN weak THEN 'W' WHEN k % 6 = 0 THEN 'C' WHEN k % 4 = 0 THEN 'W' ELSE 'T' END
  WHEN 9 THEN CASE WHEN weak THEN 'W' WHEN k % 7 = 0 AND k % 3 <> 0 THEN 'C' WHEN k % 3 = 0 THEN 'T' ELSE 'F' END
  ELSE 'N' END END AS x FROM r)
SELECT k AS c_custkey, i::INTEGER AS fact, CASE x WHEN 'T' THEN 'RESOLVED_MATCH:' WHEN 'F' THEN 'RESOLVED_NOT_MATCH:' WHEN 'W' THEN 'INSUFFICIENT:CANDIDATE_EVIDENCE_INSUFFICIENT' WHEN 'M' THEN 'INSUFFICIENT:CANDIDATE_EVIDENCE_MISSING' WHEN 'C' THEN 'REVIEW_REQUIRED:CANDIDATE_EVIDENCE_CONFLICT' WHEN 'N' THEN 'REVIEW_REQUIRED:SAFE_RULE_NOT_IMPLEMENTED' ELSE x END AS resolution FROM m
""")
def q_evidence(spark, d):
    """Facts against dated evidence, each dimension with its own deviations from the one template."""
    k = F.col("c_custkey") % 19
    rows = dealt(table(spark, d, "customer"), "c_custkey").select("c_custkey", _evidence().alias("e"), F.posexplode(_asked()).alias("fact", "f"))
    found = evidence.resolution(F.col("f"), F.col("e"), F.lit("2026-02-15").cast("timestamp_ntz"), F.when(k == 1, 1).when(k == 2, 0).otherwise(2), k != 0)
    return rows.withColumn("r", found).select("c_custkey", "fact", F.concat(F.col("r.status"), F.lit(":"), F.coalesce("r.reason", F.lit(""))).alias("resolution"))


#: Major expressions by number, and what each one is without a directory, outside a list: status, diagnostic, identities.
EXPRESSIONS = [
    ("专业不限", "RESOLVED", "", "ANY_MAJOR"), ("法律硕士（非法学）", "RESOLVED", "", "LAW_MASTER_NON_LAW"), ("法律(法学)", "RESOLVED", "", "LAW_LAW"), ("0351法律", "UNRESOLVED", "DIRECTORY_VERSION_UNRESOLVED", "LAW_0351"), ("法律", "RESOLVED", "", "LAW_GENERAL"),
    ("专业：法学", "RESOLVED", "", "LAW_STUDIES"), ("法学类", "UNRESOLVED", "MAJOR_EXPRESSION_UNRESOLVED", "LAW_STUDIES_FAMILY"), ("法律相关专业", "RESOLVED", "", "LAW_RELATED"), ("会计及相近专业", "UNRESOLVED", "MAJOR_EXPRESSION_UNRESOLVED", "UNRESOLVED"),
    ("知识产权", "RESOLVED", "", "INTELLECTUAL_PROPERTY"), ("会计学", "RESOLVED", "", "OTHER_EXPLICIT"), ("法学、法律（非法学）", "UNRESOLVED", "MAJOR_LIST_CONTEXT_UNPROVEN", ""),
]
_EXPRESSION_ROWS = ", ".join(f"({i}, {', '.join(map(_quoted, e[1:]))})" for i, e in enumerate(EXPRESSIONS))


@query(f"""
WITH t(k, status, diagnostic, identities) AS (VALUES {_EXPRESSION_ROWS}), c AS (SELECT c_custkey, c_custkey % 12 AS k, c_nationkey % 2 = 0 AS dir, c_nationkey % 3 = 0 AS lst FROM customer),
r AS (SELECT c_custkey, k, dir, CASE WHEN (dir AND k IN (3, 6)) OR (lst AND k = 11) THEN 'RESOLVED' ELSE status END AS status, CASE WHEN (dir AND k IN (3, 6)) OR (lst AND k = 11) THEN '' ELSE diagnostic END AS diagnostic, CASE WHEN lst AND k = 11 THEN 'LAW_STUDIES+LAW_NON_LAW' ELSE identities END AS identities FROM c JOIN t USING (k))
SELECT c_custkey, status, diagnostic, identities, CASE WHEN identities = '' THEN 'SOURCE_UNRESOLVED' WHEN status = 'UNRESOLVED' THEN 'SOURCE_UNRESOLVED' WHEN starts_with(identities, 'LAW_STUDIES') AND k <> 6 THEN 'ESTABLISHED' ELSE 'IDENTITY_DIFFERS' END AS relation FROM r
""")
def q_major_expressions(spark, d):
    """What major expressions mean, and their exact relation to a candidate's major."""
    text = F.element_at(F.array(*[F.lit(e[0]) for e in EXPRESSIONS]), (F.col("c_custkey") % 12 + 1).cast("int"))
    directory = F.when(F.col("c_nationkey") % 2 == 0, F.struct(F.lit("moe").alias("namespace"), F.lit("2024").alias("version"), F.lit("0351").alias("code")))
    rows = table(spark, d, "customer").select("c_custkey", requirements.major_expression(text, directory, F.col("c_nationkey") % 3 == 0).alias("e"))
    first = F.get(F.col("e.expressions"), 0)
    relation = requirements.major_relation(first, F.lit("LAW_STUDIES"), F.lit("EXACT_IDENTITY"), F.lit(None).cast("struct<namespace:string,version:string,code:string>"))
    identities = F.coalesce(F.array_join(F.transform("e.expressions", lambda x: x["identity"]), "+"), F.lit(""))
    return rows.select("c_custkey", "e.status", F.coalesce("e.diagnostic", F.lit("")).alias("diagnostic"), identities.alias("identities"), F.coalesce(relation["fault"], relation["state"]).alias("relation"))


@query("""
SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN source = 'src1' THEN 1 WHEN n_chars > 2000 THEN 2 ELSE 0 END WHEN lang = 'de' THEN greatest(CASE WHEN n_chars > 2000 THEN 2 ELSE 0 END, 2) ELSE CASE WHEN n_chars > 2000 THEN 2 ELSE 0 END END::INTEGER AS level,
  CASE lang WHEN 'en' THEN 'MASTER' WHEN 'de' THEN 'BACHELOR+MASTER' WHEN 'fr' THEN 'MASTER' ELSE 'BACHELOR' END AS selected, length(coalesce(text, '')) > 100 AND contains(coalesce(text, ''), 'the') AS explicit, NOT contains(replace(coalesce(text, ''), 'the', ''), 'th') AS plain FROM documents
""")
def q_major_scopes(spark, d):
    """Bachelor and graduate majors related, credentials selected, wording taken out before the vague one is looked for."""
    from ..operators import clauses, gates

    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    long = F.when(F.col("n_chars") > 2000, 2).otherwise(0)
    sides = docs.select("doc_id", "lang", F.explode(F.array(
        F.struct(F.lit("BACHELOR").alias("side"), F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 2).otherwise(long).alias("level"), F.lit(True).alias("there")),
        F.struct(F.lit("GRADUATE").alias("side"), long.alias("level"), (~((F.col("lang") == "en") & (F.col("source") == "src1"))).alias("there")))).alias("s"))
    facts = sides.where("s.there").select("doc_id", F.col("s.side").alias("side"), F.col("s.level").alias("level"), F.when(F.col("lang") == "en", "AND").when(F.col("lang") == "de", "OR").when(F.col("lang") == "fr", "GRADUATE").otherwise("BACHELOR").alias("relation"))
    levels = gates.major_scope(facts, "doc_id", "side", F.col("relation"), "level")
    both = F.array(F.struct(F.lit("BACHELOR").alias("level"), F.lit(1).alias("rank")), F.struct(F.lit("MASTER").alias("level"), F.lit(2).alias("rank")))
    chosen = gates.credentials(both, F.when(F.col("lang") == "en", "HIGHEST").when(F.col("lang") == "de", "ALL").when(F.col("lang") == "fr", "GRADUATE").otherwise("UNDERGRADUATE"))
    flags = clauses.degree_flags(F.col("text"), "the", "th")
    out = docs.select("doc_id", F.array_join(F.transform(chosen, lambda c: c["level"]), "+").alias("selected"), ((F.length("text") > 100) & flags["explicit"]).alias("explicit"), (~flags["ambiguous"]).alias("plain"))
    return out.join(levels.select("doc_id", F.col("level").cast("int").alias("level")), "doc_id")


#: Connecting words and marks by number: meaning outside a list of majors, and within one.
CONNECTORS = [("且", "RESOLVED/AND", "RESOLVED/AND"), (" 或 ", "RESOLVED/OR", "RESOLVED/OR"), ("以及", "RESOLVED/AND", "RESOLVED/OR"), ("：", "NON_BOOLEAN/LABEL_DELIMITER", "NON_BOOLEAN/LABEL_DELIMITER"), ("、", "UNRESOLVED", "RESOLVED/OR"), ("；", "CLAUSE_BOUNDARY", "RESOLVED/OR"), ("和", "UNRESOLVED", "UNRESOLVED")]
_CONNECTOR_ROWS = ", ".join(f"({i}, {', '.join(map(_quoted, c[1:]))})" for i, c in enumerate(CONNECTORS))


@query(f"""
WITH t(k, plain, listed) AS (VALUES {_CONNECTOR_ROWS})
SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN 'NON_BOOLEAN/PROTECTED_CONTENT' WHEN c_nationkey % 2 = 0 THEN listed ELSE plain END AS meaning FROM customer JOIN t ON k = c_custkey % 7
""")
def q_clause_connectors(spark, d):
    """What connects two parts of a clause, by word and context (K5)."""
    token = F.element_at(F.array(*[F.lit(c[0]) for c in CONNECTORS]), (F.col("c_custkey") % 7 + 1).cast("int"))
    found = rules.clause_connector(token, F.when(F.col("c_nationkey") % 2 == 0, rules.MAJOR_LIST).otherwise("REQUIREMENT"), F.col("c_nationkey") % 5 == 4)
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("/", found["status"], found["kind"]).alias("meaning"))


#: Texts by remainder, and what their clauses come to: status, facts as canonical JSON; of one clause each but the first.
_GENDER = '{"codes":["%s"],"dimension":"GENDER","kind":"CODE","logic":"AND","operator":"%s","scope":"CANDIDATE"}'
_TRACED = f"""
t(k, place, a, b, observed, warning, facts) AS (VALUES (0, 1, 0, 4, 'CONFIRMED', NULL, ['{_GENDER % ("ANY", "UNRESTRICTED")}']), (0, 2, 5, 7, 'CONFIRMED', NULL, ['{_GENDER % ("FEMALE", "EQUALS")}']),
  (1, 1, 1, 5, 'CONFIRMED', NULL, ['{_GENDER % ("ANY", "UNRESTRICTED")}']), (1, 2, 6, 12, 'UNPARSED_CLAUSE', 'UNPARSED_CLAUSE', []), (2, NULL, NULL, NULL, 'NOT_OBSERVED', 'EMPTY_EVIDENCE_FRAGMENT', [])),
r AS (SELECT o_orderkey AS id, 'v' || o_custkey AS v, t.* FROM orders JOIN t ON t.k = o_orderkey % 3),
f AS (SELECT id, v, place, a, b, 'requirement-fact:' || sha256('{{"clause_index":' || (place - 1) || ',"draft":' || facts[1] || ',"draft_index":0,"evidence_fragment_id":"' || id || '","opportunity_version_id":"' || v || '"}}') AS fact_id FROM r WHERE len(facts) > 0)"""


def _traced(spark, d):
    k = F.col("o_orderkey") % 3
    texts = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "性别不限；限女").when(k == 1, " 性别不限；会飞的人优先").alias("t"))
    versions = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("v"), "o_custkey").alias("v"))
    return requirements.parsed(texts, "o_orderkey", "t").join(versions, F.col("id") == F.col("o_orderkey"))


@query(f"""
WITH {_TRACED}
SELECT id, place, fact_id, 'requirement-evidence:' || sha256('{{"end_offset":' || b || ',"evidence_fragment_id":"' || id || '","requirement_fact_id":"' || fact_id || '","start_offset":' || a || '}}') AS evidence_id FROM f
""")
def q_fact_evidence(spark, d):
    """Facts and the evidence that leads from each to its place in the text, by id (K1)."""
    return tracing.facts_with_evidence(_traced(spark, d), F.col("v")).select("id", "place", "fact_id", "evidence_id")


@query(f"""
WITH {_TRACED}
SELECT r.id, r.place, observed, warning, 'requirement-observation:' || sha256('{{"clause_index":' || coalesce(r.place - 1, 0) || ',"evidence_fragment_id":"' || r.id || '","fact_ids":[' || coalesce('"' || fact_id || '"', '') || '],"opportunity_version_id":"' || r.v || '","status":"' || observed || '"}}') AS observation_id
FROM r LEFT JOIN f ON f.id = r.id AND f.place = r.place
""")
def q_requirement_observations(spark, d):
    """What was seen of every clause, with the ids of its facts, and warnings (K1)."""
    found = _traced(spark, d)
    facts = tracing.facts_with_evidence(found, F.col("v"))
    return tracing.observations(found, facts, F.col("v")).select("id", "place", "observed", "warning", "observation_id")
