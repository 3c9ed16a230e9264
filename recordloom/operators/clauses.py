"""Clauses to flat facts by a table of patterns, the first that matches deciding; `requirements` has the full cascade with typed values."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clauses, first_class, unmarked


class Fact(NamedTuple):
    """What a rule states: value is a literal, or an int for the group of the pattern that holds it."""

    dimension: str
    operator: str
    value: str | int | None = None
    polarity: str = "REQUIRED"


class Rule(NamedTuple):
    """status: FACT, AMBIGUOUS (facts that need more to be certain), OBSERVATION or GAP (neither makes a fact)."""

    name: str
    pattern: str
    facts: tuple[Fact, ...] = ()
    status: str = "FACT"


_LEVEL = "(博士研究生|硕士研究生|研究生|博士|硕士|本科|大专|专科)"
_DEGREE = "(博士|硕士|学士)学位"

# A table of its own for short, loose wordings, wider than the cascade in `requirements`. White space and list marks are gone by then.
RULES = [
    Rule("GENERAL_ELIGIBILITY", "中华人民共和国国籍|遵守(宪法|法律)|品行(端正|良好)|政治素质|身体健康|良好的(道德|职业)", status="GAP"),
    Rule("EDUCATION_AT_LEAST", f"^(?:具有|具备)?(?:国家承认的)?(?:全日制)?(?:普通高等教育)?(?:大学)?{_LEVEL}(?:研究生)?(?:学历)?(?:及)?以上(?:学历)?$", (Fact("EDUCATION", "AT_LEAST", 1),)),
    Rule("EDUCATION_EQUALS", f"^(?:具有|具备)?(?:全日制)?(?:大学)?{_LEVEL}(?:研究生)?(?:学历)?$", (Fact("EDUCATION", "EQUALS", 1),)),
    Rule("DEGREE_AT_LEAST", f"^(?:具有|取得)?{_DEGREE}(?:及)?以上$", (Fact("ACADEMIC_DEGREE", "AT_LEAST", 1),)),
    Rule("DEGREE_EQUALS", f"^(?:具有|取得)?{_DEGREE}$", (Fact("ACADEMIC_DEGREE", "EQUALS", 1),)),
    Rule("GENDER_UNRESTRICTED", "^(?:性别不限|男女不限)$", (Fact("GENDER", "UNRESTRICTED"),)),
    Rule("GENDER", "^(?:性别[:：]?)?(?:限)?(男|女)性?$", (Fact("GENDER", "EQUALS", 1),)),
    Rule("AGE_RANGE", r"^(?:年龄)?(?:在)?(\d{2})(?:周岁)?(?:以上)?[至到~\-—,，、](\d{2})周?岁(?:以下|之间)?$", (Fact("AGE", "AT_LEAST", 1), Fact("AGE", "AT_MOST", 2)), "AMBIGUOUS"),
    Rule("AGE_AT_MOST", r"^(?:年龄)?(?:在|不超过|未满)?(\d{2})周?岁(?:及)?(?:以下|以内)?$", (Fact("AGE", "AT_MOST", 1),), "AMBIGUOUS"),
    Rule("COHORT_YEAR_FRESH", r"^(20\d{2})(?:年|届)+(?:全国)?(?:普通)?(?:高校)?应届(?:高校)?(?:毕业生)?$", (Fact("GRADUATION_YEAR", "EQUALS", 1), Fact("CANDIDATE_COHORT", "EQUALS", "FRESH_GRADUATE"))),
    Rule("COHORT_YEAR", r"^(?:限)?(20\d{2})届(?:高校)?(?:毕业生)?$", (Fact("GRADUATION_YEAR", "EQUALS", 1),)),
    Rule("COHORT", "^(?:限)?(?:高校)?应届(?:高校)?毕业生$", (Fact("CANDIDATE_COHORT", "EQUALS", "FRESH_GRADUATE"),)),
    Rule("EXPERIENCE_GENERIC", r"^(?:具有|具备)?(\d{1,2}|[一二两三四五六七八九十])年(?:及)?以上(?:相关)?(?:工作)?(?:经验|经历)$", (Fact("WORK_EXPERIENCE", "AT_LEAST", 1),), "AMBIGUOUS"),
    Rule("EXPERIENCE", r"^(?:具有|具备)?(\d{1,2}|[一二两三四五六七八九十])年(?:及)?以上(.{1,20}?)(?:工作)?(?:经验|经历)$", (Fact("WORK_EXPERIENCE", "AT_LEAST", 1), Fact("EXPERIENCE_FIELD", "EQUALS", 2))),
    Rule("REGION_UNRESTRICTED", "^(?:户籍|生源(?:地)?)不限$", (Fact("REGION", "UNRESTRICTED"),)),
    Rule("HOUSEHOLD", "^(?:限)?(.{2,8}?)(?:市|省)?户籍$", (Fact("HOUSEHOLD_REGISTRATION", "EQUALS", 1),)),
    Rule("STUDENT_ORIGIN", "^(?:限)?(.{2,8})生源(?:地)?$", (Fact("STUDENT_ORIGIN", "EQUALS", 1),)),
    Rule("MAJOR_BOTH_LAW", "^本(?:科)?(?:、|和|及)?硕(?:士)?(?:阶段)?(?:均|都)(?:须|需|应|要求)?为?法学(?:类)?(?:专业)?$", (Fact("MAJOR", "EQUALS", "LAW/BACHELOR"), Fact("MAJOR", "EQUALS", "LAW/MASTER"))),
    Rule("MAJOR_UNRESTRICTED", "^专业不限$", (Fact("MAJOR", "UNRESTRICTED"),)),
    Rule("QUALIFICATION_PREFERRED", "(?:法律职业资格|司法考试).{0,12}(?:优先|者佳)", status="OBSERVATION"),
    Rule("QUALIFICATION_CLASS", "(?:取得|具有|通过|持有).{0,10}法律职业资格(?:证书)?.{0,4}?([ABC])(?:类|证)", (Fact("PROFESSIONAL_QUALIFICATION", "EQUALS", 1),)),
    Rule("QUALIFICATION", "(?:取得|具有|通过|持有).{0,10}(?:法律职业资格|司法考试)", (Fact("PROFESSIONAL_QUALIFICATION", "EXISTS", "LEGAL"),)),
    Rule("PRACTICE_CERTIFICATE", "(?:取得|具有|持有).{0,8}(?:律师)?执业证", (Fact("PROFESSIONAL_QUALIFICATION", "EXISTS", "PRACTICE_CERTIFICATE"),)),
    Rule("MAJOR_LAW", "^(?:专业[:：])?(?:法学类?|法律)(?:相关)?(?:专业)?$", (Fact("MAJOR", "EQUALS", "LAW"),)),
    Rule("SUBJECTIVE", "责任心|沟通能力|团队|吃苦耐劳|抗压|表达能力|认真|敬业", status="GAP"),
]

_FACTS = "array<struct<dimension:string,operator:string,value:string,polarity:string>>"


def rule_struct(clause: Column, rules: list[Rule] = RULES) -> Column:
    """struct(rule, status, facts) of a clause; UNPARSED where no rule matches."""

    def value(rule: Rule, f: Fact) -> Column:
        return F.regexp_extract(clause, rule.pattern, f.value) if isinstance(f.value, int) else F.lit(f.value).cast("string")

    def made(rule: Rule) -> Column:
        facts = [F.struct(F.lit(f.dimension).alias("dimension"), F.lit(f.operator).alias("operator"), value(rule, f).alias("value"), F.lit(f.polarity).alias("polarity")) for f in rule.facts]
        return F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.status).alias("status"), (F.array(*facts) if facts else F.array()).cast(_FACTS).alias("facts"))

    otherwise = made(Rule("UNPARSED", "", status="UNPARSED"))
    return F.coalesce(*[F.when(clause.rlike(r.pattern), made(r)) for r in rules], otherwise)


def parsed(fragments: DataFrame, id_col: str, text_col: str, rules: list[Rule] = RULES) -> DataFrame:
    """id, place, clause, start, end, rule, status, facts: every clause of every fragment, with its place in the text."""
    rows = fragments.select(F.col(id_col).alias("id"), F.inline(clauses(F.col(text_col))).alias("place", "clause", "start", "end"))
    compact = F.regexp_replace(unmarked(F.col("clause")), r"[\s　 ]+", "")
    return rows.withColumn("__r", rule_struct(compact, rules)).select("id", "place", "clause", "start", "end", "__r.rule", "__r.status", "__r.facts")


def facts_of(found: DataFrame) -> DataFrame:
    """id, place, dimension, operator, value, polarity, certain: a row for each fact; gaps and observations make none."""
    return found.select("id", "place", (F.col("status") == "FACT").alias("certain"), F.inline("facts"))


def completeness(found: DataFrame) -> DataFrame:
    """id, completeness, blockers (places): COMPLETE only where every clause was understood."""
    blocked = F.col("status").isin("UNPARSED", "GAP")
    g = found.groupBy("id").agg(F.array_sort(F.collect_list(F.when(blocked, F.col("place")))).alias("blockers"))
    return g.select("id", F.when(F.size("blockers") == 0, "COMPLETE").otherwise("INCOMPLETE").alias("completeness"), "blockers")


# What a named major is, in the order in which it is tried.
MAJORS = [
    ("专业不限|不限专业", "UNRESTRICTED"),
    (r"法律硕士[（(]非法学[）)]|法律[（(]非法学[）)]|法硕[（(]?非法学", "JURIS_MASTER_NON_LAW"),
    (r"法律硕士[（(]法学[）)]|法律[（(]法学[）)]", "JURIS_MASTER_LAW"),
    (r"0351", "DIRECTORY_CODE"),
    (r"^法律$", "LAW_PROFESSIONAL"),
    (r"^法学$", "LAW_ACADEMIC"),
    (r"法学类|法学大类", "LAW_FAMILY"),
    (r"法学?律?(?:等)?相关", "LAW_RELATED"),
    (r"相关专业|相近专业|等专业", "UNRESOLVED"),
]


def major_class(major: Column) -> Column:
    return first_class(F.regexp_replace(major, r"\s+", ""), MAJORS, "OTHER_EXPLICIT")


def degree_flags(text: Column, explicit: str, ambiguous: str) -> Column:
    """struct(explicit, ambiguous): what matches explicitly is taken out before the ambiguous wording is looked for."""
    return F.struct(text.rlike(explicit).alias("explicit"), F.regexp_replace(text, explicit, "").rlike(ambiguous).alias("ambiguous"))
