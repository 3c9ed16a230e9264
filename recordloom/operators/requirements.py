"""Requirement clauses to typed facts (K2): the cascade of rules, the first that matches decides.

A rule is a row of a table: a name, a test, a status and the facts that it
states, all columns over the clause.  The facts have the one form FACT, which
`operators.predicates` evaluates against a candidate.  Texts are read with the
punctuation that `functions.text.stable_text` leaves.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import requirement_words as w
from ..functions.text import SPACE, clauses

#: A fact: what is asked (dimension, operator, scope, kind), the value's parts that its kind has, and for whom (cohorts; null: for all).
FACT = (
    "struct<dimension:string,operator:string,scope:string,logic:string,kind:string,codes:array<string>,number:int,low:int,low_in:boolean,high:int,high_in:boolean,"
    "on:string,year:int,cohort:string,type:string,class:string,text:string,defined:boolean,rule:string,namespace:string,version:string,code:string,cohorts:array<string>>"
)


class Rule(NamedTuple):
    name: str
    test: Column
    status: Column | str
    facts: Column | None = None
    for_cohort: bool = True


_NUMBERS = ("number", "low", "high", "year")


def stated(dimension: str, operator: Column | str = "EQUALS", **parts: Column | str | int | bool) -> Column:
    """A FACT as JSON, so that a rule costs no more than the parts that it names; scope is CANDIDATE and logic AND where they aren't named."""
    parts = {"dimension": dimension, "operator": operator, "scope": "CANDIDATE", "logic": "AND", **parts}
    as_column = lambda n, v: (v.cast("int") if n in _NUMBERS else v) if isinstance(v, Column) else F.lit(v)
    return F.to_json(F.struct(*[as_column(n, v).alias(n) for n, v in parts.items()]))


def fact(dimension: str, operator: Column | str = "EQUALS", **parts: Column | str | int | bool) -> Column:
    """A FACT; parts that are not named are null."""
    return F.from_json(stated(dimension, operator, **parts), FACT)


def _mapped(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(value == a, F.lit(b)) for a, b in names.items()])


def _date(text: Column, pattern: str, first: int) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, first + i)
    return F.when(part(0) != "", F.concat_ws("-", part(0), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))


def major_items(text: Column) -> Column:
    """The items of a list of majors."""
    for cut in w.MAJOR_LIST_CUTS:
        text = F.regexp_replace(text, cut, "")
    items = F.transform(F.split(text, w.MAJOR_LIST_MARKS), lambda t: F.regexp_replace(t, w.MAJOR_ITEM_CUT, ""))
    return F.filter(items, lambda t: t != "")


def major_facts(items: Column, scope: Column | str, directory: Column) -> Column:
    """A FACT (as JSON) for each item, null for one that can't be told; families and program codes need the directory, struct(namespace, version) or null."""
    logic = F.when(F.size(items) > 1, "OR").otherwise("AND")

    def one(t: Column) -> Column:
        family, code = _mapped(t, w.MAJOR_FAMILIES), _mapped(t, w.MAJOR_CODES)
        program = F.coalesce(F.nullif(F.regexp_extract(t, w.PROGRAM_CODE_FIRST, 1), F.lit("")), F.nullif(F.regexp_extract(t, w.PROGRAM_LABEL_FIRST, 2), F.lit("")))
        coded = lambda c: stated("MAJOR", scope=scope, logic=logic, kind="CODE", codes=F.array(c))
        listed = stated("MAJOR", scope=scope, logic=logic, kind="PROGRAM_REFERENCE", namespace=directory["namespace"], version=directory["version"], code=program)
        return F.when(family.isNotNull(), F.when(directory.isNotNull(), coded(family))).when(code.isNotNull(), coded(code)).when(program.isNotNull() & directory.isNotNull(), listed)

    return F.transform(items, one)


def rules(text: Column, directory: Column, original: Column) -> list[Rule]:
    """The cascade over a clause without white space, list mark and cohort prefix (`text`); `original` still has the latter two."""
    g = lambda pattern, i: F.regexp_extract(text, pattern, i)
    has = lambda pattern: text.rlike(pattern)
    some = lambda pattern, i: g(pattern, i) != ""
    least = lambda pattern, i: F.when(some(pattern, i), "AT_LEAST").otherwise("EQUALS")
    code = lambda dimension, value, **p: stated(dimension, kind="CODE", codes=F.array(value), **p)
    law = lambda scope: code("MAJOR", F.lit("LAW_STUDIES"), scope=scope)
    any_major = lambda scope: stated("MAJOR", "UNRESTRICTED", kind="UNRESTRICTED", scope=scope)
    certificate = stated("PROFESSIONAL_QUALIFICATION", "EXISTS", kind="PROFESSIONAL_QUALIFICATION", type="LAWYER_PRACTICE_CERTIFICATE", text="REQUIRED")
    matching = lambda rule, **p: stated("MAJOR_MATCH_RULE", kind="MAJOR_MATCH_RULE", scope="ANY_EDUCATION", rule=rule, **p)
    years = lambda low, high, scope: stated("WORK_EXPERIENCE", "EXISTS", kind="WORK_EXPERIENCE", low=low, high=high, text=scope, defined=True)
    where = lambda c: F.regexp_replace(c, w.EXPERIENCE_TAIL, "")

    def region(pattern: str, dimension: str) -> Rule:
        value = g(pattern, 1)
        made = F.when(value.rlike(w.REGION_ANY), stated(dimension, "UNRESTRICTED", kind="UNRESTRICTED")).otherwise(code(dimension, value))
        return Rule(dimension, has(pattern), "FACT", F.array(made))

    def majors(items: Column, scope: Column | str, before: Column | None = None) -> tuple[Column, Column]:
        """Status and facts of a list: one item that can't be told leaves none."""
        found = major_facts(items, scope, directory)
        status = F.when(F.size(items) == 0, "UNPARSED").when(F.exists(found, lambda f: f.isNull()), "GAP").otherwise("FACT")
        return status, F.when(status == "FACT", found if before is None else F.concat(F.array(before), found))

    cohort = F.when(has(w.COHORT_NAMED), _mapped(g(w.COHORT_NAMED, 1), w.COHORT_CODES)).when(has(w.COHORT_ONLY), _mapped(g(w.COHORT_ONLY, 1), w.COHORT_CODES))
    scoped = F.when(has(w.MAJOR_SCOPED[0]), F.struct(g(w.MAJOR_SCOPED[0], 1).alias("s"), g(w.MAJOR_SCOPED[0], 2).alias("m"))).when(has(w.MAJOR_SCOPED[1]), F.struct(g(w.MAJOR_SCOPED[1], 1).alias("s"), g(w.MAJOR_SCOPED[1], 2).alias("m")))
    scope = _mapped(scoped["s"], w.EDUCATION_CODES)
    scoped_status, scoped_facts = majors(major_items(scoped["m"]), scope)
    scoped_any = scoped["m"].rlike(w.MAJOR_ANY)
    layered_status, layered_facts = majors(major_items(g(w.MAJOR_LAYERED, 1)), "MASTER", any_major("BACHELOR"))
    law_status, law_facts = majors(major_items(text), "ANY_EDUCATION")
    experience_scope = where(g(w.EXPERIENCE, 2))
    open_scope = experience_scope.rlike(w.EXPERIENCE_OPEN)
    listed = F.filter(F.split(g(w.MATCH_CODES, 1), "[,，、]"), lambda c: c != "")
    fresh = g(w.COHORT_YEAR, 2) == "应届毕业生"
    some_class = F.nullif(g(w.QUALIFICATION_CLASS, 1), F.lit(""))
    qualified = F.when(some_class.isNotNull(), stated("PROFESSIONAL_QUALIFICATION", "EXISTS", kind="PROFESSIONAL_QUALIFICATION", type="LEGAL_PROFESSIONAL_QUALIFICATION", text="REQUIRED", **{"class": some_class}))
    legal = has(w.QUALIFICATION)
    return [
        Rule("GENERAL_ELIGIBILITY", original.isin(w.GENERAL), "GAP"),
        Rule("EDUCATION", has(w.EDUCATION), "FACT", F.array(code("EDUCATION_LEVEL", _mapped(g(w.EDUCATION, 1), w.EDUCATION_CODES), operator=least(w.EDUCATION, 2)))),
        Rule("DEGREE", has(w.DEGREE), "FACT", F.array(code("ACADEMIC_DEGREE", _mapped(g(w.DEGREE, 1), w.DEGREE_CODES), operator=least(w.DEGREE, 2), scope=_mapped(g(w.DEGREE, 1), w.DEGREE_SCOPES)))),
        Rule("GENDER", has(w.GENDER), "FACT", F.array(code("GENDER", F.when(g(w.GENDER, 1).isin("男性", "男"), "MALE").otherwise("FEMALE")))),
        Rule("GENDER_UNRESTRICTED", has(w.GENDER_ANY), "FACT", F.array(code("GENDER", F.lit("ANY"), operator="UNRESTRICTED"))),
        Rule("AGE_RANGE", has(w.AGE_RANGE), F.when(some(w.AGE_RANGE, 5), "FACT").otherwise("AMBIGUOUS"), F.when(some(w.AGE_RANGE, 5), F.array(stated(
            "AGE", "EXISTS", kind="AGE_RANGE", low=g(w.AGE_RANGE, 1), low_in=g(w.AGE_RANGE, 2) != "大于", high=g(w.AGE_RANGE, 3), high_in=~g(w.AGE_RANGE, 4).isin("小于", "不满"), on=_date(text, w.AGE_RANGE, 5))))),
        Rule("AGE", has(w.AGE), F.when(some(w.AGE, 2), "FACT").otherwise("AMBIGUOUS"), F.when(some(w.AGE, 2), F.array(stated("AGE", "AT_MOST", kind="AGE", number=g(w.AGE, 1), on=_date(text, w.AGE, 2))))),
        Rule("COHORT_YEAR", has(w.COHORT_YEAR), "FACT", F.concat(
            F.array(stated("GRADUATION_YEAR", kind="GRADUATION_WINDOW", year=g(w.COHORT_YEAR, 1), cohort=F.when(fresh, "FRESH_GRADUATE"))), F.when(fresh, F.array(code("CANDIDATE_COHORT", F.lit("FRESH_GRADUATE")))).otherwise(F.array().cast("array<string>")))),
        Rule("COHORT", cohort.isNotNull(), "FACT", F.array(code("CANDIDATE_COHORT", cohort))),
        Rule("EXPERIENCE", has(w.EXPERIENCE), F.when(open_scope, "AMBIGUOUS").otherwise("FACT"), F.array(stated("WORK_EXPERIENCE", "AT_LEAST", kind="WORK_EXPERIENCE", low=g(w.EXPERIENCE, 1), text=experience_scope, on=_date(text, w.EXPERIENCE, 3), defined=~open_scope))),
        Rule("EXPERIENCE_RANGE", has(w.EXPERIENCE_RANGE), "FACT", F.array(years(g(w.EXPERIENCE_RANGE, 1), g(w.EXPERIENCE_RANGE, 2), where(g(w.EXPERIENCE_RANGE, 3)))), False),
        region(w.HOUSEHOLD, "HOUSEHOLD_REGISTRATION"),
        *[region(p, "STUDENT_ORIGIN") for p in w.ORIGIN],
        *[Rule("MAJOR_RELATION", has(p), "FACT", F.array(stated("MAJOR_SCOPE_RELATIONSHIP", kind="MAJOR_SCOPE_RELATIONSHIP", scope="ALL_EDUCATION", rule=mode))) for p, mode in w.MAJOR_RELATIONS],
        Rule("MATCH_RULE", text.isin(list(w.MATCH_RULES)), "FACT", F.array(matching(_mapped(text, w.MATCH_RULES))), False),
        Rule("MATCH_CODES", has(w.MATCH_CODES), F.when(F.size(listed) > 0, "FACT").otherwise("UNPARSED"), F.when(F.size(listed) > 0, F.array(matching("CODE_SET", codes=listed))), False),
        Rule("MATCH_DIRECTORY", has(w.MATCH_DIRECTORY), F.when(directory.isNull(), "GAP").otherwise("FACT"), F.when(directory.isNotNull(), F.array(matching("EXTERNAL_DIRECTORY_REFERENCE", namespace=directory["namespace"], version=directory["version"]))), False),
        Rule("MATCH_EXCEPTIONS", has(w.MATCH_EXCEPTIONS), "AMBIGUOUS", F.array(matching("EXCEPTION_LIST", text=text)), False),
        Rule("LAW_BOTH", has(w.LAW_BOTH), "FACT", F.array(law("BACHELOR"), law("MASTER"))),
        Rule("MAJOR_LAYERED", has(w.MAJOR_LAYERED), layered_status, layered_facts),
        Rule("MAJOR_SCOPED", scoped.isNotNull(), F.when(scoped_any, "FACT").otherwise(scoped_status), F.when(scoped_any, F.array(any_major(scope))).otherwise(scoped_facts)),
        Rule("MAJOR_UNRESTRICTED", has(w.MAJOR_UNRESTRICTED), "FACT", F.array(any_major("ANY_EDUCATION"))),
        Rule("QUALIFICATION_PREFERRED", legal & has(w.QUALIFICATION_PREFERRED) & ~has(w.QUALIFICATION_FIRM), "PREFERRED"),
        Rule("QUALIFICATION", legal & has(w.QUALIFICATION_REQUIRED), "FACT", F.array(F.coalesce(qualified, code("PROFESSIONAL_QUALIFICATION", F.lit("LEGAL_PROFESSIONAL_QUALIFICATION"), operator="EXISTS")))),
        Rule("PRACTICE_CERTIFICATE", has(w.PRACTICE_CERTIFICATE), "FACT", F.array(certificate), False),
        Rule("MAJOR_LAW", has(w.MAJOR_LAW), law_status, law_facts),
        Rule("SUBJECTIVE", has(w.SUBJECTIVE) | has(w.CONDUCT), "GAP"),
    ]


def compounds(text: Column) -> list[Rule]:
    """Clauses that state several things at once; a word of prestige in them is a gap beside the facts."""
    g = lambda pattern, i: F.regexp_extract(text, pattern, i)
    code = lambda dimension, value, **p: stated(dimension, kind="CODE", codes=F.array(F.lit(value)), **p)
    law = lambda scope: code("MAJOR", "LAW_STUDIES", scope=scope)
    praised = lambda pattern: F.when(g(pattern, 1) != "", "FACT_AND_GAP").otherwise("FACT")
    exact, later = g(w.INTERNSHIP, 2), g(w.INTERNSHIP, 3)
    year = F.when(exact != "", stated("GRADUATION_YEAR", kind="GRADUATION_WINDOW", year=F.nullif(exact, F.lit("")), cohort="FRESH_GRADUATE")).otherwise(stated("GRADUATION_YEAR", "AT_LEAST", kind="INTEGER", number=F.nullif(later, F.lit(""))))
    years = stated("WORK_EXPERIENCE", "EXISTS", kind="WORK_EXPERIENCE", low=g(w.LAWYER_YEARS, 1), high=g(w.LAWYER_YEARS, 2), text="律师", defined=True)
    certificate = stated("PROFESSIONAL_QUALIFICATION", "EXISTS", kind="PROFESSIONAL_QUALIFICATION", type="LAWYER_PRACTICE_CERTIFICATE", text="REQUIRED")
    return [
        Rule("INTERNSHIP", text.rlike(w.INTERNSHIP), praised(w.INTERNSHIP), F.array(
            law("ANY_EDUCATION"), year, code("CANDIDATE_COHORT", "CURRENT_STUDENT"), code("EDUCATION_LEVEL", "BACHELOR", logic="OR"), code("EDUCATION_LEVEL", "GRADUATE", logic="OR")), False),
        Rule("LAW_BACHELOR_MASTER", text.rlike(w.LAW_BACHELOR_MASTER), praised(w.LAW_BACHELOR_MASTER), F.array(law("BACHELOR"), law("MASTER")), False),
        Rule("LAWYER_YEARS", text.rlike(w.LAWYER_YEARS), "FACT", F.array(years, certificate), False),
    ]


def clause_rules(whole: Column, body: Column, bare: Column, directory: Column) -> Column:
    """struct(rule, status, facts as JSON, for_cohort) by the first rule that holds.

    status: FACT, AMBIGUOUS (facts, if any, are not settled), PREFERRED (a wish:
    no fact), GAP (understood, but of no fact), FACT_AND_GAP or UNPARSED.
    for_cohort: a clause of one cohort gives these facts for that one.
    """
    none = F.array().cast("array<string>")

    def made(r: Rule) -> Column:
        status = r.status if isinstance(r.status, Column) else F.lit(r.status)
        facts = none if r.facts is None else F.coalesce(r.facts, none)
        return F.when(r.test, F.struct(F.lit(r.name).alias("rule"), status.alias("status"), facts.alias("facts"), F.lit(r.for_cohort).alias("for_cohort")))

    otherwise = F.struct(F.lit("UNPARSED").alias("rule"), F.lit("UNPARSED").alias("status"), none.alias("facts"), F.lit(False).alias("for_cohort"))
    return F.coalesce(*[made(r) for r in [*compounds(whole), *rules(body, directory, bare)]], otherwise)


def parsed(fragments: DataFrame, id_col: str, text_col: str, directory: str | None = None) -> DataFrame:
    """id, place, clause, start, end, rule, status, facts (array<FACT>): a row for each clause of each fragment.

    A null or blank text has one row with the status NOT_OBSERVED: no text is
    no proof that nothing is asked.
    """
    d = F.col(directory) if directory else F.lit(None).cast("struct<namespace:string,version:string>")
    rows = fragments.select(F.col(id_col).alias("id"), d.alias("__d"), F.inline_outer(clauses(F.col(text_col))).alias("place", "clause", "start", "end"))
    rows = rows.withColumn("__bare", F.regexp_replace(F.coalesce("clause", F.lit("")), f"{SPACE}+", ""))
    rows = rows.withColumn("__whole", F.regexp_replace("__bare", w.LIST_MARK, ""))
    cohort = _mapped(F.regexp_extract("__whole", w.FOR_COHORT, 1), w.COHORT_CODES)
    rows = rows.withColumns({"__cohorts": F.when(cohort.isNotNull(), F.array(cohort)), "__body": F.when(cohort.isNotNull(), F.regexp_extract("__whole", w.FOR_COHORT, 2)).otherwise(F.col("__whole"))})
    seen = F.col("clause").isNotNull()

    def told(r: Column) -> Column:
        made = F.from_json(F.concat(F.lit("["), F.array_join(r["facts"], ","), F.lit("]")), f"array<{FACT}>")
        meant = F.col("__cohorts").isNotNull() & r["for_cohort"]
        facts = F.when(~seen, F.array().cast(f"array<{FACT}>")).when(meant, F.transform(made, lambda f: f.withField("cohorts", F.col("__cohorts")))).otherwise(made)
        return F.struct(F.when(seen, r["rule"]).alias("rule"), F.when(seen, r["status"]).otherwise("NOT_OBSERVED").alias("status"), facts.alias("facts"))

    # bound to a name in a lambda: the optimiser would put the whole cascade in place of each use of a column
    found = rows.withColumn("__r", F.transform(F.array(clause_rules(F.col("__whole"), F.col("__body"), F.col("__bare"), F.col("__d"))), told)[0])
    return found.select("id", "place", "clause", "start", "end", "__r.rule", "__r.status", "__r.facts")


def completeness(found: DataFrame) -> DataFrame:
    """id, completeness, blockers (places): COMPLETE, REVIEW_REQUIRED where a clause is not understood, INCOMPLETE where none was there."""
    blocks = ~F.col("status").isin("FACT", "PREFERRED")
    g = found.groupBy("id").agg(F.array_sort(F.collect_list(F.when(blocks, F.col("place")))).alias("blockers"), F.max(blocks.cast("int")).alias("blocked"), F.max((F.col("status") == "NOT_OBSERVED").cast("int")).alias("unseen"))
    state = F.when(F.col("unseen") == 1, "INCOMPLETE").when(F.col("blocked") == 1, "REVIEW_REQUIRED").otherwise("COMPLETE")
    return g.select("id", state.alias("completeness"), "blockers")


def major_expression(text: Column, directory: Column, in_list: Column) -> Column:
    """struct(status, diagnostic, expressions) of a major expression (K3).

    A list is cut only where it is known to be one (`in_list`) and never within
    parentheses.  Code 0351 needs a directory with that code, families one with
    a version; directory is struct(namespace, version, code) or null.
    """
    from ..functions.text import split_outside

    bare = F.regexp_replace(F.regexp_replace(F.translate(text, "（）", "()"), f"{SPACE}+", ""), r"^专业(?:要求)?[:：]", "")
    items = split_outside(bare)
    versioned = directory["namespace"].isNotNull() & directory["version"].isNotNull()

    def one(t: Column) -> Column:
        made = []
        for pattern, semantic, scope, identity, kind in w.MAJOR_EXPRESSIONS:
            open_ = ~F.coalesce(versioned & ((directory["code"] == "0351") if identity == "LAW_0351" else F.lit(True)), F.lit(False)) if kind in ("CATEGORY", "DIRECTORY_REFERENCE") else F.lit(semantic == "UNRESOLVED")
            made.append(F.when(t.rlike(pattern), F.struct(t.alias("text"), F.lit(semantic).alias("type"), F.when(open_, "UNRESOLVED").otherwise(scope).alias("scope"), F.lit(identity).alias("identity"), F.lit(kind).alias("kind"), (~open_).alias("resolved"))))
        semantic, scope, identity, kind = w.MAJOR_EXPRESSION_OTHERWISE
        return F.coalesce(*made, F.struct(t.alias("text"), F.lit(semantic).alias("type"), F.lit(scope).alias("scope"), F.lit(identity).alias("identity"), F.lit(kind).alias("kind"), F.lit(True).alias("resolved")))

    expressions = F.transform(items, one)
    unresolved = F.exists(expressions, lambda e: ~e["resolved"])
    diagnostic = (
        F.when(F.size(items) == 0, "MAJOR_EXPRESSION_UNRESOLVED")
        .when((F.size(items) > 1) & ~F.coalesce(in_list, F.lit(False)), "MAJOR_LIST_CONTEXT_UNPROVEN")
        .when(unresolved & F.exists(expressions, lambda e: e["identity"] == "LAW_0351"), "DIRECTORY_VERSION_UNRESOLVED")
        .when(unresolved, "MAJOR_EXPRESSION_UNRESOLVED")
    )
    cut = diagnostic.isin("MAJOR_LIST_CONTEXT_UNPROVEN")
    return F.struct(F.when(diagnostic.isNull(), "RESOLVED").otherwise("UNRESOLVED").alias("status"), diagnostic.alias("diagnostic"), F.when(~F.coalesce(cut, F.lit(False)), expressions).alias("expressions"))


def major_relation(expression: Column, candidate: Column, kind: Column, directory: Column) -> Column:
    """struct(state, fault) of a relation between a major that is asked for and a candidate's (K4).

    A fault says why there can be none: an expression that is not resolved, a
    directory membership without namespace, version and code, an unrestricted
    relation to a restricted major, or an exact one between different majors.
    """
    versioned = F.coalesce(directory["namespace"].isNotNull() & directory["version"].isNotNull() & directory["code"].isNotNull(), F.lit(False))
    fault = (
        F.when(~F.coalesce(expression["resolved"], F.lit(False)), "SOURCE_UNRESOLVED")
        .when((kind == "DIRECTORY_MEMBERSHIP") & ~versioned, "DIRECTORY_UNVERSIONED")
        .when((kind == "UNRESTRICTED") & (expression["scope"] != "UNRESTRICTED"), "SCOPE_RESTRICTED")
        .when((kind == "EXACT_IDENTITY") & ~F.coalesce(expression["identity"] == candidate, F.lit(False)), "IDENTITY_DIFFERS")
    )
    return F.struct(F.when(fault.isNull(), F.when(kind == "NOT_ESTABLISHED", "NOT_ESTABLISHED").otherwise("ESTABLISHED")).alias("state"), fault.alias("fault"))
