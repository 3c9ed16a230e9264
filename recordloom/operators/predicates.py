"""A requirement fact against a candidate's profile: the predicate of each dimension (L2), as three-valued levels.

Facts have the form `requirements.FACT`, profiles the form PROFILE; both are
struct columns of one row, so facts meet candidates in a plain join and nothing
else is shuffled.  What a profile does not tell is UNKNOWN, never FALSE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import requirement_words as w
from ..functions.kleene import FALSE, TRUE, UNKNOWN
from ..functions.text import full_years

PROGRAM = "struct<namespace:string,version:string,code:string,type:string,category:string>"
CREDENTIAL = f"struct<level:string,codes:array<string>,degrees:array<string>,type:string,name:string,programs:array<{PROGRAM}>>"
PROFILE = (
    f"struct<education:array<{CREDENTIAL}>,gender:string,birth:string,cohorts:array<string>,households:array<string>,origins:array<string>,"
    "qualifications:array<struct<code:string,type:string,class:string,status:string>>,graduation:int,months:int,experience:array<struct<scope:string,years:int>>,languages:array<string>,politics:string>"
)
#: Proof that two programs are, or are not, equal.
EQUIVALENCE = "struct<namespace:string,version:string,from_code:string,from_type:string,to_code:string,to_type:string,status:string>"

# States of a qualification that count as held.
HELD = ("OBTAINED", "PASSED_PENDING_CERTIFICATE")


def _level(holds: Column) -> Column:
    return F.when(holds, F.lit(TRUE)).otherwise(F.lit(FALSE))


def _size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def _none(a: Column) -> Column:
    return a.isNull() | (F.size(a) == 0)


def _compared(f: Column, actual: Column, expected: Column) -> Column:
    """Whether a number is at least, at most or exactly what is asked."""
    return F.when(f["operator"] == "AT_LEAST", actual >= expected).when(f["operator"] == "AT_MOST", actual <= expected).otherwise(actual == expected)


def _within(actual: Column, low: Column, low_in: Column, high: Column, high_in: Column) -> Column:
    above = low.isNull() | F.when(F.coalesce(low_in, F.lit(True)), actual >= low).otherwise(actual > low)
    below = high.isNull() | F.when(F.coalesce(high_in, F.lit(True)), actual <= high).otherwise(actual < high)
    return above & below


def _asked(f: Column, text: bool = False) -> Column:
    """The codes of a value, null where its kind has none."""
    out = F.when(f["kind"].isin("CODE", "CODE_SET"), f["codes"])
    return out.when(f["kind"] == "TEXT", F.array(f["text"])) if text else out


def _holds(f: Column, actual: Column, expected: Column) -> Column:
    """Whether all (operator ALL_OF) or any of the expected strings are there."""
    return F.when(f["operator"] == "ALL_OF", F.size(F.array_except(expected, actual)) == 0).otherwise(F.arrays_overlap(expected, actual))


def _strings(f: Column, actual: Column) -> Column:
    expected = _asked(f, True)
    return F.when(_none(actual) | expected.isNull(), F.lit(UNKNOWN)).otherwise(_level(_holds(f, actual, expected)))


def in_scope(f: Column, education: Column) -> Column:
    """The credentials that a fact's scope means."""
    scope = f["scope"]
    return (
        F.when(scope.isin("BACHELOR", "MASTER", "DOCTOR"), F.filter(education, lambda c: c["level"] == scope))
        .when(scope == "GRADUATE", F.filter(education, lambda c: c["level"].isin("MASTER", "DOCTOR")))
        .otherwise(education)
    )


def _rank(level: Column) -> Column:
    return F.coalesce(*[F.when(level == a, F.lit(r)) for a, r in w.EDUCATION_RANKS.items()])


def education_level(f: Column, c: Column) -> Column:
    code, levels = F.get(f["codes"], 0), F.transform(c["education"], lambda e: F.coalesce(_rank(e["level"]), F.lit(0)))
    asked = _rank(code)
    graduate = F.exists(c["education"], lambda e: e["level"].isin("MASTER", "DOCTOR"))
    holds = (
        F.when(code == "GRADUATE", graduate)
        .when(f["operator"] == "AT_LEAST", F.array_max(levels) >= asked)
        .when(f["operator"] == "AT_MOST", F.array_max(levels) <= asked)
        .otherwise(F.array_contains(levels, asked))
    )
    told = ~_none(c["education"]) & (f["kind"] == "CODE") & (asked.isNotNull() | (code == "GRADUATE"))
    return F.when(F.coalesce(told, F.lit(False)), _level(holds)).otherwise(F.lit(UNKNOWN))


def program(f: Column, credentials: Column, equivalences: Column) -> Column:
    """A program asked for by directory and code: the same one, or one that a proof makes equal."""
    held = F.flatten(F.transform(credentials, lambda e: F.transform(F.coalesce(e["programs"], F.array().cast(f"array<{PROGRAM}>")), lambda p: p.withField("type", F.coalesce(e["type"], p["type"])))))
    same = F.filter(held, lambda p: p["namespace"].eqNullSafe(f["namespace"]) & p["version"].eqNullSafe(f["version"]))
    plain = lambda t: F.coalesce(t, F.lit("UNSPECIFIED"))

    def one(p: Column) -> Column:
        def about(q: Column) -> Column:
            there = (q["from_code"] == f["code"]) & (q["from_type"] == plain(f["type"])) & (q["to_code"] == p["code"]) & (q["to_type"] == plain(p["type"]))
            back = (q["to_code"] == f["code"]) & (q["to_type"] == plain(f["type"])) & (q["from_code"] == p["code"]) & (q["from_type"] == plain(p["type"]))
            return (q["namespace"] == f["namespace"]) & (q["version"] == f["version"]) & (there | back)

        proofs = F.filter(F.coalesce(equivalences, F.array().cast(f"array<{EQUIVALENCE}>")), about)
        equal, other = F.exists(proofs, lambda q: q["status"] == "EXPLICIT_EQUIVALENT"), F.exists(proofs, lambda q: q["status"] == "NOT_EQUIVALENT")
        proven = F.when(f["version"].isNull() | (equal & other), F.lit(UNKNOWN)).when(equal, F.lit(TRUE)).when(other, F.lit(FALSE)).otherwise(F.lit(UNKNOWN))
        return F.when((p["code"] == f["code"]) & p["type"].eqNullSafe(f["type"]), F.lit(TRUE)).otherwise(proven)

    return F.when(_none(held), F.lit(UNKNOWN)).when(F.size(same) == 0, F.lit(FALSE)).otherwise(F.array_max(F.transform(same, one)))


def major(f: Column, c: Column, equivalences: Column) -> Column:
    credentials, expected = in_scope(f, c["education"]), _asked(f)
    fits = lambda e: F.coalesce(_holds(f, e["codes"], expected), F.lit(False))
    by_code = F.when(f["scope"] == "ALL_EDUCATION", F.forall(credentials, fits)).otherwise(F.exists(credentials, fits))
    return (
        F.when(_none(credentials), F.lit(UNKNOWN))
        .when(f["kind"] == "PROGRAM_REFERENCE", program(f, credentials, equivalences))
        .when(expected.isNull(), F.lit(UNKNOWN))
        .otherwise(_level(by_code))
    )


def academic_degree(f: Column, c: Column) -> Column:
    known, expected = F.filter(in_scope(f, c["education"]), lambda e: e["degrees"].isNotNull()), _asked(f)
    return F.when(_none(known) | expected.isNull(), F.lit(UNKNOWN)).otherwise(_level(F.exists(known, lambda e: _holds(f, e["degrees"], expected))))


def match_rule(f: Column, c: Column) -> Column:
    """Whether a profile has what a rule of matching majors compares."""
    programs = F.flatten(F.transform(c["education"], lambda e: F.coalesce(e["programs"], F.array().cast(f"array<{PROGRAM}>"))))
    codes = F.concat(F.flatten(F.transform(c["education"], lambda e: F.coalesce(e["codes"], F.array().cast("array<string>")))), F.transform(programs, lambda p: p["code"]))
    proven = lambda holds: F.when(holds, F.lit(TRUE)).otherwise(F.lit(UNKNOWN))
    listed = F.exists(programs, lambda p: p["namespace"].eqNullSafe(f["namespace"]) & p["version"].eqNullSafe(f["version"]))
    rule = f["rule"]
    return (
        F.when(_none(c["education"]) | (f["kind"] != "MAJOR_MATCH_RULE") | (rule == "EXCEPTION_LIST"), F.lit(UNKNOWN))
        .when(rule == "EXACT_NAME", proven(F.exists(c["education"], lambda e: F.coalesce(e["name"], F.lit("")) != "")))
        .when(rule == "EXACT_CODE", proven(F.size(codes) > 0))
        .when(rule == "CATEGORY", proven(F.exists(programs, lambda p: F.coalesce(p["category"], F.lit("")) != "")))
        .when(rule == "CODE_SET", F.when(F.size(codes) == 0, F.lit(UNKNOWN)).otherwise(_level(F.arrays_overlap(f["codes"], codes))))
        .when((rule == "EXTERNAL_DIRECTORY_REFERENCE") & (F.size(programs) > 0), _level(listed))
        .otherwise(F.lit(UNKNOWN))
    )


def age(f: Column, c: Column) -> Column:
    birth, on = F.try_to_date(c["birth"], "yyyy-MM-dd"), F.try_to_date(f["on"], "yyyy-MM-dd")
    years = full_years(birth, on)
    holds = F.when(f["kind"] == "AGE_RANGE", _within(years, f["low"], f["low_in"], f["high"], f["high_in"])).otherwise(_compared(f, years, f["number"]))
    return F.when(f["kind"].isin("AGE", "AGE_RANGE") & years.isNotNull(), _level(holds)).otherwise(F.lit(UNKNOWN))


def qualification(f: Column, c: Column) -> Column:
    held = lambda a: F.exists(a, lambda q: q["status"].isin(*HELD))
    denied = lambda a: F.forall(a, lambda q: q["status"] == "NOT_OBTAINED")
    settled = lambda a: F.when(held(a), F.lit(TRUE)).when(denied(a), F.lit(FALSE)).otherwise(F.lit(UNKNOWN))
    of_type = F.filter(c["qualifications"], lambda q: F.coalesce(q["type"], q["code"]) == f["type"])
    of_class = F.filter(of_type, lambda q: f["class"].isNull() | F.coalesce(q["class"] == f["class"], F.lit(False)))
    open_class = F.exists(of_type, lambda q: q["class"].isNull() | (q["status"] == "UNKNOWN"))
    typed = (
        F.when(F.coalesce(f["text"], F.lit("")) == "PREFERRED", F.lit(TRUE))
        .when(_size(of_type) <= 0, F.lit(UNKNOWN))
        .when(f["class"].isNotNull() & (F.size(of_class) == 0), F.when(open_class, F.lit(UNKNOWN)).otherwise(F.lit(FALSE)))
        .otherwise(settled(of_class))
    )
    coded = F.filter(c["qualifications"], lambda q: F.array_contains(_asked(f), q["code"]))
    return F.when(f["kind"] == "PROFESSIONAL_QUALIFICATION", typed).when(_asked(f).isNull() | (_size(coded) <= 0), F.lit(UNKNOWN)).otherwise(settled(coded))


def graduation(f: Column, c: Column) -> Column:
    year = c["graduation"]
    known = lambda there, holds: F.when(~there, F.lit(UNKNOWN)).otherwise(_level(holds))
    parts = F.filter(F.array(
        F.when(f["year"].isNotNull(), known(year.isNotNull(), year == f["year"])),
        F.when(f["low"].isNotNull() | f["high"].isNotNull(), known(year.isNotNull(), _within(year, f["low"], f["low_in"], f["high"], f["high_in"]))),
        F.when(f["cohort"].isNotNull(), known(~_none(c["cohorts"]), F.array_contains(c["cohorts"], f["cohort"]))),
    ), lambda p: p.isNotNull())
    window = F.when(F.size(parts) == 0, F.lit(UNKNOWN)).otherwise(F.array_min(parts))
    return F.when(f["kind"] == "INTEGER", F.when(year.isNull(), F.lit(UNKNOWN)).otherwise(_level(_compared(f, year, f["number"])))).when(f["kind"] == "GRADUATION_WINDOW", window).otherwise(F.lit(UNKNOWN))


def experience(f: Column, c: Column) -> Column:
    months = F.when(c["months"].isNull(), F.lit(UNKNOWN)).otherwise(_level(_compared(f, c["months"], f["number"])))
    same = F.filter(c["experience"], lambda e: F.trim(e["scope"]) == F.trim(f["text"]))
    enough = F.exists(same, lambda e: (e["years"] >= f["low"]) & (f["high"].isNull() | (e["years"] <= f["high"])))
    named = F.when(F.coalesce(f["defined"], F.lit(False)) & (_size(same) > 0), _level(enough)).otherwise(F.lit(UNKNOWN))
    return F.when(f["kind"] == "INTEGER", months).when(f["kind"] == "WORK_EXPERIENCE", named).otherwise(F.lit(UNKNOWN))


def outcome(f: Column, c: Column, polarity: Column, equivalences: Column | None = None) -> Column:
    """The level of fact `f` for profile `c`: 0, 1 or 2.

    Operators NOT_EQUALS and NONE_OF, and the polarity NEGATIVE, turn a known
    level round.  Dimensions that no predicate decides are UNKNOWN.
    """
    equivalences = F.lit(None).cast(f"array<{EQUIVALENCE}>") if equivalences is None else equivalences
    gender = F.when(F.coalesce(c["gender"], F.lit("UNKNOWN")) == "UNKNOWN", F.lit(UNKNOWN)).otherwise(_strings(f, F.array(c["gender"])))
    politics = F.when(c["politics"].isNull(), F.lit(UNKNOWN)).otherwise(_strings(f, F.array(c["politics"])))
    table = {
        "EDUCATION_LEVEL": education_level(f, c), "MAJOR": major(f, c, equivalences), "MAJOR_MATCH_RULE": match_rule(f, c), "ACADEMIC_DEGREE": academic_degree(f, c), "AGE": age(f, c), "GENDER": gender,
        "CANDIDATE_COHORT": _strings(f, c["cohorts"]), "HOUSEHOLD_REGISTRATION": _strings(f, c["households"]), "STUDENT_ORIGIN": _strings(f, c["origins"]),
        "PROFESSIONAL_QUALIFICATION": qualification(f, c), "GRADUATION_YEAR": graduation(f, c), "WORK_EXPERIENCE": experience(f, c), "LANGUAGE": _strings(f, c["languages"]), "POLITICAL_AFFILIATION": politics,
    }
    level = F.coalesce(*[F.when(f["dimension"] == d, v) for d, v in table.items()], F.lit(UNKNOWN))
    # rules of matching only say whether there is something to compare: no operator turns them round
    turned = f["operator"].isin("NOT_EQUALS", "NONE_OF") & (f["dimension"] != "MAJOR_MATCH_RULE")
    level = F.when(F.coalesce(turned, F.lit(False)), F.lit(TRUE) - level).otherwise(level)
    free = F.coalesce((f["operator"] == "UNRESTRICTED") | (f["kind"] == "UNRESTRICTED"), F.lit(False))
    level = F.when(free, F.lit(TRUE)).otherwise(level)
    return F.when(F.coalesce(polarity == "NEGATIVE", F.lit(False)), F.lit(TRUE) - level).otherwise(level)


def applies(f: Column, c: Column) -> Column:
    """Whether a fact is meant for the candidate: TRUE for all, else by cohort; UNKNOWN where the profile names none."""
    return F.when(f["cohorts"].isNull(), F.lit(TRUE)).when(_none(c["cohorts"]), F.lit(UNKNOWN)).otherwise(_level(F.arrays_overlap(f["cohorts"], c["cohorts"])))
