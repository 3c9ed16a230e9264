"""A requirement fact against dated evidence about a candidate (L7): a resolution with its reason.

One template serves all dimensions: evidence of the kind asked for, in force at
the instant asked about; none is INSUFFICIENT, unconfirmed likewise (or up for
review), values that differ are up for review, and only then is compared.  The
dimensions deviate from it where their functions say so.  Facts have the form
`requirements.FACT`, evidence is an array of EVIDENCE in the same row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import requirement_words as w
from ..functions.text import full_years
from .predicates import HELD, PROGRAM, _within

EVIDENCE = (
    "struct<kind:string,status:string,observed:timestamp_ntz,begins:timestamp_ntz,ends:timestamp_ntz,level:string,completeness:string,codes:array<string>,background:string,"
    f"program:string,programs:array<{PROGRAM}>,identity:string,provenance:string,year:int,birth:string,gender:string,type:string,class:string,held:string>"
)
#: Relations of a major asked for to candidates' majors, for the semantic form of a major.
RELATION = "struct<candidate:string,kind:string,state:string,certainty:string>"

# Relations between majors that prove a match, and the one that disproves it.
INCLUDING, EXCLUDING = ("EXACT_IDENTITY", "EXPLICIT_INCLUDED", "UNRESTRICTED"), "EXPLICIT_EXCLUDED"
PROTECTED_CODE, PROTECTED_PROGRAM = "0351", "LAW_MASTER_NON_LAW"


def _as(status: str | Column, reason: str | None = None) -> Column:
    status = status if isinstance(status, Column) else F.lit(status)
    return F.struct(status.alias("status"), F.lit(reason).cast("string").alias("reason"))


def _resolved(match: Column) -> Column:
    return _as(F.when(match, "RESOLVED_MATCH").otherwise("RESOLVED_NOT_MATCH"))


_MISSING, _WEAK, _CONFLICT = (lambda: _as("INSUFFICIENT", "CANDIDATE_EVIDENCE_MISSING")), (lambda: _as("INSUFFICIENT", "CANDIDATE_EVIDENCE_INSUFFICIENT")), (lambda: _as("REVIEW_REQUIRED", "CANDIDATE_EVIDENCE_CONFLICT"))
_NO_RULE, _PROTECTED = (lambda: _as("REVIEW_REQUIRED", "SAFE_RULE_NOT_IMPLEMENTED")), (lambda: _as("REVIEW_REQUIRED", "LAW_0351_APPLICABILITY_UNRESOLVED"))


def template(evidence: Column, kind: str, value: Callable[[Column], Column], compare: Callable[[Column], Column], reviews: bool = False) -> Column:
    """The steps up to the comparison of the one confirmed value; with `reviews`, evidence under review is a conflict."""
    rows = F.filter(evidence, lambda e: e["kind"] == kind)
    values = F.array_distinct(F.transform(rows, value))
    out = F.when(F.size(rows) == 0, _MISSING())
    if reviews:
        out = out.when(F.exists(rows, lambda e: e["status"] == "REVIEW_REQUIRED"), _CONFLICT())
    return out.when(F.exists(rows, lambda e: ~F.coalesce(e["status"] == "CONFIRMED", F.lit(False))), _WEAK()).when(F.size(values) != 1, _CONFLICT()).otherwise(compare(F.get(values, 0)))


def _credentials(evidence: Column, compare: Callable[[Column], Column]) -> Column:
    """As the template, but unconfirmed or incomplete credentials are set aside as long as one is left."""
    rows = F.filter(evidence, lambda e: e["kind"] == "EDUCATION_CREDENTIAL")
    sure = F.filter(rows, lambda e: (e["status"] == "CONFIRMED") & (e["completeness"] == "COMPLETE"))
    return F.when(F.size(rows) == 0, _MISSING()).when(F.size(sure) == 0, _WEAK()).otherwise(compare(sure))


def education(f: Column, evidence: Column) -> Column:
    """Credentials don't tell what else somebody has: no match is INSUFFICIENT, never a mismatch."""
    rank = lambda level: F.coalesce(*[F.when(level == a, F.lit(r)) for a, r in w.EDUCATION_RANKS.items()])
    asked = rank(F.get(f["codes"], 0))

    def compare(rows: Column) -> Column:
        fits = lambda e: F.when(f["operator"] == "AT_LEAST", F.coalesce(rank(e["level"]), F.lit(0)) >= asked).when(f["operator"] == "AT_MOST", F.coalesce(rank(e["level"]), F.lit(0)) <= asked).otherwise(F.coalesce(rank(e["level"]), F.lit(0)) == asked)
        known = (f["kind"] == "CODE") & asked.isNotNull() & f["operator"].isin("AT_LEAST", "AT_MOST", "EQUALS")
        return F.when(~F.coalesce(known, F.lit(False)), _NO_RULE()).when(F.exists(rows, fits), _resolved(F.lit(True))).otherwise(_WEAK())

    return _credentials(evidence, compare)


def major(f: Column, evidence: Column, relations: Column) -> Column:
    """A mismatch needs complete credentials all over; the protected code says nothing about one kind of program."""
    codes = F.when(f["kind"].isin("CODE", "CODE_SET"), f["codes"])

    def compare(rows: Column) -> Column:
        guarded = F.exists(rows, lambda e: e["program"] == PROTECTED_PROGRAM)
        listed = F.flatten(F.transform(rows, lambda e: F.coalesce(e["programs"], F.array().cast(f"array<{PROGRAM}>"))))
        same = F.filter(listed, lambda p: (p["namespace"] == f["namespace"]) & p["version"].eqNullSafe(f["version"]))
        by_program = F.when(F.size(same) > 0, _resolved(F.exists(same, lambda p: p["code"] == f["code"]))).when((f["code"] == PROTECTED_CODE) & guarded, _PROTECTED()).otherwise(_WEAK())
        backgrounds = F.array_intersect(codes, F.array(F.lit("LAW"), F.lit("NON_LAW")))
        by_background = F.when(F.exists(rows, lambda e: F.coalesce(e["background"], F.lit("UNKNOWN")) == "UNKNOWN"), _WEAK()).otherwise(_resolved(F.exists(rows, lambda e: F.array_contains(backgrounds, e["background"]))))
        known = F.flatten(F.transform(rows, lambda e: F.coalesce(e["codes"], F.array().cast("array<string>"))))
        complete = F.forall(rows, lambda e: (e["completeness"] == "COMPLETE") & F.coalesce(e["provenance"] == "COMPLETE", F.lit(False)))
        by_code = (
            F.when(F.array_contains(codes, "LAW_STUDIES_FAMILY") & F.forall(rows, lambda e: F.coalesce(e["background"] == "NON_LAW", F.lit(False))), _resolved(F.lit(False)))
            .when(F.size(known) == 0, _WEAK())
            .when(F.arrays_overlap(known, codes), _resolved(F.lit(True)))
            .when(complete, _resolved(F.lit(False)))
            .otherwise(_WEAK())
        )
        return (
            F.when(f["kind"] == "PROGRAM_REFERENCE", by_program)
            .when(F.coalesce(F.array_contains(codes, PROTECTED_CODE), F.lit(False)) & guarded, _PROTECTED())
            .when(f["kind"] == "MAJOR_SEMANTIC", semantic_major(f, rows, relations))
            .when(codes.isNull() | (F.size(codes) == 0), _NO_RULE())
            .when(F.size(backgrounds) > 0, by_background)
            .otherwise(by_code)
        )

    return _credentials(evidence, compare)


def semantic_major(f: Column, rows: Column, relations: Column) -> Column:
    """A major by what it means: the same identity, else the relations that are established; both ways at once need review."""
    by_identity = F.when(F.exists(rows, lambda e: ~F.coalesce(e["provenance"] == "COMPLETE", F.lit(False))), _WEAK()).otherwise(_resolved(F.exists(rows, lambda e: e["identity"] == f["code"])))

    def one(e: Column) -> Column:
        mine = F.filter(F.coalesce(relations, F.array().cast(f"array<{RELATION}>")), lambda r: (r["candidate"] == e["identity"]) & (r["state"] == "ESTABLISHED"))
        yes = F.exists(mine, lambda r: (r["certainty"] != "UNRESOLVED") & r["kind"].isin(*INCLUDING))
        no = F.exists(mine, lambda r: (r["certainty"] == "EXPLICIT") & (r["kind"] == EXCLUDING))
        return F.when(yes, "TRUE").when(no, "FALSE").otherwise("UNKNOWN")

    found = F.transform(rows, one)
    has = lambda v: F.array_contains(found, v)
    related = F.when(has("TRUE") & has("FALSE"), _CONFLICT()).when(has("TRUE"), _resolved(F.lit(True))).when(has("FALSE"), _resolved(F.lit(False))).otherwise(_PROTECTED())
    return F.when(~F.coalesce(f["defined"], F.lit(False)), _as("REVIEW_REQUIRED", "SOURCE_REQUIREMENT_UNRESOLVED")).when(f["rule"] == "EXACT_IDENTITY", by_identity).otherwise(related)


def graduation(f: Column, evidence: Column) -> Column:
    def compare(year: Column) -> Column:
        ranged = f["low"].isNotNull() & f["high"].isNotNull()
        return F.when(f["kind"] != "GRADUATION_WINDOW", _NO_RULE()).when(f["year"].isNotNull(), _resolved(year == f["year"])).when(ranged, _resolved(_within(year, f["low"], f["low_in"], f["high"], f["high_in"]))).otherwise(_NO_RULE())

    return template(evidence, "TARGET_GRADUATION_YEAR", lambda e: e["year"], compare, reviews=True)


def age(f: Column, evidence: Column, at: Column) -> Column:
    """A reference date that is still to come can't be answered yet."""

    def compare(birth: Column) -> Column:
        on = F.when(f["kind"].isin("AGE", "AGE_RANGE"), F.try_to_date(f["on"], "yyyy-MM-dd"))
        years = full_years(F.try_to_date(birth, "yyyy-MM-dd"), on)
        plain = F.when(f["operator"] == "AT_LEAST", years >= f["number"]).when(f["operator"] == "AT_MOST", years <= f["number"]).when(f["operator"] == "EQUALS", years == f["number"])
        single = F.when(plain.isNull(), _NO_RULE()).otherwise(_resolved(plain))
        return F.when(on.isNull() | (on.cast("timestamp_ntz") > at), _as("REVIEW_REQUIRED", "TEMPORAL_CONTEXT_UNRESOLVED")).when(f["kind"] == "AGE", single).otherwise(_resolved(_within(years, f["low"], f["low_in"], f["high"], f["high_in"])))

    return template(evidence, "DATE_OF_BIRTH", lambda e: e["birth"], compare)


def gender(f: Column, evidence: Column) -> Column:
    def compare(value: Column) -> Column:
        plain = (f["kind"] == "CODE") & (f["operator"] == "EQUALS")
        return F.when(F.coalesce(value, F.lit("UNKNOWN")) == "UNKNOWN", _WEAK()).when(~F.coalesce(plain, F.lit(False)), _NO_RULE()).otherwise(_resolved(value == F.get(f["codes"], 0)))

    return template(evidence, "GENDER", lambda e: e["gender"], compare)


def qualification(f: Column, evidence: Column) -> Column:
    """Only evidence of the type (and class) asked for counts; a pass that awaits its certificate counts as held."""
    rows = F.filter(evidence, lambda e: e["kind"] == "PROFESSIONAL_QUALIFICATION")
    mine = F.filter(rows, lambda e: (e["type"] == f["type"]) & (f["class"].isNull() | F.coalesce(e["class"] == f["class"], F.lit(False))))
    held = F.transform(mine, lambda e: e["held"].isin(*HELD))
    return (
        F.when(F.size(rows) == 0, _MISSING())
        .when(f["kind"] != "PROFESSIONAL_QUALIFICATION", _NO_RULE())
        .when(F.size(mine) == 0, _WEAK())
        .when(F.exists(mine, lambda e: e["status"] == "REVIEW_REQUIRED"), _CONFLICT())
        .when(F.exists(mine, lambda e: ~F.coalesce(e["status"] == "CONFIRMED", F.lit(False)) | (F.coalesce(e["held"], F.lit("UNKNOWN")) == "UNKNOWN")), _WEAK())
        .when(F.size(F.array_distinct(held)) > 1, _CONFLICT())
        .otherwise(_resolved(F.get(held, 0)))
    )


# Kinds of evidence that a dimension can be answered by.
ADDRESSES = {"EDUCATION_LEVEL": "EDUCATION_CREDENTIAL", "MAJOR": "EDUCATION_CREDENTIAL", "ACADEMIC_DEGREE": "EDUCATION_CREDENTIAL", "AGE": "DATE_OF_BIRTH", "GENDER": "GENDER", "PROFESSIONAL_QUALIFICATION": "PROFESSIONAL_QUALIFICATION"}


def resolution(f: Column, evidence: Column, at: Column, applies: Column, settled: Column, relations: Column | None = None) -> Column:
    """struct(status, reason) of fact `f` at instant `at` (timestamp_ntz).

    settled: whether the requirement itself is clear; applies: 0 (not meant for
    the candidate), 1 (not known) or 2.  A fact that doesn't apply is UNKNOWN,
    neither met nor missed.  Evidence that holds at another time only is told
    apart from none.
    """
    rows = F.coalesce(evidence, F.array().cast(f"array<{EVIDENCE}>"))
    relations = F.lit(None).cast(f"array<{RELATION}>") if relations is None else relations
    now = lambda e: (e["observed"] <= at) & (e["begins"].isNull() | (e["begins"] <= at)) & (e["ends"].isNull() | (e["ends"] >= at))
    usable = F.filter(rows, lambda e: F.coalesce(now(e), F.lit(False)))
    kind = F.coalesce(*[F.when(f["dimension"] == d, F.lit(k)) for d, k in ADDRESSES.items()])
    other_time = F.exists(rows, lambda e: ~F.coalesce(now(e), F.lit(False)) & F.coalesce(e["kind"] == kind, F.lit(False)))
    return (
        F.when(~F.coalesce(settled, F.lit(False)), _as("REVIEW_REQUIRED", "SOURCE_REQUIREMENT_UNRESOLVED"))
        .when(F.coalesce(applies, F.lit(1)) == 1, _as("UNKNOWN", "APPLICABILITY_UNKNOWN"))
        .when(applies == 0, _as("UNKNOWN", "CONDITION_NOT_APPLICABLE"))
        .when((F.size(usable) == 0) & other_time, _as("INSUFFICIENT", "CANDIDATE_EVIDENCE_OUTSIDE_AS_OF"))
        .when(f["dimension"] == "EDUCATION_LEVEL", education(f, usable))
        .when(f["dimension"] == "MAJOR", major(f, usable, relations))
        .when(f["dimension"] == "GRADUATION_YEAR", graduation(f, usable))
        .when(f["dimension"] == "AGE", age(f, usable, at))
        .when(f["dimension"] == "GENDER", gender(f, usable))
        .when(f["dimension"] == "PROFESSIONAL_QUALIFICATION", qualification(f, usable))
        .otherwise(_NO_RULE())
    )
