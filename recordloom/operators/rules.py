"""Rules as tables: findings, cascades, conflicts, decisions, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, kleene
from ..functions.text import first_class, first_listed
from . import logic

#: Rules in one expression.
MOST_RULES = 1_000


def findings(texts: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """id, category, rule: every rule (category, name, pattern) that a text matches, once for each row.

    The rules are literals of one expression, so each text is read once and
    nothing is shuffled; more than MOST_RULES of them go through
    `patterns.many_findings`, which takes any number.
    """
    if len(rules) > MOST_RULES:
        from .patterns import many_findings

        return many_findings(texts, id_col, text_col, texts.sparkSession.createDataFrame(rules, "category string, rule string, pattern string"))
    hits = F.array(*[F.when(F.col(text_col).rlike(p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("rule"))) for c, n, p in rules])
    found = F.array_distinct(F.filter(hits, lambda h: h.isNotNull()))
    return texts.select(id_col, F.inline(found))


def relevance(found: DataFrame, texts: DataFrame, id_col: str, covered: str) -> DataFrame:
    """id, relevance: RELEVANT by a direct finding, POSSIBLY by an adjacent one, BLOCKED without coverage, NOT_RELEVANT only by a clear negative one, else REVIEW."""
    n = lambda c: F.count_if(F.col("category") == c).alias(c)
    counts = found.groupBy(id_col).agg(n("direct"), n("adjacent"), n("negative"))
    c = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    out = F.when(c("direct"), "RELEVANT").when(~F.coalesce(covered, F.lit(False)), "BLOCKED").when(c("adjacent"), "POSSIBLY_RELEVANT").when(c("negative"), "NOT_RELEVANT").otherwise("REVIEW")
    return texts.select(id_col, covered).join(counts, id_col, "left").select(id_col, out.alias("relevance"))


def polarity_conflicts(facts: DataFrame, predicate: list[str], polarity: str) -> DataFrame:
    """Predicates that facts state with more than one polarity."""
    return facts.groupBy(*predicate).agg(F.countDistinct(polarity).alias("polarities")).where("polarities > 1")


def group_outcomes(facts: DataFrame, owner: str, group: str, operator: str, outcome: Column, certain: Column) -> DataFrame:
    """owner, group, level (0, 1, 2), certain: AND groups take their least level, OR groups their greatest."""
    level = kleene.level(outcome)
    g = facts.groupBy(owner, group, operator).agg(F.min(level).alias("__least"), F.max(level).alias("__most"), F.min(certain.cast("int")).alias("__certain"))
    return g.select(owner, group, F.when(F.col(operator) == "OR", F.col("__most")).otherwise(F.col("__least")).alias("level"), (F.col("__certain") == 1).alias("certain"))


def eligibility(groups: DataFrame, owners: DataFrame, owner: str, conflicts: DataFrame | None = None, unknown_first: bool = True) -> DataFrame:
    """owner, result.

    Conflict or no facts at all: NEEDS_REVIEW.  With unknown_first any unknown
    group does so too, even beside one that fails for certain; without, FALSE
    decides before UNKNOWN.  Then a certain failure is INELIGIBLE, another
    LIKELY_INELIGIBLE, an uncertain pass LIKELY_ELIGIBLE, else ELIGIBLE.
    """
    agg = groups.groupBy(owner).agg(
        F.count_if(F.col("level") == kleene.UNKNOWN).alias("unknown"), F.count_if((F.col("level") == kleene.FALSE) & F.col("certain")).alias("fails"),
        F.count_if(F.col("level") == kleene.FALSE).alias("fails_some"), F.count_if(~F.col("certain")).alias("unsure"), F.count("*").alias("n"))
    out = owners.select(owner).distinct().join(agg, owner, "left")
    if conflicts is not None:
        out = out.join(conflicts.select(owner).distinct().withColumn("conflict", F.lit(True)), owner, "left")
    else:
        out = out.withColumn("conflict", F.lit(None).cast("boolean"))
    unknown = F.col("unknown") > 0
    result = F.when(F.col("n").isNull() | F.col("conflict"), "NEEDS_REVIEW")
    if unknown_first:
        result = result.when(unknown, "NEEDS_REVIEW")
    result = result.when(F.col("fails") > 0, "INELIGIBLE").when(F.col("fails_some") > 0, "LIKELY_INELIGIBLE").when(unknown, "NEEDS_REVIEW")
    return out.select(owner, result.when(F.col("unsure") > 0, "LIKELY_ELIGIBLE").otherwise("ELIGIBLE").alias("result"))


def decision(excluded: Column, relevance_: Column, bound: Column, eligible: Column) -> Column:
    """The presentation decision; the first rule that holds decides. Null relevance or eligibility means that there is none yet."""
    return (
        F.when(excluded, "NOT_DISPLAY")
        .when(relevance_.isNull(), "DISPLAY_WITH_REVIEW")
        .when(~bound, "DISPLAY_WITH_REVIEW")
        .when(relevance_ == "NOT_RELEVANT", "NOT_DISPLAY")
        .when(relevance_ == "BLOCKED", "EVIDENCE_BLOCKED")
        .when(eligible.isNull(), "DISPLAY_WITH_REVIEW")
        .when((relevance_ == "RELEVANT") & eligible.isin("ELIGIBLE", "LIKELY_ELIGIBLE"), "DISPLAY")
        .otherwise("DISPLAY_WITH_REVIEW")
    )


def excluded_by_term(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def excluded_by_identity(rows: DataFrame, rules: DataFrame, identity: str) -> DataFrame:
    """rows with excluded: whether a rule names their publisher's identity exactly."""
    named = rules.select(identity).distinct().withColumn("excluded", F.lit(True))
    return rows.join(named, identity, "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def resolved(evidence: DataFrame, keys: list[str], value: str, confirmed: str, expected: str) -> DataFrame:
    """keys, status of a predicate over its evidence: MISSING, UNCONFIRMED, CONFLICT, MATCH or NOT_MATCH, tested in this order.

    A row with a null value stands for a predicate without evidence.
    """
    g = evidence.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.col(value).isNotNull() & ~F.col(confirmed)).alias("open"), F.countDistinct(value).alias("values"), F.min(value).alias("one"), F.first(expected, ignorenulls=True).alias("want"))
    status = F.when(F.col("n") == 0, "MISSING").when(F.col("open") > 0, "UNCONFIRMED").when(F.col("values") > 1, "CONFLICT").when(F.col("one") == F.col("want"), "MATCH").otherwise("NOT_MATCH")
    return g.select(*keys, status.alias("status"))


def tree_levels(nodes: DataFrame, leaves: DataFrame, *_) -> DataFrame:
    """`logic.levels` by its former name; a number of storeys that former callers give is not needed and changes nothing."""
    return logic.levels(nodes, leaves)


def connector(token: Column, context: Column, table: list[tuple[str, str, str]], otherwise: str = "UNRESOLVED") -> Column:
    """What a connecting word means: the table's (token, context, meaning), a context of * standing for all others."""
    exact = [F.when((token == t) & (context == c), F.lit(m)) for t, c, m in table if c != "*"]
    general = [F.when(token == t, F.lit(m)) for t, c, m in table if c == "*"]
    return F.coalesce(*exact, *general, F.lit(otherwise))


# Connecting words and marks by meaning, and the context in which marks stand between alternatives.
AND_WORDS = ["AND", "且", "并且", "同时", "同时具备", "同时具有", "兼具"]
OR_WORDS = ["OR", "或", "任一", "任一项", "任选其一", "之一", "均可"]
ALSO, LABEL_MARKS, LIST_MARKS, CLAUSE_MARKS = "以及", [":", "："], [",", "，", "、", "/"], [";", "；"]
MAJOR_LIST, PROTECTED = "MAJOR_CANDIDATE_LIST", "PROTECTED_ATOMIC_SPAN"


def clause_connector(token: Column, context: Column, protected: Column) -> Column:
    """struct(status, kind) of what stands between two parts of a clause (K5); marks join alternatives only in a list of majors."""
    word, listed = F.trim(token), F.coalesce(context == MAJOR_LIST, F.lit(False))
    made = lambda status, kind: F.struct((status if isinstance(status, Column) else F.lit(status)).alias("status"), (kind if isinstance(kind, Column) else F.lit(kind).cast("string")).alias("kind"))
    return (
        F.when(F.coalesce(protected, F.lit(False)) | F.coalesce(context == PROTECTED, F.lit(False)), made("NON_BOOLEAN", "PROTECTED_CONTENT"))
        .when(word.isin(AND_WORDS), made("RESOLVED", "AND"))
        .when(word.isin(OR_WORDS), made("RESOLVED", "OR"))
        .when(word == ALSO, made("RESOLVED", F.when(listed, "OR").otherwise("AND")))
        .when(word.isin(LABEL_MARKS), made("NON_BOOLEAN", "LABEL_DELIMITER"))
        .when(word.isin(LIST_MARKS + CLAUSE_MARKS) & listed, made("RESOLVED", "OR"))
        .when(word.isin(CLAUSE_MARKS), made("CLAUSE_BOUNDARY", None))
        .otherwise(made("UNRESOLVED", None))
    )


def score(weight: Column, excluded: Column, rejected: Column, bonus: list[Column], malus: list[Column]) -> Column:
    """0 if excluded, 1 if a rule rejects, else the weight and the adjustments that hold, within 1 to 5."""
    out = weight
    for c in bonus:
        out = out + F.coalesce(c, F.lit(False)).cast("int")
    for c in malus:
        out = out - F.coalesce(c, F.lit(False)).cast("int")
    return F.when(excluded, 0).when(rejected, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), out))).cast("int")


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def direction(text: Column) -> Column:
    """The first listed direction in a text, else what its job label names, else the direction of others."""
    named = F.trim(F.regexp_extract(_compact(text), fixed.DIRECTION_LABEL, 1))
    return first_listed(_compact(text), fixed.DIRECTIONS, F.coalesce(F.when(named != "", named), F.lit(fixed.DIRECTION_OTHERWISE)))


def major_rule(text: Column) -> Column:
    """What a text says about applicants of other majors."""
    return first_class(_compact(text), fixed.MAJOR_RULES, fixed.MAJOR_OTHERWISE)


def match_score(unit_name: Column, industry: Column, unit_type: Column, title: Column, body: Column) -> Column:
    """0 to 5 for a posting; nulls count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    weights = F.create_map(*[F.lit(x) for pair in fixed.UNIT_WEIGHTS.items() for x in pair])
    about, rule = F.concat_ws(" ", text(title), text(body)), major_rule(text(body))
    return score(
        F.coalesce(weights[unit_type], F.lit(fixed.WEIGHT_OTHERWISE)), excluded_by_term(F.concat_ws(" ", text(unit_name), text(industry), text(title)), fixed.EXCLUDED_TERMS), rule.isin(fixed.REJECTING),
        [direction(about).isin(fixed.RAISED_DIRECTIONS), rule == fixed.ACCEPTING], [rule == fixed.MAJOR_OTHERWISE])
