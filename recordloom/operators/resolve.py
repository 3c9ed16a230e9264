"""Conservative entity resolution: blocked pairs, decisions with reasons, complete-link groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import forget, stored

#: Rows of a block that are compared each with each.
MOST_ROWS = 5000
#: Rounds after which their results are put together in one table.
GATHER = 16


def _bounded(rows: DataFrame, block: list[str], what: str) -> None:
    """An error if a block holds more than MOST_ROWS rows: blocks that large need another key, not a longer wait."""
    most = rows.groupBy(*block).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_ROWS:
        raise ValueError(f"a {what} of {most} rows: the most is {MOST_ROWS}")


def blocked_pairs(rows: DataFrame, id_col: str, block: list[str]) -> DataFrame:
    """Pairs l < r of rows that agree in the block columns, as columns l_* and r_*.

    Pairs outside a block differ in a block column, which already separates
    them.  All pairs of a block are compared, so one of more than MOST_ROWS rows is an error.
    """
    _bounded(rows.where(F.expr(" AND ".join(f"`{b}` IS NOT NULL" for b in block))), block, "block")
    left = rows.select(*[F.col(c).alias(f"l_{c}") for c in rows.columns])
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    on = F.col(f"l_{id_col}") < F.col(f"r_{id_col}")
    for b in block:
        on = on & (F.col(f"l_{b}") == F.col(f"r_{b}"))
    return left.join(right, on)


def pair_decision(checks: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """(decision, reason): SEPARATE with the first check (name, left, right) that is missing or differs, else MERGE."""
    reason = None
    for name, a, b in checks:
        missing, differs = a.isNull() | b.isNull(), a != b
        reason = (F if reason is None else reason).when(missing, f"{name}_MISSING").when(differs, f"{name}_DIFFERS")
    return F.when(reason.isNull(), "MERGE").otherwise("SEPARATE"), reason


def conflicts(tests: list[tuple[Column, str]]) -> Column:
    """All reasons whose test holds."""
    return F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in tests]), lambda r: r.isNotNull())


def complete_link(rows: DataFrame, merges: DataFrame, id_col: str, component: str) -> DataFrame:
    """id, group_id: in id order, each row joins the first group all of whose members it merges with.

    merges: component, l, r, pairs that may merge.  group_id is the group's
    least id.  Whether a row may join depends on smaller ones, so rows decide in
    rounds, over edges only and in all components at once: a row whose smaller
    partners are all settled knows the groups that it could still join, those
    of which it merges with every member, and founds its own if there are none.
    It joins the first of them as soon as no smaller row that is open merges
    with that group's first member, for such a row might still join and shut it
    out.  The least open row of a component can always decide.  Rounds are as
    many as the longest chain of rows that wait for each other; a component may
    have any size.  Ids are unique in a component and not null.
    """
    comp = F.coalesce(F.col(component).cast("string"), F.lit("\0"))
    own = F.coalesce(F.col("component").cast("string"), F.lit("\0"))
    ids = stored(rows.select(comp.alias("c"), F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct(), "members")
    known = ids.select("c", F.col("id").alias("s"))
    pairs = merges.select(own.alias("c"), F.least("l", "r").cast("long").alias("s"), F.greatest("l", "r").cast("long").alias("b")).where("s < b").distinct()
    pairs = pairs.join(known, ["c", "s"], "left_semi").join(known.withColumnRenamed("s", "b"), ["c", "b"], "left_semi")
    # first, rows without smaller partners found groups
    waiting = pairs.select("c", F.col("b").alias("id")).distinct()
    settled = [stored(ids.join(waiting, ["c", "id"], "left_anti").select("c", "id", F.col("id").alias("group")), "settled")]
    edges = _told(pairs.withColumn("group", F.lit(None).cast("long")), settled[0])
    sizes = stored(settled[0].select("c", "group", F.lit(1).cast("long").alias("size")), "sizes")
    while not edges.isEmpty():
        # of open rows, with how many members of which group they merge
        ready = edges.groupBy("c", "b").agg(F.count("*").alias("n"), F.count("group").alias("known")).where("n = known").select("c", "b")
        met = edges.join(ready, ["c", "b"], "left_semi").groupBy("c", "b", "group").agg(F.count("*").alias("met"))
        fits = met.join(sizes, ["c", "group"]).where("met = size").groupBy("c", "b").agg(F.min("group").alias("group"))
        first = edges.where("s = group").groupBy("c", "group").agg(F.min("b").alias("next"))
        choice = ready.join(fits, ["c", "b"], "left").join(first, ["c", "group"], "left").where("group IS NULL OR next = b")
        new = stored(choice.select("c", F.col("b").alias("id"), F.coalesce("group", "b").alias("group")), "settled")
        gone, old = new.select("c", F.col("id").alias("b")), edges
        edges = _told(edges.join(gone, ["c", "b"], "left_anti"), new)
        grown = sizes.unionAll(new.groupBy("c", "group").agg(F.count("*").alias("size"))).groupBy("c", "group").agg(F.sum("size").alias("size"))
        before, sizes = sizes, stored(grown, "sizes")
        forget(old, before)
        settled.append(new)
        if len(settled) == GATHER:
            whole = stored(_union(settled), "settled")
            forget(*settled)
            settled = [whole]
    forget(edges, sizes, ids)
    return _union(settled).select("id", F.col("group").alias("group_id"))


def _told(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the groups of smaller rows that have just settled."""
    said = new.select("c", F.col("id").alias("s"), F.col("group").alias("__group"))
    return stored(edges.join(said, ["c", "s"], "left").select("c", "s", "b", F.coalesce("group", "__group").alias("group")), "edges")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def best_by_authority(rows: DataFrame, group: str, authority: str, id_col: str, ranks: list[str]) -> DataFrame:
    """The row of each group of the highest authority (first of ranks; unknown ones last), then of the least id."""
    rank = F.coalesce(*[F.when(F.col(authority) == a, F.lit(i)) for i, a in enumerate(ranks)], F.lit(len(ranks)))
    rest = [c for c in rows.columns if c != group]
    picked = rows.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(rank, F.col(id_col))).alias("__row"))
    return picked.select(group, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


CLAIM = "struct<state:string,key:string>"


def reconciled_pairs(pairs: DataFrame, references: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """pairs (l, r) with reconciled: whether a confirmed reconciliation with evidence leads from one to the other.

    references: id, ref, one row for each name that a candidate goes by;
    reconciliations: from_refs, to_refs, state, kind, evidence (arrays).  Names
    meet by equality, in either direction; no pairs are made beside the given ones.
    """
    sure = reconciliations.where((F.col("state") == "CONFIRMED") & F.col("kind").isin("MERGE", "CORRECTION") & (F.size("evidence") > 0))
    moves = sure.select(F.monotonically_increasing_id().alias("__m"), "from_refs", "to_refs")
    side = lambda c: moves.select("__m", F.explode(c).alias("ref")).join(references, "ref").select("__m", "id").distinct()
    asked = pairs.select("l", "r")
    start, end = side("from_refs"), side("to_refs")
    found = None
    for a, b in (("l", "r"), ("r", "l")):
        one = asked.join(start.withColumnRenamed("id", a), a).join(end.withColumnRenamed("id", b), ["__m", b]).select("l", "r")
        found = one if found is None else found.unionByName(one)
    return pairs.join(found.distinct().withColumn("reconciled", F.lit(True)), ["l", "r"], "left").withColumn("reconciled", F.coalesce("reconciled", F.lit(False)))


def _claim_steps(name: str, left: Column, right: Column) -> list[tuple[Column, str]]:
    """What stops two claims from matching, in order; the last entry is what a match is called."""
    return [
        ((left["state"] == "PROVISIONAL") | (right["state"] == "PROVISIONAL"), f"{name}_PROVISIONAL"),
        (~F.coalesce((left["state"] == "CONFIRMED") & (right["state"] == "CONFIRMED"), F.lit(False)), f"{name}_UNRESOLVED"),
        (F.lit(None).cast("boolean"), f"{name}_MATCH"),
    ]


def contextual_decision(left: Column, right: Column, reconciled: Column) -> Column:
    """struct(outcome, reasons) of two candidates that each know their recruitment context.

    A side is a struct: separated, valid, opportunity, position, plan, batch
    (claims: state, key), applicability (of the batch), employer, locations.
    Proof of separation and invalid proof come first, then a reconciliation,
    then all conflicts together, then an equal confirmed opportunity; else
    position, plan, batch, employer and locations must each be confirmed equal,
    and the reasons run up to the first that is not.
    """
    both = lambda c: (left[c]["state"] == "CONFIRMED") & (right[c]["state"] == "CONFIRMED")
    differ = lambda c: both(c) & (left[c]["key"] != right[c]["key"])
    settled = lambda s: s["applicability"] != "UNRESOLVED"
    found = conflicts([
        (differ("opportunity"), "OPPORTUNITY_IDENTITY_CONFLICT"),
        (differ("position"), "POSITION_IDENTITY_CONFLICT"),
        (differ("plan"), "RECRUITMENT_PLAN_IDENTITY_CONFLICT"),
        (settled(left) & settled(right) & (left["applicability"] != right["applicability"]), "RECRUITMENT_BATCH_APPLICABILITY_CONFLICT"),
        (differ("batch"), "RECRUITMENT_BATCH_IDENTITY_CONFLICT"),
        (left["employer"] != right["employer"], "EMPLOYER_IDENTITY_CONFLICT"),
        ((F.size(left["locations"]) > 0) & (F.size(right["locations"]) > 0) & (left["locations"] != right["locations"]), "LOCATION_IDENTITY_DISCRIMINATOR_CONFLICT"),
    ])
    none, false = F.lit(None).cast("boolean"), F.lit(False)
    unsettled = ~F.coalesce(settled(left) & settled(right), false)
    batch = [(unsettled, "RECRUITMENT_BATCH_IDENTITY_UNRESOLVED"), (left["applicability"] != right["applicability"], "RECRUITMENT_BATCH_APPLICABILITY_CONFLICT")]
    batch += [(F.coalesce(left["applicability"] != "NOT_APPLICABLE", false) & F.coalesce(t, false), r) for t, r in _claim_steps("RECRUITMENT_BATCH_IDENTITY", left["batch"], right["batch"])[:2]] + [(none, "RECRUITMENT_BATCH_IDENTITY_MATCH")]
    unequal = left["locations"].isNull() | right["locations"].isNull() | ((F.size(left["locations"]) == 0) != (F.size(right["locations"]) == 0))
    steps = [
        *_claim_steps("POSITION_IDENTITY", left["position"], right["position"]), *_claim_steps("RECRUITMENT_PLAN_IDENTITY", left["plan"], right["plan"]), *batch,
        (left["employer"].isNull() | right["employer"].isNull(), "EMPLOYER_IDENTITY_UNRESOLVED"), (none, "EMPLOYER_IDENTITY_MATCH"),
        (unequal, "LOCATION_IDENTITY_DISCRIMINATOR_UNRESOLVED"), (none, "LOCATION_IDENTITY_DISCRIMINATOR_MATCH"),
    ]
    # stop: the first step that stops; reasons: what matched before it, and its own name
    stop = F.coalesce(*[F.when(F.coalesce(t, false), F.lit(i)) for i, (t, _) in enumerate(steps)], F.lit(len(steps)))
    named = [(i, t, r) for i, (t, r) in enumerate(steps)]
    match = lambda i, r: (stop > i) & (F.size(left["locations"]) > 0) if r.startswith("LOCATION") else stop > i
    reasons = conflicts([(match(i, r) if r.endswith("_MATCH") else stop == i, r) for i, _, r in named])
    through = stop == len(steps)
    official = F.coalesce(both("opportunity") & (left["opportunity"]["key"] == right["opportunity"]["key"]), false)
    answer = lambda outcome, *codes: F.struct(F.lit(outcome).alias("outcome"), F.array(*map(F.lit, codes)).alias("reasons"))
    return (
        F.when(F.coalesce(left["separated"] | right["separated"], false), answer("SEPARATE", "IDENTITY_EVIDENCE_CONFLICT"))
        .when(~F.coalesce(left["valid"] & right["valid"], false), answer("SEPARATE", "IDENTITY_EVIDENCE_INSUFFICIENT"))
        .when(reconciled, answer("MERGE", "EXPLICIT_RECONCILIATION_MATCH"))
        .when(F.size(found) > 0, F.struct(F.lit("SEPARATE").alias("outcome"), found.alias("reasons")))
        .when(official, answer("MERGE", "OPPORTUNITY_IDENTITY_MATCH", "RECRUITMENT_CONTEXT_MATCH"))
        .otherwise(F.struct(F.when(through, "MERGE").otherwise("SEPARATE").alias("outcome"), F.when(through, F.array_append(reasons, F.lit("RECRUITMENT_CONTEXT_MATCH"))).otherwise(reasons).alias("reasons")))
    )


def candidate_decision(left: Column, right: Column, left_context: Column, right_context: Column, reconciled: Column, plain: Column) -> Column:
    """struct(outcome, reasons): by context where both sides have one, by reconciliation alone where one has (J3), else as `plain` says."""
    mixed = F.struct(F.when(reconciled, "MERGE").otherwise("SEPARATE").alias("outcome"), F.array(F.when(reconciled, "EXPLICIT_RECONCILIATION_MATCH").otherwise("LEGACY_CONTEXT_RECONCILIATION_MISSING")).alias("reasons"))
    return F.when(left_context & right_context, contextual_decision(left, right, reconciled)).when(left_context | right_context, mixed).otherwise(plain)


def canonical_rows(members: DataFrame, group: str, id_col: str, version: str, authority: str, ranks: list[str], basis: Column, confirmed: Column, observed: str) -> DataFrame:
    """A row for each group (J5): identity_hash, the member of the highest authority, all versions in order, and when it was first seen.

    The identity is the hash of the basis of that member; a group of one whose
    identity is not confirmed mixes in its own id, so that two of them never
    fall together by chance.
    """
    from ..functions.canon import canonical_json, sha256, unique_sorted

    rank = F.coalesce(*[F.when(F.col(authority) == a, F.lit(i)) for i, a in enumerate(ranks)], F.lit(len(ranks)))
    rows = members.withColumns({"__basis": basis, "__confirmed": confirmed})
    g = rows.groupBy(group).agg(
        F.min_by(F.struct(id_col, "__basis", "__confirmed"), F.struct(rank, F.col(id_col))).alias("p"), F.count("*").alias("n"),
        F.min(observed).alias("first_seen"), unique_sorted(F.collect_set(version)).alias("versions"))
    base = sha256(F.col("p.__basis"))
    single = sha256(canonical_json({"canonical_basis_hash": base, "source_occurrence_id": F.col(f"p.{id_col}")}))
    identity = F.when((F.col("n") > 1) | F.coalesce(F.col("p.__confirmed"), F.lit(False)), base).otherwise(single)
    return g.select(group, identity.alias("identity_hash"), F.col(f"p.{id_col}").alias("selected"), F.when(F.col("p.__confirmed"), "CONFIRMED").otherwise("PROVISIONAL").alias("state"), F.col("n").alias("members"), "versions", "first_seen")
