"""Gates: they route or reject records and name every reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canonical_json, sha256, unique_sorted
from ..sources.stored import dealt


def reasons(tests: list[tuple[Column, str]]) -> Column:
    """Names of the tests that hold; one whose condition is null counts as holding, since nothing proves otherwise."""
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(r)) for t, r in tests]), lambda r: r.isNotNull())


def admission(decision: Column, scope: Column, level: Column, canary_reviewed: Column) -> Column:
    """CONTINUOUS, CONTROLLED, ONE_RUN or DENIED for a source; only an approved one may run at all."""
    return (
        F.when(~F.coalesce(decision == "APPROVED", F.lit(False)), "DENIED")
        .when(scope == "CONTINUOUS", "CONTINUOUS")
        .when(level == "A", "CONTROLLED")
        .when((level == "B") & F.coalesce(canary_reviewed, F.lit(False)), "ONE_RUN")
        .otherwise("DENIED")
    )


def authorization_faults(runs: DataFrame, permits: DataFrame, key: str, same: list[str], at: str, valid_from: str, valid_to: str) -> DataFrame:
    """key, faults: what keeps a run from its permit; runs without a fault have an empty list.

    What is null on either side agrees with nothing: DIFFERS, or TIME_UNKNOWN for instants and limits.
    """
    other = permits.select(key, *[F.col(c).alias(f"__{c}") for c in same], F.col(valid_from).alias("__from"), F.col(valid_to).alias("__to"), F.lit(True).alias("__there"))
    found = runs.join(other, key, "left")
    tests = [(F.col("__there").isNull(), "NO_PERMIT")] + [(F.col("__there") & ~F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False)), f"{c.upper()}_DIFFERS") for c in same]
    tests += [(F.col("__there") & (F.col(at).isNull() | F.col("__from").isNull() | F.col("__to").isNull()), "TIME_UNKNOWN")]
    tests += [(F.col("__there") & (F.col(at) < F.col("__from")), "NOT_YET_VALID"), (F.col("__there") & (F.col(at) > F.col("__to")), "EXPIRED")]
    named = F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in tests]), lambda r: r.isNotNull())
    return found.select(key, named.alias("faults"))


# What an endpoint may be for.
PURPOSES = ("JOB_LIST", "JOB_DETAIL", "RECRUITMENT_NOTICE", "RECRUITMENT_ATTACHMENT")


def admission_faults(url: Column, endpoint: Column, purpose: Column, method: Column, evidence: Column, reviews: Column, decision: Column, level: Column, purposes: tuple[str, ...] = PURPOSES) -> Column:
    """What is wrong with an admission (P2), all of it: its endpoint, what that is for, its method, its evidence, its reviews, its level.

    evidence and reviews are numbers of rows; an approved admission needs both
    and level A or B.  Nulls count as faults.
    """
    approved = F.coalesce(decision == "APPROVED", F.lit(False))
    return reasons([
        (~F.coalesce(url.rlike("^https://[^/?#@]+"), F.lit(False)), "ENDPOINT_INVALID"),
        (F.coalesce(F.trim(endpoint), F.lit("")) == "", "ENDPOINT_REFERENCE_MISSING"),
        (~purpose.isin(*purposes), "PURPOSE_UNSUPPORTED"),
        (method != "GET", "METHOD_NOT_ALLOWED"),
        (F.coalesce(evidence, F.lit(0)) < 1, "EVIDENCE_MISSING"),
        (approved & (F.coalesce(reviews, F.lit(0)) < 1), "REVIEW_MISSING"),
        (approved & ~F.coalesce(level.isin("A", "B"), F.lit(False)), "LEVEL_DENIED"),
    ])


def discovery_state(same_scope: Column, success: Column, complete: Column, content: Column, hash_: Column, length: Column, declared_type: Column, content_type: Column, authority: Column, references: Column, known: Column) -> Column:
    """struct(state, reason) of a discovery's evidence (P6): REVIEW_REQUIRED for an unknown extension, else EVIDENCE_BLOCKED by the first thing that fails, else SUPPORTED.

    references: hashes of the four things that the evidence rests on.
    """
    false = F.lit(False)
    steps = [
        (~F.coalesce(known, false), "REVIEW_REQUIRED", "EXTENSION_UNPROVEN"),
        (~F.coalesce(same_scope & success & complete, false), "EVIDENCE_BLOCKED", "SCOPE_OR_ACQUISITION"),
        (~F.coalesce((F.sha2(content, 256) == hash_) & (F.octet_length(content) == length) & (declared_type == content_type), false), "EVIDENCE_BLOCKED", "BYTES_DIFFER"),
        (~F.coalesce(authority.isin("OFFICIAL", "AUTHORIZED"), false), "EVIDENCE_BLOCKED", "AUTHORITY"),
        (~F.coalesce((F.size(references) == 4) & F.forall(references, lambda r: F.coalesce(r.rlike("^[a-f0-9]{64}$"), false)), false), "EVIDENCE_BLOCKED", "REFERENCES_MISSING"),
    ]
    made = [F.when(t, F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))) for t, s, r in steps]
    return F.coalesce(*made, F.struct(F.lit("SUPPORTED").alias("state"), F.lit(None).cast("string").alias("reason")))


def issued_evidence(manifests: DataFrame, items: DataFrame, manifest: str, evidence_class: str, provenance: str, payload: Column) -> tuple[DataFrame, DataFrame]:
    """(sealed items, faults by manifest) of an issuance of evidence.

    A manifest needs an item, and items that state where they are from must
    state the manifest's class; one that does not holds back all of its
    manifest.  A sealed item is named by the hash of its content and manifest.
    """
    known = manifests.select(manifest, evidence_class)
    rows = items.withColumn("__payload", payload).join(known, manifest)
    g = known.join(rows.groupBy(manifest).agg(F.count("*").alias("__n"), F.count_if(F.col(provenance) != F.col(evidence_class)).alias("__bad")), manifest, "left")
    fault = F.when(F.col("__n").isNull(), "NO_ITEMS").when(F.col("__bad") > 0, "PROVENANCE_DIFFERS")
    faults = g.select(manifest, fault.alias("fault")).where("fault IS NOT NULL")
    seal = F.concat(F.lit("evidence:"), sha256(canonical_json({"class": F.col(evidence_class), "manifest": F.col(manifest).cast("string"), "payload": F.col("__payload")})))
    return rows.join(faults, manifest, "left_anti").withColumn("evidence_id", seal).drop("__payload"), faults


def bound_campaigns(details: DataFrame, evidence: DataFrame, ids: list[str], claims: list[str]) -> DataFrame:
    """details with binding (P11): BOUND where the retained evidence of the same ids states the same claims, else UNBOUND, MISMATCH or AMBIGUOUS."""
    g = evidence.groupBy(*ids).agg(F.countDistinct(F.struct(*claims)).alias("__n"), F.min(F.struct(*claims)).alias("__claims"))
    same = F.lit(True)
    for c in claims:
        same = same & F.col(c).eqNullSafe(F.col(f"__claims.{c}"))
    state = F.when(F.col("__n").isNull(), "UNBOUND").when(F.col("__n") > 1, "AMBIGUOUS").when(same, "BOUND").otherwise("MISMATCH")
    return details.join(g, ids, "left").withColumn("binding", state).drop("__n", "__claims")


def approved_query(query: Column, approved: Column) -> Column:
    """Whether a URL query is one of the approved ones: no repeated names, no plus signs, pairs compared in any order."""
    pairs = lambda q: F.array_sort(F.split(q, "&"))
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    plain = (F.size(names) == F.size(F.array_distinct(names))) & ~F.contains(query, F.lit("+"))
    return F.coalesce(plain & F.exists(approved, lambda a: pairs(a) == pairs(query)), F.lit(False))


def registry_faults(sources: DataFrame, publishers: DataFrame, id_col: str, revision: str, publisher: str, kinds: list[str], kind: str, ties: list[str] | None = None) -> DataFrame:
    """id, revision, fault: DUPLICATE, PUBLISHER_UNKNOWN, PUBLISHER_CHANGED (against the first revision's) or KIND_UNSUPPORTED.

    ties: columns that tell rows of one revision apart, for the first one's sake.
    """
    w = Window.partitionBy(id_col).orderBy(revision, *(ties or []))
    known = publishers.select(F.col(publisher)).distinct().withColumn("__known", F.lit(True))
    # the wider window first: its shuffle and its sort serve the other, too
    df = dealt(sources, id_col).withColumn("__first", F.first(publisher).over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(id_col, revision))).join(known, publisher, "left")
    faults = reasons([(F.col("__n") > 1, "DUPLICATE"), (F.col("__known").isNull(), "PUBLISHER_UNKNOWN"), (~F.col(publisher).eqNullSafe(F.col("__first")), "PUBLISHER_CHANGED"), (~F.col(kind).isin(kinds), "KIND_UNSUPPORTED")])
    return df.select(id_col, revision, F.explode(faults).alias("fault")).distinct()


def missing_evidence(claims: DataFrame, evidence: DataFrame, claim: str, ids: str, id_col: str, kind: str, allowed: list[str]) -> DataFrame:
    """claim, evidence_id, fault of evidence that a claim names but that is not there (UNKNOWN) or of another kind (KIND)."""
    named = claims.select(claim, F.explode(F.array_distinct(ids)).alias("evidence_id"))
    held = evidence.select(F.col(id_col).alias("evidence_id"), F.col(kind).alias("__kind"), F.lit(True).alias("__there"))
    fault = F.when(F.col("__there").isNull(), "UNKNOWN").when(~F.coalesce(F.col("__kind").isin(allowed), F.lit(False)), "KIND")
    return named.join(held, "evidence_id", "left").withColumn("fault", fault).where("fault IS NOT NULL").select(claim, "evidence_id", "fault")


def position_identity(namespace: Column, code: Column, local_key: Column, source: Column) -> Column:
    """struct(state, identity): CONFIRMED by an official code, PROVISIONAL by a source's own key, else UNRESOLVED without one."""
    confirmed, provisional = namespace.isNotNull() & code.isNotNull(), local_key.isNotNull() & source.isNotNull()
    identity = F.when(confirmed, sha256(canonical_json({"code": code, "namespace": namespace}))).when(provisional, sha256(canonical_json({"key": local_key, "source": source})))
    return F.struct(F.when(confirmed, "CONFIRMED").when(provisional, "PROVISIONAL").otherwise("UNRESOLVED").alias("state"), identity.alias("identity"))


def capability_gate(required: Column, supported: Column) -> Column:
    """struct(allowed, missing): whether all that is required is supported."""
    missing = unique_sorted(F.array_except(required, supported))
    return F.struct((F.size(missing) == 0).alias("allowed"), missing.alias("missing"))


def mixed_scopes(rows: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """Keys whose rows have more than one evidence scope: synthetic and real evidence must not mix."""
    return rows.groupBy(*keys).agg(F.countDistinct(scope).alias("scopes")).where("scopes > 1")


def release_faults(files: DataFrame, previous: DataFrame, path: str, size: str, hash_col: str, most_files: int = 2048, most_bytes: int = 1 << 25) -> DataFrame:
    """path, fault: DUPLICATE_PATH, TOO_LARGE, CHANGED (an asset that must stay as it was), and TOO_MANY once."""
    n = files.groupBy(path).agg(F.count("*").alias("n"), F.max(size).alias("size"), F.min(hash_col).alias("hash"))
    old = previous.select(F.col(path), F.col(hash_col).alias("__old"))
    found = n.join(old, path, "left")
    faults = F.filter(F.array(F.when(F.col("n") > 1, "DUPLICATE_PATH"), F.when(F.col("size") > most_bytes, "TOO_LARGE"), F.when(F.col("__old") != F.col("hash"), "CHANGED")), lambda f: f.isNotNull())
    many = files.agg(F.count("*").alias("n")).where(F.col("n") > most_files).select(F.lit(None).cast("string").alias(path), F.lit("TOO_MANY").alias("fault"))
    return found.select(path, F.explode(faults).alias("fault")).unionByName(many)


def migration_audit(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """key, status: MIGRATED where both generations agree, BLOCKED_MISSING, BLOCKED_EXTRA or BLOCKED_DIFFERS."""
    a, b = old.select(key, F.col(hash_col).alias("__a")), new.select(key, F.col(hash_col).alias("__b"))
    status = F.when(F.col("__b").isNull(), "BLOCKED_MISSING").when(F.col("__a").isNull(), "BLOCKED_EXTRA").when(F.col("__a") == F.col("__b"), "MIGRATED").otherwise("BLOCKED_DIFFERS")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def major_scope(facts: DataFrame, owner: str, side: str, relation: Column, level: str) -> DataFrame:
    """owner, level of a rule that relates bachelor and graduate majors: AND, OR, HIGHEST, GRADUATE or BACHELOR; a side without facts is UNKNOWN.

    side holds BACHELOR or GRADUATE.  A side passes if one of its facts does.
    """
    by = lambda s: F.max(F.when(F.col(side) == s, F.col(level)))
    g = facts.groupBy(owner).agg(by("BACHELOR").alias("__has_b"), F.coalesce(by("BACHELOR"), F.lit(1)).alias("b"), F.coalesce(by("GRADUATE"), F.lit(1)).alias("g"), F.count_if(F.col(side) == "GRADUATE").alias("n"), F.first(relation).alias("relation"))
    highest = F.when(F.col("n") > 0, F.col("g")).otherwise(F.col("b"))
    out = F.when(F.col("relation") == "AND", F.least("b", "g")).when(F.col("relation") == "OR", F.greatest("b", "g")).when(F.col("relation") == "HIGHEST", highest).when(F.col("relation") == "GRADUATE", F.col("g")).otherwise(F.col("b"))
    return g.select(owner, out.alias("level"))


def credentials(all_of: Column, selection: Column, level: str = "level", rank: str = "rank") -> Column:
    """The credentials that a selection means: UNDERGRADUATE, GRADUATE, ALL, or HIGHEST by rank; null for one that isn't known."""
    top = F.array_max(F.transform(all_of, lambda c: c[rank]))
    return (
        F.when(selection == "UNDERGRADUATE", F.filter(all_of, lambda c: c[level] == "BACHELOR"))
        .when(selection == "GRADUATE", F.filter(all_of, lambda c: c[level].isin("MASTER", "DOCTOR")))
        .when(selection == "HIGHEST", F.filter(all_of, lambda c: c[rank] == top))
        .when(selection == "ALL", all_of)
    )
