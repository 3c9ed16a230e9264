import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.operators import diff, ledger, query, resolve, rules, summary, versioning


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_versions_of_a_b_a(spark):
    df = spark.createDataFrame([("k", 3, "A"), ("k", 1, "A"), ("k", 2, "B"), ("j", 1, None), ("j", 2, None)], "k string, at int, c string")
    assert rows(versioning.versions_any(df, ["k"], "c", ["at"]), "k", "at", "revision") == [("j", 1, 1), ("j", 2, 1), ("k", 1, 1), ("k", 2, 2), ("k", 3, 1)]
    assert rows(versioning.versions_latest(df, ["k"], "c", ["at"]), "k", "at", "revision") == [("j", 1, 1), ("j", 2, 1), ("k", 1, 1), ("k", 2, 2), ("k", 3, 3)]


def test_latest_first_and_shortest(spark):
    df = spark.createDataFrame([("a", 1, "xx"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "zzz")], "k string, at int, t string")
    assert rows(versioning.latest(df, ["k"], ["at"]), "k", "at") == [("a", 3), ("b", 1)]
    assert rows(versioning.first_wins(df, ["k"], ["at"]), "k", "at") == [("a", 1), ("b", 1)]
    assert rows(versioning.shortest(df, ["k"], "t", ["at"]), "k", "t") == [("a", "x"), ("b", "zzz")]


def test_chain_breaks_and_history(spark):
    df = spark.createDataFrame([("a", 1, "h1", None, "i1"), ("a", 2, "h1", "i1", "i2"), ("a", 4, "h2", "i2", "i4"), ("b", 1, "h", None, "j1"), ("b", 2, "g", "zz", "j2")], "k string, n int, h string, s string, i string")
    assert rows(versioning.chain_breaks(df, ["k"], "n", "h", "s", "i"), "i", "reason") == [("i2", "NO_OP"), ("i4", "GAP"), ("j2", "SUPERSEDES")]
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    assert rows(versioning.conflicting_history(held, spark.createDataFrame([(1, "a"), (2, "x"), (3, "y")], "k int, c string"), ["k"], "c"), "k") == [(2,)]


def test_record_diff(spark):
    old = spark.createDataFrame([("p", "same", "1"), ("p", "gone", "1"), ("p", "changed", "1"), ("q", "gone", "1"), ("r", "gone", "1"), ("s", "gone", "1"), ("t", "twice", "1"), ("t", "twice", "2"), ("t", "gone", "3")], "e string, k string, c string")
    new = spark.createDataFrame([("p", "same", "1"), ("p", "changed", "2"), ("p", "new", "1"), ("q", None, "1"), ("r", "dup", "1"), ("r", "dup", "2"), ("t", "twice", "1"), ("u", "first", "1")], "e string, k string, c string")
    found = diff.record_diff(old, new, ["e"], "k", "c", failed=spark.createDataFrame([("s",)], "e string"))
    assert sorted((r.e, r.k or "", r.change) for r in found.collect()) == [
        ("p", "changed", "UPDATED"), ("p", "gone", "MISSING_OBSERVED"), ("p", "new", "NEW"), ("p", "same", "UNCHANGED"), ("q", "", "IDENTITY_UNCERTAIN"),
        ("r", "dup", "IDENTITY_UNCERTAIN"), ("t", "twice", "IDENTITY_UNCERTAIN"), ("u", "first", "NEW")]


def test_runs_and_empty_proofs(spark):
    fields = "response_structure_valid boolean, pagination_complete boolean, explicit_empty_signal boolean, official_result_count int, authentication_wall_detected boolean, captcha_detected boolean, error_page_detected boolean, structure_drift_detected boolean, historical_comparison string"
    good = (True, True, False, 0, False, False, False, False, "CONSISTENT")
    cases = [
        ((0, 0, "COMPLETE", False, 0, good), "FAILED"), ((2, 1, "COMPLETE", False, 3, good), "FAILED"), ((1, 0, "PARTIAL", True, 3, good), "PARTIAL"), ((1, 0, "COMPLETE", True, 3, good), "NOT_MODIFIED"),
        ((1, 0, "COMPLETE", False, 3, good), "SUCCESS"), ((1, 0, "EMPTY", False, 3, good), "PARTIAL"), ((1, 0, "COMPLETE", False, 0, good), "CONFIRMED_EMPTY"), ((1, 0, "COMPLETE", False, 0, None), "SUSPICIOUS_EMPTY"),
        ((1, 0, "COMPLETE", False, 0, (True, True, False, None, False, False, False, False, "ANOMALOUS")), "SUSPICIOUS_EMPTY")]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], f"i int, snapshots int, failed int, done string, same boolean, n int, v struct<{fields.replace(' boolean', ':boolean').replace(' int', ':int').replace(' string', ':string')}>")
    reasons = diff.empty_reasons("v")
    out = df.select("i", diff.run_status(F.col("snapshots"), F.col("failed"), F.col("done"), F.col("same"), F.col("n"), reasons).alias("s"), reasons.alias("r")).orderBy("i").collect()
    assert [r.s for r in out] == [w for _, w in cases]
    assert out[8].r == ["EMPTY_SIGNAL_MISSING", "EMPTY_HISTORY_ANOMALOUS"] and out[7].r == ["ZERO_RESULT_REQUIRES_VALIDATION"]


def test_missing_streaks(spark):
    grid = spark.createDataFrame([(1, i, c, s) for i, (c, s) in enumerate([(True, True), (True, False), (False, False), (True, False), (True, True), (True, False)])], "k int, run int, counts boolean, seen boolean")
    out = diff.missing_streaks(grid, ["k"], ["run"], F.col("counts"), F.col("seen"))
    assert rows(out, "run", "streak", "missing_event") == [(0, 0, False), (1, 1, True), (2, 1, False), (3, 2, True), (4, 0, False), (5, 1, True)]


def test_health(spark):
    runs = spark.createDataFrame([(1, i, ok, h, risk) for i, (ok, h, risk) in enumerate([(True, "a", False), (False, None, False), (True, "b", False), (False, "x", False), (False, None, False), (True, None, True)])], "k int, at int, ok boolean, h string, risk boolean")
    out = ledger.source_health(runs, ["k"], ["at"], F.col("ok"), "h", F.col("risk"))
    assert rows(out, "at", "consecutive_success", "consecutive_failure", "last_hash", "status") == [
        (0, 1, 0, "a", "HEALTHY"), (1, 0, 1, "a", "DEGRADED"), (2, 1, 0, "b", "HEALTHY"), (3, 0, 1, "b", "DEGRADED"), (4, 0, 2, "b", "FAILED"), (5, 1, 0, "b", "REVIEW_REQUIRED")]


def test_cadence(spark):
    base = dt.datetime(2026, 1, 1)
    events = spark.createDataFrame([(k, base + dt.timedelta(hours=h), h) for k in (1, 2) for h in (12, 0, 5, 6, 11)] + [(None, base, 0), (3, None, 0)], "k long, at timestamp, n long")
    assert rows(ledger.cadence_gate(events, "k", "at", "n", 6 * 3600), "k", "n") == [(k, n) for k in (1, 2) for n in (0, 6, 12)]


def test_hash_chains(spark):
    df = spark.createDataFrame([("s", i, f"p{i}", "x") for i in range(1, 6)], "k string, n int, p string, scope string")
    chain = ledger.chained(df, ["k"], ["n"], F.col("p")).select("k", "sequence", "record_hash", "previous_hash", "p", "scope")
    check = lambda d: rows(ledger.chain_faults(d, ["k"], "sequence", "record_hash", "previous_hash", F.col("p"), "scope"), "sequence", "fault")
    assert check(chain) == []
    assert check(chain.where("sequence <> 3")) == [(4, "SEQUENCE"), (5, "SEQUENCE")]
    assert check(chain.withColumn("p", F.when(F.col("sequence") == 2, "tampered").otherwise(F.col("p")))) == [(2, "PAYLOAD")]
    assert check(chain.withColumn("scope", F.when(F.col("sequence") == 4, "y").otherwise(F.col("scope")))) == [(4, "SCOPE")]
    assert check(chain.withColumn("previous_hash", F.when(F.col("sequence") == 5, "0").otherwise(F.col("previous_hash")))) == [(5, "LINK")]


def test_batches(spark):
    df = spark.createDataFrame([("a", "SUCCESS", None), ("a", "NOT_MODIFIED", None), ("b", "SUCCESS", None), ("b", "FAILED", None), ("c", None, "CADENCE_DENIED"), ("d", "SUCCESS", None), ("d", None, "GRANT_REVOKED"), ("e", "FAILED", None), ("f", "SUCCESS", None), ("f", None, "CADENCE_DENIED"), ("g", None, "GRANT_REVOKED")], "b string, s string, d string")
    assert rows(ledger.batch_status(df, "b", "s", "d"), "b", "status") == [("a", "SUCCESS"), ("b", "PARTIAL"), ("c", "DEFERRED"), ("d", "PARTIAL"), ("e", "FAILED"), ("f", "SUCCESS"), ("g", "FAILED")]


@pytest.mark.parametrize("flagged,want", [([], list(range(10))), ([15], [15, *range(9)]), ([11, 12, 13, 14, 15], [11, 12, 13, *range(7)]), ([0, 1, 2, 3], list(range(10)))])
def test_quota(spark, flagged, want):
    df = spark.createDataFrame([(i, i in flagged) for i in range(20)], "i int, f boolean")
    assert sorted(r.i for r in ledger.quota_top(df, F.col("f"), ["i"], 10).collect()) == sorted(want)


def test_pages(spark):
    df = spark.range(25)
    assert rows(query.page(df, ["id"], 20, 10), "id", "total") == [(i, 25) for i in range(20, 25)]
    assert query.page(df, ["id"], 40, 1).count() == 0
    for limit in (0, 101):
        with pytest.raises(ValueError):
            query.page(df, ["id"], 0, limit)
    with pytest.raises(ValueError):
        query.page_parameter("1x", 20, 1, 100)
    assert query.page_parameter(None, 20, 1, 100) == 20


def test_keywords_and_statuses(spark):
    df = spark.createDataFrame([("100%", "b"), ("ab", "cd")], "x string, y string")
    count = lambda c: df.where(c).count()
    assert (count(query.keyword_any("%", "x", "y")), count(query.keyword_any("b c", "x", "y")), count(query.keyword_joined("B C", "x", "y")), count(query.keyword_any("  ", "x"))) == (1, 0, 1, 2)
    with pytest.raises(ValueError):
        query.status_in(["NEVER"], "x")
    shown = spark.createDataFrame([("DISPLAY",), ("NOT_DISPLAY",)], "s string")
    assert shown.where(query.status_in(["DISPLAY", "NOT_DISPLAY"], "s")).count() == 1
    with pytest.raises(Exception, match="unknown status"):
        shown.select(query.mapped(F.col("s"), {"DISPLAY": "a"}, "status")).collect()


def test_validity_includes_both_ends(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    facts = spark.createDataFrame([(1, "f", t(2), t(5))], "k int, f string, b timestamp, e timestamp")
    events = spark.createDataFrame([(1, i, t(i)) for i in range(1, 8)], "k int, i int, at timestamp")
    assert rows(query.validity_join(facts, events, "k", "b", "e", "at", 3600), "i") == [(2,), (3,), (4,), (5,)]


def test_relations(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert rows(query.upserted(a, b, ["k"]), "k", "v") == [(1, "x"), (2, "z"), (3, "w")]
    assert rows(query.insert_ignored(a, b, ["k"], ["v"]), "k") == [(3,)]
    fresh, clash = query.append_only(a, b.unionByName(spark.createDataFrame([(1, "x")], "k int, v string")), "k", "v")
    assert (rows(fresh, "k"), rows(clash, "k")) == ([(3,)], [(2,)])
    assert rows(query.set_differences(a, b, ["k"]), "k", "side") == [(1, "left"), (3, "right")]
    assert rows(query.orphans(b, a, "k"), "k") == [(3,)]
    assert rows(query.coverage(a, b, ["k"]), "k", "blocker") == [(1, "NOT_COVERED")]
    assert [r.blocker for r in query.coverage(a.where("false"), b, ["k"]).collect()] == ["NOTHING_EXPECTED"]
    published = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "s string, k int")
    assert rows(query.vanished(published, spark.createDataFrame([("s", 1)], "s string, k int"), "s", "k"), "k") == [(2,)]


def test_eligibility_generations_differ(spark):
    facts = spark.createDataFrame([("a", "g1", False), ("a", "g2", None), ("b", "g1", True), ("c", "g1", False)], "o string, g string, t boolean").withColumns({"op": F.lit("AND"), "sure": F.lit(True)})
    groups = rules.group_outcomes(facts, "o", "g", "op", F.col("t"), F.col("sure"))
    owners = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "o string")
    assert rows(rules.eligibility(groups, owners, "o"), "o", "result") == [("a", "NEEDS_REVIEW"), ("b", "ELIGIBLE"), ("c", "INELIGIBLE"), ("d", "NEEDS_REVIEW")]
    assert rows(rules.eligibility(groups, owners, "o", None, False), "o", "result")[0] == ("a", "INELIGIBLE")
    assert rows(rules.eligibility(groups, owners, "o", owners.where("o = 'b'")), "o", "result")[1] == ("b", "NEEDS_REVIEW")


def test_trees(spark):
    nodes = spark.createDataFrame([(1, "r", None, "AND"), (1, "n", "r", "NOT"), (1, "o", "r", "OR"), (1, "a", "n", "LEAF"), (1, "b", "o", "LEAF"), (1, "c", "o", "LEAF")], "tree int, node string, parent string, operator string")
    leaves = spark.createDataFrame([(1, "a", 0), (1, "b", 0)], "tree int, node string, level int")
    assert dict(rows(rules.tree_levels(nodes, leaves, 2), "node", "level")) == {"a": 0, "b": 0, "c": 1, "n": 2, "o": 1, "r": 1}


def test_resolution_is_not_transitive(spark):
    ids = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("p", 4), ("q", 9)], "component string, id long")
    merges = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("p", 3, 4)], "component string, l long, r long")
    assert rows(resolve.complete_link(ids, merges, "id", "component"), "id", "group_id") == [(1, 1), (2, 1), (3, 3), (4, 3), (9, 9)]


def test_pair_decisions_name_the_first_reason(spark):
    df = spark.createDataFrame([(1, "o", "t"), (2, "o", "t"), (3, "o", None), (4, "x", "u")], "id int, org string, title string").withColumn("b", F.lit(1))
    pairs = resolve.blocked_pairs(df, "id", ["b"])
    decided, reason = resolve.pair_decision([("ORG", F.col("l_org"), F.col("r_org")), ("TITLE", F.col("l_title"), F.col("r_title"))])
    found = {(r.l_id, r.r_id): (r.d, r.w) for r in pairs.select("l_id", "r_id", decided.alias("d"), reason.alias("w")).collect()}
    assert found[1, 2] == ("MERGE", None) and found[1, 3] == ("SEPARATE", "TITLE_MISSING") and found[1, 4] == ("SEPARATE", "ORG_DIFFERS") and len(found) == 6


def test_assertions_and_aliases(spark):
    df = spark.createDataFrame([("a", "KNOWN", "1"), ("a", "KNOWN", "2"), ("b", "KNOWN", "1"), ("c", "UNKNOWN", None), ("d", None, None)], "k string, s string, v string")
    assert rows(summary.assertion_status(df, ["k"], "s", "v"), "k", "state") == [("a", "REVIEW"), ("b", "COMPLETE"), ("c", "INSUFFICIENT"), ("d", "INSUFFICIENT")]
    known = spark.createDataFrame([(1, "A", ["x"]), (2, "B", ["x", "y"]), (3, "C", None)], "organization_id int, name string, aliases array<string>")
    asked = spark.createDataFrame([("A",), ("x",), ("y",), ("C",), ("?",)], "asked string")
    assert sorted((r.asked, r.organization_id) for r in query.by_name_or_alias(asked, known, "asked").collect()) == [("?", None), ("A", 1), ("C", 3), ("x", None), ("y", 2)]
