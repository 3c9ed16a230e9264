"""Ledgers whose next state depends on what was accepted before: schedules, grants, request budgets.

What an event does depends on the outcome of earlier ones, so no window
function gives it.  `folded` reads sorted partitions front to back and keeps
one key's state at a time.  A key's events are one sequence by definition and
pass one task.  Its state is a few fields, for grants those of each
authorization and target of the key, for budgets as many requests as their cap
allows, and the ids of runs and attempts that occur more than once (counted
beforehand; an id that occurs once can't have been used before).  So memory
grows with a key's authorizations, targets and repeated ids, not with its events.

The steps know their state by item access alone, so that `streaming.ledgers`
can run the same ones over state that lies on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Whether an event's id occurs in another event of its key and kind: only then has it to be remembered.
AGAIN = "__again"


def _with_repeats(events: DataFrame, key: str, id_col: str, kind: str) -> DataFrame:
    """events with AGAIN, for events of this kind (a null id is always remembered); counts are combined before the shuffle and only repeated ids are joined back."""
    of = (F.col("kind") == kind) & F.col(id_col).isNotNull()
    repeated = events.where(of).groupBy(F.col(key).alias("__key"), F.col(id_col).alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__key", "__id", F.lit(True).alias(AGAIN))
    joined = events.join(repeated, events[key].eqNullSafe(repeated["__key"]) & (events[id_col] == repeated["__id"]), "left")
    return joined.select(*events.columns, F.coalesce(AGAIN, F.col(id_col).isNull()).alias(AGAIN))


def folded(events: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], dict], added: str, reads: list[str]) -> DataFrame:
    """events in order by key, each with the columns `added` (a DDL) that `step` returns for it after it has changed the state.

    `reads` names the columns that step looks at; only these become Python values.
    """
    names = [c.split()[0] for c in added.split(", ")]
    kept = [f for f in events.schema if f.name not in names]
    rows = events.select(*[F.col(f"`{f.name}`") for f in kept]).repartition(key).sortWithinPartitions(key, *order)
    seen = [f.name for f in kept if f.name in {key, *reads}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, None, True
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for row in batch.select(seen).to_pylist():
                if first or row[key] != now:
                    now, state, first = row[key], start(), False
                result = step(state, row)
                for n in names:
                    out[n].append(result.get(n))
            types = schema_of(batch, names, out)
            yield pa.RecordBatch.from_arrays([*batch.columns, *types], names=[*batch.schema.names, *names])

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}

    def schema_of(batch, names, out):
        return [pa.array(out[n], kinds[c.split()[1]]) for n, c in zip(names, added.split(", "))]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{fields}, {added}")


def schedules(events: DataFrame, key: str, order: list[str], interval_s: int) -> DataFrame:
    """events with fault, status, next_run (seconds) and failures of their schedule after them (M2).

    Columns: kind (REGISTER, CLAIM, COMPLETE, PAUSE, DISABLE, RECONCILE), at
    (seconds), run, success, risk, eligible.  A fault leaves the state as it
    was: EXISTS, UNKNOWN, NOT_ELIGIBLE, NOT_ACTIVE, RUN_OPEN, NOT_DUE, RUN_USED
    or RUN_NOT_ISSUED.  A schedule is first due when it is registered; a
    completed run puts it off by the interval, a failed one counts, and a risk
    asks for review.  Null success counts as failed, null eligible as not.
    """
    events = _with_repeats(events, key, "run", "CLAIM")
    out = folded(events, key, order, schedule_start, schedule_step(interval_s), SCHEDULE, ["kind", "at", "run", "success", "risk", "eligible", AGAIN])
    return out.drop(AGAIN)


SCHEDULE = "fault string, status string, next_run long, failures int"


def schedule_start() -> dict:
    return {"status": None, "open": None, "next": None, "failures": None, "used": set()}


def schedule_step(interval_s: int) -> Callable[[Any, dict], dict]:
    def step(s: dict, e: dict) -> dict:
        kind, fault = e["kind"], None
        if kind == "REGISTER":
            fault = "EXISTS" if s["status"] else None if e["eligible"] else "NOT_ELIGIBLE"
            if not fault:
                s.update(status="ACTIVE", next=e["at"], failures=0)
        elif not s["status"]:
            fault = "UNKNOWN"
        elif kind == "CLAIM":
            tests = [(not e["eligible"], "NOT_ELIGIBLE"), (s["status"] != "ACTIVE", "NOT_ACTIVE"), (s["open"] is not None, "RUN_OPEN"), (e["at"] < s["next"], "NOT_DUE"), (e["run"] in s["used"], "RUN_USED")]
            fault = next((name for holds, name in tests if holds), None)
            if not fault:
                s["open"] = e["run"]
                if e.get(AGAIN, True):
                    s["used"].add(e["run"])
        elif kind == "COMPLETE":
            fault = None if s["open"] is not None and s["open"] == e["run"] else "RUN_NOT_ISSUED"
            if not fault:
                s.update(open=None, next=e["at"] + interval_s, failures=0 if e["success"] else s["failures"] + 1, status="REVIEW_REQUIRED" if e["risk"] else "ACTIVE")
        elif kind == "RECONCILE":
            if not e["eligible"]:
                s["status"] = "REVIEW_REQUIRED"
        elif kind in ("PAUSE", "DISABLE"):
            s["status"] = {"PAUSE": "PAUSED", "DISABLE": "DISABLED"}[kind]
        else:
            fault = "KIND"
        return {"fault": fault, "status": s["status"], "next_run": s["next"], "failures": s["failures"]}

    return step


def grant_ledger(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """records with fault and version (M4): what a replay of the ledger would have refused, and the grant's version.

    Columns: kind (GRANT, REVOKE, RESERVE, COMPLETE, RECOVER), authorization,
    content (hash of what is granted), effective (seconds), interval_s,
    attempt, holder, target, at, outcome.  A refused record changes nothing.
    The same grant again is a repeat of the old record, not a new version.
    """
    records = _with_repeats(records, key, "attempt", "RESERVE")
    out = folded(records, key, order, grant_start, grant_step, GRANTS, ["kind", "authorization", "content", "effective", "interval_s", "attempt", "holder", "target", "at", "outcome", AGAIN])
    return out.drop(AGAIN)


GRANTS = "fault string, version int"


def grant_start() -> dict:
    return {"grants": {}, "revoked": set(), "open": None, "attempts": set(), "closed": {}, "last": None}


def grant_step(s: Any, r: dict) -> dict:
    kind, fault = r["kind"], None
    grant = s["grants"].get(r["authorization"])
    if kind == "GRANT":
        if r["authorization"] in s["revoked"]:
            fault = "AUTHORIZATION_REVOKED"
        elif grant and grant["content"] == r["content"]:
            fault = "COLLISION"
        elif s["open"]:
            fault = "PENDING_GATE_DENIED"
        else:
            s["grants"][r["authorization"]] = {"content": r["content"], "effective": r["effective"], "interval": r["interval_s"], "version": (grant["version"] if grant else 0) + 1}
    elif kind == "REVOKE":
        fault = "COLLISION" if r["authorization"] in s["revoked"] else "AUTHORIZATION_MISSING" if not grant else "PENDING_GATE_DENIED" if s["open"] else None
        if not fault:
            s["revoked"].add(r["authorization"])
            s["last"] = r["at"]
    elif kind == "RESERVE":
        closed = s["closed"].get(r["target"])
        tests = [
            (not grant, "AUTHORIZATION_MISSING"), (r["authorization"] in s["revoked"], "AUTHORIZATION_REVOKED"), (s["last"] is not None and r["at"] < s["last"], "CLOCK_INVALID"),
            (grant and r["at"] < grant["effective"], "AUTHORIZATION_NOT_EFFECTIVE"), (s["open"], "PENDING_GATE_DENIED"), (r["attempt"] in s["attempts"], "ATTEMPT_ALREADY_USED"),
            (grant and closed and r["at"] < closed[0] + max(grant["interval"], closed[1]), "CADENCE_EXCEEDED"),
        ]
        fault = next((name for holds, name in tests if holds), None)
        if not fault:
            s["open"] = {"attempt": r["attempt"], "holder": r["holder"], "target": r["target"], "at": r["at"], "interval": grant["interval"]}
            if r.get(AGAIN, True):
                s["attempts"].add(r["attempt"])
            s["last"] = r["at"]
    elif kind in ("COMPLETE", "RECOVER"):
        o = s["open"]
        bad = r["outcome"] not in (("SUCCESS", "FAILED") if kind == "COMPLETE" else ("FENCED_UNKNOWN",))
        fault = "ATTEMPT_OUTCOME_INVALID" if bad else "GATE_HOLDER_MISMATCH" if not o or (o["attempt"], o["holder"]) != (r["attempt"], r["holder"]) else "CLOCK_INVALID" if r["at"] < o["at"] else None
        if not fault:
            s["closed"][o["target"]] = (r["at"], o["interval"])
            s.update(open=None, last=r["at"])
    else:
        fault = "RECORD_KIND_INVALID"
    held = s["grants"].get(r["authorization"])
    return {"fault": fault, "version": held["version"] if held else None}


def request_budget(events: DataFrame, key: str, order: list[str], most_requests: int, most_organizations: int, most_targets: int, most_bytes: int, response_bytes: int, retries: int, cooldown_s: int, failed_cooldown_s: int = 86400) -> DataFrame:
    """events with fault and used_bytes (M10): reservations, sends and observations of one scope against its caps.

    Columns: kind (RESERVE, SENT, OBSERVE), intent, organization, target, at
    (seconds), status, bytes.  Faults: INTENT_USED, UNRESOLVED_RESERVATION,
    COOLDOWN, BUDGET_EXHAUSTED, SEND_INVALID, OBSERVATION_DENIED.  A refused event changes nothing.
    """
    step = budget_step(most_requests, most_organizations, most_targets, most_bytes, response_bytes, retries, cooldown_s, failed_cooldown_s)
    return folded(events, key, order, budget_start, step, BUDGET, ["kind", "intent", "organization", "target", "at", "status", "bytes"])


BUDGET = "fault string, used_bytes long"


def budget_start() -> dict:
    return {"requests": {}, "bytes": 0}


def budget_step(most_requests: int, most_organizations: int, most_targets: int, most_bytes: int, response_bytes: int, retries: int, cooldown_s: int, failed_cooldown_s: int) -> Callable[[Any, dict], dict]:
    def step(s: dict, e: dict) -> dict:
        known, fault = s["requests"].get(e["intent"]), None
        if e["kind"] == "RESERVE":
            same = [r for r in s["requests"].values() if (r["organization"], r["target"]) == (e["organization"], e["target"])]
            done = max((r for r in same if r["done"] is not None), key=lambda r: r["done"], default=None)
            wait = None if done is None else failed_cooldown_s if done["status"] == "NETWORK_FAILURE" else cooldown_s
            organizations = {r["organization"] for r in s["requests"].values()} | {e["organization"]}
            targets = {r["target"] for r in s["requests"].values() if r["organization"] == e["organization"]} | {e["target"]}
            tries = sum(r["target"] == e["target"] for r in s["requests"].values())
            tests = [
                (known is not None, "INTENT_USED"), (any(r["done"] is None for r in s["requests"].values()), "UNRESOLVED_RESERVATION"), (done is not None and e["at"] - done["done"] < wait, "COOLDOWN"),
                (len(s["requests"]) >= most_requests or len(organizations) > most_organizations or len(targets) > most_targets or tries > retries, "BUDGET_EXHAUSTED"),
            ]
            fault = next((name for holds, name in tests if holds), None)
            if not fault:
                s["requests"][e["intent"]] = {"organization": e["organization"], "target": e["target"], "at": e["at"], "sent": False, "done": None, "status": None}
        elif e["kind"] == "SENT":
            fault = "SEND_INVALID" if known is None or known["sent"] or known["done"] is not None or e["at"] < known["at"] else None
            if not fault:
                s["requests"][e["intent"]] = {**known, "sent": True}
        else:
            size = -1 if e["bytes"] is None else e["bytes"]
            bad = known is None or known["done"] is not None or e["at"] < known["at"] or (not known["sent"] and e["status"] != "POLICY_DENIED")
            fault = "OBSERVATION_DENIED" if bad or not 0 <= size <= response_bytes or s["bytes"] + size > most_bytes else None
            if not fault:
                s["requests"][e["intent"]] = {**known, "done": e["at"], "status": e["status"]}
                s["bytes"] += size
        return {"fault": fault, "used_bytes": s["bytes"]}

    return step


def expected_heads(commands: DataFrame, key: str, order: list[str], expected: str, content: str) -> DataFrame:
    """commands with outcome, revision and head after each (H10): many writers' decisions against the head that each has seen.

    In order of arrival, a command that names no expected head (null) is LACKS_HEAD,
    one that names another than the current one is STALE, and both change
    nothing; the expected head of a key's first decision is 0.  One of the head's
    own content is SAME; any other wins: ISSUED, and its revision is the head of
    those behind it.  The state of a key is its head's revision and content.
    """

    def step(s: dict, c: dict) -> dict:
        outcome = "LACKS_HEAD" if c[expected] is None else "STALE" if c[expected] != s["head"] else "SAME" if s["head"] and c[content] == s["content"] else "ISSUED"
        if outcome == "ISSUED":
            s.update(head=s["head"] + 1, content=c[content])
        return {"outcome": outcome, "revision": s["head"] if outcome in ("ISSUED", "SAME") else None, "head": s["head"]}

    return folded(commands, key, order, lambda: {"head": 0, "content": None}, step, "outcome string, revision int, head int", [expected, content])


def enumerated(grants: DataFrame, revoked: DataFrame, open_attempts: DataFrame, closed: DataFrame, at: int, scope: str) -> DataFrame:
    """authorization, eligible, reason of the latest grant of each authorization (M5).

    grants: authorization, version, scope, bound (bindings as granted), current
    (as they are now), effective, interval_s, target; revoked: authorization;
    open_attempts: authorization; closed: target, at, interval_s.  Revoked ones
    and those whose scope or bindings differ are left out; an open attempt, a
    grant not yet in force or the cadence defers the others.
    """
    latest = grants.groupBy("authorization").agg(F.max_by(F.struct("scope", "bound", "current", "effective", "interval_s", "target"), "version").alias("g")).select("authorization", "g.*")
    latest = latest.where((F.col("scope") == scope) & F.col("bound").eqNullSafe(F.col("current"))).join(revoked.select("authorization"), "authorization", "left_anti")
    last = closed.groupBy("target").agg(F.max_by(F.struct(F.col("at").alias("closed_at"), F.col("interval_s").alias("closed_interval")), "at").alias("l")).select("target", "l.*")
    held = open_attempts.select("authorization").distinct().withColumn("pending", F.lit(True))
    rows = latest.join(held, "authorization", "left").join(last, "target", "left")
    reason = (
        F.when(F.lit(at) < F.col("effective"), "AUTHORIZATION_NOT_EFFECTIVE")
        .when(F.col("pending"), "PENDING_GATE_DENIED")
        .when(F.lit(at) < F.col("closed_at") + F.greatest("interval_s", "closed_interval"), "CADENCE_DENIED")
    )
    return rows.select("authorization", reason.isNull().alias("eligible"), reason.alias("reason"))


def endpoint_batches(targets: DataFrame, endpoint: str, order: list[str], fields: list[str]) -> DataFrame:
    """endpoint, batch (M11): the targets of an endpoint as a list in the order in which they are to run; an endpoint has few."""
    return targets.groupBy(endpoint).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("batch"))
