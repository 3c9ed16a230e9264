"""Conversation repair against a plain search over all edits, and against one sweep of each whole conversation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recordloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """For one conversation's (turn, role, text): what `reports` says, by a forward search over states."""
    rows = sorted(((t, r or " " if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    white = " \t\n\v\f\r"
    faults, said = [], set()
    for _, role, text in rows:
        core = text.rstrip(white)
        faults.append(2 if not core else 3 if (role, text) in said else 1 if core[-1] not in ".!?" else 0)
        said.add((role, text))
    follow = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
    best = {0: (0, "", ())}

    def better(best, state, new):
        if state not in best or new[:2] < best[state][:2]:
            best[state] = new
            return True
        return False

    def insert(best):
        while any(better(best, to, (c + 5, a + "I", t + (f"{role}:",))) for role in ("user", "assistant") for s, to in follow[role[0]] if s in best for c, a, t in [best[s]]):
            pass

    for (_, role, text), fault in zip(rows, faults):
        insert(best)
        new = {}
        extra = 5 if fault == 1 else 0
        for s, (c, a, t) in best.items():
            better(new, s, (c + 2, a + "D", t))
            if fault < 2:
                for f, to in follow.get(role[:1], []):
                    if f == s:
                        better(new, to, (c + extra, a + "K", t + (f"{role}:{text}",)))
                for other in ("user", "assistant"):
                    for f, to in follow[other[0]]:
                        if f == s:
                            better(new, to, (c + 1 + extra, a + "R", t + (f"{other}:{text}",)))
        best = new
    insert(best)
    cost, audit, kept = min(best[s] for s in (0, 3) if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)


def conversation(r, n):
    rows = []
    for i in range(n):
        kind = r.random()
        role = r.choice(["user", "assistant"]) if kind < 0.8 else r.choice(["system", "tool", None, "", "USER"])
        if kind < 0.5:
            role = ("user", "assistant")[i % 2]
        text = r.choice(["", " \n", None]) if r.random() < 0.06 else f"{r.choice('abcdef')}{r.randint(0, 400)}{r.choice(['.', '!', '?', '.', '. ', ''])}"
        if rows and r.random() < 0.08:
            role, text = r.choice(rows)[1:]
        rows.append((None if r.random() < 0.05 else r.choice([i, i, i, i + 1]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 7, 4096])
def test_reports_equal_a_plain_search(spark, chunk):
    r = random.Random(chunk)
    talks = {k: conversation(r, r.choice([1, 2, 3, 6, 15, 60])) for k in range(14)} | {None: conversation(r, 9), 99: conversation(r, 230)}
    rows = [(k, *row) for k, rows in talks.items() for row in rows]
    r.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {x.conv: tuple(x)[1:] for x in repair.reports(turns, chunk=chunk).collect()}
    assert found == {k: by_hand(rows)[:-1] for k, rows in talks.items()}
    texts = {}
    for x in sorted(repair.repaired_turns(turns, chunk=chunk).collect(), key=lambda x: (x.pos, x.sub)):
        texts.setdefault(x.conv, []).append(f"{x.role}:{x.text}")
        assert (x.edit == "I") == (x.turn is None and x.text == "") or x.turn is None
    assert {k: "\n".join(texts.get(k, [])) for k in talks} == {k: by_hand(rows)[-1] for k, rows in talks.items()}


def test_fix_up_passes_end_where_nothing_converges(spark):
    """All turns of a role that has to go: what stands at the end matters at the start, through every chunk."""
    rows = [(1, i, "tool", f"t{i}.") for i in range(301)] + [(2, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(300)]
    placed = repair.in_order(spark.createDataFrame(rows, SCHEMA).repartition(3))
    state, passes = repair.converged(repair.chunks_of(placed, 4))
    got = {(x.conv, x.chunk): (x.start, x.end) for x in state.collect()}
    step = repair.tables()[1]
    for conv in (1, 2):
        now = repair.tables()[0][repair.END]
        for x in sorted((x for x in repair.chunks_of(placed, 4).collect() if x.conv == conv), key=lambda x: -x.chunk):
            end = now
            for c in reversed(x.codes.encode()):
                now = int(step[now, c - 65])
            assert got[conv, x.chunk] == (now, end)
    # 76 chunks that wait for each other
    assert 2 <= passes <= 7


def test_one_turn_said_very_often_is_cut_into_chunks(spark):
    rows = spark.range(0, 3000).selectExpr("5L AS conv_id", "7L AS turn", "'user' AS role", "'again.' AS text")
    x = repair.reports(rows, chunk=64).first()
    assert (x.duplicate, x.blank, x.illegal, x.cost, x.audit) == (2999, 0, 2999, 2 * 2999 + 2, "D" * 3000)


def test_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.reports(empty).count() == 0 and repair.repaired_turns(empty).count() == 0
    one = spark.createDataFrame([(1, 1, "user", "a.", "x", 2)], SCHEMA + ", conv string, pos int")
    assert repair.reports(one).first().audit == "D"


def test_damage_is_by_key(spark):
    rows = [(i, t, "assistant", "one. two!") for i in range(40) for t in range(5)] + [(None, None, None, None)]
    found = repair.damaged(spark.createDataFrame(rows, SCHEMA)).groupBy("conv_id", "turn").agg(F.collect_list(F.struct("role", "text")).alias("x")).collect()
    import zlib

    got = {(r.conv_id, r.turn): [tuple(x) for x in r.x] for r in found}
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, text.replace(".", "").replace("!", ""))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got.get((c, t)) == want
