"""Conversation structure repair: the cheapest edits that make roles alternate, by rank-convergence parallel Viterbi.

A conversation's turns in order are to read `(s?(ua)+)?` by role initials.  A
turn may be kept (0), given the role user or assistant (1) or deleted (2, the
only choice for blank and duplicate ones); a turn without text may be inserted
anywhere (5); a truncated turn that stays costs 5 more.

States say what stands before a place: nothing, a system, a user or an
assistant turn.  A cost vector holds, for each state, the least cost from a
place to the end; only its differences matter.  Differences stay below a dozen,
so vectors up to a constant are few: they are numbered, and a step over a turn
is a look into a table (`tables`).

Conversations are cut into chunks of at most CHUNK turns.  Every chunk sweeps
backward at once, the last one of a conversation from the true end, all others
from a speculative vector.  Fix-up passes then rerun a chunk whose vector at
the end differs, by more than a constant, from what the chunk behind has
arrived at, and stop inside it as soon as new and old vectors differ by a
constant only, for what stands before is then right already.  When no chunk is
left the vectors are those of one sweep over all.  In pass k runs of 4 * 2**k
chunks are rerun one after the other, so that passes stay few where nothing
converges.  The vectors drive the tracing, forward: each chunk traces the
least audit from all four states, and a stitch over the chunks' ends picks one.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import _crc32_sql, numbered
from .stages import forget, partitions, stored

#: Turns in a chunk: it bounds what is held in one row and one step of work.
CHUNK = 4096
#: Costs of the edits, and what a truncated turn costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Where a turn of a role's initial leads from nothing, system, user, assistant; -1: nowhere.  Rows: s, u, a, any other.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Where an inserted turn, or one of a new role, leads: user turns follow all but user turns.
NEXT = np.array([2, 2, 3, 2])
#: What the end costs: nothing may stand there, or an assistant turn.
END = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("none", "truncated", "blank", "duplicate")
LETTERS = "DKR"
_FAR = 1 << 20


def _moves(vector: np.ndarray, code: int):
    """Of a turn of this code before a place of this vector: costs of D, K and R and of all with insertions, by state, and where K leads."""
    kind, fault = divmod(code, 4)
    extra = TRUNCATED if fault == 1 else 0
    dropped = DELETE + vector
    kept = np.where((KEPT[kind] >= 0) & (fault < 2), vector[KEPT[kind]] + extra, _FAR)
    changed = vector[NEXT] + REROLE + extra if fault < 2 else np.full(4, _FAR)
    best = np.minimum(np.minimum(dropped, kept), changed)
    for _ in range(2):
        best = np.minimum(best, INSERT + best[NEXT])
    return dropped, kept, changed, best


@functools.cache
def tables() -> tuple[dict, np.ndarray, np.ndarray]:
    """Numbers of vectors, the number behind each (vector, code), and the mark of each (vector, code, state).

    A mark is 12 * insertions before the turn + 4 * letter (of LETTERS) + state behind.
    Letters are tried as they sort: D, I, K, R.
    """
    numbers, todo, step, marks = {}, [tuple([0] * 4), END], [], []
    for v in todo:
        numbers[v] = len(numbers)
    for v in todo:
        row, traced = [], []
        for code in range(16):
            vector = np.array(v)
            dropped, kept, changed, best = _moves(vector, code)
            new = tuple(int(x) for x in best - best.min())
            if new not in numbers:
                numbers[new] = len(numbers)
                todo.append(new)
            row.append(numbers[new])
            for state in range(4):
                inserted = 0
                while dropped[state] != best[state] and INSERT + best[NEXT[state]] == best[state]:
                    state, inserted = NEXT[state], inserted + 1
                letter = 0 if dropped[state] == best[state] else 1 if kept[state] == best[state] else 2
                behind = (state, KEPT[code // 4][state], NEXT[state])[letter]
                traced.append(12 * inserted + 4 * letter + behind)
        step.append(row)
        marks.append(traced)
    return numbers, np.array(step, np.int32), np.array(marks, np.uint8).reshape(len(step), 16, 4)


def _role_kind(role: str) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def in_order(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns by conversation and turn, nulls first, then role and the text's SHA-256: conv, turn, role, text, pos, kind, fault.

    pos counts all turns of the table; kind is the initial's number (s, u, a,
    other) and fault an index of FAULTS.  Null roles and texts are one space.
    Equal rows are told apart by where they were read, so that many can be
    dealt out.  Its attribute `reads` names the stored tables that it reads.
    """
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("text", 256)), "copy": F.monotonically_increasing_id()})
    rows = numbered(rows, ["conv", "turn", "role", "sha", "copy"], "pos")
    # said before: counted first, so that a text of very many turns is no hot key
    said = rows.groupBy("conv", "role", "sha").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where("n > 1").drop("n")
    said = said.select(F.col("conv").alias("__conv"), F.col("role").alias("__role"), F.col("sha").alias("__sha"), F.col("pos").alias("__first"))
    out = rows.join(said, rows["conv"].eqNullSafe(said["__conv"]) & (rows["role"] == said["__role"]) & (rows["sha"] == said["__sha"]), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, 2).when(F.col("__first") < F.col("pos"), 3).when(cut, 1).otherwise(0)
    placed = stored(out.select("conv", "turn", "role", "text", "pos", _role_kind("role").alias("kind"), fault.alias("fault")), "turns")
    forget(*rows.reads)
    placed.reads = (placed,)
    return placed


def _pieces(batches, limit: int = 1 << 20):
    """Chunks in groups of about `limit` turns: the rows, their codes end to end, and where each one's begin."""
    for batch in batches:
        texts = [t.encode() for t in batch.column(batch.schema.get_field_index("codes")).to_pylist()]
        row = 0
        while row < len(texts):
            end, size = row, 0
            while end < len(texts) and (end == row or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            codes = np.frombuffer(b"".join(texts[row:end]), np.uint8) - 65
            yield batch.slice(row, end - row), codes, np.cumsum([0, *map(len, texts[row:end])])
            row = end


def _swept(codes: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors' numbers before each turn, and before each chunk, from those at the chunks' ends."""
    _, step, _ = tables()
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    now, before = end[order].copy(), np.zeros(len(codes), np.int32)
    live = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
    for k, n in enumerate(live):
        place = at[1:][order[:n]] - 1 - k
        now[:n] = before[place] = step[now[:n], codes[place]]
    start = np.empty_like(now)
    start[order] = now
    return before, start


_CHUNKS = "conv long, chunk long, base long, final boolean, codes string, end int, start int"


def _first(batches):
    numbers, _, _ = tables()
    for batch, codes, at in _pieces(batches):
        final = batch.column(batch.schema.get_field_index("final")).to_numpy(zero_copy_only=False)
        end = np.where(final, numbers[END], numbers[(0, 0, 0, 0)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(end), pa.array(_swept(codes, at, end)[1])], names=[*batch.schema.names, "end", "start"])


def _mended(batches):
    """Chunks of a run from its last to its first, each after the one behind it; `behind` counts for the last one."""
    step = tables()[1].tolist()
    run, arrived = None, None
    for batch in batches:
        columns = batch.to_pydict()
        for i in range(batch.num_rows):
            key = columns["conv"][i], columns["run"][i]
            new = columns["behind"][i] if key != run else arrived
            run, old = key, columns["end"][i]
            if new is not None and new != old:
                columns["end"][i], a, b = new, new, old
                for c in reversed(columns["codes"][i].encode()):
                    a, b = step[a][c - 65], step[b][c - 65]
                    if a == b:
                        break
                else:
                    columns["start"][i] = a
            arrived = columns["start"][i]
        names = [n for n in columns if n not in ("run", "behind")]
        yield pa.RecordBatch.from_arrays([pa.array(columns[n], batch.schema.field(n).type) for n in names], names=names)


def _traced(batches):
    """Marks of every chunk from each state, where they lead, and its neighbours of wrong roles."""
    _, _, marks = tables()
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True
    for batch, codes, at in _pieces(batches):
        end = batch.column(batch.schema.get_field_index("end")).to_numpy()
        before, _ = _swept(codes, at, end)
        # the vector behind each turn
        behind = np.empty_like(before)
        behind[:-1] = before[1:]
        behind[at[1:] - 1] = end
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        live = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
        state, out = np.tile(np.arange(4), (len(sizes), 1)), np.zeros((len(codes), 4), np.uint8)
        for k, n in enumerate(live):
            place = at[:-1][order[:n]] + k
            out[place] = marks[behind[place][:, None], codes[place][:, None], state[:n]]
            state[:n] = out[place] % 4
        ends = np.empty_like(state)
        ends[order] = state
        kinds = codes // 4
        wrong = np.zeros(len(codes), np.int64)
        wrong[1:] = ~legal[kinds[:-1], kinds[1:]]
        wrong[at[:-1]] = 0
        offsets = pa.array(at.astype(np.int32))
        arrays = [batch.column(batch.schema.get_field_index(n)) for n in ("conv", "chunk", "base")]
        arrays += [pa.array(ends[:, s].astype(np.int32)) for s in range(4)]
        arrays += [pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(out[:, s]))]) for s in range(4)]
        arrays += [pa.array(kinds[at[:-1]].astype(np.int32)), pa.array(kinds[at[1:] - 1].astype(np.int32)), pa.array(np.add.reduceat(wrong, at[:-1]))]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv", "chunk", "base", *(f"e{s}" for s in range(4)), *(f"m{s}" for s in range(4)), "first", "last", "wrong"])


def _stitched(batches):
    """The state that each chunk starts from and the one it leads to, and wrong neighbours with that across its start."""
    conv, state, last, begun = None, 0, 0, False
    for batch in batches:
        c = batch.to_pydict()
        enter, leave, wrong = [], [], []
        for i in range(batch.num_rows):
            if not begun or c["conv"][i] != conv:
                conv, state, begun, across = c["conv"][i], 0, True, 0
            else:
                across = int((last, c["first"][i]) not in ((0, 1), (1, 2), (2, 1)))
            enter.append(state)
            state, last = c[f"e{state}"][i], c["last"][i]
            leave.append(state)
            wrong.append(c["wrong"][i] + across)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(enter, pa.int32()), pa.array(leave, pa.int32()), pa.array(wrong, pa.int64())], names=["conv", "chunk", "enter", "leave", "wrong"])


def _picked(batches):
    """A row for each turn: its pos, insertions before it, letter and state behind it."""
    for batch in batches:
        c = batch.to_pydict()
        marks = [np.frombuffer(m, np.uint8) for m in c["mark"]]
        if not marks:
            continue
        sizes = [len(m) for m in marks]
        pos = np.concatenate([b + np.arange(n) for b, n in zip(c["base"], sizes)])
        mark = np.concatenate(marks)
        yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int64)), pa.array((mark // 12).astype(np.int32)), pa.array((mark % 12 // 4).astype(np.int32)), pa.array((mark % 4).astype(np.int32))], names=["at", "inserted", "letter", "behind"])


def chunks_of(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of at most `chunk` turns of a conversation, by pos, with a character for each turn's kind and fault."""
    code = F.char((F.lit(65) + 4 * F.col("kind") + F.col("fault")).cast("int"))
    cut = rows.select("conv", F.floor(F.col("pos") / chunk).alias("chunk"), "pos", code.alias("code")).groupBy("conv", "chunk")
    cut = cut.agg(F.min("pos").alias("base"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("codes"))
    w = Window.partitionBy("conv").orderBy("chunk")
    return cut.select("conv", "chunk", "base", F.lead("chunk").over(w).isNull().alias("final"), F.array_join(F.col("codes.code"), "").alias("codes"))


def converged(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Chunks with the numbers of the vectors at their ends and starts, as one sweep over each whole conversation has them; and the fix-up passes."""
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    state = stored(chunks.mapInArrow(_first, _CHUNKS), "chunks")
    passes = 0
    while True:
        w = Window.partitionBy("conv").orderBy("chunk")
        behind = state.select("conv", "chunk", "end", F.lead("start").over(w).alias("behind"))
        if behind.where("behind != end").isEmpty():
            return state, passes
        passes += 1
        old = state
        linked = behind.select(F.col("conv").alias("__conv"), F.col("chunk").alias("__chunk"), "behind")
        work = old.join(linked, old["conv"].eqNullSafe(linked["__conv"]) & (old["chunk"] == linked["__chunk"]))
        work = work.select(*names, "behind", F.shiftright("chunk", passes + 1).alias("run"))
        work = work.repartition(partitions(old.sparkSession), "conv", "run").sortWithinPartitions("conv", "run", F.desc("chunk"))
        state = stored(work.mapInArrow(_mended, _CHUNKS), "chunks")
        forget(old)


def edits(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The least audit of the cheapest edits, for turns from `in_order`.

    First: the turns with `inserted` (turns put in before it, 0 to 2), `letter`
    (index of LETTERS) and `behind` (the state after it: 0 nothing, 1 system,
    2 user, 3 assistant).  Second: for each conversation, `illegal`, its
    neighbours of roles that may not follow each other, and `left`, the state
    that its last turn leaves: 1 and 2 call for two and one more insertions.
    Both read stored tables, named in their attribute `reads`.
    """
    p = partitions(rows.sparkSession)
    state, _ = converged(chunks_of(rows, chunk))
    traced = stored(state.mapInArrow(_traced, "conv long, chunk long, base long, e0 int, e1 int, e2 int, e3 int, m0 binary, m1 binary, m2 binary, m3 binary, first int, last int, wrong long"), "traces")
    forget(state)
    ends = traced.select("conv", "chunk", "e0", "e1", "e2", "e3", "first", "last", "wrong").repartition(p, "conv").sortWithinPartitions("conv", "chunk")
    ways = stored(ends.mapInArrow(_stitched, "conv long, chunk long, enter int, leave int, wrong long"), "ways")
    way = ways.select(F.col("conv").alias("__conv"), F.col("chunk").alias("__chunk"), "enter")
    picked = traced.join(way, traced["conv"].eqNullSafe(way["__conv"]) & (traced["chunk"] == way["__chunk"]))
    picked = picked.select("base", F.expr("CASE enter WHEN 0 THEN m0 WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END").alias("mark"))
    marks = picked.mapInArrow(_picked, "at long, inserted int, letter int, behind int")
    out = rows.join(marks, rows["pos"] == marks["at"]).drop("at")
    ended = ways.groupBy("conv").agg(F.sum("wrong").alias("illegal"), F.max_by("leave", "chunk").alias("left"))
    out.reads = ended.reads = (traced, ways)
    return out, ended


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The turns of the cheapest repairs: conv, pos, sub, turn, role, text, edit (K kept, R of a new role, I inserted, without text or turn).

    Order by conv, pos, sub; inserted turns have the pos of the turn that they
    stand before, those at an end the pos of the last turn and sub 1 and 2 where
    that turn has 0.  Among equally cheap repairs the one whose letters (D for a
    deleted turn) sort first is taken.  Null roles and texts are one space; a
    null conversation id is one conversation; no turns, no rows.
    """
    rows = in_order(turns, conv_col, turn_col, role_col, text_col)
    marked, ended = edits(rows, chunk)
    role = lambda state: F.when(state == 3, "assistant").otherwise("user")
    # the state before a turn's own edit: the last inserted one
    state = F.when(F.col("letter") == 0, F.col("behind")).otherwise(F.when(F.col("behind") == 3, 2).otherwise(3))
    none = F.lit(None).cast("long")
    own = F.struct(F.lit(0).alias("sub"), F.col("turn"), F.when(F.col("letter") == 2, role(F.col("behind"))).otherwise(F.col("role")).alias("role"), F.col("text"), F.when(F.col("letter") == 2, "R").otherwise("K").alias("edit"))
    put = lambda sub, state: F.struct(F.lit(sub).alias("sub"), none.alias("turn"), role(state).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    parts = F.array(F.when(F.col("inserted") == 2, put(-2, 5 - state)), F.when(F.col("inserted") > 0, put(-1, state)), F.when(F.col("letter") > 0, own))
    body = marked.select("conv", "pos", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x")).select("conv", "pos", "x.*")
    last = rows.groupBy("conv").agg(F.max("pos").alias("pos")).withColumnRenamed("conv", "__conv")
    tail = ended.where("left IN (1, 2)").join(last, F.col("conv").eqNullSafe(F.col("__conv")))
    tail = tail.select("conv", "pos", F.explode(F.when(F.col("left") == 1, F.array(put(1, F.lit(2)), put(2, F.lit(3)))).otherwise(F.array(put(1, F.lit(3))))).alias("x")).select("conv", "pos", "x.*")
    return body.unionByName(tail)


def _digested(batches):
    """Cost, audit and hash of each conversation, from its turns in order; a text leaves memory when it has been hashed."""
    conv, begun, audit, cost, sha, any_ = None, False, [], 0, None, False
    names = ["", "system", "user", "assistant"]

    def done():
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([cost], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["conv", "cost", "audit", "repaired_sha256"])

    def put(role, text):
        nonlocal any_
        sha.update(f"{chr(10) * any_}{role}:{text}".encode())
        any_ = True

    for batch in batches:
        c = batch.to_pydict()
        for i in range(batch.num_rows):
            if not begun or c["conv"][i] != conv:
                if begun:
                    yield done()
                conv, begun, audit, cost, sha, any_ = c["conv"][i], True, [], 0, hashlib.sha256(), False
            inserted, letter, behind = c["inserted"][i], c["letter"][i], c["behind"][i]
            state = behind if letter in (0, 3) else 2 if behind == 3 else 3
            for k in range(inserted):
                put(names[state if (inserted - k) % 2 else 5 - state], "")
            audit.append("I" * inserted)
            cost += INSERT * inserted
            if letter < 3:
                audit.append(LETTERS[letter])
                cost += (DELETE, 0, REROLE)[letter] + (TRUNCATED if letter and c["fault"][i] == 1 else 0)
            if letter in (1, 2):
                put(names[behind] if letter == 2 else c["role"][i], c["text"][i])
    if begun:
        yield done()


def reports(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """For each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps counts the turn numbers missing between the least and the greatest;
    illegal counts neighbours of roles that may not follow each other.  A
    conversation's audit and hash are one string each, so its turns pass one
    task in order, sorted on disk; all else is done by chunks.  Nulls as in
    `repaired_turns`; no turns, no rows.
    """
    rows = in_order(turns, conv_col, turn_col, role_col, text_col)
    marked, ended = edits(rows, chunk)
    # what is put in at an end comes as a last row of letter 3
    tail = ended.where("left IN (1, 2)").select("conv", F.lit((1 << 63) - 1).alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("fault"), F.when(F.col("left") == 1, 2).otherwise(1).alias("inserted"), F.lit(3).alias("letter"), F.lit(3).alias("behind"))
    work = marked.select(*tail.columns).unionByName(tail)
    work = work.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "pos")
    digests = work.mapInArrow(_digested, "conv long, cost long, audit string, repaired_sha256 string")
    count = lambda k: F.count_if(F.col("fault") == k)
    counts = rows.groupBy("conv").agg(
        F.max("turn").alias("__max"), F.min("turn").alias("__min"), F.countDistinct("turn").alias("__turns"),
        count(2).alias("blank"), count(3).alias("duplicate"), count(1).alias("truncated"))
    gaps = F.coalesce(F.col("__max") - F.col("__min") + 1 - F.col("__turns"), F.lit(0))
    out = counts.select(F.col("conv").alias("__conv"), gaps.alias("gaps"), "blank", "duplicate", "truncated")
    out = out.join(ended.select(F.col("conv").alias("__of"), "illegal"), F.col("__conv").eqNullSafe(F.col("__of")))
    out = out.join(digests, F.col("__conv").eqNullSafe(F.col("conv")))
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with each turn damaged as crc32 of `conv_id:turn`, remainder by 20, says; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind != 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("n")).drop("n")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = reports(damaged(turns))
    ids = turns.select("conv_id").distinct()
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """A forward Viterbi of all four states, turn by turn, that carries costs, audits and repaired texts."""
    far = 1000000000
    put = lambda s, t, role: f"{{'c': {s}.c + 5, 'a': {s}.a || 'I', 't': {s}.t || '{role}:' || chr(10)}}"
    move = lambda s, ok, cost, letter, text: f"{{'c': CASE WHEN {ok} THEN {s}.c + {cost} ELSE {far} END, 'a': {s}.a || '{letter}', 't': {s}.t || {text}}}"
    may = "fault < 2"
    drop = lambda s: move(s, "true", 2, "D", "''")
    keep = lambda s, k: move(s, f"{may} AND kind = {k}", "extra", "K", "role || ':' || text || chr(10)")
    role = lambda s, to: move(s, may, "1 + extra", "R", f"'{to}:' || text || chr(10)")
    users = [f for s in ("s0", "s1", "s3") for f in (keep(s, 1), role(s, "user"))]
    one = f"list_min([{drop('s2')}, {', '.join(users)}])"
    two = f"list_min([{drop('s3')}, {keep('s2', 2)}, {role('s2', 'assistant')}])"
    zero = drop("s0")
    first = f"list_min([{drop('s1')}, {keep('s0', 0)}])"
    closed = f"SELECT conv_id, n, s0, s1, list_min([s2, {put('s0', 2, 'user')}, {put('s1', 2, 'user')}, {put('s3', 2, 'user')}]) AS s2, s3"
    return f"""
WITH RECURSIVE num AS (SELECT *, row_number() OVER () AS rn FROM conversations),
hx AS (SELECT rn, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM num),
crc AS (SELECT rn, {_crc32_sql('x')} % 20 AS d FROM hx),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM num JOIN crc USING (rn) WHERE d != 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM hurt),
said AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS times, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 2 WHEN times > 1 THEN 3 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END AS fault,
  CASE role[1] WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind FROM said),
row_ AS (SELECT conv_id, n, role, text, fault, kind, CASE WHEN fault = 1 THEN 5 ELSE 0 END AS extra FROM judged),
sizes AS (SELECT conv_id, max(n) AS last, (max(turn) - min(turn) + 1 - count(DISTINCT turn)) AS gaps, count_if(fault = 2) AS blank, count_if(fault = 3) AS duplicate, count_if(fault = 1) AS truncated,
  count_if(before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
way(conv_id, n, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}, {{'c': {far}, 'a': '', 't': ''}}, {{'c': 5, 'a': 'I', 't': 'user:' || chr(10)}}, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} FROM sizes
  UNION ALL
  SELECT conv_id, n, s0, s1, s2, list_min([s3, {put('s2', 3, 'assistant')}]) FROM (
    {closed} FROM (
      SELECT conv_id, n, s0, s1, s2, list_min([s3, {put('s2', 3, 'assistant')}]) AS s3 FROM (
        {closed} FROM (
          SELECT w.conv_id, w.n + 1 AS n, {zero} AS s0, {first} AS s1, {one} AS s2, {two} AS s3
          FROM way w JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1))))),
done AS (SELECT s.conv_id, list_min([s0, s3]) AS e FROM way w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.last = w.n),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(e.t[:-2], '')) AS repaired_sha256
FROM ids i LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM i.conv_id
"""


OP13_SQL = _sql()
