"""Texts against very many patterns (E13): one scan for the literals that patterns need, then only patterns whose literals are there.

Most patterns can match only where some literal stands.  Those literals go into
one automaton, which reads every text once and names the rules that may match;
only these are run as regular expressions, as many as occur: plain ones a pattern at a
time over its texts by Arrow, others by Spark.  Rules that need no literal are run on every text, as `rules.findings` does.

Patterns of one shape, a head of a few characters before a tail that many share, are not run one by one: a
text's places where the tail matches are found once, and the characters before them are looked up among all heads.
"""

from __future__ import annotations

import ast
import functools
import hashlib
import itertools
import math
import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import dealt, merged, stored

try:
    from re import _constants as codes, _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as codes
    import sre_parse as parser

#: Bytes of patterns and their literals in one automaton; more of them are dealt into several, one after the other.
BLOCK_BYTES = 4 << 20
#: Patterns that one copy of a text carries; characters of text, and patterns, in one batch.
MOST_TRIED, BATCH_BYTES, BATCH_TRIED = 1000, 4 << 20, 50000
#: Patterns without a literal in one expression.
RULES = 500
#: Alternatives of one pattern, one of which must occur.
MOST_CHOICES = 16
#: Characters of a head, and steps of a tail; patterns for each shape of head that make a shared tail worth its scan.
MOST_HEAD, MOST_STEPS, SHARED = 16, 64, 4
#: Bytes of text that heads are looked for in at once, findings in the making, rules of one pattern in one block.
SLICE_BYTES, MOST_MADE, MOST_NAMES = 1 << 20, 1 << 20, 10000
#: What ends a text among the characters of several.
_END = np.uint32(0xFFFFFFFF)
_automata: dict = {}
_shapes: dict = {}


def literals(pattern: str) -> list[str] | None:
    """Literals of which one must occur in any text that the pattern matches; None where none is known.

    Only what both Java's and Python's syntax take alike is looked into: a
    pattern that Python doesn't parse, or that changes the case, has none.
    """
    if re.search(r"\(\?[a-zA-Z-]*[ixU]|\\Q|\\[pPhHvVXRGkK]|&&|\[[^\]]*\[", pattern):
        return None
    try:
        found = _best(list(parser.parse(pattern)))
    except (re.error, OverflowError, RecursionError):
        return None
    return sorted(set(found)) if found and len(found) <= MOST_CHOICES else None


def _weight(choices: list[str] | None) -> int:
    return min(map(len, choices)) if choices else 0


def _best(nodes: list) -> list[str]:
    """The choices with the longest shortest literal, of a sequence of parsed nodes."""
    best: list[str] = []
    run = ""
    for op, arg in [*nodes, (None, None)]:
        if op is codes.LITERAL:
            run += chr(arg)
            continue
        if op is codes.SUBPATTERN and not arg[1] and not arg[2]:
            inner = list(arg[3])
            if all(o is codes.LITERAL for o, _ in inner):
                run += "".join(chr(a) for _, a in inner)
                continue
        if run and len(run) > _weight(best):
            best = [run]
        run = ""
        if op is codes.SUBPATTERN:
            own = _best(list(arg[3])) if not arg[1] and not arg[2] else []
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and arg[0] > 0:
            own = _best(list(arg[2]))
        elif op is codes.BRANCH:
            sides = [_best(list(side)) for side in arg[1]]
            own = [x for side in sides for x in side] if all(sides) else []
        else:
            own = []
        if _weight(own) > _weight(best):
            best = own
    return best


def plain(pattern: str) -> bool:
    """Whether a pattern has only what Java, Python and RE2 read alike: literals, classes of them, any character (?s:.), choices and repeats.

    Such a pattern describes one set of strings, so any engine tells whether a text holds one.
    """
    if re.search(r"\\(?![^\w\s])|\[\^?\]|\[[^\]]*\[|&&|\{(?!\d+(,\d*)?\})|\(\?(?!s?:)|\0", pattern):
        return False

    def known(nodes, dotall: bool) -> bool:
        for op, arg in nodes:
            if op in (codes.LITERAL, codes.NOT_LITERAL) or (op is codes.ANY and dotall):
                continue
            if op is codes.IN and all(o in (codes.LITERAL, codes.RANGE, codes.NEGATE) for o, _ in arg):
                continue
            if op is codes.SUBPATTERN and not arg[2] and known(arg[3], dotall or bool(arg[1] & re.DOTALL)):
                continue
            if op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and known(arg[2], dotall):
                continue
            if op is codes.BRANCH and all(known(side, dotall) for side in arg[1]):
                continue
            return False
        return True

    try:
        return known(parser.parse(pattern), False)
    except (re.error, OverflowError, RecursionError):
        return False


def _flat(nodes):
    for op, arg in nodes:
        if op is codes.SUBPATTERN:
            yield from _flat(arg[3])
        else:
            yield op, arg


def _steps(nodes) -> tuple[list, int]:
    """Parsed nodes of a plain pattern as classes of characters, choices and repeats, and how many steps they take; ValueError where a repeat of more than a character has no end."""
    out, size = [], 0
    for op, arg in _flat(nodes):
        if op is codes.LITERAL:
            step, n = ("in", False, ((arg, arg),)), 1
        elif op is codes.NOT_LITERAL:
            step, n = ("in", True, ((arg, arg),)), 1
        elif op is codes.ANY:
            step, n = ("in", True, ()), 1
        elif op is codes.IN:
            kept = [(o, a) for o, a in arg if o is not codes.NEGATE]
            step, n = ("in", len(kept) < len(arg), tuple((a, a) if o is codes.LITERAL else tuple(a) for o, a in kept)), 1
        elif op is codes.BRANCH:
            sides = [_steps(side) for side in arg[1]]
            step, n = ("or", tuple(tuple(x) for x, _ in sides)), sum(k for _, k in sides) + 1
        else:
            low, high, (inner, n) = arg[0], None if arg[1] is codes.MAXREPEAT else int(arg[1]), _steps(arg[2])
            if len(inner) == 1 and inner[0][0] == "in":
                step, n = ("run", int(low), high, inner[0]), 2
            elif high is None:
                raise ValueError("no end")
            else:
                step, n = ("times", int(low), high, tuple(inner)), (n + 1) * high
        out.append(step)
        size += n
    return out, size


def shaped(pattern: str) -> tuple[list[int], str] | None:
    """A plain pattern's head, its first characters (-1 for any), and what follows as text; None where there is no such head or tail."""
    if not plain(pattern):
        return None
    nodes = list(_flat(parser.parse(pattern)))
    head = [arg if op is codes.LITERAL else -1 for op, arg in itertools.takewhile(lambda n: n[0] in (codes.LITERAL, codes.ANY), nodes)][:MOST_HEAD]
    try:
        tail, size = _steps(nodes[len(head) :])
    except ValueError:
        return None
    return (head, repr(tail)) if tail and size <= MOST_STEPS else None


def _next(yes: np.ndarray) -> np.ndarray:
    """The first place from each one on where it is so; their number where there is none."""
    at = np.where(yes, np.arange(len(yes), dtype=np.int32), np.int32(len(yes)))
    return np.minimum.accumulate(at[::-1])[::-1]


def _ahead(yes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(yes), bool)
    if n < len(yes):
        out[: len(yes) - n] = yes[n:]
    return out


def _places(steps, chars: np.ndarray, after: np.ndarray, classes: dict) -> np.ndarray:
    """Places of the characters from which the steps match up to a place of `after`; a number of passes over them that only the steps give."""

    def members(step):
        if step not in classes:
            _, negated, ranges = step
            found = np.zeros(len(chars), bool)
            for low, high in ranges:
                found |= chars == low if low == high else (chars >= low) & (chars <= high)
            classes[step] = ~found & (chars != _END) if negated else found
        return classes[step]

    for step in reversed(steps):
        if step[0] == "in":
            after = members(step) & _ahead(after, 1)
        elif step[0] == "or":
            after = np.logical_or.reduce([_places(side, chars, after, classes) for side in step[1]])
        elif step[0] == "run":
            _, low, high, one = step
            here, stop, goal = np.arange(len(chars), dtype=np.int32), _next(~members(one)), _next(after)
            reached = np.full(len(chars), len(chars), np.int32)
            if low < len(chars):
                reached[: len(chars) - low] = goal[low:]
            after = (reached <= stop) & (reached < len(chars))
            if high is not None:
                after &= reached - here <= high
        else:
            _, low, high, inner = step
            end = after
            for _ in range(high - low):
                after = end | _places(inner, chars, after, classes)
            for _ in range(low):
                after = _places(inner, chars, after, classes)
    return after


def _heads(shared):
    """The block's rules by pattern, and by tail and length of head what each shape of head is looked up in; built once in each worker."""
    key = shared.value["digest"]
    if key not in _shapes:
        _shapes.clear()
        rules = pa.ipc.open_stream(shared.value["rules"]).read_all().combine_chunks()
        ids = rules.column("__rule").to_numpy()
        first = np.flatnonzero(np.append([True], ids[1:] != ids[:-1]))
        heads, tails = (rules.column(n).combine_chunks().take(pa.array(first)) for n in ("__head", "__tail"))
        tails = tails.dictionary_encode()
        tail, width = tails.indices.to_numpy(), heads.value_lengths().to_numpy()
        made = []
        for t, text in enumerate(tails.dictionary.to_pylist()):
            by_width = []
            for w in np.unique(width[tail == t]).tolist():
                own = np.flatnonzero((tail == t) & (width == w))
                chars = heads.take(pa.array(own)).flatten().to_numpy().reshape(len(own), w)
                mult = np.random.default_rng(w).integers(1, 1 << 64, w, np.uint64, endpoint=False) | np.uint64(1)
                sums = (np.where(chars >= 0, chars, 0).astype(np.uint64) * mult).sum(1, dtype=np.uint64)
                shape = (chars >= 0) @ (1 << np.arange(w))
                tables = []
                for s in np.unique(shape).tolist():
                    at = np.flatnonzero(shape == s)
                    at = at[np.argsort(sums[at], kind="stable")]
                    bits = min(22, max(12, len(at).bit_length() + 6))
                    may = np.zeros(1 << bits, bool)
                    may[sums[at] >> np.uint64(64 - bits)] = True
                    tables.append(([o for o in range(w) if s >> o & 1], sums[at], chars[at], own[at], np.uint64(64 - bits), may))
                by_width.append((w, mult, tables))
            made.append((ast.literal_eval(text), by_width))
        names = np.diff(np.append(first, len(ids)))
        _shapes[key] = rules, first, names, made
    return _shapes[key]


def _added(parts, n: int) -> np.ndarray:
    return functools.reduce(np.add, parts, np.zeros(n, np.uint64))


def _expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run [start, start + count) all places, run by run."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def _with_heads(chars: np.ndarray, begins: np.ndarray, weight: np.ndarray, made):
    """Texts and patterns that match them, no pair twice, some texts at a time; weight: of each pattern, how much a finding makes."""
    rows_of, windows_of, heads_of, patterns_of, seen = [], [], [], [], 0
    classes: dict = {}
    for tail, by_width in made:
        ends = np.flatnonzero(_places(tail, chars, np.ones(len(chars), bool), classes))
        rows = np.searchsorted(begins, ends, "right") - 1
        for w, mult, tables in by_width:
            fit = ends - w >= begins[rows]
            at, row = ends[fit] - w, rows[fit]
            if not len(at):
                continue
            window = [chars[at + o] for o in range(w)]
            parts = [c * m for c, m in zip(window, mult)]
            _, one, of = np.unique(_added(parts, len(at)), return_index=True, return_inverse=True)
            if not all((c[one][of] == c).all() for c in window):  # two of one hash
                one = of = np.arange(len(at))
            window, parts = [c[one] for c in window], [p[one] for p in parts]
            for offsets, sums, heads, own, shift, may in tables:
                asked = _added([parts[o] for o in offsets], len(one))
                hit = np.flatnonzero(may[asked >> shift])
                low = np.searchsorted(sums, asked[hit], "left")
                n = np.searchsorted(sums, asked[hit], "right") - low
                hit, found = np.repeat(hit, n), _expanded(low, n)
                same = np.ones(len(hit), bool)
                for o in offsets:
                    same &= window[o][hit] == heads[found, o]
                heads_of.append(hit[same] + seen)
                patterns_of.append(own[found[same]])
            pair = np.unique(row * len(one) + of)
            rows_of.append(pair // len(one))
            windows_of.append(pair % len(one) + seen)
            seen += len(one)
    if not heads_of:
        return
    heads, patterns = np.concatenate(heads_of), np.concatenate(patterns_of)
    order = np.argsort(heads, kind="stable")
    heads, patterns = heads[order], patterns[order]
    rows, windows = np.concatenate(rows_of), np.concatenate(windows_of)
    first, n = np.searchsorted(heads, windows, "left"), np.searchsorted(heads, windows, "right")
    keep = np.flatnonzero(n > first)
    keep = keep[np.argsort(rows[keep], kind="stable")]
    rows, first, n = rows[keep], first[keep], (n - first)[keep]
    sizes = np.append(0, np.cumsum(weight[patterns]))
    upto = np.cumsum(sizes[first + n] - sizes[first])
    # whole texts, as many as make about MOST_MADE findings
    lasts = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else rows
    cuts = lasts[np.append(np.diff(upto[lasts] // MOST_MADE) > 0, True)] + 1 if len(lasts) else lasts
    for start, end in zip([0, *cuts[:-1]], cuts):
        some = patterns[_expanded(first[start:end], n[start:end])]
        pair = np.unique(np.repeat(rows[start:end], n[start:end]) * len(weight) + some)
        yield pair // len(weight), pair % len(weight)


def _named(shared):
    """Rows of the texts without the text, and category and rule of every pattern that matches."""

    def run(batches):
        rules, first, names, made = _heads(shared)
        for batch in _sliced(batches, SLICE_BYTES):
            texts = batch.column("__text")
            sizes = pc.utf8_length(texts).to_numpy().astype(np.int64) + 1
            ends = np.cumsum(sizes)
            chars = np.frombuffer(("\0".join(texts.to_pylist()) + "\0").encode("utf-32-le"), np.uint32).copy()
            chars[ends - 1] = _END
            for rows, found in _with_heads(chars, ends - sizes, names, made):
                rows, at = np.repeat(rows, names[found]), _expanded(first[found], names[found])
                for s in range(0, len(rows), BATCH_TRIED):
                    row, name = pa.array(rows[s : s + BATCH_TRIED]), pa.array(at[s : s + BATCH_TRIED])
                    columns = {n: batch.column(n).take(row) for n in batch.schema.names if n != "__text"}
                    columns |= {n: rules.column(n).combine_chunks().take(name) for n in ("category", "rule")}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _automaton(shared):
    """The automaton, what owns each literal, the patterns, and which are plain; built once in each worker."""
    key = shared.value["digest"]
    if key not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for n, (_, _, needs) in enumerate(shared.value["patterns"]):
            for literal in needs:
                owners.setdefault(literal, []).append(n)
        for k, literal in enumerate(owners):
            found.add_word(literal, k)
        found.make_automaton()
        rules, texts, _ = zip(*shared.value["patterns"])
        made = pa.StructArray.from_arrays([pa.array(rules, pa.int64()), pa.array(texts, pa.string())], names=["rule", "pattern"])
        _automata[key] = found, [np.array(o) for o in owners.values()], made, [plain(t) for t in texts]
    return _automata[key]


def _candidates(shared):
    """Rows with __may: the patterns that may match the text, and without text and pattern those that do.

    A text is repeated once for each MOST_TRIED patterns, and a batch ends after
    BATCH_BYTES of text or BATCH_TRIED patterns, so that neither grows with the
    number of patterns.
    """

    def flushed(batch, at, parts, made, texts):
        may = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), made.take(pa.array(np.concatenate(parts))))
        columns = [texts.take(at) if name == "__text" else batch.column(name).take(at) for name in batch.schema.names]
        return pa.RecordBatch.from_arrays([*columns, may], names=[*batch.schema.names, "__may"])

    def run(batches):
        automaton, owners, made, shared_syntax = _automaton(shared)
        told = pa.StructArray.from_arrays([made.field("rule"), pa.nulls(len(made), pa.string())], names=["rule", "pattern"])
        for batch in _sliced(batches):
            texts = batch.column("__text")
            mays = []
            for i in range(len(batch)):
                text = texts[i].as_py()
                hit = {k for _, k in automaton.iter(text)} if text else ()
                mays.append(np.unique(np.concatenate([owners[k] for k in hit])) if hit else np.empty(0, np.int64))
            # by pattern: those of a syntax that all read alike are settled here, a pattern at a time over its texts
            at, may = np.repeat(np.arange(len(mays)), [len(m) for m in mays]), np.concatenate([*mays, np.empty(0, np.int64)])
            order = np.argsort(may, kind="stable")
            at, may = at[order], may[order]
            found, left = [], []
            for own in np.split(np.arange(len(may)), np.flatnonzero(np.diff(may)) + 1) if len(may) else ():
                n = may[own[0]]
                if not shared_syntax[n]:
                    left.append(own)
                    continue
                try:
                    yes = pc.match_substring_regex(texts.take(pa.array(at[own])), made.field("pattern")[n].as_py())
                except pa.ArrowInvalid:  # too large for that engine
                    left.append(own)
                    continue
                found.append(own[yes.to_numpy(zero_copy_only=False)])
            for some, names, shown in ((found, told, pa.nulls(len(texts), texts.type)), (left, made, texts)):
                if not some:
                    continue
                some = np.sort(np.concatenate(some))
                some = some[np.argsort(at[some], kind="stable")]
                rows, parts, size, tried = [], [], 0, 0
                for own in np.split(some, np.flatnonzero(np.diff(at[some])) + 1) if len(some) else ():
                    for start in range(0, len(own), MOST_TRIED):
                        part = may[own[start : start + MOST_TRIED]]
                        rows.append(at[own[0]])
                        parts.append(part)
                        size, tried = size + len(shown[rows[-1]].as_py() or ""), tried + len(part)
                        if size >= BATCH_BYTES or tried >= BATCH_TRIED:
                            yield flushed(batch, pa.array(rows), parts, names, shown)
                            rows, parts, size, tried = [], [], 0, 0
                if rows:
                    yield flushed(batch, pa.array(rows), parts, names, shown)

    return run


def _sliced(batches, limit: int = BATCH_BYTES):
    """Batches of about `limit` bytes of text at most, and a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False).astype("int64")
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(batch)]):
            if end > start:
                yield batch.slice(start, end - start)


def many_findings(texts: DataFrame, id_col: str, text_col: str, rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, category, rule: every rule that a text matches, once for each row of texts, as `rlike` says.

    rules: category, rule, pattern, as many as there are; a pattern that several
    share is tried once.  Patterns are collected in blocks of about block_bytes,
    one automaton each, or of RULES patterns without a literal.  Those that share
    a tail come in blocks of four times that, with their rules, so that findings,
    which grow with texts times rules, are not shuffled.  Only a rule of several
    patterns is made distinct.  A null text matches nothing; a null pattern is no rule.
    """
    spark = texts.sparkSession

    def looked_into(column):
        found = [shaped(p) or (None, None) for p in column]
        return pd.DataFrame({"needs": [literals(p) for p in column], "head": [h for h, _ in found], "tail": [t for _, t in found]})

    into = F.pandas_udf(looked_into, "needs array<string>, head array<int>, tail string")
    known = rules.where("pattern IS NOT NULL").select("category", "rule", "pattern").distinct()
    known = known.withColumn("__several", F.count(F.lit(1)).over(Window.partitionBy("category", "rule")) > 1)
    told = dealt(known.groupBy("pattern").agg(F.count(F.lit(1)).alias("__names")), "pattern").withColumns({"__rule": F.monotonically_increasing_id(), "__into": into("pattern")})
    told = stored(told.select("pattern", "__rule", "__names", F.col("__into.needs").alias("__needs"), F.col("__into.head").alias("__head"), F.col("__into.tail").alias("__tail")), "rules")
    shapes = F.count_distinct(F.transform("__head", lambda c: c >= 0))
    tails = told.where("__tail IS NOT NULL").groupBy("__tail").agg((F.count(F.lit(1)) >= SHARED * shapes).alias("__shared")).where("__shared")
    named = stored(known.join(merged(told.join(merged(tails), "__tail", "left")), "pattern"), "named")
    rows = texts.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    once, again = [], []  # findings of rules of one pattern, and of several

    # many patterns of one tail: looked up by their heads
    weight = 4 * F.size("__head") + sum(F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in ("category", "rule")) + 24
    for several, found in ((False, once), (True, again)):
        own = named.where(F.col("__shared") & (F.col("__several") == several))
        blocks = math.ceil((own.agg(F.sum(weight)).first()[0] or 0) / (4 * block_bytes))
        part = F.pmod(F.xxhash64("category", "rule"), F.ceil(F.col("__names") / MOST_NAMES))
        for block in range(blocks):
            some = own.where(F.pmod(F.xxhash64("pattern", part), F.lit(blocks)) == block).select("__rule", "__head", "__tail", "category", "rule").toArrow().sort_by("__rule")
            if not len(some):
                continue
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema) as out:
                out.write_table(some)
            data = sink.getvalue().to_pybytes()
            shared = spark.sparkContext.broadcast({"digest": hashlib.sha256(data).hexdigest(), "rules": data})
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(f for f in rows.schema if f.name != "__text"), *named.select("category", "rule").schema])
            found.append(dealt(rows.where("__text IS NOT NULL"), "__row").mapInArrow(_named(shared), schema))

    # those without a literal are asked of every text, RULES of them in one expression
    rest = told.join(merged(named.where("__shared").select("pattern").distinct()), "pattern", "left_anti")
    hits = []
    bare = rest.where("__needs IS NULL").select("__rule", "pattern").toLocalIterator()
    while some := list(itertools.islice(bare, RULES)):
        asked = F.array(*[F.when(F.col("__text").rlike(r.pattern), F.lit(r["__rule"]).cast("long")) for r in some])
        hits.append(rows.select("__id", "__row", F.explode(F.array_compact(asked)).alias("__rule")))
    needing = rest.where("__needs IS NOT NULL")
    weight = F.octet_length("pattern") + 64 + F.aggregate("__needs", F.lit(0), lambda n, x: n + F.octet_length(x) + 64)
    blocks = math.ceil((needing.agg(F.sum(weight)).first()[0] or 0) / block_bytes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    for block in range(blocks):
        own = sorted(tuple(r) for r in needing.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).select("__rule", "pattern", "__needs").collect())
        if not own:
            continue
        digest = hashlib.sha256(repr(own).encode()).hexdigest()
        shared = spark.sparkContext.broadcast({"digest": digest, "patterns": own})
        may = rows.where("__text IS NOT NULL").mapInArrow(_candidates(shared), f"{schema}, __may array<struct<rule: bigint, pattern: string>>")
        tried = may.select("__id", "__row", "__text", F.explode("__may").alias("__one")).where(F.expr("__one.pattern IS NULL OR __text rlike __one.pattern"))
        hit = stored(tried.select("__id", "__row", F.col("__one.rule").alias("__rule")), "findings")
        shared.destroy()
        hits.append(hit)
    if hits:
        names = named.where("__shared IS NULL")
        found = functools.reduce(DataFrame.unionAll, hits).join(merged(names.select("__rule", "category", "rule")), "__rule")
        (again if names.where("__several").head(1) else once).append(found.select("__id", "__row", "category", "rule"))
    out = [*once, *([functools.reduce(DataFrame.unionAll, again).dropDuplicates(["__row", "category", "rule"])] if again else [])]
    if not out:
        return rows.where("false").select(F.col("__id").alias(id_col), F.lit("").alias("category"), F.lit("").alias("rule"))
    return functools.reduce(DataFrame.unionAll, out).select(F.col("__id").alias(id_col), "category", "rule")
