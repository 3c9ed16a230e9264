"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with CRF transitions for other forms of it.

Two LSTMs read a window's characters, one from each side; their states give
every character a score for each tag (outside, begin and inside of each kind),
and a CRF's transitions tie neighbouring tags together.  All of it is learned
in numpy from labelled spans, by Adam on the CRF's log likelihood.

A text is read in windows of WIDTH characters that overlap by half.  A span
must hold a digit or an @, so only windows that hold one are decoded; every
window of the text that does is.  Each window's best tags give spans; a span
that touches an edge of its window is left to the neighbour that has it whole.
Over the whole text, spans of all windows are then reconciled: those that
overlap a pattern's match, end inside a run of letters or digits, or fail
their kind's arithmetic go, and of the rest the set without overlaps and with
the greatest sum of probabilities above one half stays.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Most training texts, and most windows of each.
SAMPLE, SEGMENTS = 400, 3
WIDTH, STEP = 96, 48
HIDDEN, TAGS = 16, 1 + 2 * len(KINDS)
EPOCHS, BATCH, RATE = 8, 32, 0.02
SEED = 11
#: Windows decoded at once.
GROUP = 2048
#: Symbols: 0 pads, ASCII stands for itself, then other letters and all else.
LETTER, ELSE, SYMBOLS = 128, 129, 130
_FAR = -1e4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HINT = re.compile(r"[0-9@]")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = (ord(c) - 48) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The arithmetic of a kind: parts of an address, a card's length and check digit, a number's length."""
    if kind == "email":
        return True
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    n = len(digits := _digits(text))
    return 12 <= n <= 19 and _luhn(digits) if kind == "card" else 9 <= n <= 15


def shaped(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind's pattern, by kind, before their arithmetic.

    Written so that no text makes a pattern look at the same characters again
    and again: an e-mail address is built around its @, an ip address cut from
    a run of numbers and dots.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts = [p.span() for p in re.finditer("[0-9]+", m[0])]
        out += [("ip", m.start() + parts[i][0], m.start() + parts[i + 3][1]) for i in range(0, len(parts) - 3, 4)]
    out += [("card", *m.span()) for m in _CARD.finditer(text)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text)]
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern matches whose arithmetic holds, by start and kind."""
    if not _HINT.search(text):
        return []
    found = [s for s in shaped(text) if valid(s[0], text[s[1] : s[2]])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(codes, ELSE).astype(np.uint8)
    for i in np.flatnonzero(codes >= 128):
        out[i] = LETTER if text[i].isalpha() else ELSE
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """The network.  Its arrays: input tables and recurrent weights of both directions, output layer, transitions and first tags."""

    def __init__(self):
        draw = np.random.default_rng(SEED)
        h = HIDDEN
        make = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        self.inputs = [make(SYMBOLS, 4 * h, scale=0.3) for _ in range(2)]
        self.inner = [make(h, 4 * h, scale=h**-0.5) for _ in range(2)]
        for table in self.inputs:
            table[:, h : 2 * h] += 1
        self.out = make(2 * h, TAGS, scale=(2 * h) ** -0.5)
        self.level = np.zeros(TAGS, np.float32)
        self.moves = np.zeros((TAGS, TAGS), np.float32)
        self.first = np.zeros(TAGS, np.float32)
        # an inside follows its own begin or inside only
        self.barred = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            self.barred[:, 2 + 2 * k] = _FAR
            self.barred[1 + 2 * k : 3 + 2 * k, 2 + 2 * k] = 0

    @property
    def parts(self):
        return [*self.inputs, *self.inner, self.out, self.level, self.moves, self.first]

    def _states(self, symbols: np.ndarray, way: int, keep: bool):
        """Hidden states along axis 1, and with keep what going back needs."""
        if way:
            symbols = symbols[:, ::-1]
        n, length = symbols.shape
        h = HIDDEN
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        states, kept = np.empty((n, length, h), np.float32), []
        table, inner = self.inputs[way], self.inner[way]
        for t in range(length):
            gates = table[symbols[:, t]] + state @ inner
            gates[:, : 3 * h] = _sigmoid(gates[:, : 3 * h])
            gates[:, 3 * h :] = np.tanh(gates[:, 3 * h :])
            before = cell
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * gates[:, 3 * h :]
            bent = np.tanh(cell)
            if keep:
                kept.append((gates, before, bent, state))
            state = gates[:, 2 * h : 3 * h] * bent
            states[:, t] = state
        return (states[:, ::-1] if way else states), kept

    def _back(self, symbols, way, kept, d_states, d_input, d_inner):
        """Adds the gradients of one direction."""
        if way:
            symbols, d_states = symbols[:, ::-1], d_states[:, ::-1]
        h = HIDDEN
        d_state, d_cell = np.zeros_like(d_states[:, 0]), np.zeros_like(d_states[:, 0])
        all_d = np.empty((symbols.shape[1], len(symbols), 4 * h), np.float32)
        for t in range(symbols.shape[1] - 1, -1, -1):
            gates, before, bent, state = kept[t]
            d_state = d_state + d_states[:, t]
            i, f, o, g = (gates[:, k * h : (k + 1) * h] for k in range(4))
            d_cell = d_cell + d_state * o * (1 - bent * bent)
            d = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_state * bent * o * (1 - o), d_cell * i * (1 - g * g)], axis=1)
            all_d[t] = d
            d_inner += state.T @ d
            d_state, d_cell = d @ self.inner[way].T, d_cell * f
        seen = symbols.T.ravel()
        order = np.argsort(seen, kind="stable")
        which, heads = np.unique(seen[order], return_index=True)
        d_input[which] += np.add.reduceat(all_d.reshape(-1, 4 * h)[order], heads, axis=0)

    def scores(self, symbols: np.ndarray, keep: bool = False):
        """Scores of tags for every character of the windows."""
        sides = [self._states(symbols, way, keep) for way in range(2)]
        both = np.concatenate([s for s, _ in sides], axis=2)
        return both @ self.out + self.level, both, [k for _, k in sides]

    def _sums(self, scores: np.ndarray):
        """Log sums of all ways to and from each tag, and of all ways."""
        moves = self.moves + self.barred
        to, back = np.empty_like(scores), np.zeros_like(scores)
        to[:, 0] = self.first + scores[:, 0]
        for t in range(1, scores.shape[1]):
            x = to[:, t - 1, :, None] + moves
            top = x.max(axis=1)
            to[:, t] = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + scores[:, t]
        for t in range(scores.shape[1] - 2, -1, -1):
            x = moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :]
            top = x.max(axis=2)
            back[:, t] = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
        last = to[:, -1]
        top = last.max(axis=1)
        return to, back, top + np.log(np.exp(last - top[:, None]).sum(axis=1))

    def fit(self, windows: np.ndarray, tags: np.ndarray) -> "Tagger":
        draw = np.random.default_rng(SEED)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parts]
        step, total = 0, EPOCHS * -(-len(windows) // BATCH)
        for _ in range(EPOCHS):
            order = draw.permutation(len(windows))
            for begin in range(0, len(order), BATCH):
                rows = order[begin : begin + BATCH]
                symbols, gold = windows[rows], tags[rows]
                n, length = symbols.shape
                scores, both, kept = self.scores(symbols, True)
                to, back, whole = self._sums(scores)
                shares = np.exp(to + back - whole[:, None, None])
                d_scores = shares.copy()
                np.subtract.at(d_scores, (np.arange(n)[:, None], np.arange(length)[None], gold), 1)
                d_scores /= n
                moves = self.moves + self.barred
                pairs = np.exp(to[:, :-1, :, None] + moves + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None])
                d_moves = pairs.sum(axis=(0, 1))
                np.subtract.at(d_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
                d_first = shares[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=TAGS)
                grads = [np.zeros_like(p) for p in (*self.inputs, *self.inner)]
                d_both = d_scores @ self.out.T
                for way in range(2):
                    self._back(symbols, way, kept[way], d_both[:, :, way * HIDDEN : (way + 1) * HIDDEN], grads[way], grads[2 + way])
                grads += [np.einsum("nth,ntk->hk", both, d_scores), d_scores.sum(axis=(0, 1)), d_moves / n, d_first / n]
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                rate, step = RATE * (1 - step / total) + RATE / 50, step + 1
                for p, g, (m, v) in zip(self.parts, grads, moments):
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def spans(self, symbols: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Of each window, spans of its best tags: kind, start, end, and the sum of its characters' probabilities above one half."""
        scores, _, _ = self.scores(symbols)
        to, back, whole = self._sums(scores)
        n, length, _ = scores.shape
        moves = self.moves + self.barred
        best, came = self.first + scores[:, 0], []
        for t in range(1, length):
            x = best[:, :, None] + moves
            came.append(x.argmax(axis=1))
            best = x.max(axis=1) + scores[:, t]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = came[t - 1][np.arange(n), tags[:, t]]
        sure = np.exp(np.take_along_axis(to + back, tags[:, :, None], 2)[:, :, 0] - whole[:, None]) - 0.5
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(n)]
        for w in np.flatnonzero(tags.any(axis=1)):
            t = 0
            while t < length:
                if not (tag := int(tags[w, t])):
                    t += 1
                    continue
                kind, end = (tag - 1) // 2, t + 1
                while end < length and tags[w, end] == 2 + 2 * kind:
                    end += 1
                out[w].append((kind, t, end, float(sure[w, t:end].sum())))
                t = end
        return out


def _places(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @."""
    last = max(0, -(-(len(text) - WIDTH) // STEP)) * STEP
    found = set()
    for m in _HINT.finditer(text):
        at = m.start() // STEP * STEP
        found.update(p for p in (at - STEP, at) if 0 <= p <= last)
        if at > last:
            found.add(last)
    return sorted(found)


def _window(codes: np.ndarray, at: int) -> np.ndarray:
    part = codes[at : at + WIDTH]
    return np.concatenate([part, np.zeros(WIDTH - len(part), np.uint8)])


def forms(text: str, spans: list[tuple[str, int, int]], draw: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans in forms that no pattern has: space around an @, a number without its +, dots or slashes in a card."""
    out, moved, last, shift = [], [], 0, 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start < last:
            continue
        own = text[start:end]
        if kind == "email":
            new = own.replace("@", [" @ ", " @", "@ "][draw.integers(3)])
        elif kind == "phone":
            new = own[1:] if draw.integers(2) else own[1:].split(" ", 1)[-1]
        elif kind == "card":
            digits, gap = _digits(own), "./_"[draw.integers(3)]
            new = gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            new = own.replace(".", [" . ", ". "][draw.integers(2)])
        out += [text[last:start], new]
        moved.append((kind, start + shift, start + shift + len(new)))
        last, shift = end, shift + len(new) - len(own)
    return "".join([*out, text[last:]]), moved


def _tagged(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Windows of a text and their tags; where spans overlap the first one counts."""
    tags = np.zeros(len(text), np.uint8)
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if not tags[start:end].any():
            tags[start:end] = 2 + 2 * KINDS.index(kind)
            tags[start] -= 1
    codes = symbols_of(text)
    places = _places(text)
    return [_window(codes, p) for p in places], [_window(tags, p) for p in places]


def _training(batches):
    """Windows and tags of each text with labelled spans, as they are and in other forms, SEGMENTS evenly spaced ones of either."""
    for batch in batches:
        c = batch.to_pydict()
        ids, windows, tags = [], [], []
        for i, text, spans in zip(c["id"], c["text"], c["spans"]):
            text, spans = text or "", [(s["kind"], s["start"], s["end"]) for s in spans or []]
            draw = np.random.default_rng([SEED, len(text)])
            for own in ((text, spans), forms(text, spans, draw)):
                x, y = _tagged(*own)
                some = sorted({round(k * (len(x) - 1) / max(1, SEGMENTS - 1)) for k in range(SEGMENTS)}) if x else []
                windows += [x[k].tobytes() for k in some]
                tags += [y[k].tobytes() for k in some]
                ids += [i] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(windows, pa.binary()), pa.array(tags, pa.binary())], names=["id", "window", "tags"])


def shapes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans to learn from: id and spans, the patterns' matches (card and number by length, not by check digit), of texts with a digit or an @.

    A network cannot learn check digits, so it learns shapes, and the arithmetic is done on what it finds.
    """

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                some = [s for s in shaped(text) if s[0] in ("email", "ip") or (12 <= len(_digits(text[s[1] : s[2]])) <= 19 if s[0] == "card" else valid(s[0], text[s[1] : s[2]]))]
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in some])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["id", "spans"])

    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def trained(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """A network fitted to the `sample` texts with labelled spans whose ids hash least; spans has id and spans (kind, start, end).

    Rows without an id are not learned from; without any text to learn from there is no network (None).
    """
    known = spans.where(F.col("id").isNotNull())
    picked = known.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id", "left_semi")
    rows = texts.join(known.join(F.broadcast(picked), "id", "left_semi"), "id").select("id", "text", "spans")
    got = rows.mapInArrow(_training, "id long, window binary, tags binary").collect()
    if not got:
        return None
    got = sorted({(r.id, bytes(r.window), bytes(r.tags)) for r in got})
    as_array = lambda k: np.frombuffer(b"".join(r[k] for r in got), np.uint8).reshape(len(got), WIDTH)
    return Tagger().fit(as_array(1), as_array(2).astype(np.int64))


def reconciled(text: str, found: list[tuple[int, int, int, float]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the spans of all windows, those that are added to `base`: no overlaps, and the greatest sum of scores."""
    best: dict[tuple[int, int, int], float] = {}
    for kind, start, end, score in found:
        own = text[start:end]
        if own != own.strip() or score <= 0 or not _HINT.search(own):
            continue
        if (start and text[start - 1].isalnum() and own[0].isalnum()) or (end < len(text) and text[end].isalnum() and own[-1].isalnum()):
            continue
        if not valid(KINDS[kind], own) or kind == 0 and not _EMAIL.fullmatch(re.sub(r"\s*@\s*", "@", own)):
            continue
        best[kind, start, end] = max(score, best.get((kind, start, end), 0))
    starts = sorted(s for _, s, _ in base)
    ends = sorted(e for _, _, e in base)
    free = [(e, s, k, score) for (k, s, e), score in best.items() if bisect.bisect_left(starts, e) == bisect.bisect_right(ends, s)]
    free.sort()
    # the usual walk over spans by their ends: with the best set of what ends before it, or without it
    total, taken = [0.0], [None]
    for i, (_, s, _, score) in enumerate(free):
        before = bisect.bisect_right(free, s, 0, i, key=lambda x: x[0])
        with_it = total[before] + score
        total.append(max(total[i], with_it))
        taken.append(before if with_it > total[i] else None)
    out, i = [], len(free)
    while i:
        if taken[i] is None:
            i -= 1
        else:
            e, s, k, _ = free[i - 1]
            out.append((KINDS[k], s, e))
            i = taken[i]
    return out


def found_in(texts: list[str], network: Tagger | None) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text by start and kind, and whether a pattern has them."""
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    if network is not None:
        where = [(i, p) for i, t in enumerate(texts) if _HINT.search(t) for p in _places(t)]
        codes: dict[int, np.ndarray] = {}
        for begin in range(0, len(where), GROUP):
            some = where[begin : begin + GROUP]
            codes = {i: codes[i] if i in codes else symbols_of(texts[i]) for i in {i for i, _ in some}}
            for (i, p), spans in zip(some, network.spans(np.stack([_window(codes[i], p) for i, p in some]))):
                size = len(texts[i])
                found[i] += [(k, p + s, min(p + e, size), score) for k, s, e, score in spans if (s or not p) and (e < WIDTH or p + e >= size) and p + s < size]
    out = []
    for text, own, more in zip(texts, base, found):
        spans = [(*s, True) for s in own] + [(*s, False) for s in (reconciled(text, more, own) if more else [])]
        out.append(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def personal_spans(docs: DataFrame, network: Tagger | None, text_col: str = "text") -> DataFrame:
    """docs with `spans`: kind, start, end (in characters, the end not included) and base, by start and kind.

    base says that a pattern has the span; these are never dropped.  Null and
    empty texts have none, rows stay as they are, equal texts get equal spans,
    a column named spans is replaced, an empty table stays empty.  Without a
    network there are the patterns' spans only.  Added spans are at most
    WIDTH - STEP characters long.
    """
    names = [f for f in docs.schema if f.name != "spans"]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in some] for some in found_in(texts, network)]
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, _SPANS)], names=[*(f.name for f in names), "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    return docs.select(*[F.col(f"`{f.name}`") for f in names]).mapInArrow(run, f"{fields}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span as [KIND]; of overlapping ones the first."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def put(acc, s):
        cut = F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(cut.alias("done"), s["end"].alias("at"))).otherwise(acc)

    return F.aggregate(spans, start, put, lambda acc: F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int"))))


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_spans(docs, trained(docs, shapes(docs)))
    base = F.filter("spans", lambda s: s["base"])
    name = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(name(base), 256).alias("base_sha256"), name("spans").alias("spans"))
