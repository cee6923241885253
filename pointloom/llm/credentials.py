"""Secrets in texts: fixed patterns, and formats learnt from what those find.

Values that the patterns find are labelled credentials. For each kind a prefix tree of a bounded sample of its distinct
values is turned into a probabilistic automaton: states whose next symbols and ends are alike within Hoeffding's bound,
and whose successors are too, are merged. Another automaton is learnt in the same way from ordinary runs of the same
characters. Every run of at least LEAST characters that no pattern covers is then scored: the log-likelihood of its
format under a kind's automaton against that under the ordinary one, for each character. What is as likely as the
kind's own values is a span of its own, `like_` and the kind.

Odd rows: a null text is an empty one and has no spans; texts are read whole; repeated rows are texts of their own, and
equal values count once in learning; other columns, of whatever name, are not read. Without labelled values nothing is
learnt and only the patterns find spans. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: The kinds of the patterns, in the order of spans that begin together, and the patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: What every match of ASSIGN has, in lower case.
HINTS = (b"passw", b"secret", b"token", b"api")

#: Characters of a run that is scored, at least.
LEAST = 16
#: Distinct values of a kind, and ordinary runs, that are learnt from at most: those with the least hash, and none of
#: more characters than LONGEST.
SAMPLE, LONGEST = 2000, 512
#: Error allowed to a test of two states, and how much likelier a character must be than in ordinary runs (nats).
ALPHA, MARGIN = 0.05, 0.25
#: Share of a kind's own values that may score below its threshold.
MISSED = 0.05

SYMBOLS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
END = len(SYMBOLS)
_CODE = np.full(256, -1, np.int16)
_CODE[list(SYMBOLS)] = np.arange(len(SYMBOLS))
_VALUE, _HEX = _CODE >= 0, np.isin(np.arange(256), list(b"0123456789abcdef"))


@dataclass
class State:
    """A state of a prefix tree: how many strings come to it and how many of them end in it."""

    n: int = 0
    ends: int = 0
    next: dict[int, State] = field(default_factory=dict)
    uses: dict[int, int] = field(default_factory=dict)


def prefix_tree(strings: Iterable[bytes]) -> State:
    root = State()
    for s in strings:
        at = root
        at.n += 1
        for c in _CODE[np.frombuffer(s, np.uint8)].tolist():
            at.uses[c] = at.uses.get(c, 0) + 1
            at = at.next.setdefault(c, State())
            at.n += 1
        at.ends += 1
    return root


def _alike(a: State, b: State, alpha: float) -> bool:
    """Whether two states, and those that follow them by the same symbols, may have the same distribution."""
    width = math.sqrt(0.5 * math.log(2 / alpha))
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        bound = width * (1 / math.sqrt(a.n) + 1 / math.sqrt(b.n))
        if bound >= 1:
            continue
        if abs(a.ends / a.n - b.ends / b.n) >= bound:
            return False
        for c in a.uses.keys() | b.uses.keys():
            if abs(a.uses.get(c, 0) / a.n - b.uses.get(c, 0) / b.n) >= bound:
                return False
            if c in a.next and c in b.next:
                todo.append((a.next[c], b.next[c]))
    return True


def _fold(into: State, tree: State) -> None:
    """Adds the strings of a tree to a state and to those that follow it."""
    todo = [(into, tree)]
    while todo:
        a, b = todo.pop()
        a.n += b.n
        a.ends += b.ends
        for c, k in b.uses.items():
            a.uses[c] = a.uses.get(c, 0) + k
            if c in a.next:
                todo.append((a.next[c], b.next[c]))
            else:
                a.next[c] = b.next[c]


def merged(root: State, alpha: float = ALPHA) -> list[State]:
    """The states that are left when each new state, the most visited first, is merged into the first that is alike."""
    kept, k = [root], 0
    fringe = [(-s.n, k := k + 1, root, c) for c, s in sorted(root.next.items())]
    heapq.heapify(fringe)
    known = {id(root)}
    while fringe:
        _, _, parent, c = heapq.heappop(fringe)
        state = parent.next[c]
        if id(state) in known:
            continue
        alike = next((s for s in kept if _alike(s, state, alpha)), None)
        if alike is None:
            kept.append(state)
            known.add(id(state))
            grown = [state]
        else:
            parent.next[c] = alike
            _fold(alike, state)
            grown = kept  # states that the fold hung below any that is kept
        for s in grown:
            for d, t in s.next.items():
                if id(t) not in known:
                    heapq.heappush(fringe, (-t.n, k := k + 1, s, d))
    return kept


@dataclass(frozen=True)
class Automaton:
    """Log probabilities of symbols and of the end in each state, and the state that follows; -1 where a symbol was not
    seen, after which reading goes on in the first state."""

    logp: list[list[float]]
    next: list[list[int]]

    def score(self, text: bytes) -> float:
        """Log probability of a whole run."""
        at, total, logp, follow = 0, 0.0, self.logp, self.next
        for c in _CODE[np.frombuffer(text, np.uint8)].tolist():
            total += logp[at][c]
            at = max(follow[at][c], 0)
        return total + logp[at][END]


def infer(strings: Iterable[bytes], alpha: float = ALPHA, smooth: float = 0.05) -> Automaton:
    """The automaton of some strings; `smooth` is added to the count of every symbol and of the end."""
    states = merged(prefix_tree(strings), alpha)
    number = {id(s): k for k, s in enumerate(states)}
    logp, follow = [], []
    for s in states:
        whole = s.n + smooth * (END + 1)
        logp.append([math.log((s.uses.get(c, 0) + smooth) / whole) if whole else -math.log(END + 1) for c in range(END)] + [math.log((s.ends + smooth) / whole) if whole else -math.log(END + 1)])
        follow.append([number[id(s.next[c])] if c in s.next else -1 for c in range(END)])
    return Automaton(logp, follow)


def half(value: bytes) -> int:
    return xxhash.xxh64_intdigest(value) & 1


@dataclass(frozen=True)
class Model:
    """Automata and thresholds by kind, and two ordinary automata, each of the runs of one half of the hashes: a run is
    held against the one that it is no part of, since a secret may be among the ordinary runs."""

    kinds: dict[str, tuple[Automaton, float]]
    ordinary: tuple[Automaton, Automaton]

    def plain(self, run: bytes) -> float:
        return self.ordinary[1 - half(run)].score(run)

    def best(self, run: bytes) -> tuple[str, float] | None:
        """The kind that a run is likest to, if it is like any."""
        plain = self.plain(run)
        scored = [((a.score(run) - plain) / (len(run) + 1), kind, least) for kind, (a, least) in self.kinds.items()]
        passed = [(s, kind) for s, kind, least in scored if s >= least]
        if not passed:
            return None
        s, kind = max(passed)
        return kind, s


def _runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of at least `least` bytes; a run ends where its text does."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = np.unique(off[1:-1])
    inner = inner[(inner > 0) & (inner < len(mask))]
    inner = inner[mask[inner] & mask[inner - 1]]
    if len(inner):
        begins, ends = np.sort(np.append(begins, inner)), np.sort(np.append(ends, inner))
    long = ends - begins >= least
    return begins[long], ends[long]


def spans_of(off: np.ndarray, data: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]], list[tuple[int, int, bytes]]]]:
    """Each text that has any: its number, the spans of the patterns (start, kind, end, value) and the other runs
    (start, end, value). Places are bytes of the text."""
    whole = data.tobytes()
    lower = whole.lower()
    found: dict[int, list] = {}
    for i in range(len(off) - 1):
        lo, hi = int(off[i]), int(off[i + 1])
        if any(lower.find(h, lo, hi) >= 0 for h in HINTS):
            for m in ASSIGN.finditer(whole[lo:hi]):
                if len(m.group(2)) >= ASSIGN_LEAST:
                    found.setdefault(i, []).append((m.start(), 0, m.end(), m.group(2)))
        if whole.find(b"AKIA", lo, hi) >= 0:
            for m in ACCESS.finditer(whole[lo:hi]):
                if m.end() - m.start() >= ACCESS_LEAST:
                    found.setdefault(i, []).append((m.start(), 1, m.end(), m.group()))
    begins, ends = _runs(_HEX[data], off, HEX_LEAST)
    for i, lo, hi in zip((np.searchsorted(off, begins, side="right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
        found.setdefault(i, []).append((lo - int(off[i]), 2, hi - int(off[i]), whole[lo:hi]))
    others: dict[int, list] = {}
    begins, ends = _runs(_VALUE[data], off, least)
    for i, lo, hi in zip((np.searchsorted(off, begins, side="right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
        a, z = lo - int(off[i]), hi - int(off[i])
        if not any(s < z and a < e for s, _, e, _ in found.get(i, ())):
            others.setdefault(i, []).append((a, z, whole[lo:hi]))
    for i in sorted(found.keys() | others.keys()):
        yield i, sorted(found.get(i, [])), others.get(i, [])


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> Model | None:
    """The automata of the labelled values of all texts, from a sample bounded by `sample` and `longest`; None if the
    patterns find nothing. Only the sample comes to the driver."""

    def run(batches):
        least: dict[str, dict[bytes, int]] = {}

        def cut():
            for kind, values in least.items():
                if len(values) > 2 * sample:
                    least[kind] = dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:sample])

        for b in batches:
            off, data = C.buffers(b.column(0))
            for _, base, others in spans_of(off, data):
                for kind, value in [*((KINDS[k], v) for _, k, _, v in base), *(("ordinary", v) for *_, v in others)]:
                    if len(value) <= longest:
                        least.setdefault(kind, {})[value] = xxhash.xxh64_intdigest(value) >> 1
            cut()
        for kind, values in least.items():
            rows = sorted(values.items(), key=lambda x: (x[1], x[0]))[:sample]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), pa.array([v for v, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.int64())], names=["kind", "value", "hash"])

    values = C.spread(docs.select(F.col(text).cast("string").alias("text"))).mapInArrow(run, "kind string, value binary, hash long").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("hash", "value"))
    rows = values.withColumn("nth", nth).where(F.col("nth") <= sample).orderBy("kind", "nth").toArrow()
    strings: dict[str, list[bytes]] = {}
    for kind, value in zip(rows.column("kind").to_pylist(), rows.column("value").to_pylist(), strict=True):
        strings.setdefault(kind, []).append(value)
    ordinary = strings.pop("ordinary", [])
    if not strings:
        return None
    model = Model({}, tuple(infer([v for v in ordinary if half(v) == k]) for k in range(2)))
    for kind in KINDS:
        if own := strings.get(kind):
            # the threshold is of values that the automaton has not seen: each half is scored by the other's
            halves = [(own[::2] or own, own[1::2] or own), (own[1::2] or own, own[::2] or own)]
            ratios = sorted((a.score(v) - model.plain(v)) / (len(v) + 1) for learnt, other in halves for a in (infer(learnt),) for v in other)
            model.kinds[kind] = (infer(own), max(MARGIN, ratios[int(MISSED * len(ratios))]))
    return model


SPANS = "array<struct<kind string, start long, end long, score double>>"


def scan(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, score) of each text, by start and then by kind, the patterns' first. Places
    are code points, the end exclusive; score is of learnt spans, by character, null for the patterns'."""
    order = [*KINDS, *(f"like_{k}" for k in KINDS)]
    schema = f"doc_id long, spans {SPANS}"

    def run(batches):
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for b in batches:
            off, data = C.buffers(b.column(1))
            out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
            for i, base, others in spans_of(off, data):
                rows = [(s, k, e, None) for s, k, e, _ in base]
                if model is not None:
                    rows += [(s, order.index(f"like_{hit[0]}"), e, hit[1]) for s, e, v in others if (hit := model.best(v))]
                at = np.concatenate([[0], np.cumsum((data[off[i] : off[i + 1]] & 0xC0) != 0x80)]) if rows else None
                out[i] = [{"kind": order[k], "start": int(at[s]), "end": int(at[e]), "score": score} for s, k, e, score in sorted(rows, key=lambda r: r[:3])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    read = C.spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return read.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
