"""Language-model scores by a probabilistic suffix tree over bytes, and by add-one counts of words.

The tree's contexts have up to DEPTH bytes. Every context of the training texts is tested, however rare: it is retained
if what follows it diverges from what follows its longest retained suffix by GAIN nats (Kullback-Leibler) or more,
EVIDENCE over all its places. So the tree grows with the corpus. Next-symbol distributions are smoothed toward the
suffix's, down to add-half counts at the root, so that every byte has a probability after every context. Scoring takes
the longest retained suffix of the text so far.

Counts come from all training texts. A shard sends its different strings of DEPTH + 1 symbols, with their training
counts, to the group of the end of their context, where all of every longer context meets; the group grows its part of
the tree and answers each shard with its strings' probabilities. That end has two symbols, or, where those are hot, as
many more as it takes to be no hot context: one of 1 / HOT of all positions or more. So no group depends on one pair of
symbols. What follows hot contexts, of which each length has HOT at most, and contexts of one symbol is summed up and
sent to every group; no task ever holds the tree. Which contexts are hot is estimated from a part of each shard: that
decides where strings go and not what comes out. Words' counts go back to the shard that asked for them in the same way.

build() and score() are the same tree as one machine's automaton.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH = 6
GAIN = 0.002
EVIDENCE = 20.0
PULL = 20.0
END, PAD, BITS = 256, 257, 9
PIECE = 256
#: Bytes of text in a shard at least, since texts of one shard share its strings, and those counted at once.
SHARD_BYTES, COUNT_BYTES = 8 << 20, 1 << 20
#: Different strings that a group gathers before it adds them up.
MOST_GRAMS = 1_500_000
MOST_BUCKETS = 16_384
#: Hot contexts of one length at most; and symbols of a shard by which they are estimated.
HOT, HINT = 1024, 1 << 18
HELD_OUT = (7, 2)
FOLD = np.arange(256, dtype=np.uint16)
FOLD[65:91] += 32


def held_out(ids: np.ndarray) -> np.ndarray:
    """Whether crc32 of the id as text, modulo 7, is 2; a null id counts as an empty text."""
    return np.array([zlib.crc32(b"" if i == C.NULL_ID else str(i).encode()) % HELD_OUT[0] == HELD_OUT[1] for i in ids.tolist()], bool)


def symbols(s: C.Shard, pick: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The picked texts one after another, each as depth times PAD, its bytes and END; and where each begins."""
    n = np.diff(s.off)[pick]
    off = np.concatenate([[0], np.cumsum(n + depth + 1)])
    out = np.full(off[-1], PAD, np.uint16)
    for k, i in enumerate(pick):
        at = off[k] + depth
        out[at : at + n[k]] = FOLD[s.data[s.off[i] : s.off[i + 1]]]
        out[at + n[k]] = END
    return out, off


def gram_counts(s: C.Shard, train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each different string of depth symbols and the next one, as a number of BITS a symbol, and how often it occurs."""
    x, _ = symbols(s, train, depth)
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(len(x) - depth, np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(BITS)) | x[k : len(x) - depth + k].astype(np.uint64)
    return np.unique(code[x[depth:] != PAD], return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    each, inverse = np.unique(codes, return_inverse=True)
    return each, np.bincount(inverse, n.astype(np.float64), minlength=len(each)).astype(np.int64)


@dataclass
class Model:
    """The automaton. of_symbol: the column of each symbol; lp, go: log10 probability and next state by state * columns
    + column, the last column being that of no symbol; start: the state at a text's begin."""

    of_symbol: np.ndarray
    columns: int
    lp: np.ndarray
    go: np.ndarray
    start: int
    depth: int
    states: int


def build(counts: list[tuple[np.ndarray, np.ndarray]], gain: float = GAIN, pull: float = PULL, evidence: float = EVIDENCE) -> Model:
    """The tree and its automaton. counts: by length d of context, numbers of d + 1 symbols and how often each occurs,
    for the candidate contexts; of d = 0 all."""
    depth = len(counts) - 1
    next0, n0 = counts[0]
    seen = np.unique(next0.astype(np.int64))
    seen = seen[seen != PAD]
    others = 257 - len(seen)
    of_symbol = np.full(258, len(seen), np.int64)  # bytes never seen share a column
    of_symbol[seen] = np.arange(len(seen))
    a = len(seen) + 1
    root = np.zeros(a)
    root[of_symbol[next0.astype(np.int64)]] += n0
    root = (root + 0.5 * np.append(np.ones(len(seen)), max(others, 1))) / (n0.sum() + 0.5 * (len(seen) + max(others, 1)))
    root = root.astype(np.float32)
    kept_code, kept_dist = [np.zeros(1, np.uint64)], [root[None, :]]
    for d in range(1, depth + 1):
        code, n = counts[d]
        ctx, inverse = np.unique(code >> np.uint64(BITS), return_inverse=True)
        c = np.zeros((len(ctx), a), np.float32)
        if len(ctx):
            np.add.at(c, (inverse, of_symbol[(code & np.uint64(511)).astype(np.int64)]), n)
        parent = np.tile(root, (len(ctx), 1))
        for e in range(1, d):  # the longest retained suffix
            suffix = ctx & np.uint64((1 << (BITS * e)) - 1)
            k = np.minimum(np.searchsorted(kept_code[e], suffix), max(len(kept_code[e]) - 1, 0))
            if len(kept_code[e]):
                hit = kept_code[e][k] == suffix
                parent[hit] = kept_dist[e][k[hit]]
        p = (c + pull * parent) / (c.sum(1, keepdims=True) + pull)
        apart = (p * np.log(p / parent)).sum(1)
        keep = (apart >= gain) & (apart * c.sum(1) >= evidence)
        kept_code.append(ctx[keep])
        kept_dist.append(p[keep])
    code, dist = [kept_code[0]], [kept_dist[0]]
    wanted: list[set[int]] = [set(x.tolist()) for x in kept_code]
    for d in range(depth, 1, -1):  # the prefixes of states are states, with their longest retained suffix's distribution
        wanted[d - 1] |= {x >> BITS for x in wanted[d]}
    for d in range(1, depth + 1):
        ctx = np.array(sorted(wanted[d]), np.uint64)
        p = np.tile(root, (len(ctx), 1))
        for e in range(1, d + 1):
            suffix = ctx & np.uint64((1 << (BITS * e)) - 1)
            if len(kept_code[e]) and len(ctx):
                k = np.minimum(np.searchsorted(kept_code[e], suffix), len(kept_code[e]) - 1)
                hit = kept_code[e][k] == suffix
                p[hit] = kept_dist[e][k[hit]]
        code.append(ctx)
        dist.append(p)
    base = np.concatenate([[0], np.cumsum([len(x) for x in code])])
    states, columns = int(base[-1]), a + 2  # and columns for PAD and for no symbol
    lp = np.zeros((states, columns), np.float32)
    lp[:, :a] = np.log10(np.concatenate(dist))
    lp[:, len(seen)] -= np.log10(max(others, 1))
    go = np.zeros((states, columns), np.int32)

    def state_of(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.int32)
        for e in range(1, depth + 1):
            if len(code[e]):
                suffix = x & np.uint64((1 << (BITS * e)) - 1)
                k = np.minimum(np.searchsorted(code[e], suffix), len(code[e]) - 1)
                out = np.where((code[e][k] == suffix) & (length >= e), (base[e] + k).astype(np.int32), out)
        return out

    of = np.append(np.append(seen, 511), PAD)  # 511 is no symbol: what follows a byte never seen
    for d in range(depth + 1):
        for j, sym in enumerate(of):
            go[base[d] : base[d + 1], j] = state_of(code[d] << np.uint64(BITS) | np.uint64(sym), np.full(len(code[d]), d + 1))
    of_symbol[PAD] = a
    pads = sum(PAD << (BITS * k) for k in range(depth))
    start = int(state_of(np.array([pads], np.uint64), np.array([depth]))[0])
    return Model(of_symbol, columns, lp.ravel(), go.ravel(), start, depth, states)


def score(model: Model, s: C.Shard) -> np.ndarray:
    """log10 of each text's probability, END included."""
    d = model.depth
    x, off = symbols(s, np.arange(len(s)), d)
    x = model.of_symbol[x].astype(np.int32)
    n = np.diff(off) - d  # bytes and END
    pieces = -(-n // PIECE)
    of = np.repeat(np.arange(len(s)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, size = off[of] + k * PIECE, np.minimum(PIECE, n[of] - k * PIECE)
    out = np.zeros(len(s))
    padded = np.concatenate([x, np.full(PIECE, model.columns - 1, np.int32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, PIECE + d)
    for lo in range(0, len(of), 8192):
        part = view[begin[lo : lo + 8192]]
        part[np.arange(PIECE + d)[None, :] >= size[lo : lo + 8192, None] + d] = model.columns - 1
        part = np.ascontiguousarray(part.T)
        state, total = np.zeros(part.shape[1], np.int32), np.zeros(part.shape[1])
        for t in range(PIECE + d):
            at = state * model.columns + part[t]
            if t >= d:  # before, the state only takes in what stands ahead of the piece
                total += model.lp[at]
            state = model.go[at]
        np.add.at(out, of[lo : lo + 8192], total)
    return out


def _tokens(s: C.Shard) -> list[list[bytes]]:
    return [s.text(i).lower().split() for i in range(len(s))]


def _by_bucket(tokens: list[bytes], buckets: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for t in sorted(tokens):
        out.setdefault(zlib.crc32(t) % buckets, []).append(t)
    return out


def _word_counts(shards: DataFrame, buckets: int) -> DataFrame:
    """shard, bucket, n (training counts of the shard's words of that bucket, in order), and of the bucket, on one of
    its rows: total and different."""

    def count(batches):
        for row, s in C.packed(batches):
            held, train, others = held_out(s.ids), {}, set()
            for tokens, out in zip(_tokens(s), held.tolist(), strict=True):
                if out:
                    others.update(tokens)
                else:
                    for t in tokens:
                        train[t] = train.get(t, 0) + 1
            own = _by_bucket(list(others.union(train)), buckets)
            get = train.get
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([row["shard"]] * len(own), pa.int64()), pa.array([zstandard.compress(b"\n".join(ts), 1) for ts in own.values()], pa.binary()), pa.array([zstandard.compress(np.array([get(t, 0) for t in ts], np.uint32).tobytes(), 1) for ts in own.values()], pa.binary())], names=["bucket", "shard", "words", "n"])

    def answer(group: pa.Table) -> pa.Table:
        words = [zstandard.decompress(x).split(b"\n") for x in group.column("words").to_pylist()]
        counts = [np.frombuffer(zstandard.decompress(x), np.uint32).tolist() for x in group.column("n").to_pylist()]
        total: dict[bytes, int] = {}
        for ts, ns in zip(words, counts, strict=True):
            for t, n in zip(ts, ns, strict=True):
                total[t] = total.get(t, 0) + n
        sums = [sum(total.values())] + [0] * (len(words) - 1)
        different = [sum(1 for n in total.values() if n)] + [0] * (len(words) - 1)
        back = [zstandard.compress(np.fromiter(map(total.__getitem__, ts), np.int64, len(ts)).tobytes(), 1) for ts in words]
        return pa.table({"shard": group.column("shard"), "bucket": group.column("bucket"), "n": pa.array(back, pa.binary()), "total": pa.array(sums, pa.int64()), "different": pa.array(different, pa.int64())})

    sent = shards.mapInArrow(count, "bucket int, shard long, words binary, n binary")
    return C.checkpoint(sent.groupBy("bucket").applyInArrow(answer, "shard long, bucket int, n binary, total long, different long"))


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers as bytes, all first ones first."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unsqueezed(b: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(wide, -1).T).view(kind).ravel()


def _codes(x: np.ndarray, depth: int) -> np.ndarray:
    """The string of depth + 1 symbols that ends at each byte or END of symbols()."""
    if len(x) <= depth:
        return np.zeros(0, np.uint64)
    wide, code, long = x.astype(np.uint64), np.zeros(len(x), np.uint64), 0  # code: strings of `long` symbols by their first
    for bit in f"{depth + 1:b}":
        if long:  # twice as long
            code = code[:-long] << np.uint64(BITS * long) | code[long:]
            long *= 2
        if bit == "1":  # and one more
            code = code[:-1] << np.uint64(BITS) | wide[long : long + len(code) - 1] if long else wide
            long += 1
    return code[x[depth:] != PAD]


def _pieces(s: C.Shard) -> list[np.ndarray]:
    """The texts' numbers, in pieces of about COUNT_BYTES."""
    out, lo = [], 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(s.off, s.off[lo] + COUNT_BYTES, side="right")) - 1)
        out.append(np.arange(lo, hi))
        lo = hi
    return out


def shard_counts(s: C.Shard, train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each different string of depth + 1 symbols in the shard's texts, and how often it occurs in those of train."""
    parts = []
    for pick in _pieces(s):
        for own, count in ((pick[train[pick]], 1), (pick[~train[pick]], 0)):
            code, n = np.unique(_codes(symbols(s, own, depth)[0], depth), return_counts=True)
            parts.append((code, n * count))
    return _merged(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _retained(g: np.ndarray, m: np.ndarray, parent: np.ndarray, gain: float, pull: float, evidence: float) -> np.ndarray:
    """The probability of each string's last symbol after its context, if that is retained, or else parent. g: strings in
    order, with all that occur in training; m: their training counts; parent: the probabilities after the longest retained suffix."""
    if not len(g):
        return parent
    change = np.concatenate([[True], g[1:] >> np.uint64(BITS) != g[:-1] >> np.uint64(BITS)])
    begin, of = np.flatnonzero(change), np.cumsum(change) - 1
    total = np.add.reduceat(m, begin).astype(np.float64)
    p = (m + pull * parent) / (total[of] + pull)
    apart = np.add.reduceat(np.where(m > 0, p * np.log(p / parent), 0.0), begin)
    rest = np.maximum(0.0, 1 - np.add.reduceat(np.where(m > 0, parent, 0.0), begin))  # of symbols that never follow
    shrunk = pull / (total + pull)
    apart += rest * shrunk * np.log(shrunk)
    keep = (apart >= gain) & (apart * total >= evidence)
    return np.where(keep[of], p, parent)


def first_level(code: np.ndarray, n: np.ndarray, gain: float = GAIN, pull: float = PULL, evidence: float = EVIDENCE) -> np.ndarray:
    """By context symbol and next symbol, the probability after the longest retained suffix of one symbol at most. code,
    n: strings of two symbols and their training counts."""
    last = np.bincount((code & np.uint64(511)).astype(np.int64), n, minlength=512)
    seen = int(np.count_nonzero(last))
    root = (last + 0.5) / (last.sum() + 0.5 * (seen + max(257 - seen, 1)))
    m = np.zeros((512, 512))
    m[(code >> np.uint64(BITS)).astype(np.int64), (code & np.uint64(511)).astype(np.int64)] = n
    g = np.arange(512 * 512, dtype=np.uint64)
    return _retained(g, m.ravel(), np.tile(root, 512), gain, pull, evidence).reshape(512, 512)


def _end(code: np.ndarray, symbols_: int) -> np.ndarray:
    """The last symbols of strings."""
    return code & np.uint64((1 << (BITS * symbols_)) - 1)


class Known:
    """A few numbers, each in a slot of its own of a table, so that membership of many is one look into it."""

    SLOTS = 18

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.append(known, np.uint64(0))
        factors = np.random.default_rng(len(known)).integers(1, 1 << 63, 10_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for self.factor in factors:
            slot = self.slot(known)
            if len(np.unique(slot)) == len(known):
                break
        self.at = np.full(1 << self.SLOTS, len(known), np.int16)
        self.at[slot] = np.arange(len(known))

    def slot(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (x * self.factor) >> np.uint64(64 - self.SLOTS)

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = self.at[self.slot(x)]
        return (self.known[at] == x) & (at < len(self.known) - 1)


@dataclass
class Ends:
    """How strings are dealt out. hot: by length from 2, the hot contexts; follow: by the same length, what
    follows them, as strings of one symbol more, ascending, with probabilities; first: of first_level()."""

    hot: list[Known]
    first: np.ndarray | None = None
    follow: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def lengths(self, code: np.ndarray) -> np.ndarray:
        """By how many last symbols of its context each string is dealt: the fewest, from 2 on, that are not hot."""
        context = code >> np.uint64(BITS)
        out, rest = np.full(len(code), 2, np.int8), np.arange(len(code))
        for d, hot in enumerate(self.hot, 2):
            held = hot.holds(_end(context, d))
            rest, context = rest[held], context[held]
            out[rest] = d + 1
        return out

    def dealt(self, code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of strings by bucket, where each bucket begins, and lengths()."""
        by = self.lengths(code)
        end = (code >> np.uint64(BITS)) & ((np.uint64(1) << (by.astype(np.uint64) * np.uint64(BITS))) - np.uint64(1))
        bucket = _bucket(end * np.uint64(8) + by.astype(np.uint64), buckets)
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))]), by

    def followed(self, counts: list[tuple[np.ndarray, np.ndarray]], gain: float, pull: float = PULL, evidence: float = EVIDENCE) -> Ends:
        """With first and follow, from the summed counts of strings of two symbols and of those of hot contexts."""
        out = Ends(self.hot, first_level(*counts[0], gain, pull, evidence))
        for d, (code, n) in enumerate(counts[1:], 2):
            out.follow.append((code, _retained(code, n, out.before(code, d), gain, pull, evidence)))
        return out

    def before(self, code: np.ndarray, by: int) -> np.ndarray:
        """The probability of each string's last symbol by the contexts of fewer than `by` symbols."""
        if by == 2:
            return self.first[((code >> np.uint64(BITS)) & np.uint64(511)).astype(np.int64), (code & np.uint64(511)).astype(np.int64)]
        known, p = self.follow[by - 3]
        return p[np.searchsorted(known, _end(code, by))]


def probabilities(code: np.ndarray, n: np.ndarray, ends: Ends, depth: int, gain: float = GAIN, pull: float = PULL, evidence: float = EVIDENCE) -> np.ndarray:
    """The probability of the last symbol of each string of depth + 1, by the tree. code: different strings, with all that
    are dealt by the same ends; n: training counts, which may be 0."""
    by = ends.lengths(code)
    out = np.empty(len(code))
    for d in np.unique(by):
        out[by == d] = ends.before(code[by == d], int(d))
    for d in range(2, depth + 1):
        own = np.flatnonzero(by <= d)
        g, at, inverse = np.unique(_end(code[own], d + 1), return_index=True, return_inverse=True)
        m = np.bincount(inverse, n[own].astype(np.float64), minlength=len(g))
        out[own] = _retained(g, m, out[own][at], gain, pull, evidence)[inverse]
    return out


def hint(s: C.Shard, turn: int, depth: int, hot: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length of context from 2 to depth - 1, those that may be hot in a part of the shard's texts, and how often they
    occur there. The last entry has the number of positions."""
    order = np.roll(np.arange(len(s)), -(turn % max(len(s), 1)))
    upto = int(np.searchsorted(np.cumsum(np.diff(s.off)[order]), HINT)) + 1
    code = _codes(symbols(s, order[:upto], depth)[0], depth)[:HINT] >> np.uint64(BITS)
    out, rest = [], code
    for d in range(2, depth):
        c, n = np.unique(_end(rest, d), return_counts=True)
        many = n * (2 * hot) >= len(code)
        out.append((c[many], n[many]))
        rest = rest[np.isin(_end(rest, d), c[many])]
    return [*out, (np.zeros(1, np.uint64), np.array([len(code)]))]


def _hot_contexts(shards: DataFrame, depth: int, hot: int) -> list[Known]:
    def run(batches):
        for row, s in C.packed(batches):
            for d, (c, n) in enumerate(hint(s, row["shard"], depth, hot), 2):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), d, np.int32)), pa.array(c.view(np.int64)), pa.array(n.astype(np.int64))], names=["d", "c", "n"])

    counted = shards.mapInArrow(run, "d int, c long, n long").groupBy("d", "c").agg(F.sum("n").alias("n"))
    positions = counted.where(F.col("d") == depth).select(F.col("n").alias("all"))
    got = counted.where(F.col("d") < depth).join(F.broadcast(positions)).where(F.col("n") * hot >= F.col("all")).select("d", "c").toArrow()  # `hot` of a length at most
    d, c = got.column("d").to_numpy(), got.column("c").to_numpy().astype(np.uint64)
    return [Known(np.sort(c[d == k])) for k in range(2, depth)]


def _gram_answers(shards: DataFrame, ends: Ends, buckets: int, depth: int, gain: float) -> DataFrame:
    """shard, bucket, lp: log10 probabilities of the shard's different strings of that bucket, in order."""

    def count(batches):
        for row, s in C.packed(batches):
            code, n = shard_counts(s, ~held_out(s.ids), depth)
            order, cut, by = ends.dealt(code, buckets)
            own = []
            for d in range(1, depth):  # what follows contexts of one symbol, and hot ones of d
                x, m = (code, n) if d == 1 else (code[by > d], n[by > d])
                each, inverse = np.unique(_end(x, d + 1), return_inverse=True)
                if len(each):
                    own.append((-d, each, np.bincount(inverse, m.astype(np.float64), minlength=len(each)).astype(np.int64)))
            own += [(b, code[order[cut[b] : cut[b + 1]]], n[order[cut[b] : cut[b + 1]]]) for b in range(buckets) if cut[b + 1] > cut[b]]
            packs = [pa.array([_squeezed(np.diff(c, prepend=np.uint64(0))) for _, c, _ in own], pa.binary()), pa.array([_squeezed(k.astype(np.uint32)) for _, _, k in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in own], pa.int32()), pa.array([row["shard"]] * len(own), pa.int64()), *packs], names=["bucket", "shard", "code", "n"])

    def opened(code: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(_unsqueezed(code, np.uint64), dtype=np.uint64), _unsqueezed(n, np.uint32).astype(np.int64)

    def summed(batches):
        for b in batches:
            for d, code, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "code", "n")), strict=True):
                c, k = opened(code, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), -d, np.int32)), pa.array(c.view(np.int64)), pa.array(k)], names=["d", "code", "n"])

    sent = C.checkpoint(shards.mapInArrow(count, "bucket int, shard long, code binary, n binary"))
    got = sent.where("bucket < 0").select("bucket", "code", "n").mapInArrow(summed, "d int, code long, n long").groupBy("d", "code").agg(F.sum("n").alias("n")).orderBy("d", "code").toArrow()  # 512 next symbols of each context at most
    d, code, n = got.column("d").to_numpy(), got.column("code").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    known = shards.sparkSession.sparkContext.broadcast(ends.followed([(code[d == k], n[d == k]) for k in range(1, depth)], gain))

    def answer(group: pa.Table) -> pa.Table:
        columns = [group.column(c) for c in ("code", "n")]
        parts, fresh = [], 0
        for k in range(group.num_rows):
            parts.append(opened(*(c[k].as_py() for c in columns)))
            fresh += len(parts[-1][0])
            if fresh > max(MOST_GRAMS, len(parts[0][0])):
                parts, fresh = [_merged(parts)], 0
        code, n = _merged(parts)
        lp = np.log10(probabilities(code, n, known.value, depth, gain)).astype(np.float32)
        back = [_squeezed(lp[np.searchsorted(code, opened(*(c[k].as_py() for c in columns))[0])]) for k in range(group.num_rows)]
        return pa.table({"shard": group.column("shard"), "bucket": group.column("bucket"), "lp": pa.array(back, pa.binary())})

    return sent.where("bucket >= 0").groupBy("bucket").applyInArrow(answer, "shard long, bucket int, lp binary")


def _summed(s: C.Shard, answers: dict[int, bytes], ends: Ends, buckets: int, depth: int) -> np.ndarray:
    """log10 of each text's probability, END included. answers: by bucket those to the shard's strings."""
    held = [(pick, *np.unique(_codes(symbols(s, pick, depth)[0], depth), return_inverse=True)) for pick in _pieces(s)]
    held = [(pick, own, at.astype(np.int32)) for pick, own, at in held]
    code = np.unique(np.concatenate([own for _, own, _ in held]), return_counts=True)[0] if held else np.zeros(0, np.uint64)  # with counts it sorts, which is quicker
    order, cut, _ = ends.dealt(code, buckets)
    lp = np.zeros(len(code), np.float32)
    for b in range(buckets):
        if cut[b + 1] > cut[b]:
            lp[order[cut[b] : cut[b + 1]]] = _unsqueezed(answers[b], np.float32)
    out = np.zeros(len(s))
    for pick, own, at in held:
        each = lp[np.searchsorted(code, own)][at].astype(np.float64)
        n = np.diff(s.off)[pick] + 1
        out[pick] = np.add.reduceat(each, np.cumsum(n) - n)
    return out


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gain: float = GAIN, hot: int = HOT) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    Texts are lower-cased (A-Z). Words are what white space (bytes 9 to 13 and 32) sets apart, then one end, which counts
    as a word. base_score is the sum of log10((c + 1) / (N + V + 1)) over them, with counts of the training texts: those
    whose crc32 of the id, modulo 7, is not 2. score is the log10 probability of the text's bytes and its end under the
    suffix tree of those texts. A null text is empty: one end. Rows keep their number, whether ids repeat or are null; an
    empty table gives an empty one; other columns are left out.
    """
    shards = C.pack(docs, id_col, text_col, least=SHARD_BYTES)
    buckets = max(1, min(MOST_BUCKETS, -(-shards.count() // 2)))
    fit = docs.where(C.remainder(F.col(id_col), HELD_OUT[0]) != HELD_OUT[1]).agg(F.count("*").alias("n")).first()
    train_texts = fit["n"]
    ends = Ends(_hot_contexts(shards, depth, hot))
    grams = _gram_answers(shards, ends, buckets, depth, gain)
    words = _word_counts(shards, buckets)
    sums = words.agg(F.sum("total"), F.sum("different")).first()
    total, different = (sums[0] or 0) + train_texts, (sums[1] or 0) + (train_texts > 0)
    down = math.log10(total + different + 1)

    def run(batches):
        schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        for row, s in C.packed(batches):
            tokens = _tokens(s)
            own = _by_bucket(list(set().union(*tokens)), buckets)
            known = {a["bucket"]: np.frombuffer(zstandard.decompress(a["n"]), np.int64) for a in row["answers"] or ()}
            place = {t: k for k, t in enumerate(t for ts in own.values() for t in ts)}
            c = np.concatenate([known[b] for b in own]) if own else np.zeros(0, np.int64)
            log, some = np.log10(c + 1.0), c > 0
            end = math.log10(train_texts + 1.0)
            rows = []
            for ts in tokens:
                k = np.fromiter(map(place.__getitem__, ts), np.int64, len(ts))
                rows.append((len(ts) + 1, int(np.count_nonzero(some[k])) + (train_texts > 0), float(log[k].sum()) + end - (len(ts) + 1) * down))
            n, m, base = zip(*rows, strict=True)
            del tokens, place, rows
            yield C.batch(schema, C.id_column(s.ids), held_out(s.ids), n, m, [total] * len(s), base, _summed(s, {a["bucket"]: a["lp"] for a in row["grams"] or ()}, ends, buckets, depth))

    asked = shards.join(words.groupBy("shard").agg(F.collect_list(F.struct("bucket", "n")).alias("answers")), "shard", "left")
    asked = asked.join(grams.groupBy("shard").agg(F.collect_list(F.struct("bucket", "lp")).alias("grams")), "shard", "left")
    return asked.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)

