"""Removal of repeated strings by a distributed merge sort of suffixes that are exchanged as front-coded runs.

A string of LENGTH bytes is repeated if it also starts earlier: at a smaller id, or earlier in the same text. The
suffixes that are sorted are sparse. Of each LENGTH bytes, the positions whose GRAM bytes have the least hash are
anchors (winnowing), so equal strings hold equal anchors at equal places. Anchors whose gram occurs once in all texts
cannot lie in a repeated string and take no part. The others' contexts, the suffix from the anchor on and then the
bytes before it in reverse, are sorted in runs, front-coded, sent to the task of their gram, and merged there by a
loser tree that keeps each loser's common prefix with the winner that beat it and compares bytes beyond it only.

The merge's common prefixes then say all: contexts that are equal to an earlier one are repeated as a whole, and of
different contexts with one gram, those strings are equal whose suffixes and reversed prefixes have the same rank at
their depth. A gram with more than MOST_CONTEXTS occurrences would fill its task: its contexts are cut into the single
strings that hold the anchor, each sent to the task of its own hash, where equal strings of a run have become one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 100
GRAM = 50
#: Occurrences of a gram beyond which its contexts are cut into single strings.
MOST_CONTEXTS = 200_000
#: Groups that grams are dealt to at most; below, one for two shards.
MOST_BUCKETS = 16_384
BLOCK = 1 << 18
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    size = max(BLOCK, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        out = []
        for base in (int(_B), pow(int(_B), -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(x))
        if len(_POWERS) > 2:
            _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each position on, as far as there are as many."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[gram:] - sums[: n + 1 - gram]) * down[: n + 1 - gram]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def _running(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each width consecutive values."""
    n, out = 1, x
    while 2 * n <= width:
        out = pick(out[:-n], out[n:]) if len(out) > n else out[:0]
        n *= 2
    rest = width - n
    return pick(out[: len(out) - rest], out[rest:]) if rest and len(out) > rest else (out[:0] if rest else out)


def _remixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of texts that lie one after another in data."""
    wide, found, hashes = length - gram + 1, [], []
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, side="right")) - 1)
        part, ends = data[off[lo] : off[hi]], off[lo + 1 : hi + 1] - off[lo]
        if len(part) >= length:
            h = gram_hashes(part, gram)
            least = _running(h, wide, np.minimum)  # of the string that starts here
            bad = np.zeros(len(part) + 1, np.int32)  # strings that run over a text's end
            begins = np.maximum(ends - length + 1, np.concatenate([[0], ends[:-1]]))
            np.add.at(bad, begins, 1)
            np.add.at(bad, ends, -1)
            least[(np.cumsum(bad)[: len(least)]) > 0] = 0
            pad = np.zeros(wide - 1, np.uint64)
            most = _running(np.concatenate([pad, least, pad]), wide, np.maximum)[: len(h)]
            at = np.flatnonzero(most == h)
            found.append(at + off[lo])
            hashes.append(_remixed(h[at]))  # anchors have low hashes: others deal them out evenly
        lo = hi
    return (np.concatenate(found), np.concatenate(hashes)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash, so that sorted hashes are dealt out in slices."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass
class Run:
    """Sorted contexts, front-coded: lcp bytes in common with the one before, then the others, in rest."""

    lcp: np.ndarray
    rest: bytes
    doc: np.ndarray
    index: np.ndarray
    at: np.ndarray

    def pack(self) -> bytes:
        n = len(self.lcp)
        raw = b"".join((n.to_bytes(8, "little"), self.lcp.astype(np.uint8).tobytes(), self.doc.astype(np.int64).tobytes(), self.index.astype(np.uint32).tobytes(), self.at.astype(np.uint32).tobytes(), self.rest))
        return zstandard.ZstdCompressor(level=3).compress(raw)

    @staticmethod
    def unpack(blob: bytes) -> Run:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        take = lambda lo, size, kind: np.frombuffer(raw, kind, n, lo) if size else None
        return Run(take(8, 1, np.uint8), raw[8 + 17 * n :], take(8 + n, 8, np.int64), take(8 + 9 * n, 4, np.uint32), take(8 + 13 * n, 4, np.uint32))

    def strings(self, width: int) -> list[bytes]:
        out, last, at = [], b"", 0
        rest = self.rest
        for k in self.lcp.tolist():
            to = at + width - k
            last = last[:k] + rest[at:to]
            out.append(last)
            at = to
        return out


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 65_536):
        x = rows[lo : lo + 65_536] != rows[lo - 1 : lo - 1 + len(rows[lo : lo + 65_536])]
        out[lo : lo + 65_536] = np.where(x.any(1), x.argmax(1), rows.shape[1])
    return out


def merge(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """Merges sorted runs of strings of one width with a loser tree: the run of each output, and its common prefix with
    the output before. runs: strings, and each one's common prefix with the one before it in its run.

    lcp[r] is what run r's next string has in common with the last output; of two candidates the one with more is
    smaller, and only with as many are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [iter(zip(s, n, strict=True)) for s, n in runs] + [iter(())] * (k - len(runs))
    text: list[bytes | None] = []
    lcp: list[int] = [0] * k
    for h in heads:
        first = next(h, None)
        text.append(first[0] if first else None)
    loser, source, shared = [0] * k, [], []

    def play(a: int, b: int) -> int:
        """The winner; the other's lcp becomes what it has in common with it."""
        x, y = text[a], text[b]
        if y is None:
            return a
        if x is None:
            return b
        m, n = lcp[a], lcp[b]
        if m > n:
            return a
        if m < n:
            return b
        if m == width or x == y:
            lcp[b] = width
            return a
        d = int.from_bytes(x[m:], "big") ^ int.from_bytes(y[m:], "big")
        t = width - ((d.bit_length() + 7) >> 3)
        if x[t] < y[t]:
            lcp[b] = t
            return a
        lcp[a] = t
        return b

    winner = list(range(k))
    node = k
    best = [0] * k + winner
    while node > 1:
        node -= 1
        a, b = best[2 * node], best[2 * node + 1]
        w = play(a, b)
        best[node] = w
        loser[node] = b if w == a else a
    w = best[1] if k > 1 else 0
    while text[w] is not None:
        source.append(w)
        shared.append(lcp[w])
        following = next(heads[w], None)
        if following is None:
            text[w] = None
        else:
            text[w], lcp[w] = following
        node = (w + k) >> 1
        while node:
            o = loser[node]
            y = text[o]
            if y is not None:
                x = text[w]
                if x is None:
                    loser[node], w = w, o
                else:
                    m, n = lcp[w], lcp[o]
                    if m < n:
                        loser[node], w = w, o
                    elif m == n:
                        if m == width or x == y:
                            lcp[o] = width
                        else:
                            d = int.from_bytes(x[m:], "big") ^ int.from_bytes(y[m:], "big")
                            t = width - ((d.bit_length() + 7) >> 3)
                            if x[t] < y[t]:
                                lcp[o] = t
                            else:
                                lcp[w] = t
                                loser[node], w = w, o
            node >>= 1
    return source, shared


def contexts(s: C.Shard, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each anchor a row: length bytes from it on, length - gram before it in reverse, and how many of either are
    of its text (the others are 0)."""
    left = length - gram
    padded = np.concatenate([np.zeros(left, np.uint8), s.data, np.zeros(length, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, left + length)
    of = np.searchsorted(s.off, at, side="right") - 1
    before, after = np.minimum(left, at - s.off[of]), np.minimum(length, s.off[of + 1] - at)
    rows = np.empty((len(at), length + left + 2), np.uint8)
    for lo in range(0, len(at), 16_384):
        x = view[at[lo : lo + 16_384]]
        rows[lo : lo + 16_384, :length] = x[:, left:]
        rows[lo : lo + 16_384, length : length + left] = x[:, :left][:, ::-1]
    short = np.flatnonzero(after < length)
    rows[short, :length] *= np.arange(length)[None, :] < after[short, None]
    short = np.flatnonzero(before < left)
    rows[short, length:-2] *= np.arange(left)[None, :] < before[short, None]
    rows[:, -2], rows[:, -1] = after, before
    return rows


def pack_hits(hits: np.ndarray) -> bytes:
    """Hits (text, first and last start; three rows) in the order of texts and starts, as small differences, compressed."""
    index, first, last = hits[:, np.lexsort((hits[1], hits[0]))].astype(np.int64)
    return zstandard.compress(np.stack([np.diff(index, prepend=0), np.diff(first, prepend=0), last - first]).astype(np.int32).tobytes(), 3)


def unpack_hits(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(blob), np.int32).reshape(3, -1).astype(np.int64)
    index, first = np.cumsum(steps[0]), np.cumsum(steps[1])
    return np.stack([index, first, first + steps[2]])


def _starts(rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest distance of the anchor from the start of a whole string that holds its gram."""
    return np.maximum(0, length - rows[:, -2].astype(np.int64)), np.minimum(length - gram, rows[:, -1].astype(np.int64))


def single_strings(s: C.Shard, at: np.ndarray, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings that hold an anchor's gram, each once: starts, rows of the same shape, and hashes."""
    lo, hi = _starts(rows, length, gram)
    n = np.maximum(0, hi - lo + 1)
    start = np.unique(np.repeat(at - hi, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    out = contexts(s, start, length, gram) if len(start) else rows[:0].copy()
    out[:, length:-1] = 0
    out[:, -2], out[:, -1] = length, 0
    h = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, length, 4):  # whole words of the string at once
            h = (h ^ out[:, k : k + 4].copy().view(np.uint32)[:, 0].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(28)
    return start, out, h


def _sorted_runs(s: C.Shard, at: np.ndarray, rows: np.ndarray, h: np.ndarray, buckets: int, length: int, gram: int):
    """Runs by bucket, equal contexts as one; and as hits (text, first and last start) the others of them."""
    index = np.searchsorted(s.off, at, side="right") - 1
    doc, pos = s.ids[index], at - s.off[index]
    order = np.lexsort((pos, doc))
    order = order[np.argsort(np.ascontiguousarray(rows[order]).view(f"S{rows.shape[1]}")[:, 0], kind="stable")]
    order = order[np.argsort(bucket_of(h[order], buckets), kind="stable")]
    rows, doc, pos, index, where = rows[order], doc[order], pos[order], index[order], bucket_of(h[order], buckets)
    lcp = common_prefixes(rows)
    lcp[1:][where[1:] != where[:-1]] = 0
    same = lcp == rows.shape[1]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows)))) if len(rows) else np.zeros(0, np.int64)
    later = same & ((doc > doc[first]) | (pos > pos[first]))
    lo, hi = _starts(rows, length, gram)
    ok = later & (hi >= lo)
    hits = np.stack([index[ok], pos[ok] - hi[ok], pos[ok] - lo[ok]]).astype(np.uint32)
    keep = np.flatnonzero(~later)  # what starts at the same id and byte as the first of its equals stays beside it
    lcp = np.where(later, 0, lcp)
    rows, lcp, doc, pos, index, where = rows[keep], lcp[keep], doc[keep], pos[keep], index[keep], where[keep]
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else np.zeros(0, np.int64)
    runs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = rows[a:b]
        rest = part[np.arange(rows.shape[1])[None, :] >= lcp[a:b, None]].tobytes()
        runs.append((int(where[a]), Run(lcp[a:b], rest, doc[a:b], index[a:b], pos[a:b]).pack()))
    return runs, hits


def repeated(runs: list[tuple[int, Run]], length: int, gram: int) -> dict[int, np.ndarray]:
    """Merges one bucket's runs. runs: shard and run. By shard, the hits: text, first and last start."""
    width = 2 * length - gram + 2
    texts = [r.strings(width) for _, r in runs]
    source, shared = merge([(t, r.lcp.tolist()) for t, (_, r) in zip(texts, runs, strict=True)], width)
    source, shared = np.array(source, np.int64), np.array(shared, np.int64)
    base = np.concatenate([[0], np.cumsum([len(r.lcp) for _, r in runs])])
    order = np.empty(len(source), np.int64)  # the k-th output of a run is its k-th string
    by_run = np.argsort(source, kind="stable")
    order[by_run] = np.arange(len(source))
    gather = lambda xs: np.concatenate(xs)[order]
    doc, pos, index = gather([r.doc for _, r in runs]), gather([r.at.astype(np.int64) for _, r in runs]), gather([r.index.astype(np.int64) for _, r in runs])
    shard = np.repeat(np.array([s for s, _ in runs], np.int64), np.diff(base))[order]
    rows = np.frombuffer(b"".join([t for ts in texts for t in ts]), np.uint8).reshape(-1, width)
    lo, hi = _starts(rows[:, -2:], length, gram)
    lo, hi = lo[order], hi[order]
    starts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    # equal contexts: those that are not the earliest of theirs
    kind = np.cumsum(shared < width) - 1
    early = np.lexsort((pos, doc, kind))
    head = early[np.flatnonzero(np.concatenate([[True], kind[early][1:] != kind[early][:-1]]))]
    first = head[kind]
    later = (doc > doc[first]) | (pos > pos[first])
    ok = np.flatnonzero(later & (hi >= lo))
    starts.append((ok, pos[ok] - hi[ok], pos[ok] - lo[ok]))

    # different contexts with one gram
    begin = np.flatnonzero(shared < width)
    depth = shared[begin]
    group = np.cumsum(depth < gram) - 1
    many = np.bincount(group)[group] > 1
    sub = np.flatnonzero(many)
    if len(sub):
        ahead = np.minimum(depth[sub], length)
        ahead[np.concatenate([[True], group[sub][1:] != group[sub][:-1]])] = 0
        left = rows[order[begin[sub]], length:-2]
        by_left = np.argsort(np.ascontiguousarray(left).view(f"S{left.shape[1]}")[:, 0], kind="stable")
        back = common_prefixes(left[by_left])
        behind = np.empty(len(sub), np.int64)
        place = np.full(len(begin), -1)
        place[sub] = np.arange(len(sub))
        own = np.flatnonzero(~later & (place[kind] >= 0))  # the earliest of each context, and what ties with it
        own = own[np.lexsort((pos[own], doc[own]))]
        place = place[kind[own]]
        for o in range(length - gram + 1):
            valid = (lo[own] <= o) & (o <= hi[own])
            if valid.sum() < 2:
                continue
            behind[by_left] = np.cumsum(back < o)
            key = (np.cumsum(ahead < length - o) * (len(sub) + 1) + behind)[place]
            v = np.flatnonzero(valid)
            v = v[np.argsort(key[v], kind="stable")]
            new = np.concatenate([[True], key[v][1:] != key[v][:-1]])
            x, y = own[v], own[v[np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))]]
            hit = x[(doc[x] > doc[y]) | (pos[x] > pos[y])]
            starts.append((hit, pos[hit] - o, pos[hit] - o))
    hit, a, b = (np.concatenate(x) for x in zip(*starts, strict=True))
    found = np.stack([index[hit], a, b]).astype(np.uint32)
    return {int(s): np.ascontiguousarray(found[:, shard[hit] == s]) for s in np.unique(shard[hit])}


def find(shards: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_CONTEXTS) -> DataFrame:
    """shards (of common.pack), each with hits, of pack_hits(): text, first and last start."""
    buckets = max(1, min(MOST_BUCKETS, -(-shards.count() // 2)))
    grams = C.checkpoint(_counted(shards, buckets, length, gram, most))
    hits = _exchange(shards, grams, buckets, length, gram)
    return shards.join(hits.groupBy("shard").agg(F.collect_list("hits").alias("hits")), "shard", "left")


def _counted(shards: DataFrame, buckets: int, length: int, gram: int, most: int) -> DataFrame:
    """shard, keys, hot: the gram hashes of its anchors that occur more than once in all shards; hot says which of them
    occur more than `most` times."""

    def count(batches):
        for row, s in C.packed(batches):
            _, h = anchors(s.data, s.off, length, gram)
            keys, n = np.unique(h, return_counts=True)
            cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            n = np.minimum(n, 65_535).astype(np.uint16)
            own = [b for b in range(buckets) if cut[b + 1] > cut[b]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([row["shard"]] * len(own), pa.int64()), pa.array([keys[cut[b] : cut[b + 1]].tobytes() for b in own], pa.binary()), pa.array([zstandard.compress(n[cut[b] : cut[b + 1]].tobytes(), 1) for b in own], pa.binary())], names=["bucket", "shard", "keys", "n"])

    def twice(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]
        n = [np.frombuffer(zstandard.decompress(x), np.uint16) for x in group.column("n").to_pylist()]
        each, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(n).astype(np.float64))[inverse]
        out, at = [], 0
        for shard, k in zip(group.column("shard").to_pylist(), keys, strict=True):
            t = total[at : at + len(k)]
            at += len(k)
            if (more := t > 1).any():
                out.append((shard, k[more].tobytes(), (t[more] > most).astype(np.uint8).tobytes()))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"shard": pa.array(cols[0], pa.int64()), "keys": pa.array(cols[1], pa.binary()), "hot": pa.array(cols[2], pa.binary())})

    counted = shards.mapInArrow(count, "bucket int, shard long, keys binary, n binary")
    return counted.groupBy("bucket").applyInArrow(twice, "shard long, keys binary, hot binary")


def _exchange(shards: DataFrame, grams: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    own = grams.groupBy("shard").agg(F.collect_list("keys").alias("keys"), F.collect_list("hot").alias("hot"))

    def sort(batches):
        for row, s in C.packed(batches):
            keys, hot = np.frombuffer(b"".join(row["keys"]), np.uint64), np.frombuffer(b"".join(row["hot"]), np.uint8)
            order = np.argsort(keys)
            keys, hot = keys[order], hot[order]
            at, h = anchors(s.data, s.off, length, gram)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[k] == h
            at, h, is_hot = at[known], h[known], hot[k[known]] > 0
            rows = contexts(s, at[~is_hot], length, gram)
            runs, hits = _sorted_runs(s, at[~is_hot], rows, h[~is_hot], buckets, length, gram)
            if is_hot.any():
                hot_at = at[is_hot]
                for lo in range(0, len(hot_at), 2_000):  # their strings are many
                    part = hot_at[lo : lo + 2_000]
                    start, strings, sh = single_strings(s, part, contexts(s, part, length, gram), length, gram)
                    more, more_hits = _sorted_runs(s, start, strings, sh, buckets, length, gram)
                    runs, hits = runs + more, np.concatenate([hits, more_hits], axis=1)
            out = [(b, row["shard"], r, None) for b, r in runs] + [(-1 - row["shard"] % buckets, row["shard"], None, pack_hits(hits) if hits.size else None)] * bool(hits.size)
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["bucket", "shard", "run", "hits"])

    def combine(group: pa.Table) -> pa.Table:
        shard, run, hits = (group.column(c).to_pylist() for c in ("shard", "run", "hits"))
        out = [(s, h) for s, h in zip(shard, hits, strict=True) if h is not None]
        runs = [(s, Run.unpack(r)) for s, r in zip(shard, run, strict=True) if r is not None]
        if runs:
            out += [(s, pack_hits(h)) for s, h in repeated(runs, length, gram).items()]
        cols = list(zip(*out, strict=True)) or [[], []]
        return pa.table({"shard": pa.array(cols[0], pa.int64()), "hits": pa.array(cols[1], pa.binary())})

    runs = shards.join(own, "shard").mapInArrow(sort, "bucket int, shard long, run binary, hits binary")
    return runs.groupBy("bucket").applyInArrow(combine, "shard long, hits binary")


def removed_bytes(s: C.Shard, hits: list[bytes] | None, length: int) -> np.ndarray:
    """Which bytes of the shard are covered by a hit."""
    edge = np.zeros(len(s.data) + 1, np.int32)
    for h in hits or ():
        index, first, last = unpack_hits(h)
        np.add.at(edge, s.off[index] + first, 1)
        np.add.at(edge, s.off[index] + last + length, -1)
    return np.cumsum(edge[:-1], dtype=np.int32, out=edge[:-1]) > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST_CONTEXTS, pass_on: tuple[str, ...] = (), keep_text: bool = True) -> DataFrame:
    """Removes each byte that a repeated string of `length` bytes covers: id_col, pass_on, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and, with keep_text, the kept text, less what removal left of split characters.

    A null text is empty (and stays null as kept text). Ids order the texts, null first; what starts at the same id
    and the same byte, as in repeated rows, is neither earlier nor later, so such rows do not remove each other. Texts
    of fewer than `length` bytes stay whole. An empty table gives an empty one.
    """
    shards = C.pack(docs, id_col, text_col, pass_on)
    found = find(shards, length, gram, most)
    kinds = [f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(pass_on)]

    def run(batches):
        for row, s in C.packed(batches):
            gone = removed_bytes(s, row["hits"], length)
            begins = np.zeros(len(gone), bool)
            begins[s.off[:-1][np.diff(s.off) > 0]] = True
            spans = gone & (begins | ~np.concatenate([[False], gone[:-1]]))
            each = [gone[a:z] for a, z in zip(s.off[:-1], s.off[1:], strict=True)]
            n_spans = [int(np.count_nonzero(spans[a:z])) for a, z in zip(s.off[:-1], s.off[1:], strict=True)]
            kept = [s.data[a:z][~g].tobytes() for a, z, g in zip(s.off[:-1], s.off[1:], each, strict=True)]
            cols = [C.id_column(s.ids), *C.rest_of(row["rest"]), pa.array(np.diff(s.off)), pa.array([int(np.count_nonzero(g)) for g in each], pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            if keep_text:
                cols.append(pa.array([None if null else x.decode("utf-8", "ignore") for x, null in zip(kept, s.null, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", *(f"c{k}" for k in range(len(pass_on))), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * keep_text])

    schema = ", ".join(["id long", *kinds, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["text string"] * keep_text])
    return found.mapInArrow(run, schema).toDF(id_col, *pass_on, "n_bytes", "n_removed", "n_spans", "kept_sha256", *[text_col] * keep_text)
