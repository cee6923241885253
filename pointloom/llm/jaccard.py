"""N-gram Jaccard join of texts: a MinHash LSH forest finds candidates, exact verification decides.

A text's set has the hashes of its SHINGLE consecutive words; texts of one set are one class, of which one takes part.
Each class has a signature of DEPTH values for each of TREES trees. A tree is the sorted order of its signatures, of
which every run with the same first values is a node of a prefix trie. Within a node, rows that are NEAR alike by their
whole signatures are candidates; the runs of DEPTH equal values come first, then those of one value fewer, and so on.

The matched prefix is shortened as the data ask for it. Candidates of the longest prefix are verified exactly. Each link
found has a similarity s, and a prefix of d values finds such a one with probability p = 1 - (1 - s^d)^TREES, so that
the links are estimated as the sum of 1 / p. While those found are less than RECALL of that, the prefix is shortened
to the length at which they would be, what the forest adds is verified, and so on, down to the prefix that finds a pair
at the threshold itself with that probability (prefix_for). Where no link was found, nothing is estimated and that floor
is next.

A node with more rows than a task takes (NODE_ROWS) is one component as it is, and its children are looked into by
themselves. Components of candidates are verified in one task, or in tiles of a bounded size by one task for each pair
of tiles. Tasks return counts of links and the edges of a spanning forest, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected
from .suffix import _powers

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 5
#: Share of the links that must be found; also the least probability with which the floor finds a pair at the threshold.
RECALL = 0.999999
#: Share of equal signature values that makes rows of a node candidates. At a similarity of 0.8 it stands seven standard
#: deviations of its estimate on the safe side.
NEAR = 0.5
#: Classes of one trie node, and classes and shingles of one tile, that a task takes at once.
NODE_ROWS, TILE_ROWS, TILE_SHINGLES = 4096, 1000, 1_500_000
#: Parts that a component's nodes are dealt out by where they meet its row.
SALTS = 16
#: Bytes of sets that go to the JVM at once.
SEND_BYTES = 4 << 20
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[65:91] = WORD_BYTE[128:] = 1
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_MIX = np.random.default_rng(20).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def found(s, depth: int, trees: int = TREES):
    """The probability that a pair of similarity s shares a prefix of depth values in some tree."""
    return 1 - (1 - s**depth) ** trees


def prefix_for(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from depth down, that a pair at the threshold shares in some tree with probability recall."""
    return next((d for d in range(depth, 1, -1) if found(threshold, d, trees) >= recall), 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another, and where each text's words begin among them."""
    n = len(data)
    word = np.zeros(n + 2, np.int8)
    word[1:-1] = WORD_BYTE[data]
    begin = np.flatnonzero((word[1:-1] == 1) & (word[:-2] == 0))
    end = np.flatnonzero((word[1:-1] == 1) & (word[2:] == 0)) + 1
    cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    cuts = np.unique(cuts[(word[cuts] == 1) & (word[cuts + 1] == 1)]) if len(cuts) else cuts  # words that run over a text's end
    begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((FOLD[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, off)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE, block: int = 1 << 18) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; texts of fewer words have one shingle of all, or none without."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block, side="right")) - 1)
        h, at = word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        with np.errstate(over="ignore"):
            n = max(0, len(h) - size + 1)
            s = np.zeros(n, np.uint64)
            for k in range(size):
                s = s * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
            s = _mixed(s)
            for i in range(hi - lo):
                a, z = int(at[i]), int(at[i + 1])
                if z - a >= size:
                    yield np.unique(s[a : z - size + 1])
                elif z > a:
                    one = np.uint64(z - a)
                    for x in h[a:z]:
                        one = one * np.uint64(0x9FB21C651E98DF25) + x
                    yield _mixed(np.array([one], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
        lo = hi


def signature(s: np.ndarray) -> np.ndarray:
    """The least of the set's values under each of the TREES * DEPTH multiplications."""
    with np.errstate(over="ignore"):
        out = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(s), 512):
            np.minimum(out, (s[lo : lo + 512, None] * _MIX[None, :]).min(0), out=out)
        return out


def _sketches(shards: DataFrame, size: int) -> DataFrame:
    """A row for each text: rid, shard, index, doc_id, n_set, digest of its set, and the signature in 16 bits a value,
    tree by tree."""
    schema = pa.schema([("rid", pa.int64()), ("shard", pa.int64()), ("index", pa.int32()), ("doc_id", pa.int64()), ("n_set", pa.int32()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 36
        for row, s in C.packed(batches):
            n, digest, sigs = [], [], []
            for x in shingle_sets(s.data, s.off, size):
                n.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sigs.append((_mixed(signature(x)) >> np.uint64(48)).astype(">u2").tobytes() if len(x) else None)
            ids = np.arange(rid, rid + len(s))
            rid += len(s)
            yield C.batch(schema, ids, [row["shard"]] * len(s), np.arange(len(s), dtype=np.int32), C.id_column(s.ids), n, digest, sigs)

    return C.checkpoint(shards.mapInArrow(run, "rid long, shard long, index int, doc_id long, n_set int, digest binary, sig binary"))


class _Union:
    """Components of rows 0 to n - 1, and the edges that joined them."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int, int]] = []

    def add(self, row: int, others: np.ndarray, mark: int) -> None:
        """row and others become one component, by one edge for each component that they had."""
        own = self.label[row]
        others = others[self.label[others] != own]
        if len(others):
            labels, first = np.unique(self.label[others], return_index=True)
            self.edges += [(row, int(k), mark) for k in others[first]]
            self.label[np.isin(self.label, labels)] = own


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a sorted stream, several at once where they are small."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        change = np.zeros(t.num_rows, bool)
        for k in key:
            x = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield t.slice(0, int(cuts[-1]))
            held = t.slice(int(cuts[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _node(path: np.ndarray, sig: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Edges (row, row, depth) that connect the candidates of one node whose rows are sorted by path, (n, DEPTH): first
    within the runs of DEPTH equal values, then within those of fewer, down to least."""
    n, depth = path.shape
    same = np.cumprod(path[1:] == path[:-1], axis=1).sum(1)  # the prefix that a row shares with the one before
    union = _Union(n)
    for d in range(depth, least - 1, -1):
        cuts = np.concatenate([[0], np.flatnonzero(same < d) + 1, [n]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            label = union.label[lo:hi]
            if hi - lo < 2 or (label == label[0]).all():
                continue
            for row in range(lo, hi - 1):
                others = row + 1 + np.flatnonzero(union.label[row + 1 : hi] != union.label[row])
                near = others[(sig[others] == sig[row]).mean(1) >= NEAR]
                if len(near):
                    union.add(row, near, d)
                    if (label == label[0]).all():
                        break
    return union.edges


def _path(tree, length: int):
    return F.substring(F.col("sig"), tree * (2 * DEPTH) + 1, F.lit(2 * length))


def _candidates(classes: DataFrame, floor: int, node_rows: int) -> DataFrame:
    """Edges a, b, depth: those of a depth or more connect all candidates that share such a prefix in some tree.
    classes: node, sig."""
    each = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: _path(t, DEPTH))).alias("tree", "path"))
    taken, whole = [], []
    for d in range(floor, DEPTH + 1):
        each = each.withColumn("key", F.substring("path", 1, 2 * d))
        counted = C.checkpoint(each.groupBy("tree", "key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
        inside = each.join(counted, ["tree", "key"])
        taken.append(inside.where(F.col("n") <= node_rows).select("node", "tree", "path", F.lit(d).alias("d"), "key"))
        large = inside.where(F.col("n") > node_rows)
        whole.append(large.select(F.col("least").alias("a"), F.col("node").alias("b"), F.lit(d).alias("depth")))
        if counted.where(F.col("n") > node_rows).isEmpty():
            whole.pop()
            break
        each = large.select("node", "tree", "path")
    rows = reduce(DataFrame.union, taken).join(classes.select("node", "sig"), "node")
    order = ["tree", "d", "key"]

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32())])
        for t in _groups(batches, order):
            node, tree, d, key = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("node", *order[:2], "key"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
            path = np.frombuffer(b"".join(t.column("path").to_pylist()), np.uint16).reshape(len(node), -1)
            change = (tree[1:] != tree[:-1]) | (d[1:] != d[:-1]) | (key[1:] != key[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(node)]])
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]  # most nodes
            two = two[(sig[two] == sig[two + 1]).mean(1) >= NEAR]
            out = [np.stack([two, two + 1, np.cumprod(path[two] == path[two + 1], axis=1).sum(1)])]
            for lo, hi in zip(cuts[:-1][size > 2], cuts[1:][size > 2], strict=True):
                if edges := _node(path[lo:hi], sig[lo:hi], int(d[lo])):
                    out.append(np.array(edges).T + np.array([[lo], [lo], [0]]))
            a, b, depth = np.concatenate(out, axis=1)
            yield C.batch(schema, node[a], node[b], depth.astype(np.int32))

    inside = rows.repartition(*order).sortWithinPartitions(*order, "path", "node").mapInArrow(run, "a long, b long, depth int")
    edges = reduce(DataFrame.union, [inside, *whole])
    return C.checkpoint(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth")))


def _sized(nodes: DataFrame, tile_rows: int, tile_shingles: int) -> DataFrame:
    """Of each component its root, n classes, w shingles and bands, a map from each band to its number of tiles. A set's
    band follows from its size, so that a component has no more bands than the logarithm of its largest set's."""
    tiles = F.greatest(F.ceil(F.count("*") * 2 / tile_rows), F.ceil(F.sum("n_set") * 2 / tile_shingles)).cast("int")
    bands = nodes.groupBy("root", "band").agg(F.count("*").alias("n"), F.sum("n_set").alias("w"), tiles.alias("tiles"))
    return C.checkpoint(bands.groupBy("root").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.map_from_entries(F.collect_list(F.struct("band", "tiles"))).alias("bands")))


def _dealt(nodes: DataFrame, sized: DataFrame, tile_rows: int, tile_shingles: int) -> DataFrame:
    """The nodes (node, root, band, n_set, ...) of the components in sized, with n, g and side: the groups in which each
    is compared, as one of all (0) or as one of either side (1, 2). A small component is one group. In a larger one only
    neighbouring bands can reach the threshold, and each band is cut into tiles; each pair of tiles of a band or of
    neighbours is a group."""
    columns = [*nodes.columns, "n"]
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # one component may have most nodes
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(sized.select("*", salt), ["root", "salt"])
    fits = (F.col("n") <= tile_rows) & (F.col("w") <= tile_shingles)
    small = nodes.where(fits).select(*columns, F.concat_ws(":", F.col("root")).alias("g"), F.lit(0).alias("side"))
    large = nodes.where(~fits).withColumn("tiles", F.col("bands")[F.col("band")])
    large = large.withColumn("tile", F.pmod(F.xxhash64("node", F.lit("tile")), "tiles").cast("int"))
    name = lambda b1, t1, b2, t2: F.concat_ws(":", F.col("root"), b1, t1, b2, t2)
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    b, t = F.col("band"), F.col("tile")
    same = F.transform(upto(F.col("tiles")), lambda o: F.struct(name(b, F.least(t, o), b, F.greatest(t, o)).alias("g"), F.when(t == o, 0).when(t < o, 1).otherwise(2).alias("side")))
    up = F.transform(upto(F.col("bands")[b + 1]), lambda o: F.struct(name(b, t, b + 1, o).alias("g"), F.lit(1).alias("side")))
    down = F.transform(upto(F.col("bands")[b - 1]), lambda o: F.struct(name(b - 1, o, b, t).alias("g"), F.lit(2).alias("side")))
    large = large.withColumn("x", F.explode(F.concat(same, up, down))).select(*columns, "x.g", "x.side")
    return small.unionByName(large)


def verify(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that reach the threshold: their lesser indices, in order, their larger ones and their similarities.
    Where side is 0, of all pairs; where it is 1 and 2, of those across."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size.astype(np.int64))
    common = count[ids] > 1
    ids, row = ids[common], row[common]
    new = np.cumsum(count > 1) - 1
    ids, width = new[ids], int((count > 1).sum())
    inter = np.zeros((m, m), np.float32)
    slab = max(256, min(8192, 4_000_000 // m))
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    for lo in range(0, width, slab):
        a, z = np.searchsorted(ids, [lo, lo + slab])
        x = np.zeros((m, min(slab, width - lo)), np.float32)
        x[row[a:z], ids[a:z] - lo] = 1
        inter += x @ x.T
    union = size[:, None] + size[None, :] - inter
    linked = np.triu(inter >= threshold * union - 1e-9, 1)
    if side.any():
        linked &= side[:, None] != side[None, :]
    i, j = np.nonzero(linked)
    return i, j, inter[i, j] / union[i, j]


def _verified(shards: DataFrame, dealt: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of each component (root, n): node and links, its other classes and their copies that reach the threshold; node
    and other, the least node that links connect it with in its group; and pairs with expected, the number of links and, for each length of a
    prefix, how many there should be where that length finds as many."""
    wanted = dealt.groupBy("shard").agg(F.collect_list(F.struct("index", "root", "n", "node", "mult", "g", "side")).alias("wanted"))
    given = ("g", "side", "root", "n", "node", "mult")

    def sets(batches):
        schema = pa.schema([("g", pa.string()), ("side", pa.int32()), *((c, pa.int64()) for c in given[2:]), ("x", pa.binary())])
        for row, s in C.packed(batches):
            of: dict[int, list] = {}
            for w in row["wanted"]:
                of.setdefault(w["index"], []).append(w)
            picked = np.array(sorted(of))
            lens = s.off[picked + 1] - s.off[picked]
            data = np.concatenate([s.data[s.off[i] : s.off[i + 1]] for i in picked])
            out: list[tuple] = []
            held = 0
            for i, x in zip(picked, shingle_sets(data, np.concatenate([[0], np.cumsum(lens)]), size), strict=True):
                blob = x.tobytes()
                for w in of[int(i)]:
                    out.append((*(w[c] for c in given), blob))
                    held += len(blob)
                    if held >= SEND_BYTES or len(out) >= 1000:
                        yield C.batch(schema, *zip(*out, strict=True))
                        out, held = [], 0
            if out:
                yield C.batch(schema, *zip(*out, strict=True))

    def compare(batches):
        schema = pa.schema([*((c, pa.int64()) for c in ("root", "n", "node", "links", "other", "pairs")), ("expected", pa.list_(pa.float64()))])
        for t in _groups(batches, ["g"]):
            g, side, root, n, node, mult = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in given)
            off, data = C.buffers(t.column("x"))
            cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z - a < 2:
                    continue
                i, j, s = verify([data[off[k] : off[k + 1]].view(np.uint64) for k in range(a, z)], side[a:z], threshold)
                if not len(i):
                    continue
                own, copies = node[a:z], mult[a:z].astype(np.float64)
                links = np.bincount(i, copies[j], minlength=z - a) + np.bincount(j, copies[i], minlength=z - a)
                some = np.flatnonzero(links)
                union, starts = _Union(z - a), np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
                for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                    union.add(int(i[lo]), j[lo:hi], 0)
                least = np.full(z - a, np.iinfo(np.int64).max)
                np.minimum.at(least, union.label, own)
                p, q = own[some], least[union.label[some]]
                p, q = p[p != q], q[p != q]
                expected = [float((1 / found(s, d)).sum()) for d in range(1, DEPTH + 1)]
                k, m = len(some), len(some) + len(p)
                none = lambda x: [None] * x
                yield C.batch(
                    schema, np.full(m + 1, root[a]), np.full(m + 1, n[a]), [*own[some].tolist(), *p.tolist(), None],
                    [*links[some].astype(np.int64).tolist(), *none(m + 1 - k)], [*none(k), *q.tolist(), None],
                    [*none(m), len(i)], [*none(m), expected],
                )

    sent = shards.join(wanted, "shard").mapInArrow(sets, "g string, side int, root long, n long, node long, mult long, x binary")
    return C.checkpoint(sent.repartition("g").sortWithinPartitions("g", "side", "node").mapInArrow(compare, "root long, n long, node long, links long, other long, pairs long, expected array<double>"))


@dataclass
class Search:
    """What a forest search found. verified: as _verified has it; depth: the prefix at which it ended; recall: the
    estimated share of links that a prefix finds, for each that was tried (none where no link was found)."""

    verified: DataFrame
    depth: int
    recall: dict[int, float]


def search(shards: DataFrame, parts: DataFrame, threshold: float, shingle: int, recall: float, node_rows: int, tile_rows: int, tile_shingles: int) -> Search:
    """Shortens the matched prefix until the share of links found is recall. parts: node, shard, index, n_set, mult, sig."""
    floor = prefix_for(threshold, TREES, DEPTH, recall)
    band = F.floor(F.log(F.col("n_set").cast("double")) / (float(-np.log(threshold)) * (1 + 1e-9))).cast("int")
    edges = _candidates(parts.select("node", "sig"), floor, node_rows)
    at = {r["depth"]: r["count"] for r in edges.groupBy("depth").count().collect()}  # DEPTH rows at most
    roots = done = verified = None
    tried: dict[int, float] = {}
    before, d = DEPTH + 1, DEPTH
    while True:
        if any(at.get(k) for k in range(d, before)):
            pairs = edges.where((F.col("depth") >= d) & (F.col("depth") < before)).select("a", "b")
            roots = connected(pairs if roots is None else pairs.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            own = C.checkpoint(parts.select("node", "shard", "index", "n_set", "mult", band.alias("band")).join(roots, "node"))
            sized = _sized(own, tile_rows, tile_shingles)
            new = sized if done is None else sized.join(done, ["root", "n"], "left_anti")
            more = _verified(shards, _dealt(own, new, tile_rows, tile_shingles), shingle, threshold)
            verified = more if verified is None else verified.join(sized, ["root", "n"], "left_semi").unionByName(more)  # those of components that have grown since go
            done = sized
        if verified is not None:
            n, *expected = verified.agg(F.sum("pairs"), *(F.sum(F.element_at("expected", k)) for k in range(1, DEPTH + 1))).first()
            if n:
                tried[d] = n / expected[d - 1]
                if tried[d] >= recall:
                    break
        if d == floor:
            break
        before = d
        d = next((k for k in range(d - 1, floor, -1) if verified is not None and n and n / expected[k - 1] >= recall), floor)
    if verified is None:
        verified = shards.sparkSession.createDataFrame([], "root long, n long, node long, links long, other long, pairs long, expected array<double>")
    return Search(verified, d, tried)


def _classes(shards: DataFrame, threshold: float, shingle: int, recall: float, node_rows: int, tile_rows: int, tile_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row; and digest, mult, least (id), links and root of every class."""
    sketches = _sketches(shards, shingle)
    classes = C.checkpoint(sketches.where("n_set > 0").groupBy("digest").agg(F.min("rid").alias("node"), F.count("*").alias("mult"), F.min("doc_id").alias("least")))
    parts = C.checkpoint(sketches.select(F.col("rid").alias("node"), "shard", "index", "n_set", "sig").join(classes.select("node", "mult"), "node"))
    verified = search(shards, parts, threshold, shingle, recall, node_rows, tile_rows, tile_shingles).verified
    links = verified.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    linked = connected(verified.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    own = classes.join(linked, "node", "left").join(links, "node", "left")
    return sketches, C.checkpoint(own.select("digest", "mult", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, node_rows: int = NODE_ROWS, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """id_col, class_id and n_links for each row of docs.

    n_links counts the other rows whose sets of shingles have a Jaccard similarity of threshold or more with this one's;
    class_id is the least id that is connected with it by such links, its own without any. A text of fewer words than a
    shingle has one shingle of all its words. A null text or one without words has none and links to nothing. Repeated
    rows are copies and link to each other; a null id is no class_id unless its class has no other. An empty table gives
    an empty one; other columns are left out.
    """
    sketches, own = _classes(C.pack(docs, id_col, text_col), threshold, shingle, recall, node_rows, tile_rows, tile_shingles)
    named = own.join(own.groupBy("root").agg(F.min("least").alias("class_id")), "root")
    out = sketches.select("doc_id", "digest").join(named.select("digest", "mult", "links", "class_id"), "digest", "left")
    return out.select(F.col("doc_id").alias(id_col), F.when(F.col("mult").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("links") + F.col("mult") - 1, F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, node_rows: int = NODE_ROWS, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """docs with one row of each class that join() finds: that of the least id (a null comes last), one of its repeats.

    Rows that link to nothing stay, those without words among them. All columns of docs are kept.
    """
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    shards = C.pack(docs, id_col, text_col, others)
    sketches, own = _classes(shards, threshold, shingle, recall, node_rows, tile_rows, tile_shingles)
    grouped = sketches.where("n_set > 0").select("doc_id", "rid", "shard", "index", "digest").join(own.select("digest", "root"), "digest")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "shard", "index")).alias("x")).select("x.shard", "x.index")
    rows = first.union(sketches.where("n_set = 0").select("shard", "index")).groupBy("shard").agg(F.collect_list("index").alias("kept"))

    def run(batches):
        for row, s in C.packed(batches):
            k = np.array(sorted(row["kept"]))
            text = pa.array([None if s.null[i] else s.text(i).decode("utf-8", "replace") for i in k], pa.string())
            yield pa.RecordBatch.from_arrays([C.id_column(s.ids[k]), text, *(c.take(pa.array(k)) for c in C.rest_of(row["rest"]))], names=["id", "text", *(f"c{j}" for j in range(len(others)))])

    kinds = "".join(f", c{j} {docs.schema[c].dataType.simpleString()}" for j, c in enumerate(others))
    return shards.join(rows, "shard").mapInArrow(run, f"id long, text string{kinds}").toDF(id_col, text_col, *others).select(docs.columns)
