"""Hard negatives of anchors by inner product, found through a pivot table.

An anchor's positives are its first rows of the same label; the negatives of an anchor and a positive are the first rows
of other labels whose score lies between a share of the positive's score and that score itself.

Augmenting turns the inner product into a distance: a row x gets the coordinate sqrt(M - |x|^2), M being the largest
squared norm, and an anchor gets 0 there, so that |a - x|^2 = |a|^2 + M - 2 a.x. The pivot table holds each row's
distances to a few pivots. By the triangle inequality the distance of anchor and row is at least the largest
|d(a, p) - d(x, p)| and at most the least d(a, p) + d(x, p); this brackets the score, first for blocks of anchors and
groups of rows, then for an anchor and 1024 rows that lie at like distances, then for an anchor and a row. What the
brackets leave is checked exactly, in integers. Brackets spare work and decide nothing: where they would spare less than
half of a block's pairs, all of them are checked.

Rows are dealt out by label, nearest pivot and distance, into groups of one label that a task can hold, however common
a label or a vector is. Anchors are a stated set of queries: blocks of them meet the groups that brackets leave.

Odd rows: a row with a null label, a null vector, or a null or non-finite component takes no part. A shorter vector
counts as one with zeros at its end. A null id is no anchor and comes after other ids. Repeated rows are rows of their
own: one is another's positive. Scaled components beyond the size at which sums leave 64 bits count as that size. Other
columns, of whatever name, are not read. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Pivots, and the rows that they are chosen from: those with the least hash of their id.
PIVOTS, SAMPLE = 8, 1024
#: Rows of one label that a task compares at once: a share of the table within these bounds. Anchors of a block.
LEAST_GROUP, MOST_GROUP, GROUPS, ANCHORS = 2048, 131_072, 64, 4096
#: Rows that are bracketed together, and how many of them are asked first whether brackets help.
BLOCK, PROBE = 1024, 64
#: Stands for a null id: after all others.
LAST = np.iinfo(np.int64).max

ROW = "uid long, label string, anchor boolean, id long, cell int, near float, vec binary, dist binary"
PACK = "key long, label string, n int, norm double, lo array<float>, hi array<float>, uids binary, ids binary, vecs binary, dists binary, wants binary"


@dataclass(frozen=True)
class Space:
    """The augmented space. dim: components; top: the largest squared norm; store, work: number types of vectors that
    are kept, and of exact products; pivots: rows of dim + 1 coordinates."""

    scale: float
    dim: int
    top: float
    store: str
    work: str
    pivots: np.ndarray

    def scaled(self, col: pa.Array) -> np.ndarray:
        return _scaled(col, self.scale, self.dim)

    def distances(self, vecs: np.ndarray, augmented: bool) -> np.ndarray:
        """Distances to the pivots, of rows (augmented) or of anchors."""
        v = vecs.astype(np.float64)
        norm = (v * v).sum(1)
        last = np.sqrt(np.maximum(self.top - norm, 0)) if augmented else np.zeros(len(v))
        p = self.pivots
        square = norm[:, None] + last[:, None] ** 2 + (p * p).sum(1)[None] - 2 * (v @ p[:, :-1].T + last[:, None] * p[None, :, -1])
        return np.sqrt(np.maximum(square, 0)).astype(np.float32)

    @property
    def slack(self) -> float:
        """What rounding may cost a distance."""
        return 1e-5 * np.sqrt(self.top) + 1e-3


def _scaled(col: pa.Array, scale: float, dim: int) -> np.ndarray:
    lens = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(col.flatten().cast(pa.float64()))
    most = np.floor(np.sqrt(2.0**61 / max(1, dim)))
    values = np.clip(np.floor(scale * values), -most, most).astype(np.int64)
    if (lens == dim).all():
        return values.reshape(len(lens), dim)
    out = np.zeros((len(lens), dim), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out


def _space(rows: DataFrame, scale: float) -> tuple[Space, int]:
    """The space of some rows, and their number."""
    dim = int(rows.agg(F.max(F.size("vec"))).first()[0] or 0)

    def measure(batches):
        for b in batches:
            v = _scaled(b.column(0), scale, dim)
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int64()), pa.array([int((v * v).sum(1).max())], pa.int64()), pa.array([int(np.abs(v).max(initial=0))], pa.int64())], names=["n", "top", "peak"])

    n, top, peak = rows.select("vec").mapInArrow(measure, "n long, top long, peak long").agg(F.sum("n"), F.max("top"), F.max("peak")).first()
    top, peak = top or 0, peak or 0
    sample = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column(0).combine_chunks()
    v = _scaled(sample, scale, dim).astype(np.float64)
    full = np.hstack([v, np.sqrt(np.maximum(top - (v * v).sum(1, keepdims=True), 0))])
    chosen, far = np.zeros((0, dim + 1)), np.full(len(full), np.inf)
    for _ in range(min(PIVOTS, len(full))):  # each the farthest from those before
        chosen = np.vstack([chosen, full[int(far.argmax())]])
        far = np.minimum(far, ((full - chosen[-1]) ** 2).sum(1))
    store = "<i2" if peak < 1 << 15 else "<i4"
    work = "float32" if top < 1 << 24 else "float64" if top < 1 << 53 else "int64"
    return Space(scale, dim, float(top), store, work, chosen), n or 0


def _table(rows: DataFrame, space: Space, n: int) -> DataFrame:
    """The pivot table: rows with their distances to the pivots, ordered by label, nearest pivot and distance, in
    groups of one label (PACK). Written, so that a row's place in it (its uid) stays as it is."""

    def run(batches):
        for b in batches:
            v = space.scaled(b.column(3))
            d = space.distances(v, True)
            cell = d.argmin(1).astype(np.int32) if len(d) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(v), pa.int64()), b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(d[np.arange(len(d)), cell]), _cells(v.astype(space.store)), _cells(d)],
                names=["uid", "label", "anchor", "id", "cell", "near", "vec", "dist"],
            )

    most = min(MOST_GROUP, max(LEAST_GROUP, n // GROUPS))
    return C.checkpoint(_packed(rows.select("label", "anchor", "id", "vec").mapInArrow(run, ROW), space, most, n))


def _cells(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as values of bytes."""
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, (len(a) + 1) * width, max(1, width), dtype=np.int32)[: len(a) + 1] if width else np.zeros(len(a) + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _packed(rows: DataFrame, space: Space, most: int, n: int) -> DataFrame:
    """ROW (and wants) as PACK: up to `most` rows of one label, that are near each other, in one."""
    order = ["label", "cell", "near", "id", "uid"]
    with_wants = "wants" in rows.columns
    k = len(space.pivots)

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []

        def pack(t: pa.Table, key: int):
            b = t.combine_chunks()
            col = lambda name: b.column(name).combine_chunks()
            raw = lambda name: C.buffers(col(name))[1].tobytes()
            d = np.frombuffer(raw("dist"), np.float32).reshape(len(b), k)
            v = np.frombuffer(raw("vec"), space.store).reshape(len(b), space.dim).astype(np.float64)
            ids = np.asarray(col("id").fill_null(LAST)).astype(np.int64)
            uids = key * MOST_GROUP + np.arange(len(b)) if col("uid").null_count else np.asarray(col("uid"))
            anchor = np.asarray(col("anchor").cast(pa.int64())) if not with_wants else np.ones(len(b), np.int64)
            wants = raw("wants") if with_wants else anchor.astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((key, col("label")[0].as_py(), len(b), float((v * v).sum(1).max()), d.min(0).tolist(), d.max(0).tolist(), uids.astype(np.int64).tobytes(), ids.tobytes(), raw("vec"), raw("dist"), wants), PACK_TYPES, strict=True)],
                names=PACK_NAMES,
            )

        size = 0
        for b in batches:
            lo = 0
            labels = b.column("label")
            changes = np.flatnonzero(np.asarray(pc.not_equal(labels.slice(1), labels.slice(0, len(labels) - 1)))) + 1 if len(labels) > 1 else np.zeros(0, int)
            ends = [*changes.tolist(), len(labels)]
            for end in ends:
                while lo < end:
                    if held and held[0].column("label")[0] != labels[lo] or size >= most:
                        yield from pack(pa.Table.from_batches(held), key)
                        held, size, key = [], 0, key + 1
                    step = min(end - lo, most - size)
                    held.append(b.slice(lo, step))
                    size, lo = size + step, lo + step
        if held:
            yield from pack(pa.Table.from_batches(held), key)

    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism if n > LEAST_GROUP else 1, n // most)
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, PACK)


PACK_NAMES = ["key", "label", "n", "norm", "lo", "hi", "uids", "ids", "vecs", "dists", "wants"]
PACK_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float32()), pa.list_(pa.float32()), *[pa.binary()] * 5]


@dataclass
class Side:
    """Some anchors, or a group of rows, as arrays."""

    uid: np.ndarray
    id: np.ndarray
    vec: np.ndarray
    dist: np.ndarray

    @staticmethod
    def of(space: Space, uids: bytes, ids: bytes, vecs: bytes, dists: bytes) -> Side:
        uid = np.frombuffer(uids, np.int64)
        vec = np.frombuffer(vecs, space.store).reshape(len(uid), space.dim)
        return Side(uid, np.frombuffer(ids, np.int64), vec.astype(space.work), np.frombuffer(dists, np.float32).reshape(len(uid), len(space.pivots)))


def _bracket(space: Space, norm: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the score, from bounds of the distance."""
    base = (norm + space.top)[:, None]
    rounding = 0.5 + 1e-9 * space.top
    near, far = np.maximum(least - space.slack, 0), most + space.slack
    return (base - far.astype(np.float64) ** 2) / 2 - rounding, (base - near.astype(np.float64) ** 2) / 2 + rounding


def survivors(space: Space, a: Side, x: Side, low: np.ndarray, high: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor, row and score of pairs with low <= score <= high, by blocks of rows: for each anchor, column of low and
    block, all that can be among its first `most`. low and high have a row for each anchor and a column for each window;
    the caller may raise low between blocks. An anchor does not meet itself."""
    v = a.vec.astype(np.float64)
    norm = (v * v).sum(1)
    starts = np.arange(0, len(x.uid), BLOCK)
    lo, hi = np.minimum.reduceat(x.dist, starts), np.maximum.reduceat(x.dist, starts)
    gap = np.maximum(lo[None] - a.dist[:, None], a.dist[:, None] - hi[None]).max(2)
    reach = (a.dist[:, None] + hi[None]).min(2)
    lower, upper = _bracket(space, norm, gap, reach)
    for s in np.argsort(gap.mean(0), kind="stable"):
        who = np.flatnonzero((upper[:, s] >= low.min(1)) & (lower[:, s] <= high.max(1)))
        if not len(who):
            continue
        rows = slice(starts[s], starts[s] + BLOCK)
        from_, to = low[who].min(1)[:, None], high[who].max(1)[:, None]

        def possible(d, who=who, from_=from_, to=to):
            least = np.zeros((len(who), len(d)), np.float32)
            furthest = np.full((len(who), len(d)), np.inf, np.float32)
            for j in range(d.shape[1]):
                p, q = a.dist[who, j][:, None], d[None, :, j]
                np.maximum(least, np.abs(p - q), out=least)
                np.minimum(furthest, p + q, out=furthest)
            lower, upper = _bracket(space, norm[who], least, furthest)
            return (upper >= from_) & (lower <= to)

        xs, d = x.vec[rows], x.dist[rows]
        i, j, score = None, None, None
        if possible(d[:: max(1, len(d) // PROBE)]).mean() < 0.5:
            ok = possible(d)
            if ok.mean() < 0.1:
                i, j = np.nonzero(ok)
                score = np.einsum("ij,ij->i", a.vec[who[i]], xs[j])
                keep = (score >= from_[i, 0]) & (score <= to[i, 0]) & (a.uid[who[i]] != x.uid[rows][j])
                yield who[i[keep]], j[keep] + starts[s], score[keep].astype(np.int64)
                continue
        product = (a.vec[who] @ xs.T).astype(np.float64 if space.work == "float32" else space.work)
        ok = (product >= from_) & (product <= to) & (a.uid[who][:, None] != x.uid[rows][None])
        many = np.flatnonzero(ok.sum(1) > 16 * most)
        few = ok.copy()
        few[many] = False
        i, j = np.nonzero(few)
        yield who[i], j + starts[s], product[i, j].astype(np.int64)
        if len(many):  # equal scores by id, so that no more than `most` are left for each window
            place = np.argsort(np.argsort(x.id[rows], kind="stable"))
            exact = space.top < 1 << 42
            for w in range(low.shape[1]):
                p = product[many]
                fits = ok[many] & (p >= low[who[many], w][:, None]) & (p <= high[who[many], w][:, None])
                if exact and p.shape[1] > most:
                    rank = np.where(fits, p * BLOCK - place[None], -np.inf)
                    fits &= rank >= np.partition(rank, -most, axis=1)[:, -most][:, None]
                i, j = np.nonzero(fits)
                yield who[many[i]], j + starts[s], p[i, j].astype(np.int64)


def first(key: np.ndarray, score: np.ndarray, ids: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Which of some rows are among the first `most` of their key: higher scores first, then smaller ids. A row (its
    place) that comes twice counts once."""
    order = np.lexsort((place, ids, -score, key))
    k, p = key[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    order = order[new]
    k = key[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    nth = np.arange(len(k)) - np.repeat(begins, np.diff(np.append(begins, len(k))))
    return order[nth < most]


def _search(space: Space, most: int, windows: int, share: tuple[int, int]):
    """Compares blocks of anchors with groups of rows; each gives, for an anchor and a window, its first `most` rows.
    Without windows the window is all scores. Otherwise a window is a positive's: wants holds the scores, or LAST."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                a_uid, a_id, a_vec, a_dist, wants, x_uid, x_id, x_vec, x_dist = (b.column(c)[r].as_py() for c in range(9))
                a, x = Side.of(space, a_uid, a_id, a_vec, a_dist), Side.of(space, x_uid, x_id, x_vec, x_dist)
                if windows:
                    want = np.frombuffer(wants, np.int64).reshape(len(a.uid), windows)
                    fits = (want != LAST) & (want >= 0)
                    low = np.where(fits, -(-np.where(fits, want, 0).astype(object) * share[0] // share[1]), 2**62).astype(np.int64)
                    high = np.where(fits, want, -(2**62))
                else:
                    low, high = np.full((len(a.uid), 1), -(2**62)), np.full((len(a.uid), 1), 2**62)
                key = score = ids = place = np.zeros(0, np.int64)
                floor, width, held = low.copy(), low.shape[1], []

                def merged(held=held, floor=floor, low=low):
                    key, score, ids, place = (np.concatenate(c) for c in zip(*held, strict=True))
                    keep = first(key, score, ids, place, most)
                    key, score, ids, place = key[keep], score[keep], ids[keep], place[keep]
                    held[:] = [(key, score, ids, place)]
                    least = low.ravel().copy()
                    least[key] = score  # a key's last row has its least score
                    floor[:] = np.where((np.bincount(key, minlength=floor.size) == most).reshape(floor.shape), least.reshape(floor.shape), low)
                    return held[0]

                size = 0
                for i, j, s in survivors(space, a, x, floor, high, most):
                    for w in range(width):
                        fit = (s >= floor[i, w]) & (s <= high[i, w])
                        held.append((i[fit] * width + w, s[fit], x.id[j[fit]], j[fit]))
                        size += len(held[-1][0])
                    if size >= most * floor.size:
                        merged()
                        size = 0
                if held:
                    key, score, ids, place = merged()
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(a.uid[key // width]), pa.array((key % width).astype(np.int32)), pa.array(score), pa.array(ids, mask=ids == LAST), pa.array(x.uid[place])], names=["uid", "window", "score", "id", "other"])

    return run


FOUND = "uid long, window int, score long, id long, other long"


def _compare(anchors: DataFrame, groups: DataFrame, space: Space, most: int, same: bool, windows: int, share: tuple[int, int]) -> DataFrame:
    """FOUND: the first `most` rows of each anchor and window, of the anchor's label or of others."""
    a = anchors.select(F.col("key").alias("block"), F.col("label").alias("la"), F.col("norm").alias("na"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), *([F.col("least")] if windows else []))
    g = groups.select(F.col("key").alias("grp"), F.col("label").alias("lg"), F.col("lo").alias("glo"), F.col("hi").alias("ghi"))
    if same:
        units = a.join(g, F.col("la") == F.col("lg"))
    else:  # blocks of the stated queries against groups of all rows: numbers of blocks only, dealt out by group
        parts = 4 * groups.sparkSession.sparkContext.defaultParallelism
        blocks = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        units = g.withColumn("part", F.pmod(F.hash("grp"), F.lit(parts))).join(blocks, "part").where("la <> lg")
        apart = F.greatest(F.array_max(F.zip_with("glo", "ahi", lambda p, q: p - q)), F.array_max(F.zip_with("alo", "ghi", lambda p, q: p - q)), F.lit(0.0)) - F.lit(space.slack)
        best = (F.col("na") + F.lit(space.top) - F.pow(F.greatest(apart, F.lit(0.0)), 2)) / 2 + F.lit(0.5 + 1e-9 * space.top)
        units = units.where(best * share[1] >= F.col("least") * share[0])
    left = anchors.select(F.col("key").alias("block"), *(F.col(c).alias(f"a_{c}") for c in ("uids", "ids", "vecs", "dists", "wants")))
    right = groups.select(F.col("key").alias("grp"), *(F.col(c).alias(f"x_{c}") for c in ("uids", "ids", "vecs", "dists")))
    met = units.select("block", "grp").join(left, "block").join(right, "grp").drop("block", "grp")
    found = met.mapInArrow(_search(space, most, windows, share), FOUND)
    nth = F.row_number().over(Window.partitionBy("uid", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other"))
    return found.withColumn("nth", nth.cast("int")).where(F.col("nth") <= most)


def mine(table: DataFrame, anchor: Callable[[DataFrame], Column] | Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: float = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). An anchor (a row for which the condition `anchor` holds) has its first
    `positives` other rows of the same label; each of these has its first `negatives` rows of other labels with
    share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score. Higher scores come first, then
    smaller ids. Ranks start at 1.
    """
    label = F.col(label) if isinstance(label, str) else label
    vec = F.col(vector_col)
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = table.where(label.isNotNull() & vec.isNotNull() & sound).select(label.cast("string").alias("label"), (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("anchor"), F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"))
    space, n = _space(rows, scale)
    groups = _table(C.spread(rows), space, n)

    def anchors_in(batches):
        for b in batches:
            for r in range(b.num_rows):
                label, uids, ids, vecs, wants = (b.column(c)[r].as_py() for c in ("label", "uids", "ids", "vecs", "wants"))
                own = np.flatnonzero(np.frombuffer(wants, np.int8))
                v = np.frombuffer(vecs, space.store).reshape(-1, space.dim)[own] if space.dim else np.zeros((len(own), 0), space.store)
                d = space.distances(v, False)
                cell = d.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(uids, np.int64)[own]), pa.array([label] * len(own), pa.string()), pa.array([True] * len(own), pa.bool_()), pa.array(np.frombuffer(ids, np.int64)[own]), pa.array(cell), pa.array(d[np.arange(len(d)), cell]), _cells(v), _cells(d)],
                    names=["uid", "label", "anchor", "id", "cell", "near", "vec", "dist"],
                )

    anchors = C.checkpoint(groups.select("label", "uids", "ids", "vecs", "wants").mapInArrow(anchors_in, ROW))
    n_anchors = anchors.count()
    blocks = C.checkpoint(_packed(anchors, space, ANCHORS, n_anchors))
    found = C.checkpoint(_compare(blocks, groups, space, positives, True, 0, share))

    scores = F.transform(F.sort_array(F.collect_list(F.struct("nth", "score"))), lambda s: s["score"])
    wants = found.groupBy("uid").agg(scores.alias("scores"))
    padded = F.concat("scores", F.array_repeat(F.lit(int(LAST)), F.lit(positives) - F.size("scores")))

    def with_wants(batches):
        for b in batches:
            want = np.asarray(b.column(b.schema.get_field_index("want")).flatten()).reshape(-1, positives).astype("<i8")
            keep = [c for c in b.schema.names if c != "want"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), _cells(want)], names=[*keep, "wants"])

    asked = anchors.join(wants.withColumn("want", padded).drop("scores"), "uid").select(*anchors.columns, "want")
    asked = asked.mapInArrow(with_wants, ROW + ", wants binary")
    asked = _packed(asked, space, ANCHORS, n_anchors)

    def with_least(batches):
        for b in batches:
            least = [min((int(w) for w in np.frombuffer(x.as_py(), np.int64) if 0 <= w < LAST), default=None) for x in b.column("wants")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=[*b.schema.names, "least"])

    asked = C.checkpoint(asked.mapInArrow(with_least, PACK + ", least long").where("least IS NOT NULL"))
    hard = _compare(asked, groups, space, negatives, False, positives, share)
    hard = hard.select("uid", (F.col("window") + 1).alias("place"), F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pos = found.select("uid", F.col("nth").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(pos, ["uid", "place"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
