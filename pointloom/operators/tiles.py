"""The stored octree of a scan: tiles of bounded counts, and display nodes below and above them.

A node's key is a one followed by its path from the root, three bits a level, so that keys sort by level and then by
place, and key >> 3 is the parent. Tiles come from a pyramid of counts, split until each has at most a given number of
points; one redistribution brings each tile's points together, and a task builds the display nodes of a tile from below:
leaves keep their points, and every other node lifts one point of each cell of its grid from its children. What tiles'
own nodes hold then waits for the few nodes above all tiles, which are built in the same way, a level at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.geometry import Bounds, distance2, morton, xyz

#: Levels below the root, levels that a round of counting goes down, and the bits below a tile's number of its part.
DEPTH, ROUND, KEY_BITS = 17, 6, 52
#: Points of a tile and of a leaf at most, and cells along a node's side.
MOST_TILE, MOST_LEAF, GRID = 262_144, 16_384, 128
#: Points of small tiles that a task takes together.
TOGETHER = 100_000
#: The root's key, and the tile of records that are not valid.
ROOT, NOWHERE = 1, 0


def cube(bounds: Bounds | None) -> tuple[tuple[float, float, float], float]:
    """The least corner and the side of the root."""
    if bounds is None:
        return (0.0, 0.0, 0.0), 1.0
    side = max(float(b - a) for a, b in zip(bounds.lo, bounds.hi, strict=True))
    return tuple(float(v) for v in bounds.lo), side * (1 + 1e-9) if side > 0 else 1.0


def coded(points: DataFrame, lo: tuple[float, float, float], size: float) -> DataFrame:
    """points with _code, the Morton number of their cell of the deepest level; null of those that are not valid. Cells come
    from a generator of one row, so that the many steps of a number read columns rather than work cells out anew."""
    most = (1 << DEPTH) - 1
    cells = [F.least(F.greatest(F.floor((v - float(a)) / size * float(1 << DEPTH)).cast("long"), F.lit(0)), F.lit(most)) for v, a in zip(xyz(), lo, strict=True)]
    at = points.select("*", F.inline(F.array(F.struct(*(c.alias(f"_c{k}") for k, c in enumerate(cells))))))
    code = F.when(F.col("valid"), morton(*(F.col(f"_c{k}") for k in range(3))))
    return at.withColumn("_code", code).drop("_c0", "_c1", "_c2")


def key_of(code: Column, level: int) -> Column:
    return F.shiftright(code, 3 * (DEPTH - level)).bitwiseOR(F.lit(1 << 3 * level).cast("long"))


def level_of(key: Column) -> Column:
    """The level of a node's key."""
    return F.floor((F.length(F.bin(key)) - 1) / 3).cast("int")


def _round(codes: DataFrame, top: int, bottom: int, most: int) -> DataFrame:
    """key, tile and n of every cell at level `bottom` with points: the coarsest node at levels top to bottom around it
    with at most `most` points; tile is null where the cell itself has more."""
    base = codes.groupBy(key_of(F.col("_code"), bottom).alias("key")).agg(F.count("*").alias("n"))
    up = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("key", 3 * (bottom - k)).alias("at")) for k in range(top, bottom + 1))))
    paths = base.select("key", "n", up.alias("u")).select("key", "n", "u.level", "u.at")
    few = paths.groupBy("at").agg(F.sum("n").alias("all")).where(F.col("all") <= most)
    tile = paths.join(few, "at").groupBy("key").agg(F.min_by("at", "level").alias("tile"))
    return base.join(tile, "key", "left").select("key", "tile", "n")


def tiled(points: DataFrame, lo: tuple[float, float, float], size: float, ref: tuple[str, ...], written: Callable[[DataFrame], DataFrame], most: int = MOST_TILE) -> tuple[DataFrame, int]:
    """points (with valid) with _code and _tile, and the greatest level of a tile; `written` stores counts of cells. No tile has more than `most` points,
    but for one of the deepest level: equal places cannot be split, and such a tile is cut into up to 2,048 parts."""
    own = coded(points, lo, size)
    left, out, deepest = own.where("_code IS NOT NULL"), [], 0
    level = 0
    while True:
        bottom = min(level + ROUND, DEPTH)
        cells = _round(left.select("_code"), level + 1 if level else 0, bottom, most)
        cells = written(cells)
        told = cells.agg(F.max(level_of(F.col("tile"))).alias("level"), F.count_if(F.col("tile").isNull()).alias("heavy"), F.max("n").alias("n")).first()
        deepest = max(deepest, told["level"] or 0, bottom if told["heavy"] else 0)
        # 8^ROUND rows at most in the first round; in later ones Spark knows the table's size
        side = cells.select(F.col("key").alias("_key"), F.col("tile").alias("_tile"), F.col("n").alias("_n"))
        met = left.withColumn("_key", key_of(F.col("_code"), bottom)).join(F.broadcast(side) if not level else side, "_key")
        if not told["heavy"]:
            out.append(met.drop("_key", "_n"))
            break
        out.append(met.where("_tile IS NOT NULL").drop("_key", "_n"))
        rest = met.where("_tile IS NULL")
        if bottom == DEPTH:
            part = F.pmod(F.xxhash64(*ref), F.least(F.ceil(F.col("_n") / most), F.lit(1 << 63 - KEY_BITS)).cast("long"))
            out.append(rest.withColumn("_tile", F.col("_key").bitwiseOR(F.shiftleft(part, KEY_BITS))).drop("_key", "_n"))
            break
        left, level = rest.drop("_key", "_n", "_tile"), bottom
    # records without a place: by their number, so that no task has them all
    out.append(own.where("_code IS NULL").withColumn("_tile", F.shiftleft(F.pmod(F.xxhash64(*ref), F.lit(256)).cast("long"), KEY_BITS)))
    return reduce(DataFrame.unionByName, out), deepest


def lift(place: np.ndarray, code: np.ndarray, order: np.ndarray, top: int | np.ndarray, lo: tuple[float, float, float], size: float, leaf: int = MOST_LEAF, grid: int = GRID) -> np.ndarray:
    """The level of the display node that keeps each point of the node at level `top` that holds them all, or of each
    point's own such node. place: (n, 3); order: each point's rank by its reference, for ties."""
    n = len(code)
    top = np.broadcast_to(top, n)
    by = np.argsort(code, kind="stable")
    level, highest = np.full(n, DEPTH), int(top.min(initial=DEPTH))
    for k in range(DEPTH, highest - 1, -1):
        c = code[by] >> 3 * (DEPTH - k)
        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        counts = np.diff(np.append(at, n))
        level[by[np.repeat(counts <= leaf, counts) & (top[by] <= k)]] = k
    rel = place - np.array(lo)
    for k in range(int(level.max(initial=highest)) - 1, highest - 1, -1):
        pool = np.flatnonzero((level == k + 1) & (top <= k))
        step = size / (1 << k) / grid
        cell = np.floor(rel[pool] / step)
        far = (((rel[pool] - (cell + 0.5) * step)) ** 2).sum(1)
        rank = np.lexsort((order[pool], far, cell[:, 2], cell[:, 1], cell[:, 0]))
        c = cell[rank]
        first = np.concatenate([np.ones(min(1, len(c)), bool), (c[1:] != c[:-1]).any(1)])
        level[pool[rank[first]]] = k
    return level


def whole_tiles(batches, rows: int):
    """Tables of whole tiles, of about so many rows if their tiles are smaller, from batches in order of tiles."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            t = pa.Table.from_batches(held)
            tile = t.column("_tile").to_numpy()
            cut = int(np.searchsorted(tile, tile[-1]))
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), len(t) - cut
    if n:
        yield pa.Table.from_batches(held)


def with_nodes(points: DataFrame, lo: tuple[float, float, float], size: float, ref: tuple[str, ...], tasks: int | None, leaf: int = MOST_LEAF, grid: int = GRID) -> DataFrame:
    """points (as tiled() gives them) with _node, dealt out by tile into `tasks` partitions (None: as many as a shuffle
    has), and _waiting: whether a point is its tile's node's own and a node above may take it. A task takes its tiles one
    after another, small ones together; a tile's size is bounded."""
    schema = T.StructType([*(f for f in points.schema if f.name != "_code"), T.StructField("_node", T.LongType()), T.StructField("_waiting", T.BooleanType())])

    def run(batches):
        for t in whole_tiles(batches, TOGETHER):
            col = lambda c, t=t: t.column(c).to_numpy()
            tile = col("_tile")
            key = tile & (1 << KEY_BITS) - 1
            order = np.empty(len(t), np.int64)
            order[np.lexsort(tuple(col(c) for c in reversed(ref)))] = np.arange(len(t))
            node, waiting = np.zeros(len(t), np.int64), np.zeros(len(t), bool)
            code = t.column("_code").fill_null(0).to_numpy()
            here = np.flatnonzero(key != NOWHERE)
            if len(here):
                each, inverse = np.unique(key[here], return_inverse=True)
                top = np.array([(int(k).bit_length() - 1) // 3 for k in each])[inverse]
                level = lift(np.stack([col(c)[here] for c in "xyz"], 1), code[here], order[here], top, lo, size, leaf, grid)
                node[here] = (np.int64(1) << 3 * level) | code[here] >> 3 * (DEPTH - level)
                waiting[here] = (level == top) & (top > 0)
            out = t.drop_columns(["_code"]).append_column("_node", pa.array(node)).append_column("_waiting", pa.array(waiting))
            sort = np.lexsort((order, code, node, tile))
            yield from out.take(pa.array(sort)).to_batches()

    dealt = points.repartition(*([] if tasks is None else [tasks]), "_tile").sortWithinPartitions("_tile")
    return dealt.mapInArrow(run, schema)


def above_tiles(waiting: DataFrame, lo: tuple[float, float, float], size: float, ref: tuple[str, ...], deepest: int, written: Callable[[DataFrame], DataFrame], grid: int = GRID) -> DataFrame:
    """The points that wait, each in the node that keeps it, which is its tile too if it is above the tile. From the deepest tiles' level up
    each node takes the point nearest the centre of each cell of its grid from its children's. `written` stores a level's
    points and reads them again, so that a level's plan does not hold the last one's."""
    own = waiting.withColumn("_level", level_of(F.col("_node"))).drop("_waiting")
    lifted, done = None, []
    for k in range(deepest - 1, -1, -1):
        pool = own.where(F.col("_level") == k + 1)
        pool = pool if lifted is None else pool.unionByName(lifted)
        step = size / (1 << k) / grid
        cells = [F.floor((v - float(a)) / step).cast("long") for v, a in zip(xyz(), lo, strict=True)]
        centre = tuple((c.cast("double") + 0.5) * step + float(a) for c, a in zip(cells, lo, strict=True))
        nth = F.row_number().over(Window.partitionBy(*cells).orderBy(distance2(xyz(), centre), *ref))
        ranked = written(pool.withColumn("_up", nth == 1))
        done.append(ranked.where(~F.col("_up")).drop("_up"))
        lifted = ranked.where("_up").drop("_up").withColumns({"_node": F.shiftright("_node", 3), "_level": F.lit(k)})
    done.append(lifted if lifted is not None else own)
    stays = F.col("_tile").bitwiseAND(F.lit((1 << KEY_BITS) - 1)) == F.col("_node")
    return reduce(DataFrame.unionByName, done).withColumn("_tile", F.when(stays, F.col("_tile")).otherwise(F.col("_node"))).drop("_level")


def levels_within(counts: dict[int, int], budget: int) -> tuple[int, int]:
    """The last of the levels, the coarsest first, that it takes to reach a budget, and the points of all of them."""
    last, total = 0, 0
    for level in sorted(counts):
        last, total = level, total + counts[level]
        if total >= budget:
            break
    return last, total


def node_table(points: DataFrame) -> DataFrame:
    """Of each display node and file its number of points: node, level, tile, file, n, and the bounds min_x .. max_z of
    all points in the node and below it."""
    own = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    at = points.where((F.col("_node") != NOWHERE) & F.col("valid")).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    nodes = at.groupBy(F.col("_node").alias("node"), F.col("_tile").alias("tile"), "file").agg(F.count("*").alias("n"), *own).withColumn("level", level_of(F.col("node")))
    up = F.explode(F.expr("transform(sequence(0, level), k -> shiftright(node, 3 * k))"))
    whole = [f(f"{n}_{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    below = nodes.withColumn("node", up).groupBy("node").agg(*whole)
    return nodes.select("node", "level", "tile", "file", "n").join(below, "node")
