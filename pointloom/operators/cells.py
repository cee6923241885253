"""Neighbours of points: a hash grid over arrays, and tables dealt out so that a task has all neighbours of its own points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import cell
from pointloom.session import checkpoint

#: Places that a group is to have on average, and beyond which it is split; levels of halving at which groups are tried.
FEW, MANY, LEVELS = 4_000, 60_000, (2, 4, 6, 8, 10, 12)
#: Cells by which the grid of groups lies aside, so that the origin is near a third of a group at every level.
OFF = 1365.5
#: Points that look for neighbours at once, and their candidates.
BLOCK, PAIRS = 4_000, 4_000_000
#: Points to an occupied cell from which a finer grid is looked through first.
CROWD = 8
#: Cells are wider than the reach by this factor, so that rounding cannot put a neighbour beyond them.
MARGIN = 1 + 1e-9


class Cells:
    """Points in a hash grid: nearest and all neighbours within the cells' size, for many points at once."""

    def __init__(self, points: np.ndarray, size: float, depth: int = 3):
        self.points, self.size, self.depth, self.fine = points, size * (1 + 1e-9), depth, None
        c = np.floor(points / self.size).astype(np.int64)
        self.order = np.lexsort((c[:, 2], c[:, 1], c[:, 0]))
        self.lo = c.min(0) if len(c) else np.zeros(3, np.int64)
        self.n = (c.max(0) - self.lo + 3) if len(c) else np.ones(3, np.int64)
        self.keys = self._key(c[self.order])

    def _key(self, c: np.ndarray) -> np.ndarray:
        d = c - self.lo + 1
        return (d[:, 0] * self.n[1] + d[:, 1]) * self.n[2] + d[:, 2]

    def pairs(self, p: np.ndarray, radius: float, block: int = 20_000):
        """Blocks of (index of p, index of a point, squared distance) with all points within radius, at most the size. A
        block is halved while it has more than PAIRS candidates."""
        todo = [(lo, min(lo + block, len(p))) for lo in range(0, len(p), block)][::-1]
        while todo:
            lo, hi = todo.pop()
            part = p[lo:hi]
            c = np.floor(part / self.size).astype(np.int64)
            ok = ((c >= self.lo - 1) & (c <= self.lo + self.n - 2)).all(1)
            rows, begins, ends = [], [], []
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    d = c + (dx, dy, 0)
                    k = np.flatnonzero(ok & (d[:, 0] >= self.lo[0] - 1) & (d[:, 0] <= self.lo[0] + self.n[0] - 2) & (d[:, 1] >= self.lo[1] - 1) & (d[:, 1] <= self.lo[1] + self.n[1] - 2))
                    key = self._key(d[k])
                    rows.append(k)
                    begins.append(np.searchsorted(self.keys, key - 1))
                    ends.append(np.searchsorted(self.keys, key + 1, side="right"))
            k, a, z = (np.concatenate(x) for x in (rows, begins, ends))
            n = z - a
            if n.sum() > PAIRS and hi - lo > 1:
                todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                continue
            i = np.repeat(k, n)
            j = self.order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            d2 = ((part[i] - self.points[j]) ** 2).sum(1)
            near = d2 <= radius * radius * (1 + 1e-12)
            yield i[near] + lo, j[near], d2[near]

    def nearest(self, p: np.ndarray, radius: float, itself: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the p that have a point within radius, and of their nearest ones. Where cells are crowded a grid of a
        quarter of the size answers first; only what it leaves open looks farther. itself: of each p the index of a point that is not meant."""
        if self.fine is None and self.size > 1e-9 and len(self.points) > 1000 and self.depth and len(self.points) >= CROWD * (1 + np.count_nonzero(np.diff(self.keys))):
            self.fine = Cells(self.points, self.size / 4, self.depth - 1)
        todo, found = np.arange(len(p)), []
        if self.fine is not None and radius > self.fine.size / (1 + 1e-9):
            i, j = self.fine.nearest(p, self.fine.size / (1 + 1e-9), itself)
            found.append((i, j))
            todo = np.setdiff1d(todo, i, assume_unique=True)
        for i, j, d2 in self.pairs(p[todo], radius):
            if itself is not None:
                other = itself[todo[i]] != j
                i, j, d2 = i[other], j[other], d2[other]
            order = np.lexsort((j, d2, i))
            i, j = i[order], j[order]
            first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
            found.append((todo[i[first]], j[first]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(i)
        return i[order], j[order]


def with_halo(places: DataFrame, reach: float, scan: str = "scan", many: int = MANY, few: int = FEW, at: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """places with own and a key (scan, _level, _kx, _ky, _kz): each in the group of its own cell (own) and in every other
    group that lies within reach, so that a group has all neighbours of its own places.

    Groups are cells of two reaches, halved together so far that they have `few` places on average; what has more than
    `many` is split again, down to single cells. A group is then at most what lies within a reach of one cell, or bounded.
    at: the columns by which places are dealt out. The origin, which points often lie around, is no border of groups."""
    s, side = reach * MARGIN, 2 * reach * MARGIN
    aside = side * OFF
    lows, highs, mids = (("_l", "_h", "_m")[k] for k in range(3))
    cut = places
    for c, p in zip("xyz", at, strict=True):
        cut = cut.withColumns({f"{lows}{c}": cell(F.col(p) + (aside - s), side), f"{highs}{c}": cell(F.col(p) + (aside + s), side), f"{mids}{c}": cell(F.col(p) + aside, side)})
    up = lambda name, k: F.shiftright(F.col(name), k)
    told = cut.agg(F.count("*").alias("n"), *(F.approx_count_distinct(F.xxhash64(scan, *(up(f"{mids}{c}", k) for c in "xyz"))).alias(f"c{k}") for k in LEVELS)).first()
    level = next((k for k in LEVELS if told["n"] >= few * told[f"c{k}"]), LEVELS[-1])
    keys, out, parent = ["_kx", "_ky", "_kz"], [], None
    while True:
        rows = cut
        for c, key in zip("xyz", keys, strict=True):
            rows = rows.withColumn(f"{key}n", F.explode(F.array_distinct(F.array(up(f"{lows}{c}", level), up(f"{highs}{c}", level)))))
        if parent is not None:  # only what lies in the cell that is split
            rows = rows.where(reduce(lambda a, b: a & b, (F.shiftright(f"{key}n", parent - level) == F.col(key) for key in keys)))
        rows = rows.drop(*keys).withColumnsRenamed({f"{key}n": key for key in keys})
        rows = rows.withColumn("own", reduce(lambda a, b: a & b, (F.col(key) == up(f"{mids}{c}", level) for key, c in zip(keys, "xyz", strict=True))))
        full = rows.where("own").groupBy(scan, *keys).agg(F.count("*").alias("_n")).where(F.col("_n") > many).drop("_n")
        if level == 0 or full.isEmpty():
            out.append(rows.withColumn("_level", F.lit(level)))
            break
        full = F.broadcast(full)  # a row for so many places
        out.append(rows.join(full, [scan, *keys], "left_anti").withColumn("_level", F.lit(level)))
        cut, parent, level = rows.join(full, [scan, *keys], "left_semi").drop("own"), level, level // 2
    return reduce(DataFrame.unionByName, out).select(*places.columns, "own", "_level", *keys)


def by_groups(places: DataFrame, reach: float, schema: str, work: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], scan: str = "scan") -> DataFrame:
    """What `work` says of each asked place: scan, x, y, z and the columns of schema. places: scan, x, y, z, copies and
    asked. work gets a group's coordinates, copies, and which rows are asked about, and gives a value for each of these."""
    rows = with_halo(checkpoint(places), reach, scan)  # counted, then dealt out
    kind = places.schema[scan].dataType.simpleString()
    names, none = [c.split()[0] for c in schema.split(", ")], [pa.array([], {"long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        asked = np.flatnonzero(np.asarray(t.column("own")) & np.asarray(t.column("asked")))
        some = t.select([scan, "x", "y", "z"]).take(pa.array(asked))
        values = work(np.stack([t.column(c).to_numpy() for c in "xyz"], 1), t.column("copies").to_numpy(), asked) if len(asked) else none
        for name, v in zip(names, values, strict=True):
            some = some.append_column(name, v if isinstance(v, pa.Array) else pa.array(v))
        return some

    return rows.groupBy(scan, "_level", "_kx", "_ky", "_kz").applyInArrow(run, f"{scan} {kind}, x double, y double, z double, {schema}")


def nearest_means(k: int, reach: float):
    """For by_groups: the mean distance of each asked place to the k nearest other points within reach; NaN with fewer."""

    def work(p: np.ndarray, copies: np.ndarray, asked: np.ndarray):
        n, total = np.zeros(len(asked), np.int64), np.zeros(len(asked))
        for i, j, d2 in Cells(p, reach, 0).pairs(p[asked], reach, BLOCK):
            others = copies[j] - (asked[i] == j)
            keep = (others > 0) & (d2 <= reach * reach)
            i, d2, others = i[keep], d2[keep], others[keep]
            order = np.lexsort((d2, i))
            i, d2, others = i[order], d2[order], others[order]
            upto = np.cumsum(others) - others
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), bool), i[1:] != i[:-1]]))
            before = upto - np.repeat(upto[first], np.diff(np.append(first, len(i))))
            taken = np.clip(k - before, 0, others)
            n += np.bincount(i, taken, len(asked)).astype(np.int64)
            total += np.bincount(i, np.sqrt(d2) * taken, len(asked))
        return (pa.array(np.where(n >= k, total / k, 0.0), mask=n < k),)

    return work
