"""Grids and levels of detail, and the choice of nodes for a view."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import Bounds, Camera, distance2, xyz

#: Cells along a node's longest side.
GRID = 128
#: Points of a bucket whose order is found in one task.
RANKED = 100_000
#: Below this ratio of a node's radius to its distance its children are not looked at.
SMALLEST = 0.015


def chunk_stats(points: DataFrame, size: float, scan: str = "scan") -> DataFrame:
    """Of each cell of a scan the number of points and their bounds."""
    cells = [F.floor(v / size).cast("long").alias(n) for v, n in zip(xyz(), ("cx", "cy", "cz"), strict=True)]
    own = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return points.select("*", *cells).groupBy(scan, "cx", "cy", "cz").agg(F.count("*").alias("n"), *own)


def grid_counts(points: DataFrame, size: float, levels: int) -> DataFrame:
    """level, cx, cy, cz, n: counts on a grid and on coarser ones, each of twice the last one's size."""
    base = points.groupBy(*(F.floor(v / size).cast("long").alias(n) for v, n in zip(xyz(), ("cx", "cy", "cz"), strict=True))).agg(F.count("*").alias("n"))
    up = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), *(F.shiftright(c, k).alias(c) for c in ("cx", "cy", "cz"))) for k in range(levels + 1))))
    return base.select("n", up.alias("c")).groupBy("c.level", "c.cx", "c.cy", "c.cz").agg(F.sum("n").alias("n"))


def grid_pick(points: DataFrame, size: float, grid: int, ref: tuple[str, ...], scan: str = "scan") -> DataFrame:
    """One point of each cell of a node's grid, nearest the cell's centre, ties to the least ref: scan, nx, ny, nz, ref.

    Nodes are cubes of the given size; each is cut in grid cells a side."""
    node = [F.floor(v / size).cast("long").alias(n) for v, n in zip(xyz(), ("nx", "ny", "nz"), strict=True)]
    step = size / grid
    cells = [F.floor(v / step).cast("long").alias(n) for v, n in zip(xyz(), ("cx", "cy", "cz"), strict=True)]
    centre = tuple((F.col(c).cast("double") + 0.5) * step for c in ("cx", "cy", "cz"))
    best = F.min(F.struct(distance2(xyz(), centre).alias("d2"), *ref)).alias("b")
    out = points.select("*", *node, *cells).groupBy(scan, "nx", "ny", "nz", "cx", "cy", "cz").agg(best)
    return out.select(scan, "nx", "ny", "nz", *(F.col(f"b.{r}").alias(r) for r in ref))


def additive_levels(points: DataFrame, lo: tuple[float, float, float], size: float, depth: int, ref: tuple[str, ...], scan: str = "scan", grid: int = GRID) -> DataFrame:
    """points with level, nx, ny, nz: the display node that holds each, exactly one.

    From the root down a node takes the point nearest the centre of each of its grid's cells; the others go on to its
    children, and the deepest level takes all that is left. One window for each level.
    """
    left, out = points, None
    for level in range(depth + 1):
        side = size / (1 << level)
        node = [F.floor((v - float(a)) / side).cast("int").alias(n) for v, a, n in zip(xyz(), lo, ("nx", "ny", "nz"), strict=True)]
        here = left.select("*", *node).withColumn("level", F.lit(level))
        if level == depth:
            return here if out is None else out.unionByName(here)
        step = side / grid
        cells = [F.floor((v - float(a)) / step).cast("long").alias(n) for v, a, n in zip(xyz(), lo, ("_cx", "_cy", "_cz"), strict=True)]
        centre = tuple((F.col(c).cast("double") + 0.5) * step + float(a) for c, a in zip(("_cx", "_cy", "_cz"), lo, strict=True))
        marked = here.select("*", *cells)
        best = marked.groupBy(scan, "_cx", "_cy", "_cz").agg(F.min(F.struct(distance2(xyz(), centre).alias("d2"), *ref)).alias("_b")).select(scan, *(F.col(f"_b.{r}").alias(r) for r in ref))
        taken = here.join(best, [scan, *ref], "left_semi")
        out = taken if out is None else out.unionByName(taken)
        left = here.join(best, [scan, *ref], "left_anti").select(points.columns)
    return out


def view_nodes(levels: DataFrame, scan: str = "scan") -> DataFrame:
    """Of each display node the number of its own points and their bounds."""
    own = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return levels.groupBy(scan, "level", "nx", "ny", "nz").agg(F.count("*").alias("n"), *own)


@dataclass(frozen=True)
class Node:
    """A display node: key (scan, level, nx, ny, nz), bounds in project coordinates, and how many visible points it has."""

    key: tuple
    bounds: Bounds
    count: int

    @property
    def parent(self) -> tuple | None:
        scan, level, *c = self.key
        return (scan, level - 1, *(v >> 1 for v in c)) if level else None


def nodes_of(stats: DataFrame, scan: str = "scan") -> list[Node]:
    """The nodes of view_nodes() on the driver: their number is that of grid nodes, not of points."""
    return [Node((r[scan], r["level"], r["nx"], r["ny"], r["nz"]), Bounds((r["min_x"], r["min_y"], r["min_z"]), (r["max_x"], r["max_y"], r["max_z"])), r["n"]) for r in stats.toLocalIterator()]


def select_view(nodes: list[Node], camera: Camera, budget: int) -> list[tuple[Node, int]]:
    """The nodes to show, with how many points of each: the best first, by radius over distance.

    Roots that exceed the budget share it in proportion. The first node that does not fit ends the choice. A node's
    children are looked at if it is near enough, and they are in view and not empty.
    """
    children: dict[tuple, list[Node]] = {}
    roots = []
    for n in nodes:
        if n.parent is None:
            roots.append(n)
        else:
            children.setdefault(n.parent, []).append(n)

    def weight(n: Node) -> float:
        if camera.orthographic:
            return n.bounds.radius / camera.distance
        far = float(((n.bounds.center - camera.eye) ** 2).sum() ** 0.5)
        return n.bounds.radius / max(far - n.bounds.radius, 1e-9) if far > n.bounds.radius else 1e9

    shown = [n for n in roots if n.count and camera.sees(n.bounds)]
    total = sum(n.count for n in shown)
    if total > budget:
        return [(n, budget * n.count // total) for n in shown]
    heap = [(-weight(n), k, n) for k, n in enumerate(shown)]
    heapq.heapify(heap)
    out, used, serial = [], 0, len(heap)
    while heap:
        w, _, n = heapq.heappop(heap)
        if used + n.count > budget:
            break
        used += n.count
        out.append((n, n.count))
        if -w > SMALLEST:
            for c in children.get(n.key, ()):
                if c.count and camera.sees(c.bounds):
                    serial += 1
                    heapq.heappush(heap, (-weight(c), serial, c))
    return out


def estimates(nodes: list[Node]) -> dict[tuple, int]:
    """Points of each node and all below it."""
    out: dict[tuple, int] = {}
    for n in sorted(nodes, key=lambda n: -n.key[1]):
        out[n.key] = out.get(n.key, 0) + n.count
        if n.parent is not None:
            out[n.parent] = out.get(n.parent, 0) + out[n.key]
    return out


def thinned(points: DataFrame, quotas: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], ranked: int = RANKED) -> DataFrame:
    """Of each group of n points the elements i * n / quota, by order, whose first column is a number. quotas: keys and
    quota.

    A group is cut into buckets of the first column's range, of about `ranked` points where it is even; counts of buckets
    give each its first index, so that no window holds a group.
    """
    first = F.col(order[0])
    own = points.join(F.broadcast(quotas), list(keys))  # a row for each node in view
    span = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(first).cast("double").alias("_lo"), F.max(first).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.ceil(F.col("_n") / ranked) * (1 + 1e-9)
    span = span.select(*keys, "_n", "_lo", F.when(width > 0, width).otherwise(1.0).alias("_width"))
    own = own.join(F.broadcast(span), list(keys)).withColumn("_b", F.floor((first.cast("double") - F.col("_lo")) / F.col("_width")))
    counts = own.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = own.join(counts.select(*keys, "_b", before.alias("_before")), [*keys, "_b"])
    own = placed.withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    # element i is chosen if some k has floor(k * n / quota) = i
    k = F.ceil(F.col("_i") * F.col("quota") / F.col("_n"))
    chosen = (F.col("quota") >= F.col("_n")) | ((k < F.col("quota")) & (F.floor(k * F.col("_n") / F.col("quota")) == F.col("_i")))
    return own.where(chosen).drop("_i", "_n", "_lo", "_width", "_b", "_before", "quota")


def view_points(levels: DataFrame, chosen: list[tuple[Node, int]], ref: tuple[str, ...], scan: str = "scan") -> DataFrame:
    """The points of chosen nodes, thinned to their numbers, with 32-bit offsets dx, dy, dz from the node's centre."""
    keys = (scan, "level", "nx", "ny", "nz")
    kind = levels.schema[scan].dataType.simpleString()
    rows = [(*n.key, *(float(c) for c in n.bounds.center), q) for n, q in chosen]
    nodes = levels.sparkSession.createDataFrame(rows, f"{scan} {kind}, level int, nx int, ny int, nz int, ox double, oy double, oz double, quota int")
    own = thinned(levels, nodes.select(*keys, "ox", "oy", "oz", "quota"), keys, ref)
    return own.select("*", *((F.col(c) - F.col(f"o{c}")).cast("float").alias(f"d{c}") for c in "xyz"))


def view_spacings(points: DataFrame, chosen: list[tuple[Node, int]], scan: str = "scan", grid: int = GRID) -> DataFrame:
    """points with spacing: the longest side over grid of the deepest chosen node whose box holds them; null of none.

    Chosen nodes are a view's, so few: each scan's are sent to every task as one array."""
    rows = [(n.key[0], n.key[1], *(float(v) for v in (*n.bounds.lo, *n.bounds.hi)), max(b - a for a, b in zip(n.bounds.lo, n.bounds.hi, strict=True)) / grid) for n, _ in chosen]
    kind = points.schema[scan].dataType.simpleString()
    boxes = points.sparkSession.createDataFrame(rows, f"{scan} {kind}, _level int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, _s double")
    listed = boxes.groupBy(scan).agg(F.collect_list(F.struct("_level", "x0", "y0", "z0", "x1", "y1", "z1", "_s")).alias("_boxes"))
    own = points.join(F.broadcast(listed), scan, "left")  # a row for each scan in view
    x, y, z = xyz()
    holds = F.filter("_boxes", lambda b: (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"]) & (z >= b["z0"]) & (z <= b["z1"]))
    deepest = F.aggregate(holds, F.struct(F.lit(-1).alias("level"), F.lit(None).cast("double").alias("s")), lambda a, b: F.when(b["_level"] > a["level"], F.struct(b["_level"].alias("level"), b["_s"].alias("s"))).otherwise(a))
    return own.withColumn("spacing", deepest["s"]).drop("_boxes")


def nearest_pick(points: DataFrame, camera: Camera, u: float, v: float, reach: float, ref: tuple[str, ...]) -> DataFrame:
    """The point in view that is picked at a place of it: the nearest one there within reach, the front one of equals; one
    row, or none."""
    at = points.select(*ref, "x", "y", "z", camera.project(xyz()).alias("p")).where("p IS NOT NULL")
    off = (F.col("p.u") - u) * (F.col("p.u") - u) + (F.col("p.v") - v) * (F.col("p.v") - v)
    return at.select(*ref, "x", "y", "z", off.alias("off"), F.col("p.w").alias("depth")).where(F.col("off") <= reach * reach).orderBy("off", "depth", *ref).limit(1)
