"""Spatial filters. Each takes points (x, y, z, a scan, and columns that tell its points apart) and returns those that
it would move to another layer, so that a caller relabels them; points are never changed."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import CLIPPED, CropBox, Selection, Xyz, cell, distance2, xyz
from pointloom.operators import cells
from pointloom.session import checkpoint

#: Cells around a cell, itself among them.
AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
#: The shares of the reach in which nearest neighbours are looked for, one after another.
SHARES_OF_REACH = (1 / 8, 1.0)
#: Halvings of a reach at which a search may begin, and the places of a cell at the first, on average over the places.
FINER, SHARED = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16), 8
#: Wide cells of all scans' range images that are broadcast at most, but for one a scan.
COARSE_CELLS = 500_000
#: A radius join's cells are wider than the radius by this factor, so that rounding cannot put a neighbour two away.
MARGIN = 1 + 1e-9


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not (math.isfinite(v) and v > 0):
            raise ValueError(f"{name} must be positive")


# ---- voxels -----------------------------------------------------------------------------------------------------------


def voxel_winners(points: DataFrame, size: float, ref: tuple[str, ...], scan: str | None = "scan") -> DataFrame:
    """The point nearest the centre of each voxel, ties to the least ref: scan (if any), cx, cy, cz, ref.

    One aggregation with partial sums on the map side: a voxel that holds a third of all points is no hot spot.
    """
    _positive(size=size)
    p = xyz()
    cells = [cell(c, size).alias(n) for c, n in zip(p, ("cx", "cy", "cz"), strict=True)]
    centre = tuple((F.col(n).cast("double") + 0.5) * size for n in ("cx", "cy", "cz"))
    keys = [*([scan] if scan else []), "cx", "cy", "cz"]
    best = F.min(F.struct(distance2(p, centre).alias("d2"), *ref)).alias("best")
    out = points.select("*", *cells).groupBy(*keys).agg(best)
    return out.select(*keys, *(F.col(f"best.{r}").alias(r) for r in ref))


def voxel_subsample(points: DataFrame, size: float, ref: tuple[str, ...], scan: str = "scan") -> DataFrame:
    """Points that are not the nearest of their voxel, within each scan, in the scan's own coordinates."""
    return points.join(voxel_winners(points, size, ref, scan).select(scan, *ref), [scan, *ref], "left_anti")


def voxel_subsample_merged(points: DataFrame, size: float, ref: tuple[str, ...]) -> DataFrame:
    """The same over one grid for all scans, in project coordinates; ref begins with the scan's place in the order."""
    return points.join(voxel_winners(points, size, ref, None).select(*ref), list(ref), "left_anti")


# ---- neighbours ---------------------------------------------------------------------------------------------------------


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a left and a right point at most radius apart, both sides' columns and d2. The sides' columns differ but
    for `on`, which must be equal; coordinates are lx, ly, lz and rx, ry, rz.

    An equi-join on cells as wide as two radii: each left point looks into the two cells along each axis that its reach
    meets, eight in all. Spark splits cells of uneven size.
    """
    _positive(radius=radius)
    reach = radius * MARGIN
    keys = ["_cx", "_cy", "_cz"]
    ends = [F.array(cell(F.col(c) - reach, 2 * reach), cell(F.col(c) + reach, 2 * reach)) for c in ("lx", "ly", "lz")]
    a = left
    for k, e in zip(keys, ends, strict=True):
        a = a.withColumn(k, F.explode(F.array_distinct(e)))
    b = right.select("*", *(cell(F.col(c), 2 * reach).alias(k) for c, k in zip(("rx", "ry", "rz"), keys, strict=True)))
    d2 = distance2(xyz("lx", "ly", "lz"), xyz("rx", "ry", "rz"))
    return a.join(b, [*on, *keys]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop(*keys)


def finite() -> Column:
    """Whether x, y and z are numbers that have a distance."""
    x, y, z = xyz()
    return ((x - x) + (y - y) + (z - z)) == 0


def nearest_pairs(asked: DataFrame, to: DataFrame, reach: float, ref: tuple[str, ...], known: tuple[str, ...], on: tuple[str, ...] = (), itself: bool = False) -> DataFrame:
    """Of each asked place (ref, lx, ly, lz) that has one of `to` (known, rx, ry, rz) within reach, the nearest, ties to the
    least known: ref, d2 and known. on: columns of ref that both sides must have equal. itself: a place that equals the
    asked one does not count.

    The first radius is so small that a place of `to` shares its cell with few others on average. Who finds none looks
    twice as far, up to the reach: having found none within half, it meets few. Places must differ, so that a pile of
    copies is met once.
    """
    _positive(reach=reach)
    own, names = checkpoint(to), ("rx", "ry", "rz")
    finest = reach / (1 << max(FINER))
    at = own.select(*on, *(cell(F.col(c), 2 * finest * MARGIN).alias(f"_{c}") for c in names))
    counts = at.groupBy(*on, *(f"_{c}" for c in names)).agg(F.count("*").alias("_n"))
    start = 0
    for k in sorted(FINER):  # from the widest cells on
        wide = counts.groupBy(*on, *(F.shiftright(f"_{c}", max(FINER) - k).alias(f"_{c}") for c in names)).agg(F.sum("_n").alias("_n"))
        told = wide.agg(F.sum(F.col("_n").cast("double") * F.col("_n")).alias("pairs"), F.sum("_n").alias("n")).first()
        start = k
        if not told["n"] or told["pairs"] <= SHARED * told["n"]:
            break
    left, out = checkpoint(asked), None
    for k in range(start, -1, -1):
        radius = reach / (1 << k)
        pairs = radius_pairs(left, own, radius, on)
        if itself:
            pairs = pairs.where((F.col("lx") != F.col("rx")) | (F.col("ly") != F.col("ry")) | (F.col("lz") != F.col("rz")))
        best = checkpoint(pairs.groupBy(*ref).agg(F.min(F.struct("d2", *known)).alias("_b")).select(*ref, "_b.*"))
        out = best if out is None else out.unionByName(best)
        if k:
            left = checkpoint(left.join(best.select(*ref), list(ref), "left_anti"))
            if left.isEmpty():
                break
    return out


def places(points: DataFrame, scan: str = "scan") -> DataFrame:
    """scan, x, y, z and copies: points at one place are one row, so that a pile of copies meets others once."""
    return points.groupBy(scan, "x", "y", "z").agg(F.count("*").alias("copies"))


def place_pairs(asked: DataFrame, own: DataFrame, reach: float, scan: str = "scan") -> DataFrame:
    """Pairs of an asked place and one of the same scan within reach: scan, lx, ly, lz, d2 and others, the number of
    points there; without the asked point itself."""
    left = asked.select(scan, *(F.col(c).alias(f"l{c}") for c in "xyz"))
    right = own.select(scan, *(F.col(c).alias(f"r{c}") for c in "xyz"), "copies")
    same = (F.col("lx") == F.col("rx")) & (F.col("ly") == F.col("ry")) & (F.col("lz") == F.col("rz"))
    pairs = radius_pairs(left, right, reach, (scan,)).withColumn("others", F.col("copies") - F.when(same, 1).otherwise(0))
    return pairs.where("others > 0").select(scan, "lx", "ly", "lz", "d2", "others")


def neighbour_counts(points: DataFrame, radius: float, ref: tuple[str, ...], scan: str = "scan", of: DataFrame | None = None) -> DataFrame:
    """scan, ref and n: the other points of the scan within radius, at the same place too; 0 for none. of: the points
    that are asked about, if not all.

    Points of one place are met as one row with its number, so that a pile of copies does not square.
    """
    of = points if of is None else of
    left = of.select(scan, *ref, *(F.col(c).alias(f"l{c}") for c in "xyz"))
    right = places(points, scan).withColumnsRenamed({c: f"r{c}" for c in "xyz"})
    return radius_pairs(left, right, radius, (scan,)).groupBy(scan, *ref).agg((F.sum("copies") - 1).alias("n"))  # it meets itself


def remove_noise(points: DataFrame, radius: float, min_neighbours: int, ref: tuple[str, ...], scan: str = "scan") -> DataFrame:
    """Points with fewer than min_neighbours others of their scan within radius.

    All points of a cell whose diagonal is the radius are neighbours of each other. A cell with more than min_neighbours
    of them has none to move, so only points of sparser cells look for neighbours: where points are dense, none do.
    """
    _positive(radius=radius)
    side = radius / math.sqrt(3) * (1 - 1e-9)
    cells = [cell(c, side).alias(n) for c, n in zip(xyz(), ("_dx", "_dy", "_dz"), strict=True)]
    own = points.select("*", *cells)
    dense = own.groupBy(scan, "_dx", "_dy", "_dz").agg(F.count("*").alias("_n")).where(F.col("_n") > min_neighbours)
    sparse = own.join(dense, [scan, "_dx", "_dy", "_dz"], "left_anti").select(points.columns)
    few = neighbour_counts(points, radius, ref, scan, sparse).where(F.col("n") < min_neighbours)
    return points.join(few.select(scan, *ref), [scan, *ref], "left_semi")


def mean_distances(points: DataFrame, k: int, reach: float, ref: tuple[str, ...], scan: str = "scan") -> DataFrame:
    """scan, ref and m: the mean distance to the k nearest others of the scan within reach; null if they are fewer.

    Points at one place count as one row with its number. Those that have k neighbours within a small share of the reach
    are done with it: those are their nearest. Only the others look farther, so that where points are dense none meets
    all others within reach.
    """
    if not 1 <= k <= 256:
        raise ValueError("neighbours must be 1 to 256")
    place = [scan, "x", "y", "z"]
    own, found = checkpoint(places(points, scan)).withColumn("asked", F.lit(True)), None
    for share in SHARES_OF_REACH:
        told = cells.by_groups(own, reach * share, "m double", cells.nearest_means(k, reach * share), scan)
        if share < SHARES_OF_REACH[-1]:
            told = checkpoint(told)
            left = told.where("m IS NULL").select(*place, F.lit(True).alias("_open"))
            own = own.drop("asked").join(left, place, "left").select(*place, "copies", F.col("_open").isNotNull().alias("asked"))
        done = told.where("m IS NOT NULL")
        found = done if found is None else found.unionByName(done)
    return points.join(found, place, "left").select(scan, *ref, "m")


def outlier_limits(distances: DataFrame, deviations: float, scan: str = "scan") -> DataFrame:
    """Of each scan the mean of m, its deviation over all points that have one, and the limit."""
    mu, square = F.avg("m"), F.avg(F.col("m") * F.col("m"))
    sigma = F.sqrt(F.greatest(square - mu * mu, F.lit(0.0)))
    return distances.groupBy(scan).agg(mu.alias("mu"), sigma.alias("sigma"), (mu + sigma * deviations).alias("most"))


def remove_outliers(points: DataFrame, k: int, deviations: float, reach: float, ref: tuple[str, ...], scan: str = "scan") -> DataFrame:
    """Points without k others within reach, or whose mean distance to them is over the scan's mean by more than so many
    deviations."""
    if deviations < 0:
        raise ValueError("deviations must not be negative")
    m = mean_distances(points, k, reach, ref, scan)
    out = m.join(F.broadcast(outlier_limits(m, deviations, scan)), scan).where(F.col("m").isNull() | (F.col("m") > F.col("most")))  # a row for each scan
    return points.join(out.select(scan, *ref), [scan, *ref], "left_semi")


# ---- overlap ------------------------------------------------------------------------------------------------------------


def overlap_densities(points: DataFrame, size: float, scan: str = "scan") -> DataFrame:
    """scan, cx, cy, cz and n: the scan's points in each cell and the 26 around it, for cells that have any of these."""
    counts = points.groupBy(scan, *(cell(c, size).alias(n) for c, n in zip(xyz(), ("cx", "cy", "cz"), strict=True))).agg(F.count("*").alias("own"))
    to = F.explode(F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(("cx", "cy", "cz"), o, strict=True))) for o in AROUND)))
    return counts.select(scan, "own", to.alias("c")).groupBy(scan, "c.cx", "c.cy", "c.cz").agg(F.sum("own").alias("n"))


def overlap_winners(points: DataFrame, size: float, scanners: DataFrame | None = None, scan: str = "scan") -> DataFrame:
    """The scan that each occupied eighth of a cell's edge keeps: cx, cy, cz, sx, sy, sz, scan, density.

    Of the scans with points in the sub-cell, that of the highest density at its centre, interpolated between the eight
    cell centres around; then of the nearer scanner (scanners: scan, sx, sy, sz in project coordinates; unknown ones are
    last), then the first by scan.
    """
    _positive(size=size)
    p = xyz()
    g = [c / size for c in p]
    names = ("cx", "cy", "cz")
    sub = [F.least(F.greatest(F.floor((q - F.floor(q)) * 8), F.lit(0)), F.lit(7)).cast("long").alias(f"s{n[1]}") for q, n in zip(g, names, strict=True)]
    held = points.select(scan, *(F.floor(q).cast("long").alias(n) for q, n in zip(g, names, strict=True)), *sub).distinct()
    at = {n: (F.col(f"s{n[1]}") + 0.5) / 8 - 0.5 for n in names}  # from the cell's own centre, in cells
    weight = {n: at[n] - F.floor(at[n]) for n in names}
    corners = []
    for k in range(8):
        d = [k >> a & 1 for a in range(3)]
        w = [weight[n] if b else 1 - weight[n] for n, b in zip(names, d, strict=True)]
        corners.append(F.struct(*((F.col(n) + F.floor(at[n]).cast("long") + b).alias(f"k{n[1]}") for n, b in zip(names, d, strict=True)), ((w[0] * w[1]) * w[2]).alias("w"), F.lit(k).alias("k")))
    each = held.select("*", F.explode(F.array(*corners)).alias("c")).select(*held.columns, "c.*")
    dense = overlap_densities(points, size, scan).select(scan, F.col("cx").alias("kx"), F.col("cy").alias("ky"), F.col("cz").alias("kz"), "n")
    parts = each.join(dense, [scan, "kx", "ky", "kz"], "left").groupBy(*held.columns).agg(F.array_sort(F.collect_list(F.struct("k", (F.col("w") * F.coalesce("n", F.lit(0))).alias("v")))).alias("parts"))
    density = F.aggregate("parts", F.lit(0.0), lambda a, q: a + q["v"])  # always added in the corners' order
    scored = parts.select(*held.columns, density.alias("density"))
    if scanners is None:
        scored = scored.withColumn("far", F.lit(float("inf")))
    else:
        centre = tuple((F.col(n) + (F.col(f"s{n[1]}") + 0.5) / 8) * size for n in names)
        own = scanners.select(scan, *(F.col(f"s{c}").alias(f"o{c}") for c in "xyz"))
        scored = scored.join(F.broadcast(own), scan, "left").withColumn("far", F.coalesce(distance2(centre, xyz("ox", "oy", "oz")), F.lit(float("inf"))))  # a row for each scan
    best = F.min(F.struct((-F.col("density")).alias("least"), "far", F.col(scan).alias("scan"))).alias("best")
    keys = [c for c in held.columns if c != scan]
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("best.scan").alias("scan"), (-F.col("best.least")).alias("density"))


def reduce_overlap(points: DataFrame, size: float, ref: tuple[str, ...], scanners: DataFrame | None = None, scan: str = "scan") -> DataFrame:
    """Points in sub-cells that another scan keeps. points are in project coordinates."""
    keys = ["cx", "cy", "cz", "sx", "sy", "sz"]
    g = [c / size for c in xyz()]
    cells = [F.floor(q).cast("long").alias(n) for q, n in zip(g, keys[:3], strict=True)]
    sub = [F.least(F.greatest(F.floor((q - F.floor(q)) * 8), F.lit(0)), F.lit(7)).cast("long").alias(n) for q, n in zip(g, keys[3:], strict=True)]
    own = points.select(scan, *ref, *cells, *sub)
    lost = own.join(overlap_winners(points, size, scanners, scan).select(*keys, F.col("scan").alias("winner")), keys).where(F.col(scan) != F.col("winner"))
    return points.join(lost.select(scan, *ref), [scan, *ref], "left_semi")


# ---- moving objects -------------------------------------------------------------------------------------------------------


def sphere_cell(q: Xyz, degrees: float) -> tuple[Column, Column, Column]:
    """Column (azimuth), row (elevation) and range of a direction from the origin; null within a micrometre of it."""
    size = math.radians(degrees)
    columns, rows = math.ceil(2 * math.pi / size), math.ceil(math.pi / size)
    r = F.sqrt((q[0] * q[0] + q[1] * q[1]) + q[2] * q[2])
    ok = r >= 1e-6
    azimuth, elevation = F.atan2(q[1], q[0]) + math.pi, F.asin(F.least(F.greatest(q[2] / r, F.lit(-1.0)), F.lit(1.0))) + math.pi / 2
    to = lambda a, n: F.when(ok, F.least(F.floor(a / size).cast("int"), F.lit(n - 1)))
    return to(azimuth, columns), to(elevation, rows), F.when(ok, r)


def range_images(points: DataFrame, degrees: float, scan: str = "scan") -> DataFrame:
    """scan, col, row and range (32 bits): the nearest range of each cell around a scanner; points in its own frame."""
    col, row, r = sphere_cell(xyz(), degrees)
    return points.select(scan, col.alias("col"), row.alias("row"), r.cast("float").alias("r")).where("r IS NOT NULL").groupBy(scan, "col", "row").agg(F.min("r").alias("range"))


def eroded(images: DataFrame, degrees: float, scan: str = "scan") -> DataFrame:
    """The least of each cell and the eight around it, around the full turn of azimuth; cells with none stay away."""
    size = math.radians(degrees)
    columns, rows = math.ceil(2 * math.pi / size), math.ceil(math.pi / size)
    to = F.explode(F.array(*(F.struct(F.pmod(F.col("col") + i, F.lit(columns)).cast("int").alias("col"), (F.col("row") + j).alias("row")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    each = images.select(scan, "range", to.alias("c")).select(scan, "range", "c.*").where(F.col("row").between(0, rows - 1))
    return each.groupBy(scan, "col", "row").agg(F.min("range").alias("range"))


def _coarse(degrees: float, scans: int) -> int:
    """The least number of cells, along both axes, of a wide cell such that all scans together have COARSE_CELLS of them
    at most, or one each."""
    size = math.radians(degrees)
    columns, rows = math.ceil(2 * math.pi / size), math.ceil(math.pi / size)
    k = max(1, math.isqrt(scans * columns * rows // COARSE_CELLS))
    while k < columns and scans * math.ceil(columns / k) * math.ceil(rows / k) > COARSE_CELLS:
        k += 1
    return k


def remove_moving(points: DataFrame, frames: dict, ref: tuple[str, ...], degrees: float = 0.1, tolerance: float = 0.05, min_scans: int = 2, scan: str = "scan") -> DataFrame:
    """Points (project coordinates) past which min_scans other scans measured, in their direction.

    frames: for each scan with a known scanner, the 4 x 4 matrix from project to its own coordinates. A scan measured
    past a point if the eroded image's range there is more than the point's range, tolerance and a cell's width at it.
    Points meet a scan's image only where some cell of a wide one around it is that far; the wide cells are broadcast.
    """
    if not (0.01 <= degrees <= 5 and tolerance >= 0 and 1 <= min_scans <= 255):
        raise ValueError("cells must be 0.01 to 5 degrees, tolerance not negative, scans 1 to 255")
    spark = points.sparkSession
    kind = points.schema[scan].dataType
    rows = [(s, *(float(v) for v in np.asarray(m)[:3].ravel())) for s, m in frames.items()]
    fields = ", ".join(f"m{i}{j} double" for i in range(3) for j in range(4))
    seen_by = spark.createDataFrame(rows, f"seer {kind.simpleString()}, {fields}")  # a row for each scan
    placed = lambda df: df.select("*", *(((F.col(f"m{i}0") * F.col("x") + F.col(f"m{i}1") * F.col("y")) + F.col(f"m{i}2") * F.col("z") + F.col(f"m{i}3")).alias(f"q{i}") for i in range(3)))
    own = placed(points.join(F.broadcast(seen_by), F.col(scan) == F.col("seer")))
    image = eroded(range_images(own.select(F.col("seer").alias("s"), F.col("q0").alias("x"), F.col("q1").alias("y"), F.col("q2").alias("z")), degrees, "s"), degrees, "s").where("s IS NOT NULL AND col IS NOT NULL AND row IS NOT NULL")  # alike in both uses, so that its exchange serves both
    col, row, r = sphere_cell(xyz("q0", "q1", "q2"), degrees)
    seen = placed(points.select(scan, *ref, "x", "y", "z").join(F.broadcast(seen_by), F.col(scan) != F.col("seer")))
    looked = seen.select(scan, *ref, "seer", col.alias("col"), row.alias("row"), r.alias("r")).where("r IS NOT NULL")
    beyond = lambda c: F.col(c).cast("double") > F.col("r") + tolerance + F.col("r") * math.radians(degrees)
    k = _coarse(degrees, len(frames))
    wide = lambda c: F.coalesce(F.floor(F.col(c) / k).cast("int"), F.lit(-1)).alias(f"wide_{c}")
    farthest = image.groupBy(F.col("s").alias("seer"), wide("col"), wide("row")).agg(F.max("range").alias("farthest"))
    looked = looked.select("*", wide("col"), wide("row")).join(F.broadcast(farthest), ["seer", "wide_col", "wide_row"]).where(beyond("farthest")).select(scan, *ref, "seer", "col", "row", "r")
    hit = looked.join(image.withColumnRenamed("s", "seer"), ["seer", "col", "row"])
    past = hit.where(beyond("range"))
    out = past.groupBy(scan, *ref).agg(F.count("*").alias("n")).where(F.col("n") >= min_scans)
    return points.join(out.select(scan, *ref), [scan, *ref], "left_semi")


# ---- boxes and selections ---------------------------------------------------------------------------------------------------


def move_box(points: DataFrame, box: CropBox, inside: bool) -> DataFrame:
    """Points in the box, or those outside it. Inside, an axis-aligned condition lets Parquet skip what is far off."""
    box.check()
    p = xyz()
    return points.where(box.around(p) & box.contains(p)) if inside else points.where(~box.contains(p))


def _clip() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in CLIPPED)


def selection_nearest(points: DataFrame, selection: Selection) -> DataFrame:
    """One row: nearest, the least depth of the points in the selection; null without any."""
    selection.check()
    return selection.clipped(points.select("x", "y", "z")).agg(F.min(selection.contains(xyz(), _clip())).alias("nearest"))


def move_selection(points: DataFrame, selection: Selection, nearest: float | None = None) -> DataFrame:
    """The selected points. With a limited depth the nearest point's depth, if it is not given, is found first, in a pass
    of its own."""
    selection.check()
    limit = None
    if selection.depth_limited:
        nearest = selection_nearest(points, selection).first()["nearest"] if nearest is None else nearest
        if nearest is None:
            return points.limit(0)
        limit = nearest + selection.depth
    return selection.clipped(points).where(selection.excludes(xyz(), limit, _clip())).select(points.columns)
