"""Percentiles by index, not interpolation; spacing, anchors and order-free fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import scaled
from pointloom.operators import filters
from pointloom.operators.filters import nearest_pairs, places, radius_pairs
from pointloom.session import checkpoint


def element_at_share(values: Column, share: float, rounded: bool = False) -> Column:
    """Of a sorted array the element trunc((n - 1) * share), or the rounded one; null of an empty array."""
    at = (F.size(values) - 1) * F.lit(share)
    return F.when(F.size(values) > 0, F.element_at(values, (F.floor(at + 0.5) if rounded else F.floor(at)).cast("int") + 1))


#: Values of a group that are ranked in one task; a larger group is first narrowed down to a few thousandths.
RANKED = 200_000
#: Relative error of the ranks that narrow a group down, and how far the bracket reaches to either side, with room to spare.
ACCURACY, REACH = 10_000, 4e-4


def _index(n: Column, share: float, rounded: bool | None) -> Column:
    """The index of n sorted values that a share names: truncated, rounded, or for None n / 2."""
    if rounded is None:
        return F.floor(n / 2)
    at = (n - 1) * F.lit(share)
    return F.floor(at + 0.5) if rounded else F.floor(at)


def percentile_rows(points: DataFrame, value: str, shares: dict[str, tuple[float, bool | None]], *keys: str, ranked: int = RANKED) -> DataFrame:
    """By keys the values of the elements at each share (share, and how its index is found). NULLs do not count.

    Groups of up to `ranked` values are ranked in a window. Of a larger one approximate percentiles bracket each share;
    what lies below is counted, and the different values in the bracket are ranked by running counts: exact, and no task
    sorts a group.
    """
    own = points.where(F.col(value).isNotNull()).select(*keys, value)
    sizes = own.groupBy(*keys).agg(F.count("*").alias("_n"))
    small = sizes.where(F.col("_n") <= ranked)
    w = Window.partitionBy(*keys).orderBy(value)
    placed = own.join(F.broadcast(small), list(keys)).withColumn("_i", F.row_number().over(w) - 1)  # a row for each group
    out = placed.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == _index(F.col("_n"), s, r), F.col(value))).alias(name) for name, (s, r) in shares.items()))
    large = sizes.where(F.col("_n") > ranked)
    if large.isEmpty():
        return out
    own = own.join(F.broadcast(large), list(keys))
    found = large.select(*keys)
    for name, (s, r) in shares.items():
        ends = F.percentile_approx(value, [max(0.0, s - REACH), min(1.0, s + REACH)], ACCURACY)
        bracket = own.groupBy(*keys).agg(ends.alias("_e")).select(*keys, F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
        near = own.join(F.broadcast(bracket), list(keys))
        below = near.groupBy(*keys).agg(F.count_if(F.col(value) < F.col("_lo")).alias("_below"))
        counts = near.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, value, "_n").agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
        at = counts.join(F.broadcast(below), list(keys)).withColumn("_upto", F.col("_below") + upto)
        hit = at.where((_index(F.col("_n"), s, r) < F.col("_upto")) & (_index(F.col("_n"), s, r) >= F.col("_upto") - F.col("_c")))
        found = found.join(hit.select(*keys, F.col(value).alias(name)), list(keys), "left")
    return out.unionByName(found)


def scan_anchor(points: DataFrame, scan: str = "scan") -> DataFrame:
    """scan, ax, ay, az: median X and Y, and the height that a hundredth of the points lie below."""
    x = percentile_rows(points, "x", {"ax": (0.5, True)}, scan)
    y = percentile_rows(points, "y", {"ay": (0.5, True)}, scan)
    z = percentile_rows(points, "z", {"az": (0.01, True)}, scan)
    return x.join(y, scan).join(z, scan)


def intensity_grey(points: DataFrame, value: str, scan: str = "scan") -> DataFrame:
    """points with grey (0 to 255) between the 1st and 99th percentile of their scan; null where a scan has fewer than
    100 values or no spread."""
    w = percentile_rows(points, value, {"lo": (0.01, False), "hi": (0.99, False)}, scan)
    n = points.groupBy(scan).agg(F.count(value).alias("_n"))
    own = points.join(F.broadcast(w.join(n, scan)), scan)  # a row for each scan
    grey = F.when((F.col("_n") >= 100) & (F.col("hi") > F.col("lo")), F.floor(F.least(F.greatest((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int"))
    return own.withColumn("grey", grey).drop("lo", "hi", "_n")


def nearest_gap(points: DataFrame, reach: float, ref: tuple[str, ...], scan: str = "scan") -> DataFrame:
    """scan, ref and gap: the distance to the nearest other point of the scan within reach."""
    own, place = checkpoint(places(points, scan)), [scan, "x", "y", "z"]
    alone = own.where("copies = 1").select(scan, *(F.col(c).alias(f"l{c}") for c in "xyz"))
    to = own.select(scan, *(F.col(c).alias(f"r{c}") for c in "xyz"))
    found = nearest_pairs(alone, to, reach, (scan, "lx", "ly", "lz"), (), (scan,), itself=True)
    gaps = found.select(scan, *(F.col(f"l{c}").alias(c) for c in "xyz"), F.sqrt("d2").alias("gap"))
    gaps = gaps.unionByName(own.where("copies > 1").where(filters.finite()).select(*place, F.lit(0.0).alias("gap")))
    return points.join(gaps, place).select(scan, *ref, "gap")


def covariances(points: DataFrame, radius: float, ref: tuple[str, ...], least: int = 5, scan: str = "scan") -> DataFrame:
    """Of each point with `least` neighbours of its scan within radius, itself among them: n and the sums xx, xy, xz, yy,
    yz and zz of their offsets' products from their mean."""
    a = points.select(scan, *ref, *(F.col(c).alias(f"l{c}") for c in "xyz"))
    b = points.select(scan, *(F.col(c).alias(f"r{c}") for c in "xyz"))
    sums = [(F.covar_pop(f"r{p}", f"r{q}") * F.count("*")).alias(p + q) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return radius_pairs(a, b, radius, (scan,)).groupBy(*ref, scan).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)


def typical_spacing(points: DataFrame, reach: float, ref: tuple[str, ...], scan: str = "scan") -> DataFrame:
    """scan and spacing: the gap at index n / 2 of those in order; a tenth of reach without any."""
    mid = percentile_rows(checkpoint(nearest_gap(points, reach, ref, scan).select(scan, "gap")), "gap", {"gap": (0.5, None)}, scan)
    return points.select(scan).distinct().join(mid, scan, "left").select(scan, F.coalesce("gap", F.lit(reach / 10)).alias("spacing"))


def fingerprint(points: DataFrame, *columns: str) -> DataFrame:
    """Number, sum and exclusive or of the rows' hashes, the first 15 hexadecimal digits of an MD5 of their values as text:
    equal for equal rows in any order."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return points.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mix"))


def rescaled(value: str, lo: float, hi: float) -> Column:
    """A value in 16 bits."""
    return scaled(F.col(value), lo, hi, 65535)
