"""Layers: labels as a log of changes, of which the last for a point counts; visibility; counts and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import affine, xyz


def last_labels(changes: DataFrame, ref: tuple[str, ...], seq: str = "seq", code: str = "code") -> DataFrame:
    """ref and code of the last change of each point. One aggregation with partial results."""
    return changes.groupBy(*ref).agg(F.max_by(code, seq).alias("code"))


def labelled(points: DataFrame, labels: DataFrame, ref: tuple[str, ...]) -> DataFrame:
    """points with their code: layer 0 where no label says otherwise."""
    return points.join(labels, list(ref), "left").withColumn("code", F.coalesce("code", F.lit(0)).cast("short"))


def visible(points: DataFrame, shown: list[int], valid: str | None = None) -> DataFrame:
    """Points whose layer is shown; a code of no layer is hidden."""
    out = points.where(F.col("code").isin([int(c) for c in shown]))
    return out.where(F.col(valid)) if valid else out


def relabel(points: DataFrame, target: int, ref: tuple[str, ...]) -> DataFrame:
    """The changes that move points to a layer: those that are not there already."""
    return points.where(F.col("code") != target).select(*ref, F.lit(target).cast("short").alias("code"))


def layer_counts(points: DataFrame, layers: DataFrame) -> DataFrame:
    """code and n for each layer, 0 for an empty one; points that are not valid count too."""
    n = points.groupBy("code").agg(F.count("*").alias("n"))
    return layers.select("code").join(F.broadcast(n), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))  # at most 256 rows


def counts_by_chunk(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return points.groupBy(*keys, "code").agg(F.count("*").alias("n"))


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    """The least and greatest coordinates by keys."""
    return points.groupBy(*keys).agg(*(f(c).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a, c in zip("xyz", xyz(), strict=True)))


def record_counts(points: DataFrame, valid: str, scan: str = "scan") -> DataFrame:
    """scan, records and valid: all records, and those for which the condition holds."""
    return points.groupBy(scan).agg(F.count("*").alias("records"), F.count_if(F.expr(valid)).alias("valid"))


def moved_bounds(boxes: DataFrame, matrix, *keys: str) -> DataFrame:
    """The bounds by keys of the corners of boxes (as bounds() gives them), moved by a matrix."""
    corners = F.explode(F.array(*(F.struct(*(F.col(f"{('max' if k >> a & 1 else 'min')}_{c}").alias(c) for a, c in enumerate("xyz"))) for k in range(8))))
    at = boxes.select(*keys, corners.alias("c")).select(*keys, "c.*")
    return bounds(at.select(*keys, *(m.alias(c) for m, c in zip(affine(matrix, xyz()), "xyz", strict=True))), *keys)


def overlapping(boxes: DataFrame, key: str = "scan") -> DataFrame:
    """a and b, the keys of boxes (as bounds() gives them) that touch, a before b.

    An equi-join: boxes are listed by slabs of X as wide as the widest box, so each is in two at most, and a pair counts
    in the slab where the later of the two begins.
    """
    wide = boxes.agg(F.greatest(F.max(F.col("max_x") - F.col("min_x")), F.lit(1e-9)).alias("_wide"))
    slab = lambda c: F.floor(F.col(c) / F.col("_wide")).cast("long")
    own = boxes.join(F.broadcast(wide)).withColumns({"_lo": slab("min_x"), "_hi": slab("max_x")})  # one row
    listed = own.withColumn("_slab", F.explode(F.sequence("_lo", "_hi")))
    sides = [listed.select("_slab", *(F.col(c).alias(f"{s}_{c}") for c in (key, "_lo", *(f"{n}_{x}" for n in ("min", "max") for x in "xyz")))) for s in "ab"]
    touch = (F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col("_slab") == F.greatest("a__lo", "b__lo"))
    for c in "xyz":
        touch = touch & (F.col(f"a_min_{c}") <= F.col(f"b_max_{c}")) & (F.col(f"b_min_{c}") <= F.col(f"a_max_{c}"))
    return sides[0].join(sides[1], "_slab").where(touch).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))
