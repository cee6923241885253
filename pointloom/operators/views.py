"""Points as a camera or a panorama sees them: occlusion by cells of the view, and rasters of the nearest points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import Camera, xyz


def unoccluded(points: DataFrame, camera: Camera, ref: tuple[str, ...], cells: float, share: float = 0.05, slack: float = 0.05) -> DataFrame:
    """The ref of points in view that are not behind others: no deeper than the least depth of their cell and the eight
    around it, by a share and a slack. cells: per unit of the view. Depths of cells are partial sums on the map side."""
    x, y, z, w = camera.clip(xyz())
    seen = points.where((w > 0) & (z >= 0) & (z <= w))
    own = seen.select(*ref, F.floor(x / w * cells).cast("long").alias("px"), F.floor(y / w * cells).cast("long").alias("py"), camera.depth(xyz()).alias("depth"))
    front = own.groupBy("px", "py").agg(F.min("depth").alias("depth"))
    near = F.explode(F.array(*(F.struct((F.col("px") + i).alias("px"), (F.col("py") + j).alias("py")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    wide = front.select("depth", near.alias("c")).groupBy("c.px", "c.py").agg(F.min("depth").alias("front"))
    return own.join(wide, ["px", "py"]).where(F.col("depth") <= F.col("front") * (1 + share) + slack).select(*ref)


def raster(points: DataFrame, centre: tuple[float, float, float], degrees: float, ref: tuple[str, ...]) -> DataFrame:
    """px, py and ref: the nearest point of each cell of an equirectangular image around a place, ties to the least ref."""
    x, y, z = (c - float(a) for c, a in zip(xyz(), centre, strict=True))
    width = round(360 / degrees)
    px: Column = F.floor((F.lit(180.0) - F.degrees(F.atan2(y, x))) / degrees).cast("int") % width
    py = F.floor((F.lit(90.0) - F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))) / degrees).cast("int")
    own = points.select(*ref, px.alias("px"), py.alias("py"), ((x * x + y * y) + z * z).alias("dist"))
    best = own.groupBy("px", "py").agg(F.min(F.struct("dist", *ref)).alias("b"))
    return best.select("px", "py", *(F.col(f"b.{r}").alias(r) for r in ref))
