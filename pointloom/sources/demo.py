"""Generated point clouds: a waved sheet, and a ray-cast site for benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.geometry import Pose
from pointloom.plans.state import Scan, new_id


def demo_points(spark: SparkSession, side: int = 128) -> DataFrame:
    """A sheet of side * side points."""
    return sheet(spark.range(side * side), side)


def sheet(i: DataFrame, side: int) -> DataFrame:
    """Points of a sheet by their numbers (id), side to a row: z = 0.3 sin 2x cos 2y, coloured by height."""
    x, y = (F.col("id") % side) / side * 4 - 2, F.floor(F.col("id") / side) / side * 4 - 2
    own = i.select("id", x.alias("x"), y.alias("y")).withColumn("z", F.sin(F.col("x") * 2) * F.cos(F.col("y") * 2) * 0.3)
    shade = F.floor((F.col("z") + 0.3) / 0.6 * 255).cast("short")
    return own.select(F.shiftright("id", 16).cast("int").alias("chunk"), (F.col("id") % 65_536).cast("int").alias("idx"), F.lit(True).alias("valid"), "x", "y", "z", shade.alias("r"), (255 - shade).cast("short").alias("g"), F.lit(128).cast("short").alias("b"), F.lit(255).cast("short").alias("a"), F.floor(F.col("id") / side).alias("row"), (F.col("id") % side).alias("col"))


def demo_scans(spark: SparkSession, side: int = 128) -> list[tuple[Scan, DataFrame]]:
    return [(Scan(new_id(), f"Demo {k + 1}", Pose((3.0 * k, 0.0, 0.0))), demo_points(spark, side)) for k in range(2)]


def site_points(spark: SparkSession, scans: int, points: int, radius: float = 40.0) -> DataFrame:
    """Scanners in a ring of wall on a ground: each direction's nearest hit. scan, chunk, idx, valid, x, y, z (project)."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 24)) / float(1 << 24)
    own = spark.range(scans * points).select("id", F.floor(F.col("id") / points).cast("int").alias("scan"))
    sx, sy = F.cos(F.col("scan") * (2 * math.pi / scans)) * radius / 3, F.sin(F.col("scan") * (2 * math.pi / scans)) * radius / 3
    own = own.select("*", sx.alias("sx"), sy.alias("sy"), (u(1) * 2 * math.pi).alias("az"), ((u(2) - 0.5) * 1.6).alias("el"))
    dx, dy, dz = F.cos("el") * F.cos("az"), F.cos("el") * F.sin("az"), F.sin("el")
    own = own.select("*", dx.alias("dx"), dy.alias("dy"), dz.alias("dz"))
    along = F.col("sx") * F.col("dx") + F.col("sy") * F.col("dy")
    flat = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    wall = (-along + F.sqrt(along * along - flat * (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") - radius * radius))) / flat
    ground = F.when(F.col("dz") < 0, F.lit(-1.7) / F.col("dz"))
    t = F.least(wall, F.coalesce(ground, wall))
    own = own.withColumn("t", t)
    return own.select("scan", F.shiftright(F.col("id") % points, 16).cast("int").alias("chunk"), (F.col("id") % points % 65_536).cast("int").alias("idx"), F.lit(True).alias("valid"), *((F.col(s) if s else F.lit(0.0)) + F.col("t") * F.col(d) for s, d in (("sx", "dx"), ("sy", "dy"), (None, "dz")))).toDF("scan", "chunk", "idx", "valid", "x", "y", "z")
