"""Points that arrive as files: a stream over a folder, thinned voxel by voxel as it comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.filters import voxel_winners


def dropped_points(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the points in Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_of_voxels(stream: DataFrame, size: float, target: str, checkpoint: str, ref: tuple[str, ...] = ("chunk", "idx"), scan: str = "scan"):
    """Writes each batch's voxel winners less those of voxels that an earlier batch filled. Returns the running query."""

    def batch(points: DataFrame, number: int) -> None:
        new = voxel_winners(points, size, ref, scan)
        keys = [scan, "cx", "cy", "cz"]
        try:
            new = new.join(points.sparkSession.read.parquet(target).where(F.col("batch") != number).select(*keys), keys, "left_anti")
        except Exception as e:  # nothing is there before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
