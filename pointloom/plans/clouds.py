"""The benchmark tables as point clouds, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cloud: ref, scan (the label), and the first three dimensions as coordinates."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), F.col("label").cast("long").alias("scan"), *(F.get(e, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, scan (eight by user), x the value, y the hour of the day, z the number in props, code a layer, seq a time."""
    t = F.col("ts")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("ref"), (F.col("user_id") % 8).alias("scan"), F.col("value").alias("x"), (seconds / 3600.0).alias("y"), F.get_json_object("props", "$.k").cast("double").alias("z"), (F.col("event_id") % 4).cast("short").alias("code"), (F.floor(F.col("event_id") / 1000)).cast("long").alias("chunk"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume: scan (four by supplier), quantity, price and discount as coordinates, and four columns of identity."""
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 4).alias("scan"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") * 100.0).alias("z"))


LI_REF = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

#: Common table expressions of the three clouds.
EMB = "emb AS (SELECT vec_id AS ref, CAST(label AS BIGINT) AS scan, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
EVT = "evt AS (SELECT event_id AS ref, user_id % 8 AS scan, value AS x, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600.0 AS y, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS z, CAST(event_id % 4 AS SMALLINT) AS code, event_id // 1000 AS chunk FROM events)"
LI = "li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 4 AS scan, l_quantity AS x, l_extendedprice / 1000.0 AS y, l_discount * 100.0 AS z FROM lineitem)"
