"""Pixel tables: the native form of the source, and the fixtures derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells

PIXELS = "pixel_x int, pixel_y int, population float"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored pixel table, by its declared schema."""
    return spark.read.schema(PIXELS).parquet(path)


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse background pixels, and a dense cluster for each supplier."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    sparse = F.col("l_returnflag") == "R"
    x = F.when(sparse, F.expr("(l_orderkey * 7919 + l_linenumber * 104729) % 43200")).otherwise(F.expr("(l_suppkey * 17011 + (l_orderkey * 31 + l_linenumber * 7) % 6) % 43200"))
    y = F.when(sparse, F.expr("(l_orderkey * 6007 + l_partkey * 13) % 17280")).otherwise(F.expr("(l_suppkey * 9973 + (l_partkey * 5) % 6) % 17280"))
    return t.select(x.cast("int").alias("pixel_x"), y.cast("int").alias("pixel_y"), F.col("l_quantity").cast("float").alias("population"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, pixel_x, pixel_y."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return t.select("event_id", F.expr("cast((user_id * 17011 + event_id % 6) % 43200 as int)").alias("pixel_x"), F.expr("cast((user_id * 9973 + event_id % 6) % 17280 as int)").alias("pixel_y"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, face, level, path, compact: cells of levels 0 to 12."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    t = t.select("o_orderkey", F.expr("cast(o_orderkey % 6 as int)").alias("face"), F.expr("cast(o_orderkey % 13 as int)").alias("level"), F.expr("(o_orderkey * 7919 + o_custkey) & (shiftleft(1L, cast(2 * (o_orderkey % 13) as int)) - 1)").alias("path"))
    return t.withColumn("compact", cells.compact_from_path("face", "level", "path"))
