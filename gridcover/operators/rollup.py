"""Sums by cell, and their roll-up to all levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells, fixedpoint, projection


def filter_and_project(pixels: DataFrame) -> DataFrame:
    """Pixels with people, with the coordinates of their centres. The filter stands on the raw column, so that a scan can apply it."""
    p = F.col("population")
    kept = pixels.where(p.isNotNull() & (p != fixedpoint.NODATA) & (p != 0))
    return kept.withColumn("lat", projection.latitude("pixel_y")).withColumn("lng", projection.longitude("pixel_x"))


def cell12_population(pixels: DataFrame) -> DataFrame:
    """compact, population_fixed at level 12. Overflow of a sum raises (ANSI)."""
    at = F.concat(F.lit("pixel ("), F.col("pixel_x"), F.lit(", "), F.col("pixel_y"), F.lit(")"))
    fixed = filter_and_project(pixels).select("lat", "lng", fixedpoint.to_fixed("population", at).alias("population_fixed"))
    return projection.with_compact12(fixed).groupBy("compact").agg(F.sum("population_fixed").alias("population_fixed"))


def roll_up(cell12: DataFrame) -> DataFrame:
    """level, compact, population_fixed for levels 0 to 12: one shuffle, whose map side sums the upper levels down to a few rows."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(cells.MAX_COVER_LEVEL))).alias("level")
    at = cell12.select("compact", "population_fixed", levels)
    at = at.select("level", cells.compact_ancestor("compact", F.col("level")).alias("compact"), "population_fixed")
    return at.groupBy("level", "compact").agg(F.sum("population_fixed").alias("population_fixed"))


def roll_up_sets(cell12: DataFrame) -> DataFrame:
    """The same through ROLLUP over the path's digits: level, compact, population_fixed."""
    digits = [cells.compact_child("compact", k).alias(f"d{k + 1}") for k in range(cells.MAX_COVER_LEVEL)]
    df = cell12.select(cells.compact_face("compact").alias("face"), *digits, "population_fixed")
    names = ["face", *(f"d{k + 1}" for k in range(cells.MAX_COVER_LEVEL))]
    df = df.rollup(*names).agg(F.sum("population_fixed").alias("population_fixed"), F.grouping_id().alias("g")).where(F.col("g") < (1 << 13) - 1)
    level = (12 - F.bit_count("g")).cast("int")
    path = F.lit(0)
    for n in names[1:]:
        path = path * 4 + F.coalesce(F.col(n), F.lit(0))
    marker = 24 - 2 * level
    compact = cells.shl(F.col("face"), 25).bitwiseOR(cells.shl(path, 1)).bitwiseOR(cells.shl(F.lit(1), marker))
    return df.select(level.alias("level"), compact.alias("compact"), "population_fixed")


def cells_per_level(population: DataFrame) -> DataFrame:
    return population.groupBy("level").agg(F.count("*").alias("cells"))
