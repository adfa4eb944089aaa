"""Verification: generated queries, two ways to answer them, and what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from . import cover, lookup

#: Fixed value: paths per face and level of a quick run.
QUICK_PATHS = 4096


def sampled_cells(spark: SparkSession, per_level: int | None = QUICK_PATHS, levels: range = range(13)) -> DataFrame:
    """face, level, path, compact: evenly spaced paths of each face and level; all of them if per_level is None."""
    parts = []
    for level in levels:
        paths = 4**level
        n = paths if per_level is None else min(paths, per_level)
        ids = spark.range(6 * n).select((F.col("id") % 6).cast("int").alias("face"), F.lit(level).alias("level"), F.expr(f"(id div 6) * {paths}L div {n}L").alias("path"))
        parts.append(ids.withColumn("compact", cells.compact_from_path("face", "level", "path")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mismatches(queries: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """One row: mismatches between the walk down the tree and the neighbours along the curve."""
    a = lookup.deepest(queries, members).select(id_col, F.col("answer").alias("a"))
    b = lookup.by_neighbours(queries, cover.leaves(members)).select(id_col, F.col("answer").alias("b"))
    return a.join(b, id_col, "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, n: how many rows are in one of two tables only."""
    names = [f"_{k}" for k in range(len(left.columns))]
    rows = left.toDF(*names).withColumn("_n", F.lit(1)).union(right.toDF(*names).withColumn("_n", F.lit(-1)))
    more = rows.groupBy(*names).agg(F.sum("_n").alias("_n"))  # rows are read once: each counts for its side
    total = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("long")
    sides = more.agg(total(F.col("_n")).alias("l"), total(-F.col("_n")).alias("r"))
    return sides.select(F.inline(F.array(F.struct(F.lit("left").alias("side"), F.col("l").alias("n")), F.struct(F.lit("right").alias("side"), F.col("r").alias("n")))))


def checksum(answers: DataFrame) -> DataFrame:
    """One row, n and sum: the same in whatever order the answers come."""
    return answers.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("compact", "answer")).alias("sum"))


def ordered_hash(values) -> int:
    """The order-sensitive checksum of unsigned numbers: rotate by 9, add, multiply, in 64 bits."""
    h, m = 0, (1 << 64) - 1
    for v in values:
        h = ((((h << 9) | (h >> 55)) + int(v)) * 0x9E3779B185EBCA87) & m
    return h


def verify(spark: SparkSession, members: DataFrame, per_level: int | None = QUICK_PATHS) -> DataFrame:
    """queries, mismatches of all sampled cells."""
    q = sampled_cells(spark, per_level).withColumn("query", F.concat_ws("/", "face", "level", "path"))
    return q.agg(F.count("*").alias("queries")).join(mismatches(q, members, "query"))
