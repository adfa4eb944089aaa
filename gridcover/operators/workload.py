"""Workloads for measuring lookups: random queries, throughput and histograms of answers."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import cells

#: The constants of SplitMix64 and of a 64-bit linear congruential generator.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407


def splitmix64(index: np.ndarray, seed: int = 0) -> np.ndarray:
    """The numbers after `index` steps, as unsigned 64 bits: any of them without the ones before."""
    with np.errstate(over="ignore"):
        z = (index.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))


@F.pandas_udf(LongType())
def splitmix(index: pd.Series) -> pd.Series:
    """splitmix64 as a column; wrapping products would raise in SQL."""
    return pd.Series(splitmix64(index.to_numpy()).view(np.int64))


def lcg64(index: np.ndarray, seed: int = 0) -> np.ndarray:
    """The numbers after index + 1 steps of a linear congruential generator, each by repeated squaring of the step."""
    a, c = np.uint64(LCG_A), np.uint64(LCG_C)
    n = index.astype(np.uint64) + np.uint64(1)
    mul, add = np.ones(len(n), np.uint64), np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        for _ in range(64):
            odd = (n & np.uint64(1)).astype(bool)
            add = np.where(odd, add * a + c, add)
            mul = np.where(odd, mul * a, mul)
            c, a, n = c * (a + np.uint64(1)), a * a, n >> np.uint64(1)
        return mul * np.uint64(seed) + add


@F.pandas_udf(LongType())
def spread(index: pd.Series) -> pd.Series:
    """Multiples of GAMMA, cut to 60 bits: evenly spread paths of level-30 cells."""
    with np.errstate(over="ignore"):
        return pd.Series((index.to_numpy().astype(np.uint64) * np.uint64(GAMMA) & np.uint64((1 << 60) - 1)).view(np.int64))


def spread_level_30(spark: SparkSession, n: int) -> DataFrame:
    """query_id, cell_id: evenly spread level-30 cells, faces in turn."""
    q = spark.range(n).withColumnRenamed("id", "query_id")
    return q.select("query_id", cells.from_path(F.col("query_id") % 6, F.lit(30), spread("query_id")).alias("cell_id"))


def stored_descendants(leaf_cells: DataFrame, n: int) -> DataFrame:
    """query_id, cell_id: at least n level-30 cells, the same number in each leaf."""
    each = -(-n // max(1, leaf_cells.count()))
    rows = leaf_cells.select("compact", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("r"))
    rows = rows.withColumn("query_id", F.col("r").cast("long") * (cells.MAX_COMPACT + 1) + F.col("compact"))
    return rows.select("query_id", cells.descendant_30(cells.from_compact("compact"), splitmix("query_id")).alias("cell_id"))


def global_level_30(spark: SparkSession, n: int) -> DataFrame:
    """query_id, cell_id: random level-30 cells, faces in turn."""
    q = spark.range(n).withColumnRenamed("id", "query_id")
    path = splitmix("query_id").bitwiseAND(F.lit((1 << 60) - 1))
    return q.select("query_id", cells.from_path(F.col("query_id") % 6, F.lit(30), path).alias("cell_id"))


def throughput(durations: DataFrame, queries_per_run: int, seconds: str = "seconds") -> DataFrame:
    """aggregate_qps, median_qps of runs that took `seconds`."""
    return durations.agg((F.count("*") * queries_per_run / F.sum(seconds)).alias("aggregate_qps"), F.median(queries_per_run / F.col(seconds)).alias("median_qps"))


def measure(run, repeats: int = 6) -> list[float]:
    """Seconds of each run of a function that returns a checksum; runs that disagree raise."""
    took, seen = [], set()
    for _ in range(repeats):
        t = time.perf_counter()
        seen.add(run())
        took.append(time.perf_counter() - t)
    if len(seen) > 1:
        raise ValueError("repeats disagree")
    return took


def answer_histogram(answers: DataFrame) -> DataFrame:
    return answers.groupBy(F.col("answer_level").alias("level")).agg(F.count("*").alias("n"))
