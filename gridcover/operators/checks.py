"""Checks of covers and leaf sets: one row per check (check, ok, detail), and a way to raise on the first that fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, fixedpoint
from . import cover


def _row(df: DataFrame, name: str, bad, detail=None) -> DataFrame:
    """bad: an aggregate that counts offenders."""
    return df.agg(bad.alias("n")).select(F.lit(name).alias("check"), (F.coalesce("n", F.lit(0)) == 0).alias("ok"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(f" {detail or 'offenders'}")).alias("detail"))


def overlaps(leaf_cells: DataFrame) -> DataFrame:
    """compact of the leaves that have an ancestor, or a second self, among the leaves. An equality on ancestors: no order of all leaves is needed."""
    up = leaf_cells.select("compact", F.explode(F.sequence(F.lit(0), cells.compact_level("compact"))).alias("l"))
    up = up.select("compact", cells.compact_ancestor("compact", F.col("l")).alias("a"))
    held = up.join(leaf_cells.select(F.col("compact").alias("a")), "a")
    return held.groupBy("compact").agg(F.count("*").alias("n")).where("n > 1").select("compact")


def orphans(members: DataFrame) -> DataFrame:
    """level, compact of the members whose parent isn't one."""
    low = members.where("level > 0").withColumn("_up", cells.compact_ancestor("compact", F.col("level") - 1)).withColumn("_l", F.col("level") - 1)
    return low.join(members.select(F.col("level").alias("_l"), F.col("compact").alias("_up")), ["_l", "_up"], "left_anti").select("level", "compact")


def faces_missing(members: DataFrame) -> DataFrame:
    """One row: missing, how many faces have no member."""
    return members.agg((6 - F.bit_count(F.coalesce(F.bit_or(cells.shl(F.lit(1), cells.compact_face("compact"))), F.lit(0)))).cast("long").alias("missing"))


def leaf_set_checks(leaf_cells: DataFrame) -> DataFrame:
    c = leaf_cells.select("compact")
    valid = c.where(cells.compact_valid("compact"))
    out = [
        c.agg(F.count("*").alias("n")).select(F.lit("not_empty").alias("check"), (F.col("n") > 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" leaves")).alias("detail")),
        _row(c, "compact_in_range", F.count_if(F.col("compact").isNull() | (F.col("compact") < 0) | (F.col("compact") > cells.MAX_COMPACT))),
        _row(c, "valid_cells", F.count_if(~cells.compact_valid("compact"))),
        _row(c.groupBy("compact").count().where("count > 1"), "unique", F.count("*")),
        _row(overlaps(valid.distinct()), "no_overlap", F.count("*")),
        faces_missing(valid).select(F.lit("all_faces").alias("check"), (F.col("missing") == 0).alias("ok"), F.concat(F.col("missing").cast("string"), F.lit(" faces missing")).alias("detail")),
    ]
    return _union(out)


def tree_checks(members: DataFrame, node_table: DataFrame) -> DataFrame:
    counts = node_table.groupBy("level").agg(F.count("*").alias("nodes"), F.sum(F.bit_count("mask")).alias("children"), F.count_if(F.col("mask") == 0).alias("zero"))
    kids = counts.select((F.col("level") + 1).alias("level"), F.col("children").alias("expected")).where("level <= 12").join(counts.select("level", "nodes"), "level", "left")
    leaf_rows = cover.leaves(members).agg(F.count("*").alias("n"))
    zeros = counts.agg(F.sum("zero").alias("z"))
    return _union([
        _row(orphans(members), "no_orphans", F.count("*")),
        _row(counts, "level_capacity", F.count_if(F.col("nodes") > cells.maximum_nodes("level"))),
        _row(kids, "children_are_nodes", F.count_if(F.coalesce("nodes", F.lit(0)) != F.col("expected"))),
        leaf_rows.join(zeros).select(F.lit("leaf_count").alias("check"), (F.col("n") == F.coalesce("z", F.lit(0))).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" leaves")).alias("detail")),
        _row(node_table.withColumn("_x", F.row_number().over(Window.partitionBy("level", cells.shr(F.col("compact"), 15)).orderBy("compact"))).groupBy("level", "node_index").count().where("count > 1"), "unique_indexes", F.count("*")),
    ])


def cover_checks(leaf_cells: DataFrame) -> DataFrame:
    """All checks; what each of them reads is kept from the first one on."""
    leaf_cells = leaf_cells.persist()
    members = cover.closure(leaf_cells).persist()
    return leaf_set_checks(leaf_cells).unionByName(tree_checks(members, cover.nodes(members).persist()))


def every_level(members: DataFrame) -> DataFrame:
    """The stored form's own condition: each level has a node."""
    return members.agg(F.count_distinct("level").alias("n")).select(F.lit("every_level").alias("check"), (F.col("n") == 13).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" levels")).alias("detail"))


def threshold_audit(answers: DataFrame, population: DataFrame, threshold: int = fixedpoint.THRESHOLD) -> DataFrame:
    """One row: violations, how many answers have fewer people than the threshold."""
    known = population.select(F.col("compact").alias("answer"), "population_fixed")
    return answers.select("answer").join(known, "answer", "left").agg(F.count_if(F.coalesce("population_fixed", F.lit(0)) < threshold).alias("violations"))


def require(found: DataFrame) -> None:
    bad = [f"{r['check']}: {r['detail']}" for r in found.where("not ok").collect()]
    if bad:
        raise ValueError("; ".join(bad))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
