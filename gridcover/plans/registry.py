"""Registered queries of the spatial engine. Their SQL is in oracles.py."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, fixedpoint, projection
from ..operators import checks, cover, lookup, rollup, verify, workload
from ..sources import pixels
from ..stored import materialize
from . import oracles


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return cover.tree(_population(spark, d))


def _population(spark: SparkSession, d: str) -> DataFrame:
    return rollup.roll_up(rollup.cell12_population(pixels.from_lineitem(spark, d)))


def _events(spark: SparkSession, d: str) -> DataFrame:
    p = pixels.event_points(spark, d).withColumn("lat", projection.latitude("pixel_y")).withColumn("lng", projection.longitude("pixel_x"))
    return projection.with_compact12(p).select("event_id", "compact")


def _lookup(how, spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    return how(_events(spark, d), cover.leaves(tree) if how is lookup.by_neighbours else tree).select("event_id", "answer", "answer_level")


def pixel_filter_project(spark, d):
    return rollup.filter_and_project(pixels.from_lineitem(spark, d)).select("pixel_x", "pixel_y", "lat", "lng")


def rollup_grouping_sets(spark, d):
    t = rollup.roll_up_sets(rollup.cell12_population(pixels.from_lineitem(spark, d)))
    return t.groupBy("level").agg(F.count("*").alias("groups"), F.sum("population_fixed").alias("total_fixed"))


def lookup_mixed_levels(spark, d):
    q = pixels.order_cells(spark, d)
    return lookup.deepest(q, _tree(spark, d)).select("o_orderkey", F.col("compact").alias("query_compact"), "answer")


def lookup_neighbors_mixed(spark, d):
    q = pixels.order_cells(spark, d)
    return lookup.by_neighbours(q, cover.leaves(_tree(spark, d))).select("o_orderkey", F.col("compact").alias("query_compact"), "answer")


def lookup_tiles_mixed(spark, d):
    q = pixels.order_cells(spark, d)
    return lookup.by_tiles(q, _tree(spark, d)).select("o_orderkey", F.col("compact").alias("query_compact"), "answer")


def _cells(spark, d):
    return pixels.order_cells(spark, d).withColumn("cell_id", cells.from_compact("compact"))


def cell_level(spark, d):
    return _cells(spark, d).select("o_orderkey", cells.level("cell_id").alias("cell_level"), cells.hex_id("cell_id").alias("cell_hex"))


def cell_ancestors(spark, d):
    t = _cells(spark, d).select("o_orderkey", "cell_id", F.explode(F.sequence(F.lit(0), cells.level("cell_id"))).alias("at_level"))
    return t.select("o_orderkey", "at_level", cells.to_compact(cells.ancestor("cell_id", F.col("at_level"))).alias("ancestor"))


def cell_children(spark, d):
    t = _cells(spark, d).where("level < 12")
    t = t.select("o_orderkey", "level", F.posexplode(cells.children("cell_id", F.col("level"))).alias("k", "child"))
    return t.select("o_orderkey", "k", cells.to_compact("child").alias("child"), cells.child_index("child", F.col("level")).alias("child_at"))


def cell_face(spark, d):
    return _cells(spark, d).select("o_orderkey", cells.face("cell_id").alias("face"), cells.to_compact(cells.face_root(F.col("face"))).alias("root"))


def cell_range(spark, d):
    return _cells(spark, d).select("o_orderkey", (F.col("compact") - cells.compact_lowest("compact")).alias("lo"), (F.col("compact") + cells.compact_lowest("compact")).alias("hi"))


def shared_ancestor(spark, d):
    t = _cells(spark, d).withColumn("other", cells.from_compact(cells.compact_from_path("face", F.lit(12), F.expr("(o_orderkey * 104729) & 16777215"))))
    return t.select("o_orderkey", cells.common_level("cell_id", "other").alias("shared_level"), cells.to_compact(cells.common_ancestor("cell_id", "other")).alias("shared"))


def try_level_invalid_ids(spark, d):
    raw = F.expr("case c_custkey % 5 when 0 then 0L when 1 then shiftleft(6L, 61) when 2 then shiftleft(1L, cast(1 + 2 * (c_custkey % 29) as int)) when 3 then shiftleft(1L, 61) else shiftleft(c_custkey % 6, 61) | shiftleft(1L, cast(60 - 2 * (c_custkey % 31) as int)) end")
    t = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", raw.alias("raw_id"))
    return t.select("c_custkey", cells.try_level("raw_id").alias("cell_level"), cells.is_valid("raw_id").alias("valid"))


def fixed_point_convert(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr("cast(case when o_orderkey % 11 = 0 then -99999 when o_orderkey % 13 = 0 then 0 else o_totalprice end as float)").alias("p"))
    return t.select("o_orderkey", fixedpoint.source_to_fixed("p").alias("population_fixed"))


def threshold_audit(spark, d):
    population = _population(spark, d)
    return checks.threshold_audit(lookup.deepest(_events(spark, d), cover.tree(population)), population)


def cover_checks(spark, d):
    return checks.cover_checks(cover.leaves(_tree(spark, d))).select("check", "ok")


def parent_orphans(spark, d):
    return checks.orphans(_tree(spark, d)).agg(F.count("*").alias("orphans"))


def overlap_check(spark, d):
    return checks.overlaps(cover.leaves(_tree(spark, d))).agg(F.count("*").alias("overlaps"))


def leaf_set_difference(spark, d):
    """Leaves against those that are rebuilt from the masks of the nodes."""
    tree = materialize(_tree(spark, d), "tree")
    return verify.set_difference(cover.leaves(tree).select("compact"), cover.reconstruct(materialize(cover.nodes(tree), "nodes")).select("compact"))


def oracle_mismatch_count(spark, d):
    return verify.mismatches(_events(spark, d), _tree(spark, d), "event_id")


def throughput_summary(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select((F.abs("value") + 0.001).alias("seconds"))
    return workload.throughput(t, 1000)


def queries() -> dict:
    tree = lambda f: lambda spark, d: f(_tree(spark, d))
    nodes = lambda f: lambda spark, d: f(cover.nodes(_tree(spark, d)))
    return {
        "pixel_filter_project": pixel_filter_project,
        "cell12_population": lambda spark, d: rollup.cell12_population(pixels.from_lineitem(spark, d)),
        "population_rollup": _population,
        "rollup_grouping_sets": rollup_grouping_sets,
        "populated_cells_per_level": lambda spark, d: rollup.cells_per_level(_population(spark, d)),
        "qualifying_tree": _tree,
        "leaf_cells": tree(cover.leaves),
        "reconstructed_leaves": lambda spark, d: cover.reconstruct(materialize(cover.nodes(_tree(spark, d)), "nodes")),
        "leaf_level_histogram": tree(lambda t: cover.level_histogram(cover.leaves(t))),
        "leaf_histogram_text": tree(lambda t: cover.format_histogram(cover.leaves(t))),
        "leaf_closure": tree(lambda t: cover.closure(cover.leaves(t))),
        "child_masks": tree(cover.child_masks),
        "node_ranks": nodes(lambda n: n.select("level", "node_index", "compact", "mask", "child_rank")),
        "mask_level_totals": nodes(cover.mask_level_totals),
        "mask_transitions": nodes(cover.mask_transitions),
        "block_checkpoints": nodes(cover.block_checkpoints),
        "cover_tiles": tree(cover.tiles),
        "lookup_deepest": partial(_lookup, lookup.deepest),
        "lookup_tiles": partial(_lookup, lookup.by_tiles),
        "lookup_neighbors": partial(_lookup, lookup.by_neighbours),
        "lookup_search": lambda spark, d: lookup.by_search(_events(spark, d), cover.leaves(_tree(spark, d)).persist()).select("event_id", "answer", "answer_level"),
        "lookup_level_histogram": lambda spark, d: workload.answer_histogram(_lookup(lookup.deepest, spark, d)),
        "lookup_mixed_levels": lookup_mixed_levels,
        "lookup_neighbors_mixed": lookup_neighbors_mixed,
        "lookup_tiles_mixed": lookup_tiles_mixed,
        "cell_level": cell_level,
        "cell_ancestors": cell_ancestors,
        "cell_children": cell_children,
        "cell_face": cell_face,
        "cell_range": cell_range,
        "shared_ancestor": shared_ancestor,
        "try_level_invalid_ids": try_level_invalid_ids,
        "fixed_point_convert": fixed_point_convert,
        "threshold_audit": threshold_audit,
        "cover_checks": cover_checks,
        "parent_orphans": parent_orphans,
        "overlap_check": overlap_check,
        "face_coverage": tree(checks.faces_missing),
        "leaf_set_difference": leaf_set_difference,
        "oracle_mismatch_count": oracle_mismatch_count,
        "sampled_paths": lambda spark, d: verify.sampled_cells(spark),
        "throughput_summary": throughput_summary,
    }


def oracle_sql() -> dict:
    return oracles.sql()
