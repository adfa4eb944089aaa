"""Deepest-ancestor lookups: which cell of a cover answers for a cell.

Four forms with equal answers. `deepest` walks down the tree by halving the levels that are left, `by_tiles` finds the range that holds a
query by an equality on the range's aligned block (or, of many ranges, in order within blocks), `by_neighbours` merges queries and leaves along the curve, and `by_search` looks
queries up in the sorted leaves.

While the tree (or its tiles) is counted and has at most BROADCAST_ROWS rows, it is broadcast, and queries are answered where they are read:
one stage, no shuffle. That holds for the whole Earth at 1 km, whose tree has under a million rows. Beyond that the distinct
ids of the queries, of which there can't be more than cells of levels 0 to 12, are looked up by shuffled joins.

Null ids, and ids outside of the tree's faces, get a null answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import cells
from . import cover

BROADCAST_ROWS = 2_000_000


def small(df: DataFrame) -> tuple[DataFrame, bool]:
    """Marked for broadcast if it was counted and found small, and whether it was. It is kept from the count to the join: what is behind it may be long."""
    df = df.persist()
    few = df.count() <= BROADCAST_ROWS
    return (F.broadcast(df) if few else df), few


def query_compact(cell: Column | str) -> Column:
    """A query's compact id; invalid ids raise."""
    cell = cells.col(cell).cast("long")
    return F.when(cells.level(cell) >= 0, cells.to_compact(cell))


def deepest(queries: DataFrame, members: DataFrame, compact: str = "compact") -> DataFrame:
    """queries with answer and answer_level. members is closed towards the roots, as a tree is."""
    tree, few = small(members.select(F.col("compact").alias("_a")).distinct())
    if few:
        return _halving(queries, tree, compact)
    distinct = queries.select(F.col(compact).alias("_q")).distinct()
    up = distinct.select("_q", F.explode(F.sequence(F.lit(0), cells.compact_level("_q"))).alias("_l"))
    up = up.withColumn("_a", cells.compact_ancestor("_q", F.col("_l")))
    hit = up.join(tree, "_a", "left_semi").groupBy("_q").agg(F.max("_l").alias("answer_level"))
    hit = hit.withColumn("answer", cells.compact_ancestor("_q", F.col("answer_level")))
    return queries.join(hit, F.col(compact) == F.col("_q"), "left").select(*queries.columns, "answer", "answer_level")


def _halving(queries: DataFrame, tree: DataFrame, compact: str) -> DataFrame:
    """The deepest level whose ancestor is in the tree, by steps of 8, 4, 2 and 1 levels from above level 0: if an ancestor is in it, all above
    are. Each step is a join with the same broadcast table."""
    tree = tree.withColumn("_in", F.lit(True))
    q = queries.withColumn("_l", F.lit(-1))
    for step in (8, 4, 2, 1):
        at = F.col("_l") + step
        q = q.withColumn("_k", F.when(at <= cells.compact_level(compact), cells.compact_ancestor(compact, at)))
        q = q.join(tree, F.col("_k") == F.col("_a"), "left").select(*queries.columns, F.when(F.col("_in"), F.col("_l") + step).otherwise(F.col("_l")).alias("_l"))
    level = F.when(F.col("_l") >= 0, F.col("_l"))
    return q.select(*queries.columns, F.when(F.col("_l") >= 0, cells.compact_ancestor(compact, F.col("_l"))).alias("answer"), level.alias("answer_level"))


def by_tiles(queries: DataFrame, members: DataFrame, compact: str = "compact", block_level: int = 3) -> DataFrame:
    """The same through tiles: a tile is an aligned block of 2^(25 - 2 l) ids, so that (l, id >> (25 - 2 l)) is a key. Each id is in
    exactly one, so that with few tiles nothing is kept or gathered and queries may be a stream. With many, a query's tile is the last one that
    begins up to it, among those of its ancestor at block_level: one row per query instead of one for each of 13 keys."""
    tiles, few = small(_tile_keys(members))
    q = queries.withColumn("_q", F.col(compact)) if few else queries.select(F.col(compact).alias("_q")).distinct()
    hit = _by_keys(q, tiles) if few else _last_tile(q, tiles, 25 - 2 * block_level)
    hit = hit.withColumn("answer_level", F.least(cells.compact_level("_t"), cells.compact_level("_q")))
    hit = hit.withColumn("answer_level", F.when(F.col("_t").isNotNull(), F.col("answer_level"))).withColumn("answer", cells.compact_ancestor("_q", F.col("answer_level")))
    if few:
        return hit.select(*queries.columns, "answer", "answer_level")
    return queries.join(hit.select("_q", "answer", "answer_level"), F.col(compact) == F.col("_q"), "left").select(*queries.columns, "answer", "answer_level")


def _tile_keys(members: DataFrame) -> DataFrame:
    """_b, _k, _t, _found: each tile by its block."""
    t = cover.tiles(members).select(F.col("answer").alias("_t"), "lo", F.bit_count(F.col("hi") - F.col("lo") - 1).alias("_b"))
    return t.select("_b", cells.shr(F.col("lo"), F.col("_b")).alias("_k"), "_t", F.lit(True).alias("_found"))


def _by_keys(q: DataFrame, tiles: DataFrame) -> DataFrame:
    """q with _t, by one key a level. Ids outside of the faces that have tiles get one row too, by the bits of those faces."""
    faces = tiles.agg(F.coalesce(F.bit_or(cells.shl(F.lit(1), cells.shr(F.col("_k"), 25 - F.col("_b")))), F.lit(0))).first()[0]
    face = cells.compact_face("_q")
    inside = face.between(0, 5) & (cells.shr(F.lit(faces), F.least(face, F.lit(31))).bitwiseAND(F.lit(1)) == 1)
    bits = F.when(inside, F.array(*[F.lit(25 - 2 * level) for level in range(13)])).otherwise(F.array(F.lit(-1)))
    q = q.withColumn("_b", F.explode(bits))
    q = q.withColumn("_k", F.when(F.col("_b") >= 0, cells.shr(F.col("_q"), F.col("_b"))))
    return q.join(tiles, ["_b", "_k"], "left").where("_found or _b < 0")


def _last_tile(q: DataFrame, tiles: DataFrame, bits: int) -> DataFrame:
    """_q, _t: tiles dealt to the blocks of 2^bits ids that they lie in or cover (one of a level above to at most 4^block_level), and in each
    block a running last tile."""
    lo, block = cells.shl(F.col("_k"), F.col("_b")), F.col("_block")
    t = tiles.select("_t", lo.alias("_lo"), F.explode(F.sequence(cells.shr(lo, bits), cells.shr(lo + cells.shl(F.lit(1), F.col("_b")) - 1, bits))).alias("_block"))
    t = t.select("_block", F.greatest(F.col("_lo"), cells.shl(block, bits)).alias("_at"), "_t", F.lit(None).cast("int").alias("_q"))
    rows = t.unionByName(q.select(cells.shr(F.col("_q").cast("int"), bits).alias("_block"), F.col("_q").cast("int").alias("_at"), F.lit(None).cast("int").alias("_t"), F.col("_q").cast("int").alias("_q")))
    order = Window.partitionBy("_block").orderBy("_at", F.asc_nulls_first("_q")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_t", F.last("_t", True).over(order)).where("_q is not null").select("_q", "_t")


def by_neighbours(queries: DataFrame, leaf_cells: DataFrame, compact: str = "compact", block_level: int = 3) -> DataFrame:
    """The same from leaves alone: the leaf before and the leaf from a query on, along the curve, and the deeper common ancestor.

    Rows are dealt out by the ancestor at block_level; the last leaf before a block and the first one after it are carried over from
    the table of blocks, so that no face is in one task. Within a block, the leaf from a query on is taken in the order from its end: a frame
    that reaches forward to the end is computed anew for each row, in the square of the block's rows.
    """
    block = cells.shr(cells.col("_c"), 25 - 2 * block_level)
    q = queries.select(F.col(compact).alias("_c")).distinct().select("_c", F.lit(None).cast("int").alias("_leaf"), F.lit(0).alias("_kind"))
    rows = q.unionByName(leaf_cells.select(F.col("compact").alias("_c"), F.col("compact").alias("_leaf"), F.lit(1).alias("_kind")))
    rows = rows.withColumn("_block", block)
    ends = queries.select(F.col(compact).alias("_c"), F.lit(None).cast("int").alias("_leaf")).unionByName(leaf_cells.select(F.col("compact").alias("_c"), F.col("compact").alias("_leaf")))
    ends = ends.groupBy(block.alias("_block")).agg(F.max("_leaf").alias("_hi"), F.min("_leaf").alias("_lo"))
    whole = Window.partitionBy(F.shiftright("_block", 2 * block_level)).orderBy("_block")
    ends = ends.select("_block", F.max("_hi").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_lo").over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    order, back = Window.partitionBy("_block").orderBy("_c", "_kind"), Window.partitionBy("_block").orderBy(F.desc("_c"), F.desc("_kind"))
    rows = rows.withColumn("_p", F.last("_leaf", True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_s", F.last("_leaf", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("_kind = 0").join(ends, "_block").withColumn("_p", F.coalesce("_p", "_before")).withColumn("_s", F.coalesce("_s", "_after"))
    level = F.greatest(*[F.coalesce(_shared(F.col("_c"), F.col(k)), F.lit(0)) for k in ("_p", "_s")])
    hit = rows.select(F.col("_c").alias("_q"), level.alias("answer_level")).withColumn("answer", cells.compact_ancestor("_q", F.col("answer_level")))
    return queries.join(hit, F.col(compact) == F.col("_q"), "left").select(*queries.columns, "answer", "answer_level")


def by_search(queries: DataFrame, leaf_cells: DataFrame, compact: str = "compact") -> DataFrame:
    """The same by binary search in the sorted leaves, which are sent to all workers; a table of more than BROADCAST_ROWS is refused."""
    spark = queries.sparkSession
    if leaf_cells.count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} leaves; use by_neighbours")
    ordered = spark.sparkContext.broadcast(np.sort(leaf_cells.select("compact").toPandas()["compact"].to_numpy(np.int64)))

    def levels(c: np.ndarray) -> np.ndarray:
        return 12 - (np.bitwise_count((c & -c) - 1).astype(np.int64) >> 1)

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(levels(a), levels(b))
        differ = (a ^ b) >> 25 - 2 * most
        bits = np.ceil(np.log2(differ + 1.0)).astype(np.int64)
        return np.where(a >> 25 == b >> 25, (2 * most - bits) // 2, -1)

    @F.pandas_udf(IntegerType())
    def level(c: pd.Series) -> pd.Series:
        q, known = c.to_numpy(np.int64), ordered.value
        at = np.searchsorted(known, q)
        before, after = known[np.maximum(at - 1, 0)], known[np.minimum(at, len(known) - 1)]
        return pd.Series(np.maximum(shared(q, before), shared(q, after)).astype(np.int32))

    found = queries.withColumn("answer_level", level(F.col(compact)))
    return found.select(*queries.columns, cells.compact_ancestor(compact, F.col("answer_level")).alias("answer"), "answer_level")


def _shared(a: Column, b: Column) -> Column:
    """Level of the deepest common ancestor of two compact ids; null for different faces."""
    most = F.least(cells.compact_level(a), cells.compact_level(b))
    differ = cells.shr(a.bitwiseXOR(b), 25 - 2 * most)
    return F.when(cells.compact_face(a) == cells.compact_face(b), ((2 * most - cells.significant_bits(differ)) / 2).cast("int"))
