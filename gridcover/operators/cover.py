"""The cover: the tree of cells that reach the threshold, its leaves, nodes and tiles.

Everything is a table keyed by compact id. The tree is closed towards the root, since populations are not negative, so that a leaf
is a member no member has for a parent; no recursion is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, fixedpoint
from .rollup import cell12_population, roll_up

#: Levels up to this one have at most 24,576 nodes.
BROADCAST_LEVEL = 6


def tree(population: DataFrame, threshold: int = fixedpoint.THRESHOLD) -> DataFrame:
    """level, compact of the cells that reach the threshold. Must see all levels: small cells count in their ancestors."""
    return population.where(F.col("population_fixed") >= threshold).select("level", "compact")


def parents(members: DataFrame) -> DataFrame:
    return members.where("level > 0").select((F.col("level") - 1).alias("level"), cells.compact_ancestor("compact", F.col("level") - 1).alias("compact")).distinct()


def leaves(members: DataFrame) -> DataFrame:
    """compact, level of the members without a child among the members."""
    return _with_masks(members).where("mask = 0").select("compact", "level")


def closure(leaf_cells: DataFrame) -> DataFrame:
    """level, compact of the leaves and all their ancestors."""
    at = leaf_cells.select("compact", F.explode(F.sequence(F.lit(0), cells.compact_level("compact"))).alias("level"))
    return at.select("level", cells.compact_ancestor("compact", F.col("level")).alias("compact")).distinct()


def child_masks(members: DataFrame) -> DataFrame:
    """level, compact, mask: bit k stands for child k. Members at level 12 have none."""
    return _with_masks(members).where("level < 12")


def _with_masks(members: DataFrame) -> DataFrame:
    """level, compact, mask of all members. Each brings its bit to its parent: one pass and one shuffle instead of a join, so that what is
    behind members is computed once and nothing is sent to the driver. Repeated members stay repeated."""
    at, up = F.col("level"), F.col("level") - 1
    own = F.struct(at.alias("level"), F.col("compact"), F.lit(0).alias("bit"), F.lit(1).alias("own"))
    parent = F.struct(up.alias("level"), cells.compact_ancestor("compact", up).alias("compact"), cells.shl(F.lit(1), cells.compact_child("compact", up)).alias("bit"), F.lit(0).alias("own"))
    rows = members.select(F.explode(F.when(at > 0, F.array(own, parent)).otherwise(F.array(own))).alias("_m")).select("_m.*")
    masks = rows.groupBy("level", "compact").agg(F.bit_or("bit").alias("mask"), F.sum("own").cast("int").alias("_n")).where("_n > 0")
    return masks.select("level", "compact", "mask", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).drop("col")


def nodes(members: DataFrame) -> DataFrame:
    """level, node_index, compact, mask, child_rank: breadth-first order, as of the stored form.

    Positions in a level are running counts. They are taken within (level, face, upper path) blocks first and then shifted by the
    sums of the blocks before, so that no task orders a whole level.
    """
    m = _with_masks(members).withColumn("_block", cells.shr(F.col("compact"), 15)).withColumn("_kids", F.bit_count("mask"))
    sums = m.groupBy("level", "_block").agg(F.count("*").alias("_n"), F.sum("_kids").alias("_k"))
    before = Window.partitionBy("level").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("level", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"))
    inside = Window.partitionBy("level", "_block").orderBy("compact")
    m = m.withColumn("_at", F.row_number().over(inside) - 1).withColumn("_rank", F.coalesce(F.sum("_kids").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    m = m.join(sums, ["level", "_block"])
    return m.select("level", (F.col("_n0") + F.col("_at")).cast("long").alias("node_index"), "compact", "mask", (F.col("_k0") + F.col("_rank")).cast("long").alias("child_rank"))


def tiles(members: DataFrame) -> DataFrame:
    """lo, hi (exclusive), answer: disjoint ranges of compact ids that cover all faces, and the cell that answers for each."""
    whole, low = F.col("k") < 0, cells.compact_lowest("compact")
    t = _with_masks(members).select("compact", "mask", F.explode(F.when(F.col("mask") == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(3)))).alias("k"))
    t = t.where(whole | (cells.shr(F.col("mask"), F.greatest("k", F.lit(0))).bitwiseAND(F.lit(1)) == 0))
    start, quarter = F.col("compact") - low, F.expr("(compact & -compact) div 2").cast("int")
    t = t.select((start + F.greatest("k", F.lit(0)) * quarter).alias("lo"), F.when(whole, 2 * low).otherwise(quarter).alias("_wide"), F.col("compact").alias("answer"))
    return t.select("lo", (F.col("lo") + F.col("_wide")).alias("hi"), "answer")


def mask_and_rank(node_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """mask and child_rank of the nodes that wanted names by level and node_index."""
    return wanted.join(node_table.select("level", "node_index", "mask", "child_rank"), ["level", "node_index"], "left")


def reconstruct(node_table: DataFrame) -> DataFrame:
    """compact, level of the leaves, from masks and ranks alone: twelve joins from a level's nodes to their children's positions.

    They form one chain, which leaves that are found go through as they are: with a branch for each level, level l would be computed anew
    for each level below. Levels of at most 6 * 4^6 nodes are broadcast, others never are. node_table is read twelve times: keep it.
    """
    spark = node_table.sparkSession
    n = node_table.select("level", "node_index", "mask", "child_rank")
    at = spark.range(6).select(F.lit(0).alias("level"), F.col("id").alias("node_index"), cells.shl(F.col("id").cast("int"), 25).bitwiseOR(F.lit(1 << 24)).alias("compact"))
    for level in range(cells.MAX_COVER_LEVEL):
        here = n.where(F.col("level") == level)
        here = at.join(F.broadcast(here) if level <= BROADCAST_LEVEL else here.hint("merge"), ["level", "node_index"], "left").where((F.col("level") < level) | F.col("mask").isNotNull())
        ends = F.coalesce("mask", F.lit(0)) == 0
        here = here.select("level", "node_index", "compact", "mask", "child_rank", F.explode(F.when(ends, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(3)))).alias("k"))
        kid = F.col("k") >= 0
        here = here.where(~kid | (cells.shr(F.col("mask"), F.greatest("k", F.lit(0))).bitwiseAND(F.lit(1)) == 1))
        before = F.bit_count(F.col("mask").bitwiseAND(cells.shl(F.lit(1), F.col("k")) - 1))
        marker = 24 - 2 * level
        compact = F.col("compact").bitwiseXOR(F.lit(1 << marker)).bitwiseOR(cells.shl(F.col("k"), marker - 1)).bitwiseOR(F.lit(1 << marker - 2))
        at = here.select(*[F.when(kid, down).otherwise(F.col(c)).alias(c) for c, down in (("level", F.lit(level + 1)), ("node_index", F.col("child_rank") + before), ("compact", compact))])
    return at.select("compact", "level")


def mask_level_totals(node_table: DataFrame) -> DataFrame:
    return node_table.where("level < 12").groupBy("level").agg(F.count("*").alias("nodes"), F.sum(F.bit_count("mask")).cast("long").alias("children"), F.count_if(F.col("mask") == 0).alias("zero_masks"))


def mask_transitions(node_table: DataFrame, restart: int = 208) -> DataFrame:
    """level, prev_mask, mask, n: how often a mask follows another within blocks of `restart` nodes."""
    block = Window.partitionBy("level", F.floor(F.col("node_index") / restart)).orderBy("node_index")
    t = node_table.where("level < 12").withColumn("prev_mask", F.lag("mask").over(block)).where("prev_mask is not null")
    return t.groupBy("level", "prev_mask", "mask").agg(F.count("*").alias("n"))


def block_checkpoints(node_table: DataFrame, restart: int = 208) -> DataFrame:
    """level, block, child_rank: the rank at which each block of nodes begins."""
    t = node_table.where((F.col("level") < 12) & (F.col("node_index") % restart == 0))
    return t.select("level", F.floor(F.col("node_index") / restart).alias("block"), "child_rank")


def level_histogram(leaf_cells: DataFrame) -> DataFrame:
    """level, cell_count, pct."""
    t = leaf_cells.groupBy("level").agg(F.count("*").alias("cell_count"))
    return t.withColumn("pct", F.col("cell_count") / F.sum("cell_count").over(Window.partitionBy(F.lit(0))) * 100)


def format_histogram(leaf_cells: DataFrame) -> DataFrame:
    """One row, text: 'L3: 5, L12: 9'."""
    t = leaf_cells.groupBy("level").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("a"))
    return t.select(F.array_join(F.transform("a", lambda x: F.concat(F.lit("L"), x["level"], F.lit(": "), x["n"])), ", ").alias("text"))


class Cover:
    """A cover as tables; building raises unless all six faces have members."""

    def __init__(self, spark: SparkSession, members: DataFrame):
        self.spark, self.members = spark, members

    @classmethod
    def build(cls, pixels: DataFrame, threshold: int = fixedpoint.THRESHOLD, check: bool = True) -> Cover:
        cover = cls(pixels.sparkSession, tree(roll_up(cell12_population(pixels)), threshold))
        if check:
            cover.require_faces()
        return cover

    @classmethod
    def from_leaves(cls, leaf_cells: DataFrame) -> Cover:
        return cls(leaf_cells.sparkSession, closure(leaf_cells))

    @classmethod
    def load(cls, spark: SparkSession, path: str, verify: bool = True) -> Cover:
        """From a folder that save wrote. verify runs all checks and raises at the first that fails."""
        cover = cls(spark, spark.read.schema("level int, compact int").parquet(f"{path}/tree"))
        if verify:
            from . import checks

            checks.require(checks.cover_checks(cover.leaves()))
        return cover

    def save(self, path: str) -> None:
        """Sorted by compact id, so that row groups can be skipped."""
        self.members.select("level", "compact").repartitionByRange("level", "compact").sortWithinPartitions("level", "compact").write.mode("overwrite").parquet(f"{path}/tree")

    def require_faces(self) -> None:
        faces = self.members.where("level = 0").agg(F.coalesce(F.bit_or(cells.shl(F.lit(1), cells.compact_face("compact"))), F.lit(0))).first()[0]
        if faces != 63:
            raise ValueError(f"faces without a member: {[f for f in range(6) if not faces >> f & 1]}")

    def snapshot(self) -> Cover:
        """The same cover, kept in memory or on disk from its first use on."""
        return Cover(self.spark, self.members.persist())

    def leaves(self) -> DataFrame:
        return leaves(self.members)

    def nodes(self) -> DataFrame:
        return nodes(self.members)

    def tiles(self) -> DataFrame:
        return tiles(self.members)

    def count(self) -> int:
        return self.leaves().count()
