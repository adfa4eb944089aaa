import pytest
from pyspark.sql import functions as F

from gridcover.functions import cells, fixedpoint, projection

#: Ids of named points, as listed in FIXTURES.md.
GOLDEN = [
    ("Beijing", 39.9042, 116.4074, "35f052b9d91e0311", 56558891),
    ("London", 51.5074, -0.1278, "487604ce36748fa9", 75980877),
    ("New York", 40.7128, -74.0060, "89c25a220cf80969", 144450979),
    ("Everest", 27.9881, 86.9250, "39e853611d279f8b", 60720439),
    ("Kathmandu", 27.7172, 85.3240, "39eb190ffff00119", 60731793),
    ("Lhasa", 29.6524, 91.1172, "3761317340663a67", 58069783),
    ("Antarctica", -80.0, 0.0, "b07f8757d6029fe3", 185071733),
    ("Henderson", -24.3797, -128.3242, "9e43f2d128b9018f", 165953325),
]


def ids(spark, *values):
    return spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in values], "id long")


def one(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_named_points(spark):
    df = spark.createDataFrame([g[:3] for g in GOLDEN], "name string, lat double, lng double")
    got = {r["name"]: r for r in projection.with_cell30(projection.with_compact12(df)).select("name", "compact", cells.hex_id("cell_id").alias("hex")).collect()}
    for name, _, _, hexed, compact in GOLDEN:
        assert (got[name]["hex"], got[name]["compact"]) == (hexed, compact)


def test_levels_and_bounds(spark):
    df = ids(spark, 1, 1 << 60, 0x1000000004000000, (5 << 61) | 1, 0x8000000000000000 | 1 << 60)
    assert one(df, cells.level("id")) == [30, 0, 17, 30, 0]
    assert one(df, cells.face("id")) == [0, 0, 0, 5, 4]


@pytest.mark.parametrize("bad", [0, 6 << 61 | 1, 7 << 61 | 1, 1 << 1, 1 << 61, 1 << 63])
def test_invalid_ids(spark, bad):
    df = ids(spark, bad)
    assert one(df, cells.try_level("id")) == [None]
    assert one(df, cells.is_valid("id")) == [False]
    assert one(df, cells.try_ancestor("id", 0)) == [None]
    with pytest.raises(Exception, match="cell id"):
        df.select(cells.level("id")).collect()


def test_ancestors_children(spark):
    df = spark.range(200).select(cells.from_path(F.col("id") % 6, F.col("id") % 30, F.expr("(id * 7919) & (shiftleft(1L, cast(2 * (id % 30) as int)) - 1)")).alias("c"), (F.col("id") % 30).cast("int").alias("l"))
    df = df.withColumn("kid", F.explode(cells.children("c", F.col("l"))))
    bad = df.where((cells.parent("kid", F.col("l")) != F.col("c")) | (cells.level("kid") != F.col("l") + 1) | (cells.ancestor("c", F.col("l")) != F.col("c")))
    assert bad.count() == 0
    order = df.groupBy("c").agg(F.array_sort(F.collect_set(cells.child_index("kid", cells.try_level("c")))).alias("k"))
    assert order.where(F.col("k") != F.array(*map(F.lit, range(4)))).count() == 0
    with pytest.raises(Exception, match="no ancestor"):
        ids(spark, 1 << 60).select(cells.ancestor("id", 1)).collect()
    with pytest.raises(Exception, match="no children"):
        ids(spark, 1).select(cells.children("id", 30)).collect()


def test_shared_ancestor(spark):
    def brute(a, b):
        la, lb = (60 - ((a & -a).bit_length() - 1)) // 2, (60 - ((b & -b).bit_length() - 1)) // 2
        if a >> 61 != b >> 61:
            return None
        return max(l for l in range(min(la, lb) + 1) if a >> 61 - 2 * l == b >> 61 - 2 * l)

    import random

    r = random.Random(3)
    pairs = []
    for _ in range(200):
        mk = lambda f: (lambda l: f << 61 | r.getrandbits(2 * l) << 61 - 2 * l | 1 << 60 - 2 * l)(r.randrange(31))
        a = mk(r.randrange(4))
        b = mk(a >> 61) if r.random() < 0.8 else mk(r.randrange(4))
        if r.random() < 0.5:
            l = (60 - ((b & -b).bit_length() - 1)) // 2
            k = r.randrange(l + 1)
            b = (a >> 61 - 2 * k << 61 - 2 * k) | (b & ((1 << 61 - 2 * k) - 1)) if (60 - ((a & -a).bit_length() - 1)) // 2 >= k else b
        pairs.append((a, b, brute(a, b)))
    df = spark.createDataFrame(pairs, "a long, b long, e int").withColumn("g", cells.common_level("a", "b"))
    assert df.where(~F.col("g").eqNullSafe(F.col("e"))).count() == 0


def test_ranges_and_descendants(spark):
    df = ids(spark, 1 << 60, 3 << 61 | 1 << 40).withColumn("r", cells.cell_range("id")).withColumn("d", cells.descendant_30("id", F.lit(12345)))
    assert df.where((cells.level("d") != 30) | (cells.ancestor("d", cells.level("id")) != F.col("id")) | (F.col("d") < F.col("r.lo")) | (F.col("d") > F.col("r.hi"))).count() == 0


def test_small_numbers(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (255, 8), (256, 9)], "x long, e int")
    assert df.where(cells.required_width("x") != F.col("e")).count() == 0
    assert one(spark.range(3), cells.maximum_nodes("id")) == [6, 24, 96]


def test_fixed_point(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (-99999.0,), (0.0,), (None,), (2.0**-21,)], "p float")
    assert one(df, fixedpoint.source_to_fixed("p")) == [1 << 19, 1 << 20, None, None, None, 1]
    for bad in (-1.0, float("inf"), float("-inf"), float("nan"), 2.0**43):
        df = spark.createDataFrame([(bad,)], "p float")
        assert one(df, fixedpoint.try_to_fixed("p")) == [None]
        with pytest.raises(Exception, match="invalid population"):
            df.select(fixedpoint.source_to_fixed("p")).collect()
    assert one(spark.createDataFrame([(2.0**42,)], "p float"), fixedpoint.to_fixed("p")) == [1 << 62]


def test_sql_functions_say_the_same(spark):
    from gridcover.functions import sql

    sql.register(spark)
    q = spark.range(400).select(cells.from_path(F.col("id") % 6, F.col("id") % 31, F.expr("(id * 7919 + 13) & (shiftleft(1L, cast(2 * (id % 31) as int)) - 1)")).alias("id"), (F.col("id") % 5).cast("int").alias("up"))
    q = q.withColumn("at", F.greatest(F.lit(0), cells.level("id") - F.col("up")))
    pairs = [
        ("cell_face(id)", cells.face("id")), ("try_cell_level(id)", cells.try_level("id")), ("cell_level(id)", cells.level("id")), ("cell_ancestor(id, at)", cells.ancestor("id", F.col("at"))),
        ("try_cell_ancestor(id, 31)", cells.try_ancestor("id", 31)), ("cell_child_index(id, at - 1)", F.when(F.col("at") > 0, cells.child_index("id", F.col("at") - 1))), ("cell_hex(id)", cells.hex_id("id")),
        ("cell_range_low(id)", cells.cell_range("id")["lo"]), ("cell_range_high(id)", cells.cell_range("id")["hi"]), ("cell_to_compact(id)", cells.to_compact("id")), ("cell_face_root(cell_face(id))", cells.face_root(cells.face("id"))),
        ("cell_from_compact(cell_to_compact(id))", cells.from_compact(cells.to_compact("id"))), ("compact_level(cell_to_compact(id))", cells.compact_level(cells.to_compact("id"))),
        ("compact_ancestor(cell_to_compact(id), 0)", cells.compact_ancestor(cells.to_compact("id"), 0)), ("CASE WHEN cell_level(id) < 30 THEN cell_children(id) END", F.when(cells.level("id") < 30, cells.children(F.when(cells.level("id") < 30, F.col("id")).otherwise(F.lit(1 << 60))))),
    ]
    got = q.select(*[F.expr(s).eqNullSafe(c).alias(f"c{k}") for k, (s, c) in enumerate(pairs) if "child_index" not in s])
    assert all(all(r) for r in got.collect())
    deep = q.where("at > 0").select(F.expr("cell_child_index(id, at - 1)").eqNullSafe(cells.child_index("id", F.col("at") - 1)).alias("ok"))
    assert all(r["ok"] for r in deep.collect())
    bad = spark.sql("SELECT id, cell_is_valid(id) AS ok, try_cell_level(id) AS l FROM VALUES (0L), (-1L), (2L), (CAST(NULL AS BIGINT)), (-9223372036854775808L) AS t(id)").collect()
    assert all(not r["ok"] and r["l"] is None for r in bad)
    with pytest.raises(Exception, match="not a cell id"):
        spark.sql("SELECT cell_level(2L)").collect()
    with pytest.raises(Exception, match="no ancestor"):
        spark.sql("SELECT cell_ancestor(cell_face_root(2), 1)").collect()
