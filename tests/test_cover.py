import random

import pytest
from pyspark.sql import functions as F

from gridcover.functions import cells, fixedpoint
from gridcover.operators import checks, cover, lookup, rollup, verify, workload

#: The smallest cover of the stored form: one leaf on each face, of which one is at level 12.
MINIMAL = [0x00000001, 0x03000000, 0x05000000, 0x07000000, 0x09000000, 0x0B000000]


def level(c):
    return 12 - ((c & -c).bit_length() - 1) // 2


def anc(c, l):
    s = 24 - 2 * l
    return c >> s + 1 << s + 1 | 1 << s


def random_tree(seed, depth=12, n=60):
    r = random.Random(seed)
    out = {anc(f << 25 | 1, 0) for f in range(6)}
    for _ in range(n):
        c = r.randrange(6) << 25 | r.getrandbits(24) << 1 | 1
        out |= {anc(c, l) for l in range(r.randrange(depth + 1) + 1)}
    return out


def frame(spark, members):
    return spark.createDataFrame([(level(c), c) for c in sorted(members)], "level int, compact int")


@pytest.fixture(scope="module")
def tree(spark):
    members = random_tree(1)
    return members, frame(spark, members).persist()


def test_leaves_masks_nodes(spark, tree):
    members, df = tree
    leaf = {c for c in members if not any(anc(k, level(c)) == c and level(k) == level(c) + 1 for k in members)}
    assert {r["compact"] for r in cover.leaves(df).collect()} == leaf
    assert {r["compact"] for r in cover.closure(cover.leaves(df)).collect()} == members
    nodes = {(r["level"], r["compact"]): r for r in cover.nodes(df).collect()}
    for l in range(13):
        rank = 0
        for k, c in enumerate(sorted(m for m in members if level(m) == l)):
            kids = [m for m in members if level(m) == l + 1 and anc(m, l) == c]
            row = nodes[l, c]
            assert (row["node_index"], row["child_rank"]) == (k, rank)
            assert row["mask"] == sum(1 << (m >> 23 - 2 * l & 3) for m in kids)
            rank += len(kids)


def test_reconstruction(spark, tree):
    members, df = tree
    n = cover.nodes(df).persist()
    assert verify.set_difference(cover.reconstruct(n), cover.leaves(df)).agg(F.sum("n")).first()[0] == 0
    got = cover.mask_and_rank(n, spark.createDataFrame([(0, 0), (0, 99)], "level int, node_index long")).orderBy("node_index").collect()
    assert got[0]["child_rank"] == 0 and got[1]["mask"] is None


def test_reconstruction_is_one_chain(spark, tree):
    """Twelve joins, of which only those of the bounded levels may be broadcast; nothing is read anew for each level below."""
    members, df = tree
    n = cover.nodes(df).persist()
    qe = cover.reconstruct(n)._jdf.queryExecution()
    assert qe.analyzed().toString().count("Join LeftOuter") == 12
    assert qe.sparkPlan().toString().count("SortMergeJoin") == 12 - cover.BROADCAST_LEVEL - 1
    assert {r["compact"] for r in cover.reconstruct(n.where("level < 12")).collect()} == {r["compact"] for r in cover.leaves(df).collect()}
    assert cover.reconstruct(n.where("level < 0")).count() == 0
    gone = cover.reconstruct(n.where("level <> 5"))  # leaves above are kept, what is below can't be reached
    assert {r["compact"] for r in gone.collect()} == {r["compact"] for r in cover.leaves(df).where("level < 5").collect()}


def test_masks_read_members_once(spark):
    twice, lone = anc(1, 1), anc(0x05000001, 3)
    df = frame(spark, [anc(1, 0), twice, twice, 0x03000000, lone])
    assert sorted(r["compact"] for r in cover.leaves(df).collect()) == sorted([twice, twice, 0x03000000, lone])
    assert {r["compact"]: r["mask"] for r in cover.child_masks(df).collect()} == {anc(1, 0): 1, twice: 0, 0x03000000: 0, lone: 0}
    for got in (cover.leaves(df), cover.child_masks(df), cover.tiles(df)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_set_difference_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (3,), (None,), (None,)], "y long")
    d = verify.set_difference(a, b)
    assert {r["side"]: r["n"] for r in d.collect()} == {"left": 2, "right": 3}
    assert "Except" not in d._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in verify.set_difference(a.limit(0), a.limit(0)).orderBy("side").collect()] == [("left", 0), ("right", 0)]


def test_tiles_cover_everything(spark, tree):
    t = sorted((r["lo"], r["hi"]) for r in cover.tiles(tree[1]).collect())
    assert t[0][0] == 0 and t[-1][1] == 6 << 25 and all(a[1] == b[0] for a, b in zip(t, t[1:]))


def test_lookups_agree_with_the_walk(spark, tree):
    members, df = tree
    r, q = random.Random(2), []
    for k in range(1500):
        c = r.randrange(6) << 25 | r.getrandbits(24) << 1 | 1
        if r.random() < 0.5:
            c = r.choice(sorted(members)) & ~1 | 1 if r.random() < 0.5 else r.choice(sorted(members))
        q.append((k, anc(c, r.randrange(level(c) + 1))))
    want = {k: max((anc(c, l) for l in range(level(c) + 1) if anc(c, l) in members), key=level) for k, c in q}
    queries = spark.createDataFrame(q, "k long, compact int")
    for got in (lookup.deepest(queries, df), lookup.by_tiles(queries, df), lookup.by_neighbours(queries, cover.leaves(df)), lookup.by_neighbours(queries, cover.leaves(df), block_level=0), lookup.by_search(queries, cover.leaves(df))):
        assert {x["k"]: x["answer"] for x in got.collect()} == want
        assert all(x["answer_level"] == level(x["answer"]) for x in got.collect())


@pytest.mark.parametrize("most", [lookup.BROADCAST_ROWS, 0])
def test_lookups_whatever_is_broadcast(spark, tree, monkeypatch, most):
    """Few members: one stage without a shuffle. Many: by shuffled joins. Null ids and faces without members have no answer."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", most)
    members, df = tree
    df = df.where(cells.compact_face("compact") != 2)
    q = [(k, c) for k, c in enumerate([None, 2 << 25 | 1 << 24, 2 << 25 | 1, 3 << 25 | 1, 1 << 24, *sorted(members)[::7]])]
    want = {k: None if c is None or c >> 25 == 2 else max((anc(c, l) for l in range(level(c) + 1) if anc(c, l) in members), key=level) for k, c in q}
    queries = spark.createDataFrame(q, "k long, compact int")
    for how in (lookup.deepest, lookup.by_tiles):
        got = how(queries, df)
        assert {x["k"]: x["answer"] for x in got.collect()} == want and got.count() == len(q)
        assert all((x["answer"] is None) == (x["answer_level"] is None) for x in got.collect())
        plan = how(queries, df)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert ("Exchange hashpartitioning" in plan) == (most == 0)


def test_many_tiles_without_a_row_for_each_level(spark, tree, monkeypatch):
    """Shuffled lookups through tiles answer as those by keys do, for tiles above, at and below the blocks' level, and read members once."""
    members, df = tree
    r = random.Random(3)
    faceless = [6 << 25 | 1, 7 << 25 | 1 << 24, None]
    q = spark.createDataFrame(list(enumerate([anc(r.randrange(6) << 25 | r.getrandbits(24) << 1 | 1, r.randrange(13)) for _ in range(600)] + sorted(members) + faceless)), "k long, compact int")
    few = {x["k"]: x["answer"] for x in lookup.by_tiles(q, df).collect()}
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    for level in (0, 3, 6):
        got = lookup.by_tiles(q, df, block_level=level)
        assert {x["k"]: x["answer"] for x in got.collect()} == few and got.count() == len(few)
    plan = lookup.by_tiles(q, df)._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "array(25, 23" not in plan and "[25,23" not in plan
    assert "Join" not in lookup._tile_keys(df)._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_in_one_large_block(spark):
    """30,000 queries between 30,000 leaves of one block: no frame reaches forward to its end, which would take their product."""
    leaf = spark.range(30_000).select((1 + 4 * F.col("id")).cast("int").alias("compact"))
    q = spark.range(30_000).select("id", (1 + 2 * F.col("id") + F.when(F.col("id") % 3 == 0, 2).otherwise(0)).cast("int").alias("compact"))
    got = lookup.by_neighbours(q, leaf)
    windows = [x for x in got._jdf.queryExecution().analyzed().toString().splitlines() if "Window [" in x and "_leaf" in x]
    assert len(windows) == 2 and not any("unboundedfollowing" in x for x in windows)
    members = {anc(1 + 4 * k, l) for k in range(30_000) for l in range(13)}
    want = {(k, c): max((l for l in range(13) if anc(c, l) in members)) for k in range(0, 30_000, 97) for c in [1 + 2 * k + 2 * (k % 3 == 0)]}
    assert {(r["id"], r["compact"]): r["answer_level"] for r in got.where("id % 97 = 0").collect()} == want


def test_finer_queries_and_invalid_ids(spark, tree):
    df = spark.range(50).select(cells.from_path(F.col("id") % 6, F.lit(20), F.col("id") * 7919).alias("cell"))
    df = df.withColumn("a", lookup.query_compact("cell")).withColumn("b", cells.to_compact(cells.ancestor("cell", 12)))
    assert df.where("a <> b").count() == 0
    with pytest.raises(Exception, match="cell id"):
        spark.createDataFrame([(0,)], "cell long").select(lookup.query_compact("cell")).collect()


def test_verify_and_checks(spark, tree):
    members, df = tree
    assert verify.verify(spark, df, 16).first()["mismatches"] == 0
    assert verify.sampled_cells(spark, None, range(5)).count() == 6 * (4**5 - 1) // 3
    assert checks.cover_checks(cover.leaves(df)).where("not ok").count() == 0
    assert sum(6 * min(4**l, verify.QUICK_PATHS) for l in range(13)) == 180_222


@pytest.mark.parametrize(("leaves", "check"), [([], "not_empty"), ([*MINIMAL, 1], "unique"), (MINIMAL[1:], "all_faces"), ([*MINIMAL, 0x01000000], "no_overlap"), ([*MINIMAL, 0x10000000], "compact_in_range"), ([*MINIMAL, 2], "valid_cells")])
def test_bad_leaf_sets(spark, leaves, check):
    df = spark.createDataFrame([(c,) for c in leaves], "compact int")
    bad = {r["check"] for r in checks.leaf_set_checks(df).where("not ok").collect()}
    assert check in bad
    with pytest.raises(ValueError, match=check):
        checks.require(checks.leaf_set_checks(df))


def test_orphans(spark, tree):
    members, df = tree
    gone = next(c for c in members if 0 < level(c) < 12 and any(level(m) > level(c) and anc(m, level(c)) == c for m in members))
    assert checks.orphans(frame(spark, members - {gone})).count() > 0


def test_roll_up_forms(spark):
    pop = spark.range(300).select(((F.col("id") % 6).cast("int") * (1 << 25) + (F.col("id") * 7919 % (1 << 24)).cast("int") * 2 + 1).alias("compact"), (F.col("id") * 1000003 + 1).alias("population_fixed"))
    a, b = rollup.roll_up(pop), rollup.roll_up_sets(pop)
    assert verify.set_difference(a.select("level", "compact", "population_fixed"), b.select("level", "compact", "population_fixed")).agg(F.sum("n")).first()[0] == 0
    big = spark.createDataFrame([(1, 2**62), (3, 2**62)], "compact int, population_fixed long")
    with pytest.raises(Exception, match="OVERFLOW"):
        rollup.roll_up(big).collect()


def test_build_needs_all_faces(spark, tmp_path):
    px = spark.createDataFrame([(21600, 10080, 5000.0)], "pixel_x int, pixel_y int, population float")
    with pytest.raises(ValueError, match="faces"):
        cover.Cover.build(px)
    members = frame(spark, random_tree(4))
    c = cover.Cover(spark, members)
    c.save(str(tmp_path / "cover"))
    back = cover.Cover.load(spark, str(tmp_path / "cover"))
    assert verify.set_difference(back.members.select("level", "compact"), members).agg(F.sum("n")).first()[0] == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cover.Cover.load(spark, str(tmp_path / "none"))


def test_invalid_pixel_names_its_place(spark):
    px = spark.createDataFrame([(7, 9, -5.0)], "pixel_x int, pixel_y int, population float")
    with pytest.raises(Exception, match=r"pixel \(7, 9\)"):
        rollup.cell12_population(px).collect()


def test_workloads(spark, tree):
    import numpy as np

    def step(s):
        s = (s + workload.GAMMA) & (1 << 64) - 1
        z = ((s ^ s >> 30) * workload.MIX_A) & (1 << 64) - 1
        z = ((z ^ z >> 27) * workload.MIX_B) & (1 << 64) - 1
        return s, z ^ z >> 31

    s, want = 0, []
    for _ in range(5):
        s, v = step(s)
        want.append(v)
    assert workload.splitmix64(np.arange(5)).tolist() == want
    x, want = 5, []
    for _ in range(6):
        x = (x * workload.LCG_A + workload.LCG_C) & (1 << 64) - 1
        want.append(x)
    assert workload.lcg64(np.arange(6), 5).tolist() == want
    assert workload.spread_level_30(spark, 40).where(cells.level("cell_id") != 30).count() == 0
    q = workload.global_level_30(spark, 60)
    assert q.where(cells.level("cell_id") != 30).count() == 0 and q.select(cells.face("cell_id")).distinct().count() == 6
    q = workload.stored_descendants(cover.leaves(tree[1]), 300).select("cell_id", cells.to_compact("cell_id").alias("compact"))
    got = lookup.by_tiles(q, tree[1])
    assert q.count() >= 300 and got.join(cover.leaves(tree[1]).select(F.col("compact").alias("answer")), "answer", "left_anti").count() == 0
    r = workload.throughput(spark.createDataFrame([(2.0,), (4.0,)], "seconds double"), 10).first()
    assert (r["aggregate_qps"], r["median_qps"]) == (20 / 6, 3.75)
    assert [r["path"] for r in verify.sampled_cells(spark, 4, range(2, 3)).where("face = 0").orderBy("path").collect()] == [0, 4, 8, 12]
    assert verify.ordered_hash([1, 2]) != verify.ordered_hash([2, 1])


def test_threshold(spark):
    assert fixedpoint.THRESHOLD == 1000 << 20
    pop = spark.createDataFrame([(0, 1 << 24, fixedpoint.THRESHOLD), (0, 3 << 24, fixedpoint.THRESHOLD - 1)], "level int, compact int, population_fixed long")
    assert [r["compact"] for r in cover.tree(pop).collect()] == [1 << 24]


def test_plan_of_the_scan(spark, tmp_path):
    """The filter reaches the scan, only three columns are read, and one shuffle sums; no Python."""
    from gridcover.sources import pixels

    pixels.from_lineitem(spark, "/root/testdata/sf0.001").withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "px"))
    plan = rollup.cell12_population(pixels.read(spark, str(tmp_path / "px")))._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(population)" in plan and "Not(EqualTo(population" in plan and "other" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "partial_sum" in plan
