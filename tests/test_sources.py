import numpy as np
import pytest
from pyspark.sql import functions as F
from .test_cover import MINIMAL, anc, frame, level, random_tree

from gridcover import cli
from gridcover.operators import cover, lookup, verify
from gridcover.sources import geotiff, s2pd
from gridcover.streaming import lookups


def leaves_of(members):
    return np.array(sorted(c for c in members if not any(level(k) == level(c) + 1 and anc(k, level(c)) == c for k in members)))


def test_minimal_file():
    data = s2pd.encode(np.array(MINIMAL))
    assert len(data) == 2245 and data[:4] == b"S2PD" and data == s2pd.encode(np.array(MINIMAL))
    assert s2pd.decode(data).tolist() == MINIMAL
    assert s2pd.decode(data, strict=False).tolist() == MINIMAL


@pytest.mark.parametrize("seed", range(4))
def test_random_files(seed):
    leaves = leaves_of(random_tree(seed, n=400) | {anc(1, l) for l in range(13)})
    data = s2pd.encode(leaves)
    assert s2pd.decode(data).tolist() == leaves.tolist()
    rng = np.random.default_rng(seed)
    refused = 0
    for _ in range(60):  # damage is refused, unless it makes the canonical file of other leaves
        at, bit = int(rng.integers(len(data))), int(rng.integers(8))
        bad = bytearray(data)
        bad[at] ^= 1 << bit
        try:
            assert s2pd.encode(s2pd.decode(bytes(bad))) == bytes(bad)
        except ValueError:
            refused += 1
    assert refused > 50
    with pytest.raises(ValueError):
        s2pd.decode(data[:-1])


def test_large_blocks():
    rng = np.random.default_rng(5)
    c = np.unique(rng.integers(0, 6 << 24, 60_000) * 2 + 1)
    leaves = np.unique(np.concatenate([c, [f << 25 | 1 for f in range(6)]]))
    assert s2pd.decode(s2pd.encode(leaves)).tolist() == leaves.tolist()


@pytest.mark.parametrize("bad", [[], [*MINIMAL[:2], MINIMAL[1], *MINIMAL[2:]], MINIMAL[1:], [MINIMAL[0], 0x01000000, *MINIMAL[1:]], [2, *MINIMAL[1:]], [f << 25 | 1 << 24 for f in range(6)]])
def test_bad_leaves(bad):
    with pytest.raises(ValueError):
        s2pd.encode(np.array(bad, np.int64))


def test_code_lengths():
    assert s2pd.code_lengths({0: 1, 1: 1, 2: 2, 3: 4}) == {0: 3, 1: 3, 2: 2, 3: 1}
    assert s2pd.code_lengths({4: 1, 5: 1, 6: 1}) == {4: 2, 5: 2, 6: 1}


def test_file_and_frame(spark, tmp_path):
    members = random_tree(7) | {anc(1, l) for l in range(13)}
    df = frame(spark, members)
    s2pd.write(str(tmp_path / "x.bin"), cover.leaves(df))
    assert verify.set_difference(s2pd.read(spark, str(tmp_path / "x.bin")), cover.leaves(df)).agg(F.sum("n")).first()[0] == 0
    with pytest.raises(FileNotFoundError):
        s2pd.read(spark, str(tmp_path / "none"))


def test_geotiff(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(3, 4)
    for name, how in (("a.tif", 1), ("b.tif", 8)):
        geotiff.write_mock(str(tmp_path / name), v, how)
        rows = geotiff.read(spark, str(tmp_path / name)).collect()
        assert {(r["pixel_x"], r["pixel_y"]): r["population"] for r in rows} == {(x, y): v[y, x] for y in range(3) for x in range(4)}
    wide = np.arange(77, dtype=np.float32).reshape(7, 11)
    geotiff.write_mock(str(tmp_path / "t.tif"), wide, 8, tile=4)
    df = geotiff.read(spark, str(tmp_path / "t.tif"), partitions=5)
    assert {(r["pixel_x"], r["pixel_y"]): r["population"] for r in df.collect()} == {(x, y): wide[y, x] for y in range(7) for x in range(11)}
    assert df.rdd.getNumPartitions() == 5  # one file, decoded in many tasks
    assert len(list(geotiff.tiles((tmp_path / "t.tif").read_bytes()))) == 6
    data = (tmp_path / "a.tif").read_bytes()
    m = geotiff.metadata(data)
    assert m["pixel_scale"] == geotiff.EXPECTED["pixel_scale"] and not geotiff.is_lzw(data)
    with pytest.raises(ValueError, match="width"):
        geotiff.require_metadata(m)
    for name in geotiff.EXPECTED:
        with pytest.raises(ValueError, match=name):
            geotiff.require_metadata(geotiff.EXPECTED | {name: "x"})
    geotiff.require_metadata(dict(geotiff.EXPECTED))
    good = geotiff.digest(str(tmp_path / "a.tif"))
    assert geotiff.read(spark, str(tmp_path / "a.tif"), sha256=good).count() == 12
    with pytest.raises(Exception, match="digest"):
        geotiff.read(spark, str(tmp_path / "a.tif"), sha256="0" * 64).count()


def test_lzw():
    def pack(data):
        table, out, cur, width = {bytes([k]): k for k in range(256)}, [], b"", 9
        bits = [(256, 9)]
        size = 258
        for b in data:
            nxt = cur + bytes([b])
            if nxt in table:
                cur = nxt
                continue
            bits.append((table[cur], width))
            table[nxt], size = size, size + 1
            if size + 0 > (1 << width) - 1 and width < 12:
                width += 1
            if size == 4094:
                bits.append((256, width))
                table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
            cur = bytes([b])
        bits += [(table[cur], width), (257, width)]
        text = "".join(format(c, f"0{w}b") for c, w in bits)
        return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")

    for data in (b"a" * 40, bytes(range(256)) * 3, b"-----A---B", np.arange(300, dtype="<f4").tobytes()):
        assert geotiff.unpack_lzw(pack(data)) == data


def test_digest_of_abc(spark):
    assert spark.sql("select sha2('abc', 256)").first()[0] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_stream(spark, tmp_path):
    members = frame(spark, random_tree(9))
    q = spark.range(100).select("id", ((F.col("id") % 6).cast("int") * (1 << 25) + (F.col("id") * 104729 % (1 << 24)).cast("int") * 2 + 1).alias("compact"))
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    w = lookups.resolve(stream, members).writeStream.format("memory").queryName("resolved").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        w.processAllAvailable()
    finally:
        w.stop()
    want = {r["id"]: r["answer"] for r in lookup.deepest(q, members).collect()}
    assert {r["id"]: r["answer"] for r in spark.sql("select * from resolved").collect()} == want


def test_command_line(spark, tmp_path, capsys):
    from gridcover.sources import pixels

    pixels.from_lineitem(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "px"))
    db = str(tmp_path / "cover")
    cli.main(["build", "--pixels-path", str(tmp_path / "px"), "--database-path", db, "--s2pd-path", str(tmp_path / "c.bin")], spark)
    cli.main(["inspect", "--database-path", db], spark)
    cli.main(["bench", "--database-path", db, "--query-count", "500", "--repeat-count", "2"], spark)
    said = capsys.readouterr().out
    assert "66 leaves" in said and "Level 12:       45" in said and "median" in said
