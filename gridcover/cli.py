"""Command line: build a cover from a raster or a pixel table, verify, inspect and measure it."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import cells
from .operators import checks, cover, lookup, verify, workload
from .sources import geotiff, pixels, s2pd


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    t = time.time()
    source = geotiff.read(spark, args.tiff_path, geotiff.EXPECTED if args.pinned else None, args.sha256) if args.tiff_path else pixels.read(spark, args.pixels_path)
    c = cover.Cover.build(source)
    c.save(args.database_path)
    if args.s2pd_path:
        s2pd.write(args.s2pd_path, c.leaves())
        checks.require(verify.set_difference(s2pd.read(spark, args.s2pd_path).select("compact"), c.leaves().select("compact")).select(F.col("side").alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail")))
    print(f"{c.count()} leaves in {time.time() - t:.1f} s")


def check(spark: SparkSession, args: argparse.Namespace) -> None:
    c = cover.Cover.load(spark, args.database_path)
    r = verify.verify(spark, c.members, verify.QUICK_PATHS if args.quick else None).first()
    print(f"{r['queries']} queries, {r['mismatches']} mismatches")
    if r["mismatches"]:
        raise SystemExit(1)


def inspect(spark: SparkSession, args: argparse.Namespace) -> None:
    for r in cover.level_histogram(cover.Cover.load(spark, args.database_path, verify=False).leaves()).orderBy("level").collect():
        print(f"Level {r['level']:2}: {r['cell_count']:8} {r['pct']:.4f}%")


def bench(spark: SparkSession, args: argparse.Namespace) -> None:
    c = cover.Cover.load(spark, args.database_path, verify=False)
    members = c.members.persist()
    for name, q in (("stored", workload.stored_descendants(c.leaves(), args.query_count)), ("global", workload.global_level_30(spark, args.query_count))):
        q = q.select("query_id", cells.to_compact("cell_id").alias("compact")).persist()
        n = q.count()
        took = workload.measure(lambda q=q: tuple(verify.checksum(lookup.by_tiles(q, members)).first()), args.repeat_count)
        r = workload.throughput(spark.createDataFrame([(x,) for x in took], "seconds double"), n).first()
        text = cover.format_histogram(lookup.by_tiles(q, members).select(F.col("answer_level").alias("level"))).first()[0]
        print(f"{name}: {n} queries, aggregate {r['aggregate_qps']:.0f}/s, median {r['median_qps']:.0f}/s; {text}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridcover")
    sub = p.add_subparsers(required=True)
    b = sub.add_parser("build")
    b.add_argument("--tiff-path")
    b.add_argument("--pixels-path")
    b.add_argument("--sha256")
    b.add_argument("--pinned", action="store_true", help="require the pinned raster's metadata")
    b.add_argument("--s2pd-path")
    v, i, m = sub.add_parser("verify"), sub.add_parser("inspect"), sub.add_parser("bench")
    v.add_argument("--quick", action="store_true")
    m.add_argument("--query-count", type=int, default=1_000_000)
    m.add_argument("--repeat-count", type=int, default=6)
    for s, f in ((b, build), (v, check), (i, inspect), (m, bench)):
        s.add_argument("--database-path", default="cover")
        s.set_defaults(run=f)
    args = p.parse_args(argv)
    args.run(spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
