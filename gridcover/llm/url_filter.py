"""URL filters by a Bloom filter cascade (operator 10), in DataFrame expressions only.

A rule is (host, path, action). It fits a URL when its host is the URL's host or a parent domain of it and the URL's
path starts with its path. The longest fitting rule (characters of host + path, then the greater string) decides.

Every URL yields a few candidate keys `host-suffix || path-prefix`, one for each *shape* (number of host labels, path
length) that occurs in the rules. A cascade of Bloom filters answers, exactly for every key of the corpus's complete
key universe, whether a candidate is listed: level 1 encodes the listed keys, level 2 the keys of the universe that
level 1 lets pass wrongly, level 3 the listed keys that level 2 holds wrongly, and so on until none is left. A key
that first fails at an even level is listed, else not. A second cascade over the listed keys tells block from allow.
Filters are literals in the expressions, so that judging is one projection over the URL column: no join, no shuffle.

Sizes: filters grow with the list, not with the corpus (level 1 gets a false positive rate of about listed/universe).
`max_filter_bytes` bounds what becomes a literal; a longer list raises ValueError instead of being cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits in a byte of a filter: seven, so that each byte is an ASCII character.
_BITS, _CHUNK = 7, 4096


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    for stop in "/?#":
        rest = F.substring_index(rest, stop, 1)
    return F.coalesce(F.translate(rest, _AZ, _az), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    for stop in "?#":
        rest = F.substring_index(rest, stop, 1)
    return F.coalesce(F.substring(rest, F.length(url_host(url)) + 1, F.length(rest)), F.lit(""))


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int
    seed: int
    data: bytes

    def holds(self, key: Column) -> Column:
        """Whether the filter lets key pass; each further hash is only computed while the ones before pass."""
        out = F.lit(True)
        for h in reversed(range(self.hashes)):
            pos = F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + h)), F.lit(self.bits))
            byte = F.ascii(F.substring(F.lit(self.data), (F.floor(pos / _BITS) + 1).cast("int"), F.lit(1)).cast("string"))
            bit = F.call_function("shiftright", byte, (pos % _BITS).cast("int")).bitwiseAND(F.lit(1))
            out = F.when(bit == 1, out).otherwise(F.lit(False))
        return out


def build_bloom(keys: DataFrame, count: int, rate: float, seed: int, max_bytes: int) -> Bloom:
    """A filter over the `key` column of keys; its bytes are put together on the executors and arrive in chunks."""
    hashes = max(1, math.ceil(-math.log2(rate)))
    bits = max(64, math.ceil(1.4427 * max(1, count) * hashes))
    size = -(-bits // _BITS)
    if size > max_bytes:
        raise ValueError(f"{count} listed keys need a filter of {size} bytes; the bound is {max_bytes}")
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed * 64 + h)), F.lit(bits)) for h in range(hashes)]))
    marks = keys.select(at.alias("p")).select(F.floor(F.col("p") / _BITS).alias("i"), F.call_function("shiftleft", F.lit(1), (F.col("p") % _BITS).cast("int")).alias("v"))
    zeros = keys.sparkSession.range(size).select(F.col("id").alias("i"), F.lit(0).alias("v"))
    rows = (
        marks.unionByName(zeros)
        .groupBy("i")
        .agg(F.bit_or("v").alias("v"))
        .groupBy(F.floor(F.col("i") / _CHUNK).alias("c"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: F.char(x["v"])), "").alias("s"))
        .collect()
    )
    data = "".join(r["s"] for r in sorted(rows, key=lambda r: r["c"]))
    return Bloom(bits, hashes, seed, data.encode("ascii"))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def member(self, key: Column) -> Column:
        """Exact for the universe it was built over: listed exactly if the first level that stops key is an even one."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            out = F.when(self.levels[n].holds(key), out).otherwise(F.lit(n % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, universe_size: int, max_bytes: int, seed: int = 1) -> Cascade:
    """listed, universe: a column `key` each; keys of universe that are listed are no false positives.

    An empty list gives a cascade without levels, whose answer is always no.
    """
    inside = listed.where("key is not null").distinct()
    n = inside.count()
    levels: list[Bloom] = []
    if not n:
        return Cascade(())
    rate = min(0.5, max(1e-15, math.sqrt(0.5) * n / max(1, universe_size)))
    levels.append(build_bloom(inside, n, rate, seed, max_bytes))
    #: The other side's keys that pass all levels so far; about n of the universe at most, by the choice of rate.
    outside = universe.where(F.col("key").isNotNull() & levels[0].holds(F.col("key"))).distinct().join(F.broadcast(inside) if n <= 100_000 else inside, "key", "left_anti").checkpoint()
    sides = [outside, inside]
    while (n := sides[0].count()) > 0:
        levels.append(build_bloom(sides[0], n, 0.5, seed + len(levels), max_bytes))
        sides = [sides[1].where(levels[-1].holds(F.col("key"))), sides[0]]
    return Cascade(tuple(levels))


@dataclass(frozen=True)
class UrlFilter:
    """Compiled rules: `judge` adds host, path, rule and verdict by expressions alone."""

    shapes: tuple[tuple[int, int], ...]
    listed: Cascade
    blocked: Cascade
    default: str

    def rule(self, host: Column, path: Column) -> Column:
        best = [F.when(self.listed.member(k), F.struct(F.length(k).alias("n"), k.alias("k"))) for k in candidates(host, path, self.shapes)]
        best += [F.lit(None).cast("struct<n:int,k:string>")] * 2
        return F.greatest(*best)["k"]

    def verdict(self, rule: Column) -> Column:
        return F.when(rule.isNull(), self.default).when(self.blocked.member(rule), "block").otherwise("allow")


def candidates(host: Column, path: Column, shapes) -> list[Column]:
    """One key for each shape that the URL is long enough for, else null."""
    return [F.when((host != "") & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n))) for labels, n in shapes]


def compile_rules(rules: DataFrame, urls: DataFrame, url: str = "url", default: str = "allow", max_filter_bytes: int = 64 << 20) -> UrlFilter:
    """rules: host, path, action ('allow' or 'block'); rules with null or empty hosts fit nothing. Two rules with one key
    and two actions: block wins. urls: the corpus whose keys must be answered exactly; only its url column is read."""
    spark = rules.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        from .common import shared_dir

        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    rules = rules.where("host is not null and host <> ''").select(F.translate("host", _AZ, _az).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "action")
    rules = rules.select(F.concat("h", "p").alias("key"), (F.length("h") - F.length(F.translate("h", ".", "")) + 1).alias("labels"), F.length("p").alias("n"), "action")
    shapes = tuple(sorted((r["labels"], r["n"]) for r in rules.select("labels", "n").distinct().collect()))
    host, path = F.col("h"), F.col("p")
    keys = urls.select(url_host(F.col(url)).alias("h"), url_path(F.col(url)).alias("p")).select(F.explode(F.array(*candidates(host, path, shapes), F.lit(None).cast("string"))).alias("key"))
    size = urls.count() * max(1, len(shapes))
    listed = build_cascade(rules.select("key"), keys, size, max_filter_bytes, seed=1)
    block = rules.where("action = 'block'").select("key")
    blocked = build_cascade(block, rules.select("key"), max(1, rules.count()), max_filter_bytes, seed=1001)
    return UrlFilter(shapes, listed, blocked, default)


def judge(pages: DataFrame, rules: UrlFilter, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced)."""
    return (
        pages.withColumn("host", url_host(F.col(url)))
        .withColumn("path", url_path(F.col(url)))
        .withColumn("rule", rules.rule(F.col("host"), F.col("path")))
        .withColumn("verdict", rules.verdict(F.col("rule")))
    )


#: The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by RULES; where none fits, the cascade says that it isn't listed, which is allow."""
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(pages, compile_rules(rules, pages)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), rules(h, pre, act) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT u.page_id, u.host, u.path, rules.h || rules.pre AS rule, act,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rules.h || rules.pre) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
)
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM m WHERE k = 1
"""
