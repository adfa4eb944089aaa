"""Exact self-join of documents on the Jaccard similarity of their word shingles (operator 5), with set-relation skipping.

Sets: distinct hashes (64 bits) of all runs of SHINGLE words; a shorter text is one run. Two sets link when
100 * |intersection| >= 80 * |union|. The steps:

1. Each text is read into its size, a 128-bit fingerprint of its set, and the first part of its set in the order of hashes that
   two linked sets must share a member of (prefix filter). Equal fingerprints become one class.
2. Shingles that are in more than HOT of these prefixes are put last in the order (at most MOST_HOT of them; the order is a
   matter of cost only), and the classes' prefixes are taken in that order. Classes whose prefixes still open large lists are
   read whole, what is common among them is put last too, and the prefixes that this changes are taken anew. A bit map of the shingles that two prefixes
   share, of a bounded size, lets all others be dropped before the inverted lists are dealt out.
3. Classes whose first common shingles open large lists are compared with the list's leader, the member with the fewest rare
   shingles. Those that link with it form one component with it: pairs within are skipped from here on. For all of them,
   the leader's answers bound their own: two classes share at most the lesser of their overlaps with the leader plus
   what they share outside of it, which their prefixes tell.
4. Shingles that stand in prefixes of one component only are dropped. Lists of more than SPLIT postings are split into blocks, so that no
   task gathers one: the blocks of the list's largest component meet those of the other members, and these each other. Lists are
   sorted by size; for each member only the block of sizes that can link is visited, and members whose
   positions, or whose leader's answers, rule out enough overlap are skipped. How often and how late a pair meets bounds its
   difference; pairs above that are dropped, then those whose whole prefixes differ too much. The remaining ones are
   checked on whole sets, each set's overlap derived from that of the set before it by their difference where both meet
   the same partner.
5. Links give components; each document gets its class's component, named by its smallest doc_id.

No step holds a list of all documents in one task or on the driver; classes, prefixes and sets are tables in the shared
folder. Counts of shingles are put together before they are shuffled. What is broadcast: hot shingles and split lists (MOST_HOT), the
bit map (BITMAP_BITS), ids of classes to be read again
while they are at most BROADCAST_IDS (else Spark joins by shuffle).

Null or empty texts, or texts without words, have an empty set and link with nothing, not even with each other. Rows that
repeat an id are documents of their own; a component is named by the smallest non-null doc_id in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, matches, materialize, release, short_batches, table, tidy
from .components import components

SHINGLE = 5
HOT, MOST_HOT, BITMAP_BITS, BROADCAST_IDS = 8, 1 << 19, 1 << 26, 200_000
#: Postings of a list beyond which it is split into blocks of that many.
SPLIT = 5000
#: Lists this long get a leader.
LEADER_FROM = 8
#: How many of a class's first shingles of large lists look for a leader.
LEADERS = 4
#: Classes with one leader in a block of those that are compared with another block.
GROUP = 500
#: Pairs that a task holds at once while it visits inverted lists; what it found so far goes on from there.
PAIRS = 1 << 17
#: The condition on two sizes and an overlap.
LINKS = "180 * o >= 80 * (nx + ny)"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = matches(_WORD, text.encode("utf-8", "surrogatepass").lower()) if text else ()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64)
    if len(h) < size:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], np.uint64) if len(h) else h
    out = h[: len(h) - size + 1] * _ODD[0]
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(31))) * _ODD[k % 5] + h[k : len(h) - size + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _ODD[1]
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes(), seed=len(s)) if len(s) else b""


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def prefix(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first members of a set in the order (hot, hash)."""
    p = prefix_length(len(s))
    if not len(hot) or not _among(s[:p], hot).any():
        return s[:p]
    late = _among(s, hot)
    return np.concatenate([s[~late], s[late]])[:p]


def _among(s: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(s), bool)
    at = np.searchsorted(ordered, s)
    at[at == len(ordered)] = 0
    return ordered[at] == s


def _spots(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each shingle, and its bit within the bucket's part of the bit map."""
    mixed = (tokens ^ (tokens >> np.uint64(33))) * _ODD[2]
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), ((mixed & np.uint64(0xFFFFFFFF)) % np.uint64(max(64, BITMAP_BITS // buckets))).astype(np.int64)


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row a bucket: the values of each column that fall into it, as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    stop = np.append(first[1:], len(bucket))
    cols = [[c[i:j].tobytes() for i, j in zip(first, stop, strict=True)] for c in (c[order] for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", *(f"c{k}" for k in range(len(columns)))])


def _gathered(t: pa.Table, kinds: list) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(t.column(f"c{k}").to_pylist()), kind) for k, kind in enumerate(kinds)]


def _together(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.Table]:
    """Batches of about that many bytes put together, so that what is counted in them is few rows to shuffle."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _totals(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a bucket, and how often they were counted."""
    tokens, n = _gathered(t, [np.uint64, np.uint8])
    order = np.argsort(tokens)
    tokens, n = tokens[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    return tokens[first], np.add.reduceat(n, first)


@dataclass(frozen=True)
class Splits:
    """The lists that are split: shingle, the component with most of the postings, and how many blocks there are of it and of the others."""

    tokens: np.ndarray
    main: np.ndarray
    blocks: np.ndarray
    others: np.ndarray

    def cells(self, tokens: np.ndarray, root: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For postings: which of them go where, as index, a name for the cell in the place of the shingle, and side. Blocks of the main
        component meet the blocks of the others, and these each other; members of the main component needn't meet. Each pair of postings
        meets in one cell; there, side 1 meets side 2, or all of side 0 each other."""
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        split = self.tokens[at] == tokens if len(self.tokens) else np.zeros(len(tokens), bool)
        whole, some = np.flatnonzero(~split), np.flatnonzero(split)
        at = at[some]
        blocks, others, main = self.blocks[at], self.others[at], root[some] == self.main[at]
        dealt = ((c[some].astype(np.uint64) * _ODD[0]) >> np.uint64(33)).astype(np.int64)
        times = np.where(main, others, blocks + others)
        index = np.repeat(some, times)
        r = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
        blocks, others, main, dealt = (np.repeat(v, times) for v in (blocks, others, main, dealt))
        own, between = dealt % others, ~main & (r >= blocks)
        j = r - blocks
        kind = between.astype(np.int64)
        a = np.where(main, dealt % blocks, np.where(between, np.minimum(own, j), r))
        b = np.where(main, r, np.where(between, np.maximum(own, j), own))
        side = np.where(main, 1, np.where(~between, 2, np.where(j == own, 0, np.where(own < j, 1, 2)))).astype(np.uint8)
        name = (tokens[index] ^ ((kind << 62 | a << 31 | b).astype(np.uint64) * _ODD[3])) * _ODD[4]
        return np.concatenate([whole, index]), np.concatenate([tokens[whole], name ^ (name >> np.uint64(29))]), np.concatenate([np.zeros(len(whole), np.uint8), side])


class Join:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, threshold_hot: int = HOT):
        self.spark, self.hot_from, self.whole = docs.sparkSession, threshold_hot, None
        short_batches(self.spark)
        self.docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        self.id_type = self.docs.schema["_id"].dataType.simpleString()

    # -- reading

    def read(self) -> None:
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, fp, pre = [], [], []
                for t in b.column(1):
                    s = shingles(t.as_py())
                    n.append(len(s))
                    fp.append(fingerprint(s))
                    pre.append(s[: prefix_length(len(s))].tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(pre, pa.binary())], names=["_id", "n", "fp", "pre"])

        read = materialize(self.docs.mapInArrow(tidy(sets), f"_id {self.id_type}, n long, fp binary, pre binary"), "jaccard-read")
        total = read.agg(F.sum(F.octet_length("pre"))).first()[0] or 0
        self.buckets = int(min(1 << 20, max(64, total // 8 // 100_000)))
        self.hot = self._hot(read)
        self.rows = materialize(read.select("_id", "n", "fp"), "jaccard-rows")
        discard(read)
        classes = self.rows.where("n > 0").groupBy("fp").agg(F.min("_id").alias("low"), F.first("n").alias("n"), F.count("*").alias("copies"))
        self.classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "jaccard-classes")
        self.repeats = not self.rows.groupBy("_id").count().where("count > 1").isEmpty()

    # -- counting what prefixes share

    def _tokens(self, pre: DataFrame) -> DataFrame:
        """Shingles by bucket, with how often they stand in a few megabytes of prefixes (up to 255: counts only decide on costs beyond)."""
        buckets = self.buckets

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _together(batches):
                tokens, n = np.unique(np.frombuffer(b"".join(t.column(0).to_pylist()), np.uint64), return_counts=True)
                if len(tokens):
                    yield _dealt(_spots(tokens, buckets)[0], tokens, np.minimum(n, 255).astype(np.uint8))

        return pre.select("pre").mapInArrow(tidy(dealt), "bucket long, c0 binary, c1 binary").groupBy("bucket")

    def _hot(self, pre: DataFrame) -> np.ndarray:
        least = self.hot_from

        def counted(t: pa.Table) -> pa.Table:
            tokens, n = _totals(t)
            many = n > least
            return pa.table({"token": pa.array(tokens[many].view(np.int64)), "n": pa.array(n[many], pa.int64())})

        got = self._tokens(pre).applyInArrow(counted, "token long, n long").orderBy(F.desc("n"), "token").limit(MOST_HOT).select("token").toArrow()
        return np.sort(got.column(0).to_numpy().view(np.uint64))

    def prefixes(self) -> None:
        shared = self.spark.sparkContext.broadcast(self.hot)

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [s for s in (shingles(t.as_py()) for t in b.column(0)) if len(s)]
                pre = [prefix(s, shared.value) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in pre], pa.binary())], names=["fp", "pre"])

        pre = self.docs.select("_t").mapInArrow(tidy(taken), "fp binary, pre binary").groupBy("fp").agg(F.first("pre").alias("pre"))
        self.pre = materialize(pre.join(self.classes.select("c", "n", "fp"), "fp").select("c", "n", "pre"), "jaccard-prefixes")
        release(self.spark)

    def count_lists(self, map_bits: bool = True) -> None:
        """The bits of the shingles that two prefixes share, by bucket, if asked for, and the shingles of large lists (the largest MOST_HOT / buckets
        of each bucket; which ones only decides who is compared with a leader first)."""
        buckets, least = self.buckets, LEADER_FROM - 1
        marked = self._marked

        def counted(t: pa.Table) -> pa.Table:
            tokens, n = _totals(t)
            large = np.flatnonzero(n > least)
            large = large[np.lexsort((tokens[large], -n[large]))][: max(1, MOST_HOT // buckets)]
            return pa.table({"bucket": t.column("bucket").slice(0, 1), "bits": pa.array([marked(buckets, tokens[n > 1]) if map_bits else b""], pa.binary()), "large": pa.array([tokens[large].tobytes()], pa.binary())})

        got = self._tokens(self.pre).applyInArrow(counted, "bucket long, bits binary, large binary").toArrow()
        if map_bits:
            self._bitmap(got)
        self.large = np.sort(np.frombuffer(b"".join(got.column(2).to_pylist()), np.uint64))

    @staticmethod
    def _marked(buckets: int, tokens: np.ndarray) -> bytes:
        """The bits of a bucket's part of the bit map for some of its shingles."""
        flags = np.zeros(-(-max(64, BITMAP_BITS // buckets) // 8) * 8, np.uint8)
        flags[_spots(tokens, buckets)[1]] = 1
        return np.packbits(flags).tobytes()

    def _bitmap(self, got: pa.Table) -> None:
        self.bits = np.zeros((self.buckets, -(-max(64, BITMAP_BITS // self.buckets) // 8)), np.uint8)
        for b, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            self.bits[b] = np.frombuffer(raw, np.uint8)

    def narrow(self, led: DataFrame) -> None:
        """Leaves those bits whose shingles stand in prefixes of several components, and finds the lists that are split. Of a list, what is
        shuffled are counts by component, put together before: no task sees its postings."""
        buckets, marked, shared = self.buckets, self._marked, self.spark.sparkContext.broadcast(self.bits)

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _together(batches):
                raw = t.column(1).to_pylist()
                tokens = np.frombuffer(b"".join(raw), np.uint64)
                root = np.repeat(t.column(0).to_numpy(), [len(x) // 8 for x in raw])
                bucket, bit = _spots(tokens, buckets)
                kept = np.flatnonzero(shared.value[bucket, bit >> 3] >> (7 - (bit & 7)) & 1)
                if len(kept):
                    tokens, root = tokens[kept], root[kept]
                    order = np.lexsort((root, tokens))
                    tokens, root = tokens[order], root[order]
                    first = np.flatnonzero(np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (root[1:] != root[:-1])]))
                    n = np.diff(np.append(first, len(tokens)))
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[first].view(np.int64)), pa.array(root[first], pa.int64()), pa.array(n, pa.int64())], names=["token", "root", "n"])

        pre = self.pre.select("c", "pre").join(_few(led.withColumnRenamed("node", "c")), "c", "left").select(F.coalesce("root", "c").alias("root"), "pre")
        lists = pre.mapInArrow(tidy(held), "token long, root long, n long").groupBy("token", "root").agg(F.sum("n").alias("n"))
        lists = lists.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1")
        lists = materialize(lists.select("token", "n", F.col("top.n").alias("most"), F.col("top.root").alias("main")), "jaccard-lists")

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tokens = b.column(0).to_numpy().view(np.uint64)
                if len(tokens):
                    yield _dealt(_spots(tokens, buckets)[0], tokens)

        def mapped(t: pa.Table) -> pa.Table:
            return pa.table({"bucket": t.column("bucket").slice(0, 1), "bits": pa.array([marked(buckets, _gathered(t, [np.uint64])[0])], pa.binary())})

        self._bitmap(lists.select("token").mapInArrow(tidy(dealt), "bucket long, c0 binary").groupBy("bucket").applyInArrow(mapped, "bucket long, bits binary").toArrow())
        long = lists.where(F.col("n") > SPLIT).orderBy(F.desc("n"), "token").limit(MOST_HOT).toArrow()
        tokens, n, most, main = (x.to_numpy() for x in long.columns)
        order = np.argsort(tokens.view(np.uint64))
        self.splits = Splits(tokens.view(np.uint64)[order], main[order], -(-most[order] // SPLIT), np.maximum(1, -(-(n - most)[order] // SPLIT)))
        release(self.spark)

    def settle(self) -> None:
        """Puts last all shingles that are common among classes whose prefixes open large lists, not only those that prefixes showed so far, and
        takes the prefixes that this changes anew. Then classes near a common text begin with what is their own."""
        if not len(self.large):
            self.count_lists()
            return
        late = self.spark.sparkContext.broadcast(np.union1d(self.large, self.hot))
        restless = materialize(self._opening(late), "jaccard-restless")
        whole = self._read_sets(restless)
        more = self._hot(whole.select(F.col("s").alias("pre")))
        self.hot = np.union1d(self.hot, more)
        late = self.spark.sparkContext.broadcast(self.hot)
        moved = materialize(self._opening(late).unionByName(restless).distinct(), "jaccard-moved")
        self.whole = materialize(whole.unionByName(self._read_sets(moved.join(whole, "c", "left_anti"))), "jaccard-settled")

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([prefix(x, late.value).tobytes() for x in sets], pa.binary())], names=["c", "n", "pre"])

        anew = self.whole.mapInArrow(tidy(taken), "c long, n long, pre binary")
        before = self.pre
        self.pre = materialize(before.join(self.whole.select("c"), "c", "left_anti").unionByName(anew), "jaccard-prefixes")
        discard(before)
        self.count_lists()

    def _opening(self, tokens) -> DataFrame:
        """c of the classes whose prefixes hold one of the broadcast shingles."""

        def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [bool(_among(np.frombuffer(x, np.uint64), tokens.value).any()) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["c"])

        return self.pre.select("c", "pre").mapInArrow(tidy(holding), "c long")

    # -- whole sets and links

    def sets(self, wanted: DataFrame) -> DataFrame:
        """c, s: whole sets of the classes in wanted (column c)."""
        wanted = materialize(wanted.distinct(), "jaccard-wanted")
        if self.whole is None:
            return self._read_sets(wanted)
        return self.whole.join(wanted, "c", "left_semi").unionByName(self._read_sets(wanted.join(self.whole, "c", "left_anti")))

    def _read_sets(self, wanted: DataFrame) -> DataFrame:
        """Whole sets, from the texts again."""
        ids = materialize(self.classes.join(wanted, "c", "left_semi").select("c", "low", "fp"), "jaccard-ids")
        rows = self.docs.join(_few(ids), F.col("_id").eqNullSafe(F.col("low"))).select("c", "fp", "_t")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c, out = [], []
                for k, fp, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    s = shingles(t.as_py())
                    if fingerprint(s) == fp:
                        c.append(k)
                        out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(out, pa.binary())], names=["c", "s"])

        out = rows.mapInArrow(tidy(whole), "c long, s binary")
        return materialize(out.dropDuplicates(["c"]) if self.repeats else out, "jaccard-whole")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """x, y, nx, ny and their overlap o, with r, how many members of x are in neither y nor x's prefix, and flags, which members
        of x's prefix are in y."""
        sets = self.sets(pairs.select(F.explode(F.array("x", "y")).alias("c")))
        both = pairs.select("x", "y").join(sets.select(F.col("c").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("c").alias("y"), F.col("s").alias("sy")), "y")
        hot = self.spark.sparkContext.broadcast(self.hot)

        def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows, last = [], None
                for k in sorted(range(len(x)), key=lambda k: (y[k], x[k])):
                    s = np.frombuffer(b.column(2)[k].as_py(), np.uint64)
                    if last is None or last[0] != y[k]:
                        t = np.frombuffer(b.column(3)[k].as_py(), np.uint64)
                        o = int(_among(s, t).sum())
                    else:  # what left the set before and what came, against the same partner
                        _, t, before, o = last
                        gone, new = before[~_among(before, s)], s[~_among(s, before)]
                        o += int(_among(new, t).sum()) - int(_among(gone, t).sum())
                    last = (y[k], t, s, o)
                    inside = _among(prefix(s, hot.value), t)
                    rows.append({"x": x[k], "y": y[k], "nx": len(s), "ny": len(t), "o": o, "r": len(s) - o - int((~inside).sum()), "flags": np.packbits(inside).tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("x", pa.int64()), ("y", pa.int64()), ("nx", pa.int32()), ("ny", pa.int32()), ("o", pa.int32()), ("r", pa.int32()), ("flags", pa.binary())]))

        return both.select("x", "y", "sx", "sy").mapInArrow(tidy(checked), "x long, y long, nx int, ny int, o int, r int, flags binary")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (x, y) that link."""
        return self.compared(pairs).where(LINKS).select("x", "y")

    def led(self) -> tuple[DataFrame, DataFrame]:
        """Of the classes in large lists: what the comparison with their leader gave (c, y, o, r, flags), and the components (node, root)
        of those that link with theirs."""
        large = self.spark.sparkContext.broadcast(self.large)

        def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for c, n, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    s = np.frombuffer(raw, np.uint64)
                    common = s[_among(s, large.value)]
                    rows += [{"c": c, "n": n, "rare": len(s) - len(common), "t": t} for t in common[:LEADERS].view(np.int64).tolist()]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("c", pa.int64()), ("n", pa.int64()), ("rare", pa.int32()), ("t", pa.int64())]))

        opened = materialize(self.pre.select("c", "n", "pre").mapInArrow(tidy(opening), "c long, n long, rare int, t long"), "jaccard-opened")
        lists = opened.groupBy("t").agg(F.min(F.struct("rare", "c", "n")).alias("lead"), F.count("*").alias("k")).where("k > 1").select("t", F.col("lead.c").alias("y"), F.col("lead.n").alias("m"))
        pairs = opened.join(lists, "t").where("c <> y and 5 * least(n, m) >= 4 * greatest(n, m)").select(F.col("c").alias("x"), "y").distinct()
        pairs = materialize(pairs, "jaccard-leaders")
        got = materialize(self.compared(pairs), "jaccard-compared")
        own = got.select("y", "ny").distinct().join(self.pre.select(F.col("c").alias("y"), "pre"), "y").select(F.col("y").alias("x"), "y", F.col("ny").alias("nx"), "ny", F.col("ny").alias("o"), F.lit(0).alias("r"), F.unhex(F.repeat(F.lit("FF"), F.ceil(F.octet_length("pre") / 64).cast("int"))).alias("flags"))
        # of several leaders the one of most classes, so that classes near one text have one leader; then the nearest
        many = got.groupBy("y").agg(F.count("*").alias("many"))
        near = got.unionByName(own).join(many, "y").groupBy("x").agg(F.max(F.struct("many", (F.col("o") / (F.col("nx") + F.col("ny") - F.col("o"))).alias("near"), "y", "nx", "o", "r", "flags")).alias("b"))
        near = materialize(near.select(F.col("x").alias("c"), "b.y", F.col("b.nx").alias("n"), "b.o", "b.r", "b.flags"), "jaccard-near")
        return near, materialize(components(got.where(LINKS)), "jaccard-led")

    def bordering(self, near: DataFrame, led: DataFrame) -> DataFrame:
        """Pairs with one leader, of different components, that its answers don't rule out even without a common member outside of it. One of
        them isn't of the leader's component; these few and the others are dealt out in blocks of about GROUP, and each block of
        these meets each of the others in a task of its own."""
        root = led.withColumnRenamed("node", "c")
        t = near.select("c", "y", "n", "o", "r").join(root, "c", "left").withColumn("root", F.coalesce("root", "c"))
        t = t.join(root.select(F.col("c").alias("y"), F.col("root").alias("lead")), "y", "left").withColumn("lead", F.coalesce("lead", "y"))
        edge = t.groupBy("y").agg(F.max("r").alias("most"), F.min("n").alias("least"))
        t = t.join(_few(materialize(edge, "jaccard-edges")), "y").where("9 * (o + r + most) >= 4 * (n + least)")
        t = materialize(t.select("c", "y", "n", "o", "r", "root", "lead"), "jaccard-bordering")
        blocks = t.groupBy("y").agg(F.ceil(F.count_if(F.col("root") != F.col("lead")) / GROUP).cast("int").alias("rows"), F.ceil(F.count("*") / GROUP).cast("int").alias("cols")).where("rows > 0")
        t = t.join(_few(materialize(blocks, "jaccard-blocks")), "y")
        deal = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = t.where("root <> lead").select("y", deal("rows").alias("row"), every("cols").alias("col"), *[F.col(k).alias(f"a_{k}") for k in ("c", "n", "o", "r", "root")])
        b = t.select("y", every("rows").alias("row"), deal("cols").alias("col"), *[F.col(k).alias(f"b_{k}") for k in ("c", "n", "o", "r", "root", "lead")])
        most = F.expr("least(a_o, b_o) + a_r + b_r")
        pairs = a.join(b, ["y", "row", "col"]).where("a_root <> b_root and (b_root = b_lead or a_c < b_c) and 5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)").where(9 * most >= 4 * (F.col("a_n") + F.col("b_n")))
        swap = F.col("a_c") > F.col("b_c")
        pick = lambda k: (F.when(swap, F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")), F.when(swap, F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")))
        (x, y), (nx, ny) = pick("c"), pick("n")
        return pairs.select(x.alias("x"), y.alias("y"), nx.alias("nx"), ny.alias("ny"), *[F.lit(v).alias(k) for k, v in (("k", 0), ("i", -1), ("j", -1))], most.alias("most"))

    def candidates(self, near: DataFrame, led: DataFrame) -> DataFrame:
        """Pairs x < y of classes of different components that may link.

        Two classes with one leader share at most the lesser of their overlaps with it, those of its non-members that both prefixes
        hold, and what is in neither prefix. Lists of the leader's members skip such pairs; those that may be near enough without a
        common member outside of the leader come from `bordering`.
        """
        self.narrow(led)
        buckets, shared, splits = self.buckets, self.spark.sparkContext.broadcast(self.bits), self.spark.sparkContext.broadcast(self.splits)
        pre = self.pre.select("c", "n", "pre").join(led.withColumnRenamed("node", "c"), "c", "left").join(near.drop("n"), "c", "left").select("c", "n", F.coalesce("root", "c").alias("root"), F.coalesce("y", F.lit(-1)).alias("y"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("flags", F.lit(b"")).alias("flags"), "pre")

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = b.column(7).to_pylist()
                size = np.array([len(x) // 8 for x in raw], np.int64)
                tokens = np.frombuffer(b"".join(raw), np.uint64)
                owner = np.repeat(np.arange(len(raw)), size)
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                bucket, bit = _spots(tokens, buckets)
                kept = np.flatnonzero(shared.value[bucket, bit >> 3] >> (7 - (bit & 7)) & 1)
                if len(kept):
                    inside = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8))[:n] if f else np.zeros(n, np.uint8) for f, n in zip(b.column(6).to_pylist(), size.tolist(), strict=True)])
                    value = [b.column(k).to_numpy() for k in range(6)]
                    index, name, side = splits.value.cells(tokens[kept], value[2][owner[kept]], value[0][owner[kept]])
                    kept = kept[index]
                    o = owner[kept]
                    for k in range(0, len(kept), 1 << 18):
                        part = slice(k, k + (1 << 18))
                        yield _dealt(_spots(name[part], buckets)[0], name[part], *(value[k][o[part]].astype(kind) for k, kind in enumerate(_POSTING[1:7])), at[kept[part]].astype(np.int32), inside[kept[part]], side[part])

        columns = ", ".join(f"c{k} binary" for k in range(len(_POSTING)))
        met = pre.mapInArrow(tidy(dealt), f"bucket long, {columns}").groupBy("bucket").applyInArrow(_met, "x long, y long, nx int, ny int, k int, i int, j int, most int")
        met = met.unionByName(self.bordering(near, led)).groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum("k").alias("k"), F.max("i").alias("i"), F.max("j").alias("j"), F.max("most").alias("most"))
        # up to the last common member, and up to the end of the prefix that ends first, all but k members are in one set only
        ends = lambda n: n - F.ceil(F.lit(4) * n / 5) + 1
        size = F.col("nx") + F.col("ny")
        apart = F.least(ends(F.col("nx")) + F.col("j") + 1, ends(F.col("ny")) + F.col("i") + 1) - 2 * F.col("k")
        least = F.ceil(F.lit(4) * size / 9)
        may = F.when(F.col("most") >= 0, F.col("most") + F.col("k") >= least).otherwise(apart <= size - 2 * least)
        met = materialize(met.where(may).select("x", "y", "nx", "ny"), "jaccard-met")
        sides = met
        for side in ("x", "y"):
            sides = sides.join(self.pre.select(F.col("c").alias(side), F.col("pre").alias(f"p{side}")), side)
        hot = self.spark.sparkContext.broadcast(self.hot)

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.zeros(b.num_rows, bool)
                for k, (nx, ny, px, py) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                    keep[k] = _apart(np.frombuffer(px, np.uint64), np.frombuffer(py, np.uint64), hot.value) <= nx + ny - 2 * -(-4 * (nx + ny) // 9)
                yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in range(2)], names=["x", "y"])

        return sides.select("x", "y", "nx", "ny", "px", "py").mapInArrow(tidy(close), "x long, y long")

    def labels(self) -> DataFrame:
        """node, root of classes in components of more than one."""
        self.count_lists(map_bits=False)
        self.settle()
        near, led = self.led()
        release(self.spark)
        found = materialize(self.candidates(near, led), "jaccard-candidates")
        release(self.spark)
        found = materialize(self.links(found), "jaccard-links")
        return components(found.unionByName(led.select(F.col("node").alias("x"), F.col("root").alias("y"))))

    def names(self) -> DataFrame:
        """fp, name, keeper of the classes that aren't alone or have copies: the smallest id of the component, and the class that has it.
        Large components and classes are many rows with one key, so that these are joined by broadcast while they are few."""
        labels = materialize(self.labels(), "jaccard-labels")
        grouped = labels.select("node", "root").unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
        low = self.classes.select("c", "fp", "low", "copies")
        of = materialize(low.join(_few(grouped), F.col("c") == F.col("node"), "left").where("root is not null or copies > 1").select("fp", "low", F.coalesce("root", "c").alias("root")), "jaccard-grouped")
        best = materialize(of.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("no"), F.col("low").alias("name"), F.col("fp").alias("keeper"))).alias("b")).select("root", "b.name", "b.keeper"), "jaccard-names")
        return _few(materialize(of.join(_few(best), "root").select("fp", "name", "keeper"), "jaccard-named"))


def _apart(a: np.ndarray, b: np.ndarray, hot: np.ndarray) -> int:
    """How many members, up to where the first of two prefixes ends in the order (hot, hash), are in one of them only."""
    late_a, late_b = _among(a, hot), _among(b, hot)
    end = min((bool(late_a[-1]), int(a[-1])), (bool(late_b[-1]), int(b[-1])))
    if end[0]:
        a, b = a[~late_a | (a <= np.uint64(end[1]))], b[~late_b | (b <= np.uint64(end[1]))]
    else:
        a, b = a[~late_a & (a <= np.uint64(end[1]))], b[~late_b & (b <= np.uint64(end[1]))]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) + len(b) - 2 * both


#: A posting: shingle or cell, class, size, component, leader, overlap with it, members in neither it nor the prefix, position, in the leader, side.
_POSTING = [np.uint64, np.int64, np.int32, np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8, np.uint8]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that meet in the lists of a bucket: sizes, how often, the last position in either, and for pairs with one leader the
    most that they can share apart from that leader's non-members met here (else -1). Their number grows with the square of a list's
    length, so that they leave in parts of about PAIRS; a pair may be in several."""
    names, kinds = ("x", "y", "nx", "ny", "k", "i", "j", "most"), [pa.int64()] * 2 + [pa.int32()] * 6
    for found in _summed_up(_meetings(_gathered(pa.Table.from_batches(batches), _POSTING))):
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(found, kinds, strict=True)], names=names)


def _meetings(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """The pairs of _met, a part of them at a time."""
    order = np.lexsort((columns[2], columns[0]))
    token, *rest, inside, side = (v[order] for v in columns)
    c, n, root, lead, o, r, at = (v.astype(np.int64) for v in rest)
    first = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0)
    stop = np.append(first[1:], len(token))
    rank = np.repeat(np.arange(len(first)), stop - first)

    def meet(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, among: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Members a with those of `among` from lo to hi; about PAIRS at a time."""
        counts = np.maximum(hi - lo, 0)
        done, ends = 0, np.cumsum(counts)
        while done < len(a):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
            k = counts[done:upto]
            x = np.repeat(a[done:upto], k)
            y = among[np.arange(len(x)) - np.repeat(np.cumsum(k) - k - lo[done:upto], k)]
            done = upto
            least = -(-4 * (n[x] + n[y]) // 9)
            ok = (root[x] != root[y]) & (np.minimum(at[x], at[y]) + np.minimum(n[x] - at[x], n[y] - at[y]) >= least)
            one = (lead[x] == lead[y]) & (lead[x] >= 0)
            most = np.where(one, np.minimum(o[x], o[y]) + r[x] + r[y], -1)
            ok &= ~one | (inside[x] == 0)
            x, y, most = x[ok], y[ok], most[ok]
            x, y = np.where(c[x] > c[y], y, x), np.where(c[x] > c[y], x, y)
            yield _summed(c[x], c[y], n[x], n[y], np.ones(len(x), np.int64), at[x], at[y], most)

    def within(a: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        return meet(a, np.arange(len(a)) + 1, np.searchsorted(n[a], n[a] * 5 // 4, side="right"), a)

    def between(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(a) and len(b):
            yield from meet(a, np.searchsorted(n[b], -(-4 * n[a] // 5)), np.searchsorted(n[b], n[a] * 5 // 4, side="right"), b)

    # lists that hold several members of one leader are taken apart; in the others, each member meets the block of later ones that are not too large
    led = np.flatnonzero((lead >= 0) & (inside == 1))
    owned, many = np.unique(np.stack([rank[led], lead[led]]), axis=1, return_counts=True)
    apart = np.unique(owned[0][many > 1])
    cross = np.unique(rank[side > 0])
    apart = apart[~np.isin(apart, cross)]
    plain = np.flatnonzero(~np.isin(rank, apart) & ~np.isin(rank, cross))
    if len(plain):
        scale = int(n.max()) * 2 + 2
        upto = np.searchsorted(rank * scale + n, rank * scale + np.minimum(n * 5 // 4, scale - 1), side="right")
        yield from meet(plain, plain + 1, upto[plain], np.arange(len(token)))
    for k in apart:
        members = np.arange(first[k], stop[k])
        rest, groups = members, []
        for leader in owned[1][(owned[0] == k) & (many > 1)]:
            mine = (lead[rest] == leader) & (inside[rest] == 1)
            groups.append(rest[mine])
            rest = rest[~mine]
        yield from within(rest)
        for g, group in enumerate(groups):
            yield from between(rest, group)
            for other in groups[g + 1 :]:
                yield from between(group, other)
    for k in cross:  # a cell of a split list: one side meets the other, but for members of one leader
        members = np.arange(first[k], stop[k])
        a, b = members[side[members] == 1], members[side[members] == 2]
        la, lb = (np.where(inside[v] == 1, lead[v], -1) for v in (a, b))
        both = np.intersect1d(la[la >= 0], lb[lb >= 0])
        yield from between(a[~np.isin(la, both)], b)
        for leader in both:
            yield from between(a[la == leader], b[lb != leader])


def _summed_up(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts put together while that makes them fewer: at most about twice PAIRS are held."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= PAIRS:
            part = _summed(*(np.concatenate(p) for p in zip(*held, strict=True)))
            held, n = [part], len(part[0])
            if n > PAIRS // 2:
                yield part
                held, n = [], 0
    if n:
        yield _summed(*(np.concatenate(p) for p in zip(*held, strict=True)))


def _summed(x, y, nx, ny, k, i, j, most):
    if not len(x):
        return x, y, nx, ny, k, i, j, most
    order = np.lexsort((y, x))
    x, y, nx, ny, k, i, j, most = (v[order] for v in (x, y, nx, ny, k, i, j, most))
    f = np.flatnonzero((np.diff(x, prepend=x[0] - 1) != 0) | (np.diff(y, prepend=y[0]) != 0))
    return x[f], y[f], nx[f], ny[f], np.add.reduceat(k, f), np.maximum.reduceat(i, f), np.maximum.reduceat(j, f), most[f]


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of each row of docs."""
    j = Join(docs, id_col, text_col)
    j.read()
    j.prefixes()
    names = j.names().select("fp", "name")
    out = j.rows.select("_id", "n", "fp").join(names, "fp", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of its smallest id; rows without words stay.

    Rows that are alone with their id are told by the id, so that texts aren't shuffled while the ids to be dropped are at most
    BROADCAST_IDS; rows that share an id, or have none, are told by id and fingerprint, and of equal ones one stays.
    """
    j = Join(docs, id_col, text_col)
    j.read()
    j.prefixes()
    rows = j.rows.select("_id", "fp").join(j.names(), "fp", "left")
    stays = F.col("keeper").isNull() | (F.col("_id").eqNullSafe(F.col("name")) & (F.col("fp") == F.col("keeper")))
    rows = materialize(rows.select("_id", "fp", stays.alias("stays")), "jaccard-decided")
    shared = materialize(rows.groupBy("_id").agg(F.count("*").alias("n"), F.bool_and("stays").alias("stays")), "jaccard-ids")
    key, fp = free_name(docs, "_key"), free_name(docs, "_fp")
    off = shared.where("n > 1 or not stays or _id is null").select(F.col("_id").alias(key))
    kept = docs.join(_few(off), F.col(id_col).eqNullSafe(F.col(key)), "left_anti")
    many = shared.where("n > 1 or _id is null").select(F.col("_id").alias(key))
    if many.isEmpty():
        return kept
    at = docs.columns.index(text_col)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(shingles(t.as_py())) for t in b.column(at)], pa.binary())], names=[*b.schema.names, fp])

    from pyspark.sql.types import BinaryType, StructType

    again = docs.join(many, F.col(id_col).eqNullSafe(F.col(key)), "left_semi").mapInArrow(tidy(marked), StructType([*docs.schema.fields]).add(fp, BinaryType()))
    mark = free_name(docs, "_mark")
    chosen = rows.where("stays").select(F.col("_id").alias(key), F.col("fp").alias(mark)).distinct()
    again = again.join(chosen, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(fp) == F.col(mark)), "left_semi")
    empty = again.where(F.octet_length(fp) == 0)
    return kept.unionByName(again.where(F.octet_length(fp) > 0).dropDuplicates([id_col, fp]).unionByName(empty).drop(fp))


def _few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it was counted and found to have at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0) x
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""
