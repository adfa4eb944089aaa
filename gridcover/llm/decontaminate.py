"""Benchmark decontamination with an FM-index per training shard (operator 8).

Test phrases are all windows of `window` consecutive words of the benchmark items; an item of fewer words, but not none, is one window. A
shard is a run of documents of a partition of at most SHARD_WORDS words (a longer document is a shard of its own). Its
text is indexed as integers: words that occur in no phrase are one symbol, which ends a sequence; a stretch of phrase words
that is shorter than the shortest phrase holds no occurrence and is left out. The index answers each distinct phrase by
backward search through wavelet-tree ranks, locates its rows by sampled suffix positions, and the occurrences of a document
are merged into spans of words.

Distribution: documents stay where they are read, there is no shuffle. Phrases are broadcast in blocks of at most BLOCK_BYTES
of benchmark text (and 64 bytes an item). A pass over the documents takes up to BLOCKS_A_PASS blocks, one after the other on a shard; further
blocks are further passes, and what a pass found is written before the next, so that a task holds the phrases of one pass only. Removal cuts the spans of all blocks at
once and searches changed texts again in all blocks: with one block while they are at hand, with more in rounds over the documents
that changed, each of which is written.

Null texts and texts without words have no words and no hits. Benchmark rows that repeat an id count as one item; a null id
counts as ''.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from .common import free_name, matches, materialize, short_batches, table, tidy
from .fm_index import FMIndex

SHARD_WORDS, BLOCK_BYTES, BLOCKS_A_PASS = 2_000_000, 4 << 20, 4
#: A word, in UTF-8 bytes that are lower-cased in A-Z.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Phrases:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10):
        self.ids = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set[int]] = {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            for k in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[k : k + window]), set()).add(number[item])
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.patterns = np.zeros((len(found), max(self.lengths, default=1)), np.int32)
        for n, p in enumerate(found):
            self.patterns[n, : len(p)] = p
        self.owners = np.array([i for s in found.values() for i in sorted(s)], np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(s) for s in found.values()])]).astype(np.int64)
        self.shortest = int(self.lengths.min()) if found else 0

    def symbols(self, text: str | None) -> np.ndarray:
        words = matches(_WORD, text.encode("utf-8", "surrogatepass").lower()) if text else ()
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32)


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... for counts[k] numbers, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def search_shard(phrases: Phrases, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the symbols of documents: the merged spans (document, first word, last word + 1) and (document, item) pairs."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(d) for d in docs], np.int64)
    if not phrases.shortest or not sizes.sum():
        return np.zeros((0, 3), np.int64), none, none, sizes
    base = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 after each document
    whole = np.zeros(int(base[-1]), np.int32)
    for d, b in zip(docs, base[:-1], strict=True):
        whole[b : b + len(d)] = d
    inside = whole > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return np.zeros((0, 3), np.int64), none, none, sizes
    origin = _expand(begin, end - begin + 1)  # each sequence with the 0 behind it
    text = whole[origin]
    index = FMIndex(text)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return np.zeros((0, 3), np.int64), none, none, sizes
    counts = hi[hit] - lo[hit]
    phrase = np.repeat(hit, counts)
    at = origin[index.locate(_expand(lo[hit], counts))]
    doc = np.searchsorted(base, at, side="right") - 1
    cover = np.zeros(len(whole) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[phrase], -1)
    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(base, first, side="right") - 1
    spans = np.stack([of, first - base[of], last - base[of]], axis=1)
    pairs = np.unique(doc * len(phrases.owner_at) + phrase)  # document and phrase, then document and item
    doc, phrase = pairs // len(phrases.owner_at), pairs % len(phrases.owner_at)
    many = phrases.owner_at[phrase + 1] - phrases.owner_at[phrase]
    pairs = np.unique(np.repeat(doc, many) * len(phrases.ids) + phrases.owners[_expand(phrases.owner_at[phrase], many)])
    return spans, pairs // len(phrases.ids), pairs % len(phrases.ids), sizes


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between the words of a span."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = {a for a, _ in spans} | {b - 1 for _, b in spans}
    at = {k: m.span() for k, m in enumerate(_WORD.finditer(raw.lower())) if k in ends}
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _shards(batches: Iterator[pa.RecordBatch], at: int, phrases: Phrases):
    """Batches of a shard, and the symbols of their documents."""
    held, docs, size = [], [], 0
    for b in batches:
        start = 0
        for k, text in enumerate(b.column(at)):
            docs.append(phrases.symbols(text.as_py()))
            size += len(docs[-1])
            if size >= SHARD_WORDS:
                held.append(b.slice(start, k + 1 - start))
                yield held, docs
                held, docs, size, start = [], [], 0, k + 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if docs:
        yield held, docs


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).distinct()


def _n_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> int:
    return -(-(_items(benchmark, id_col, text_col).agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64)).first()[0] or 0) // BLOCK_BYTES)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    rows, n = _items(benchmark, id_col, text_col), _n_blocks(benchmark, id_col, text_col)
    for k in range(n):
        yield Phrases([(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()], window)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """docs with the number of words, the merged spans of hit words [first, last + 1) and the ids of items found."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    docs = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.array().cast("array<array<int>>"), names[2]: F.array().cast("array<string>")})
    schema = StructType(docs.schema.fields[:-3]).add(names[0], LongType()).add(names[1], ArrayType(ArrayType(IntegerType()))).add(names[2], ArrayType(StringType()))
    at_spans, at_items, keep = len(schema) - 2, len(schema) - 1, range(len(schema) - 3)

    def stage(df: DataFrame, blocks: list[Phrases]) -> DataFrame:
        shared = [spark.sparkContext.broadcast(p) for p in blocks]

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, texts in _shards(batches, at, shared[0].value):
                here: dict[int, list] = {}
                found: dict[int, list] = {}
                for n, one in enumerate(shared):
                    p = one.value
                    if n:
                        texts = [p.symbols(t.as_py()) for b in held for t in b.column(at)]
                    spans, doc, item, sizes = search_shard(p, texts)
                    for d, a, b in spans.tolist():
                        here.setdefault(d, []).append((a, b))
                    for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                        found.setdefault(d, []).append(p.ids[i])
                k = 0
                for b in held:
                    s = [sorted(x) if not (y := here.get(k + n)) else merged([*map(tuple, x), *y]) for n, x in enumerate(b.column(at_spans).to_pylist())]
                    f = [x if not (y := found.get(k + n)) else sorted({*x, *y}) for n, x in enumerate(b.column(at_items).to_pylist())]
                    n = pa.array(sizes[k : k + b.num_rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n, pa.array(s, pa.list_(pa.list_(pa.int32()))), pa.array(f, pa.list_(pa.string()))], names=[*(b.schema.names[c] for c in keep), *names])
                    k += b.num_rows

        return df.mapInArrow(tidy(searched), schema)

    blocks = _blocks(benchmark, item_col, item_text, window)
    docs = stage(docs, list(islice(blocks, BLOCKS_A_PASS)) or [Phrases([], window)])  # without a benchmark, the words are still counted
    while more := list(islice(blocks, BLOCKS_A_PASS)):
        docs = stage(materialize(docs, "decontamination-found"), more)
    return docs


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the hit words; what remains is searched again until it holds no window of the benchmark. Other columns stay, but
    for n_chars, which is the length of the new text."""
    spark = docs.sparkSession
    short_batches(spark)
    at, columns, schema = docs.columns.index(text_col), docs.columns, docs.schema

    def stage(df: DataFrame, phrases: Phrases) -> DataFrame:
        shared = spark.sparkContext.broadcast(phrases)

        def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for held, docs in _shards(batches, at, p):
                texts = [t for b in held for t in b.column(at).to_pylist()]
                todo = np.arange(len(docs))
                changed: set[int] = set()
                while len(todo):
                    spans = search_shard(p, docs)[0]
                    here: dict[int, list] = {}
                    for d, a, b in spans.tolist():
                        here.setdefault(int(todo[d]), []).append((a, b))
                    for d, s in here.items():
                        texts[d] = without(texts[d], s)
                    changed |= here.keys()
                    todo = np.array(sorted(here), np.int64)
                    docs = [p.symbols(texts[d]) for d in todo]
                k = 0
                for b in held:
                    if any(k <= d < k + b.num_rows for d in changed):
                        cols = list(b.columns)
                        cols[at] = pa.array(texts[k : k + b.num_rows], cols[at].type)
                        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
                    else:
                        yield b
                    k += b.num_rows

        return df.mapInArrow(tidy(cleaned), schema)

    if _n_blocks(benchmark, item_col, item_text) > 1:
        docs = _remove_in_rounds(docs, benchmark, window, text_col, item_col, item_text)
    else:
        for phrases in _blocks(benchmark, item_col, item_text, window):
            docs = stage(docs, phrases)
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length(text_col).cast(schema["n_chars"].dataType), F.col("n_chars")))
    return docs.select(*columns)


def _remove_in_rounds(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """docs without the hit words of all blocks, cut together; documents that changed go to the next round."""
    at = docs.columns.index(text_col)
    names = tuple(free_name(docs, x) for x in ("_n_words", "_spans", "_items"))
    flag = free_name(docs, "_changed")
    schema = StructType([*docs.schema.fields]).add(flag, BooleanType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(len(schema) - 1).to_pylist()
            cols = list(b.columns[:-1])
            if any(spans):
                texts = [without(t, s) if s else t for t, s in zip(cols[at].to_pylist(), spans, strict=True)]
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([bool(s) for s in spans], pa.bool_())], names=schema.names)

    left, done = docs, None
    while True:
        found = find(left, benchmark, window, text_col, item_col, item_text, names).select(*docs.columns, names[1])
        step = materialize(found.mapInArrow(tidy(cut), schema), "decontamination-round")
        clean = step.where(~F.col(flag)).drop(flag)
        done = clean if done is None else done.union(clean)
        left = step.where(flag).drop(flag)
        if left.isEmpty():
            return done


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0) x
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) x
), hit AS (SELECT doc_id, i, bw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p
), words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit) y) z GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) q GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
