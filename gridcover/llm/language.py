"""Language ID by multinomial naive Bayes over hashed character n-grams (operator 6).

Features: character bigrams and trigrams of the lower-cased text, runs of other characters than letters counting as one
space; each is hashed to a bucket. Learning takes at most about `fit_per_lang` documents of each language (those whose hash of
the id is below a threshold set from the language's count; the bound is a parameter), counts buckets where they are read
and keeps a matrix of log-probabilities, languages x buckets, of at most MATRIX_BYTES, that is broadcast. Scoring is a map
over Arrow batches: buckets of about CHARS_AT_ONCE characters as one array, rows of the matrix gathered and summed by document; longer
texts are read in pieces that begin with the two letters before, so that their n-grams are those of the whole text.
Texts are read once for scoring and, for the sampled documents, once for learning; nothing of a text is shuffled.

score is the posterior probability of the language. A text that is null or has no letter gets `und` and score 0. With
nothing to learn from, every text gets `und`. Ties go to the language that is first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, short_batches, table, tidy

MATRIX_BYTES = 16 << 20
CHARS_AT_ONCE = 1 << 18

_TABLE: np.ndarray | None = None


def _fold() -> np.ndarray:
    """For each code point, the lower-case letter's code point, or 32 for what isn't a letter."""
    global _TABLE
    if _TABLE is None:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x20000):
            x = chr(c)
            if x.isalpha():
                y = x.lower()
                t[c] = ord(y) if len(y) == 1 else c
        for c in range(0x20000, 0x110000, 0x10000):
            t[c : c + 0x10000] = np.arange(c, c + 0x10000) if c < 0x40000 else 32
        _TABLE = t
    return _TABLE


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text that each belongs to begins where starts says; letters of each."""
    joined = "\x00".join(texts) + "\x00"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    folded = _fold()[cp]
    folded[ends - 1] = 0
    letter = folded > 32
    letters = np.add.reduceat(letter.astype(np.int64), np.concatenate([[0], ends[:-1]]))
    keep = letter.copy()
    keep[1:] |= (folded[1:] == 32) & letter[:-1]
    keep[ends - 1] = True
    x = folded[keep].astype(np.uint64)
    stop = np.cumsum(np.add.reduceat(keep.astype(np.int64), np.concatenate([[0], ends[:-1]])))
    before = np.concatenate([[np.uint64(0)], x[:-1]])
    two = (before * np.uint64(0x9E3779B97F4A7C15) + x) * np.uint64(0xBF58476D1CE4E5B9)
    ahead = np.concatenate([[np.uint64(0)], two[:-1]])
    ahead[before == 0] = 0  # a text begins here, whatever was before
    three = (ahead ^ (x * np.uint64(0x94D049BB133111EB))) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    ids = np.stack([two >> shift, three >> shift], axis=1).astype(np.int32)
    return ids, np.concatenate([[0], stop[:-1]]), letters


def _cut(text: str) -> Iterator[tuple[str, int, bool]]:
    """The text in pieces of about CHARS_AT_ONCE characters: (piece, whether it begins with two letters of the piece before, whether it is the
    last). Each cut is within a run of letters; where there is none, a piece is longer."""
    start = 0
    while True:
        stop = start + CHARS_AT_ONCE
        while stop < len(text) and not text[stop - 2 : stop + 1].isalpha():
            stop += 1
        last = stop >= len(text)
        yield text[max(0, start - 2) : stop], start > 0, last
        if last:
            return
        start = stop


def _grams(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts, one after the other: which texts, the buckets of their n-grams, where each text's begin, and its letters."""
    held: list[tuple[int, str]] = []
    size = 0

    def flush():
        ids, starts, letters = grams([t for _, t in held], buckets)
        return np.array([k for k, _ in held]), ids, starts, letters

    for k, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > CHARS_AT_ONCE:
            yield flush()
            held, size = [], 0
        if len(t) <= CHARS_AT_ONCE:
            held.append((k, t))
            size += len(t) + 1
            continue
        for piece, joined, last in _cut(t):
            ids, _, letters = grams([piece], buckets)
            yield np.array([k]), ids[2 if joined else 0 : len(ids) if last else -1], np.array([0]), letters
    if held:
        yield flush()


def learn(docs: DataFrame, fit_per_lang: int = 4000, seed: int = 11, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in code point order, and the matrix buckets x languages of log-probabilities."""
    docs = docs.where(F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(lang_col)).agg(F.count("*")).collect()}
    langs = sorted(counts, key=lambda s: s.encode())
    if not langs:
        return [], np.zeros((1, 0), np.float32)
    buckets = 1 << 16
    while buckets > 1 << 10 and buckets * len(langs) * 4 > MATRIX_BYTES:
        buckets >>= 1
    limits = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, fit_per_lang / counts[k])))])
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11).cast("double") + 0.5) / float(1 << 53)
    sample = docs.where(chance < F.element_at(limits, F.col(lang_col))).where(F.col(text_col).isNotNull()).select(F.col(lang_col), F.col(text_col))
    short_batches(docs.sparkSession)
    index = {k: n for n, k in enumerate(langs)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if total is None:  # most partitions of a large table hold none of the sample
                total = np.zeros(len(langs) * buckets, np.int64)
            texts, of = b.column(1).to_pylist(), np.array([index[x] for x in b.column(0).to_pylist()], np.int64)
            for at, ids, starts, _ in _grams(texts, buckets):
                row = np.repeat(of[at], np.diff(np.append(starts, len(ids)))) * buckets
                total += np.bincount((ids + row[:, None]).ravel(), minlength=len(total))
        hit = np.flatnonzero(total) if total is not None else ()
        for k in range(0, len(hit), 50_000):
            part = hit[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["cell", "n"])

    cells = sample.mapInArrow(tidy(counted), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(langs) * buckets)
    total[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    total = total.reshape(len(langs), buckets) + smoothing
    logp = np.log(total / total.sum(axis=1, keepdims=True))
    return langs, np.ascontiguousarray(logp.T.astype(np.float32))


def score_texts(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return pred, score
    like, has = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool)
    for at, ids, starts, letters in _grams(texts, len(logp)):
        like[at] += np.add.reduceat(logp[ids[:, 0]] + logp[ids[:, 1]], starts, axis=0, dtype=np.float64)
        has[at] |= letters > 0
    like -= like.max(axis=1, keepdims=True, initial=-np.inf)
    p = np.exp(like)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    for k in np.flatnonzero(has):
        pred[k], score[k] = langs[best[k]], p[k, best[k]]
    return pred, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """docs with the predicted language and its posterior added (replacing columns of these names)."""
    docs = docs.drop(pred_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        for b in batches:
            pred, score = score_texts(b.column(at).to_pylist(), langs, logp)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, pred_col, score_col])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(tidy(scored), StructType([*docs.schema.fields]).add(pred_col, StringType()).add(score_col, DoubleType()))


def learn_from(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return learn(docs.where(~held_out("doc_id", 5, 0)))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn_from(docs))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
