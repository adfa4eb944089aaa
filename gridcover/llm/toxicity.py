"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks (operator 9).

Kernel: two words are compared by the subsequences of ORDER characters that they share; each counts DECAY to the power of the
characters that it spans in either word, spans over REACH are left out, and the kernel is normalised by the words' lengths. Inserted
characters and gaps therefore cost some weight but do not hide a word. A word's beginning and end are characters too.
Characters that are no letters are dropped within a token, and letters that stand alone one after the other are also
read as one word.

Learning: sentences of labelled documents are bags of words. Words that are much more frequent in sentences of toxic
documents are the first witnesses; a linear machine (squared hinge) is fitted to Nyström coordinates of witnesses, of variants of
them with inserted characters, and of words of clean sentences. Then the best sentence of each document shows new
witnesses and the hardest clean words, and the machine is fitted once more. A second linear machine is fitted to sentences as
a whole: the TOP highest values of their words, repeated ones too, and how many are positive. Its weights are not negative, so that of
a document only sentences that no other one exceeds in everything matter; it starts with the sum of the values, and takes the best
sentence of each document anew. A logistic curve through the best sentences' values makes the score.

Scoring: the value of a word, sum of beta_j K(word, landmark_j), is a sum over its subsequences of one table of weights,
which is all that is broadcast (64 ** 3 numbers). Distinct words are valued in numpy and remembered, up to MEMORY tokens; a text's
value is that of its best sentence. A sentence ends at a line's end, and at . ! or ? before white space; a text without these is one
sentence. Texts are mapped where they are read.

Learning takes at most about `fit_rows` labelled documents of each class (by a threshold on a hash of the id; the bound is
a parameter); where a class is thinned, its rows weigh more in the curve, so that scores are shares among all labels. All words of the
sample that are telling are witnesses. What else the machine is fitted to is bounded by parameters as well (`Sizes`): how many words of clean
sentences, hard clean words and words of toxic documents found by the first machine, of how many witnesses there are variants,
and how many landmarks there are; these are what makes the kernel matrix, words by landmarks. Null or empty texts get the lowest score. Repeated labels of an id count as the larger one, and
rows that agree in id and text are learned from once. With no toxic
or no clean label to learn from, every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, release, short_batches, table, tidy

ORDER, REACH, DECAY = 3, 6, 0.7
#: Letters of a word that are looked at together; longer words are read in overlapping pieces.
PIECE = 16
MEMORY = 200_000
_MARK, _LETTERS = 63, 64
_END = re.compile(r"(?:[.!?][^\w\s]*\s|\n)\s*")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_LOWEST = -2.0
#: Words of a sentence whose values count one by one, what a value counts at least, and the scale of all but the best.
TOP, FLOOR, SECOND = 3, -1.0, 0.3


@dataclass(frozen=True)
class Sizes:
    """Bounds of what the machine of words is fitted to; the first in the order given are taken."""

    #: Words of clean sentences: those in most sentences, and others by a hash.
    common: int = 1000
    other: int = 4000
    #: Clean documents' best words, by value; toxic documents' best words above them, by count.
    hard: int = 2000
    found: int = 300
    #: Witnesses with variants, witnesses that may be landmarks, and landmarks; the most telling first.
    varied: int = 150
    pool: int = 400
    landmarks: int = 256


@cache
def _positions() -> tuple[np.ndarray, np.ndarray]:
    """Index triples within a piece and its two marks, by where they end, and the weight of each by its span."""
    n = PIECE + 2
    at = sorted(((i, *rest) for i in range(n) for rest in combinations(range(i + 1, min(n, i + REACH)), ORDER - 1)), key=lambda t: t[-1])
    return np.array(at).T, np.array([DECAY ** (t[-1] - t[0] + 1) for t in at], np.float32)


def _letters(words: list[str]) -> np.ndarray:
    """The codes of the letters of words of one length, between marks."""
    o = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32).reshape(len(words), -1)
    return np.pad(np.where((o >= 97) & (o <= 122), o - 96, 27 + o % 36), ((0, 0), (1, 1)), constant_values=_MARK)


class _Blanks(dict):
    """A translation of all but letters to blanks, filled as characters come."""

    def __missing__(self, o: int):
        self[o] = o if chr(o).isalpha() else " "
        return self[o]


_BLANKS = _Blanks()


def _words_of(token: str) -> list[str]:
    """What a token is read as: its letters as one word, and each stretch of letters, in pieces."""
    if token.isalpha():
        return pieces(token)
    parts = token.translate(_BLANKS).split()
    forms = {*parts, "".join(parts)} - {""}
    return [p for f in forms for p in pieces(f)]


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of each word (at most PIECE letters; 0 where there is none) and its factor."""
    chars = np.zeros((len(words), PIECE + 2), np.int32)
    for n, w in enumerate(words):
        chars[n, : len(w) + 2] = _letters([w])[0]
    (i, j, k), weight = _positions()
    codes = (chars[:, i] * _LETTERS + chars[:, j]) * _LETTERS + chars[:, k]
    codes[chars[:, k] == 0] = 0
    return codes, _scale()[[len(w) for w in words]]


@cache
def _scale() -> np.ndarray:
    """1 / norm of a word of each length, taken as if none of its subsequences came twice. A word's own factor keeps the kernel one."""
    at, weight = _positions()
    return np.array([1 / np.sqrt((weight[at[-1] < n + 2] ** 2).sum()) if n + 2 >= ORDER else 1.0 for n in range(PIECE + 1)], np.float32)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, words x landmarks."""
    codes, scale = subsequences(landmarks)
    weight = _positions()[1]
    used, at = np.unique(codes, return_inverse=True)
    matrix = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    np.add.at(matrix, (at.reshape(codes.shape), np.arange(len(landmarks))[:, None]), np.where(codes > 0, weight, 0) * scale[:, None])
    if used[0] == 0:
        matrix[0] = 0
    index = np.full(_LETTERS**ORDER, len(used), np.int32)
    index[used] = np.arange(len(used))
    out = []
    for k in range(0, len(words), 256):
        c, s = subsequences(words[k : k + 256])
        out.append(np.einsum("bfm,f->bm", matrix[index[c]], weight) * s[:, None])
    return np.concatenate(out) if out else np.zeros((0, len(landmarks)), np.float32)


@dataclass
class Machine:
    """Weights of subsequences, and the curve from values to scores."""

    table: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    pool: np.ndarray | None = None
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def values(self, words: list[str]) -> np.ndarray:
        """Words of one length go together, and only through the subsequences that fit into it."""
        (i, j, k), weight = _positions()
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.float32)
        order = np.argsort(size, kind="stable")
        ends = np.searchsorted(size[order], np.arange(PIECE + 2))
        for n in range(1, PIECE + 1):
            m = int(np.searchsorted(k, n + 2))
            for at in range(ends[n], ends[n + 1], 2048):
                rows = order[at : min(at + 2048, ends[n + 1])]
                chars = _letters([words[r] for r in rows])
                codes = (chars[:, i[:m]] * _LETTERS + chars[:, j[:m]]) * _LETTERS + chars[:, k[:m]]
                out[rows] = (self.table[codes] * weight[:m]).sum(axis=1) * _scale()[n]  # row by row alike, whatever the batch
        return out + self.bias

    def learn_tokens(self, tokens: list[str]) -> None:
        """Values for tokens in lower case: the highest of the words that each is read as. These are remembered, too."""
        odd = [(t, _words_of(t)) for t in tokens if len(t) > PIECE or not t.isalpha()]
        new = list(set(tokens).difference(t for t, _ in odd).union(*(f for _, f in odd)).difference(self.known))
        self.known.update(zip(new, np.maximum(self.values(new), _LOWEST).tolist(), strict=True))
        value = self.known.__getitem__
        self.known.update([(t, max((_LOWEST, *map(value, f)))) for t, f in odd])

    def sentences(self, texts: list[str | None]) -> tuple[list[list[list[str]]], np.ndarray, np.ndarray]:
        """The sentences of each text as lists of tokens, and of all sentences in a row the best word's value and the vector."""
        split = [_sentences(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        new = set().union(*flat).difference(self.known)
        if len(self.known) + len(new) > MEMORY:  # emptied before anything of these texts is looked up
            self.known.clear()
            new = set().union(*flat)
        self.learn_tokens(list(new))
        sizes = np.array([len(q) for q in flat], np.int64)
        values = np.fromiter(map(self.known.__getitem__, chain.from_iterable(flat)), np.float64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        ranked = values[np.lexsort((-values, np.repeat(np.arange(len(flat)), sizes)))]
        x = np.full((len(flat), TOP + 1), FLOOR)
        for k in range(TOP):
            has = sizes > k
            x[has, k] = np.maximum(FLOOR, ranked[starts[has] + k])
        x[:, TOP] = np.log1p(np.add.reduceat(values > 0, starts, dtype=np.float64)) if len(flat) else 0
        return split, ranked[starts], x

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return (x * self.pool[:-1]).sum(axis=1) + self.pool[-1]  # row by row alike, whatever the batch

    def best_tokens(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """Of each text, the value of the best sentence and the token in it that stands out most."""
        split, top, x = self.sentences(texts)
        value = top if self.pool is None else self.pooled(x)
        lowest = _LOWEST if self.pool is None else float(self.pooled(np.array([[FLOOR] * TOP + [0.0]]))[0])
        out, at = [], 0
        for sentences in split:
            if sentences:
                k = int(np.argmax(value[at : at + len(sentences)]))
                v = float(top[at + k])
                out.append((float(value[at + k]), min(w for w in sentences[k] if self.known[w] == v) if v > _LOWEST else ""))
            else:
                out.append((lowest, ""))
            at += len(sentences)
        return out

    def fronts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text, the vectors of sentences that no other one exceeds in everything."""
        split, _, x = self.sentences(texts)
        out, at = [], 0
        for sentences in split:
            out.append(_front(x[at : at + len(sentences)]) if sentences else np.array([[FLOOR] * TOP + [0.0]]))
            at += len(sentences)
        return out

    def scores(self, values: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(values), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -50, 50)))


def _sentences(text: str) -> list[list[str]]:
    """Tokens by sentence, in lower case; letters that stand alone also as one word, before them."""
    text = _SPACED.sub(lambda m: "".join(m.group().split()) + " " + m.group(), text).lower()
    for mark in ",;:":  # at a word's end they change nothing but how many tokens there are to value
        text = text.replace(mark + " ", " ")
    return [tokens for s in _END.split(text) if (tokens := s.split())]


def _front(x: np.ndarray) -> np.ndarray:
    """The distinct rows that no other row reaches or exceeds in every column."""
    out: list[np.ndarray] = []
    for row in np.unique(x, axis=0)[::-1]:  # what exceeds a row comes before it
        if not out or not (np.array(out) >= row).all(axis=1).any():
            out.append(row)
    return np.array(out)


def _in_batches(texts: pa.Array, machine: Machine) -> list[tuple[float, str]]:
    out = []
    for k in range(0, len(texts), 200):
        out += machine.best_tokens(texts.slice(k, 200).to_pylist())
    return out


def variants(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a character inserted, with two, and with a letter left out."""
    letters, out, w = "abcdefghijklmnopqrstuvwxyz", [], word
    for _ in range(2):
        k = int(rng.integers(1, max(2, len(w))))
        w = w[:k] + letters[int(rng.integers(26))] + w[k:]
        out.append(w[:PIECE])
    if len(word) > 5:
        k = int(rng.integers(1, len(word) - 1))
        out.append(word[:k] + word[k + 1 :])
    return out


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2e-4, steps: int = 1000) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated gradients; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.sum()
    top = float(np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1])
    step = 1 / (2 * top + penalty)
    w, u, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ u))
        new = u - step * (-2 * x.T @ (weight * y * slack) + penalty * np.append(u[:-1], 0))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit_words(toxic: list[tuple[str, float]], clean: list[str], sizes: Sizes = Sizes()) -> Machine:
    """A machine from witness words with weights, the most telling first, and words of clean sentences."""
    rng = np.random.default_rng(9)
    witness = [(p, w) for word, w in toxic for p in pieces(word)]
    odd = [(v, w / 4) for word, w in witness[: sizes.varied] for v in variants(word, rng)]
    clean = [p for w in clean for p in pieces(w)]
    pool = [w for w, _ in witness[: sizes.pool]]
    near, chosen = kernel(pool, pool), []
    for n in range(len(pool)):
        if len(chosen) < sizes.landmarks // 2 and (not chosen or near[n, chosen].max() < 0.9):
            chosen.append(n)
    marks = list(dict.fromkeys([pool[n] for n in chosen] + clean[: sizes.landmarks - len(chosen)]))
    words = [w for w, _ in witness + odd] + clean
    weight = np.array([w for _, w in witness + odd] + [0.0] * len(clean))
    y = np.where(weight > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 * weight / weight.sum(), 0.5 / max(1, len(clean)))
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    w = _hinge(kernel(words, marks).astype(np.float64) @ root, y, weight)
    beta = root @ w[:-1]
    codes, scale = subsequences(marks)
    lookup = np.zeros(_LETTERS**ORDER, np.float64)
    np.add.at(lookup, codes, np.where(codes > 0, _positions()[1], 0) * (scale * beta)[:, None])
    lookup[0] = 0
    return Machine(lookup.astype(np.float32), float(w[-1]))


def fit_sentences(fronts: list[np.ndarray], y: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Weights and bias for sentence vectors; a document is a set of vectors, of which its best one counts, and clean ones stay clean."""
    owner = np.repeat(np.arange(len(fronts)), [len(f) for f in fronts])
    starts = np.searchsorted(owner, np.arange(len(fronts)))
    x = np.concatenate(fronts)
    pool = np.append(np.ones(TOP), [0.0, 0.0])
    # shrinkage is stronger for all but the best word: one word is enough unless clean documents speak against it
    scale = np.array([1.0] + [SECOND] * TOP)
    hard: list[np.ndarray] = []
    for _ in range(rounds):
        order = np.lexsort((-(x @ pool[:-1]), owner))
        best = x[order[starts]]
        hard.append(best[y == 0])
        clean, toxic = np.unique(np.concatenate(hard), axis=0), best[y == 1]
        weight = np.concatenate([np.full(len(toxic), 0.5 / len(toxic)), np.full(len(clean), 0.5 / len(clean))])
        use = np.arange(TOP + 1)
        while True:
            w = _hinge(np.concatenate([toxic, clean])[:, use] * scale[use], np.where(np.arange(len(weight)) < len(toxic), 1.0, -1.0), weight)
            if (w[:-1] >= 0).all():
                break
            use = use[w[:-1] > 0]
        pool = np.zeros(TOP + 2)
        pool[use], pool[-1] = w[:-1] * scale[use], w[-1]
    return pool


def _curve(values: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted values, by Newton's steps with a little shrinkage."""
    a = np.column_stack([values, np.ones(len(values))])
    weight = weight / weight.sum()
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([2e-3, 1e-6])
        w = w - np.linalg.solve(hess, a.T @ (weight * (p - y)) + np.array([2e-3, 0]) * w)
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = 3000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> Machine:
    labels = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    n = {r[0]: r[1] for r in labels.groupBy("_y").count().collect()}
    if not n.get(1) or not n.get(0):
        return Machine(np.zeros(1, np.float32), constant=1.0 if n.get(1) else 0.0)
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id"), 11).cast("double") + 0.5) / float(1 << 53)
    labels = labels.where(chance < F.when(F.col("_y") == 1, min(1.0, fit_rows / n[1])).otherwise(min(1.0, fit_rows / n[0])))
    kept = {r[0]: r[1] for r in labels.groupBy("_y").count().collect()}
    if not kept.get(1) or not kept.get(0):
        return Machine(np.zeros(1, np.float32), constant=n[1] / (n[1] + n[0]))
    stands = np.array([n[0] / kept[0], n[1] / kept[1]])  # labels of its class that a sampled one stands for
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(labels), "_id").where("_t is not null")
    sample = materialize(sample.select("_id", "_y", "_t").distinct(), "toxicity-sample")
    # a sentence of a clean document is clean wherever it stands; copies count once
    sentences = sample.select("_y", F.explode(F.split("_t", r"[.!?\n]+")).alias("s")).groupBy("s").agg(F.min("_y").alias("y"))
    words = sentences.select("y", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(s), '\\p{L}+', 0)"))).alias("w")).where("length(w) > 2")
    counts = materialize(words.groupBy("w").agg(F.sum("y").cast("double").alias("c"), F.sum(1 - F.col("y")).cast("double").alias("d")), "toxicity-words")
    share, distinct = sentences.agg(F.avg("y")).first()[0], counts.count()
    if not share or share == 1:
        return Machine(np.zeros(1, np.float32), constant=float(share or 0))
    # log-likelihood ratio against the share of toxic sentences in the sample, where the words are counted too; by chance, no word of so many would exceed the log of their number
    c, d = F.col("c"), F.col("d")
    ratio = c * F.log(c / (c + d) / share) + F.when(d > 0, d * F.log(d / (c + d) / (1 - share))).otherwise(0.0)
    telling = counts.where(c / (c + d) > share).withColumn("s", ratio).where(F.col("s") > max(3.0, float(np.log(max(1, distinct))))).orderBy(F.desc("s"), "w").collect()
    most = F.col("c") * float(stands[1] / stands[0])  # toxic sentences, in the proportion of all labels
    common = counts.where((F.col("d") >= 2) & (most < 2 * F.col("d"))).orderBy(F.desc("d"), "w").limit(sizes.common).collect()
    other = counts.where((F.col("d") >= 1) & (most <= F.col("d"))).orderBy(F.xxhash64("w"), "w").limit(sizes.other).collect()
    if not telling:
        return Machine(np.zeros(1, np.float32), constant=n[1] / (n[1] + n[0]))
    witness = [(r["w"], r["s"]) for r in telling]
    known = {w for w, _ in witness}
    clean = list(dict.fromkeys([r["w"] for r in other[: sizes.landmarks * 2]] + [r["w"] for r in common] + [r["w"] for r in other[sizes.landmarks * 2 :]]))
    machine = fit_words(witness, clean, sizes)
    for _ in range(2):
        best = materialize(_best(sample, machine), "toxicity-best")
        edge = best.where("_y = 0").agg(F.percentile("v", F.lit(0.995))).first()[0]
        hard = best.where("_y = 0").groupBy("w").agg(F.max("v").alias("v")).orderBy(F.desc("v"), "w").limit(sizes.hard).collect()
        more = best.where((F.col("_y") == 1) & (F.col("v") > max(0.0, edge or 0.0))).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(sizes.found).collect()
        clean = [w for w in dict.fromkeys([_letters_of(r["w"]) for r in hard] + clean) if w and w not in known]
        machine = fit_words(witness + [(w, 5.0) for w in dict.fromkeys(_letters_of(r["w"]) for r in more) if w and w not in known], clean, sizes)

    got = _fronts(sample, machine).toPandas()
    y = got["_y"].to_numpy(np.int64)
    if len(y) and y.min() < y.max():
        fronts = [np.array(f).reshape(-1, TOP + 1) for f in got["x"]]
        machine.pool = fit_sentences(fronts, y)
        machine.slope, machine.shift = _curve(np.array([machine.pooled(f).max() for f in fronts]), y.astype(np.float64), stands[y])
    release(sample.sparkSession)
    return machine


def _letters_of(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalpha())


def _best(sample: DataFrame, machine: Machine) -> DataFrame:
    """Label, value and token of the best sentence of each document of the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(machine)
    short_batches(sample.sparkSession)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _in_batches(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v for v, _ in got], pa.float64()), pa.array([w for _, w in got], pa.string())], names=["_y", "v", "w"])
        shared.value.known.clear()

    return sample.select("_y", "_t").mapInArrow(tidy(valued), "_y int, v double, w string")


def _fronts(sample: DataFrame, machine: Machine) -> DataFrame:
    """Label and, one after the other, the sentence vectors of each document of the sample that may be its best one's."""
    shared = sample.sparkSession.sparkContext.broadcast(machine)
    short_batches(sample.sparkSession)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [f.ravel().tolist() for k in range(0, b.num_rows, 200) for f in shared.value.fronts(b.column(1).slice(k, 200).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["_y", "x"])
        shared.value.known.clear()

    return sample.select("_y", "_t").mapInArrow(tidy(valued), "_y int, x array<double>")


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with the score added (replacing a column of that name)."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            if machine.constant is None:
                values = np.array([v for v, _ in _in_batches(b.column(at), machine)])
            else:
                values = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(machine.scores(values), pa.float64())], names=[*b.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(tidy(scored), StructType([*docs.schema.fields]).add(score_col, DoubleType()))


def learn_from(docs: DataFrame, labels: DataFrame) -> Machine:
    return learn(docs, labels.where(~held_out("doc_id", 4, 2)))


#: A document is toxic from this score on.
TOXIC = 0.3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn_from(docs, table(spark, sf_dir, "labels")), score_col="score")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
