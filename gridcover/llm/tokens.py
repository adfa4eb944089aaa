"""Token counts with a whole-token shortcut (operator 3).

Offline, `whole_tokens` proves which strings of the vocabulary are one pre-token and encode alone as exactly one token: it
encodes each and keeps those that come back as their own id. A text is cut at the tokenizer's special strings, then into
pre-tokens. Pre-tokens among the proven strings count one each by a dictionary look-up; each other distinct pre-token is
merged once by the tokenizer's own model and remembered. Counts equal those of the library for the whole text, since a
byte-level tokenizer merges within pre-tokens only and no pre-token of a text is cut differently when it stands alone.

Pre-tokens are found by `re` where a text has only characters whose class is known (ASCII and Latin letters up to
U+017F), by `regex` with Unicode classes elsewhere; both are the same pattern.

The proven set is bounded by the vocabulary. Texts of LONG characters or more are cut and counted step by step. The memory of merged pre-tokens is emptied at MEMORY entries. Documents
are counted where they are read: no shuffle. Null or empty texts have 0 bytes and 0 tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, short_batches, table, tidy

MEMORY = 300_000
#: The pre-token pattern of the byte-level vocabulary, with classes that both engines know.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"
_LATIN = {"L": r"[A-Za-zÀ-ÖØ-öø-ſ]", "N": "[0-9]", "S": r"\t-\r \x85\xa0", "l": r"A-Za-zÀ-ÖØ-öø-ſ", "n": "0-9"}
_WIDE = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "l": r"\p{L}", "n": r"\p{N}"}
_KNOWN = re.compile("[\x00-\x7f\x85\xa0À-ÖØ-öø-ſ«»¿¡–—‘’“”…€]*")


def splitter():
    """A function from a text to its pre-tokens."""
    import regex

    latin = re.compile(_PATTERN.format(**_LATIN)).findall
    wide = regex.compile(_PATTERN.format(**_WIDE)).findall
    known = _KNOWN.fullmatch

    return lambda text: latin(text) if known(text) else wide(text)


def _stepwise(text: str) -> Iterator[str]:
    """The same pre-tokens one after the other, for a text whose list of them would take much memory."""
    import regex

    return (m.group() for m in regex.finditer(_PATTERN.format(**_WIDE), text))


def whole_tokens(tokenizer, batch: int = 10_000) -> frozenset[str]:
    """The strings of the vocabulary that encode alone, as one pre-token, to their own id and nothing else."""
    split, vocab = splitter(), tokenizer.get_vocab(with_added_tokens=False)
    ids = list(vocab.values())
    proven = []
    for k in range(0, len(ids), batch):
        part = ids[k : k + batch]
        texts = tokenizer.decode_batch([[i] for i in part], skip_special_tokens=False)
        for i, text, got in zip(part, texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            if got.ids == [i] and split(text) == [text]:
                proven.append(text)
    return frozenset(proven)


def plain(tokenizer) -> None:
    tokenizer.no_truncation()
    tokenizer.no_padding()


class Counter:
    """Counts the tokens of texts by look-up, merging what isn't known yet."""

    def __init__(self, tokenizer, proven: frozenset[str], memory: int = MEMORY):
        plain(tokenizer)
        self.tokenizer, self.proven, self.memory, self.split = tokenizer, proven, memory, splitter()
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.cut = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.known = dict.fromkeys(proven, 1)

    def count(self, texts: list[str | None]) -> list[int]:
        pieces, extra = [], []
        for n, text in enumerate(texts):
            parts = [text or ""]
            if self.cut is not None and text and self.cut.search(text):
                parts = self.cut.split(text)
            extra.append(len(parts) - 1)
            if len(text or "") >= LONG:  # its pre-tokens are counted a slice at a time
                for p in parts:
                    rest = _stepwise(p)
                    while some := list(islice(rest, 100_000)):
                        extra[n] += self._counted([some])[0]
                pieces.append([])
            else:
                pieces.append([t for p in parts for t in self.split(p)] if len(parts) > 1 else self.split(parts[0]))
        return [a + b for a, b in zip(self._counted(pieces), extra, strict=True)]

    def _counted(self, pieces: list[list[str]]) -> list[int]:
        """Tokens of lists of pre-tokens."""
        known = self.known
        if len(known) > self.memory + len(self.proven):
            known = self.known = dict.fromkeys(self.proven, 1)
        new = list({t for p in pieces for t in p}.difference(known))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            known.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, p)) for p in pieces]


_COUNTERS: dict = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of docs. tokenizer_path must be readable on every executor."""
    from tokenizers import Tokenizer

    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(Tokenizer.from_file(tokenizer_path)))
    short_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _COUNTERS.get(tokenizer_path)
        if counter is None:
            counter = _COUNTERS[tokenizer_path] = Counter(Tokenizer.from_file(tokenizer_path), proven.value)
        for b in batches:
            out = [[], []]
            for k in range(0, b.num_rows, 250):
                texts = b.column(1).slice(k, 250).to_pylist()
                out[0] += [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                out[1] += counter.count(texts)
            n = pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), n, pa.array([x > limit for x in out[1]], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(counted), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
