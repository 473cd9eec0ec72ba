"""Language identification with language-bitmask n-gram filters.

Training gives each language the set of its most frequent letter n-grams. The
sets go into Bloom filters of equal size, stored bit-sliced: slot ``s`` holds one
bit per language, so one n-gram is looked up for all languages at once, by
and-ing its slots. A text's score for a language is the share of its n-grams
found in that language's filter, corrected for the filter's false positives.

The model is bounded: it is fitted on at most ``sample_docs`` labelled documents
a language (those with the smallest hash of their text), read whole, and keeps
``grams`` n-grams a language.

Defined results: a null text, or one without a letter, gets ``und`` and score 0,
as does every text if nothing could be learned; ties go to the language first by
code point; repeated rows are predicted alike; an empty table gives an empty
result; extra columns are ignored. Long texts are read in pieces that overlap by
an n-gram less one letter, so their length does not bound memory use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
NGRAM = 4
GRAMS = 6000
SAMPLE_DOCS = 400
SLOTS_PER_GRAM = 16
HASHES = 2
PIECE = 1 << 19

#: 64-bit odd multipliers (golden ratio, and those of the public splitmix64 finaliser).
_MUL = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


class _Letters:
    """Code point to lower-case code point for letters, to 0 for all else; filled as planes are met."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            low = np.zeros(0x110000, dtype=np.uint32)
            for c in range(0x110000):
                ch = chr(c)
                if ch.isalpha():
                    low[c] = ord(x) if len(x := ch.lower()) == 1 else c
            cls.table = low
        return cls.table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pieces(text: str, n: int) -> Iterator[str]:
    """Pieces of a long text; each repeats the last n - 1 characters of the one before."""
    for start in range(0, max(1, len(text) - n + 1), PIECE):
        yield text[start : start + PIECE + n - 1]


def _hashed(letters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that starts at each place, and which of them count.

    An n-gram is made of letters and single gaps; it counts if it starts inside
    or just before a word, that is, if one of its first two places is a letter.
    """
    h = np.zeros(len(letters) - n + 1, dtype=np.uint64)
    for i in range(n):
        h *= _MUL[0]
        h += letters[i : len(letters) - n + 1 + i]
    h ^= h >> np.uint64(31)
    h *= _MUL[1]
    h ^= h >> np.uint64(29)
    counts = (letters[: len(h)] != 0) | (letters[1 : len(h) + 1] != 0)
    return h, counts


def _laid(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined, n gaps apart, as letters; start and end of each."""
    gap = " " * n
    joined = gap + gap.join(texts) + gap
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + n)
    return _Letters.get()[_codes(joined)], ends - lengths, ends


def train(docs: DataFrame, n: int = NGRAM, grams: int = GRAMS, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """The most frequent n-gram hashes of each language in labelled ``docs``."""
    labelled = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    bounds = (
        labelled.groupBy("lang", "h").count()
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= sample_docs)
        .groupBy("lang").agg(F.max("h").alias("bound"))
    )
    # One row a language, as the model itself has to be held by every task.
    sample = labelled.join(F.broadcast(bounds), "lang").where("h <= bound").dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in _pieces(text, n):
                    h, counts = _hashed(_laid([piece], n)[0], n)
                    values, times = np.unique(h[counts], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))],
                        names=["lang", "gram", "times"],
                    )

    counted = sample.mapInArrow(count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    top = Window.partitionBy("lang").orderBy(F.col("times").desc(), "gram")
    kept = counted.withColumn("place", F.row_number().over(top)).where(F.col("place") <= grams)
    model: dict[str, np.ndarray] = {}
    # At most ``grams`` rows a language reach the driver.
    for row in kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).orderBy("lang").collect():
        model[row["lang"]] = np.array(row["grams"], dtype=np.int64).view(np.uint64)
    return dict(sorted(model.items()))


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, model: dict[str, np.ndarray], n: int = NGRAM) -> None:
        self.n, self.names = n, list(model)
        most = max([1, *(len(g) for g in model.values())])
        self.slots = 1 << int(most * SLOTS_PER_GRAM - 1).bit_length()
        self.words = -(-max(1, len(self.names)) // 64)
        self.table = np.zeros((self.words, self.slots), dtype=np.uint64)
        for i, grams in enumerate(model.values()):
            for at in self._at(grams):
                self.table[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
        self.false = np.array([(np.count_nonzero(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / self.slots) ** HASHES for i in range(len(self.names))])

    def _at(self, h: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.slots - 1)
        return [((h >> np.uint64(32 * i)) & mask).astype(np.int64) for i in range(HASHES)]

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language's filter holds."""
        letters, starts, ends = _laid(texts, self.n)
        h, counts = _hashed(letters, self.n)
        edges = np.append(np.stack([starts - self.n + 1, ends], 1).ravel(), len(h)).clip(0, len(h))
        add = lambda x: np.add.reduceat(np.append(x, 0), edges[:-1], dtype=np.int64)[::2]
        found = np.empty((len(self.names), len(texts)), dtype=np.int64)
        at = self._at(h)
        for w in range(self.words):
            bits = self.table[w][at[0]]
            for more in at[1:]:
                bits &= self.table[w][more]
            bits[~counts] = 0
            for i in range(64 * w, min(64 * (w + 1), len(self.names))):
                found[i] = add((bits >> np.uint64(i % 64) & np.uint64(1)).astype(np.int32))
        return add(counts.astype(np.int32)), found

    def decide(self, total: np.ndarray, found: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(total), np.zeros(len(total))
        share = found / np.maximum(total, 1)
        share = np.clip((share - self.false[:, None]) / (1 - self.false[:, None]), 0, 1)
        best = share.argmax(0)
        score = share[best, np.arange(len(total))]
        return [self.names[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)], np.where(total > 0, score, 0.0)


def predict(docs: DataFrame, model: dict[str, np.ndarray], n: int = NGRAM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``, from the text alone."""
    from .common import runs

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(model, n)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            total = np.zeros(len(texts), dtype=np.int64)
            found = np.zeros((len(filters.names), len(texts)), dtype=np.int64)
            for a, b in runs([len(t) for t in texts], PIECE):
                if b - a == 1:
                    for piece in _pieces(texts[a], n):
                        t, f = filters.hits([piece])
                        total[a] += t[0]
                        found[:, a] += f[:, 0]
                else:
                    total[a:b], found[:, a:b] = filters.hits(texts[a:b])
            names, score = filters.decide(total, found)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict all of them."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(marked.where("not held_out"))
    return predict(marked, model, keep=("doc_id", "held_out"))
