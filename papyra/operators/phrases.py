"""Phrases of a dictionary at every place of texts, found by hashes in one pass over packed bytes."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Bytes of text that are searched at once.
PIECE_BYTES = 1 << 20
#: Of 2^64; odd, so it has an inverse.
BASE = 0x9E3779B97F4A7C15

_powers: list[np.ndarray] = []


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any stretch of some bytes, wherever it stands in them."""

    def __init__(self, data: np.ndarray):
        up, self.down = _grown(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _within(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array without offset, and where each string begins and the last ends."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[: len(strings) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, of bytes with spaces between them."""
    edge = np.diff(np.concatenate([[0], (data != 32).astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def written(spark: SparkSession, phrases: pa.Table) -> tuple[str, str]:
    """Names of two files that every executor has: phrases by hash, and first words by hash with the counts of words after them.

    ``alias`` holds words of ASCII with one space between them. The files are
    mapped, so workers of one machine share their memory.
    """
    phrases = phrases.combine_chunks()
    aliases = phrases["alias"].chunk(0) if len(phrases) else pa.array([], pa.string())
    data, at = _bytes_of(aliases)
    own, first, size = np.zeros(len(aliases), np.uint64), np.zeros(len(aliases), np.uint64), np.zeros(len(aliases), np.int32)
    low = 0
    while low < len(aliases):
        high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE_BYTES, side="right")) - 1)
        piece, ends = data[at[low] : at[high]], (at[low + 1 : high + 1] - at[low]).astype(np.int64)
        starts = (at[low:high] - at[low]).astype(np.int64)
        spaces = np.flatnonzero(piece == 32)
        hashes = Hashes(piece)
        own[low:high] = hashes.of(starts, ends)
        size[low:high] = np.searchsorted(spaces, ends) - np.searchsorted(spaces, starts) + 1
        first[low:high] = hashes.of(starts, np.minimum(np.append(spaces, len(piece))[np.searchsorted(spaces, starts)], ends))
        low = high
    order = np.argsort(own, kind="stable")
    by = np.lexsort([size, first])
    first, size = first[by], size[by]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (size[1:] != size[:-1])])[: len(by)]
    names = []
    for table in (phrases.take(pa.array(order)).append_column("hash", pa.array(own[order])), pa.table({"hash": first[new], "size": size[new]})):
        fd, path = tempfile.mkstemp(prefix="phrases-", suffix=".arrow", dir=spark.sparkContext._temp_dir)
        with os.fdopen(fd, "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table.combine_chunks())
        spark.sparkContext.addFile(path)
        names.append(os.path.basename(path))
    return names[0], names[1]


def _ranges(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and where each begins and the last ends."""
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[begins], np.append(begins, len(hashes))


def _met(values: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a value's place and a place in the sorted array with that value."""
    distinct, begins = known
    if not len(distinct):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(distinct, values)
    at[at == len(distinct)] = 0
    same = np.flatnonzero(distinct[at] == values)
    counts = begins[at[same] + 1] - begins[at[same]]
    return np.repeat(same, counts), np.repeat(begins[at[same]], counts) + _within(counts)


class Dictionary:
    """Phrases as ``written``."""

    def __init__(self, files: tuple[str, str]):
        tables = [pa.ipc.open_file(pa.memory_map(SparkFiles.get(f))).read_all().combine_chunks() for f in files]
        column = lambda t, name: t[name].chunk(0) if len(t) else pa.array([], t.schema.field(name).type)
        self.alias, self.code = column(tables[0], "alias"), column(tables[0], "code")
        self.bytes, self.at = _bytes_of(self.alias)
        self.hashes = _ranges(column(tables[0], "hash").to_numpy())
        self.firsts, self.sizes = _ranges(column(tables[1], "hash").to_numpy()), column(tables[1], "size").to_numpy()

    def hits(self, texts: list[str], apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, phrase and place, in words, of all hits; in texts that are ``apart`` only of those that no longer one overlaps."""
        data = np.frombuffer(" ".join(texts).encode("ascii"), dtype=np.uint8)
        begin, end = _words(data)
        lengths = np.array([len(t) + 1 for t in texts])
        text = np.searchsorted(np.cumsum(lengths) - lengths, begin, side="right") - 1
        limits = np.searchsorted(text, np.arange(len(texts) + 1))
        hashes = Hashes(data)
        word, kind = _met(hashes.of(begin, end), self.firsts)
        size = self.sizes[kind].astype(np.int64)
        inside = word + size <= limits[text[word] + 1]
        word, size = word[inside], size[inside]
        start, stop = begin[word], end[word + size - 1]
        which, phrase = _met(hashes.of(start, stop), self.hashes)
        # Equal hashes are not yet equal words.
        length = (self.at[phrase + 1] - self.at[phrase]).astype(np.int64)
        near = length == stop[which] - start[which]
        which, phrase, length = which[near], phrase[near], length[near]
        if len(which):
            each = _within(length)
            differ = data[np.repeat(start[which], length) + each] != self.bytes[np.repeat(self.at[phrase].astype(np.int64), length) + each]
            equal = ~np.logical_or.reduceat(differ, np.cumsum(length) - length)
            which, phrase = which[equal], phrase[equal]
        word, size = word[which], size[which]
        if len(word):
            # The longest hit over each word: longer ones are written later.
            order = np.argsort(size, kind="stable")
            word, size, phrase = word[order], size[order], phrase[order]
            over = np.repeat(word, size) + _within(size)
            longest = np.zeros(len(begin), np.int64)
            longest[over] = np.repeat(size, size)
            kept = (np.maximum.reduceat(longest[over], np.cumsum(size) - size) <= size) | ~apart[text[word]]
            word, phrase = word[kept], phrase[kept]
        return text[word], phrase, (word - limits[text[word]]).astype(np.int32)


def searched(batches: Iterator[pa.RecordBatch], files: tuple[str, str], longest: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hits ``key, alias, code, place`` of rows ``key, plain``. A text without a key has no longer hit that counts."""
    known = Dictionary(files)
    for batch in batches:
        texts = [(t or "").strip() for t in batch.column(1).to_pylist()]
        apart = np.asarray(batch.column(0).is_valid()) & longest
        total = np.cumsum([len(t) + 1 for t in texts])
        low = 0
        while low < len(texts):
            before = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + PIECE_BYTES, side="right")))
            text, phrase, place = known.hits(texts[low:high], apart[low:high])
            phrase = pa.array(phrase)
            columns = [batch.column(0).take(pa.array(text + low)), known.alias.take(phrase), known.code.take(phrase), pa.array(place)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            low = high
