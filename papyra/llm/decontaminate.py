"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may occur with up to ``m // CHARS_PER_ERROR``
edits. It is cut into one piece more than that, so an occurrence within the
budget holds at least one piece unchanged. One automaton finds all exact piece
hits in a document; each gives a window in which Myers' bit-parallel algorithm
(J. ACM 46(3), 1999) finds the least edit distance.

Text is compared as lower-case words of letters and digits, joined and bounded
by one space. The items are a stated query set: they pass in blocks of at most
``block_chars`` characters, each block against all documents; what a block finds
is written before the next but one is read, so the driver holds two blocks.

Defined results: null and empty documents match nothing, nor do items without a
word; an item shorter than CHARS_PER_ERROR characters has to occur unchanged,
as whole words; repeated documents each give their rows; a document without a
doc_id is searched like others and its rows have a null doc_id; items repeated
with the same id and text count once, those with one id and different texts, or
without an id, each count; of equally good occurrences of an item the first is
given; empty tables give an empty result; extra columns are ignored. Documents
are searched whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged

CHARS_PER_ERROR = 20
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> str:
    words = _WORD.findall(text)
    return f" {' '.join(words).lower()} " if words else ""


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and the first end that has it."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best = (m, 0)
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        hp = down | (ones & ~(xh | up))
        hn = up & xh
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1, hn << 1
        up = (hn | ~(xv | hp)) & ones
        down = hp & xv & ones
        if score < best[0]:
            best = (score, j)
    return best


class Matcher:
    """Finds items in documents. ``items``: pairs of id and text."""

    def __init__(self, items: list[tuple[int, str]], chars_per_error: int = CHARS_PER_ERROR) -> None:
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normalised(t)) for i, t in items) if t]
        self.budget = [len(t) // chars_per_error for _, t in self.items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, text) in enumerate(self.items):
            n = self.budget[at] + 1
            cuts = [len(text) * j // n for j in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places[text[a:b]].append((at, a))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """The best occurrence of each item within its budget: item id, edits, budget, start, end.

        Start and end are places in ``text``, widened to whole words. Of equally
        good occurrences the first counts.
        """
        doc = normalised(text)
        out = []
        for at, (edits, a, end) in self._hits(doc):
            length = myers(self.items[at][1][::-1], doc[a:end][::-1])[1]
            out.append((self.items[at][0], edits, self.budget[at], *_original(text, end - length, end)))
        return out

    def holds_one(self, text: str) -> bool:
        """Whether any item occurs within its budget."""
        return next(self._hits(normalised(text)), None) is not None

    def _hits(self, doc: str) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Each item that occurs, with the edits of its best window, where that starts and where the occurrence ends."""
        if not doc or not self.items:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, found) in self.automaton.iter(doc):
            for at, offset in found:
                starts[at].add(end - length + 1 - offset)
        for at, ests in starts.items():
            item, k, best = self.items[at][1], self.budget[at], None
            for a, b in _windows(sorted(ests), k, len(item)):
                a, b = max(0, a), min(len(doc), b)
                edits, end = myers(item, doc[a:b])
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, a, a + end)
            if best:
                yield at, best


def _windows(starts: list[int], k: int, m: int) -> Iterator[tuple[int, int]]:
    """Windows around estimated starts, those that overlap joined."""
    a = b = None
    for s in starts:
        if b is not None and s - k <= b:
            b = s + m + k
        else:
            if b is not None:
                yield a, b
            a, b = s - k, s + m + k
    if b is not None:
        yield a, b


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """Places in ``text`` of the words that normalised places start..end touch."""
    at, first, last = 1, None, 0
    for m in _WORD.finditer(text):
        n = len(m.group().lower())
        if at < end and at + n > start:
            first, last = (m.start() if first is None else first), m.end()
        at += n + 1
        if at >= end:
            break
    return (first or 0), last


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The stated items in blocks of bounded size; the driver holds one block and one partition."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.where("text is not null").select("item_id", "text").distinct().toLocalIterator():
        if block and size + len(row["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, chars_per_error: int = CHARS_PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds: ``doc_id, item_id, n_errors, budget, start, end``."""
    schema = docs.select("doc_id").schema
    for field in benchmark.select("item_id").schema:
        schema.add(field)
    for name in ("n_errors", "budget", "start", "end"):
        schema.add(name, "long")
    texts = docs.where("text is not null").select("doc_id", "text")

    def search(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, chars_per_error)
            for batch in batches:
                rows, ids = [], []
                for i, text in enumerate(batch.column(1)):
                    for found in matcher.find(text.as_py()):
                        ids.append(i)
                        rows.append(found)
                if rows:
                    columns = [pa.array(x, pa.int64()) for x in zip(*[r[1:] for r in rows], strict=True)]
                    found_ids = pa.array([r[0] for r in rows], to_arrow_type(schema["item_id"].dataType))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), found_ids, *columns], names=schema.names)

        return texts.mapInArrow(run, schema)

    out, held = docs.sparkSession.createDataFrame([], schema), None
    for items in blocks(benchmark, block_chars):
        if held is not None:
            out = out.unionByName(staged(search(held), "matches"))
        held = items
    return out if held is None else out.unionByName(search(held))


def clean(docs: DataFrame, benchmark: DataFrame, chars_per_error: int = CHARS_PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; each row is judged by its own text, whatever its doc_id."""
    at, names = docs.columns.index("text"), docs.columns
    # Columns travel by number, so they may have any names.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = numbered.schema

    def left(items: list[tuple[int, str]], rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, chars_per_error)
            for batch in batches:
                keep = [text is None or not matcher.holds_one(text) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, schema)

    rows, held = numbered, None
    for items in blocks(benchmark, block_chars):
        if held is not None:
            rows = staged(left(held, rows), "clean")
        held = items
    return (rows if held is None else left(held, rows)).toDF(*names)
