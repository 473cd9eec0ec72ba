"""Chunkers: fixed, overlapping, by headings and budget."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_fixed(text: Column, size: int = 1200) -> Column:
    """Pieces of ``size`` characters, each trimmed, empty ones dropped."""
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.trim(F.substring(text, i * size + 1, F.lit(size))))
    return F.filter(pieces, lambda p: p != "")


def chunk_fixed(docs: DataFrame, size: int = 1200) -> DataFrame:
    return docs.select("doc_id", F.posexplode(split_fixed(F.coalesce("text", F.lit("")), size)).alias("chunk_index", "chunk"))


#: What a chunk may end before, the end of a paragraph, of a sentence, of a word.
BREAKS = ("\n\n", ". ", " ")


def overlapping(text: str, size: int, overlap: int) -> Iterator[str]:
    """Chunks of at most ``size`` characters that end at a paragraph, sentence or word and overlap.

    A break counts only in the second half of a chunk; the next chunk starts
    ``overlap`` characters before the end of the last. Where breaks are is found
    once for the text, and the last one that fits a chunk by bisection.
    """
    text = text.strip()
    places = [(len(mark), [m.start() for m in re.finditer(f"(?={re.escape(mark)})", text)]) for mark in BREAKS]

    def end_of(first: int) -> int:
        limit = first + size
        if limit >= len(text):
            return len(text)
        fitting = (at[n - 1] for width, at in places if (n := bisect_right(at, limit - width)))
        last = max(fitting, default=0)
        return last if last - first > size // 2 else limit

    first, end = 0, end_of(0)
    spans = [(first, end)]
    while end < len(text):
        first = max(end - overlap, first + 1)
        end = end_of(first)
        spans.append((first, end))
    yield from filter(None, (text[a:b].strip() for a, b in spans))


def split_overlapping(size: int = 1500, overlap: int = 250):
    """A vectorised function from text to its overlapping chunks."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(overlapping(t or "", size, overlap)))

    return chunks


def chunk_overlapping(docs: DataFrame, size: int = 1500, overlap: int = 250) -> DataFrame:
    return docs.select("doc_id", F.posexplode(split_overlapping(size, overlap)("text")).alias("chunk_index", "chunk"))


def budgeted(lines: list[str], budget: int, least: int) -> Iterator[tuple[str, str]]:
    """Sections and texts of consecutive lines within a budget; ``## `` lines start sections.

    A line longer than the budget stays whole; chunks under ``least`` characters
    go. Chunk ends are looked up in the running sum of line lengths.
    """
    ends = np.cumsum([0, *(len(line) + 1 for line in lines)])
    heads = [i for i, line in enumerate(lines) if line.startswith("## ")]
    for head, stop in pairwise([-1, *heads, len(lines)]):
        at = head + 1
        while at < stop:
            fits = int(np.searchsorted(ends, ends[at] + budget + 1, side="right")) - 1
            upto = min(stop, max(at + 1, fits))
            if ends[upto] - ends[at] > least:
                yield lines[head][3:] if head >= 0 else "", "\n".join(lines[at:upto])
            at = upto


def split_by_budget(budget: int = 1500, least: int = 40):
    """A vectorised function from lines to chunks with their section."""

    @F.pandas_udf("array<struct<section:string,chunk:string>>")
    def chunks(pages: pd.Series) -> pd.Series:
        return pages.map(lambda lines: [{"section": s, "chunk": c} for s, c in budgeted([] if lines is None else list(lines), budget, least)])

    return chunks


def chunk_by_budget(pages: DataFrame, lines: str, budget: int = 1500, least: int = 40) -> DataFrame:
    """One row per chunk of each row's ``lines``, with the other columns kept."""
    rest = [c for c in pages.columns if c != lines]
    each = pages.select(*rest, F.posexplode(split_by_budget(budget, least)(lines)).alias("chunk_index", "c"))
    return each.select(*rest, "chunk_index", "c.section", "c.chunk")


def line_doc_freq(docs: DataFrame, key: str, lines: Column) -> DataFrame:
    """In how many documents each line occurs."""
    return docs.select(key, F.explode(F.array_distinct(lines)).alias("line")).groupBy("line").agg(F.count("*").alias("n_docs"))


def drop_boilerplate(docs: DataFrame, key: str, lines: str, ratio: float = 0.4, least_docs: int = 5) -> DataFrame:
    """Documents less the lines that more than ``ratio`` of them hold; emptied documents go.

    Fewer than ``least_docs`` documents are left as they are. At most 1 / ratio
    such lines can be found for each line of the average document, so they are
    gathered once for each document that has some, not broadcast.
    """
    total = docs.agg(F.countDistinct(key)).first()[0]
    if total < least_docs:
        return docs
    often = line_doc_freq(docs, key, F.col(lines)).where(F.col("n_docs") > ratio * total).select("line")
    hits = docs.select(key, F.explode(F.array_distinct(lines)).alias("line")).join(often, "line").groupBy(key).agg(F.collect_set("line").alias("__often"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__often", x), F.lit(False)))
    return docs.join(hits, key, "left").withColumn(lines, kept).drop("__often").where(F.size(lines) > 0)


def context_text(code: Column, name: Column, text: Column) -> Column:
    """A chunk's text after the line that names its course."""
    return F.concat(F.lit("Course: "), F.concat_ws(" ", code, name), F.lit("\n\n"), text)
