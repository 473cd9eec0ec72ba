"""The best documents of each query by BM25, with blocks of documents passed over that cannot hold one.

Documents are packed into blocks: the postings of the terms that are asked for,
and for each of these the highest frequency and the least length of a document
that has it. These bound what any document of the block can score. A task keeps
the ``k`` best of each query so far; a block whose bound is below the last of
them is not scored for that query (block-max pruning: Ding and Suel, SIGIR 2011).
Only a task's best leave it, so what is shuffled is ``k`` rows a query and task,
not every document with a common term.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import spread, staged
from .ranking import B, K1, top_k

BLOCK_DOCS = 512
QUERY_BLOCK = 1000


def blocks(docs: DataFrame, key: str, tokens, terms: list[str], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``n, n_dl, dl, keys, lengths, at, terms, tfs, most``: blocks of documents with their postings of ``terms``, staged.

    ``at``, ``terms`` and ``tfs`` are the postings: document of the block, number
    of the term, frequency. ``most`` has each term's document frequency, highest
    frequency and least length within the block.
    """
    schema = T.StructType.fromDDL("n bigint, n_dl bigint, dl bigint, lengths binary, at binary, terms binary, tfs binary, most array<struct<term: int, df: int, tf: int, dl: int>>")
    schema.add("keys", T.ArrayType(docs.schema[key].dataType))
    arrow = to_arrow_schema(schema)

    def packed(keys: pa.Array, lists: pa.ListArray, known: pa.Array) -> list:
        lengths = pc.list_value_length(lists)
        dl = lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        number = pc.index_in(lists.flatten(), known)
        asked = pc.is_valid(number).to_numpy(zero_copy_only=False)
        term = number.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[asked]
        pair, tf = np.unique(np.repeat(np.arange(len(dl)), dl)[asked] * np.int64(len(known) or 1) + term, return_counts=True)
        at, term = (pair // (len(known) or 1)).astype(np.int32), (pair % (len(known) or 1)).astype(np.int32)
        order = np.argsort(term, kind="stable")
        at, term, tf = at[order], term[order], tf[order].astype(np.int32)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=np.int64)
        if len(first):
            most = zip(term[first].tolist(), np.diff(np.append(first, len(term))).tolist(), np.maximum.reduceat(tf, first).tolist(), np.minimum.reduceat(dl[at], first).tolist(), strict=True)
        else:
            most = iter(())
        bounds = [dict(zip(("term", "df", "tf", "dl"), m, strict=True)) for m in most]
        return [len(dl), len(dl) - lengths.null_count, int(dl.sum()), dl.tobytes(), at.tobytes(), term.tobytes(), tf.tobytes(), bounds, keys.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            for a in range(0, batch.num_rows, block_docs):
                part = batch.slice(a, block_docs)
                row = packed(part.column(0), part.column(1), known)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return staged(spread(docs).select(F.col(key), tokens(F.col("text")).alias("ts")).mapInArrow(run, schema), "blocks")


class _Best:
    """The k best of each query so far: rounded scores, keys and scores, best first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, q: int, rows: list[tuple]) -> None:
        held = sorted(self.rows[q] + rows)[: self.k]
        self.rows[q] = held
        if len(held) == self.k:
            self.least[q] = -held[-1][0]


def block_top(block: dict, weights: tuple[np.ndarray, np.ndarray, np.ndarray], best: _Best, avgdl: float, k1: float, b: float) -> int:
    """Add a block's best documents; returns how many pairs of query and document were scored.

    ``weights`` are the queries of each term, as edges of runs, query numbers and idf times frequency in the query.
    """
    edges, query, weight = weights
    n, n_queries = block["n"], len(best.rows)
    part = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    def spread_out(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term of a list and each query that has it: place in the list, place in the weights."""
        times = edges[term + 1] - edges[term]
        row = np.repeat(np.arange(len(term)), times)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(edges[term], times)

    bounds = block["most"]
    term = np.array([m["term"] for m in bounds], dtype=np.int64)
    high = part(np.array([m["tf"] for m in bounds], dtype=np.float64), np.array([m["dl"] for m in bounds], dtype=np.float64))
    row, place = spread_out(term)
    # A term of negative weight adds nothing at best: to a document that lacks it.
    bound = np.bincount(query[place], weights=np.maximum(weight[place], 0) * high[row], minlength=n_queries)
    found = np.zeros(n_queries, dtype=bool)
    found[query[place]] = True
    active = np.flatnonzero(found & (bound >= best.least - 1e-6))
    if not len(active):
        return 0
    number = np.full(n_queries, -1)
    number[active] = np.arange(len(active))
    at, terms, tfs, lengths = (np.frombuffer(block[c], dtype=np.int32) for c in ("at", "terms", "tfs", "lengths"))
    parts = part(tfs.astype(np.float64), lengths[at].astype(np.float64))
    row, place = spread_out(terms.astype(np.int64))
    column = number[query[place]]
    row, place, column = row[column >= 0], place[column >= 0], column[column >= 0]
    cell = column * n + at[row]
    score = np.bincount(cell, weights=weight[place] * parts[row], minlength=n * len(active)).reshape(len(active), n)
    has = np.bincount(cell, minlength=n * len(active)).reshape(len(active), n) > 0
    scored = 0
    for j, q in enumerate(active.tolist()):
        docs = np.flatnonzero(has[j])
        scored += len(docs)
        rounded = np.round(score[j][docs], 9)
        least = best.least[q]
        if len(docs) > best.k:
            least = max(least, np.partition(rounded, len(docs) - best.k)[len(docs) - best.k])
        chosen = docs[rounded >= least]
        if len(chosen):
            best.add(q, [(-float(s), block["keys"][d], float(x)) for s, d, x in zip(rounded[rounded >= least], chosen.tolist(), score[j][chosen], strict=True)])
    return scored


def bm25_top(
    docs: DataFrame, queries: DataFrame, key: str, qkey: str, tokens, k: int, k1: float = K1, b: float = B, idf: str = "plus_one", repeated: bool = False, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """``qkey, key, score, rank``: the ``k`` best documents with a common term; equal scores, to nine places, by key.

    Parameters and scores are those of ``ranking.bm25``. Queries are a stated
    set; they pass in blocks, each of which reads the documents once. Keys are
    not null.
    """
    schema = T.StructType([*queries.select(F.col(qkey)).schema.fields, *docs.select(F.col(key)).schema.fields, T.StructField("score", T.DoubleType())])
    asked = queries.select(F.col(qkey), tokens(F.col("text")).alias("ts")).toLocalIterator()
    found = docs.sparkSession.createDataFrame([], schema)
    some = list(islice(asked, query_block))
    while some:
        near = _search(blocks_of(docs, key, tokens, some), some, schema, k, k1, b, idf, repeated)
        some = list(islice(asked, query_block))
        found = found.unionByName(staged(near, "best") if some else near)
    return top_k(found, qkey, key, k)


def blocks_of(docs: DataFrame, key: str, tokens, asked: list) -> tuple[DataFrame, list[str]]:
    """The blocks for all terms of these queries, and the terms."""
    terms = sorted({t for _, ts in asked for t in ts or []})
    return blocks(docs, key, tokens, terms), terms


def _weights(packed: tuple[DataFrame, list[str]], asked: list, idf: str, repeated: bool) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """The queries of each term, as edges of runs, query numbers and idf times frequency in the query; the mean length."""
    held, terms = packed
    totals = held.agg(F.sum("n").alias("n"), F.sum("n_dl").alias("n_dl"), F.sum("dl").alias("dl")).first()
    n, avgdl = float(totals["n"] or 0), max((totals["dl"] or 0) / (totals["n_dl"] or 1), 1.0)
    # One row a term of these queries.
    df = np.zeros(len(terms))
    for r in held.select(F.explode("most").alias("m")).groupBy("m.term").agg(F.sum("m.df").alias("df")).collect():
        df[r["term"]] = r["df"]
    odds = (n - df + 0.5) / (df + 0.5)
    value = np.log(odds + 1 if idf == "plus_one" else odds)
    number = {t: i for i, t in enumerate(terms)}
    weights = []
    for q, (_, ts) in enumerate(asked):
        each, times = np.unique(np.array([number[t] for t in ts or []], dtype=np.int64), return_counts=True)
        weights += [(t, q, value[t] * (c if repeated else 1)) for t, c in zip(each.tolist(), times.tolist(), strict=True)]
    weights.sort()
    term = np.array([w[0] for w in weights], dtype=np.int64)
    return (np.searchsorted(term, np.arange(len(terms) + 1)), np.array([w[1] for w in weights], dtype=np.int64), np.array([w[2] for w in weights])), avgdl


def _search(packed: tuple[DataFrame, list[str]], asked: list, schema: T.StructType, k: int, k1: float, b: float, idf: str, repeated: bool) -> DataFrame:
    held = packed[0]
    runs, avgdl = _weights(packed, asked, idf, repeated)
    names = [q for q, _ in asked]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(names), k)
        for batch in batches:
            for block in batch.to_pylist():
                block_top(block, runs, best, avgdl, k1, b)
        rows = [(names[q], key, score) for q, own in enumerate(best.rows) for _, key, score in own]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return held.mapInArrow(run, schema)


#: Groups whose bound a task remembers; documents of others are compared within their block.
MOST_GROUPS = 4096
#: Shares of the best score this far apart differ in their ninth place.
APART = 2e-9


def _all_scores(block: dict, weights: tuple[np.ndarray, np.ndarray, np.ndarray], n_queries: int, avgdl: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, document, score`` of every pair of a block with a common term; documents without a key have none."""
    edges, query, weight = weights
    at, terms, tfs, lengths = (np.frombuffer(block[c], dtype=np.int32) for c in ("at", "terms", "tfs", "lengths"))
    parts = tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * lengths[at] / avgdl))
    times = edges[terms + 1] - edges[terms]
    row = np.repeat(np.arange(len(terms)), times)
    place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(edges[terms], times)
    cell = query[place] * block["n"] + at[row]
    score = np.bincount(cell, weights=weight[place] * parts[row], minlength=n_queries * block["n"])
    pair = np.flatnonzero(np.bincount(cell, minlength=n_queries * block["n"]))
    there = np.array([x["key"] is not None for x in block["keys"]], dtype=bool)
    pair = pair[there[pair % block["n"]]]
    return pair // block["n"], pair % block["n"], score[pair]


class _Bounds:
    """For each query and group, what the k-th best of some block reached."""

    def __init__(self, n: int, k: int):
        self.k, self.number, self.least = k, {}, np.full((n, 1), -np.inf)

    def kept(self, query: np.ndarray, share: np.ndarray, groups: list[tuple], doc: np.ndarray) -> np.ndarray:
        """Which pairs can be among the k best of their query and group."""
        own = {g: i for i, g in enumerate(dict.fromkeys(groups))}
        for g in own:
            if g not in self.number and len(self.number) < MOST_GROUPS:
                self.number[g] = len(self.number) + 1
        grown = len(self.number) + 1 - self.least.shape[1]
        self.least = np.hstack([self.least, np.full((len(self.least), grown), -np.inf)])
        inside = np.array([own[g] for g in groups], dtype=np.int64)[doc]
        known = np.array([self.number.get(g, 0) for g in groups], dtype=np.int64)[doc]
        some = np.flatnonzero(share >= self.least[query, known] - APART)
        query, share, inside, known = query[some], share[some], inside[some], known[some]
        cell = query * len(own) + inside
        order = np.lexsort((-share, cell))
        first = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0)) if len(order) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(first, len(order)))
        reached = np.where(sizes >= self.k, share[order[np.minimum(first + self.k, first + sizes) - 1]], -np.inf) if len(order) else np.zeros(0)
        heads = order[first]
        now = known[heads] > 0
        np.maximum.at(self.least, (query[heads][now], known[heads][now]), reached[now])
        return some[order[share[order] >= np.repeat(reached, sizes) - APART]]


def bm25_by_group(
    docs: DataFrame, queries: DataFrame, key: str, qkey: str, tokens, groups: list[str], k: int, k1: float = K1, b: float = B, idf: str = "plus_one", repeated: bool = False, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """``qkey, key, *groups, score, best``: a query's best score, and the documents that can be among the ``k`` best of it and their group.

    For orders by the share of the best score plus what depends on the query and
    the group only: of equal groups the share decides, so a document with ``k``
    better ones of its group, further than the ninth place apart, is not needed.
    Scores are those of ``ranking.bm25``; no table of pairs is shuffled.
    """
    top = T.StructType([*queries.select(F.col(qkey)).schema.fields, T.StructField("best", T.DoubleType())])
    packed = docs.select(F.struct(F.col(key).alias("key"), *groups).alias("row"), "text")
    schema = T.StructType([top.fields[0], *docs.select(key, *groups).schema.fields, T.StructField("score", T.DoubleType()), top.fields[1]])

    def near(some: list) -> DataFrame:
        held, terms = blocks_of(packed, "row", tokens, some)
        runs, avgdl = _weights((held, terms), some, idf, repeated)
        names = [q for q, _ in some]

        def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full(len(names), -np.inf)
            for batch in batches:
                for block in batch.to_pylist():
                    query, _, score = _all_scores(block, runs, len(names), avgdl, k1, b)
                    np.maximum.at(best, query, score)
            met = np.flatnonzero(best > -np.inf).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([names[q] for q in met], best[met].tolist()), to_arrow_schema(top), strict=True)], schema=to_arrow_schema(top))

        # One row a query of the block.
        reached = {r[0]: r[1] for r in held.mapInArrow(highest, top).groupBy(qkey).agg(F.max("best")).collect()}
        best = np.array([reached.get(q, 0.0) for q in names])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = _Bounds(len(names), k)
            for batch in batches:
                for block in batch.to_pylist():
                    query, doc, score = _all_scores(block, runs, len(names), avgdl, k1, b)
                    of = [tuple(row[g] for g in groups) for row in block["keys"]]
                    kept = bounds.kept(query, score / np.where(best == 0, 1.0, best)[query], of, doc)
                    rows = [block["keys"][d] for d in doc[kept].tolist()]
                    columns = [[names[q] for q in query[kept].tolist()], [r["key"] for r in rows], *[[r[g] for r in rows] for g in groups], score[kept].tolist(), best[query[kept]].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return held.mapInArrow(run, schema)

    asked = queries.select(F.col(qkey), tokens(F.col("text")).alias("ts")).toLocalIterator()
    found = docs.sparkSession.createDataFrame([], schema)
    some = list(islice(asked, query_block))
    while some:
        rows = near(some)
        some = list(islice(asked, query_block))
        found = found.unionByName(staged(rows, "near") if some else rows)
    return found
