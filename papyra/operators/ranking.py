"""Term statistics, BM25, vectors, fusion, votes, boosts: many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import spread, staged

K1, B = 1.2, 0.7


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, term, tf`` of documents."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_stats(posts: DataFrame) -> DataFrame:
    """Document frequency and occurrences of each term."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_stats(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Length of each document in tokens; those without any count 0."""
    return docs.select(key, F.size(tokens).alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, qkey: str, tokens, k1: float = K1, b: float = B, idf: str = "plus_one", repeated: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """``qkey, key, score`` of every query and document with a common term, of these ``pairs`` only if any are given.

    ``tokens`` maps a text column to tokens. ``plus_one`` is the logarithm of one
    plus the odds, ``okapi`` that of the odds, as published by Robertson and
    Zaragoza. ``repeated`` counts a query's repeated terms as often as they occur.

    Documents are cut into tokens once, into a table of tokens and lengths. Query
    terms are joined to it before any counting, so only tokens that some query
    asks for are shuffled.
    """
    each = staged(spread(docs.select(key, "text")).select(F.col(key), tokens(F.col("text")).alias("ts")).withColumn("dl", F.size("ts")), "tokens")
    totals = each.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = F.lit(float(totals["n"])), F.lit(max(totals["avgdl"] or 0.0, 1.0))
    asked = queries.select(qkey, F.explode(tokens(F.col("text"))).alias("term")).groupBy(qkey, "term").agg(F.count("*").alias("qtf"))
    weight = F.col("qtf") if repeated else F.lit(1)
    asked = asked.select(qkey, "term", weight.alias("qtf"))
    terms = asked.select("term").distinct()
    posts = (
        each.select(key, "dl", F.explode("ts").alias("term"))
        .join(terms, "term")
        .groupBy("term", key, "dl")
        .agg(F.count("*").alias("tf"))
    )
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    odds = (n - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weighted = df.select("term", F.log(odds + 1 if idf == "plus_one" else odds).alias("idf"))
    per_query = asked.join(weighted, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    met = posts.join(per_query, "term")
    met = met if pairs is None else met.join(pairs.select(qkey, key).distinct(), [qkey, key], "left_semi")
    return met.groupBy(qkey, key).agg(F.sum(part * F.col("qtf")).alias("score"))


def top_k(scored: DataFrame, qkey: str, key: str, k: int, score: str = "score", higher_id_first: bool = False) -> DataFrame:
    """The k best of each query with their rank; ties by id."""
    tie = F.col(key).desc() if higher_id_first else F.col(key).asc()
    order = Window.partitionBy(qkey).orderBy(F.round(score, 9).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def listed_in_full(ranked: DataFrame, docs: DataFrame, queries: DataFrame, qkey: str, key: str, k: int, score: str = "score") -> DataFrame:
    """Ranked hits of positive scores, and after them documents with score 0, by key, until each query has ``k`` rows.

    A query with h hits lacks k - h rows, and of the k smallest keys at most h
    are hits: so the k smallest keys are enough for every query, and no query
    meets all documents.
    """
    smallest = [r[0] for r in docs.select(key).where(F.col(key).isNotNull()).orderBy(key).limit(k).collect()]
    kind = docs.schema[key].dataType
    first = F.array(*[F.lit(x) for x in smallest]).cast(T.ArrayType(kind))
    hits = ranked.groupBy(qkey).agg(F.collect_list(key).alias("__hits"))
    short = queries.select(qkey).distinct().join(hits, qkey, "left").withColumn("__hits", F.coalesce("__hits", F.array().cast(T.ArrayType(kind)))).where(F.size("__hits") < k)
    rest = F.slice(F.filter(first, lambda x: ~F.array_contains("__hits", x)), 1, F.greatest(F.lit(k) - F.size("__hits"), F.lit(0)))
    filled = short.select(qkey, F.size("__hits").alias("__n"), F.posexplode(rest).alias("__i", key))
    return ranked.select(qkey, key, score, "rank").unionByName(filled.select(qkey, key, F.lit(0.0).alias(score), (F.col("__n") + F.col("__i") + 1).alias("rank")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense(vectors: DataFrame, queries: DataFrame, key: str, qkey: str, k: int, block: int = 1000, others_only: bool = True) -> DataFrame:
    """The ``k`` nearest vectors by cosine of each of a stated set of query vectors: ``qkey, key, score, rank``.

    Queries pass in blocks of bounded size, each with its norms taken once and
    held by every task. A batch of vectors meets a block in one matrix product,
    and only each query's best of the batch leave it. Equally near ones are
    ranked by key; with ``others_only`` a query's own key is none of its
    neighbours. Vectors without a direction and null ones have score null and
    come last.
    """
    fields = [*queries.select(F.col(qkey)).schema.fields, *vectors.select(F.col(key)).schema.fields, T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def nearest(ids: list, matrix: np.ndarray):
        none = [0.0] * matrix.shape[1]
        norms = np.linalg.norm(matrix, axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_pylist()
                # A null vector has no direction either.
                rows = np.array([v if v is not None else none for v in batch.column(1).to_pylist()], dtype=np.float64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = matrix @ rows.T / (norms[:, None] * np.linalg.norm(rows, axis=1))
                out: tuple[list, list, list] = ([], [], [])
                for q, found in zip(ids, scores, strict=True):
                    ordered = np.round(np.where(np.isnan(found), -np.inf, found), 9)
                    # One more than k, as the query itself may be among them; ties stay together.
                    least = np.partition(ordered, -k - 1)[-k - 1] if len(ordered) > k + 1 else -np.inf
                    for i in np.flatnonzero(ordered >= least).tolist():
                        if not others_only or keys[i] != q:
                            for held, x in zip(out, (q, keys[i], None if np.isnan(found[i]) else float(found[i])), strict=True):
                                held.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=schema.names)

        return run

    found = vectors.sparkSession.createDataFrame([], schema)
    rows = vectors.select(F.col(key), F.col("embedding"))
    asked = queries.select(F.col(qkey), F.col("embedding")).toLocalIterator()
    some = list(islice(asked, block))
    while some:
        width = max((len(r[1]) for r in some if r[1] is not None), default=0) or len((rows.select("embedding").where("embedding is not null").first() or [[]])[0])
        near = rows.mapInArrow(nearest([r[0] for r in some], np.array([r[1] if r[1] is not None else [0.0] * width for r in some], dtype=np.float64)), schema)
        some = list(islice(asked, block))
        # The plan keeps the last block only; what earlier ones found is written.
        found = found.unionByName(staged(near, "near") if some else near)
    return top_k(found, qkey, key, k)


def rrf(a: DataFrame, b: DataFrame, qkey: str, key: str, how: str = "sum", k0: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists by the sum or the larger of the parts."""
    one = a.select(qkey, key, F.col("rank").alias("rank_a"))
    two = b.select(qkey, key, F.col("rank").alias("rank_b"))
    both = one.join(two, [qkey, key], "full_outer")
    x, y = (F.coalesce(F.lit(1.0) / (k0 + F.col(c)), F.lit(0.0)) for c in ("rank_a", "rank_b"))
    return both.select(qkey, key, "rank_a", "rank_b", (x + y if how == "sum" else F.greatest(x, y)).alias("score"))


def admitted(hits: DataFrame, qkey: str, most_distance: float = 0.85) -> DataFrame:
    """Hits with a lexical score or a near vector; queries with neither anywhere give none."""
    ok = (F.col("lexical") > 0) | (F.col("distance") <= most_distance)
    w = Window.partitionBy(qkey)
    any_ok = (F.max("lexical").over(w) > 0) | (F.min("distance").over(w) <= most_distance)
    return hits.withColumn("__any", any_ok).where(ok & F.col("__any")).drop("__any")


def source_vote(ranked: DataFrame, qkey: str, source: str, k: int) -> DataFrame:
    """The source with the most votes of 1/2**rank among a query's first max(k, 3) hits; ties go to the first seen."""
    votes = ranked.where(F.col("rank") <= max(k, 3)).groupBy(qkey, source).agg(
        F.sum(F.pow(F.lit(2.0), -(F.col("rank") - 1))).alias("vote"), F.min("rank").alias("first_rank")
    )
    best = Window.partitionBy(qkey).orderBy(F.col("vote").desc(), "first_rank")
    return votes.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def boosted(scored: DataFrame, qkey: str, boosts: list[tuple[Column, Column, float]], meta: Column, asked: Column, best: Column | None = None) -> DataFrame:
    """Score over the query's best (of these rows, or as given), plus the share of asked terms in ``meta``, plus rule weights.

    A rule is a predicate on the query, one on the document, and a weight.
    """
    top = F.max("score").over(Window.partitionBy(qkey)) if best is None else best
    norm = F.col("score") / F.when(top == 0, 1.0).otherwise(top)
    share = F.size(F.array_intersect(asked, meta)) / F.greatest(F.size(F.array_distinct(asked)), F.lit(1))
    extra = F.lit(0.0)
    for on_query, on_doc, weight in boosts:
        extra = extra + F.when(on_query & on_doc, F.lit(weight)).otherwise(0.0)
    return scored.withColumn("final", norm + share + extra)


def cut_after_limit(ranked: DataFrame, k: int, final: str = "final", score: str = "score") -> DataFrame:
    """Of the first k hits those with a positive final score and either a lexical one or more than one half."""
    return ranked.where((F.col("rank") <= k) & (F.col(final) > 0) & ((F.col(score) > 0) | (F.col(final) > 0.5)))


def cascade(stages: list[DataFrame], qkey: str) -> DataFrame:
    """Rows of the first stage that has any for a query."""
    union = None
    for i, stage in enumerate(stages):
        rows = stage.withColumn("stage", F.lit(i))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    return union.withColumn("__first", F.min("stage").over(Window.partitionBy(qkey))).where("stage = __first").drop("__first")


def quality(ranked: DataFrame, qkey: str, relevant: Column) -> DataFrame:
    """Per query: whether a relevant hit is among those ranked, and the reciprocal rank of the first."""
    first = F.min(F.when(relevant, F.col("rank")))
    return ranked.groupBy(qkey).agg(F.coalesce(first.isNotNull(), F.lit(False)).alias("hit"), F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias("mrr"))
