"""Whole retrieval chains for batches of queries: two ranked lists fused and voted on, and stages of which the first that finds something answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_stemmed
from ..operators import intents, ranking
from ..operators.sections import semester_pages

#: Vectors that a query considers at most, and how far one may be that no word supports.
CANDIDATES = 3000
MOST_DISTANCE = 0.85
RRF = 60
#: The page of a file that shares out its credits.
CREDIT_PAGE = 3


def hybrid(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 8, candidates: int = CANDIDATES, most_distance: float = MOST_DISTANCE, tokens=tokens_stemmed, **options
) -> DataFrame:
    """``query_id, id, place, file, fused``: the best ``k`` passages of the file that a query's best passages vote for.

    ``docs`` are ``id, text, file, page``, ``vectors`` ``id, embedding``, queries
    ``query_id, text, embedding``. The nearest vectors are the candidates; those
    with a common word or near enough stay, and queries without either have
    none. The larger reciprocal rank of the two lists decides, then the lexical
    score, then distance. The first max(k, 3) vote for their files, each with
    half the weight of the one before; ties go to the file seen first. Of
    passages with equal page, file and text the first stays.
    """
    near = ranking.dense(vectors, queries, "id", "query_id", candidates, others_only=False)
    near = near.select("query_id", "id", F.coalesce(1 - F.col("score"), F.lit(float("inf"))).alias("distance"), F.col("rank").alias("dense_rank"))
    lexical = ranking.bm25(docs, queries, "id", "query_id", tokens, pairs=near.select("query_id", "id"), **options).withColumnRenamed("score", "lexical")
    rows = near.join(lexical, ["query_id", "id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    rows = rows.join(docs.select("id", "file", "page", F.xxhash64("text").alias("hash")), "id")
    # All windows are over one query's candidates.
    found = F.col("lexical") > 0
    by_words = Window.partitionBy("query_id", found).orderBy(F.round("lexical", 9).desc(), "dense_rank")
    rows = rows.withColumn("lexical_rank", F.when(found, F.row_number().over(by_words)))
    rows = ranking.admitted(rows, "query_id", most_distance)
    fused = F.greatest(F.lit(1.0) / (RRF + F.col("dense_rank")), F.coalesce(F.lit(1.0) / (RRF + F.col("lexical_rank")), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), F.round("lexical", 9).desc(), "dense_rank")
    rows = rows.withColumn("fused", fused).withColumn("rank", F.row_number().over(order))
    best = ranking.source_vote(rows.where("file is not null"), "query_id", "file", k).select("query_id", F.col("file").alias("best"))
    rows = rows.join(best, "query_id", "left").where("best is null or file = best")
    first = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    return with_forced(rows.select("query_id", "id", "place", "file", "fused"), None, docs, k)


def with_forced(found: DataFrame, forced: DataFrame | None, docs: DataFrame, k: int) -> DataFrame:
    """``query_id, id, place, file, fused``: rows of ``forced`` (``query_id, id, ord``) before those found; of passages with equal page, file and text the first stays, ``k`` in all."""
    parts = found.select("query_id", "id", "fused", F.lit(1).alias("part"), F.col("place").cast("int").alias("ord"))
    if forced is not None:
        parts = forced.select("query_id", "id", F.lit(None).cast("double").alias("fused"), F.lit(0).alias("part"), F.col("ord").cast("int").alias("ord")).unionByName(parts)
    each = parts.join(docs.select("id", "file", "page", F.xxhash64("text").alias("hash")), "id")
    same = Window.partitionBy("query_id", "page", "file", "hash").orderBy("part", "ord", "id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "ord", "id"))
    once = each.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return once.withColumn("place", place).where(F.col("place") <= k).select("query_id", "id", "place", "file", "fused")


def semester_stage(pages: DataFrame, marked: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, id``: what structure queries get: the credit page of every file, or pages that name a semester asked for.

    ``pages`` are ``id, file, page``, ``marked`` ``filename, page, semesters``,
    ``asked`` ``query_id, semesters, is_credit``. Credit queries get credit pages
    only; there is one for each file, so these are joined by a constant.
    """
    credit = asked.where("is_credit").select("query_id", F.lit(CREDIT_PAGE).alias("page")).join(pages, "page").select("query_id", "id")
    named = semester_pages(marked, asked.where("not is_credit and size(semesters) > 0"), "query_id").withColumnRenamed("filename", "file")
    return credit.unionByName(named.join(pages, ["file", "page"]).select("query_id", "id"))


def retrieve(queries: DataFrame, semesters: DataFrame, sections: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, id, stage``: rows of the first stage that has any for a query.

    Stage 0 are structure pages for queries for a catalogue of semesters, a range
    of them or credits, 1 the section of a course, 2 structure pages for any
    query that names a semester, 3 the hybrid search. The first three are rows
    ``query_id, id``, ``queries`` ``query_id, text``.
    """
    asked = intents.with_intents(queries.select("query_id", "text"))
    gate = intents.has("is_semester_catalogue") | intents.has("is_semester_range") | intents.has("is_credit_query")
    first = semesters.join(asked.where(gate).select("query_id"), "query_id", "left_semi")
    return ranking.cascade([part.select("query_id", "id") for part in (first, sections, semesters, hits)], "query_id")
