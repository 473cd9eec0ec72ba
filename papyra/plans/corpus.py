"""A corpus of documents or pages: chunk, index, search, in whole batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens_stemmed
from ..operators import ranking
from ..operators.chunking import chunk_fixed, chunk_overlapping


@dataclass
class Corpus:
    """Rows ``id, text`` with optional ``source``, and vectors ``id, embedding`` of them."""

    rows: DataFrame
    vectors: DataFrame | None = None

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, key: str = "doc_id", vectors: str | None = None) -> Corpus:
        rows = spark.read.parquet(path).withColumnRenamed(key, "id")
        return cls(rows, spark.read.parquet(vectors) if vectors else None)

    def chunk(self, how: str = "fixed", **options: int) -> Corpus:
        """The corpus of chunks; their ids are the row's id and the chunk's number."""
        split = {"fixed": chunk_fixed, "overlapping": chunk_overlapping}[how]
        chunks = split(self.rows.withColumnRenamed("id", "doc_id"), **options)
        return Corpus(chunks.select(F.concat_ws("#", "doc_id", "chunk_index").alias("id"), F.col("chunk").alias("text")))

    def search(self, queries: DataFrame, k: int = 5, mode: str = "bm25", tokens=tokens_stemmed) -> DataFrame:
        """``query_id, id, score, rank`` by bm25, dense, rrf_sum or rrf_max.

        ``queries`` has ``query_id`` and ``text``, and ``embedding`` for vectors.
        """
        lexical = dense = None
        if mode != "dense":
            scored = ranking.bm25(self.rows, queries, "id", "query_id", tokens)
            lexical = ranking.top_k(scored, "query_id", "id", k if mode == "bm25" else 3 * k)
        if mode != "bm25":
            if self.vectors is None:
                raise ValueError(f"{mode} needs vectors")
            dense = ranking.dense(self.vectors, queries.select("query_id", "embedding"), "id", "query_id", k if mode == "dense" else 3 * k)
        if mode in ("bm25", "dense"):
            return lexical if mode == "bm25" else dense
        fused = ranking.rrf(dense, lexical, "query_id", "id", mode.removeprefix("rrf_"))
        return ranking.top_k(fused, "query_id", "id", k)
