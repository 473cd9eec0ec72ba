"""A persisted store of vectors with their metadata: count, get by a filter, and the nearest of many queries at once.

Vectors lie in lists around centroids, one folder a list (an inverted file index).
A query reads the lists of its nearest centroids only; the folders that no query of
the block wants, and rows that the filter excludes, are left to the scan to skip.
Centroids are fitted on a bounded sample, ``SAMPLE`` rows with the smallest hashes
of their key; every row is indexed. How many lists a query reads is set when the
store is made, as the number that finds ``RECALL`` of the sample's nearest vectors;
``exact`` reads all lists.

Vectors that are null or have no direction are stored, counted and got, but near to
nothing. Keys are not null and stand once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.pruned import _Best
from ..operators.ranking import top_k
from ..storage import staged

SAMPLE = 20_000
MOST_LISTS = 4_096
RECALL = 0.97
CALIBRATED_ON = 200
NEIGHBOURS = 8
#: The most rows a query may ask for.
MOST_RESULTS = 3_000
QUERY_BLOCK = 1_000
ROUNDS = 8
#: Holds vectors that are near to nothing.
NOWHERE = -1


def _directions(vectors: list, width: int) -> np.ndarray:
    """Vectors of length 1; null and zero ones, and those of another width, are rows of zeros."""
    rows = np.array([v if v is not None and len(v) == width and None not in v else [0.0] * width for v in vectors], dtype=np.float64).reshape(len(vectors), width)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=(norms > 0) & np.isfinite(norms))


def centroids(rows: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centres of ``n`` lists by spherical k-means; an empty list starts anew at the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:n]]
    for _ in range(rounds):
        near = rows @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        sums[empty] = rows[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, norms, out=centres.copy(), where=norms > 0)
    return centres


def probes_for(rows: np.ndarray, centres: np.ndarray, recall: float = RECALL) -> int:
    """The fewest lists that hold the wanted share of the nearest rows, over the first rows as queries."""
    own = (rows @ centres.T).argmax(axis=1)
    queries = rows[:CALIBRATED_ON]
    near = queries @ rows.T
    np.fill_diagonal(near, -np.inf)
    k = min(NEIGHBOURS, len(rows) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(queries @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(queries), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(len(needed) * recall)) - 1)]) + 1


class VectorStore:
    """The store at a path; make one with ``create``, open one with the path alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.parquet(f"{path}/head").first()
        self.key, self.vector, self.width, self.probes = head["key"], head["vector"], head["width"], head["probes"]
        self.schema = T.StructType.fromJson(json.loads(head["schema"]))
        #: One row a list, MOST_LISTS at most.
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.centres = np.array([r["centre"] for r in found], dtype=np.float64).reshape(len(found), self.width)

    @classmethod
    def create(cls, vectors: DataFrame, path: str, key: str = "id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> VectorStore:
        """Store rows with a key, a vector and any other columns; ``lists`` is by default the root of their number."""
        spark = vectors.sparkSession
        taken = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
        width = max((len(r[0]) for r in taken), default=0)
        rows = _directions([r[0] for r in taken], width)
        rows = rows[rows.any(axis=1)] if width else rows[:0]
        lists = min(lists or max(1, int(vectors.count() ** 0.5)), MOST_LISTS, max(1, len(rows)))
        centres = centroids(rows, lists) if len(rows) else np.zeros((0, width))
        probes = probes_for(rows, centres, recall) if len(rows) else 1
        schema = T.StructType([*vectors.schema.fields, T.StructField("__list", T.IntegerType())]).json()
        spark.createDataFrame([(key, vector, width, probes, schema)], "key string, vector string, width int, probes int, schema string").coalesce(1).write.parquet(f"{path}/head")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        placed = cls._placed(vectors, vector, width, centres)
        # Large lists are split, small ones share a task.
        placed.hint("rebalance", "__list").write.partitionBy("__list").parquet(f"{path}/rows")
        return cls(spark, path)

    @staticmethod
    def _placed(vectors: DataFrame, vector: str, width: int, centres: np.ndarray) -> DataFrame:
        """Rows with the number of their list."""
        schema = T.StructType([*vectors.schema.fields, T.StructField("__list", T.IntegerType())])
        arrow = to_arrow_schema(schema)
        at = vectors.columns.index(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _directions(batch.column(at).to_pylist(), width)
                own = (rows @ centres.T).argmax(axis=1) if len(centres) and batch.num_rows else np.full(batch.num_rows, NOWHERE)
                own = np.where(rows.any(axis=1), own, NOWHERE)
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)], pa.array(own, pa.int32())], schema=arrow)

        return vectors.mapInArrow(run, schema)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def add(self, vectors: DataFrame) -> None:
        """Add rows whose keys are not there yet, in the lists there are; a repeat adds nothing."""
        new = vectors.dropDuplicates([self.key]).join(self._rows().select(self.key), self.key, "left_anti").select(*vectors.columns)
        self._placed(new, self.vector, self.width, self.centres).hint("rebalance", "__list").write.mode("append").partitionBy("__list").parquet(f"{self.path}/rows")

    def count(self, where: Column | str | None = None) -> int:
        return self.get(where).count()

    def get(self, where: Column | str | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Stored rows that pass a filter on their columns, or whose key is among ``keys``."""
        rows = self._rows().drop("__list")
        rows = rows if where is None else rows.where(where)
        return rows if keys is None else rows.join(keys.select(F.col(keys.columns[0]).alias(self.key)).distinct(), self.key, "left_semi")

    def query(self, queries: DataFrame, qkey: str, k: int = NEIGHBOURS, where: Column | str | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """``qkey, key, score, rank``: for each query vector, which has the store's vector name, the ``k`` nearest by cosine that pass the filter.

        Equal scores, to nine places, are ranked by key. Queries without a
        direction have no neighbours.
        """
        if not 1 <= k <= MOST_RESULTS:
            raise ValueError(f"a query gives 1 to {MOST_RESULTS} rows")
        n_probes = len(self.centres) if exact else min(probes or self.probes, len(self.centres))
        rows = self._rows()
        schema = T.StructType([*queries.select(F.col(qkey)).schema.fields, rows.schema[self.key], T.StructField("score", T.DoubleType())])
        out = self.spark.createDataFrame([], schema)
        asked = queries.select(qkey, self.vector).toLocalIterator()
        some = list(islice(asked, QUERY_BLOCK))
        while some:
            near = self._near(rows, some, schema, k, where, n_probes)
            some = list(islice(asked, QUERY_BLOCK))
            out = out.unionByName(staged(near, "near") if some else near)
        return top_k(out, qkey, self.key, k)

    def _near(self, rows: DataFrame, asked: list, schema: T.StructType, k: int, where: Column | str | None, n_probes: int) -> DataFrame:
        names, matrix = [r[0] for r in asked], _directions([r[1] for r in asked], self.width)
        lists = np.argsort(-(matrix @ self.centres.T), axis=1, kind="stable")[:, :n_probes]
        readers: dict[int, list[int]] = {}
        for q in np.flatnonzero(matrix.any(axis=1)).tolist():
            for i in lists[q].tolist():
                readers.setdefault(i, []).append(q)
        by_list = {i: np.array(qs) for i, qs in readers.items()}
        width, arrow = self.width, to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(names), k)
            for batch in batches:
                own, keys = np.array(batch.column(0).to_pylist(), dtype=np.int64), batch.column(1).to_pylist()
                vectors = _directions(batch.column(2).to_pylist(), width)
                for i in np.unique(own).tolist():
                    here, qs = np.flatnonzero(own == i), by_list[i]
                    scores = matrix[qs] @ vectors[here].T
                    rounded = np.round(scores, 9)
                    for j, q in enumerate(qs.tolist()):
                        least = best.least[q]
                        if len(here) > k:
                            least = max(least, np.partition(rounded[j], len(here) - k)[len(here) - k])
                        best.add(q, [(-float(rounded[j][d]), keys[here[d]], float(scores[j][d])) for d in np.flatnonzero(rounded[j] >= least).tolist()])
            out = [(names[q], key, score) for q, held in enumerate(best.rows) for _, key, score in held]
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        wanted = rows.where(F.col("__list").isin(sorted(by_list)))
        wanted = wanted if where is None else wanted.where(where)
        return wanted.select("__list", self.key, self.vector).mapInArrow(run, schema)
