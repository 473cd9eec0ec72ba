"""What the operators of this subpackage share: shared storage, components, batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import folder, free, shared_dir, staged  # noqa: F401

#: One or more characters that are not ASCII white space: a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows below which a dimension table may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a dimension of ``rows`` counted rows, none beyond the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` as rows ``(id, component_id)``.

    Alternates large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond") until the edges stop changing. Each
    vertex ends at the smallest id it reaches; vertices without an edge are not
    listed. Edges stay distributed, every round is a staged table.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    stars = staged(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, stars = stars, staged(small_star, "stars")
        free(before)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return stars.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).union(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to at most ``limit`` (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
