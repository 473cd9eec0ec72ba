"""The corpus pipeline: five stages, each one operator of papyra.llm.

Documents whose language is unknown go; lines that repeat an earlier one go, and
documents left without a line; of documents that are near copies one stays;
documents that hold a benchmark item go; the rest is mixed to target weights.

Defined results, for all stages: a row is a document, whatever its doc_id, null and
repeated ones included; null columns other than text pass through; columns of any
other names are carried; an empty table gives an empty one; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import decontaminate, jaccard, language, lines, mixing
from papyra.llm.common import named, staged, table
from papyra.session import ship

#: A text's language counts as known from this share of its n-grams on.
LEAST_SCORE = 0.15
#: Near copies: shingles of five words, similar at 80 per cent.
SHINGLE, PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the model learns from all that have a lang.

    Null texts, those without a letter and, if no document has a lang, all are
    rejected. Ties go to the language first by code point; equal texts fare alike.
    """
    ship(spark)
    rows = docs.select("text", F.struct(*[named(c) for c in docs.columns]).alias("row"))
    found = language.predict(rows, language.train(docs), keep=("row",))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that occur earlier; those that lose all their lines go.

    Documents without a line of words stay as they are. Earlier means a smaller
    doc_id, none before any, then the place in the text. Of rows with equal doc_id
    and equal text each keeps the lines that one of them would.
    """
    rest = [named(c) for c in docs.columns if c not in ("doc_id", "text")]
    found = lines.dedup(docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0)])).alias("rest"))).where("n_lines = 0 or n_removed < n_lines")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("rest")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Documents are told apart by doc_id and text, so different texts under one
    doc_id, or without one, stay; of equal rows one does. Documents without
    words are copies of none.
    """
    ship(spark)
    return jaccard.without_copies(docs, SHINGLE, PERCENT)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; each row is judged by its text, and null or empty texts stay."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, target and words taken; these replace columns of their names.

    A document is told apart by doc_id, source and text; rows that are equal in all three each show the most that is
    taken of one. Null and wordless texts have nothing to take and go.
    """
    key = F.struct("doc_id", "source", F.xxhash64("text").alias("t"))
    taken = mixing.mix(docs.select(key.alias("doc_id"), "text", "source"))["taken"].where("taken > 0").groupBy(F.col("doc_id").alias("mixed"))
    taken = taken.agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")])
    taken = taken.select(F.struct("mixed", "size", "source_size", "target", "taken").alias("mix"))
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), key.alias("key"))
    both = [F.col("key")[c].eqNullSafe(F.col("mix.mixed")[c]) for c in ("doc_id", "source", "t")]
    found = rows.join(taken, both[0] & both[1] & both[2])
    new = ("size", "source_size", "target", "taken")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[F.col("mix")[c].alias(c) for c in new])


STAGES = [
    ("language ID", known_language),
    ("line dedup", unique_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", no_benchmark),
    ("mixing", mix_sources),
]

#: SQL cannot express language ID and mixing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each writing the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
