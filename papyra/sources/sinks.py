"""Writers: appends that skip what is there, replacements, exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import folder


def new_only(rows: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not present yet."""
    return rows.join(present.select(*keys).distinct(), list(keys), "left_anti")


def upserted(current: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``current`` with the rows of equal keys replaced and the others added."""
    return current.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def _there(spark: SparkSession, path: str) -> bool:
    at, fs = folder(spark, path)
    return fs.exists(at)


def append_new(rows: DataFrame, path: str, *keys: str) -> int:
    """Append rows with new keys to a parquet table; a repeat adds nothing. Returns the rows added, counted as they are written."""
    spark = rows.sparkSession
    added = rows.dropDuplicates(list(keys))
    if _there(spark, path):
        added = new_only(added, spark.read.schema(rows.schema).parquet(path), *keys)
    counted = Observation()
    added.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return counted.get["n"]


#: Rows that a reader could not parse have this column.
CORRUPT = "_corrupt_record"
#: Committed batches of an ingested table, one file each, and the claims of those under way.
LEDGER, CLAIMS = "_ledger", "_claims"


class Busy(RuntimeError):
    """Another writer has claimed the table."""


def ingest_batch(rows: DataFrame, path: str, batch: str, *keys: str, failed: Column | None = None) -> dict[str, int]:
    """Add a batch's rows of new keys to a table and count them: ``new, skipped, failed``.

    Failed rows lack a key, could not be parsed or meet ``failed``; skipped ones
    repeat a key of the batch or of one before. All three are observed while the
    rows are written, in one pass. A batch lies in a folder of its own and counts
    once its file stands in the ledger: a batch that is there already adds
    nothing and returns its counts, and what a broken run left is written anew.
    One writer at a time claims the table; a second one is ``Busy``.
    """
    spark = rows.sparkSession
    if (done := _committed(spark, path).get(batch)) is not None:
        return done
    claim, fs = folder(spark, f"{path}/{CLAIMS}/writer")
    try:
        fs.create(claim, False).close()
    except Exception as e:
        if fs.exists(claim):
            raise Busy(f"{path} is being written; delete {CLAIMS} if its writer is gone") from e
        raise
    try:
        bad = F.lit(False)
        for c in keys:
            bad = bad | F.col(c).isNull()
        if CORRUPT in rows.columns:
            bad = bad | F.col(CORRUPT).isNotNull()
        if failed is not None:
            bad = bad | F.coalesce(failed, F.lit(False))
        seen, kept = Observation(), Observation()
        judged = rows.withColumn("__bad", bad).observe(seen, F.count(F.lit(1)).alias("all"), F.count_if("__bad").alias("failed"))
        good = judged.where("not __bad").drop("__bad", CORRUPT).dropDuplicates(list(keys))
        if (present := ingested(spark, path, good.schema)) is not None:
            good = new_only(good, present, *keys)
        good.observe(kept, F.count(F.lit(1)).alias("new")).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        counts = {"new": kept.get["new"], "skipped": seen.get["all"] - seen.get["failed"] - kept.get["new"], "failed": seen.get["failed"]}
        at, _ = folder(spark, f"{path}/{LEDGER}/{batch}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps({"batch": batch} | counts).encode()))
        out.close()
        return counts
    finally:
        fs.delete(claim, False)


def _committed(spark: SparkSession, path: str) -> dict[str, dict[str, int]]:
    """Counts of the batches in the ledger."""
    if not _there(spark, f"{path}/{LEDGER}"):
        return {}
    rows = spark.read.schema("batch string, new long, skipped long, failed long").json(f"{path}/{LEDGER}").collect()
    return {r["batch"]: {c: r[c] for c in ("new", "skipped", "failed")} for r in rows}


def ingested(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """Rows of the committed batches; none if there is no batch yet."""
    batches = sorted(_committed(spark, path))
    if not batches:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path}/batch={b}" for b in batches])


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Write as JSON lines, CSV with a header, or the one text column as lines."""
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    getattr(writer, kind)(path)


def manifest(docs: DataFrame, preview: int = 500) -> DataFrame:
    """Export rows with a composed text for embedding and a preview."""
    parts: list[Column] = [F.concat(F.lit(f"{label}: "), F.col(c)) for label, c in (("Title", "title"), ("Category", "category"), ("Department", "department"), ("Context", "context"))]
    return docs.withColumn("content_for_embedding", F.concat_ws("\n", *parts)).withColumn("preview", F.left(F.col("content_for_embedding"), F.lit(preview)))
