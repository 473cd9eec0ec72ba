"""Counted ingestion: repeated batches, broken runs, two writers, corrupt rows, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from papyra.sources import sinks
from papyra.streaming import serving

SCHEMA = "id int, v string"


def ids(spark, path):
    return sorted(r["id"] for r in sinks.ingested(spark, path).collect())


def test_counts_and_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, "bad")], SCHEMA)
    bad = F.col("v") == "bad"
    assert sinks.ingested(spark, path) is None
    assert sinks.ingest_batch(one, path, "b1", "id", failed=bad) == {"new": 2, "skipped": 1, "failed": 2}
    assert sinks.ingest_batch(one, path, "b1", "id", failed=bad) == {"new": 2, "skipped": 1, "failed": 2}
    two = spark.createDataFrame([(2, "x"), (4, "d"), (5, None)], SCHEMA)
    assert sinks.ingest_batch(two, path, "b2", "id", failed=bad) == {"new": 2, "skipped": 1, "failed": 0}
    assert sinks.ingest_batch(two.limit(0), path, "b3", "id") == {"new": 0, "skipped": 0, "failed": 0}
    assert ids(spark, path) == [1, 2, 4, 5]


def test_broken_run_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    # Rows were written, the ledger was not: they do not count and are written anew.
    rows.write.parquet(f"{path}/batch=b1")
    assert sinks.ingested(spark, path) is None
    assert sinks.ingest_batch(rows, path, "b1", "id")["new"] == 2 and ids(spark, path) == [1, 2]
    os.makedirs(f"{path}/{sinks.CLAIMS}", exist_ok=True)
    open(f"{path}/{sinks.CLAIMS}/writer", "w").close()
    with pytest.raises(sinks.Busy):
        sinks.ingest_batch(rows, path, "b2", "id")
    os.remove(f"{path}/{sinks.CLAIMS}/writer")
    with pytest.raises(Exception, match="no_such"):
        sinks.ingest_batch(rows, path, "b2", "id", failed=F.col("no_such"))
    assert sinks.ingest_batch(rows, path, "b2", "id") == {"new": 0, "skipped": 2, "failed": 0}


def test_corrupt_rows_fail(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join([json.dumps({"id": 1, "v": "a"}), "{broken", json.dumps({"id": 2, "v": "b"}), json.dumps({"id": "x", "v": "c"})]))
    rows = spark.read.schema(f"{SCHEMA}, {sinks.CORRUPT} string").json(str(source))
    path = str(tmp_path / "t")
    assert sinks.ingest_batch(rows, path, "b", "id") == {"new": 2, "skipped": 0, "failed": 2}
    assert sinks.ingested(spark, path).columns == ["id", "v"]


def test_stream(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "t", "state"))
    for some in ([(1, "a"), (2, "b")], [(2, "b"), (3, None), (None, "d")]):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        serving.ingest_counted(spark.readStream.schema(SCHEMA).parquet(source), path, state, "id").awaitTermination()
    assert ids(spark, path) == [1, 2, 3]
    counts = sorted((c["new"], c["skipped"], c["failed"]) for c in sinks._committed(spark, path).values())
    assert counts == [(1, 1, 1), (2, 0, 0)]
