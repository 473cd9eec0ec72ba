"""The vector store against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.sources import vectors

SCHEMA = "id long, embedding array<double>, label int"


def clustered(n=1500, groups=25, width=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 4
    own = rng.integers(groups, size=n)
    return [(i, (centres[g] + rng.normal(size=width)).tolist(), int(g % 4)) for i, g in enumerate(own.tolist())]


def nearest(rows, query, k, keep=lambda r: True):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    found = sorted((-round(float(unit(query) @ unit(v)), 9), i) for i, v, label in rows if v is not None and any(v) and keep((i, v, label)))
    return [i for _, i in found[:k]]


def answers(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = clustered()
    odd = [(5000, None, 0), (5001, [0.0] * 12, 1)]
    path = str(tmp_path_factory.mktemp("store") / "v")
    return rows, vectors.VectorStore.create(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), path), path


def test_recall_of_the_lists(spark, made):
    rows, store, _ = made
    asked = [(i, v) for i, v, _ in rows if i % 50 == 0]
    queries = spark.createDataFrame(asked, "q long, embedding array<double>")
    found, exact = answers(store.query(queries, "q")), answers(store.query(queries, "q", exact=True))
    want = {i: nearest(rows, v, 8) for i, v in asked}
    assert exact == want
    assert np.mean([len(set(found[i]) & set(want[i])) / 8 for i in want]) >= 0.9
    assert store.probes <= len(store.centres) // 2


def test_filter_and_pruning(spark, made):
    rows, store, _ = made
    queries = spark.createDataFrame([(1, rows[3][1]), (2, None), (3, [0.0] * 12)], "q long, embedding array<double>")
    df = store.query(queries, "q", 5, F.col("label") == 2, exact=True)
    assert answers(df) == {1: nearest(rows, rows[3][1], 5, lambda r: r[2] == 2)}
    plan = store.query(queries, "q", 5, "label = 2")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,2)]" in plan and "PartitionFilters: [isnotnull(__list" in plan or "PartitionFilters: [__list" in plan
    with pytest.raises(ValueError):
        store.query(queries, "q", 3001)


def test_get_count_and_add(spark, made, tmp_path):
    rows, store, path = made
    assert store.count() == len(rows) + 2 and store.count("label = 1") == sum(r[2] == 1 for r in rows) + 1
    keys = spark.createDataFrame([(3,), (5000,), (9999,)], "k long")
    assert sorted(r["id"] for r in store.get(keys=keys).collect()) == [3, 5000]
    again = vectors.VectorStore(spark, path)
    assert again.probes == store.probes and np.allclose(again.centres, store.centres)
    small = vectors.VectorStore.create(spark.createDataFrame(rows[:40], SCHEMA), str(tmp_path / "s"), lists=4)
    more = spark.createDataFrame(rows[30:60] + rows[50:60], SCHEMA)
    small.add(more)
    small.add(more)
    assert sorted(r["id"] for r in small.get().collect()) == list(range(60))
    queries = spark.createDataFrame([(0, rows[55][1])], "q long, embedding array<double>")
    assert answers(small.query(queries, "q", 60, exact=True))[0] == nearest(rows[:60], rows[55][1], 60)


def test_empty_store(spark, tmp_path):
    store = vectors.VectorStore.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert store.query(spark.createDataFrame([(1, [1.0])], "q long, embedding array<double>"), "q").collect() == []
