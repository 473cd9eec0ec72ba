"""The answer cache: batch against brute force, stream over batches and restarts."""

import datetime
import random

from papyra.streaming import cache

SCHEMA = "part long, request_id long, cache_key string, ts timestamp, cacheable boolean"
START = datetime.datetime(2024, 1, 1)


def rows_of(n, seed, parts=3, keys=12):
    rng = random.Random(seed)
    out, now = [], START
    for i in range(n):
        now += datetime.timedelta(seconds=rng.choice([1, 5, 40]))
        out.append((rng.randrange(parts), i, rng.choice([f"k{rng.randrange(keys)}", f"k{rng.randrange(3)}", None if i % 50 == 7 else "k0"]), now, rng.random() < 0.9))
    return out


def brute(rows, capacity, ttl):
    """Each request looks back: saved when, used last, and how many others since."""
    hits, held = {}, {}
    for part, i, key, ts, ok in sorted(rows, key=lambda r: (r[3], r[1])):
        now = ts.timestamp()
        entries = [e for e in held.get(part, []) if now - e[1] <= ttl]
        mine = [e for e in entries if e[0] == key]
        hits[i] = bool(mine) and key is not None
        if key is not None and mine:
            entries = [e for e in entries if e[0] != key] + mine
        elif key is not None and ok:
            entries = [*entries, (key, now)][-capacity:]
        held[part] = entries
    return hits


def test_batch_matches_brute_force(spark):
    rows = rows_of(600, 1)
    for capacity, ttl in ((4, 60), (2, 10_000), (100, 25)):
        got = cache.answered(spark.createDataFrame(rows, SCHEMA).repartition(3), capacity, ttl)
        assert {r["request_id"]: r["hit"] for r in got.collect()} == brute(rows, capacity, ttl)
    odd = [(None, 1, "k", None, None), (None, 2, "k", START, True), (None, 3, "k", START, True), (1, 4, None, START, True), (1, 5, None, START, True)]
    got = {r["request_id"]: r["hit"] for r in cache.answered(spark.createDataFrame(odd, SCHEMA)).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert cache.answered(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_over_restarts_expiry_and_eviction(spark, tmp_path):
    rows = rows_of(150, 2)
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cache.STATE_STORE)
    try:
        # Four starts with one checkpoint; the third comes long after all else has expired, and the fourth sees its watermark.
        last = rows[-1][3] + datetime.timedelta(days=1)
        late = [(0, 1000, "k0", last, True), (0, 1001, "k0", last + datetime.timedelta(seconds=1), True)]
        after = [(0, 1002, "k0", last + datetime.timedelta(seconds=2), True)]
        for some in (rows[:70], rows[70:], late, after):
            spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = cache.answered_stream(spark.readStream.schema(SCHEMA).parquet(source), 4, 60)
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
            assert query.exception() is None
        got = {r["request_id"]: r["hit"] for r in spark.read.parquet(out).collect()}
        assert got == brute(rows + late + after, 4, 60)
        # Parts that are asked no more have left no state.
        entries = spark.read.format("statestore").option("path", state).option("stateVarName", "entries").load()
        assert [(r["key"]["part"], r["user_map_key"]["cache_key"]) for r in entries.collect()] == [(0, "k0")]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
