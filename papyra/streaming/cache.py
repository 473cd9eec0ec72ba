"""Answer caches with a bound and a time to live, as batches and as streams.

A cache keeps the answers of the ``capacity`` requests used last, each for
``ttl_seconds`` from the time it was saved; using an answer doesn't prolong its
life. There is one cache for each value of ``part``, say a version of the corpus
or a shard of the keys, so caches are spread over tasks and each task holds one
cache's entries at a time.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAPACITY = 256
TTL_SECONDS = 7 * 86400
#: The state store that streams with several kinds of state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lru:
    """Keys and the times they were saved, the one used last at the end."""

    def __init__(self, capacity: int, ttl: float, entries: list[tuple[str, float]] | None = None):
        self.capacity, self.ttl = capacity, ttl
        self.saved: OrderedDict[str, float] = OrderedDict(entries or [])

    def expire(self, now: float) -> None:
        """Drop what was saved longer ago than the time to live."""
        for key in [k for k, saved in self.saved.items() if now - saved > self.ttl]:
            del self.saved[key]

    def ask(self, key: str, now: float, cacheable: bool) -> bool:
        """Whether a request is answered from the cache; if not, its answer is saved if it may be."""
        self.expire(now)
        if key in self.saved:
            self.saved.move_to_end(key)
            return True
        if cacheable:
            self.saved[key] = now
            if len(self.saved) > self.capacity:
                self.saved.popitem(last=False)
        return False


def answered(requests: DataFrame, capacity: int = CAPACITY, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """``part, request_id, cache_key, ts, hit`` of rows ``part, request_id, cache_key, ts, cacheable``, in order of ts and request_id.

    A request without a key misses and saves nothing; a null ``cacheable`` is false; those without a time come first, at time 0.
    """
    rows = requests.select("part", "request_id", "cache_key", "ts", F.coalesce("cacheable", F.lit(False)).alias("cacheable"), F.coalesce(F.col("ts").cast("timestamp").cast("double"), F.lit(0.0)).alias("now"))
    schema = T.StructType([*rows.select("part", "request_id", "cache_key", "ts").schema.fields, T.StructField("hit", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, of = Lru(capacity, ttl_seconds), None
        for batch in batches:
            hits = []
            for part, key, cacheable, now in zip(*[batch.column(i).to_pylist() for i in (0, 2, 4, 5)], strict=True):
                if (part,) != of:
                    cache, of = Lru(capacity, ttl_seconds), (part,)
                hits.append(key is not None and cache.ask(key, now, cacheable))
            columns = [batch.column(i).cast(f.type) for i, f in zip(range(4), arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.bool_())], schema=arrow)

    return rows.repartition("part").sortWithinPartitions("part", "now", "request_id").mapInArrow(run, schema)


class AnswerCache(StatefulProcessor):
    """The cache of one part as state: its entries, and a timer for the one that expires next."""

    def __init__(self, capacity: int, ttl_seconds: float):
        self.capacity, self.ttl = capacity, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "cache_key string", "saved double, used long")

    def _load(self) -> Lru:
        held = sorted((used, key, saved) for (key,), (saved, used) in self.entries.iterator())
        return Lru(self.capacity, self.ttl, [(key, saved) for _, key, saved in held])

    def _store(self, cache: Lru, before: dict[str, tuple[float, int]]) -> None:
        """Write what has changed, and wait for the next entry to expire."""
        for key in before.keys() - cache.saved.keys():
            self.entries.removeKey((key,))
        for used, (key, saved) in enumerate(cache.saved.items()):
            if before.get(key) != (saved, used):
                self.entries.updateValue((key,), (saved, used))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if cache.saved:
            self.handle.registerTimer(int((min(cache.saved.values()) + self.ttl) * 1000) + 1)

    def _before(self) -> dict[str, tuple[float, int]]:
        return {key: (saved, used) for (key,), (saved, used) in self.entries.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, cache = self._before(), self._load()
        frame = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        hits = [k is not None and cache.ask(k, at.timestamp(), bool(c)) for k, at, c in zip(frame["cache_key"], frame["ts"], frame["cacheable"], strict=True)]
        self._store(cache, before)
        yield frame.assign(hit=hits)[["part", "request_id", "cache_key", "ts", "hit"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, cache = self._before(), self._load()
        cache.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._store(cache, before)
        yield pd.DataFrame(columns=["part", "request_id", "cache_key", "ts", "hit"])

    def close(self) -> None:
        pass


def answered_stream(requests: DataFrame, capacity: int = CAPACITY, ttl_seconds: float = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``answered`` for a stream: rows of a batch in order of ts, state that ends with the time to live.

    Entries go when the watermark passes their time, so a part that is asked no
    more leaves no state. The session has to name ``STATE_STORE``.
    """
    spark = requests.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass has to be {STATE_STORE}")
    rows = requests.select("part", "request_id", "cache_key", "ts", F.coalesce("cacheable", F.lit(False)).alias("cacheable")).withWatermark("ts", late)
    schema = T.StructType([*rows.select("part", "request_id", "cache_key", "ts").schema.fields, T.StructField("hit", T.BooleanType())])
    return rows.groupBy("part").transformWithStateInPandas(AnswerCache(capacity, ttl_seconds), schema, "append", "EventTime")
