"""Serving as streams: request metrics, answer cache, incremental ingest, event windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import cache_key
from ..sources.sinks import append_new, ingest_batch


def request_metrics(events: DataFrame, request: str = "req_id") -> DataFrame:
    """Latency, time to the first token and token rate of each request, from event rows ``type, ts``.

    On a stream with a watermark this is a stateful aggregation.
    """
    seconds = lambda c: c.cast("timestamp").cast("double")
    ts = seconds(F.col("ts"))
    token = F.col("type") == "token"
    grouped = events.groupBy(request).agg(
        F.min(ts).alias("start"), F.max(ts).alias("stop"), F.min(F.when(token, ts)).alias("first_token"), F.count_if(token).alias("tokens")
    )
    total = F.col("stop") - F.col("start")
    return grouped.select(
        request,
        total.alias("total_time"),
        (F.col("first_token") - F.col("start")).alias("ttft"),
        "tokens",
        F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("tok_per_sec"),
    )


def windowed(events: DataFrame, ts: str, width: str, slide: str | None = None, late: str | None = None, *by: str) -> DataFrame:
    """Counts and sums by window; with ``late`` as a watermark, for streams."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width, slide), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, gap: str, late: str | None = None, *by: str) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def cacheable(answers: DataFrame, version: Column, least: int = 20) -> DataFrame:
    """Answers worth keeping, by normalised query and corpus version; of one key the latest."""
    kept = answers.where(F.length("answer") > least).withColumn("cache_key", F.concat_ws("|", version, cache_key(F.col("query"))))
    return kept.groupBy("cache_key").agg(F.max_by("answer", "ts").alias("answer"), F.max("ts").alias("ts"))


def cached_stream(requests: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Of a stream of ``cache_key, query, ts``, whether each request repeats one less than the time to live ago.

    One time is kept for each key, for ever; ``cache.answered_stream`` bounds keys and lets them expire.
    """
    schema = "cache_key string, query string, ts timestamp, hit boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values("ts")
            hits = []
            for at in frame["ts"]:
                now = at.timestamp()
                hits.append(last is not None and now - last <= ttl_seconds)
                if not hits[-1]:
                    last = now
            yield frame.assign(hit=hits)[["cache_key", "query", "ts", "hit"]]
        if last is not None:
            state.update((last,))

    return requests.groupBy("cache_key").applyInPandasWithState(step, schema, "last double", "append", "NoTimeout")


def ingest(stream: DataFrame, path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Append each batch's new rows to a parquet table; restarts and repeats add nothing."""

    def append(batch: DataFrame, _: int) -> None:
        append_new(batch, path, *keys)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_counted(stream: DataFrame, path: str, checkpoint: str, *keys: str, failed: Column | None = None) -> StreamingQuery:
    """Ingest each batch with its counts; a batch is known by its checkpoint and number, so a restart that repeats it adds nothing."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, path, f"{name}-{number:09d}", *keys, failed=failed)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Tags of a call that an answer's reader does not see.
CALL_TAGS = ("<tool_call>", "</tool_call>")


def visible_tokens(tokens: DataFrame, request: str, order: str, delta: str, tags: tuple[str, str] = CALL_TAGS) -> DataFrame:
    """``request, place, token``: an answer's tokens less those of calls in it.

    From the token that completes an opening tag to the one that completes the
    closing tag none is shown; what came of a tag before it was complete has been
    shown. An answer without a closing tag ends at the opening one. The tokens of
    one answer, which has a bounded length, meet in one row.
    """
    opening, closing = (F.lit(t) for t in tags)
    keep = max(len(t) for t in tags) - 1
    ordered = tokens.groupBy(request).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(delta, F.lit("")).alias("t")))), lambda x: x["t"]).alias("ts"))

    def step(state: Column, token: Column) -> Column:
        text = F.concat(state["tail"], token)
        opens = state["hidden"] | F.contains(text, opening)
        # A closing tag counts after the opening one only.
        rest = F.when(state["hidden"], text).otherwise(F.substring_index(text, tags[0], -1))
        closes = opens & F.contains(rest, closing)
        tail = F.when(closes, F.substring_index(rest, tags[1], -1)).when(opens, F.right(rest, F.lit(keep))).otherwise(F.right(text, F.lit(keep)))
        shown = F.when(opens, state["shown"]).otherwise(F.concat(state["shown"], F.array(token)))
        return F.struct(tail.alias("tail"), (opens & ~closes).alias("hidden"), shown.alias("shown"))

    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("hidden"), F.array().cast("array<string>").alias("shown"))
    return ordered.select(request, F.posexplode(F.aggregate("ts", start, step, lambda s: s["shown"])).alias("place", "token"))
