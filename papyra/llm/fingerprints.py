"""Document fingerprints by SimHash.

The terms of a text are its words; each votes on 64 signed bits with its hash and
the weight 1 + ln(times it occurs), and the signs are the fingerprint (Charikar,
STOC 2002). Fingerprints within a Hamming radius are found with permuted block
tables (Manku et al., WWW 2007): the bits are cut into radius + spare blocks, and
any two such fingerprints agree on ``spare`` whole blocks, so there is one table
for each choice of these, keyed by their bits.

Defined results: a null text counts as empty; texts without words have the
fingerprint 0; equal texts have equal fingerprints; documents that share a
doc_id follow each other in order of a hash of their text, and so do those
without one, after all others; the next document of the last is the first; an
empty table gives an empty result; extra columns are ignored. Texts are read
whole; memory grows with the longest ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged
from .shingles import word_hashes

BITS = 64
RADIUS = 3
BUCKET_BYTES = 16 << 20
ORDER_ROWS = 50_000
MOST_BUCKETS = 10_000
#: Stands for no id where numbers are compared.
NO_ID = (1 << 63) - 1
#: Fingerprints compared with as many at once.
TILE = 1024


def simhashes(texts: list[bytes | None]) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for first, words, counts in word_hashes(texts):
        at = 0
        for i, c in enumerate(counts.tolist(), first):
            if c:
                terms, times = np.unique(words[at : at + c], return_counts=True)
                weights = (1 + np.log(times)).astype(np.float64)
                bits = np.unpackbits(terms[:, None].view(np.uint8), axis=1, bitorder="little")
                votes = weights @ bits * 2 - weights.sum()
                out[i] = np.packbits(votes > 0, bitorder="little").view(np.uint64)[0]
            at += c
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents with ``h``, a hash of the text, in buckets that follow each other as doc_id and h do.

    Bucket bounds are quantiles of doc_id. Documents without a doc_id come after
    all others, in buckets that are even ranges of h.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    known = F.col("doc_id").isNotNull()
    total = texts.groupBy(known.alias("known")).agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).collect()
    needed = {r["known"]: min(MOST_BUCKETS, max(1, -(-r["n"] // BUCKET_BYTES), -(-r["rows"] // ORDER_ROWS))) for r in total}
    n, nulls = needed.get(True, 1), needed.get(False, 1)
    bounds = texts.where(known).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    placed = texts.withColumn("bucket", F.lit(0.0))
    if bounds:
        splits = [-float("inf"), *sorted(set(bounds)), float("inf")]
        keyed = texts.withColumn("at", F.col("doc_id").cast("double"))
        placed = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep").transform(keyed).drop("at")
    # The hash as a share of its range, from 0 on.
    share = F.col("h").cast("double") / 2.0**64 + 0.5
    return placed.withColumn("bucket", F.when(known, F.col("bucket")).otherwise(F.lit(float(n)) + F.floor(share * nulls)))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and their likeness.

    The first document of each bucket is put at the end of the bucket before,
    marked as a follower; that of the first bucket goes to the last.
    """
    placed = _ordered(docs)
    # Numbers and hashes only, one row a bucket, and MOST_BUCKETS for either kind of document at most.
    heads = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy())))
    heads = heads.select(F.col("bucket").alias("b"), "f", "to")
    same = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("h") == F.col("f.h"))
    # Rows of equal id and hash have equal texts; one of them follows.
    firsts = staged(placed.join(F.broadcast(heads), same).groupBy(F.col("to").alias("bucket"), "doc_id", "h").agg(F.min("text").alias("text")), "firsts")
    columns = ["bucket", "doc_id", "text", "h"]
    rows = placed.select(*columns, F.lit(0).alias("follows")).unionByName(firsts.select(*columns, F.lit(1).alias("follows")))
    schema = docs.select("doc_id").schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema.add(name, kind)

    def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of all but the last text; each is followed by the next."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own = simhashes([t.encode() for t in texts])
        new = simhashes([t.encode() for t in changed])
        columns = [
            pa.array(ids[:-1], schema_type),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([f"{x:016x}" for x in own[:-1].tolist()], pa.string()),
            pa.array([f"{x:016x}" for x in new.tolist()], pa.string()),
            pa.array(likeness(own[:-1], new), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema_type = to_arrow_type(schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        bucket, size = None, 0
        for batch in batches:
            for b, i, t in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if b != bucket:
                    if len(ids) > 1:
                        yield emit(ids, texts)
                    ids, texts, bucket, size = [], [], b, 0
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > 1 << 20:
                    yield emit(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if len(ids) > 1:
            yield emit(ids, texts)

    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket", "follows", "doc_id", "h", "text")
    return sorted_rows.mapInArrow(run, schema)


def _blocks(radius: int, spare: int) -> list[Column]:
    """The bits of each block of a fingerprint column ``fp``."""
    n = radius + spare
    cuts = [BITS * i // n for i in range(n + 1)]
    return [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1)) for a, b in zip(cuts, cuts[1:], strict=False)]


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, spare: int = 2) -> DataFrame:
    """All pairs ``query_id, id, distance`` of fingerprints within ``radius`` bits.

    ``prints`` and ``queries`` have ``id`` and ``fp`` (a long). Queries are
    joined by distinct fingerprint, and so are the prints, so copies multiply
    only in the pairs that are asked for.
    """
    tables = list(combinations(range(radius + spare), spare))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        blocks = _blocks(radius, spare)
        keys = F.array(*[F.xxhash64(F.lit(t), *[blocks[i] for i in chosen]) for t, chosen in enumerate(tables)])
        return rows.select("fp").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("key"))

    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = keyed(queries, "a").join(keyed(prints, "b"), "key").where(distance <= radius).select("a", "b", distance.cast("long").alias("distance")).distinct()
    return (
        near.join(queries.select(F.col("fp").alias("a"), F.col("id").alias("query_id")), "a")
        .join(prints.select(F.col("fp").alias("b"), "id"), "b")
        .where("query_id <> id")
        .select("query_id", "id", "distance")
    )


def _lowest(radius: int, spare: int) -> np.ndarray:
    """By the blocks on which two fingerprints agree (bits): the first table that puts them together."""
    n = radius + spare
    tables = [sum(1 << i for i in chosen) for chosen in combinations(range(n), spare)]
    return np.array([next((t for t, mask in enumerate(tables) if z & mask == mask), -1) for z in range(1 << n)], dtype=np.int64)


def neighbours(prints: DataFrame, radius: int = RADIUS, spare: int = 2) -> DataFrame:
    """``fp, n_near, first_near`` of every fingerprint of ``prints`` (``id, fp``): other documents within ``radius`` bits, and the smallest id (an integer) within it, its own included.

    Equal fingerprints are one row. A bucket of a block table holds those that
    agree on its blocks; its members are compared in tiles and a pair counts in
    the first table that has it, so what leaves a task is a count for each member
    of a bucket, not the pairs.
    """
    tables = list(combinations(range(radius + spare), spare))
    blocks = _blocks(radius, spare)
    classes = staged(prints.groupBy("fp").agg(F.count("*").alias("n"), F.coalesce(F.min(F.col("id").cast("long")), F.lit(NO_ID)).alias("first")), "prints")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[blocks[i] for i in chosen]).alias("key")) for t, chosen in enumerate(tables)])
    keyed = classes.select("fp", "n", "first", F.explode(keys).alias("k")).select("k.key", "k.t", "fp", "n", "first")
    firsts = _lowest(radius, spare)
    cuts = [BITS * i // (radius + spare) for i in range(radius + spare + 1)]
    masks = np.array([((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)], dtype=np.uint64)

    def met(t: int, fp: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each member of a bucket its partners' documents and their smallest id."""
        docs, low = np.zeros(len(fp), dtype=np.int64), np.full(len(fp), NO_ID)
        for a in range(0, len(fp), TILE):
            for b in range(0, len(fp), TILE):
                apart = fp[a : a + TILE, None] ^ fp[None, b : b + TILE]
                i, j = np.nonzero((np.bitwise_count(apart) <= radius) & (apart != 0))
                agree = ((apart[i, j][:, None] & masks) == 0) @ (1 << np.arange(len(masks)))
                own = firsts[agree] == t
                np.add.at(docs, a + i[own], n[b + j[own]])
                np.minimum.at(low, a + i[own], first[b + j[own]])
        return docs, low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=k) for k in (np.int64, np.int32, np.uint64, np.int64, np.int64)]

        def emit(key: np.ndarray, t: np.ndarray, fp: np.ndarray, n: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
            ends = np.append(edges[1:], len(key))
            out: list[tuple] = [(fp[:0], n[:0], first[:0])]
            for a, b in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist(), strict=True):
                docs, low = met(int(t[a]), fp[a:b], n[a:b], first[a:b])
                some = docs > 0
                out.append((fp[a:b][some], docs[some], low[some]))
            own, docs, low = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(docs), pa.array(low)], names=["fp", "docs", "low"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(), batch.column(4).to_numpy()]
            held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            # The last bucket may go on in the next batch.
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield emit(*[h[:last] for h in held])
            held = [h[last:] for h in held]
        yield emit(*held)

    dealt = keyed.repartition("key").sortWithinPartitions("key")
    near = dealt.mapInArrow(run, "fp long, docs long, low long").groupBy("fp").agg(F.sum("docs").alias("docs"), F.min("low").alias("low"))
    low = F.least("first", F.coalesce("low", F.lit(NO_ID)))
    return classes.join(near, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("docs", F.lit(0))).alias("n_near"), F.when(low != NO_ID, low).alias("first_near"))


def searched(docs: DataFrame) -> DataFrame:
    """``compare`` with ``n_near`` and ``first_near`` of each document."""
    found = staged(compare(docs), "compared")
    # Two halves, as a number of 64 bits has no sign to fit.
    half = lambda a: F.conv(F.substring("fingerprint", a, 8), 16, 10).cast("long")
    rows = found.withColumn("fp", F.shiftleft(half(1), 32).bitwiseOR(half(9)))
    return rows.join(neighbours(rows.select(F.col("doc_id").alias("id"), "fp")), "fp").select(*found.columns, "n_near", "first_near")
