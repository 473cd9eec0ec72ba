"""Mixing sources to target weights (native).

Every source is a stream of words: its documents in a pseudorandom order, cut
into blocks of ``block_words``. An output slot takes one block. Slots are dealt
to output shards by one pseudorandom permutation of all slots, so the source
counts of a shard are a multinomial draw conditioned on every source meeting its
total. Within a source, slot numbers go through a pseudorandom permutation of
its block numbers, a new one each epoch, and blocks are joined by that number.
The output is written as packed blocks, one row a slot with its words, and what
was taken of each document is counted from that output.

Defined results: a null text counts as empty and a document without words gets
0; null sources form one source of their own, last in order; repeated rows and
repeated doc_ids are separate documents; an empty table gives an empty result;
columns other than doc_id, text and source are ignored, whatever their names.
Texts of any length are cut into blocks; sources share no window or task, for
documents are numbered in buckets of bounded expected size. The documents are
read twice, for sizes and for texts, and must give the same rows both times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, staged

#: What stands between words.
SPACE = r"[\x20\x09-\x0D]+"

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 2048
SHARD_SLOTS = 1024
BUCKET_ROWS = 4096
SLOT_CHUNK = 4096
WRITTEN_SLOTS = 64
WALK = 64


def _size() -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, source, size)``, staged."""
    return staged(docs.select("doc_id", "source", _size().alias("size")), "sizes")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: its rank, size, weight and target.

    Targets share the total size by weight; a target above ``most`` times its
    source's size stops there and the excess is shared by weight again. In order
    of ``size / weight`` the stopped sources come first, so the level is found
    by running sums instead of rounds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_ix") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("source_ix", F.row_number().over(order)).withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(most)
    by_level = Window.orderBy(cap / F.col("weight"), "source_ix")
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    per = (
        per.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(after))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("stops", F.col("level") * F.col("weight") > cap)
    )
    # All sources before the first that does not stop are at their cap; it sets the level of the rest.
    first_free = F.min(F.when(~F.col("stops"), F.struct(cap / F.col("weight"), "source_ix", "left_words", "left_weight"))).over(everything)
    per = per.withColumn("free", first_free)
    share = F.col("free.left_words") * F.col("weight") / F.col("free.left_weight")
    return per.select(
        "source",
        F.col("source_ix").cast("long").alias("source_ix"),
        "source_size",
        F.least(cap.cast("double"), F.coalesce(share, cap.cast("double"))).alias("target"),
    )


def permuted(df: DataFrame, x: str, n: str, seed: Column, out: str) -> DataFrame:
    """Add ``out``: the image of column ``x`` under a pseudorandom permutation of 0..n-1.

    Multiply, add and xor-shift rounds permute the next power of two; numbers
    that leave 0..n-1 walk on until they return. After each step at most half
    the numbers are out, so WALK steps suffice; one still out raises an error.
    """
    bits = F.greatest(F.lit(2), F.length(F.bin(F.col(n) - 1)))
    mask = F.pow(F.lit(2.0), bits).cast("long") - F.lit(1)
    walk = F.struct(F.col(n).alias("n"), mask.alias("mask"), (bits / 2).cast("int").alias("half"), F.xxhash64(seed).alias("k"))

    def mixed(v: Column) -> Column:
        # Products stay below 2**63: a 20-bit odd factor times at most 2**42.
        for i, factor in enumerate((0x9E375, 0x85EBD, 0xC2B2D)):
            v = (v * F.lit(factor) + F.shiftrightunsigned(F.col("walk.k"), 1 + 7 * i)).bitwiseAND(F.col("walk.mask"))
            v = v.bitwiseXOR(F.call_function("shiftrightunsigned", v, F.col("walk.half")))
        return v

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        mixed(F.col(x).cast("long")),
        lambda v, _: F.when(v < F.col("walk.n"), v).otherwise(mixed(v)),
    )
    kept = F.when(F.col(out) < F.col("walk.n"), F.col(out)).otherwise(F.raise_error(F.lit("permutation walk did not end")))
    return df.withColumn("walk", walk).withColumn(out, walked).withColumn(out, kept).drop("walk")


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """All output slots: ``shard, place, source_ix, epoch, block, words``.

    A source of size s has ``s // block_words`` full blocks, numbered from 0, and
    a tail, numbered -1, which opens each epoch. ``words`` is how many leading
    words of the block the slot takes; only a source's last slot takes fewer
    than all, so that the source ends at its target.
    """
    b = F.lit(block_words).cast("long")
    full = F.floor(F.col("source_size") / b).cast("long")
    tail = F.col("source_size") - full * b
    want = F.floor("target").cast("long")
    per = (
        targets.where("source_size > 0")
        .select("source_ix", "source_size", full.alias("full"), tail.alias("tail"), want.alias("want"))
        .withColumn("whole", F.floor(F.col("want") / F.col("source_size")).cast("long"))
        .withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size"))
        .withColumn("rest_slots", F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.lit(1) + F.ceil(F.greatest(F.col("rest") - F.col("tail"), F.lit(0)) / b)).cast("long"))
        .withColumn("per_epoch", F.col("full") + 1)
        .withColumn("n_slots", F.col("whole") * F.col("per_epoch") + F.col("rest_slots"))
    )
    w = Window.orderBy("source_ix")
    per = per.withColumn("n_all", F.sum("n_slots").over(Window.partitionBy())).withColumn("before", F.sum("n_slots").over(w) - F.col("n_slots"))
    per = per.where("n_slots > 0")
    chunk = F.lit(SLOT_CHUNK).cast("long")
    chunks = per.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / chunk).cast("long")))).repartition("source_ix", "chunk")
    each = chunks.withColumn(
        "j", F.explode(F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("n_slots")) - 1))
    )
    each = (
        each.withColumn("epoch", F.floor(F.col("j") / F.col("per_epoch")).cast("long"))
        .withColumn("r", F.col("j") % F.col("per_epoch"))
        .withColumn("ordinal", F.greatest(F.col("r") - 1, F.lit(0)))
        .withColumn("domain", F.greatest(F.col("full"), F.lit(1)))
        .withColumn("number", F.col("before") + F.col("j"))
    )
    each = permuted(each, "ordinal", "domain", F.struct(F.lit(seed), "source_ix", "epoch"), "block")
    each = permuted(each, "number", "n_all", F.struct(F.lit(seed), F.lit("shards")), "at")
    length = F.when(F.col("r") == 0, F.col("tail")).otherwise(b)
    ahead = F.when(F.col("r") == 0, F.lit(0).cast("long")).otherwise(F.col("tail") + (F.col("r") - 1) * b)
    left = F.when(F.col("epoch") < F.col("whole"), length).otherwise(F.least(length, F.greatest(F.col("rest") - ahead, F.lit(0))))
    return each.select(
        F.floor(F.col("at") / shard_slots).cast("long").alias("shard"),
        (F.col("at") % shard_slots).alias("place"),
        "source_ix",
        "epoch",
        F.when(F.col("r") == 0, F.lit(-1)).otherwise(F.col("block")).cast("long").alias("block"),
        left.cast("long").alias("words"),
    ).where("words > 0")


def shard_counts(slot_rows: DataFrame) -> DataFrame:
    """Drawn source counts of each output shard."""
    return slot_rows.groupBy("shard", "source_ix").agg(F.count("*").alias("n_slots"))


def packed(docs: DataFrame, targets: DataFrame, n_docs: int, n_sources: int, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Documents laid into their source's blocks: a row per document and block.

    ``first`` and ``n_words`` say where in the block the document's words lie,
    ``words`` are these words. Offsets are running sums in two steps, over
    buckets and within one, so a source of any size is spread over tasks.
    """
    n_buckets = max(1, -(-n_docs // BUCKET_ROWS))
    rows = docs.select("doc_id", "source", "text", _size().alias("size")).where("size > 0")
    keyed = rows.join(small(targets, n_sources), rows["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "text", "size", "source_ix", "source_size", "target", F.xxhash64(F.lit(seed), "doc_id", "size").alias("key")
    )
    keyed = keyed.withColumn("bucket", F.pmod(F.col("key"), F.lit(n_buckets)))
    before = Window.partitionBy("source_ix").orderBy("bucket")
    starts = keyed.groupBy("source_ix", "bucket").agg(F.sum("size").alias("n")).withColumn("bucket_start", F.sum("n").over(before) - F.col("n")).drop("n")
    # The bucket's own order; equal rows are interchangeable.
    within = Window.partitionBy("source_ix", "bucket").orderBy("key", "doc_id", "size", F.xxhash64("text"), "text")
    placed = (
        keyed.withColumn("in_bucket", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(starts, ["source_ix", "bucket"])
        .withColumn("start", F.col("bucket_start") + F.col("in_bucket"))
    )
    b = F.lit(block_words).cast("long")
    start, stop = F.col("start"), F.col("start") + F.col("size")
    n_full = F.floor(F.col("source_size") / b).cast("long")

    def piece(words: Column, at: Column) -> Column:
        from_, to = F.greatest(start, at * b), F.least(stop, (at + 1) * b)
        own = F.slice(words, (from_ - start + 1).cast("int"), (to - from_).cast("int"))
        return F.struct(
            F.when(at < n_full, at).otherwise(F.lit(-1)).alias("block"),
            (from_ - at * b).alias("first"),
            (to - from_).alias("n_words"),
            F.array_join(own, " ").alias("words"),
        )

    # A lambda over an array of one binds the document's words, so that they are split once for all its pieces.
    blocks = F.sequence(F.floor(start / b).cast("long"), F.floor((stop - 1) / b).cast("long"))
    split = F.filter(F.split("text", SPACE, -1), lambda word: word != "")
    pieces = F.flatten(F.transform(F.array(split), lambda words: F.transform(blocks, lambda at: piece(words, at))))
    return placed.select("doc_id", "size", "source_ix", "source_size", "target", "start", F.inline(pieces))


def filled(pieces: DataFrame) -> DataFrame:
    """One row per block of a source, with its words and the documents they are of, staged."""
    part = F.struct("first", "start", "n_words", "doc_id", "size", "words")
    whole = pieces.groupBy("source_ix", "block").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return staged(
        whole.select(
            "source_ix",
            "block",
            F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["size"].alias("size"), p["start"].alias("start"), p["first"].alias("first"), p["n_words"].alias("n_words"))).alias("docs"),
            F.array_join(F.transform("parts", lambda p: p["words"]), " ").alias("text"),
        ),
        "blocks",
    )


def output(slot_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The packed blocks: ``shard, place, source_ix, epoch, block, words, docs, text``, staged.

    ``text`` holds the slot's words with one space between them, ``docs`` how
    many of them are of which document, in order. A shard is written in runs of
    WRITTEN_SLOTS places.
    """
    cut = F.array_join(F.slice(F.split("text", " ", -1), 1, F.col("words").cast("int")), " ")
    docs = F.transform(
        F.filter("docs", lambda d: d["first"] < F.col("words")),
        lambda d: F.struct(d["doc_id"].alias("doc_id"), d["start"].alias("start"), F.least(d["n_words"], F.col("words") - d["first"]).alias("n_words")),
    )
    held = F.aggregate("docs", F.lit(0).cast("long"), lambda n, d: n + d["n_words"])
    per = slot_rows.groupBy("source_ix", "block").agg(F.collect_list(F.struct("shard", "place", "epoch", "words")).alias("slots"))
    dealt = blocks.join(per, ["source_ix", "block"]).select("source_ix", "block", "docs", "text", F.inline("slots"))
    dealt = dealt.select("shard", "place", "source_ix", "epoch", "block", "words", docs.alias("docs"), F.when(F.col("words") < held, cut).otherwise(F.col("text")).alias("text"))
    run = F.floor(F.col("place") / WRITTEN_SLOTS)
    return staged(dealt.repartition("shard", run).sortWithinPartitions("shard", "place"), "packed")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 0) -> dict[str, DataFrame]:
    """The mix of ``docs``: tables ``sizes, targets, slots, blocks, output`` and ``taken``.

    ``output`` is ``slots`` joined to ``blocks`` by source and block, written
    with its words; ``taken`` has one row per document with the words the output
    holds of it.
    """
    sizes = sized(docs)
    targets = staged(source_targets(sizes, weights, most), "targets")
    n_sources = targets.count()
    slot_rows = slots(targets, block_words, seed=seed)
    blocks = filled(packed(docs, targets, sizes.count(), n_sources, block_words, seed))
    written = output(slot_rows, blocks)
    # All documents with words, at 0, and what the output holds of them.
    every = blocks.select("source_ix", F.explode("docs").alias("d")).select("source_ix", "d.start", F.struct("d.doc_id", "d.size").alias("doc"), F.lit(0).cast("long").alias("n"))
    held = written.select("source_ix", F.explode("docs").alias("d")).select("source_ix", "d.start", F.lit(None).cast(every.schema["doc"].dataType).alias("doc"), F.col("d.n_words").alias("n"))
    counted = every.unionByName(held).groupBy("source_ix", "start").agg(F.first("doc", ignorenulls=True).alias("doc"), F.sum("n").alias("taken"))
    taken = counted.join(small(targets, n_sources), "source_ix").select("doc.doc_id", "doc.size", "source_size", "target", "taken")
    none = (
        sizes.where("size = 0")
        .join(small(targets, n_sources), sizes["source"].eqNullSafe(targets["source"]))
        .select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    )
    return {"sizes": sizes, "targets": targets, "slots": slot_rows, "blocks": blocks, "output": written, "taken": taken.unionByName(none)}
