"""Exact n-gram Jaccard join by universe partition and pigeonhole.

Documents are sets of word shingles. Equal sets form one class, known by a
128-bit hash, and only classes are joined. A set that has more shingles of its own
than similar sets may differ in has no similar set; such classes drop out first,
found by counting a fixed share of all shingles over all documents.

Size bands make similar sets fall into one band or two neighbouring ones. For a
band whose smaller sets have up to ``hi`` shingles, similar sets differ in at most
H shingles, and every shingle belongs to one of a number of segments by its hash. A
segment gets a budget: 1 if two sets must agree on it to meet there, 2 if they may
differ by one shingle, which takes its one-deletion neighbourhood. If the budgets
sum to more than H, similar sets meet in at least one segment. The budgets are set
by cost: exact segments write least, but short ones are shared by chance, so a
band of small sets gets as many larger segments with neighbourhoods as it needs to
keep MIN_SEGMENT shingles a segment. Larger bands get spare segments instead, so
that costly ones may have budget 0: a set leaves out its segments of one shingle or
none, if the first kind of spare covers them, and needs no large group, if the
second kind covers its segments in large groups.

Classes that meet become candidates: all pairs of a small group; of a large one,
pairs with the first, the last and the next member. Parity sketches, which bound
the difference of two sets from below, rule out most others; the rest are
verified exactly, first one pair for each class, then those that are not yet
connected. Classes with more segments in large groups than the spare covers are
finished there: by the pairs of different components, if these are few, else by
a prefix join, which takes of each class the rarest shingles, as many as any
similar set must share one of. No link between components is missed, and no
large group is expanded into all its pairs.

Defined results: null and empty texts have no shingles and no links; a text of
fewer words than a shingle has one, its whole sequence; rows that repeat are
separate members of one class; different texts under one doc_id, or without one,
are documents of their own, but component_id is the smallest doc_id of the
component, or null if all its documents lack one; an empty table gives an empty
result; extra columns are ignored. Texts are read whole; memory grows with the
longest one. Words are compared by hashes of 64 bits: two that meet by chance
within one pair of documents would change a result about once in 2**40 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, components, free, named, staged
from .shingles import distinct, mix, shingle_sets

SHINGLE = 4
PERCENT = 85
MIN_SEGMENT = 5
SMALL_GROUP = 8
FEW_PAIRS = 64
SKETCH_BITS = 256
SHARD_BYTES = 16 << 20
#: One shingle in so many is counted to find classes with enough of their own.
COUNTED = 4


class Bands:
    """Size bands for a threshold in per cent, and the segments of each."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.low: list[int] = []
        self.high: list[int] = []
        self.segments: list[tuple[int, int, int, int]] = []
        lo = 1
        while (lo * (100 - percent)) // percent < 1:
            lo += 1  # smaller sets are similar to equal ones only
        self.first = lo

    def upto(self, n: int) -> None:
        while not self.high or self.high[-1] < n:
            lo = self.high[-1] + 1 if self.high else self.first
            hi = max(lo, lo * 100 // self.percent)
            self.low.append(lo)
            self.high.append(hi)
            self.segments.append(self.allocate(lo, hi))

    def allocate(self, lo: int, hi: int) -> tuple[int, int, int, int]:
        """Number of budget-2 and of budget-1 segments, and of both kinds of spare ones among the latter."""
        need = hi * (100 - self.percent) // self.percent + 1
        for two in range(need // 2 + 1):
            if lo >= MIN_SEGMENT * (two + need - 2 * two):
                break
        if two or need < 4:
            return two, max(0, need - 2 * two), 0, 0
        short, large = 1 + need // 10, 1 + need // 25
        return 0, need + short + large, short, large

    def of(self, n: int) -> list[int]:
        """The bands whose smaller sets may be similar to a set of n."""
        if n < self.first:
            return []
        self.upto(n)
        k = int(np.searchsorted(self.low, n, side="right")) - 1
        return [k - 1, k] if k and n * self.percent <= self.high[k - 1] * 100 else [k]


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashed segments, and one-deletion neighbours of budget-2 segments, of one set."""
    out = []
    place, value = mix(shingles, 1), mix(shingles, 2)
    for g in bands.of(len(shingles)):
        two, one, short, _ = bands.segments[g]
        m = two + one
        seg = ((place >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(m, dtype=np.uint64)
        np.add.at(total, seg, value)
        held = np.bincount(seg, minlength=m) > 1
        salts = mix(np.arange(m, dtype=np.uint64), 1000 + g)
        whole = mix(total ^ salts)
        out.append(whole if m - np.count_nonzero(held) > short else whole[held])
        if two:
            near = seg < two
            out.append(mix((total[seg[near]] - value[near]) ^ salts[seg[near]]))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(shingles, 3).sum(dtype=np.uint64), mix(shingles, 4).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles in each bucket: SKETCH_BITS buckets, doubled up to twice the set's size.

    Sets differ in at least as many shingles as their sketches in bits. Half as
    many buckets result from an exclusive or of both halves.
    """
    bits = SKETCH_BITS
    while bits < 2 * len(shingles):
        bits *= 2
    at = (mix(shingles, 5) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketches_apart(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, folded to the size of the smaller."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def text_hash() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Each document's number of shingles, set hashes, sketch, and large groups that its spare segments cover.

    ``t`` is a hash of the text, as a doc_id may repeat or be missing.
    """
    schema = docs.select("doc_id").schema
    for name, kind in (("t", "long"), ("n", "long"), ("s1", "long"), ("s2", "long"), ("sketch", "binary"), ("spare", "long")):
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            n, hashes, sketches, spare = [], [], [], []
            for s in shingle_sets(_bytes(batch.column(2)), k):
                n.append(len(s))
                hashes.append(set_hash(s))
                sketches.append(sketch(s) if len(s) >= bands.first else b"")
                spare.append(min([bands.segments[g][3] for g in bands.of(len(s))], default=0))
            a, b = zip(*hashes, strict=True) if hashes else ([], [])
            columns = [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketches, pa.binary()), pa.array(spare, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return docs.select("doc_id", text_hash().alias("t"), "text").mapInArrow(run, schema)


def _packed(shard: int, *parts: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([p.tobytes()], pa.binary()) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *arrays], names=["shard", *[f"p{i}" for i in range(len(parts))]])


def _unpacked(table: pa.Table, *kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(f"p{i}").to_pylist()), dtype=k) for i, k in enumerate(kinds)]


_PACKED_COUNTS = pa.schema([("shard", pa.int32()), ("p0", pa.binary()), ("p1", pa.binary()), ("p2", pa.binary())])


def _packed_schema(parts: int) -> str:
    return "shard int, " + ", ".join(f"p{i} binary" for i in range(parts))


def _dealt(hashes: np.ndarray, owner: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By shard of the hash: shard, hashes, and which owners have how many of them; owners ascend."""
    if not len(hashes):
        return
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)], strict=True):
        own = order[a:b]
        who, times = np.unique(owner[own], return_counts=True)
        yield int(shard[own[0]]), hashes[own], who, times.astype(np.int32)


def _two_of_each(values: np.ndarray) -> np.ndarray:
    """Places, ascending, of the first two of equal values: two owners are enough to show that a shingle is shared."""
    order = np.argsort(values, kind="stable")
    keep = np.ones(len(values), dtype=bool)
    keep[2:] = values[order][2:] != values[order][:-2]
    return np.sort(order[keep])


def _own_counts(docs: DataFrame, k: int, least: int, shards: int) -> DataFrame:
    """``s1, s2, own``: how many of the counted shingles of each class no other class has.

    A batch sends two classes of each shingle at most, so a shingle that very many
    documents share does not gather them all in one shard. A shard's counts go on
    in packed form to the shards of their classes, which add them up.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], int] = {}
            found: list[np.ndarray] = []
            for s in shingle_sets(_bytes(batch.column(0)), k):
                if len(s) >= least and (h := set_hash(s)) not in seen:
                    seen[h] = len(seen)
                    found.append(s[s % np.uint64(COUNTED) == 0])
            if not found:
                continue
            ids = np.array(list(seen), dtype=np.int64)
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            kept = _two_of_each(counted := np.concatenate(found))
            for shard, hashes, who, times in _dealt(counted[kept], owner[kept], shards):
                # The shard stands for the upper bits, so 32 more tell shingles apart well enough for a filter.
                yield _packed(shard, mix(hashes, 6).astype(np.uint32), times, ids[who, 0], ids[who, 1])

    def count(table: pa.Table) -> pa.Table:
        hashes, times, s1, s2 = _unpacked(table, np.uint32, np.int32, np.int64, np.int64)
        classes, which = np.unique(np.rec.fromarrays([s1, s2], names="a,b"), return_inverse=True)
        pairs = distinct(hashes.astype(np.uint64) << np.uint64(32) | np.repeat(which, times).astype(np.uint64))
        hashes, owner = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, dtype=bool)
        own = np.bincount(owner[new & np.append(new[1:], True)] if len(hashes) else owner, minlength=len(classes))
        some = np.flatnonzero(own)
        classes, own = classes[some], own[some].astype(np.int32)
        shard = (np.ascontiguousarray(classes.a).view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        parts = [(int(x), shard == x) for x in np.unique(shard)]
        packed = [_packed(x, np.ascontiguousarray(classes.a[at]), np.ascontiguousarray(classes.b[at]), own[at]) for x, at in parts]
        return pa.Table.from_batches(packed, schema=_PACKED_COUNTS)

    def add(table: pa.Table) -> pa.Table:
        s1, s2, own = _unpacked(table, np.int64, np.int64, np.int32)
        classes, which = np.unique(np.rec.fromarrays([s1, s2], names="a,b"), return_inverse=True)
        total = np.bincount(which, weights=own, minlength=len(classes)).astype(np.int64)
        return pa.table([pa.array(np.ascontiguousarray(classes.a)), pa.array(np.ascontiguousarray(classes.b)), pa.array(total)], names=["s1", "s2", "own"])

    dealt = docs.select("text").mapInArrow(deal, _packed_schema(4))
    counted = dealt.groupBy("shard").applyInArrow(count, _packed_schema(3))
    return counted.groupBy("shard").applyInArrow(add, "s1 long, s2 long, own long")


def _rivals(docs: DataFrame, classes: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """Classes that may have a similar one: ``class, of, s1, s2``."""
    least = Bands(percent).first
    own = _own_counts(docs, k, least, shards)
    may_differ = F.col("n") - F.ceil(F.col("n") * percent / 100)
    joined = classes.where(F.col("n") >= least).join(own, ["s1", "s2"], "left")
    return joined.where(F.coalesce("own", F.lit(0)) <= may_differ).select("class", "of", "s1", "s2")


def _signed(texts: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """Signatures of the classes in ``class, text``, dealt to shards, packed: one row for each batch and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            sets = list(shingle_sets(_bytes(batch.column(1)), k))
            found = [signatures(s, bands) for s in sets]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            if not found:
                continue
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            for shard, sig, who, times in _dealt(np.concatenate(found), owner, shards):
                yield _packed(shard, sig, times, ids[who], sizes[who])

    return texts.select("class", "text").mapInArrow(run, _packed_schema(4))


def _meet(percent: int, small_group: int):
    """Of one shard's signatures: candidate pairs (kind 0) and members of large groups (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        sig, times, ids, n = _unpacked(table, np.uint64, np.int32, np.int64, np.int64)
        sets, first_at, which = np.unique(ids, return_index=True, return_inverse=True)
        n = n[first_at]
        owner = np.repeat(which.astype(np.int32), times)
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        keep = np.ones(len(sig), dtype=bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
        sig, owner = sig[keep], owner[keep]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(start, len(sig)))
        lefts, rights = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for s in range(2, small_group + 1):
            members = owner[start[size == s][:, None] + np.arange(s)]
            for i, j in combinations(range(s), 2):
                lefts.append(members[:, i])
                rights.append(members[:, j])
        group = np.repeat(np.arange(len(size)), size)
        big = size[group] > small_group
        first, last = owner[start][group[big]], owner[start + size - 1][group[big]]
        me = owner[big]
        same = np.append(group[big][1:] == group[big][:-1], False) if len(me) else np.zeros(0, dtype=bool)
        lefts += [first, me, me[same]]
        rights += [me, last, np.roll(me, -1)[same]]
        left, right = np.concatenate(lefts), np.concatenate(rights)
        small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        ok = (left != right) & (small * 100 >= large * percent)
        left, right = np.minimum(left[ok], right[ok]), np.maximum(left[ok], right[ok])
        pairs = distinct(left.astype(np.int64) << 32 | right)
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        columns = [
            np.concatenate([np.zeros(len(left), dtype=np.int64), np.ones(len(me), dtype=np.int64)]),
            np.concatenate([np.zeros(len(left), dtype=np.int64), sig[big].view(np.int64)]),
            np.concatenate([sets[left], sets[me]]),
            np.concatenate([sets[right], sets[me]]),
        ]
        return pa.table([pa.array(c) for c in columns], names=["kind", "sig", "a", "b"])

    return run


MEET_SCHEMA = "kind long, sig long, a long, b long"


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of class ids whose sets are similar, by their texts."""
    left = texts.select(F.col("class").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("b_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0))
        for batch in batches:
            keep = []
            firsts, seconds = _bytes(batch.column(2)), _bytes(batch.column(3))
            for a_text, b in zip(firsts, shingle_sets(seconds, k), strict=True):
                if a_text != last[0]:
                    last = (a_text, next(shingle_sets([a_text], k)))
                common = len(np.intersect1d(last[1], b, assume_unique=True))
                keep.append(common * 100 >= percent * (len(last[1]) + len(b) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(run, pairs.select("a", "b").schema)


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that their sizes and sketches do not rule out."""
    one = classes.select(F.col("class").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    two = classes.select(F.col("class").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)
            apart = np.array([sketches_apart(x, y) for x, y in both], dtype=np.int64)
            a_n, b_n = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = (apart * (100 + percent) <= (a_n + b_n) * (100 - percent)) & (np.minimum(a_n, b_n) * 100 >= np.maximum(a_n, b_n) * percent)
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "a_n", "a_sketch", "b_n", "b_sketch")
    return joined.mapInArrow(run, pairs.select("a", "b").schema)


def _class_texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``class, text`` of the classes in ``wanted``: the text of the class's first document."""
    # How many classes are wanted is not bounded, so they are not broadcast at any size.
    texts = docs.where("text is not null").select("doc_id", text_hash().alias("t"), "text")
    same = F.col("of.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("of.t") == F.col("t"))
    found = texts.join(wanted.hint("merge"), same).select("class", "text", "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [set_hash(s) == h for s, h in zip(shingle_sets(_bytes(batch.column(1)), k), own, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["class", "text"])

    return found.mapInArrow(run, found.select("class", "text").schema)


def _prefixes(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The rarest shingles of each class, one of which any similar class must have too."""
    schema = texts.select("class").schema.add("shingle", "long").add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in enumerate(shingle_sets(_bytes(batch.column(1)), k)):
                own = batch.column(0).take(pa.array(np.full(len(s), i, dtype=np.int64)))
                columns = [own, pa.array(s.view(np.int64)), pa.array(np.full(len(s), len(s), dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = staged(texts.select("class", "text").mapInArrow(run, schema), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    rarest = Window.partitionBy("class").orderBy("c", "shingle")
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = rows.join(often, "shingle", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("place", F.row_number().over(rarest))
    return ranked.where((F.col("place") <= needed) & (F.col("c") > 1)).select("class", "shingle", "n", "place")


def _across(members: DataFrame, key: str) -> DataFrame:
    """Pairs ``(a, b)`` of members with equal keys in different components."""
    other = members.select(key, F.col("id").alias("b"), F.col("part").alias("b_part"))
    pairs = members.select(key, F.col("id").alias("a"), "part").join(other, key)
    return pairs.where((F.col("a") < F.col("b")) & (F.col("part") != F.col("b_part"))).select("a", "b").distinct()


def _across_prefixes(members: DataFrame, percent: int) -> DataFrame:
    """Such pairs with a common rare shingle, if their sizes and its place in both still allow enough common shingles."""
    other = members.select("shingle", F.col("id").alias("b"), F.col("part").alias("b_part"), F.col("n").alias("m"), F.col("place").alias("at"))
    pairs = members.select("shingle", F.col("id").alias("a"), "part", "n", "place").join(other, "shingle")
    common = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    possible = F.lit(1) + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= common
    sizes = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return pairs.where((F.col("a") < F.col("b")) & (F.col("part") != F.col("b_part")) & sizes & possible).select("a", "b").distinct()


def _in_parts(rows: DataFrame, found: DataFrame, *ids: str) -> DataFrame:
    """Add to each id column its component so far, as ``<id>_part``."""
    grown = components(found)
    for c in ids:
        part = grown.select(F.col("id").alias(c), F.col("component_id").alias("__part"))
        rows = rows.join(part, c, "left").withColumn(f"{c}_part", F.coalesce("__part", c)).drop("__part")
    return rows


def links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, small_group: int = SMALL_GROUP, few_pairs: int = FEW_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Documents with their class (``doc_id, t, n, class, of``), and verified links that connect similar classes.

    Classes are numbered as they are written; ``of`` is a class's first document.
    """
    sets = staged(_sets(docs, k, percent), "sets")
    # A document without doc_id comes after all others.
    first_doc = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("of")
    each = sets.where("n > 0").groupBy("s1", "s2").agg(first_doc, *[F.first(c).alias(c) for c in ("n", "sketch", "spare")])
    classes = staged(each.withColumn("class", F.monotonically_increasing_id()), "classes")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rivals = staged(_rivals(docs, classes, k, percent, max(1, -(-total // (4 * SHARD_BYTES)))), "rivals")
    texts = staged(_class_texts(docs, rivals, k), "texts")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    met = staged(_signed(texts, k, percent, max(1, -(-total // SHARD_BYTES))).groupBy("shard").applyInArrow(_meet(percent, small_group), MEET_SCHEMA), "met")

    pairs = staged(_possible(met.where("kind = 0").select("a", "b").distinct(), classes, percent), "pairs")
    members = met.where("kind = 1").select("sig", F.col("a").alias("id"))
    spare = classes.select(F.col("class").alias("id"), "spare")
    busy = members.groupBy("id").agg(F.count("*").alias("c")).join(spare, "id").where("c > spare").select("id")
    members = staged(members.join(busy, "id"), "members")

    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = staged(_verified(first, texts, k, percent), "links")
    rest = _in_parts(pairs.join(first, ["a", "b"], "left_anti"), found, "a", "b").where("a_part <> b_part").select("a", "b")
    found = staged(found.union(_verified(rest, texts, k, percent)), "links")

    placed = _in_parts(members, found, "id").withColumnRenamed("id_part", "part")
    each = placed.groupBy("sig", "part").agg(F.count("*").alias("c")).groupBy("sig").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    crossing = each.where("c * c > cc").select("sig", ((F.col("c") * F.col("c") - F.col("cc")) / 2 <= few_pairs).alias("few"))
    open_ = staged(placed.join(crossing, "sig"), "open")
    more = _across(open_.where("few"), "sig")
    many = open_.where("not few").select(F.col("id").alias("class"), "part").distinct()
    if not many.isEmpty():
        prefix = _prefixes(texts.join(many.select("class").distinct(), "class"), k, percent)
        more = more.union(_across_prefixes(staged(prefix.join(many, "class").withColumnRenamed("class", "id"), "prefixes"), percent)).distinct()
    more = staged(_possible(more.join(pairs, ["a", "b"], "left_anti"), classes, percent), "more")
    found = staged(found.union(_verified(more, texts, k, percent)), "links")
    free(rivals, texts, met, pairs, members, open_, more)
    return sets.join(classes.select("s1", "s2", "class", "of"), ["s1", "s2"], "left").select("doc_id", "t", "n", "class", "of"), found


def grouped(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, **groups: int) -> DataFrame:
    """Every document with its number of shingles and the first document, by doc_id, of its component: ``doc_id, t, n, of``."""
    rows, found = links(docs, k, percent, **groups)
    grown = staged(components(found), "components")
    linked = rows.join(grown.withColumnRenamed("id", "class"), "class", "left")
    firsts = linked.where("component_id is not null").groupBy("component_id").agg(F.min("of").alias("first"))
    return linked.join(firsts, "component_id", "left").select("doc_id", "t", "n", F.coalesce("first", "of").alias("of"))


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, **groups: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    rows = grouped(docs, k, percent, **groups)
    # A document without shingles, which has no first one, is its own component.
    component = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("of.doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_copies(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, **groups: int) -> DataFrame:
    """``docs`` with one row of each component, the first by doc_id, text hash and the other columns; rows without words stay."""
    kept = grouped(docs, k, percent, **groups).where("of is not null").select("of").distinct()
    kept = kept.select(F.col("of.doc_id").alias("__id"), F.col("of.t").alias("__t"))
    # Columns may have any names, so a row travels as one struct.
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__doc"), text_hash().alias("__hash"))
    worded = F.coalesce(F.col("__row.text").rlike(WORD), F.lit(False))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__t"))
    # What has no order of its own, as maps do, is ordered by how it is written.
    own = [(F.col("__row")[f.name], f.dataType) for f in docs.schema if f.name not in ("doc_id", "text")]
    plain = [c.cast("string") if "map<" in kind.simpleString() or kind.simpleString() == "variant" else c for c, kind in own]
    order = Window.partitionBy("__doc", "__hash").orderBy(*plain, F.lit(0))
    firsts = rows.where(worded).join(kept, same, "left_semi").withColumn("__place", F.row_number().over(order)).where("__place = 1")
    return rows.where(~worded).select("__row").unionByName(firsts.select("__row")).select("__row.*")
