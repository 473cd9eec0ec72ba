"""Suffix-array dedup: bytes covered by strings that also start in an earlier document.

A window is a string of LENGTH bytes. Its anchor is the place of its GRAM-byte
substring with the least hash, so equal windows have equal anchors, and windows of
one anchor lie next to each other; together they form its context. Only anchors
that occur in two or more documents matter. Contexts are dealt to shards by
anchor, so all copies of a window meet in one shard, however long the passage.

A shard keeps distinct contexts with the smallest doc_id of each. An anchor with
one context needs no more. The others are joined into one text, whose suffix array
is built by induced sorting: suffixes are classified as smaller or larger than
the next, leftmost-smaller substrings are sorted and named, the sequence of names
is sorted by doubling what its ranks tell of (as divsufsort does, and few doublings
are enough, as contexts are short), and the rest of the array is induced from it in
linear time, one bucket after another. Permuted common prefixes with the suffix
before in the array are computed in text order; windows in a run with prefixes of
LENGTH or more are equal, and the smallest doc_id of the run decides for all of them.

Passages that very many documents share do not meet in one task. Anchors found in
several documents of one batch are known to be shared there, and only two of these
documents go on to the anchor's shard. Anchors of HOT documents or more are left
out of the shards: their contexts are aggregated by value, map side first, and
so are the windows of what is left. At most MOST_HOT anchors, the most frequent, take
this way, as their list is held by every task; that leaves any other anchor a
bounded share of the input.

Defined results: null texts count as empty; texts shorter than a window lose
nothing; matches never cross documents; a document's own repeats do not count,
nor do rows with the same doc_id, whose texts may differ and lose their own bytes
only; rows without a doc_id are before or after no other and lose nothing; an empty table gives an empty result; extra columns are
ignored. Texts are read whole; memory grows with the longest one.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, runs, staged
from .shingles import _BYTE, CHUNK, _Powers, distinct, mix

LENGTH = 50
GRAM = 24
SHARD_BYTES = 6 << 20
#: Bytes of texts that are worked on at once, if none is longer.
DEALT_BYTES = 2 << 20
#: Bytes of contexts that one suffix array holds, and contexts that a batch gathers, at most.
SORTED_BYTES = 3 << 19
HELD_CONTEXTS = 1 << 16
#: Anchors in so many documents are hot; so many of them at most; documents of one batch from which a task remembers an anchor as shared.
HOT = 4096
MOST_HOT = 100_000
TOLD = 4
MOST_TOLD = 1 << 17

#: Hits in a row, at most.
PACKED = 4

_PLACE_BITS = 30
MASK_BITS = LENGTH - GRAM + 1


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of the windows of each text, by groups of texts.

    Arrays of the text's place in the list, the anchor's hash, and the first and
    last window that it anchors (byte places in the text).
    """
    window = length - gram + 1
    for a, b in runs([len(t) for t in texts], CHUNK):
        raw = b"".join(texts[a:b])
        if len(raw) < length:
            continue
        sizes = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(raw, dtype=np.uint8)
        power, inverse = _Powers.upto(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        n = len(data) - gram + 1
        grams = mix((sums[gram:] - sums[:n]) * inverse[:n], 7)
        # The least of each window's grams, the leftmost of equals: hash above, place below.
        bits = np.uint64(max(_PLACE_BITS, int(n).bit_length()))
        least = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if rest := window - span:
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        owner = np.repeat(np.arange(b - a), sizes)[: len(place)]
        valid = np.arange(len(place)) + length <= (starts + sizes)[owner]
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        own, anchor = owner[at], place[at]
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])))
        last = np.append(first[1:], len(at)) - 1
        who = own[first]
        yield who + a, grams[anchor[first]], at[first] - starts[who], at[last] - starts[who]


#: Symbols of 16 bits are sorted by numpy in linear time.
_SYMBOL = np.int16


def suffix_array(text: np.ndarray, seps: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting of ``text``, whose zeros (at ``seps``) count as distinct, ascending symbols.

    The text ends with a zero. Each bucket is induced at once: its entries, in
    order, send the suffixes before them to the next free places of their buckets.
    """
    n = len(text)
    top = int(text.max(initial=0)) + 1
    # S: smaller than the next suffix. Equal neighbours follow the next change; zeros are S.
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = text[1:][change] > text[change]
    smaller = np.zeros(n, dtype=bool)
    if len(change):
        smaller[: change[-1] + 1] = np.repeat(rising, np.diff(change, prepend=-1))
    smaller[seps] = True
    leftmost = np.flatnonzero(smaller & np.append(False, ~smaller[:-1]) | (text == 0)).astype(np.int32)
    counts = np.bincount(text, minlength=top)
    ends = np.cumsum(counts)
    heads = ends - counts
    chars = np.flatnonzero(counts)
    # Of each suffix the symbol before it, if the suffix from there is larger or smaller than it, else -1.
    to_larger, to_smaller = np.full((2, n), -1, dtype=_SYMBOL)
    to_larger[1:][~smaller[:-1]] = text[:-1][~smaller[:-1]]
    induces = smaller[:-1] & (text[:-1] != 0)
    to_smaller[1:][induces] = text[:-1][induces]

    def induce(ordered: np.ndarray) -> np.ndarray:
        """The array from its leftmost-smaller suffixes in order."""
        sa = np.full(n, -1, dtype=np.int32)
        ordered = ordered[np.argsort(text[ordered], kind="stable")]
        by = text[ordered]
        tail = np.bincount(by, minlength=top)
        first = ends - tail
        sa[first[by] + np.arange(len(by)) - (np.cumsum(tail) - tail)[by]] = ordered
        larger_end = heads.copy()

        def send(entries: np.ndarray, to: np.ndarray, top_of: np.ndarray, up: bool) -> None:
            c = to[entries]
            here = c >= 0
            c = c[here]
            if not len(c):
                return
            order = c.argsort(kind="stable")
            before = entries[here][order] - 1
            c = c[order]
            rank = np.arange(len(c)) - c.searchsorted(c)
            if up:
                sa[top_of[c] + rank] = before
                top_of += np.bincount(c, minlength=top)
            else:
                sa[top_of[c] - 1 - rank] = before
                top_of -= np.bincount(c, minlength=top)

        for c in chars.tolist():
            done = heads[c]
            while done < larger_end[c]:
                upto = larger_end[c]
                send(sa[done:upto], to_larger, larger_end, True)
                done = upto
            send(sa[first[c] : ends[c]], to_larger, larger_end, True)
        smaller_top = ends.copy()
        smaller_top[0] = heads[0]  # zeros stay as they are
        for c in chars[::-1].tolist():
            done = ends[c]
            while c and done > smaller_top[c]:
                upto = smaller_top[c]
                send(sa[upto:done][::-1], to_smaller, smaller_top, False)
                done = upto
            # What is left in the bucket is larger, or zeros.
            send(sa[heads[c] : larger_end[c] if c else ends[c]][::-1], to_smaller, smaller_top, False)
        return sa

    first_pass = induce(leftmost)
    is_leftmost = np.zeros(n, dtype=bool)
    is_leftmost[leftmost] = True
    ordered = first_pass[is_leftmost[first_pass]]
    # Names: two leftmost-smaller substrings are one if all characters up to the next such place agree.
    following = np.append(leftmost[1:], n - 1)
    index = np.zeros(n, dtype=np.int32)
    index[leftmost] = np.arange(len(leftmost))
    size = following[index[ordered]] - ordered + 1
    differs = np.append(True, size[1:] != size[:-1])
    differs |= text[ordered] == 0
    live = np.flatnonzero(~differs)
    step = 0
    while len(live):
        x, y = text[ordered[live] + step], text[ordered[live - 1] + step]
        # A zero at the end of both is two different symbols.
        unequal = (x != y) | ((x == 0) & (y == 0))
        differs[live[unequal]] = True
        step += 1
        live = live[~unequal]
        live = live[step < size[live]]
    name = np.empty(len(leftmost), dtype=np.int32)
    name[index[ordered]] = np.cumsum(differs) - 1
    if differs.all():
        return induce(ordered)
    return induce(leftmost[_sorted_names(name)])


def _sorted_names(name: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of names in order; its last name is unique.

    Ranks tell of one name first, and of twice as many in each round (Larsson and
    Sadakane): those that are equal are sorted by the rank that far behind. A unique
    name settles its suffix, so only names that repeat go on.
    """
    counts = np.bincount(name)
    rank = (np.cumsum(counts) - counts)[name]
    live, step = np.flatnonzero(counts[name] > 1), 1
    while len(live):
        key = rank[live] << 32 | rank[live + step]
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        group = np.flatnonzero(np.append(True, key[1:] >> 32 != key[:-1] >> 32))
        sizes = np.diff(np.append(at, len(key)))
        new = (key[at] >> 32) + at - group[np.searchsorted(group, at, "right") - 1]
        rank[live] = np.repeat(new, sizes)
        live = live[np.repeat(sizes > 1, sizes)]
        step *= 2
    out = np.empty(len(name), dtype=np.int64)
    out[rank] = np.arange(len(name))
    return out


def equal_windows(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of the contexts, in text order: their context, and a number equal for equal windows."""
    raw = b"\0".join(contexts) + b"\0"
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.frombuffer(raw, dtype=np.uint8).astype(_SYMBOL) + 1
    seps = starts + sizes
    text[seps] = 0
    sa = suffix_array(text, seps)
    before = np.empty(len(text), dtype=np.int64)  # the suffix before it in the array
    before[sa] = np.append(-1, sa[:-1])
    # Permuted common prefixes, in text order: one less than that of the place before, at least.
    n_windows = np.maximum(sizes - length + 1, 0)
    first = np.cumsum(n_windows) - n_windows
    prefix = np.zeros(int(n_windows.sum()), dtype=np.int64)
    known = np.zeros(len(contexts), dtype=np.int64)
    live = np.arange(len(contexts))
    for offset in range(int(n_windows.max(initial=0))):
        live = live[n_windows[live] > offset]
        at = starts[live] + offset
        other = before[at]
        common = np.maximum(known[live] - 1, 0)
        going = np.flatnonzero(other >= 0)
        while len(going):
            x, y = text[at[going] + common[going]], text[other[going] + common[going]]
            going = going[(x == y) & (x != 0)]
            common[going] += 1
        known[live] = common
        prefix[first[live] + offset] = common
    owner = np.repeat(np.arange(len(contexts)), n_windows)
    place = starts[owner] + np.arange(len(owner)) - first[owner]
    number = np.full(len(text), -1, dtype=np.int64)
    number[place] = np.arange(len(owner))
    in_order = number[sa]
    in_order = in_order[in_order >= 0]
    # Suffixes between two equal windows would be equal windows too, so runs are not broken.
    label = np.empty(len(owner), dtype=np.int64)
    label[in_order] = np.cumsum(prefix[in_order] < length)
    return owner, label


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among sorted values."""
    at = np.searchsorted(values, x)
    at[at == len(values)] = 0
    return values[at] == x if len(values) else np.zeros(len(x), dtype=bool)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of each range, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _first_equal(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of strings that stand one after another: for each, the number of the first that is equal.

    Strings are compared byte by byte with the first of their hash; the few whose
    hash another string has by chance are looked up by their bytes.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = np.empty(len(sizes), dtype=np.uint64)
    parts = list(runs(sizes.tolist(), CHUNK))
    for a, b in parts:
        data = flat[starts[a] : ends[b - 1]]
        power, inverse = _Powers.upto(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        at = starts[a:b] - starts[a]
        h[a:b] = (sums[at + sizes[a:b]] - sums[at]) * inverse[at]
    _, least, which = np.unique(h, return_index=True, return_inverse=True)
    first = least[which]
    same = sizes[first] == sizes
    for a, b in parts:
        own = a + np.flatnonzero(same[a:b] & (first[a:b] != np.arange(a, b)))
        if len(own):
            n = sizes[own]
            equal = flat[_ranges(starts[own], n)] == flat[_ranges(starts[first[own]], n)]
            same[own] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    known: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        first[i] = known.setdefault(flat[starts[i] : ends[i]].tobytes(), i)
    return first


def _binary(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _released(x):
    """``x``, after freed memory went back to the system: workers live on, and many small contexts leave gaps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    return x


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    h = mix(h, 11)  # anchors are least hashes, so their upper bits are not spread evenly
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _pack(shard: int, *parts) -> pa.RecordBatch:
    arrays = [pa.array([p if isinstance(p, bytes) else p.tobytes()], pa.binary()) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *arrays], names=["shard", *[f"p{i}" for i in range(len(parts))]])


def _joined(table: pa.Table, i: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(f"p{i}").to_pylist()), dtype=kind)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1]))
    for a, b in zip(at, [*at[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


class _Told:
    """Anchors that a task knows to be shared, and in how many documents it has seen them since."""

    def __init__(self) -> None:
        self.h, self.docs = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def seen(self, h: np.ndarray, docs: np.ndarray) -> np.ndarray:
        known = _among(h, self.h)
        self.docs[np.searchsorted(self.h, h[known])] += docs[known]
        return known

    def add(self, h: np.ndarray) -> None:
        h = h[: max(0, MOST_TOLD - len(self.h))]
        h = np.concatenate([self.h, h])
        order = np.argsort(h)
        self.h, self.docs = h[order], np.concatenate([self.docs, np.zeros(len(h) - len(self.docs), dtype=np.int64)])[order]


def _by_doc(doc: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct documents, and for each array its values by document as bytes."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[at], [[x.tobytes() for x in np.split(v[order], at[1:])] if len(at) else [] for v in values]


def shared_anchors(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, shared, anchor, often``: the low halves of anchor hashes that other documents have too, several packed or one.

    Rows with ``often`` are of a hot anchor, and of about how many documents it is in.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Told()
        none = np.zeros(0, dtype=np.uint32)
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            texts = _binary(batch.column(1))
            for a, b in runs([len(t) for t in texts], DEALT_BYTES):
                found = [f[:2] for f in anchors(texts[a:b])]
                if not found:
                    continue
                who, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                known_ids, number = np.unique(ids[a:b], return_inverse=True)
                doc = number[who]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
                h, doc = h[new], doc[new]
                at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                times = np.diff(np.append(at, len(h)))
                known = told.seen(h[at], times)
                here = np.repeat((times > 1) | known, times)
                goes = (np.arange(len(h)) - np.repeat(at, times) < 2) & ~np.repeat(known, times)
                told.add(h[at][(times >= TOLD) & ~known])
                # Shared within the batch, or known before: what these documents have is settled.
                if here.any():
                    own, (blobs,) = _by_doc(doc[here], h[here].astype(np.uint32))
                    sizes = np.array([len(x) // 4 for x in blobs], dtype=np.int32)
                    yield _pack(-1 - int(known_ids[0]) % shards, b"".join(blobs), sizes, known_ids[own], none, none)
                more = (times > 2) & ~known
                extra_h, extra = h[at][more], (times[more] - 2).astype(np.int32)
                h, doc = h[goes], doc[goes]
                also = dict(_by_shard(_shard(extra_h, shards)))
                for shard, own in _by_shard(_shard(h, shards)):
                    own = own[np.argsort(doc[own], kind="stable")]
                    docs_here, times = np.unique(doc[own], return_counts=True)
                    extras = also.get(shard, none)
                    yield _pack(shard, h[own].astype(np.uint32), times.astype(np.int32), known_ids[docs_here], extra_h[extras].astype(np.uint32), extra[extras])
        for shard, own in _by_shard(_shard(told.h, shards)):
            yield _pack(shard, none, none, none, told.h[own].astype(np.uint32), told.docs[own].astype(np.int32))

    def meet(table: pa.Table) -> pa.Table:
        h, times, ids = _joined(table, 0, np.uint32), _joined(table, 1, np.int32), _joined(table, 2, np.int64)
        hot = hot_docs = np.zeros(0, dtype=np.int64)
        if table.column("shard")[0].as_py() < 0:
            edges = np.cumsum(times)[:-1]
            values, blobs = ids, [x.tobytes() for x in np.split(h, edges)] if len(times) else []
        else:
            values = distinct(ids)
            doc = np.repeat(np.searchsorted(values, ids), times)
            pairs = distinct(h.astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64))
            h, doc = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            same = np.append(False, h[1:] == h[:-1]) if len(h) else np.zeros(0, dtype=bool)
            same |= np.append(same[1:], False) if len(h) else same
            counted, which = np.unique(np.concatenate([h, _joined(table, 3, np.uint32)]), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate([np.ones(len(h)), _joined(table, 4, np.int32)]), minlength=len(counted))
            hot, hot_docs = counted[total >= HOT], total[total >= HOT].astype(np.int64)
            values, h, blobs = values[doc[same]], h[same], None
        n = len(values)
        none = pa.nulls(len(hot), pa.int64())
        columns = [
            pa.concat_arrays([pa.array(values, pa.int64()), none]),
            pa.concat_arrays([pa.array(blobs, pa.binary()) if blobs is not None else pa.nulls(n, pa.binary()), pa.nulls(len(hot), pa.binary())]),
            pa.concat_arrays([pa.nulls(n, pa.int32()) if blobs is not None else pa.array(h.view(np.int32)), pa.array(hot.astype(np.uint32).view(np.int32))]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(hot_docs, pa.int64())]),
        ]
        return _released(pa.table(columns, names=["doc_id", "shared", "anchor", "often"]))

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "shard int, " + ", ".join(f"p{i} binary" for i in range(5)))
    return dealt.groupBy("shard").applyInArrow(meet, "doc_id long, shared binary, anchor int, often long")


def hot_anchors(shared: DataFrame) -> np.ndarray:
    """The low halves of the hottest anchors' hashes, sorted: MOST_HOT rows at most reach the driver."""
    rows = shared.where("often is not null").orderBy(F.col("often").desc(), "anchor").limit(MOST_HOT).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], dtype=np.int32).view(np.uint32))


def _with_anchors(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``doc_id, text, shared, anchors, tag``: documents with their lists of shared anchors, and a hash that tells texts of one doc_id apart."""
    lists = shared.where("doc_id is not null").groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list("shared").alias("shared"), F.collect_list("anchor").alias("anchors"))
    return docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("__doc")).select("doc_id", "text", "shared", "anchors", F.xxhash64("text").alias("tag"))


def _wanted(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Each document's shared anchors, sorted."""
    both = zip(batch.column(2).to_pylist(), batch.column(3), strict=True)
    return [np.sort(np.concatenate([np.frombuffer(b"".join(packed), dtype=np.uint32), single.values.to_numpy().view(np.uint32)])) for packed, single in both]


def earlier_windows(docs: DataFrame, shared: DataFrame, hot: np.ndarray, shards: int, length: int = LENGTH) -> DataFrame:
    """``doc_id, tag, hits, hit``: windows that start in an earlier document too, but those of hot anchors.

    A hit is a place in the text, and below it MASK_BITS bits; bit i is the window i bytes after the place. Several are packed.
    """

    def deal_some(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], wanted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.zeros(0, dtype=np.uint64), *[np.uint64(i << 32) | w.astype(np.uint64) for i, w in enumerate(wanted)]])
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            flat, sizes, hashes, who, start = (np.concatenate([x[i] for x in held]) for i in range(5))
            held.clear()
            # Distinct contexts, those of one shard together.
            used, ctx = np.unique(_first_equal(flat, sizes), return_inverse=True)
            shard = _shard(hashes[used], shards)
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(used), dtype=np.int64)
            place[order] = np.arange(len(used))
            ctx = place[ctx]
            used, shard = used[order], shard[order]
            flat = flat[_ranges((np.cumsum(sizes) - sizes)[used], sizes[used])]
            sizes, hashes = sizes[used], hashes[used]
            ends = np.append(0, np.cumsum(sizes))
            by = np.argsort(shard[ctx], kind="stable")
            ctx, who, start = ctx[by], who[by], start[by]
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
            rows = np.searchsorted(shard[ctx], shard[cuts[:-1]])
            for a, b, p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), rows.tolist(), [*rows[1:].tolist(), len(ctx)], strict=True):
                own = who[p:q]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                times = np.diff(np.append(at, len(own)))
                docs_here = own[at]
                yield _pack(
                    int(shard[a]), flat[ends[a] : ends[b]], sizes[a:b].astype(np.uint8), hashes[a:b], np.array([b - a], dtype=np.int64),
                    (ctx[p:q] - a).astype(np.int32), start[p:q].astype(np.int64), times.astype(np.int32), ids[docs_here], tags[docs_here],
                )
            _released(None)

        for who, h, lo, hi in anchors(texts):
            short = h.astype(np.uint32)
            keep = np.flatnonzero(_among(who.astype(np.uint64) << np.uint64(32) | short, keys) & ~_among(short, hot))
            if not len(keep):
                continue
            who, h, lo, hi = who[keep], h[keep], lo[keep], hi[keep]
            some = texts[who[0] : who[-1] + 1]
            begin = np.cumsum([0, *[len(t) for t in some]])
            size = hi - lo + length
            data = np.frombuffer(b"".join(some), dtype=np.uint8)
            held.append((data[_ranges(begin[who - who[0]] + lo, size)], size, h, who, lo))
            if sum(len(x[1]) for x in held) > HELD_CONTEXTS:
                yield from packed()
        if held:
            yield from packed()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            yield from deal_some(ids, batch.column(4).to_numpy(), _binary(batch.column(1)), _wanted(batch))

    def meet(table: pa.Table) -> pa.Table:
        flat, sizes, h = _joined(table, 0, np.uint8), _joined(table, 1, np.uint8).astype(np.int64), _joined(table, 2, np.uint64)
        per_row, ctx = _joined(table, 3, np.int64), _joined(table, 4, np.int32).copy()
        start, times, ids, tags = _joined(table, 5, np.int64), _joined(table, 6, np.int32), _joined(table, 7, np.int64), _joined(table, 8, np.int64)
        ctx += np.repeat(np.cumsum(per_row) - per_row, [len(x) // 4 for x in table.column("p4").to_pylist()]).astype(np.int32)
        del table
        doc, tag = np.repeat(ids, times), np.repeat(tags, times)
        used, same = np.unique(_first_equal(flat, sizes), return_inverse=True)
        offsets, sizes, anchor = (np.cumsum(sizes) - sizes)[used], sizes[used], h[used]
        ctx = same[ctx]
        earliest = np.full(len(used), np.iinfo(np.int64).max)
        np.minimum.at(earliest, ctx, doc)
        n_windows = sizes - length + 1
        # Earliest document of each window: its context's, unless another context of the anchor has it earlier.
        first = np.cumsum(n_windows) - n_windows
        by_window = np.repeat(earliest, n_windows)
        _, row, counts = np.unique(anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[row] > 1)
        several = several[np.argsort(row[several], kind="stable")]
        group = np.flatnonzero(np.append(True, row[several][1:] != row[several][:-1])) if len(several) else several
        edges = np.append(group, len(several))
        bulk = np.add.reduceat(n_windows[several] + length, group).tolist() if len(several) else []
        # All contexts of an anchor are sorted together.
        for a, b in runs(bulk, SORTED_BYTES):
            chosen = several[edges[a] : edges[b]]
            owner, label = equal_windows([flat[o : o + n].tobytes() for o, n in zip(offsets[chosen].tolist(), sizes[chosen].tolist(), strict=True)], length)
            least = np.full(int(label.max(initial=0)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, label, earliest[chosen][owner])
            sizes_here = n_windows[chosen]
            within = np.arange(len(owner)) - (np.cumsum(sizes_here) - sizes_here)[owner]
            by_window[first[chosen][owner] + within] = least[label]
        mask = np.zeros(len(ctx), dtype=np.uint32)
        for i in range(int(n_windows.max(initial=0))):
            has = np.flatnonzero(n_windows[ctx] > i)
            earlier = by_window[first[ctx[has]] + i] < doc[has]
            mask[has] |= earlier.astype(np.uint32) << np.uint32(i)
        hit = np.flatnonzero(mask)
        # Few hits a row, so that rows grow as hits do, from however many shards those of a text come.
        hit = hit[np.lexsort((tag[hit], doc[hit]))]
        doc, tag, hits = doc[hit], tag[hit], start[hit] << MASK_BITS | mask[hit].astype(np.int64)
        at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))) if len(hit) else np.zeros(0, dtype=np.int64)
        within = np.arange(len(hit)) - np.repeat(at, np.diff(np.append(at, len(hit))))
        at = np.flatnonzero(within % PACKED == 0)
        packs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(hits)).astype(np.int32) * np.int32(8)), pa.py_buffer(hits)])
        return _released(pa.table([pa.array(doc[at], pa.int64()), pa.array(tag[at], pa.int64()), packs, pa.nulls(len(at), pa.int64())], names=["doc_id", "tag", "hits", "hit"]))

    schema = "shard int, " + ", ".join(f"p{i} binary" for i in range(9))
    return _with_anchors(docs, shared).mapInArrow(deal, schema).groupBy("shard").applyInArrow(meet, WINDOWS)


WINDOWS = "doc_id long, tag long, hits binary, hit long"


def hot_windows(docs: DataFrame, shared: DataFrame, hot: np.ndarray, length: int = LENGTH) -> DataFrame:
    """Like ``earlier_windows``, for hot anchors: contexts and then windows are aggregated by value."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [w[_among(w, hot)] for w in _wanted(batch)]
            some = [i for i, w in enumerate(wanted) if len(w)]
            ids, texts, tags = batch.column(0).to_pylist(), _binary(batch.column(1)), batch.column(4).to_pylist()
            for who, h, lo, hi in anchors([texts[i] for i in some]):
                short = h.astype(np.uint32)
                keep = np.concatenate([np.zeros(0, dtype=np.int64), *[at[_among(short[at], wanted[some[w]])] for w in np.unique(who).tolist() for at in [np.flatnonzero(who == w)]]])
                own = [some[w] for w in who[keep].tolist()]
                places = list(zip(own, lo[keep].tolist(), hi[keep].tolist(), strict=True))
                for a in range(0, len(places), 4096):
                    rows = places[a : a + 4096]
                    columns = [pa.array([texts[i][p : q + length] for i, p, q in rows], pa.binary()), pa.array([ids[i] for i, _, _ in rows], pa.int64()), pa.array([tags[i] for i, _, _ in rows], pa.int64()), pa.array([p for _, p, _ in rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["context", "doc_id", "tag", "start"])

    places = staged(_with_anchors(docs, shared).mapInArrow(cut, "context binary, doc_id long, tag long, start long"), "hot")
    contexts = places.groupBy("context").agg(F.min("doc_id").alias("first"))
    offsets = F.sequence(F.lit(0), F.octet_length("context") - length)
    windows = contexts.select("context", "first", F.explode(offsets).alias("i"))
    windows = windows.withColumn("window", F.substring("context", F.col("i") + 1, F.lit(length)))
    earliest = windows.groupBy("window").agg(F.min("first").alias("earliest"))
    # A window is in few contexts or, at the edge of a passage, a context has few windows of others; both joins may be split.
    each = windows.join(earliest, "window").groupBy("context").agg(F.collect_list(F.struct("i", "earliest")).alias("windows"))
    bits = F.aggregate("windows", F.lit(0).cast("long"), lambda m, w: m + F.when(w["earliest"] < F.col("doc_id"), F.pow(F.lit(2.0), w["i"]).cast("long")).otherwise(F.lit(0).cast("long")))
    found = places.join(each, "context").select("doc_id", "tag", "start", bits.alias("mask")).where("mask <> 0")
    return found.select("doc_id", "tag", F.lit(None).cast("binary").alias("hits"), (F.col("start") * (1 << MASK_BITS) + F.col("mask")).alias("hit"))


def covered(n: int, hits: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of n bytes lie in a window that is hit."""
    bits = np.arange(MASK_BITS)
    row, offset = np.nonzero(hits[:, None] >> bits & 1)
    at = (hits >> MASK_BITS)[row] + offset
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def dedup(docs: DataFrame, length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every document; ``kept`` holds the bytes left, if wanted."""
    if not GRAM <= length <= LENGTH:
        raise ValueError(f"windows have {GRAM} to {LENGTH} bytes")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    texts = docs.where("text is not null")
    # Anchors are short, so four times as many share a shard as contexts do.
    shared = staged(shared_anchors(texts.where("doc_id is not null"), -(-shards // 4)), "shared")
    hot = hot_anchors(shared)
    found = staged(earlier_windows(texts, shared, hot, shards, length), "windows")
    if len(hot):
        found = found.unionByName(staged(hot_windows(texts, shared, hot, length), "windows"))
    free(shared)
    # Different texts may share a doc_id; each has its own hits.
    lists = found.groupBy("doc_id", "tag").agg(F.collect_list("hits").alias("hits"), F.collect_list("hit").alias("hit"))
    joined = docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).join(lists, ["doc_id", "tag"], "left").select("doc_id", "text", "hits", "hit")
    schema = docs.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary")):
        schema.add(name, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, packs, single in zip(_binary(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
                removed = spans = 0
                kept = text
                if packs is not None:
                    gone = covered(len(text), np.concatenate([np.frombuffer(b"".join(packs), dtype=np.int64), single.values.to_numpy()]), length)
                    removed = int(np.count_nonzero(gone))
                    spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))
                    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return staged(joined.mapInArrow(cut, schema), "kept")
