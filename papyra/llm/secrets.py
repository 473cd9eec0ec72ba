"""Secrets in texts: fixed patterns, and a character network for what they miss.

Patterns find values assigned to telling names, access keys and long hexadecimal
numbers. Every run of eight or more key characters that holds a letter and a digit
is a candidate besides; a convolutional network over the characters of the
candidate and its surroundings, written in numpy, judges those that no pattern
covers. It learns from the corpus: candidates within a pattern's finding are
labelled secret, others not. Findings also serve with their characters drawn anew
and in other surroundings, and plain words of the corpus joined with numbers serve
as harmless ones, so that shape counts and not one alphabet or one name. Scores are
calibrated on candidates held out, and for each alphabet the threshold is the
highest that keeps ``LEAST_RECALL`` of the findings held out.

Every distinct candidate counts: they are dealt by hash to buckets of bounded size,
rare findings to several so that each bucket has some. In each round all buckets learn
from the same weights, a task each, and the mean of what they come to, by the windows
learnt from, starts the next (iterative parameter mixing, McDonald et al. 2010). One in
``HELD_OUT``, by hash, is held out; the scores of all of these are counted in steps of
1/``STEPS`` of log odds, and calibration and thresholds come from these counts. Means are
sums of whole numbers, so they are the same in whatever order buckets come.

Defined results: a null text counts as empty; positions are code points; texts are
read whole, however long; rows that repeat a doc_id or a text each get their own
result and equal texts equal ones; a corpus without a finding has no model, and
only patterns count; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import spread
from .common import free, staged

#: Kinds of spans in the order they are listed; the last is the network's.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: One of these is in every text that the pattern finds something in.
NAMES = ("passw", "secret", "token", "api")
LEAST_VALUE = 8
#: Runs of these characters are maximal, so a least length finds the same as dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{8,}={0,2}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

#: Characters before and after a candidate that the network sees.
LEFT, RIGHT = 24, 12
#: Distinct candidates of a bucket, and their characters, on average; findings and others in it, if there are as many.
BUCKET, BUCKET_CHARS, LEAST_EACH = 2000, 1 << 21, 200
#: Windows drawn of each label in a bucket, at least, and the longest value drawn.
LEAST_DRAWN, LONGEST_DRAWN = 800, 512
#: Rounds, and passes over a bucket in each.
ROUNDS, PASSES = 5, 2
SEED = 7
LEAST_RECALL = 0.95
HELD_OUT = 4
#: Findings of an alphabet held out, if its threshold is to come from them alone.
LEAST_OWN = 20

_DIM, _FILTERS, _WIDTH, _HIDDEN = 8, 24, 5, 16
_SLICE = 1 << 16
#: Steps in one of log odds, which are counted from -_MOST to _MOST; steps in one of a weight, when means are taken.
STEPS, _MOST = 256, 32
_WEIGHT_STEPS = float(1 << 24)
_CODES = 97  # printable characters, others, padding
_PAD = 3 * _CODES


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``start, kind, end`` of the patterns' findings in order, and where the secret value begins."""
    low = text.lower()
    named = any(name in low for name in NAMES)
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE] if named else []
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        found += [(m.start(), kind, m.end(), m.start()) for m in pattern.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, bool]]:
    """``start, end`` of what may be a secret, and whether a pattern says that it is.

    The values of findings, once where patterns overlap, and the runs that touch none.
    """
    out: list[tuple[int, int, bool]] = []
    covered: list[tuple[int, int]] = []
    for start, _, end, value in base:
        if not covered or value >= covered[-1][1]:
            out.append((value, end, True))
        if covered and start < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(end, covered[-1][1]))
        else:
            covered.append((start, end))
    at = 0
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if run.isalpha() or not _DIGIT.search(run) or not _LETTER.search(run):
            continue
        start = m.start() + len(run) - len(run.lstrip(".-"))
        end = m.end() - (len(run) - len(run.rstrip(".-")))
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if end - start >= LEAST_VALUE and (at == len(covered) or covered[at][0] >= end):
            out.append((start, end, False))
    return sorted(out)


def shape(value: str) -> int:
    """The alphabet of a value: hexadecimal, capitals and digits, small letters and digits, mixed."""
    for i, pattern in enumerate((r"[0-9a-fA-F]+", r"[A-Z0-9]+", r"[a-z0-9]+")):
        if re.fullmatch(pattern, value):
            return i
    return 3


def _encoded(windows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """One number a character, by character and part of the window, and where each window begins; padding lies between."""
    parts, starts, at = [np.full(_WIDTH // 2, _PAD, dtype=np.int32)], [], _WIDTH // 2
    for window in windows:
        starts.append(at)
        for region, part in enumerate(window):
            codes = np.frombuffer(part.encode("latin-1", "replace"), dtype=np.uint8).astype(np.int32)
            parts.append(np.where((codes >= 32) & (codes < 127), codes - 32, _CODES - 2) + region * _CODES)
            at += len(part)
        parts.append(np.full(_WIDTH // 2, _PAD, dtype=np.int32))
        at += _WIDTH // 2
    return np.concatenate(parts), np.array([*starts, at], dtype=np.int64)


def _slices(starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Slices of encoded windows of bounded size, and the first and behind the last window in each."""
    end = int(starts[-1]) - _WIDTH // 2
    for a in range(int(starts[0]), end, _SLICE):
        b = min(a + _SLICE, end)
        yield a, b, int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts[:-1], b, "left"))


@dataclass
class Network:
    """Embedding, one convolution, largest and mean response of each filter, two dense layers."""

    weights: list[np.ndarray]
    #: Slope and offset of the calibrated log odds, and thresholds by shape.
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (1.0,) * 4

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        sizes = [(_PAD + 1, _DIM), (_WIDTH * _DIM, _FILTERS), (_FILTERS,), (2 * _FILTERS, _HIDDEN), (_HIDDEN,), (_HIDDEN, 1), (1,)]
        return cls([(rng.normal(0, (2 / s[0]) ** 0.5 if i else 0.5, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for i, s in enumerate(sizes)])

    def _responses(self, codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        half = _WIDTH // 2
        embedded = self.weights[0][codes[a - half : b + half]]
        seen = np.lib.stride_tricks.sliding_window_view(embedded, _WIDTH, axis=0).transpose(0, 2, 1).reshape(b - a, -1)
        return seen, np.maximum(seen @ self.weights[1] + self.weights[2], 0)

    def logits(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """Log odds of each window; characters pass in slices of bounded size."""
        if not windows:
            return np.zeros(0, dtype=np.float32)
        return self._head(self._pooled(*_encoded(windows))[0])[1]

    def _pooled(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and mean response of each filter by window, and the windows' sizes."""
        n, kind = len(starts) - 1, self.weights[2].dtype
        sizes = (starts[1:] - _WIDTH // 2 - starts[:-1]).astype(kind)
        most, total = np.zeros((n, _FILTERS), dtype=kind), np.zeros((n, _FILTERS), dtype=kind)
        for a, b, first, last in _slices(starts):
            _, out = self._responses(codes, a, b)
            out[codes[a:b] == _PAD] = 0
            cuts = np.maximum(starts[first:last], a) - a
            most[first:last] = np.maximum(most[first:last], np.maximum.reduceat(out, cuts))
            total[first:last] += np.add.reduceat(out, cuts)
        return np.hstack([most, total / sizes[:, None]]), sizes

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.weights[3] + self.weights[4], 0)
        return hidden, (hidden @ self.weights[5] + self.weights[6])[:, 0]

    def gradients(self, windows: list[tuple[str, str, str]], labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss."""
        codes, starts = _encoded(windows)
        pooled, sizes = self._pooled(codes, starts)
        most = pooled[:, :_FILTERS]
        hidden, logits = self._head(pooled)
        d = ((1 / (1 + np.exp(-logits)) - labels) / len(windows)).astype(logits.dtype)[:, None]
        g5, g6 = hidden.T @ d, d.sum(0)
        d = (d @ self.weights[5].T) * (hidden > 0)
        g3, g4 = pooled.T @ d, d.sum(0)
        d = d @ self.weights[3].T
        g0, g1, g2 = (np.zeros_like(w) for w in self.weights[:3])
        # The same slices as before, so that the largest responses are met again.
        for a, b, first, last in _slices(starts):
            seen, out = self._responses(codes, a, b)
            real = codes[a:b] != _PAD
            out[~real] = 0
            owner = first + np.repeat(np.arange(last - first), np.diff(np.append(np.maximum(starts[first:last], a), b)))
            spread = np.where(out == most[owner], d[owner, :_FILTERS], 0) + (d[:, _FILTERS:] / sizes[:, None])[owner]
            spread *= (out > 0) & real[:, None]
            g1 += seen.T @ spread
            g2 += spread.sum(0)
            back = (spread @ self.weights[1].T).reshape(b - a, _WIDTH, _DIM)
            for k in range(_WIDTH):
                np.add.at(g0, codes[a + k - _WIDTH // 2 : b + k - _WIDTH // 2], back[:, k])
        return [g0, g1, g2, g3, g4, g5, g6]

    def probabilities(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        slope, offset = self.scale
        return 1 / (1 + np.exp(-(slope * self.logits(windows).astype(np.float64) + offset)))

    def secret(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """Whether each window's candidate reaches its alphabet's threshold."""
        least = np.array([self.thresholds[shape(w[1])] for w in windows])
        return self.probabilities(windows) >= least


#: Alphabets that findings are drawn anew from.
_ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"]
_ALPHABETS.append("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_ALPHABETS += [_ALPHABETS[-1] + "+/", _ALPHABETS[-1] + "-_"]


def varied(found: list[tuple[str, str, str]], harmless: list[tuple[str, str, str]], rng: np.random.Generator) -> tuple[list, list]:
    """More windows of either label: drawn values in any surroundings; words joined with numbers."""
    around = found + harmless
    words = sorted({w for left, _, right in around for w in re.findall(r"[A-Za-z]{3,}", left + " " + right)}) or ["word"]
    pick = lambda some: some[rng.integers(len(some))]
    plain = [w for w in around if not ASSIGN.search("".join(w))] or [(f" {pick(words)} ", "", f" {pick(words)}")]
    secret, not_secret = [], []
    # Few findings are varied more often, so that the network has as much to learn from, and as much as of others.
    for left, value, right in found * -(-max(LEAST_DRAWN, len(harmless)) // len(found)) if found else []:
        long = min(len(value), LONGEST_DRAWN)
        n = int(rng.integers(max(16, long // 2), max(48, long) + 1))
        drawn = "".join(rng.choice(list(pick(_ALPHABETS)), n))
        if rng.random() < 0.25:
            drawn = pick(words)[:4].lower() + "_" + drawn
        if rng.random() < 0.6:
            left, _, right = pick(plain)
        secret.append((left, drawn, right))
        number = str(rng.integers(10 ** int(rng.integers(1, 9))))
        a, b = pick(words), pick(words)
        joined = pick([
            a + b + number, f"{a}-{number}-{b}", f"{a}_{b}_{number}", f"{a}/{b}{number}.html", f"{a}.{number}", f"www.{b}{number}.{a}.com", number + a + b,
            f"{a.capitalize()}{b.capitalize()}{number}", f"{a}.{b}.{a}{number}", f"{1900 + rng.integers(200)}-{rng.integers(10, 13)}-{rng.integers(10, 32)}T{rng.integers(10, 24)}",
        ])
        left, _, right = pick(plain)
        not_secret.append((left, joined.ljust(LEAST_VALUE, "0"), right))
    return secret, not_secret


@dataclass
class Examples:
    """Windows of a bucket with their labels, real and drawn; which are held out, and which of these count here."""

    windows: list[tuple[str, str, str]]
    labels: np.ndarray
    held: np.ndarray
    counted: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[bool, tuple[str, str, str], bool]], bucket: int) -> Examples:
        """From rows of a label, a window, and whether it counts in this bucket."""
        found, harmless = ([w for label, w, _ in rows if label == kind] for kind in (True, False))
        secret, not_secret = varied(found, harmless, np.random.default_rng([SEED, bucket]))
        real = [(w, label, zlib.crc32("\0".join(w).encode()) % HELD_OUT == 0, own) for label, w, own in rows]
        drawn = [(w, label, i % HELD_OUT == 0, True) for label, some in ((True, secret), (False, not_secret)) for i, w in enumerate(some)]
        windows, labels, held, counted = zip(*real, *drawn, strict=True)
        return cls(list(windows), np.array(labels, dtype=np.float64), np.array(held), np.array(held) & np.array(counted))

    def learnt(self, weights: list[np.ndarray], seed: list[int], batch: int = 64, rate: float = 4e-3) -> tuple[list[np.ndarray], int]:
        """What ``PASSES`` of Adam make of the weights, and of how many windows."""
        net, rng = Network([w.copy() for w in weights]), np.random.default_rng(seed)
        learn = np.flatnonzero(~self.held)
        first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
        step = 0
        for _ in range(PASSES):
            order = rng.permutation(learn)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                step += 1
                for i, g in enumerate(net.gradients([self.windows[j] for j in some], self.labels[some])):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    net.weights[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return net.weights, len(learn)

    def tally(self, net: Network) -> list[tuple[int, int, int, int]]:
        """``label, shape, step, n`` of the windows held out: how many have log odds from that step on."""
        own = np.flatnonzero(self.counted)
        windows = [self.windows[i] for i in own]
        steps = np.floor(np.clip(net.logits(windows), -_MOST, _MOST) * STEPS).astype(np.int64)
        return [(*k, n) for k, n in sorted(Counter(zip(self.labels[own].astype(int).tolist(), (shape(w[1]) for w in windows), steps.tolist(), strict=True)).items())]


def _summed(weights: list[np.ndarray], n: int) -> np.ndarray:
    """Weights times n in whole steps."""
    return np.round(np.concatenate([w.ravel() for w in weights]).astype(np.float64) * _WEIGHT_STEPS).astype(np.int64) * n


def _mean(total: np.ndarray, n: int, like: list[np.ndarray]) -> list[np.ndarray]:
    flat = (total / (n * _WEIGHT_STEPS)).astype(np.float32)
    ends = np.cumsum([w.size for w in like])
    return [x.reshape(w.shape) for x, w in zip(np.split(flat, ends[:-1]), like, strict=True)]


def settled(net: Network, tally: list[tuple[int, int, int, int]]) -> Network:
    """The network, calibrated, with its thresholds."""
    labels, kinds, steps, n = (np.array(x) for x in zip(*sorted(tally), strict=True))
    logits = steps / STEPS
    net.scale = _calibrated(logits, labels, n)
    scores = 1 / (1 + np.exp(-(net.scale[0] * logits + net.scale[1])))
    every = labels == 1
    net.thresholds = tuple(_threshold((scores[own], n[own]) if n[own := every & (kinds == k)].sum() >= LEAST_OWN else (scores[every], n[every])) for k in range(4))
    return net


def fit(found: list[tuple[str, str, str]], harmless: list[tuple[str, str, str]]) -> Network | None:
    """A network from labelled windows of one bucket; none without findings."""
    if not found:
        return None
    net, bucket = Network.fresh(np.random.default_rng(SEED)), Examples.of([(True, w, True) for w in found] + [(False, w, True) for w in harmless], 0)
    for i in range(ROUNDS):
        weights, n = bucket.learnt(net.weights, [SEED, 0, i])
        net.weights = _mean(_summed(weights, n), n, weights)
    return settled(net, bucket.tally(net))


def _calibrated(logits: np.ndarray, labels: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset by Newton's method on the logistic loss of n windows each; smoothed targets keep them finite (Platt 1999)."""
    n1, n0 = n[labels == 1].sum(), n[labels == 0].sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (n * (p - target))), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def _threshold(scored: tuple[np.ndarray, np.ndarray]) -> float:
    """The highest score that keeps the recall, one half at least."""
    scores, n = scored
    if not len(scores):
        return 1.0
    order = np.argsort(scores)
    upto = np.cumsum(n[order])
    return float(max(0.5, scores[order][np.searchsorted(upto, int(upto[-1] * (1 - LEAST_RECALL)), "right")]))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, found`` of every document: findings of the patterns, and candidates in their surroundings."""
    schema = docs.select("doc_id").schema
    schema.add("base", T.DataType.fromDDL("array<struct<start: bigint, kind: int, end: bigint>>"))
    schema.add("found", T.DataType.fromDDL("array<struct<start: bigint, end: bigint, secret: boolean, left: string, value: string, right: string>>"))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in spans])
                found.append([
                    {"start": a, "end": b, "secret": secret, "left": text[max(0, a - LEFT) : a], "value": text[a:b], "right": text[b : b + RIGHT]}
                    for a, b, secret in candidates(text, spans)
                ])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(base, arrow.field(1).type), pa.array(found, arrow.field(2).type)], schema=arrow)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def dealt(found: DataFrame) -> DataFrame | None:
    """``bucket, rows``: all distinct candidates by bucket; none without findings."""
    each = staged(found.select(F.explode("found").alias("f")).select("f.secret", "f.left", "f.value", "f.right").distinct(), "windows")
    size = F.sum(F.length("left") + F.length("value") + F.length("right"))
    told = {r["secret"]: (r["n"], r["chars"]) for r in each.groupBy("secret").agg(F.count("*").alias("n"), size.alias("chars")).collect()}
    if True not in told:
        free(each)
        return None
    buckets = max(-(-sum(n for n, _ in told.values()) // BUCKET), -(-sum(c for _, c in told.values()) // BUCKET_CHARS))
    copies = {k: min(buckets, max(1, -(-LEAST_EACH * buckets // n))) for k, (n, _) in told.items()}
    times = F.when(F.col("secret"), copies[True]).otherwise(copies.get(False, 1))
    rows = each.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    rows = rows.withColumn("bucket", F.pmod(F.pmod(F.xxhash64("left", "value", "right"), F.lit(buckets)) + F.col("copy"), F.lit(buckets)))
    row = F.struct("secret", "left", "value", "right", (F.col("copy") == 0).alias("own"))
    out = staged(rows.groupBy("bucket").agg(F.sort_array(F.collect_list(row)).alias("rows")), "buckets")
    free(each)
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Examples]]:
    for batch in batches:
        for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield bucket, Examples.of([(r["secret"], (r["left"], r["value"], r["right"]), r["own"]) for r in rows.as_py()], bucket)


def _round(buckets: DataFrame, weights: list[np.ndarray], number: int) -> list[np.ndarray]:
    """The mean weights of all buckets after a round: one row a weight reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows = np.zeros(sum(w.size for w in weights), dtype=np.int64), 0
        for bucket, examples in _examples(batches):
            made, n = examples.learnt(weights, [SEED, bucket, number])
            total, windows = total + _summed(made, n), windows + n
        if windows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, windows))], names=["i", "v"])

    summed = {r["i"]: r["v"] for r in buckets.mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    total = np.array([summed[i] for i in range(len(summed))], dtype=np.int64)
    return _mean(total[:-1], int(total[-1]), weights)


def _tally(buckets: DataFrame, net: Network) -> list[tuple[int, int, int, int]]:
    """The counts of all buckets: at most one row for each label, shape and step of log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, examples in _examples(batches):
            columns = list(zip(*examples.tally(net), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["label", "shape", "step", "n"])

    rows = buckets.mapInArrow(run, "label long, shape long, step long, n long").groupBy("label", "shape", "step").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in rows.collect()]


def train(found: DataFrame) -> Network | None:
    """The network of a corpus, from all its distinct candidates; none without findings."""
    table = dealt(found)
    if table is None:
        return None
    buckets, net = spread(table), Network.fresh(np.random.default_rng(SEED))
    for i in range(ROUNDS):
        net.weights = _round(buckets, net.weights, i)
    net = settled(net, _tally(buckets, net))
    free(table)
    return net


def judge(found: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, base, spans`` with the network's spans among the base ones."""
    schema = found.select("doc_id", "base").schema
    schema.add("spans", T.DataType.fromDDL("array<struct<start: bigint, kind: int, end: bigint>>"))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [list(base) for base in batch.column(1).to_pylist()]
            if net is not None:
                # Texts pass in turn, so the windows of one text are held at once.
                for own, found_ in zip(spans, batch.column(2), strict=True):
                    left = [c for c in found_.as_py() if not c["secret"]]
                    windows = [(c["left"], c["value"], c["right"]) for c in left]
                    own += [{"start": c["start"], "kind": 3, "end": c["end"]} for c, yes in zip(left, net.secret(windows) if left else [], strict=True) if yes]
                    own.sort(key=lambda s: (s["start"], s["kind"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), pa.array(spans, arrow.field(2).type)], schema=arrow)

    return found.select("doc_id", "base", "found").mapInArrow(run, schema)


def scan(docs: DataFrame) -> DataFrame:
    """Counts of the patterns' findings, a digest of these, and all spans as ``kind:start:end``."""
    found = staged(find(docs), "candidates")
    judged = judge(found, train(found))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return judged.select("doc_id", count(0), count(1), count(2), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
