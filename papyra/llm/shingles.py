"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. Word
hashes come from one running polynomial sum over the bytes of a group of texts,
so no word becomes a Python object. Hashes have 64 bits; two that meet within
one pair of documents by chance differ from the truth about once in 2**40 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import runs

CHUNK = 1 << 18

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A pseudorandom value for each byte.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_ORDER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the splitmix64 finaliser)."""
    h = h + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorting beats the hash table that numpy would build."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class _Powers:
    power = inverse = np.zeros(0, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.power) < n:
            n = max(n, CHUNK + (CHUNK >> 2))
            made = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                values = np.full(n, base, dtype=np.uint64)
                values[0] = 1
                made.append(np.multiply.accumulate(values))
            cls.power, cls.inverse = made
        return cls.power, cls.inverse


def word_hashes(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each group of texts: its first text's place, all words' hashes, and word counts by text."""
    sizes = [len(t) if t else 0 for t in texts]
    for a, b in runs(sizes, CHUNK):
        raw = b"\n" + b"\n".join([t or b"" for t in texts[a:b]]).lower() + b"\n"
        data = np.frombuffer(raw, dtype=np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        power, inverse = _Powers.upto(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * inverse[starts])
        offsets = 1 + np.concatenate([[0], np.cumsum(np.array(sizes[a:b], dtype=np.int64) + 1)])
        yield a, words, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The distinct hashed k-word shingles of each text, sorted; of fewer words, the one sequence."""
    for _, words, counts in word_hashes(texts):
        n = max(0, len(words) - k + 1)
        hashed = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            hashed += words[i : i + n] * _ORDER[i]
        hashed = mix(hashed, k)
        at = 0
        for c in counts.tolist():
            if c >= k:
                own = np.sort(hashed[at : at + c - k + 1])
                keep = np.ones(len(own), dtype=bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif c:
                with np.errstate(over="ignore"):
                    yield mix(np.array([(words[at : at + c] * _ORDER[:c]).sum(dtype=np.uint64)], dtype=np.uint64), c)
            else:
                yield np.zeros(0, dtype=np.uint64)
            at += c
