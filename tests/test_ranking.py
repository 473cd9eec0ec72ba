"""Pruned BM25, lists in full and vectors against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions import text
from papyra.operators import pruned, ranking


def brute_bm25(docs, queries, k1, b, idf, repeated):
    lists = {i: [w for w in t.lower().split()] if t is not None else None for i, t in docs}
    lengths = [len(v) for v in lists.values() if v is not None]
    avgdl = max(sum(lengths) / max(len(lengths), 1), 1.0)
    df = collections.Counter(w for v in lists.values() for w in set(v or []))
    out = {}
    for q, t in queries:
        terms = collections.Counter((t or "").lower().split())
        for i, words in lists.items():
            tf = collections.Counter(words or [])
            if not any(tf[w] for w in terms):
                continue
            score = 0.0
            for w, c in terms.items():
                odds = (len(docs) - df[w] + 0.5) / (df[w] + 0.5)
                value = math.log(odds + 1 if idf == "plus_one" else odds)
                score += value * (c if repeated else 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(words) / avgdl))
            out[q, i] = score
    return out


WORDS = lambda x: F.filter(F.split(F.lower(x), " "), lambda w: w != "")


@pytest.mark.parametrize("idf, repeated, k, size", [("plus_one", False, 3, 4), ("okapi", True, 5, 7), ("plus_one", True, 1, 512), ("okapi", False, 100, 3)])
def test_pruned_lists_match_brute_force(spark, monkeypatch, idf, repeated, k, size):
    monkeypatch.setattr(pruned, "BLOCK_DOCS", size)
    monkeypatch.setattr(pruned.blocks, "__defaults__", (size,))
    rng = random.Random(k)
    words = [f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, "")]
    docs += [(200 + i, docs[5][1]) for i in range(20)]
    queries = [(q, " ".join(rng.choice([*words, "absent"]) for _ in range(rng.randint(0, 4)))) for q in range(12)] + [(50, None)]
    want = []
    scores = brute_bm25(docs, queries, 1.5, 0.75, idf, repeated)
    for q, _ in queries:
        own = sorted((-round(s, 9), i) for (p, i), s in scores.items() if p == q)[:k]
        want += [(q, i, rank, round(-s, 6)) for rank, (s, i) in enumerate(own, 1)]
    a, b = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "q long, text string")
    got = pruned.bm25_top(a, b, "id", "q", WORDS, k, 1.5, 0.75, idf, repeated, query_block=5)
    assert sorted((r["q"], r["id"], r["rank"], round(r["score"], 6)) for r in got.collect()) == sorted(want)


def test_blocks_that_cannot_win_are_passed_over():
    """A block of weak documents is not scored once k better ones are known."""
    best = pruned._Best(1, 2)
    weights = (np.array([0, 1, 2]), np.array([0, 0]), np.array([2.0, 1.0]))
    ints = lambda *x: np.array(x, dtype=np.int32).tobytes()
    strong = {"n": 2, "keys": [1, 2], "lengths": ints(5, 5), "at": ints(0, 1, 0), "terms": ints(0, 0, 1), "tfs": ints(3, 3, 1), "most": [{"term": 0, "tf": 3, "dl": 5}, {"term": 1, "tf": 1, "dl": 5}]}
    weak = {"n": 2, "keys": [3, 4], "lengths": ints(9, 9), "at": ints(0, 1), "terms": ints(1, 1), "tfs": ints(1, 1), "most": [{"term": 1, "tf": 1, "dl": 9}]}
    assert pruned.block_top(strong, weights, best, 5.0, 1.2, 0.7) == 2
    assert pruned.block_top(weak, weights, best, 5.0, 1.2, 0.7) == 0
    assert [r[1] for r in best.rows[0]] == [1, 2]


def test_lists_in_full(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(10, 0, -1)], "id long, text string")
    queries = spark.createDataFrame([("a",), ("b",)], "q string")
    ranked = spark.createDataFrame([("a", 2, 1.5, 1), ("a", 9, 1.0, 2)], "q string, id long, score double, rank int")
    got = sorted(tuple(r) for r in ranking.listed_in_full(ranked, docs, queries, "q", "id", 4).collect())
    assert got == [("a", 1, 0.0, 3), ("a", 2, 1.5, 1), ("a", 3, 0.0, 4), ("a", 9, 1.0, 2), ("b", 1, 0.0, 1), ("b", 2, 0.0, 2), ("b", 3, 0.0, 3), ("b", 4, 0.0, 4)]
    few = docs.where("id < 3")
    assert ranking.listed_in_full(ranked.limit(0), few, queries, "q", "id", 4).count() == 4


def test_null_vectors_come_last(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], "q long, embedding array<double>")
    got = {}
    for r in ranking.dense(rows, queries, "id", "q", 4).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["id"], None if r["score"] is None else round(r["score"], 4)))
    assert got == {10: [(1, 1.0), (4, 0.7071), (2, None), (3, None)], 11: [(1, None), (2, None), (3, None), (4, None)]}


def test_stemmed_tokens_of_null(spark):
    assert spark.createDataFrame([(None,)], "x string").select(text.tokens_stemmed(F.col("x"))).first()[0] is None


def test_best_by_group_are_those_of_all_pairs(spark, monkeypatch):
    """The boosted order needs only the best of each query and group; equal documents, null groups and ids included."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for i in range(1200)]
    rows += [(2000 + i, "w1 w2", "a", "x") for i in range(9)] + [(None, "w1 w1", "a", "x"), (3000, None, "b", "y")]
    docs = spark.createDataFrame(rows, "id int, text string, lang string, source string").coalesce(2)
    queries = spark.createDataFrame([(1, "w1 w2 w1"), (2, "w3 a"), (3, "none"), (4, "w5 w6 w7 x")], "q int, text string")
    asked = queries.select("q", text.tokens_unicode(F.col("text")).alias("asked"))
    rules = [(F.col("q") % 2 == 0, F.col("lang") == "a", 0.5), (F.lit(True), F.col("source") == "x", -0.25)]
    top = lambda rows, best: {(r["q"], r["rank"], r["id"], round(r["final"], 6)) for r in ranking.top_k(ranking.boosted(rows.join(asked, "q"), "q", rules, F.array("lang", "source"), F.col("asked"), best), "q", "id", 4, "final", higher_id_first=True).collect()}
    pairs = ranking.bm25(docs, queries, "id", "q", text.tokens_unicode, repeated=True).join(docs.drop("text"), "id")
    want, every = top(pairs, None), pairs.count()
    for groups, size in ((pruned.MOST_GROUPS, 1000), (1, 3)):
        monkeypatch.setattr(pruned, "MOST_GROUPS", groups)
        found = pruned.bm25_by_group(docs, queries, "id", "q", text.tokens_unicode, ["lang", "source"], 4, repeated=True, query_block=size)
        assert top(found, F.col("best")) == want and found.count() < every / 2
