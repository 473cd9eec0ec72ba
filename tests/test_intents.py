"""Intents: the automaton against a scan of words, and both forms of a choice of topics."""

import random
import re

import pytest
from pyspark.sql import functions as F

from papyra.operators import intents


def words_of(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def named(words, phrase):
    """Whether the words of a phrase stand somewhere in a row."""
    own = phrase.split()

    def fits(word, form):
        if form.endswith("*"):
            return word.startswith(form[:-1])
        return word == form or (form.endswith("~") and word in (form[:-1], form[:-1] + "s"))

    return any(all(fits(w, f) for w, f in zip(words[i:], own)) for i in range(len(words) - len(own) + 1))


def brute(text):
    words = words_of(text)
    topics = {t for t, own in intents.phrases().items() if any(named(words, p) for p in own)}
    if any(re.fullmatch(r"[a-z]{2,6}\d{3,}", w) for w in words):
        topics.add(intents.CODE)
    return {n: (not i.some or bool(topics & {*i.some})) and topics >= {*i.every} and not topics & {*i.none} for n, i in intents.INTENTS.items()}


def texts():
    rng = random.Random(3)
    known = [p for own in intents.phrases().values() for p in own]
    shown = lambda p: p.replace("~", rng.choice(["", "s"])).replace("*", rng.choice(["", "ed", "x1"]))
    out = [rng.choice([" ", ", "]).join(rng.choice([shown(rng.choice(known)), shown(rng.choice(known)).upper(), "xyz", "modulesx", "labé"]) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    return [*out, None, "", "CSA101", "csa 101", "credits of csa101 in total", "Semester-2", "2nd  SEMESTER", "sem 1 to 3", "sem 3 to 1", "b.tech credits", "list of modules"]


def test_automaton_matches_a_scan_of_words(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r["n"]: r["intents"] for r in intents.with_intents(spark.createDataFrame(rows, "n int, text string")).collect()}
    for n, t in rows:
        assert got[n] == brute(t), t


def test_patterns_agree_with_intents(spark):
    plain = [n for n, i in intents.INTENTS.items() if not i.every and not i.none and intents.CODE not in i.some]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "n int, text string")
    rows = intents.with_intents(df).select("text", "intents", *[F.coalesce(F.lower("text").rlike(intents.pattern(n)), F.lit(False)).alias(n) for n in plain]).collect()
    for r in rows:
        assert {n: r[n] for n in plain} == {n: r["intents"][n] for n in plain}, r["text"]
    with pytest.raises(ValueError):
        intents.pattern("only_online")


def test_bounds_of_words_are_those_of_ascii(spark):
    from papyra import catalog
    from papyra.functions import text as t
    from papyra.operators import understanding

    assert t.ascii_bounds(r"\\b\b") == r"\\b" + t.WORD_BOUND
    texts = ["un lesèreen", "èles", "les_", "les2", "(les)", "a les", "éandé", "dept thatè"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    found = understanding.intent_with_rewrite(F.col("text"), catalog.INTENTS, catalog.REWRITES, "none")
    assert [r[0] for r in rows.select(found).collect()] == ["syllabus", "syllabus", "none", "none", "syllabus", "syllabus", "syllabus", "website"]
    words = spark.createDataFrame([("éab-cd ab-cdé x_ab-cd",)], "text string").select(t.tokens_stemmed(F.col("text"))).first()[0]
    assert words.count("abcd") == 2
