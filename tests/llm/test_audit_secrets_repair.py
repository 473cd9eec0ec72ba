"""Filter audit, secret scan and conversation repair against brute force, and on hard tables."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import string
import zlib

import numpy as np
from pyspark.sql import functions as F

from papyra.llm import conversations, filter_audit, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# -- 11: filter audit


def fails(docs):
    """The failed filters of each row, judged one by one."""
    out = []
    for i, t, _ in docs:
        t = t or ""
        words = WORD.findall(t)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            bad.add("C")
        if re.search("[#$%&*|]", t):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            bad.add("E")
        out.append(bad)
    return out


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    flags = fails(docs)
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        rows = [(i, f) for (i, _, lang), f in zip(docs, flags) if (lang or "") == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in rows)
                alone = sum(r[1] == {f} for r in rows)
                total[f] += len(gone)
                out[part, order, step] = [len(kept), len(gone), failing - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_of(spark, docs, labels):
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in docs], DOCS)
    for c in ("n", "part", "good", "A", "digest", "first", "a.b"):
        df = df.withColumn(c, F.lit("own"))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(filter_audit.judged(df, told)).collect()}


def test_audit_matches_filters_applied_one_by_one(spark):
    rng = random.Random(4)
    words = [a + b for a in "bcdfg" for b in "aeiou"]
    texts = [" ".join(rng.choice(words[: rng.choice((3, 25))]) + str(rng.randrange(400)) * (rng.random() < 0.8) for _ in range(rng.choice((5, 190, 200, 260)))) for _ in range(12)]
    texts += [t.upper() for t in texts[:3]] + [t + " #1" for t in texts[3:6]] + ["", "A" * 3 + "b" * 97, "A" * 4 + "b" * 96]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(None, texts[0], "en"), (None, None, "fr"), (70, None, None), (5, texts[0], "en"), (5, texts[0], "en"), (6, "x y" * 20_000, "en")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 60, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    assert audit_of(spark, docs, labels) == brute_audit(docs, labels)
    assert audit_of(spark, docs, []) == brute_audit(docs, [])
    assert audit_of(spark, [], labels) == {}


def test_audit_of_other_filters(spark):
    """Two filters and no loss: half of what both remove is dealt to each."""
    rows = spark.createDataFrame([("p", 3, True, True), ("p", 2, True, False), ("p", 5, False, False)], "part string, n long, X boolean, Y boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.audit(rows, "XY", ()).collect()}
    assert got == {("XY", 1): (5, 5, 0, 2, 7), ("XY", 2): (5, 0, 3, 0, 3), ("YX", 1): (7, 3, 0, 0, 3), ("YX", 2): (5, 2, 3, 2, 7)}


# -- 12: secrets


def scan_by_hand(text, kind):
    """Leftmost matches of one kind, character by character, failing ones dropped."""
    out, at = [], 0
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    run = lambda i, allowed: next((j for j in range(i, len(text)) if text[j] not in allowed), len(text))
    while at < len(text):
        end, ok = None, False
        if kind == "hex":
            end = run(at, set("0123456789abcdef"))
            ok, end = end - at >= 32, end if end > at else None
        elif kind == "access" and text.startswith("AKIA", at):
            end = run(at + 4, set(string.ascii_uppercase + string.digits))
            ok, end = end - at >= 16, end if end > at + 4 else None
        elif kind == "assign":
            for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
                part = text[at : at + len(name)]
                if part.isascii() and part.lower() == name:
                    i = at + len(name)
                    i += text[i : i + 1] in ("'", '"') and i < len(text)
                    i = run(i, {" "})
                    if text[i : i + 1] not in (":", "=") or i >= len(text):
                        continue
                    i = run(i + 1, {" "})
                    i += i < len(text) and text[i] in "'\""
                    j = run(i, value)
                    if j > i:
                        end, ok = j, j - i >= 8
                        break
        if end is None:
            at += 1
        else:
            if ok:
                out.append((at, kind, end))
            at = end
    return out


def found(rng, words):
    name = rng.choice(["password=", "token: '", 'Secret" : "', "API_KEY = ", "apikey:"])
    return name + "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40)))


def corpus(rng, n):
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts = []
    for i in range(n):
        t = prose(15)
        if i % 3 == 0:
            t += " " + found(rng, words) + " " + prose(8)
        if i % 3 == 1:
            t += f" {rng.choice(words)}.{rng.choice(words)}{rng.randrange(99)}@mail{i}.example.com {rng.choice(words)}-{rng.randrange(9999)} " + prose(8)
        texts.append(t)
    return texts


def test_base_spans_match_a_scan_by_hand():
    rng = random.Random(5)
    parts = ["password", "Passwd", "TOKEN", "secret", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "AKIAABCDEFGH2345", "0" * 31, "deadbeef" * 4, "F", "z", "é", "\n", "token=token: abcdefghij"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = sorted((a, secrets.KINDS.index(k), b) for k in secrets.KINDS[:3] for a, k, b in scan_by_hand(text, k))
        assert [s[:3] for s in secrets.base_spans(text)] == want
        for a, b, labelled in secrets.candidates(text, secrets.base_spans(text)):
            assert b - a >= 8 and (labelled or not any(a < e and s < b for s, _, e in want))


def test_query_rows_and_hard_tables(spark):
    texts = corpus(random.Random(6), 60) + [None, "", "é\U0001f600 password=abcdefgh1", "x" * 300_000 + " AKIAABCDEFGH2345Z", "AKIAABCDEFGH2345Z" * 3]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None), (0, texts[0], "en", "s", 1)]
    df = spark.createDataFrame(docs, DOCS)
    for c in ("base", "found", "spans", "kind", "value", "a.b"):
        df = df.withColumn(c, F.lit("own"))
    got = rows_of(secrets.scan(df))
    assert len(got) == len(docs)
    by_id = {}
    for i, *row in got:
        by_id.setdefault(i, []).append(tuple(row))
    for i, t, *_ in docs:
        base = sorted((a, secrets.KINDS.index(k), b) for k in secrets.KINDS[:3] for a, k, b in scan_by_hand(t or "", k))
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        counts = tuple(sum(k == x for _, x, _ in base) for k in range(3))
        for row in by_id[i]:
            assert row[:4] == (*counts, hashlib.sha256(listed.encode()).hexdigest())
            assert [s for s in row[4].split(",") if s and not s.startswith("model")] == [s for s in listed.split(",") if s]
    assert by_id[None][0] == by_id[0][0] == by_id[0][1]
    assert sorted(map(repr, rows_of(secrets.scan(df.repartition(3))))) == sorted(map(repr, got))
    assert rows_of(secrets.scan(df.limit(0))) == []
    plain = rows_of(secrets.scan(df.where("doc_id = 1")))
    assert plain == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")]


def test_network_finds_what_patterns_miss():
    """Held-out recall and false findings of a network trained on one kind of text only."""
    rng = random.Random(8)

    def windows(texts):
        out = {True: [], False: []}
        for t in texts:
            for a, b, secret in secrets.candidates(t, secrets.base_spans(t)):
                out[secret].append((t[max(0, a - secrets.LEFT) : a], t[a:b], t[b : b + secrets.RIGHT]))
        return out

    learnt, apart = windows(corpus(rng, 300)), windows(corpus(rng, 300))
    net = secrets.fit(learnt[True], learnt[False])
    assert net.secret(apart[True]).mean() >= 0.9
    assert net.secret(apart[False]).mean() <= 0.02
    missed = [("the value ", "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(36)), " went out") for _ in range(100)]
    assert net.secret(missed).mean() >= 0.9
    assert secrets.fit([], learnt[False]) is None
    # Long windows pass in slices; the slices don't show.
    long = [("a ", "x1" * 100_000, " b"), *apart[True][:5]]
    assert np.allclose(net.logits(long)[1:], net.logits(long[1:]), atol=1e-4)
    small, secrets._SLICE = secrets._SLICE, 37
    try:
        assert np.allclose(net.logits(apart[True][:20]), sliced := net.logits(apart[True][:20]), atol=1e-4)
    finally:
        secrets._SLICE = small
    assert np.allclose(sliced, net.logits(apart[True][:20]), atol=1e-4)


def test_every_candidate_is_learnt_from(spark, monkeypatch):
    """Findings beyond any fixed number count, in one bucket at least and once among those held out, however rows are dealt."""
    monkeypatch.setattr(secrets, "BUCKET", 500)
    rng = random.Random(31)
    texts = [f"so {found(rng, [])} ends" for _ in range(1000)] + corpus(rng, 300)
    df = secrets.find(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS))
    each = df.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*").withColumn("h", F.xxhash64("left", "value", "right"))
    want = {(r["secret"], r["left"], r["value"], r["right"]) for r in each.collect()}
    buckets = [r["rows"] for r in secrets.dealt(df).collect()]
    assert len(buckets) == -(-len(want) // 500)
    assert sorted(tuple(r)[:4] for rows in buckets for r in rows if r["own"]) == sorted(want)
    assert all(sum(r["secret"] == k for r in rows) >= 100 for rows in buckets for k in (True, False))
    net = secrets.train(df)
    again = secrets.train(df.repartition(7))
    assert all(np.array_equal(x, y) for x, y in zip(net.weights, again.weights)) and (net.scale, net.thresholds) == (again.scale, again.thresholds)
    # The finding with the largest hash is not among the first few.
    last = each.where("secret").orderBy(F.desc("h")).first()["doc_id"]
    less = secrets.train(df.where(F.col("doc_id") != last))
    assert not all(np.array_equal(x, y) for x, y in zip(net.weights, less.weights))
    apart = {k: [(t[max(0, a - secrets.LEFT) : a], t[a:b], t[b : b + secrets.RIGHT]) for t in corpus(rng, 300) for a, b, s in secrets.candidates(t, secrets.base_spans(t)) if s == k] for k in (True, False)}
    assert net.secret(apart[True]).mean() >= 0.9 and net.secret(apart[False]).mean() <= 0.02


def test_gradients_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    net = secrets.Network.fresh(rng)
    # No runs that repeat: where equal responses tie for the largest, rounding decides.
    drawn = "".join(rng.permutation(list(string.ascii_letters + string.digits)))
    windows, labels = [("ab ", drawn, " c"), ("", "token123", ".."), ("a", drawn[::-1], "")], np.array([1.0, 0.0, 1.0])
    whole = net.gradients(windows, labels)
    monkeypatch.setattr(secrets, "_SLICE", 13)
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(whole, net.gradients(windows, labels)))


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = secrets.Network.fresh(rng)
    net.weights = [w.astype(np.float64) for w in net.weights]
    windows, labels = [("ab ", "x9y8z7w6", " c"), ("", "token123", "..")], np.array([1.0, 0.0])

    def loss():
        z = net.logits(windows).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    for w, g in zip(net.weights, net.gradients(windows, labels)):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(10)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            was, w[at] = w[at], w[at] + 1e-3
            up = loss()
            w[at] = was - 1e-3
            down = loss()
            w[at] = was
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3


# -- 13: conversations


def damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        out[conv] += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def cheapest(rows):
    """Dijkstra over (rows passed, turns made): least cost, then least edits; at most two turns are inserted in a row."""
    queue, seen = [(0, "", 0, (), 0)], set()
    while queue:
        cost, edits, i, made, free = heapq.heappop(queue)
        roles = "".join(r[:1] or "?" for r, _ in made)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits, made
        if (i, edits) in seen:
            continue
        seen.add((i, edits))
        steps = []
        if free < 2:
            steps += [("I", 3, i, (*made, (r, "")), free + 1) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, gone, cut = rows[i]
            steps.append(("D", 4, i + 1, made, 0))
            if not gone:
                steps.append(("K", 3 * cut, i + 1, (*made, (role, text)), 0))
                steps += [("R", 3 + 3 * cut, i + 1, (*made, (r, text)), 0) for r in ("user", "assistant")]
        for edit, price, j, then, f in steps:
            if re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in then)):
                heapq.heappush(queue, (cost + price, edits + edit, j, then, f))
    raise AssertionError


def brute_repair(rows):
    out = {}
    for conv, left in damage(rows).items():
        judged, before = [], set()
        counts = collections.Counter()
        for _, role, text in left:
            blank = not WORD.search(text)
            again = not blank and (role, text) in before
            cut = not blank and not again and text.rstrip(" \t\n\v\f\r")[-1] not in ".!?"
            before.add((role, text))
            counts.update({"blank": blank, "again": again, "cut": cut})
            judged.append((role, text, blank or again, cut))
        initials = [r[1][:1] for r in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[0] for r in left if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, edits, made = cheapest(judged)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (gaps, counts["blank"], counts["again"], counts["cut"], illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string"


def conversation_rows(rng, n, longest):
    texts = ["Fine.", "No", " ", "", "Why?", "Go!\n", "cut off", None, "é. \t", "a.b"]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = "system" if turn == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant", "user", "assistant", "tool", None, "", "system"])
            out.append((conv, rng.choice([turn, turn, turn, None, turn * 2]), role, rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."))
    return out


def test_repair_matches_brute_force(spark):
    rng = random.Random(9)
    rows = conversation_rows(rng, 150, 7) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 1, "user", "Hi.")]
    df = spark.createDataFrame(rows, CONV)
    for c in ("copies", "again", "there", "a.b", "job"):
        df = df.withColumn(c, F.lit("own"))
    want = brute_repair(rows)
    harmed = conversations.damaged(df)
    for limits in ({}, {"batch_rows": 4, "segment_rows": 1}, {"batch_rows": 3, "segment_rows": 2}):
        got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(harmed, **limits).collect()}
        assert got == want
    assert rows_of(conversations.repair(conversations.damaged(df.limit(0)))) == []


def test_repair_of_a_long_conversation_and_long_texts(spark):
    """Segments leave no trace; a conversation whose rows are all dropped has zeros."""
    rng = random.Random(10)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"Turn {i}" + rng.choice([".", ""]) + " word" * (50_000 * (i == 30))) for i in range(1200)]
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Dropped."))
    df = conversations.damaged(spark.createDataFrame(rows, CONV))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(df).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(df, segment_rows=50).collect()}
    assert len(got[7][6]) >= sum(zlib.crc32(f"7:{i}".encode()) % 20 != 0 for i in range(1200))
