"""The training-data operators against brute force, and on hard tables."""

import base64
import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import common, decontaminate, fingerprints, html_text, jaccard, language, licences, lines, mixing, suffixes, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use for their own.
EXTRA = ["h", "rank", "place", "size", "taken", "kept_text", "n_lines", "class", "lang_pred", "score", "bucket"]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts):
    return table(spark, [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)])


def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns."""
    long = " ".join(f"word{i % 977} tail" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (4, "one", "en", None, 3), (4, "one", "en", None, 3),
        (5, long, "en", "b", len(long)), (6, long, "fr", "b", len(long)), (7, "the cat sat on the mat today", "en", "a", 28),
        (8, "the cat sat on the mat today", "en", "a", 28), (None, "the dog sat on the mat today", "en", "a", 28), (9, "\U0001f600é\x00 ß", "de", "ü", 6),
    ]
    df = table(spark, rows)
    for c in EXTRA:
        df = df.withColumn(c, F.lit(1))
    return df


def rows_of(df):
    return [tuple(r) for r in df.collect()]


RUNS = {
    "lines": lambda d: lines.dedup(d.select("doc_id", "text")),
    "suffixes": lambda d: suffixes.dedup(d),
    "fingerprints": lambda d: fingerprints.searched(d),
    "language": lambda d: language.identify(d),
    "jaccard": lambda d: jaccard.join(d),
    "mixing": lambda d: mixing.mix(d)["taken"],
    "licences": lambda d: licences.scan(d),
}


@pytest.mark.parametrize("name", list(RUNS))
def test_hard_and_empty_tables(spark, name):
    df = hard(spark)
    got = rows_of(RUNS[name](df))
    assert len(got) == df.count()
    assert rows_of(RUNS[name](df.limit(0))) == []
    assert sorted(map(repr, rows_of(RUNS[name](df.repartition(3))))) == sorted(map(repr, got))


# -- 1: lines


def brute_lines(docs):
    first = {}
    for d, t in sorted(docs):
        for p, line in enumerate((t or "").split("\n")):
            if w := tuple(WORD.findall(line)):
                first.setdefault(w, (d, p))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < lines.MIN_WORDS:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    gone = {a for a in first for b in first if first[b] < first[a] and near(a, b)}
    out = {}
    for d, t in docs:
        kept = []
        for p, line in enumerate((t or "").split("\n")):
            w = tuple(WORD.findall(line))
            if not w or (first[w] == (d, p) and w not in gone):
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    docs += [(900, None), (901, ""), (902, "a\tb  c d e"), (903, "a b c d e")]
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup(table(spark, docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


# -- 2: suffix arrays


def test_suffix_array_and_windows():
    rng = random.Random(2)
    for _ in range(100):
        contexts = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        sizes = np.array([len(c) for c in contexts])
        seps = np.cumsum(sizes + 1) - 1
        text = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8).astype(np.int16) + 1
        text[seps] = 0
        symbols = [(int(x), 0) for x in text]
        for i, s in enumerate(seps):
            symbols[s] = (0, i)
        assert suffixes.suffix_array(text, seps).tolist() == sorted(range(len(text)), key=lambda i: symbols[i:])
        owner, label = suffixes.equal_windows(contexts, 3)
        windows = [(c, contexts[c][i : i + 3]) for c in range(len(contexts)) for i in range(len(contexts[c]) - 2)]
        assert owner.tolist() == [c for c, _ in windows]
        assert len(set(zip((w for _, w in windows), label.tolist()))) == len({w for _, w in windows}) == len(set(label.tolist()))


def brute_bytes(docs):
    first, out = {}, {}
    docs = sorted((d, (t or "").encode()) for d, t in docs)
    for d, t in docs:
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    for d, t in docs:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_near_equal_contexts_are_sorted_without_recursion(monkeypatch):
    """Names of contexts that differ in one byte repeat a lot; doublings settle them, not one suffix array in another."""
    rng = random.Random(21)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(76))
    contexts = sorted({base[:i] + bytes([rng.choice(b"xyz")]) + base[i + 1 :] for i in range(76) for _ in range(3)})
    array, calls = suffixes.suffix_array, []
    monkeypatch.setattr(suffixes, "suffix_array", lambda *a: calls.append(1) or array(*a))
    owner, label = suffixes.equal_windows(contexts)
    windows = [c[i : i + 50] for c in contexts for i in range(27)]
    assert len(set(zip(windows, label.tolist()))) == len(set(windows)) == len(set(label.tolist()))
    assert calls == [1]


@pytest.mark.parametrize("values", [suffixes._BYTE, np.zeros(256, dtype=np.uint64), np.arange(256, dtype=np.uint64) % np.uint64(2)])
def test_equal_strings_whatever_their_hashes(monkeypatch, values):
    monkeypatch.setattr(suffixes, "_BYTE", values)
    monkeypatch.setattr(suffixes, "CHUNK", 40)
    rng = random.Random(22)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    flat, sizes = np.frombuffer(b"".join(strings), dtype=np.uint8), np.array([len(x) for x in strings])
    assert suffixes._first_equal(flat, sizes).tolist() == [strings.index(x) for x in strings]


def test_hits_of_a_text_share_rows(spark):
    rng = random.Random(23)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    docs = table(spark, [(i, text) for i in range(4)], "doc_id long, text string")
    shared = common.staged(suffixes.shared_anchors(docs, 1), "shared")
    found = suffixes.earlier_windows(docs, shared, np.zeros(0, dtype=np.uint32), 1).collect()
    for i in range(4):
        packs = [r["hits"] for r in found if r["doc_id"] == i]
        hits = np.frombuffer(b"".join(packs), dtype=np.int64)
        assert len(packs) == -(-len(hits) // suffixes.PACKED)
        assert suffixes.covered(2000, hits).all() == (i > 0)


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_suffixes_match_brute_force(spark, monkeypatch, hot):
    for name, value in (("HOT", hot), ("DEALT_BYTES", 4000 if hot == 3 else suffixes.DEALT_BYTES)):
        monkeypatch.setattr(suffixes, name, value)
    by_value, split = suffixes.hot_windows, []
    monkeypatch.setattr(suffixes, "hot_windows", lambda *a: split.append(len(a[2])) or by_value(*a))
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(6)]
    piece = lambda: (lambda b, x: b[x : x + rng.randint(10, 120)])(rng.choice(base), rng.randint(0, 200))
    docs = [(i * 3, "".join(piece() for _ in range(rng.randint(0, 6)))) for i in range(120)]
    docs += [(5000, None), (5001, ""), (5002, "a" * 400), (5003, "a" * 300), (5004, "x" * 49), (5006, "x" * 50), (5007, "x" * 50)]
    # One passage in every second document.
    docs += [(6000 + i, f"{i} " * rng.randint(0, 9) + base[0][:150] + f" {i}" * rng.randint(0, 9)) for i in range(60)]
    got = suffixes.dedup(table(spark, docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_bytes(docs)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert bool(split) == (hot == 3) and all(split)


@pytest.mark.parametrize("hot", [4096, 2])
def test_texts_of_one_id_lose_their_own_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = prose(80), prose(300)
    docs = [(1, shared), (2, shared + prose(40)), (2, other), (3, prose(30) + other[100:200]), (3, prose(50) + shared), (3, prose(200))]
    got = sorted(tuple(r)[:5] for r in suffixes.dedup(table(spark, docs, "doc_id long, text string")).collect())
    want = []
    for i, t in docs:
        # Alone with the texts of smaller ids, so rows of its own id have no part in it.
        alone = brute_bytes([(n, u) for n, (j, u) in enumerate([d for d in docs if d[0] < i])] + [(1000, t)])[1000]
        want.append((i, *alone))
    assert got == sorted(want)


# -- 3: fingerprints


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dé", "e"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts[7] = texts[3]
    got = {r["doc_id"]: r for r in fingerprints.compare(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = (int(x) for x in fingerprints.simhashes([t.encode(), changed.encode(), following.encode()]))
        assert (int(got[i]["fingerprint"], 16), int(got[i]["edited_fingerprint"], 16)) == (a, b)
        assert (got[i]["near_edited"], got[i]["near_next"]) == (1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64)
    assert got[7]["fingerprint"] == got[3]["fingerprint"]


@pytest.mark.parametrize("limit", [1 << 24, 40, 1])
def test_every_document_is_followed(spark, monkeypatch, limit):
    """Null and repeated ids, in one bucket and in many."""
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", limit)
    rows = [(i, f"text {i} " * (i % 4)) for i in range(30)] + [(3, "another three"), (3, "a third three"), (4, "text 4 " * 0), (None, "no id"), (None, "none either"), (None, None), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = [tuple(r) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    order = sorted(hashed, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    want = []
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()))
    assert sorted([tuple(r)[:3] for r in fingerprints.compare(df).collect()], key=repr) == sorted(want, key=repr)
    only = spark.createDataFrame([(None, "one row alone")], "doc_id long, text string")
    assert [r["n_chars"] for r in fingerprints.compare(only).collect()] == [13]


def test_block_tables_find_all_within_radius(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    got = {(r["query_id"], r["id"]): r["distance"] for r in fingerprints.within(df, df).collect()}
    assert got == {(a, b): d for a, x in enumerate(prints) for b, y in enumerate(prints) if a != b and (d := (x ^ y).bit_count()) <= 3}


@pytest.mark.parametrize("tile", [1024, 3])
def test_neighbours_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(fingerprints, "TILE", tile)
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(25)] + [0, 0, (1 << 64) - 1]
    for _ in range(4):
        prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints[:30]]
    ids = [None if rng.random() < 0.1 else i for i in range(len(prints))]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in zip(ids, prints)], "id long, fp long")
    got = {r["fp"] % (1 << 64): (r["n_near"], r["first_near"]) for r in fingerprints.neighbours(df.repartition(3)).collect()}
    for p in prints:
        near = [(i, q) for i, q in zip(ids, prints) if (p ^ q).bit_count() <= 3]
        assert got[p] == (len(near) - 1, min((i for i, _ in near if i is not None), default=None))
    assert fingerprints.neighbours(df.limit(0)).collect() == []


def test_searched_documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, base), (2, base), (3, base + " more"), (4, "something else altogether"), (None, base), (5, None), (6, "")]
    got = {}
    for r in fingerprints.searched(table(spark, rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], (r["n_near"], r["first_near"]))
    prints = {i: int(fingerprints.simhashes([(t or "").encode()])[0]) for i, t in rows}
    for i, p in prints.items():
        near = [j for j, q in prints.items() if (p ^ q).bit_count() <= 3]
        assert got[i] == (len(near) - 1, min((j for j in near if j is not None), default=None))


# -- 4: benchmark


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew a potent and bubbling elixir"
    docs = ["x " * 50 + item.upper().replace(" ", "\n") + " y", item.replace("quick", "quack"), item[: len(item) // 2], None, "", "fox " * 9]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "!!"), (4, "lazy cat")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs_of(spark, docs), bench, block_chars=10).collect()}
    assert {k: r["n_errors"] for k, r in found.items()} == {(0, 1): 0, (1, 1): 1}
    hit = found[0, 1]
    assert docs[0][hit["start"] : hit["end"]].split() == item.upper().split()
    assert {r["doc_id"] for r in decontaminate.clean(docs_of(spark, docs), bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.matches(docs_of(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.matches(hard(spark), bench).count() == 0


def test_myers_matches_dynamic_programming():
    rng = random.Random(6)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, 20))) for lo in (1, 0))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.myers(p, t) == (min(row), row.index(min(row)))


# -- 5: pages


def test_main_text(spark):
    page = (
        '<html><body class="home no-sidebar"><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies <div>x</div></div>'
        "<main><h2>T &amp; x</h2><p>Short  one.<div class='ad-slot'><p>Buy</div><p>Second&nbsp;part<ul><li>a<li>b</ul>"
        "<section class=comments><h3>Comments</h3><article>no</article></section></main><script>var a='<p>';</script><div class=footer>c</div></body>"
    )
    assert html_text.main_text(page) == "T & x\nShort one.\nSecond part\na\nb"
    assert [html_text.main_text(x) for x in (None, "", "<p>only", "a < b &lt; c", "<script>no end")] == ["", "", "only", "a < b < c", ""]
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in got.collect()) == [0, 0, len(html_text.main_text(page))]
    assert html_text.extract(pages.limit(0)).count() == 0
    body = "<p>" + "word " * 200_000
    assert html_text.main_text(body) == ("word " * 200_000).strip()


def test_marked_article_is_whole():
    apart = "<div class=share>Share</div><div class=advert>Buy</div><form>Find</form>"
    links = "".join(f"<li><a href=/{i}>Reference {i}</a></li>" for i in range(5))
    body = "A paragraph that is long enough to surge over the threshold of the window, and then some more words."
    for tag in ("article", "main"):
        page = f"<p>{body}</p><{tag}><h1>Title</h1>{apart}<p>{body}</p><ul>{links}</ul><p>Short end.</p></{tag}><p>{body}</p>"
        assert html_text.main_text(page) == "\n".join(["Title", body, *[f"Reference {i}" for i in range(5)], "Short end."])
    # Without a mark, surge and dive decide.
    assert html_text.main_text(f"<h1>Title</h1>{apart}<p>{body}</p>") == body


def brute_walk(weights, window, surge):
    """A line stays if the zeros around its stretch, runs of at least ``window`` of them, enclose a window that surges."""
    n, pad = len(weights), [0] * window
    w = pad + weights + pad
    keep = set()
    for a in range(window, n + window):
        if not w[a] or any(w[a - window : a]):
            continue
        b = a
        while any(w[b : b + window]):
            b += 1
        sums = [sum(w[i : i + window]) for i in range(a - window, b)]
        everywhere = max(sum(w[i : i + window]) for i in range(len(w)))
        if max(sums) >= min(surge, everywhere):
            keep |= set(range(a - window, b - window))
    return keep


def test_block_walk_matches_brute_force():
    rng = random.Random(14)
    for _ in range(500):
        weights = [rng.choice([0, 0, 0, 5, 40, 90]) for _ in range(rng.randint(0, 30))]
        got = {i for a, b in html_text.stretches(weights, 3, 86) for i in range(a, b)}
        assert got == brute_walk(weights, 3, 86), weights
    body = "A paragraph that is long enough to surge over the threshold of the window, and then some more words."
    menu = "".join(f"<p><a href=/{i}>Item {i}</a></p>" for i in range(6))
    page = f"{menu}<p>{body}</p><p>Short.</p>{menu}<p>Low</p>{menu}"
    assert html_text.main_text(page) == f"{body}\nShort."
    assert html_text.main_text(page, surge=1) == f"{body}\nShort.\nLow"  # without the threshold all stretches stay


def test_tags_with_odd_quotes_do_not_leak():
    for page, want in (
        ("<p title=it's>Text one.</p><p>it's two.</p>", "Text one.\nit's two."),
        ('<p class="x>Hello there.</p><p class="y">Again.</p>', "Hello there.\nAgain."),
        ('<p class="x>Hello there.', "Hello there."),
        ('<p data-x="<b>a > b</b>">Text.</p>', "Text."),
        ("<p a='1>2' b=\"3>4\">Text.</p>", "Text."),
        ('<a href="/x?a=1">He said "no" > yes.</a>', None),
    ):
        got = html_text.main_text(page)
        assert got == want if want is not None else "href" not in got


def test_short_ends_and_lists_stay():
    body = "word " * 60 + "end."
    apart = '<div class="ad">Buy</div><nav>Menu</nav><form>Form</form>'
    links = "<ul>" + "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(4)) + "</ul>"
    listed = "\n".join(f"Link number {i}" for i in range(4))
    assert html_text.main_text(f"<div><p>{body}</p>{apart}<p>Short end.</p></div>") == f"{body}\nShort end."
    assert html_text.main_text(f"<div><p>{body}</p>{links}<p>Short end.</p></div>") == f"{body}\n{listed}\nShort end."
    assert html_text.main_text(f"<div><p>{body}</p>{links}<p>{body}</p>{links}<p>\u00a9 2024 A company. All rights reserved.</p></div>") == f"{body}\n{listed}\n{body}"
    assert html_text.main_text(f'<article><p>{body}</p><p class="search">Of searching.</p><p id="copyright">Of rights.</p><p class="alert">Of alarms.</p><p class="ad">Buy.</p></article>') == f"{body}\nOf searching.\nOf rights.\nOf alarms."
    assert html_text.main_text(f'<main><p>{body}</p></main><article class="teaser"><p>Another page.</p></article>') == body


def test_unlucky_names_stay():
    body = "A paragraph that is long enough to surge over the threshold of the window, and then some more words."
    for name in ("social-history", "related-work", "search-results", "has-sidebar content", "no-footer", "noticeable", "adsorption"):
        for part in ("section", "div", "p"):
            assert html_text.main_text(f"<article><p>{body}</p><{part} class='{name}'>In {name}.</{part}><p>End.</p></article>") == f"{body}\nIn {name}.\nEnd."
    for name in ("cookie-notice", "ad", "ad-slot-3", "comment-list", "related-posts", "shareButtons", "site-footer", "widget_box", "newsletter-signup"):
        assert html_text.main_text(f"<article><p>{body}</p><div id='{name}'>Gone.</div><p>End.</p></article>") == f"{body}\nEnd."


# -- 6: language


def test_language_held_out(spark):
    rng = random.Random(7)
    words = {"xa": "mono stereo lira banda casa tela vita".split(), "xb": "krut stom plig vurst gnarl hump brock".split()}
    rows = []
    for i in range(200):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang, "s", 0))
    got = {r["doc_id"]: r for r in language.identify(table(spark, rows)).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows)
    shuffled = [(i + 1000, t, None, "other", 0) for i, t, *_ in rows]
    again = language.predict(table(spark, shuffled), language.train(table(spark, rows)))
    assert {r["lang_pred"] for r in again.collect()} == set(words)
    few = language.identify(table(spark, [(1, "text", None, None, 0), (2, "1 2", "en", None, 0)])).collect()
    assert {r["lang_pred"] for r in few} == {"und"}
    n = language.NGRAM
    long = "mono stereo " * 100_000
    assert sum(len(p) - n + 1 for p in language._pieces(long, n)) == len(long) - n + 1


# -- 7: archives


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\n\x00", "<p>a</p>", "solo"]
    rows = [(i, None if i == 4 else f"http://h/{i}", h) for i, h in enumerate(html)] + [(6, "http://h/6", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("x"))
    path = str(tmp_path / "w")
    warc.write(pages, path)
    got = {}
    for r in warc.resolved(warc.read(spark, path)).collect():
        got[int(r["page_id"])] = r
    for i, h in enumerate(html):
        payload = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        largest = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == largest else ("revisit", str(largest)))
        assert r["payload"] == ((h or "") if i == largest else None)
        assert r["url"] == (None if i == 4 else f"http://h/{i}")
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    raw = [f.read_bytes() for f in files]
    assert files and all(r.endswith(warc.END) and gzip.decompress(r) for r in raw)
    assert sum(1 for r in raw for m in warc._unpacked(r) if m) == len(rows)
    kept = warc.decide(pages, min_bytes=5).where("page_id in (2, 3)").collect()
    assert {r["record_type"] for r in kept} == {"response"}
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    odd = spark.createDataFrame([(None, None, "a"), (None, "u v", "a"), (None, None, "c"), (1, None, "a"), (1, None, "b"), (2, None, "b"), (3, None, "é" * 300_000)], "page_id long, url string, html string")
    warc.write(odd.withColumn("original", F.lit(9)).withColumn("value", F.lit(9)), str(tmp_path / "o"))
    found = warc.resolved(warc.read(spark, str(tmp_path / "o")))
    assert sorted(map(repr, rows_of(found.select("page_id", "record_type", "refers_to", "payload_bytes")))) == sorted(
        map(repr, [(None, "revisit", "1", 1), (None, "revisit", "1", 1), (None, "response", None, 1), ("1", "response", None, 1), ("1", "revisit", "2", 1), ("2", "response", None, 1), ("3", "response", None, 600_000)])
    )


def test_warc_files_are_bounded(spark, tmp_path):
    rng = random.Random(13)
    pages = spark.createDataFrame([(i, "u", "".join(rng.choice("abcdefgh") for _ in range(300))) for i in range(200)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), file_bytes=2000)
    assert all(f.stat().st_size < 2600 for f in (tmp_path / "w").glob("*.warc.gz"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 200


# -- 8: n-gram Jaccard


def brute_jaccard(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k, percent, groups", [(4, 85, {}), (4, 85, {"small_group": 1, "few_pairs": 0}), (5, 80, {"small_group": 2, "few_pairs": 2})])
def test_jaccard_matches_brute_force(spark, k, percent, groups):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(50):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 70))]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                j = rng.randrange(len(words))
                words[j : j + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            texts.append(" ".join(words))
    docs = [*enumerate(texts), (9000, None), (9001, ""), (9002, " \n"), (9003, "One Two"), (9004, "one two")]
    got = jaccard.join(table(spark, docs, "doc_id long, text string"), k, percent, **groups)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_jaccard(docs, k, percent)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for n, m in ((20, 25), (300, 900), (5000, 5100)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, m - n // 2, dtype=np.uint64)]))
        assert jaccard.sketches_apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)]
    got = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 140)}}


# -- 9: mixing


def water(sizes, weights, most):
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        target = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return [fixed.get(i, target.get(i)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def test_mixing(spark):
    rng = random.Random(10)
    rows, i = [], 0
    for source, n in (("a", 3), ("b", 60), ("Z", 25), ("é", 40), (None, 12)):
        for _ in range(n):
            rows.append((i, "w " * rng.randint(0, 300), None, source, 0))
            i += 1
    df = table(spark, rows)
    out = mixing.mix(df, block_words=64)
    taken = [r.asDict() for r in out["taken"].collect()]
    assert sorted(map(repr, taken)) == sorted(repr(r.asDict()) for r in mixing.mix(df.repartition(5), block_words=64)["taken"].collect())
    source_of = {r[0]: r[3] for r in rows}
    order = ["Z", "a", "b", "é", None]
    sizes = [sum(t["size"] for t in taken if source_of[t["doc_id"]] == s) for s in order]
    targets = water(sizes, [5, 2, 1, 5, 2], 3)
    for s, size, target in zip(order, sizes, targets):
        own = [t for t in taken if source_of[t["doc_id"]] == s]
        assert all(t["source_size"] == size and abs(t["target"] - target) < 1e-6 for t in own)
        assert abs(sum(t["taken"] for t in own) - target) <= 1
        assert all(t["taken"] <= 3 * t["size"] for t in own)
    slots = out["slots"].collect()
    assert len({(r["shard"], r["place"]) for r in slots}) == len(slots)
    assert len({(r["source_ix"], r["epoch"], r["block"]) for r in slots}) == len(slots)
    assert mixing.shard_counts(out["slots"]).agg(F.sum("n_slots")).first()[0] == len(slots)


def test_mix_is_written(spark):
    """Every slot's words are the words of its block, and taken counts them."""
    rng = random.Random(11)
    rows = [(i, " \n".join(f"{i}.{j}" for j in range(rng.randint(0, 300))), None, rng.choice("aab"), 0) for i in range(40)]
    rows += [rows[3], rows[3], (rows[5][0], "other " * len(rows[5][1].split()), None, rows[5][3], 0)]
    out = mixing.mix(table(spark, rows), block_words=64)
    written = {(r["shard"], r["place"]): r for r in out["output"].collect()}
    slots = {(r["shard"], r["place"]): r for r in out["slots"].collect()}
    assert written.keys() == slots.keys()
    known = {w for _, t, *_ in rows for w in t.split()}
    streams = {}
    for at, r in written.items():
        words = r["text"].split(" ")
        assert len(words) == r["words"] == slots[at]["words"] == sum(d["n_words"] for d in r["docs"])
        assert set(words) <= known
        assert [d["doc_id"] for d in r["docs"] for _ in range(d["n_words"])] == [int(w.split(".")[0]) if w != "other" else rows[5][0] for w in words]
        streams.setdefault((r["source_ix"], r["block"]), []).append(words)
    for copies in streams.values():
        longest = max(copies, key=len)
        assert all(c == longest[: len(c)] for c in copies)
    n_words = collections.Counter(d["doc_id"] for r in written.values() for d in r["docs"] for _ in range(d["n_words"]))
    taken = collections.Counter()
    for r in out["taken"].collect():
        taken[r["doc_id"]] += r["taken"]
    assert {k: n for k, n in taken.items() if n} == n_words


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 17, 64, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
        got = [r["y"] for r in mixing.permuted(df, "id", "n", F.lit(7), "y").collect()]
        assert sorted(got) == list(range(n))


# -- 10: licences


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    texts = [
        "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;"),
        mit.replace("sublicense", "sub-licence"),
        "a line\nreleased under the mit licence!\nb\nReleased under the MIT License.",
        "Copyright 2024 X. All rights reserved.",
        "nothing",
        mit[:-20],
    ]
    got = {r["doc_id"]: r for r in licences.scan(docs_of(spark, texts)).collect()}
    assert [got[i]["licence"] for i in range(6)] == ["MIT", "MIT", None, None, None, None]
    assert [got[i]["licences"] for i in range(6)] == ["MIT", "MIT", "MIT", "", "", ""]
    assert got[2]["n_found"] == 1


def test_full_licences_and_runs(spark):
    full = dict(reversed(licences.full_texts()))
    mit = licences.KNOWN[0][1]
    texts = [full[k] for k in sorted(full)]
    texts += [f"{mit}\n\ndef f():\n\n    return 1", f"Prose.\n\nPermission denied.\n\nCopyright 2024 X\n\n{mit}\n\n{full['Unlicense']}\n\nEnd.", mit.split("\n\n")[0] + "\n\nEnd."]
    got = {r["doc_id"]: r for r in licences.scan(docs_of(spark, texts)).collect()}
    assert [got[i]["licence"] for i in range(len(full))] == sorted(full)
    assert [got[len(full) + i]["licences"] for i in range(3)] == ["MIT", "MIT,Unlicense", ""]
    own = spark.createDataFrame([("Own", "May be used.\n\nNot sold.")], "licence string, text string")
    one = licences.scan(docs_of(spark, ["a\n\nmay be used\n\nnot sold\n\nb", mit]), own)
    assert sorted((r["doc_id"], r["licences"]) for r in one.collect()) == [(0, "Own"), (1, "")]


def test_jaccard_ids_and_small_partitions(spark):
    """Null and repeated ids, and partitions of one short document, of which no shingle may be counted."""
    text = "d137 d971 a977 b422 d558 b507 c739 d794 h135 b548"
    assert rows_of(jaccard.join(table(spark, [(7, text)], "doc_id long, text string"))) == [(7, 7, 7)]
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    a, b = words(60), words(60)
    rows = [(None, words(10)), (None, words(10)), (1, a), (1, b), (2, a + " x"), (None, b + " y"), (3, words(10)), (3, None), (None, ""), (None, "")]
    docs = table(spark, rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("of", F.lit(2)).withColumn("t", F.lit(3))
    got = sorted(map(repr, rows_of(jaccard.join(docs.repartition(10)))))
    shingles = lambda t: max(0, len((t or "").split()) - 3)
    component = [None, None, 1, 1, 1, 1, 3, 3, None, None]
    assert got == sorted(repr((d, shingles(t), c)) for (d, t), c in zip(rows, component))
    kept = sorted(map(repr, rows_of(jaccard.without_copies(docs.repartition(3)).select("doc_id", "text"))))
    assert kept == sorted(map(repr, [rows[i] for i in (0, 1, 2, 3, 6, 7, 8, 9)]))
    again = docs.unionByName(docs).where("text is not null and text <> ''")
    assert jaccard.without_copies(again).count() == 5
    assert rows_of(jaccard.without_copies(docs.limit(0))) == []


def test_clean_judges_each_row(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew a potent and bubbling elixir"
    rows = [(None, item), (None, "clean text"), (1, item), (1, "another clean text"), (2, None), (2, ""), (3, "z" * 300_000 + " " + item), (4, "z " * 100_000)]
    other = "Nine monks in violet robes walked past the frozen mill before the morning bell had rung its third time"
    docs = table(spark, rows, "doc_id long, text string").withColumn("item_id", F.lit("own")).withColumn("start", F.lit(0))
    bench = table(spark, [(1, other), (None, item), (2, None), (2, "")], "item_id long, text string")
    for size in (10, 4_000_000):
        left = decontaminate.clean(docs.repartition(4), bench, block_chars=size)
        assert left.columns == docs.columns
        assert sorted(map(repr, rows_of(left.select("doc_id", "text")))) == sorted(map(repr, [rows[i] for i in (1, 3, 4, 5, 7)]))
        found = rows_of(decontaminate.matches(docs, bench, block_chars=size).select("doc_id", "item_id", "n_errors"))
        assert sorted(map(repr, found)) == sorted(map(repr, [(None, None, 0), (1, None, 0), (3, None, 0)]))
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.clean(docs.limit(0), bench).count() == 0
