"""Queries that several tables answer, crawl state, and aliases at every place: small cases with known results."""

import json
import re

from pyspark.sql import functions as F

from papyra.operators import dispatch, phrases, understanding
from papyra.sources import tables

COURSES = [
    ("CSA101", "Data Tools I", False, "CSL101"),
    ("CSL101", "Data Tools Lab", True, None),
    ("CSA201", "Field Work", False, None),
    ("CSA102", "Field Work", False, None),
]


def courses(spark):
    return spark.createDataFrame(COURSES, "code string, name string, is_lab boolean, partner string")


def named(spark, texts, aliases=()):
    queries = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    extra = spark.createDataFrame(list(aliases), "alias string, code string")
    rows = dispatch.mentions(queries, ["q"], "text", courses(spark), extra).collect()
    found = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r["q"], r["place"])):
        found[r["q"]].append(r["code"])
    return found


def test_mentions(spark):
    texts = [
        "data-tools 1 and CSA201",  # a roman numeral is a digit
        "field work in semester 2",  # one name, two courses
        "field work",
        "CSA102 and CSA201",  # written codes stay though they share a title
        "data structures",  # an alias
        "CSA999 or nothing",
        None,
        "",
    ]
    found = named(spark, texts, [("Data Structures", "CSA101"), ("structures", "CSL101"), ("gone", "CSA999")])
    assert found == {0: ["CSA101", "CSA201"], 1: ["CSA201"], 2: ["CSA102"], 3: ["CSA102", "CSA201"], 4: ["CSA101"], 5: [], 6: [], 7: []}


def test_mentions_by_first_words(spark, monkeypatch):
    """Only phrases that begin as a name does are made; with too many first words all are, with the same result."""
    texts = ["compare field work with data tools 1, data structures ii and CSA101", "field of data tools i", "tools field work field", "no name " * 300 + "field work", "data-structures 2 (field) work in sem 2"]
    aliases = [("Data Structures II", "CSA101"), ("structures", "CSL101"), ("tools", "CSL101")]
    few = named(spark, texts, aliases)
    heads = spark.createDataFrame([(2, "FIELD", [2])], "kind int, head string, sizes array<int>")
    queries = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    made = dispatch.phrases_of(queries, ["q"], "text", 3, heads, F.lit(False)).collect()
    assert sorted((r["q"], r["start"], r["phrase"]) for r in made) == [(0, 1, "FIELD WORK"), (1, 0, "FIELD OF"), (2, 1, "FIELD WORK"), (3, 600, "FIELD WORK")]
    monkeypatch.setattr(dispatch, "MOST_HEADS", 0)
    assert named(spark, texts, aliases) == few and few[0] == ["CSA102", "CSL101", "CSA101"] and few[3] == ["CSA102"]


def test_answers_by_clause(spark):
    items = spark.createDataFrame([(c, n, f"{c} {n}") for c, *_ in COURSES for n in range(1, 7)], "code string, number int, title string")
    texts = [
        "CSA101 module 2 and CSA201 modules 4 to 5",
        "experiments 1 and 2 of CSA101",
        "total credits of CSA101 module 2",
        "modules of field work",  # no digit
        "CSA201 unit 1 CSA101 unit 10",  # cut from course to course; there is no tenth
        None,
    ]
    queries = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    rows = dispatch.course_answers(queries, "q", "text", courses(spark), items).collect()
    found = sorted((r["q"], r["place"], r["code"], r["number"]) for r in rows)
    assert [x for x in found if x[0] == 0] == [(0, 1, "CSA101", 2), (0, 2, "CSA201", 4), (0, 2, "CSA201", 5)]
    # The second clause names the course and has no module: its lab answers.
    assert {(c, n) for q, _, c, n in found if q == 1} <= {("CSL101", n) for n in range(1, 7)} and any(q == 1 for q, *_ in found)
    assert [x for x in found if x[0] > 1] == [(4, 1, "CSA201", 1)]


def test_special_tables_fall_through(spark):
    queries = spark.createDataFrame([(1, "PE 3 or minors"), (2, "pe ii"), (3, "none")], "q int, text string")
    rows = spark.createDataFrame([("pe", 2, 1, ["x"]), ("minors", None, 1, ["m"])], "route string, number int, ord int, cells array<string>")
    routes = [("pe", r"\bpe\s*([1-4]|iii|ii|iv|i)\b"), ("minors", r"\bminors?\b")]
    found = dispatch.special_tables(queries, "q", "text", routes, rows).collect()
    assert sorted((r["q"], r["route"], r["cells"][0]) for r in found) == [(1, "minors", "m"), (2, "pe", "x")]


def test_resume_state(spark, tmp_path):
    path = f"{tmp_path}/state.json"
    visited, records = tables.resume_state(spark, path)
    assert visited.count() == records.count() == 0
    state = {"visited": ["https://h/a", "https://h/a", "https://h/b"], "pdfs": {"https://h/x.pdf": {"hash_id": "1", "title": "x", "source_page": "https://h/a", "depth": 2}}}
    with open(path, "w") as f:
        json.dump(state, f, indent=1)
    visited, records = tables.resume_state(spark, path)
    assert sorted(r["url"] for r in visited.collect()) == ["https://h/a", "https://h/b"]
    assert [tuple(r) for r in records.collect()] == [("https://h/x.pdf", "1", "x", "https://h/a", 2)]
    links = spark.createDataFrame([("https://h/b",), ("https://h/c",), ("https://h/c",)], "url string")
    assert [r["url"] for r in tables.unvisited(links, visited).collect()] == ["https://h/c"]
    with open(path, "w") as f:
        f.write("{not json")
    assert [t.count() for t in tables.resume_state(spark, path)] == [0, 0]


def test_aliases_at_every_place(spark):
    docs = spark.createDataFrame([(1, "a b c d e f, then a b; a b c d e x"), (2, None), (3, "")], "doc_id int, text string")
    aliases = spark.createDataFrame([("a b", "S"), ("A-b c d e f", "L"), ("", "E")], "alias string, code string")
    found = understanding.entities_sql(docs, aliases, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["code"], r["place"]) for r in found) == [(1, "L", 0), (1, "S", 7), (1, "S", 9)]


def test_alias_hits_by_automaton_and_by_join(spark, monkeypatch):
    """Both ways give the same hits, and those of a search word by word."""
    import random

    rng = random.Random(5)
    words = ["a", "b", "c1", "dd", "é", "A"]
    text = lambda n: rng.choice([" ", "-", "  ", ". "]).join(rng.choice(words) for _ in range(n))
    aliases = [(text(rng.randint(1, 5)), f"k{i % 25}") for i in range(40)] + [("", "none"), ("é", "none"), (None, "none"), ("a b", "k1"), ("a b", "k2")]
    docs = [(i, text(rng.randint(0, 30))) for i in range(40)] + [(50, None), (51, ""), (52, "a b " * 2000)]
    plain = lambda x: re.findall("[a-z0-9]+", (x or "").lower())
    want = set()
    for i, t in docs:
        own = plain(t)
        if i == 52:
            continue
        hits = {(" ".join(a), code, p, len(a)) for x, code in aliases if (a := plain(x)) for p in range(len(own) - len(a) + 1) if own[p : p + len(a)] == a}
        want |= {(i, a, c, p) for a, c, p, n in hits if not any(m > n and q < p + n and p < q + m for _, _, q, m in hits)}
    queries, given = spark.createDataFrame(docs, "q int, text string"), spark.createDataFrame(aliases, "alias string, code string")
    one = {tuple(r) for r in understanding.alias_hits(queries, given, "q", "text").collect()}
    assert {r for r in one if r[0] != 52} == want
    codes = {r["q"]: r["codes"] for r in understanding.entities(queries, given, "q", "text").collect()}
    monkeypatch.setattr(understanding, "MOST_ALIASES", 0)
    assert {tuple(r) for r in understanding.alias_hits(queries, given, "q", "text").collect()} == one
    assert {r["q"]: r["codes"] for r in understanding.entities(queries, given, "q", "text").collect()} == codes
    assert codes[50] == [] and codes[52]


def test_aliases_begin_with_known_words(spark, monkeypatch):
    """With few first words only places where an alias can begin are shuffled; the hits are those of all phrases."""
    docs = spark.createDataFrame([(1, "no such name " * 200 + "ada b c d e f, ada b"), (2, "b ada"), (3, None)], "q int, text string")
    aliases = spark.createDataFrame([("Ada B", "S"), ("ada b c d e f", "L"), ("b", "B")], "alias string, code string")
    hits = lambda: sorted(tuple(r) for r in understanding.entities_sql(docs, aliases, "q", "text").collect())
    few = hits()
    assert few == [(1, "ada b", "S", 606), (1, "ada b c d e f", "L", 600), (2, "b", "B", 0)]
    plan = lambda: understanding.entities_sql(docs, aliases, "q", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(understanding, "MOST_FIRST_WORDS", 0)
    assert hits() == few and "strategy=broadcast" not in plan()


def test_alias_hits_of_many_aliases(spark, monkeypatch):
    """By automaton, by hashes and by join the hits are those of the SQL: texts with one key cover each other's, those without a key none."""
    import random

    rng = random.Random(7)
    words = ["a", "b", "ab", "c1", "é"]
    text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(words) for _ in range(n))
    aliases = [(text(rng.randint(1, 6)), f"k{i}") for i in range(60)] + [("a b", "twice"), ("A. b", "twice"), ("", "none")]
    docs = [(rng.choice([None, *range(25)]), text(rng.randint(0, 25))) for _ in range(60)] + [(70, None), (71, ""), (72, "a b ab c1"), (72, "a b ab c1")]
    plain = lambda x: re.findall("[a-z0-9]+", x or "")
    given = {(tuple(plain(a.lower())), code) for a, code in aliases if plain(a.lower())}
    hits = [(q, a, code, p) for q, t in docs for a, code in given for p in range(len(plain(t))) if tuple(plain(t)[p : p + len(a)]) == a]
    over = lambda x, y: x[0] is not None and x[0] == y[0] and len(y[1]) > len(x[1]) and y[3] < x[3] + len(x[1]) and x[3] < y[3] + len(y[1])
    order = lambda rows: sorted(rows, key=str)
    want = order((q, " ".join(a), code, p) for q, a, code, p in hits if not any(over((q, a, code, p), y) for y in hits))
    queries, named = spark.createDataFrame(docs, "q int, text string"), spark.createDataFrame(aliases, "alias string, code string")
    got = lambda texts=queries: order(tuple(r) for r in understanding.alias_hits(texts, named, "q", "text").collect())
    assert got() == want
    monkeypatch.setattr(understanding, "MOST_ALIASES", 0)
    assert got() == want
    # Of texts with one key each nothing is joined, and none is compared with all other hits.
    plan = understanding.alias_hits(spark.createDataFrame([(1, "a b")], "q int, text string"), named, "q", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    monkeypatch.setattr(understanding, "MOST_PHRASES", 0)
    assert got() == want
    monkeypatch.setattr(understanding, "MOST_SHARED_KEYS", 0)
    assert got() == want


def test_phrases_of_equal_hashes(spark, monkeypatch):
    """With a hash that is the sum of letters the words themselves still decide; pieces smaller than a text or a phrase change nothing."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "BASE", 1)
    monkeypatch.setattr(phrases, "_powers", [])
    monkeypatch.setattr(phrases, "PIECE_BYTES", 3)
    table = pa.table({"alias": ["ab", "ba", "ab c", "c ab", "bb"], "code": ["1", "2", "3", "4", "5"]})
    files = phrases.written(spark, table)
    schema = pa.schema([("k", pa.int32()), ("alias", pa.string()), ("code", pa.string()), ("place", pa.int32())])
    texts = pa.RecordBatch.from_pydict({"k": pa.array([1, 2, None, 4], pa.int32()), "plain": [" ba ab c ", "ca ac bb", "c ab", None]})
    found = lambda longest: sorted((str(r["k"]), r["code"], r["place"]) for b in phrases.searched(iter([texts]), files, longest, schema) for r in b.to_pylist())
    assert found(True) == [("1", "2", 0), ("1", "3", 1), ("2", "5", 2), ("None", "1", 1), ("None", "4", 0)]
    assert found(False) == [("1", "1", 1), ("1", "2", 0), ("1", "3", 1), ("2", "5", 2), ("None", "1", 1), ("None", "4", 0)]
    monkeypatch.setattr(phrases, "_powers", [])
    assert [b.num_rows for b in phrases.searched(iter([texts]), phrases.written(spark, table.slice(0, 0)), True, schema)] == [0] * 4


def test_name_dictionary(spark):
    stop = ["computer", "professor", "department"]
    pages = [
        ("https://x.example/faculty/ada-lee-computer/", ["Home | Site", "Dr. Ada M. Lee", "Professor", "A line of more than four words", "Fifth Line"]),
        ("https://x.example/faculty/deepikak", ["ada@x.example", "## Heading", None, ""]),
        ("https://x.example/department", ["Name of the Staff: Prof. Cy-Ann Roe; Room 5", "Dr. Nobody Here"]),
        ("https://x.example/faculty/", None),
        (None, ["x"]),
    ]
    got = {r["name"] for r in understanding.name_dictionary(spark.createDataFrame(pages, "url string, lines array<string>"), stop).collect()}
    assert got == {"ada", "lee", "ada lee computer", "ada lee", "deepikak", "deepika", "ann", "roe", "ann roe"}
    texts = spark.createDataFrame([(1, "Tell ADA LEE, or Roe; not adaptive"), (2, None)], "k int, text string")
    names = spark.createDataFrame([(n,) for n in got], "name string")
    assert sorted(tuple(r) for r in understanding.names_in(texts, names, "k").collect()) == [(1, "ada lee", 1), (1, "roe", 4)]
