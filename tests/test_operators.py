"""Automata, readers, writers, streams and ties on small fixtures."""

import json
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra import catalog
from papyra.functions import html, numbers, text, urls
from papyra.operators import chunking, extract, ranking, relational, structure, understanding
from papyra.plans.corpus import Corpus
from papyra.sources import sinks, tables
from papyra.streaming import serving


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_overlapping_chunks_cover_the_text(t, size, overlap):
    chunks = list(chunking.overlapping(t, size, overlap))
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(chunks)) - set(" \n.") == set(t) - set(" \n.")
    assert sum(c.count("a") for c in chunks) >= t.count("a")


def test_overlap_breaks_only_in_the_second_half():
    assert list(chunking.overlapping("aa bbbbbbbbbb", 10, 2)) == ["aa bbbbbbb", "bbbbb"]
    assert list(chunking.overlapping("aaaaaaa bbbb", 10, 2)) == ["aaaaaaa", "aa bbbb"]
    assert list(chunking.overlapping("x" * 10, 10, 3)) == ["x" * 10]


def test_budget_keeps_a_long_line_whole_and_drops_short_chunks():
    lines = ["## A", "x" * 50, "y" * 200, "## B", "short"]
    assert list(chunking.budgeted(lines, 100, 40)) == [("A", "x" * 50), ("A", "y" * 200)]
    assert list(chunking.budgeted(["aaa", "bbb", "c", "## H", "## I", "dddd"], 7, 1)) == [("", "aaa\nbbb"), ("", "c"), ("I", "dddd")]
    assert list(chunking.budgeted([], 7, 1)) == []


def test_tokenisers(spark):
    t = F.lit("Self-learning classes, syllabus; running the Queries of a class")
    assert one(spark, text.tokens_stemmed(t)) == ["learn", "classe", "syllabu", "running", "query", "class", "selflearn"]
    assert one(spark, text.tokens_plural(F.lit("the classes of class"))) == ["classe", "clas"]
    assert one(spark, text.key_values(F.lit("a: 1; b: 2: 3; a: 4"))) == {"a": "4", "b": "2: 3"}
    assert one(spark, text.title_case(F.lit("o'neill-smith data"))) == "O'Neill-Smith Data"


def test_urls(spark):
    assert one(spark, urls.resolved(F.lit("b.pdf#x"), F.lit("https://a.org/d/c.html"))) == "https://a.org/d/b.pdf"
    assert one(spark, urls.resolved(F.lit("//b.org/x"), F.lit("https://a.org/d"))) == "https://b.org/x"
    assert one(spark, urls.kept_url(F.lit("/data.json"), F.lit("https://a.org/"), "a.org", [".js"])) is None
    assert one(spark, urls.unquoted(F.lit("a+b%20c"))) == "a+b c"
    assert one(spark, urls.in_scope(F.lit("https://x.a.org/p.PDF?q=1"), "a.org")) is False
    assert one(spark, urls.page_label(F.lit("https://a.org/"))) == "home"


def test_html(spark):
    page = "<h1>T</h1><script>no</script><table><tr><th>k<th>v<tr><td>a<td></table><p>x <b>y</b><br>z</p><a href='/l'>L</a>"
    rows = spark.createDataFrame([(page,), (None,)], "p string")
    lines = [r[0] for r in rows.select(html.html_to_lines("p")).collect()]
    assert lines == [["## T", "k: a", "x y", "z", "L"], []]
    assert rows.select(html.html_links("p").alias("l")).first()["l"][0]["href"] == "/l"
    assert html.table_lines([["a", "b"], ["1"]]) == ["a", "b", "1"]
    assert html.table_lines([["a", "", "c"], [], ["1", "2", ""], ["", "", ""]]) == ["a: 1; 2"]
    assert html.table_lines([["a", "b"], ["1", "x" * 301]])[:3] == ["a", "b", "1"]
    assert html.table_lines([["a", "b"], ["## h", ""]]) == ["a", "b", "## h"]
    assert html.table_lines([["a"], ["1"]]) == ["a", "1"] and html.table_lines([["a", "b"]]) == ["a", "b"] and html.table_lines([]) == []


def test_boilerplate_needs_five_documents(spark):
    rows = [(i, ["nav", f"line {i}"]) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, lines array<string>")
    assert {tuple(r["lines"]) for r in chunking.drop_boilerplate(df, "id", "lines").collect()} == {(f"line {i}",) for i in range(6)}
    assert chunking.drop_boilerplate(df.where("id < 4"), "id", "lines").first()["lines"][0] == "nav"


def test_outline_and_experiments():
    lines = [(1, "intro"), (1, "1.0 First 6"), (1, "1.1 Unit"), (2, "2.9 foreign"), (2, "References"), (2, "1. book"), (3, "1.2 Again"), (3, "Self-learning topics:"), (3, "cards")]
    (module,) = structure.outline(lines)
    assert (module["title"], module["hours"], module["pages"]) == ("First", 6, [1, 3])[0:2] + (module["pages"],)
    assert module["units"] == [{"number": "1.1", "text": "Unit 2.9 foreign"}, {"number": "1.2", "text": "Again"}]
    assert module["self_learning"] == ["cards"]
    found = structure.experiments(["1 A", "more", "3", "C", "7 skipped", "1 A again"])
    assert found == [{"number": 1, "title": "A again"}, {"number": 3, "title": "C 7 skipped"}]


def test_forward_fill_never_looks_ahead(spark):
    pages = spark.createDataFrame([("f", 1, "intro"), ("f", 2, "CSA101 Data"), ("f", 3, "more"), ("g", 1, "none")], "filename string, page int, text string")
    got = {(r["filename"], r["page"]): r["course_code"] for r in structure.active_course(pages).collect()}
    assert got == {("f", 1): "GLOBAL", ("f", 2): "CSA101", ("f", 3): "CSA101", ("g", 1): "GLOBAL"}
    ranges = structure.course_ranges(pages, F.col("text").startswith("CSA")).collect()
    assert [(r["first_page"], r["last_page"], r["text"]) for r in ranges] == [(2, 3, "CSA101 Data\nmore")]


def test_entities_longest_first(spark):
    queries = spark.createDataFrame([(1, "data tools lab and CSA 103, then tools")], "q int, text string")
    aliases = spark.createDataFrame([("data tools", "A"), ("data tools lab", "B"), ("tools", "C")], "alias string, code string")
    assert understanding.entities(queries, aliases, "q", "text").first()["codes"] == ["B", "CSA103", "C"]


def test_rewrites_are_ordered_and_not_idempotent(spark):
    rules = [(r"\bra\b", "robotics and applications"), (r"\brobotics\b", "robotics lab")]
    assert one(spark, understanding.rewritten(F.lit("RA"), rules)) == "robotics lab and applications"
    table = spark.createDataFrame([(2, "b", "c"), (1, "a", "b")], "ord int, pattern string, replacement string")
    assert understanding.rewritten_by(spark.createDataFrame([("a",)], "text string"), table).first()["rewritten"] == "c"


def test_requests(spark):
    ask = lambda q: one(spark, numbers.selected(numbers.requested(F.lit(q), "experiment"), F.array(*[F.lit(i) for i in range(1, 9)])))
    assert ask("last two experiments") == [7, 8]
    assert ask("experiments 3 to 5") == [3, 4, 5]
    assert ask("2nd and 4th experiments") == [2, 4]
    assert ask("experiments") == list(range(1, 9))


def test_ranks_and_fusions(spark):
    docs = spark.createDataFrame([(1, "red blue"), (2, "red"), (3, None), (4, "red")], "id int, text string").fillna("")
    queries = spark.createDataFrame([(1, "red red"), (2, ""), (3, "absent")], "q int, text string")
    scored = ranking.bm25(docs, queries, "id", "q", text.tokens_unicode)
    top = ranking.top_k(scored, "q", "id", 2).orderBy("rank").collect()
    assert [(r["q"], r["id"]) for r in top] == [(1, 2), (1, 4)]
    assert [r["id"] for r in ranking.top_k(scored, "q", "id", 2, higher_id_first=True).orderBy("rank").collect()] == [4, 2]
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "q int, id int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "q int, id int, rank int")
    fused = {r["id"]: r["score"] for r in ranking.rrf(a, b, "q", "id").collect()}
    assert fused[20] == 1 / 62 + 1 / 61 and fused[10] == 1 / 61
    assert {r["id"]: r["score"] for r in ranking.rrf(a, b, "q", "id", "max").collect()}[20] == 1 / 61


def test_corpus_search(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "id int, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<float>")
    queries = spark.createDataFrame([(-1, "gamma", [0.1, 1.0])], "query_id int, text string, embedding array<float>")
    for mode in ("bm25", "dense", "rrf_sum", "rrf_max"):
        assert Corpus(rows, vectors).search(queries, 1, mode).first()["id"] == 2
    assert Corpus(rows).chunk("fixed", size=5).rows.count() == 4


def test_structured_documents(spark, tmp_path):
    doc = {"schema_version": 1, "document": {"filename": "a.pdf"}, "pages": [{"page_number": 1, "text": " x "}, {"page_number": 2, "text": ""}], "curricula": []}
    (tmp_path / "a_structured.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b_structured.json").write_text("{broken")
    docs = tables.structured_docs(spark, str(tmp_path / "*_structured.json"))
    assert [(r["page"], r["text"]) for r in tables.doc_pages(docs).collect()] == [(1, "x")]
    pages = spark.createDataFrame([("f", "u", "p", "d", 1, "", True), ("f", "u", "p", "d", 2, "t", False)], "filename string, source_url string, program string, department string, page int, text string, has_image boolean")
    made = tables.to_structured(pages).first()
    assert made["document"]["pages_needing_ocr"] == [1] and made["document"]["page_count"] == 2
    assert one(spark, tables.sitemap_urls(F.lit("<loc> a </loc><loc>b</loc>"))) == ["a", "b"]
    assert one(spark, tables.is_pdf(F.lit("%PDF-1").cast("binary"))) is True
    cache = spark.createDataFrame([(2, "2024-01-01 00:00:00"), (1, "2024-01-05 00:00:00"), (2, "2024-01-05 00:00:00")], "version int, saved_at string").withColumn("saved_at", F.to_timestamp("saved_at"))
    assert tables.fresh(cache, 2, F.to_timestamp(F.lit("2024-01-09"))).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    path = str(tmp_path / "t")
    assert (sinks.append_new(rows, path, "id"), sinks.append_new(rows, path, "id")) == (2, 0)
    for kind in ("json", "csv"):
        sinks.export(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert json.loads(sinks.as_json(rows).first()["json"]) == {"id": 1, "v": "a"}
    docs = spark.createDataFrame([("T", "c", None, "x")], "title string, category string, department string, context string")
    assert sinks.manifest(docs).first()["content_for_embedding"] == "Title: T\nCategory: c\nContext: x"


def test_extracts(spark):
    assert one(spark, extract.prerequisites(F.lit("Prerequisites: Nil\nx"))) is None
    assert one(spark, extract.without_sources_tail(F.lit("Answer.\n\nSources:\n- a\n- b"))) == "Answer."
    marked = extract.with_self_learning(F.lit("a\nSelf-learning topics: b"))
    assert one(spark, marked) == one(spark, extract.with_self_learning(marked))
    assert one(spark, extract.course_name(F.lit("CSA101 Data Tools - 3\nx"))) == "Data Tools"
    lines = spark.createDataFrame([("u", 1, "I teach"), ("u", 2, "Subject: Data"), ("u", 3, "after")], "url string, n int, line string")
    assert [r["kind"] for r in extract.profile_lines(lines, "url", "n").orderBy("n").collect()] == ["bio", "course", None]
    assert extract.markdown_table(lines, "url", "n", ["n", "line"]).first()["table"].startswith("| n | line |\n| --- | --- |\n| 1 | I teach |")
    cards = extract.course_card(spark.createDataFrame([("A", "A101 Name 3\nTextbooks\n1. B1\n2. B2")], "code string, text string"), "code").first()
    assert cards["textbooks"] == ["B1", "B2"] and cards["exam_pattern"] == "The general pattern applies."


def test_citations(spark):
    assert one(spark, relational.is_cited(F.lit("https://a.org/data-tools"), F.lit("see data and tools"))) is True
    assert one(spark, relational.is_cited(F.lit("https://a.org/x"), F.lit("nothing"))) is False


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(source)
    read = lambda: spark.readStream.schema("id int, v string").parquet(source)
    for checkpoint in ("c1", "c2"):  # a second run from the start adds nothing
        serving.ingest(read(), out, str(tmp_path / checkpoint), "id").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    requests = str(tmp_path / "requests")
    rows = [("k", "q", "2024-01-01 00:00:00"), ("k", "q", "2024-01-01 00:10:00"), ("k", "q", "2024-01-01 02:00:00")]
    schema = "cache_key string, query string, ts timestamp"
    spark.createDataFrame(rows, "cache_key string, query string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(requests)
    hits = serving.cached_stream(spark.readStream.schema(schema).parquet(requests))
    q = hits.writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert [r["hit"] for r in spark.sql("select * from hits order by ts").collect()] == [False, True, False]
    late = serving.windowed(spark.readStream.schema("ts timestamp, value double").parquet(requests), "ts", "1 hour", None, "10 minutes")
    assert late.isStreaming


def test_entity_codes_look_at_every_place(spark, tmp_path):
    items = [(1, "merge joins"), (2, "sort merge joins")]
    texts = [(1, "word " * 300 + "sort merge joins. " + "word " * 300 + "Merge joins."), (2, "Sort merge joins."), (3, "merge joined")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["codes"] for r in catalog.QUERIES["entity_codes"](spark, str(tmp_path)).collect()}
    assert {k: sorted(v or []) for k, v in got.items()} == {1: ["B1", "B2"], 2: ["B2"], 3: []}


def test_dense_in_blocks_with_ties_and_zero_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(60, 3)), 1)
    vectors[7] = 0
    vectors[20:30] = vectors[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in (3, 7, 20, 41, 59)], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in ranking.dense(rows, queries, "id", "query_id", 6, block=2).collect()}
    for q in (3, 20, 41, 59):
        score = {i: round(float(v @ vectors[q] / np.linalg.norm(v) / np.linalg.norm(vectors[q])), 9) for i, v in enumerate(vectors) if i not in (q, 7)}
        assert [got[q, n] for n in range(1, 7)] == sorted(score, key=lambda i: (-score[i], i))[:6]
    assert [got[7, n] for n in range(1, 7)] == [0, 1, 2, 3, 4, 5]  # no direction, so by key
    assert ranking.dense(rows, queries.limit(0), "id", "query_id", 6).count() == 0


def test_passages_letter_for_letter(spark):
    docs = spark.createDataFrame([(1, "xx one two three yy"), (2, "done two threefold"), (3, "one  two three"), (4, None), (5, "One two three")], "id long, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "two three"), (3, None), (4, "one two three")], "item long, p string")
    assert sorted(tuple(r) for r in relational.passages(docs, items, "id", "text", "item", "p").collect()) == [(1, 1), (1, 2), (4, 1), (4, 2)]


def test_key_values_of_many_keys(spark):
    """Time grows with the pairs, not with their square: 8,000 keys took a minute when each searched all pairs."""
    line = "; ".join(f"k{i % 8000}: {i}" for i in range(16000))
    rows = spark.createDataFrame([("",), (line,)], "t string").localCheckpoint()
    began = time.monotonic()
    found = [r[0] for r in rows.select(text.key_values(F.col("t"))).collect()]
    assert time.monotonic() - began < 30
    assert found == [{}, {f"k{i}": str(i + 8000) for i in range(8000)}]
