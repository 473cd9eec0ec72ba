"""Outlines and facts of one authored course, laboratory and programme, line by line."""

import pytest
from pyspark.sql import functions as F

from papyra.functions import numbers
from papyra.operators import extract, sections, structure, understanding

PHRASES = [
    ("show the first three modules", "first", "1,2,3"),
    ("last 2 modules please", "last", "5,6"),
    ("modules between 2 and 4", "range", "2,3,4"),
    ("explain modules 1-3", "range", "1,2,3"),
    ("modules 2, 5 and 6", "list", "2,5,6"),
    ("3rd and 6th modules", "list", "3,6"),
    ("module 4", "list", "4"),
    ("the whole course", "all", "1,2,3,4,5,6"),
]
SEMESTERS = [("semester iii to v", [3, 4, 5]), ("sem 2 and sem 7", [2, 7]), ("third semester", [3]), ("semester 8", [8]), ("no term named", [])]
COURSE = """CSA101 Data Tools
Prerequisites: Algebra, Logic and Sets
1.0 Records 6
1.1 Rows and columns
continued over lines
802.11 a foreign number
CO1 1.2 Keys
Self-learning topics: Index cards
2.0 Joins 8
2.1 Hash joins
Text Books
1. First book
second line
2. Other book
References
1) A paper
2.2 Sort joins
End Semester Exam Pattern: six questions, four to answer
Assessment: two tests of twenty marks
Scheme: 3 2 - 3 1 - 4"""
LAB = """Experiments
1 Load a table
with many rows
2
Join two tables
4 Window sums
9 out of order
References
1. A manual"""
PROGRAM = """Semester III
CSA101 Data Tools 3 2 1 3 1 1 5
CSA102 Query Languages
and Engines 3 1 - 4
CSA103 Project 2.5*
Total 11.5"""
QUESTIONS = [("which textbooks", "all_pages"), ("list lab experiments", "lab_pages"), ("module 3 please", "outlines"), ("all topics", "module_pages"), ("tell me more", "pages")]


def text_of(spark, text):
    return spark.createDataFrame([("f", 1, text)], "filename string, page int, text string")


def lines_of(spark, text):
    return structure.page_lines(text_of(spark, text))


def test_numbers_asked_for(spark):
    rows = spark.createDataFrame([(p,) for p, _, _ in PHRASES], "phrase string").withColumn("r", numbers.requested(F.col("phrase"), "module"))
    got = rows.select("phrase", "r.kind", numbers.selected(F.col("r"), F.array(*[F.lit(i) for i in range(1, 7)])).alias("n")).collect()
    assert [(r["phrase"], r["kind"], ",".join(map(str, r["n"]))) for r in got] == PHRASES
    rows = spark.createDataFrame([(p,) for p, _ in SEMESTERS], "phrase string").select("phrase", understanding.requested_semesters(F.col("phrase")).alias("n"))
    assert [(r["phrase"], r["n"]) for r in rows.collect()] == SEMESTERS


def test_facts_of_a_course(spark):
    t = F.col("text")
    part = extract.between_headings(t, r"text\s?books?")
    row = text_of(spark, COURSE).select(extract.numbered_items(part).alias("books"), extract.exam_pattern(t).alias("exam"), extract.assessment(t).alias("assessed"),
        extract.prerequisites(t).alias("needs"), extract.scheme(t, "scheme").alias("s"), F.size(extract.scheme_numbers(t, "scheme")).alias("n")).first()
    assert row["books"] == ["First book second line", "Other book"] and row["exam"] == "six questions, four to answer"
    assert row["assessed"] == "two tests of twenty marks" and row["needs"] == ["Algebra", "Logic", "Sets"]
    assert (row["s"]["theory"], row["s"]["practical"], row["s"]["credits"], row["n"]) == (3.0, 2.0, 4.0, 5)


def test_modules_and_chunks(spark):
    got = structure.module_outlines(lines_of(spark, COURSE), "filename").orderBy("number").collect()
    told = [(r["number"], r["title"], r["hours"], [(u["number"], u["text"]) for u in r["units"]], list(r["self_learning"])) for r in got]
    # What follows a heading of its own belongs to no unit.
    assert told == [
        (1, "Records", 6, [("1.1", "Rows and columns continued over lines 802.11 a foreign number"), ("1.2", "Keys")], ["Index cards"]),
        (2, "Joins", 8, [("2.1", "Hash joins"), ("2.2", "Sort joins")], []),
    ]
    chunks = structure.syllabus_chunks(text_of(spark, COURSE)).orderBy("chunk_index").collect()
    assert [(r["section_type"], r["module_no"], r["unit_no"]) for r in chunks] == [
        ("general", None, None), ("module", "1", None), ("unit", "1", "1.1"), ("unit", "1", "1.2"), ("self_learning", "1", "1.2"), ("module", "2", None), ("unit", "2", "2.1"), ("unit", "2", "2.2"),
    ]


def test_laboratory_and_programme(spark):
    rows = text_of(spark, LAB).select(F.explode(structure.lab_experiments("text")).alias("e")).select("e.number", "e.title").collect()
    assert [tuple(r) for r in rows] == [(1, "Load a table with many rows"), (2, "Join two tables"), (4, "Window sums 9 out of order")]
    courses = structure.program_rows(lines_of(spark, PROGRAM), "filename")
    assert sorted((r["code"], r["name"], r["scheme"], float(r["credits"])) for r in courses.collect()) == [
        ("CSA101", "Data Tools", "full", 5.0), ("CSA102", "Query Languages and Engines", "credit", 4.0), ("CSA103", "Project", "credit", 2.5),
    ]
    assert [(r["n_courses"], float(r["credits"])) for r in structure.credit_totals(courses, "filename").collect()] == [(3, 11.5)]


@pytest.mark.parametrize("question, pages", QUESTIONS)
def test_routes(spark, question, pages):
    assert spark.range(1).select(sections.routed(F.lit(question))).first()[0] == pages


def test_lab_pages_and_semesters(spark):
    rows = spark.createDataFrame([("f", 1, "one"), ("f", 2, "three\nAssessment: x"), ("f", 3, "gone")], "filename string, page int, text string")
    assert sorted((r["page"], r["text"].strip()) for r in sections.lab_text(rows, "filename", "page").collect()) == [(1, "one"), (2, "three")]
    pages = spark.createDataFrame([("a.pdf", 1, "Semester III and Sem IV"), ("a.pdf", 2, "no term"), ("a.pdf", 10, "Semester I"), ("b.pdf", 1, "SEM-VIII")], "filename string, page int, text string")
    marked = sections.semester_markers(pages, spark.createDataFrame([(10, 4)], "page int, semester int"))
    asked = spark.createDataFrame([(1, [4]), (2, [8])], "q int, semesters array<int>")
    assert sorted(tuple(r) for r in sections.semester_pages(marked, asked, "q").collect()) == [(1, "a.pdf", 1), (1, "a.pdf", 10), (2, "b.pdf", 1)]


def test_units_within_modules(spark):
    """As in the outline, by windows: a number of another module is no unit, and headings end one."""
    got = sorted((r["module"], r["title"], r["unit"], r["text"]) for r in structure.unit_rows(lines_of(spark, COURSE), "filename").collect())
    assert got == [
        (1, "Records", "1.1", "Rows and columns continued over lines 802.11 a foreign number"), (1, "Records", "1.2", "Keys"), (2, "Joins", "2.1", "Hash joins"), (2, "Joins", "2.2", "Sort joins"),
    ]
    rows = spark.createDataFrame([("Unit 2.1 and topic 3.10, not 4.1",), ("units no. 1.2; unit 1.2",), ("module 2",), (None,)], "q string")
    assert [r[0] for r in rows.select(structure.requested_units(F.col("q"))).collect()] == [["2.1", "3.10"], ["1.2"], [], None]


def test_sections_share_words_or_codes(spark):
    """Counts by a join on words give the scores of whole lists, for those that the gate lets through."""
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    some = lambda n: sorted(rng.sample(words, rng.randint(0, n)))
    docs = [(i, rng.choice(["c1", "C2"]), some(3), some(8), some(3)) for i in range(40)]
    queries = [(i, sorted({*some(5), *rng.choice([[], ["c1"], ["c2"]])})) for i in range(20)]
    got = sections.matched_sections(spark.createDataFrame(queries, "q int, words array<string>"), spark.createDataFrame(docs, "d int, code string, title array<string>, content array<string>, modules array<string>"), "q", "d")
    want = {}
    for q, asked in queries:
        for d, code, title, content, modules in docs:
            t, c, m = (len({*asked} & {*x}) for x in (title, content, modules))
            named = code.lower() in asked
            if t or m or named:
                name = 60.0 if title and t == len(title) else 40.0 if t >= 2 and t / len(title) >= 0.66 else 0.0
                want[q, d] = (name, name + 2 * c + 1.5 * m + 100 * named)
    assert {(r["q"], r["d"]): (r["name_boost"], r["section_score"]) for r in got.collect()} == want
