"""Representations of pages: a staff profile line by line, rosters, budgets."""

import itertools

import duckdb

from papyra import catalog
from papyra.operators import pages

SCHEMA = "url string, lines array<string>, hits array<string>, query string, fallback string"

PROFILE = [
    " Dr. Ada Example ", "Courses", "PhD in logic", "Course Title: Joins; Material URL: View Material", "Level",
    "From Date: 2001; To Date: 2005; Designation: Lecturer; Organization: North College; Organization Address: Hill Road",
    "From Date: 2006; Designation: Reader; Organization: South College", "a late line of the overview",
    "Year: 2010; Award Title: Best Paper; Awarded By: A Society", "Award for teaching", "Year: 2011; Details: Prize draw",
    "Date: 2012; Title: On | joins; Type: Journal; Level: National; Academic Year: 2011-12", "Date: plain; Type: Bookish",
    "Date: 2013; Title: Summer school; Type: STTP; Role: Speaker; Level: State; Venue: Hall", "Date: 2014; Title: Winter school; Type: FDP; Level: State",
    "Type: Badge; Details: Gold", "",
]
SHOWN = """### Overview & Academic Background
Dr. Ada Example
PhD in logic

### Teaching Responsibilities (Courses Taught)
- Joins

### Work Experience
- Lecturer at North College (Hill Road) (From: 2001 to 2005)
- Reader at South College (From: 2006)

### Awards, Honors & Achievements
- **Best Paper** (Awarded by: A Society) - 2010
- Award for teaching
- Prize draw
- Gold

### Research and Publications
| Title | Type | Level | Academic Year | Date |
|---|:---:|:---:|:---:|:---:|
| On - joins | Journal | National | 2011-12 | 2012 |
|  | Bookish |  |  | plain |

### Professional Development (Workshops, Training Programs, FDPs & STTPs)
| Program / Workshop Title | Type | Role / Level | Venue | Date |
|---|:---:|:---:|---|:---:|
| Summer school | STTP | Speaker (State) | Hall | 2013 |
| Winter school | FDP | State |  | 2014 |"""


def shown(spark, *rows, **options):
    got = pages.represented(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + SCHEMA), **options).orderBy("n").collect()
    return [(r["kind"], r["shown"]) for r in got]


def test_profile(spark):
    url = "https://example.com/Faculty/ada"
    passages = ["Joins\nold news", "New record\nwith more", ""]
    added = SHOWN + "\n\n### Additional Relevant Records\nNew record\nwith more"
    rows = [(url, PROFILE, [], "", ""), (url, PROFILE, passages, "", ""), (url, PROFILE, None, None, None), (url, [], ["x"], "", " left over "), (None, None, None, None, None)]
    assert shown(spark, *rows) == [("profile", SHOWN), ("profile", added), ("profile", SHOWN), ("fallback", "left over"), ("fallback", "")]
    # The budget cuts the part that crosses it, and leaves no room for passages.
    for most in (10, 60, 200, len(SHOWN) - 1, len(SHOWN) + 300, len(SHOWN) + 301):
        want = SHOWN[:most].strip() if most <= len(SHOWN) + 300 else added[:most].strip()
        assert shown(spark, rows[1], most=most) == [("profile", want)]


def test_roster_and_generic(spark):
    staff = ["Home", "Name of the Staff: Ben One", " Name of the Staff: Cy Two", "end"]
    intro = "Home\nName of the Staff: Ben One\n Name of the Staff: Cy Two\nend\n\n### Faculty Roster\n"
    named = intro + "Name of the Staff: Cy Two\nName of the Staff: Ben One"
    plain = intro + "Name of the Staff: Ben One\nName of the Staff: Cy Two"
    rows = [("u", staff, [], "tell about CY two", ""), ("u", staff, [], "who is dr", ""), ("u", staff, [], None, "")]
    assert shown(spark, *rows) == [("roster", named), ("roster", plain), ("roster", plain)][:2] + [("roster", plain)]
    lines = [f"line {i} of the page" for i in range(40)]
    whole, first = "\n".join(lines), "\n".join(lines[:10])
    rows = [("u", lines, [], "", ""), ("u", lines, ["passage one", "two"], "", ""), ("u", lines, ["line 0 of the page again"], "", ""), ("u", lines[:2], ["p"], "", "")]
    want = [whole[:300].strip(), (first + "\n\npassage one\n\ntwo")[:300].strip(), "line 0 of the page again", "\n".join(lines[:2])]
    assert [s for _, s in shown(spark, *rows, most=300)] == want


def test_any_sections(spark):
    """The first section in order that holds a line takes it, whatever order they are shown in."""
    from pyspark.sql import functions as F

    even = pages.Section("E", lambda s: s.rlike("[02468]$"), lambda s: F.concat(F.lit("e"), s))
    three = pages.Section("T", lambda s: s.cast("int") % 3 == 0, lambda s: s, "h")
    for first, order in itertools.product([[even, three], [three, even]], [["E", "T"], ["T", "E"]]):
        held = {"E": [], "T": []}
        for i in range(1, 13):
            own = next((s.heading for s in first if (i % 2 == 0 if s is even else i % 3 == 0)), None)
            if own:
                held[own].append(f"e{i}" if own == "E" else str(i))
        want = "O\n1\n\n" + "\n\n".join((f"{h}\nh\n" if h == "T" else f"{h}\n") + "\n".join(held[h]) for h in order)
        row = spark.createDataFrame([([str(i) for i in range(1, 13)],)], "lines array<string>")
        assert row.select(pages.profile(F.col("lines"), first, order, "O")).first()[0] == want


def test_read_pages(spark):
    from papyra.operators import extract

    held = spark.createDataFrame([("https://h/a/", ["## Title", "body text", "### Sub"]), ("https://h/e", []), ("https://h/n", None)], "url string, lines array<string>")
    asked = spark.createDataFrame([(1, "https://h/a#x", 0), (2, "https://h/a", 10), (3, "https://h/a", 500), (4, "https://h/zzz", 0), (5, "https://h/e", 0), (6, None, 0), (7, "https://h/a", 15)], "n int, url string, offset int")
    got = {r["n"]: r["piece"] for r in extract.read_pages(asked, held, 10).collect()}
    text = "TITLE\nbody text\n### Sub"
    assert got == {
        1: text[:10] + "\n\n[Continues at offset 10.]", 2: text[10:20] + "\n\n[Continues at offset 20.]", 3: "No more content.", 4: extract.NOT_FOUND, 5: "No more content.", 6: extract.NOT_FOUND,
        7: text[15:],
    }


def test_hidden_calls(spark):
    from papyra.streaming import serving

    streams = {
        1: ["a ", "<tool_call>", "x", "</tool_call>", " b"],
        2: ["a<tool", "_call>x</to", "ol_call>", "c", "<tool_call>never closed", "d"],
        3: ["plain </tool_call> text", None, "end"],
        4: ["<tool_call>x</tool_call>kept?", "yes", "<tool_call>", "y", "</tool_call>", "z"],
    }
    rows = [(i, n, t) for i, ts in streams.items() for n, t in enumerate(ts)]
    got = {}
    for r in serving.visible_tokens(spark.createDataFrame(rows, "id int, n int, t string").repartition(3), "id", "n", "t").orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["token"])
    assert got == {1: ["a ", " b"], 2: ["a<tool", "c"], 3: ["plain </tool_call> text", "", "end"], 4: ["yes", "z"]}


def test_page_shown_keeps_digits_of_lines(spark, tmp_path):
    # A line that ends in the number of its place, and spaces around lines of any place.
    html = "<title>None of it</title><p> first of 0 </p><p>16.155.205.171</p><p>  ends in 2</p><p>3 begins and ends 33 </p>"
    spark.createDataFrame([(1, "http://a.example/en/1/", html), (2, "http://a.example/de/1/", html)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES["page_shown"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["page_shown"](spark, str(tmp_path)).collect()) == want
