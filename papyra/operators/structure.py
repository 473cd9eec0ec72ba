"""Structure of flat text: courses, modules, units, outlines, numbered experiments, program tables.

Line classes and states are column expressions and windows. Only the outline and
the experiment automaton, where a line's meaning depends on the state that earlier
lines left, run over the lines of one document at a time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import forward_filled, islands

COURSE_CODE = r"^\s*([A-Z]{2,6}\s?\d{3}[A-Z]?)\b"
MODULE = r"^\s*([1-9])\.0\s+(.+?)(?:\s+(\d{1,2}))?\s*$"
UNIT = r"^\s*(?:CO\s?\d\s+)?(\d+)\.([1-9]\d*)\s+(\S.*)$"
SELF_LEARNING = r"(?i)^\s*self[- ]?learning"
GENERAL = "GLOBAL"


def page_lines(pages: DataFrame, by: str = "filename") -> DataFrame:
    """One row per line of each page, in order."""
    each = pages.select(by, "page", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return each.withColumn("line", F.trim("line")).where("line <> ''")


def active_course(pages: DataFrame, by: str = "filename", head_lines: int = 30) -> DataFrame:
    """Each page with the course it belongs to: the last one that starts at the head of a page so far."""
    head = F.slice(F.split("text", "\n", -1), F.lit(1), F.lit(head_lines))
    code = F.transform(head, lambda line: F.regexp_replace(F.regexp_extract(line, COURSE_CODE, 1), " ", ""))
    found = F.get(F.filter(code, lambda c: c != ""), 0)
    return forward_filled(pages.withColumn("__code", found), F.col("__code"), "course_code", by, ["page"], GENERAL).drop("__code")


def course_ranges(pages: DataFrame, starts: Column, by: str = "filename") -> DataFrame:
    """Page ranges of courses: from a starting page to before the next one, with the text joined."""
    numbered = islands(pages, starts, [by], ["page"], "section")
    rows = numbered.where("section > 0").groupBy(by, "section").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return rows.select(by, "section", F.element_at("pages", 1)["page"].alias("first_page"), F.element_at("pages", -1)["page"].alias("last_page"), F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"))


def classified(lines: DataFrame) -> DataFrame:
    """Lines with their class, in order of precedence, and the numbers that it carries."""
    line = F.col("line")
    kind = (
        F.when(line.rlike(COURSE_CODE + r"\s*$"), "code")
        .when(line.rlike(SELF_LEARNING), "self_learning")
        .when(line.rlike(MODULE), "module")
        .when(line.rlike(UNIT), "unit")
        .otherwise("content")
    )
    return lines.withColumn("kind", kind)


def syllabus_chunks(pages: DataFrame, by: str = "filename", most_chars: int = 1200) -> DataFrame:
    """Chunks of a syllabus with course, module, unit and section type.

    A unit counts only under the module of its number; other unit-like lines are
    content. A chunk starts at a course, module, unit or self-learning line and is
    split beyond ``most_chars``; its page is that of its first line.
    """
    with_course = active_course(pages, by)
    lines = with_course.select(by, "page", "course_code", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = classified(lines.withColumn("line", F.trim("line")).where("line <> ''"))
    order = ["page", "line_no"]
    in_doc = Window.partitionBy(by).orderBy(*order)
    changed = ~F.col("course_code").eqNullSafe(F.lag("course_code").over(in_doc))
    lines = islands(lines, changed, [by], order, "course_run")
    # The module in force, within the run of one course.
    w = Window.partitionBy(by, "course_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    is_module = F.col("kind") == "module"
    lines = lines.withColumn("module_no", F.last(F.when(is_module, F.regexp_extract("line", MODULE, 1)), True).over(w))
    lines = lines.withColumn("module_name", F.last(F.when(is_module, F.regexp_extract("line", MODULE, 2)), True).over(w))
    foreign = (F.col("kind") == "unit") & ~F.coalesce(F.regexp_extract("line", UNIT, 1) == F.col("module_no"), F.lit(False))
    lines = lines.withColumn("kind", F.when(foreign, "content").otherwise(F.col("kind")))
    lines = lines.withColumn("__starts", changed | F.col("kind").isin("module", "unit", "self_learning"))
    lines = islands(lines, F.col("__starts"), [by], order, "chunk_run")
    # A module line ends the unit before it.
    unit = F.when(F.col("kind") == "unit", F.concat_ws(".", F.regexp_extract("line", UNIT, 1), F.regexp_extract("line", UNIT, 2))).when(is_module, "")
    lines = lines.withColumn("unit_no", F.nullif(F.last(unit, True).over(w), F.lit("")))
    first = F.min(F.struct("page", "line_no", "kind", "course_code", "module_no", "module_name", "unit_no")).alias("f")
    rows = lines.groupBy(by, "chunk_run").agg(first, F.sort_array(F.collect_list(F.struct("page", "line_no", "line"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    section = F.when(F.col("f.kind").isin("module", "unit", "self_learning"), F.col("f.kind")).otherwise("general")
    rows = rows.select(by, "chunk_run", "f.page", "f.course_code", "f.module_no", "f.module_name", "f.unit_no", section.alias("section_type"), (F.col("f.kind") == "self_learning").alias("is_self_learning"), text.alias("text"))
    from .chunking import split_fixed

    rows = rows.select("*", F.posexplode(split_fixed(F.col("text"), most_chars)).alias("piece", "chunk")).drop("text")
    number = F.row_number().over(Window.partitionBy(by).orderBy("chunk_run", "piece")) - 1
    rows = rows.withColumn("chunk_index", number)
    identity = F.concat_ws("_", F.col(by), "course_code", F.coalesce("unit_no", "module_no", F.lit("general")), F.col("chunk_index").cast("string"))
    return rows.withColumn("id", identity).drop("chunk_run", "piece")


_MODULE = re.compile(r"^\s*([1-9])\.0\s+(.+?)(?:\s+(\d{1,2}))?\s*$")
_UNIT = re.compile(r"^\s*(?:CO\s?\d\s+)?(\d+)\.([1-9]\d*)\s+(\S.*)$")
_SELF = re.compile(r"(?i)^\s*self[- ]?learning(?:\s+topics?)?\s*:?\s*(.*)$")
_REFERENCES = re.compile(r"(?i)^\s*(?:text\s?books?|references?|reference\s+books?|online\s+resources?|assessment|end\s+semester)\b")


def outline(lines: list[tuple[int, str]]) -> list[dict]:
    """Modules of one course from its lines in order, each line with its page.

    Book lists are passed over until a module or one of its units resumes.
    """
    modules: list[dict] = []
    skipping = in_self = False
    for page, line in lines:
        if m := _MODULE.match(line):
            modules.append({"number": int(m[1]), "title": m[2].strip(), "hours": int(m[3]) if m[3] else None, "pages": [page], "units": [], "self_learning": [], "description": []})
            skipping = in_self = False
            continue
        if not modules:
            continue
        current = modules[-1]
        unit = _UNIT.match(line)
        own = bool(unit) and int(unit[1]) == current["number"]
        if _REFERENCES.match(line):
            skipping = True
            continue
        if skipping and not own:
            continue
        skipping = False
        if page not in current["pages"]:
            current["pages"].append(page)
        if own:
            in_self = False
            current["units"].append({"number": f"{unit[1]}.{unit[2]}", "text": unit[3].strip()})
        elif s := _SELF.match(line):
            in_self = True
            if s[1].strip():
                current["self_learning"].append(s[1].strip())
        elif in_self:
            current["self_learning"].append(line.strip())
        elif current["units"]:
            current["units"][-1]["text"] += " " + line.strip()
        else:
            current["description"].append(line.strip())
    return modules


OUTLINE_SCHEMA = "number int, title string, hours int, pages array<int>, units array<struct<number:string,text:string>>, self_learning array<string>, description string"


def module_outlines(lines: DataFrame, by: str) -> DataFrame:
    """Modules of each course: its lines, some pages of text, go through the outline automaton in order."""
    ordered = lines.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("page", "line_no", "line"))).alias("ls"))

    @F.pandas_udf(f"array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in OUTLINE_SCHEMA.split(', ')))}>>")
    def modules(courses: pd.Series) -> pd.Series:
        def one(rows) -> list[dict]:
            found = outline([(r["page"], r["line"]) for r in rows])
            return [m | {"description": " ".join(m["description"])} for m in found]

        return courses.map(one)

    return ordered.select(by, F.explode(modules("ls")).alias("m")).select(by, "m.*")


_EXPERIMENT = re.compile(r"^\s*(?:(?:experiment|expt|exp)\.?\s*(?:no\.?\s*)?)?(\d{1,2})\s*[.):-]?(?:\s+(.*\S))?\s*$", re.I)
_EXPERIMENTS_START = re.compile(r"(?i)^\s*(?:list\s+of\s+)?(?:suggested\s+)?(?:experiments|practicals)\s*:?\s*$")
_EXPERIMENTS_END = re.compile(r"(?i)^\s*(?:text\s?books?|references?|assessment|term\s?work)\b")


def experiments(lines: list[str]) -> list[dict]:
    """Numbered experiments of a lab text.

    A number counts if it is 1, the next, or the one after that; a number alone
    waits for its title; other lines continue the title before them. Book lists and
    assessment end the list; where it starts again, it replaces what has the same number.
    """
    found: dict[int, str] = {}
    last, waiting, ended = 0, None, False
    for line in lines:
        if _EXPERIMENTS_END.match(line) or _EXPERIMENTS_START.match(line):
            last, waiting, ended = 0, None, bool(_EXPERIMENTS_END.match(line))
            continue
        if ended:
            continue
        m = _EXPERIMENT.match(line)
        n = int(m[1]) if m else 0
        if m and (n == 1 or (last and n in (last + 1, last + 2))):
            last, waiting = n, None
            if m[2]:
                found[n] = m[2]
            else:
                waiting = n
        elif waiting:
            found[waiting] = line.strip()
            waiting = None
        elif last and last in found:
            found[last] += " " + line.strip()
    return [{"number": n, "title": t} for n, t in sorted(found.items())]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("title", T.StringType())])))
def lab_experiments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: experiments([x for x in (t or "").split("\n") if x.strip()]))


def least_experiments(text: Column) -> Column:
    """The n of "at least n experiments"."""
    return F.regexp_extract(F.lower(text), r"at ?least\s+(\d+)\s+(?:experiments|practicals)", 1).try_cast("int")


def program_rows(lines: DataFrame, by: str) -> DataFrame:
    """Rows of a program table: a line that starts with a code and the lines that continue it, with their numbers parsed.

    The scheme has seven numbers or more (three of hours, then a total), four or
    more, or fewer; the credit is the last. Credits may be decimal or marked.
    """
    starts = F.col("line").rlike(COURSE_CODE)
    rows = islands(lines, starts, [by], ["page", "line_no"], "row_no").where("row_no > 0")
    rows = rows.withColumn("total", F.col("line").rlike(r"(?i)^\s*total\b"))
    joined = rows.groupBy(by, "row_no").agg(F.sort_array(F.collect_list(F.when(~F.col("total"), F.struct("page", "line_no", "line")))).alias("ls"), F.first(F.when(F.col("total"), F.col("line")), True).alias("total_line"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), " ")
    numbers = lambda x: F.transform(F.regexp_extract_all(F.regexp_extract(x, r"((?:\s+[\d.]+[*+#&$]*|\s+-+)+)\s*$", 1), F.lit(r"[\d.]+"), F.lit(0)), lambda n: n.try_cast("double"))
    rows = joined.select(by, "row_no", text.alias("text"), "total_line").withColumn("numbers", numbers(F.col("text")))
    name = F.trim(F.regexp_replace(F.regexp_replace("text", COURSE_CODE, ""), r"(?:\s+[\d.]+[*+#&$]*|\s+-+)+\s*$", ""))
    kind = F.when(F.size("numbers") >= 7, "full").when(F.size("numbers") >= 4, "short").otherwise("credit")
    return rows.select(
        by, "row_no", F.regexp_replace(F.regexp_extract("text", COURSE_CODE, 1), " ", "").alias("code"), name.alias("name"),
        kind.alias("scheme"), "numbers", F.try_element_at("numbers", F.lit(-1)).alias("credits"),
        F.try_element_at(numbers(F.col("total_line")), F.lit(-1)).alias("stated_total"),
    )


def credit_totals(rows: DataFrame, by: str) -> DataFrame:
    """Credits of each table: the stated total, else the sum."""
    return rows.groupBy(by).agg(F.count("*").alias("n_courses"), F.coalesce(F.max("stated_total"), F.sum("credits")).alias("credits"))


#: Headings of a syllabus in the dialect of columns: a module, a unit, and what belongs to neither.
MODULE_LINE = r"^\s*([1-9])\.0\s+(.+?)(?:\s+(\d{1,2}))?\s*$"
UNIT_LINE = r"^\s*(?:CO\s?\d\s+)?(\d+\.[1-9]\d*)\s+(\S.*)$"
ASIDE_LINE = r"(?i)^\s*(?:self[- ]?learning|text\s?books?|references?|reference\s+books?|online\s+resources?|assessment|end\s+semester)\b"


def unit_rows(lines: DataFrame, by: str) -> DataFrame:
    """``by, module, title, unit, text``: the units of each module, with the lines that continue them.

    A unit belongs to the module in whose interval it lies, from its heading to
    the next one; a number of another module is no unit there and continues the
    line before, as any other line does. Headings of books, exams and
    self-learning end a unit. Windows and a grouping, so lines of a file of any
    length are sorted on disk.
    """
    w = Window.partitionBy(by).orderBy("page", "line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    opens = line.rlike(MODULE_LINE)
    own = F.when(opens, F.struct(F.regexp_extract(line, MODULE_LINE, 1).alias("module"), F.regexp_extract(line, MODULE_LINE, 2).alias("title")))
    rows = lines.select(by, "page", "line_no", "line").withColumn("m", F.last(own, ignorenulls=True).over(so_far)).where("m is not null")
    unit = F.regexp_extract(line, UNIT_LINE, 1)
    kind = F.when(opens, "module").when((unit != "") & (F.substring_index(unit, ".", 1) == F.col("m.module")), "unit").when(line.rlike(ASIDE_LINE), "aside")
    rows = rows.withColumn("kind", kind).withColumn("island", F.count("kind").over(so_far))
    parts = F.array_sort(F.collect_list(F.struct("page", "line_no", F.when(F.col("kind") == "unit", F.regexp_extract(line, UNIT_LINE, 2)).otherwise(F.trim(line)).alias("line"))))
    found = rows.groupBy(by, "island").agg(F.max("kind").alias("kind"), F.max("m").alias("m"), F.max(F.when(F.col("kind") == "unit", unit)).alias("unit"), parts.alias("parts")).where("kind = 'unit'")
    return found.select(by, F.col("m.module").cast("int").alias("module"), "m.title", "unit", F.array_join(F.transform("parts", lambda p: p["line"]), " ").alias("text"))


def requested_units(query: Column) -> Column:
    """Numbers of units, as 2.1, that a query names after unit, topic or section."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"\b(?:units?|topics?|sections?)\s+(?:no\.?\s+)?(\d+\.\d+)\b"), F.lit(1)))
