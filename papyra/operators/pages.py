"""Short representations of whole pages for an answer: profiles by section, rosters, or the text itself.

A page is a row ``url, lines``; what found it are ``hits``, passages of the page in
order of rank. Parts are ranked and share a budget of characters: each part is
taken whole while the sum so far is within it, and the one that crosses is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_values

MOST_CHARS = 4000
#: Characters that have to be left for passages beside a profile.
LEAST_LEFT = 300
INTRO_LINES = 10
ROSTER_INTRO, PAGE_INTRO = 400, 600
SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Section:
    """A heading, which lines belong below it, and how each is shown."""

    heading: str
    holds: Callable[[Column], Column]
    shown: Callable[[Column], Column]
    #: Title and rule of a table, if its lines are rows of one.
    head: str = ""


def trimmed(x: Column) -> Column:
    return F.trim(x, F.lit(SPACE))


def listed(x: Column) -> Column:
    return F.concat(F.lit("- "), x)


def holds_any(x: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(x, F.lit(w))
    return found


def field(values: Column, name: str) -> Column:
    """A value of ``a: 1; b: 2``, the empty string if it is not given."""
    return F.trim(F.coalesce(F.try_element_at(values, F.lit(name)), F.lit("")))


def bracketed(before: str, value: Column, after: str = ")") -> Column:
    """The value between two strings, or nothing for no value."""
    return F.when(value == "", "").otherwise(F.concat(F.lit(before), value, F.lit(after)))


def repaired(x: Column) -> Column:
    """Dashes and spaces that were decoded as if they were one-byte characters."""
    return F.trim(F.replace(F.replace(x, F.lit("Ã¢â¬â"), F.lit("-")), F.lit("Â"), F.lit("")))


def table_row(names: list[str | tuple[str, str]]) -> Callable[[Column], Column]:
    """A line ``a: 1; b: 2`` as a row of these fields; a pair is the first with the second in brackets. Other lines fill the first field."""

    def shown(line: Column) -> Column:
        clean = repaired(line)
        values = key_values(clean)
        cells = []
        for name in names:
            if isinstance(name, str):
                cells.append(F.replace(field(values, name), F.lit("|"), F.lit("-")))
            else:
                a, b = (F.replace(field(values, n), F.lit("|"), F.lit("-")) for n in name)
                cells.append(F.when((a != "") & (b != ""), F.concat(a, F.lit(" ("), b, F.lit(")"))).when(a != "", a).when(b != "", b).otherwise("-"))
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        plain = F.concat(F.lit("| "), F.replace(clean, F.lit("|"), F.lit("-")), F.lit(" | -" * (len(names) - 1) + " |"))
        return F.when(F.contains(clean, F.lit(": ")) & F.contains(clean, F.lit(";")), row).otherwise(plain)

    return shown


def _work(line: Column) -> Column:
    v = key_values(line)
    start, stop = field(v, "From Date"), field(v, "To Date")
    dates = F.when((start != "") & (stop != ""), F.concat(F.lit(" (From: "), start, F.lit(" to "), stop, F.lit(")"))).otherwise(bracketed(" (From: ", start))
    return listed(F.concat(field(v, "Designation"), F.lit(" at "), field(v, "Organization"), bracketed(" (", field(v, "Organization Address")), dates))


def _award(line: Column) -> Column:
    v = key_values(line)
    titled = F.concat(F.lit("**"), field(v, "Award Title"), F.lit("**"), bracketed(" (Awarded by: ", field(v, "Awarded By")), bracketed(" - ", field(v, "Year"), ""))
    return listed(F.when(F.contains(line, F.lit("Award Title:")), titled).when(field(v, "Details") != "", field(v, "Details")).otherwise(line))


def _course(line: Column) -> Column:
    return listed(F.trim(F.replace(F.replace(line, F.lit("; Material URL: View Material"), F.lit("")), F.lit("Course Title:"), F.lit(""))))


#: Headings of a profile, labels that its lines begin with, columns of its tables, lines that are navigation.
OVERVIEW = "### Overview & Academic Background"
EXTRA = "### Additional Relevant Records"
ROSTER = "### Faculty Roster"
ROSTER_LABEL = "Name of the Staff:"
PROFILE_PART = "/faculty/"
COURSES = "### Teaching Responsibilities (Courses Taught)"
WORK = "### Work Experience"
AWARDS = "### Awards, Honors & Achievements"
PUBLICATIONS = "### Research and Publications"
DEVELOPMENT = "### Professional Development (Workshops, Training Programs, FDPs & STTPs)"
PUBLICATION_HEAD = "| Title | Type | Level | Academic Year | Date |\n|---|:---:|:---:|:---:|:---:|"
DEVELOPMENT_HEAD = "| Program / Workshop Title | Type | Role / Level | Venue | Date |\n|---|:---:|:---:|---|:---:|"
PUBLICATION_TYPES = ["Type: Journal", "Type: Proceedings", "Type: Book", "Type: Conference", "Level: National", "Level: International"]
HONOURS = ["Badge", "Certificate", "Award", "Academic Year:", "Co-curricular"]
NAVIGATION = """
courses publications papers participations awards assignments achievements date title presented/published level
""".split() + ["material url: view material", "academic year", "organizer / venue"]
NO_NAMES = "faculty mam sir prof professor dr tell about who details info experience qualification publications".split()

#: A line belongs to the first section in this order that holds it.
PROFILE = [
    Section(WORK, lambda s: s.startswith("From Date:"), _work),
    Section(AWARDS, lambda s: s.startswith("Year:") | F.contains(s, F.lit("Award")) | F.contains(s, F.lit("Secured Best")), _award),
    Section(COURSES, lambda s: s.startswith("Course Title:"), _course),
    Section(PUBLICATIONS, lambda s: s.startswith("Date:") & holds_any(s, PUBLICATION_TYPES), table_row(["Title", "Type", "Level", "Academic Year", "Date"]), PUBLICATION_HEAD),
    Section(DEVELOPMENT, lambda s: s.startswith("Date:"), table_row(["Title", "Type", ("Role", "Level"), "Venue", "Date"]), DEVELOPMENT_HEAD),
    Section(AWARDS, lambda s: F.contains(s, F.lit("Type: ")) & holds_any(s, HONOURS), _award),
]
#: The order in which a profile shows them.
SHOWN = [COURSES, WORK, AWARDS, PUBLICATIONS, DEVELOPMENT]


def profile(lines: Column, sections: list[Section] = PROFILE, order: list[str] = SHOWN, overview: str = OVERVIEW, skipped: list[str] = NAVIGATION) -> Column:
    """Sections of a page's lines, with headings; lines before the first that belongs to one are the overview, later ones that belong to none go."""

    def placed(s: Column) -> Column:
        heading, shown = F.lit(None).cast("string"), s
        for section in reversed(sections):
            heading = F.when(section.holds(s), section.heading).otherwise(heading)
            shown = F.when(section.holds(s), section.shown(s)).otherwise(shown)
        return F.struct(heading.alias("heading"), shown.alias("shown"))

    kept = F.filter(F.transform(lines, trimmed), lambda s: (s != "") & ~F.lower(s).isin(skipped))
    told = F.transform(kept, placed)
    heads = {s.heading: s.head for s in sections if s.head}

    def rendered(rows: Column) -> Column:
        known = F.array_position(F.transform(rows, lambda r: r["heading"].isNotNull()), F.lit(True)).cast("int")
        before = F.when(known == 0, rows).otherwise(F.slice(rows, 1, F.greatest(known - 1, F.lit(0))))
        of = lambda heading: F.filter(rows, lambda r: r["heading"].eqNullSafe(F.lit(heading)))
        parts = [(overview, "", before), *[(h, heads.get(h, ""), of(h)) for h in order]]
        texts = []
        for heading, head, own in parts:
            text = F.concat(F.lit(f"{heading}\n{head}\n" if head else f"{heading}\n"), F.array_join(F.transform(own, lambda r: r["shown"]), "\n"))
            texts.append(F.when(F.size(own) > 0, text))
        return F.concat_ws("\n\n", *texts)

    # A lambda over an array of one binds the classified lines, so that they are classified once.
    return F.get(F.transform(F.array(told), rendered), F.lit(0))


def _with_passages(base: Column, hits: Column, most: int) -> Column:
    """The base and, if enough is left, the passages whose first line it lacks."""
    left = F.lit(most) - F.length(base)
    first = lambda h: trimmed(F.substring_index(h, "\n", 1))
    extra = F.filter(hits, lambda h: (first(h) != "") & ~F.contains(base, first(h)))
    added = F.concat(base, F.lit(f"\n\n{EXTRA}\n"), trimmed(F.left(F.array_join(extra, "\n\n"), left)))
    return F.when((left > LEAST_LEFT) & (F.size(extra) > 0), added).otherwise(base)


def _roster(lines: Column, query: Column, label: str, most: int) -> Column:
    staff = F.filter(F.transform(lines, trimmed), lambda s: s.startswith(label))
    names = F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(NO_NAMES))
    named = lambda s: F.exists(names, lambda w: F.contains(F.lower(s), w))
    ordered = F.concat(F.filter(staff, named), F.filter(staff, lambda s: ~named(s)))
    return F.concat(_intro(lines, ROSTER_INTRO), F.lit(f"\n\n{ROSTER}\n"), F.array_join(ordered, "\n"))


def _intro(lines: Column, most: int) -> Column:
    return trimmed(F.left(F.array_join(F.slice(lines, 1, INTRO_LINES), "\n"), F.lit(most)))


def _generic(lines: Column, hits: Column, most: int) -> Column:
    whole, passages, intro = F.array_join(lines, "\n"), F.array_join(hits, "\n\n"), _intro(lines, PAGE_INTRO)
    opened = (intro != "") & ~F.contains(passages, F.substring_index(intro, "\n", 1))
    long = (F.size(hits) > 0) & (F.length(whole) > most)
    return F.when(long & opened, F.concat(intro, F.lit("\n\n"), passages)).when(long, passages).otherwise(whole)


def represented(
    pages: DataFrame, most: int = MOST_CHARS, is_profile: Column | None = None, label: str = ROSTER_LABEL, sections: list[Section] = PROFILE, order: list[str] = SHOWN, name: str = "shown"
) -> DataFrame:
    """``pages`` with ``kind`` and what is shown of each: rows ``url, lines, hits, query, fallback``.

    Profiles are pages whose URL has the profiles' part; a roster is a page with
    lines of its label. A page without lines shows its fallback. Null lists and
    texts count as empty.
    """
    lines, hits = F.coalesce("lines", F.array().cast("array<string>")), F.coalesce("hits", F.array().cast("array<string>"))
    query, fallback = F.coalesce("query", F.lit("")), F.coalesce("fallback", F.lit(""))
    is_profile = F.contains(F.lower("url"), F.lit(PROFILE_PART)) if is_profile is None else is_profile
    is_roster = F.exists(lines, lambda s: trimmed(s).startswith(label))
    kind = F.when(F.size(lines) == 0, "fallback").when(F.coalesce(is_profile, F.lit(False)), "profile").when(is_roster, "roster").otherwise("generic")
    base = F.transform(F.array(profile(lines, sections, order)), lambda b: _with_passages(b, hits, most))
    shown = F.when(F.col("kind") == "fallback", fallback).when(F.col("kind") == "profile", F.get(base, F.lit(0))).when(F.col("kind") == "roster", _roster(lines, query, label, most))
    return pages.withColumn("kind", kind).withColumn(name, trimmed(F.left(shown.otherwise(_generic(lines, hits, most)), F.lit(most))))
