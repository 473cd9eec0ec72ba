"""What queries ask for: topics found by one automaton, and intents as formulas over topics.

A topic is a set of phrases; an intent holds if one of its topics is named, all of
those it needs, and none of those it excludes. Phrases are compared word by word,
a word being a run of a-z and 0-9 after lower-casing. All phrases of all topics
are one automaton for each task, and a text is passed through it once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.numbers import ROMANS

#: The phrases of each topic, by the alphabet. ``~`` after a word allows a plural s, ``*`` any ending.
PHRASES = {
    "activity": "activities, activity",
    "aim": "aim~, objective~",
    "all": "all",
    "asking": "are, can, do, does, how, is, tell me about, what is, when, whether, which, who, why",
    "assessment": "assess*, ciap, criteria, ese, esep, evaluat*, exam*, grade~, graded, grading, ise, mark~, mse, scheme, term work, weightage",
    "assignment": "assignment~",
    "available": "course~ at, course~ available, course~ in, course~ offered, program~ at, program~ available, program~ in, program~ offered",
    "book": "bibliography, book~, reading, reference~, textbook~",
    "both": "both",
    "content": "course content, course outline, curriculum, syllabus",
    "count": "count, how many, how much, number of, total number",
    "course": "course~, subject~",
    "credit": "credit~",
    "credit share": "credit~ distribution, credit~ for degree, credit~ for engineering, credit~ for program, credit~ for the degree, credit~ for the program, degree credit~, total credit~",
    "degree": "b tech, btech, degree, engineering, program",
    "department": "ai, aids, aiml, computer, ecs, electronics, extc, information, it, mech, mechanical",
    "deployment": "cloud, deploy*, hosting, prototype",
    "detail": "describe, detail~",
    "each": "all course~, all subject~, detailed module, detailed syllabus, each subject, every subject, module wise, modulewise, syllabus for each",
    "elective": "elective~, mdm~, minor~, multidisciplinary",
    "exam scheme": "assessment scheme, ese, evaluation scheme, exam scheme, examination scheme, ise, marks distribution, mse",
    "experiment": "exp~, experiment~, prac~, practical~, task~",
    "full": "complete, full, overall",
    "guide": "guideline~, instruction~, procedure, process, rule~, selection, step~, topic~",
    "hours": "contact hour~, hours per week, lecture hour~, teaching scheme",
    "info": "about, details, explain, give, info, information, overview, summary, what is",
    "lab": "lab~, laboratory",
    "listing": "give me, list, show me, what are the",
    "module": "module~, unit~",
    "mixed": "lab and subject, lab and theory, subject and lab, theory and lab",
    "online": "online",
    "only lab": "lab course~, lab subject~, only lab~, practical subject~, practical~",
    "only theory": "only theory, theory course~, theory subject~",
    "oral": "oral, presentation, rubric~, viva",
    "outcome": "co~, outcome~",
    "people": "faculty, head, hod, professor, staff, teacher",
    "reading": "reading",
    "refer": "refer",
    "reference": "reference~",
    "scheme": "all course~, all subject~, credit distribution, curriculum structure, program structure, teaching scheme, total credit~",
    "structure": "course structure, curriculum structure, program structure, structure, subject structure, teaching scheme",
    "studies": "branches, degrees, intake, postgraduate, ug and pg, undergraduate",
    "study": "coursera, learn, link~, material~, nptel, resource~, study, video~, where",
    "teaching term": "chapter~, goal~, prerequisite~, purpose, section~, self learning, topic~",
    "team": "group~, how many students, number of students, team~",
    "text": "text book~, textbook~",
    "theory": "theory",
    "tool": "hardware tool~, online resource~, software tool~, tool~, useful link~, web resource~",
    "whole": "altogether, complete, entire, four years, in total, overall, total, whole",
    "whole structure": "all course~, all subject~, course structure, curriculum structure, program structure, teaching scheme",
}
#: Subjects that are numbered, and words for a half-year.
NUMBERED = "applied bee chemistry graphics math mathematics mechanics part physics project sem semester".split()
TERMS = "sem semester term".split()
_ENDINGS = {1: "st", 2: "nd", 3: "rd"}
_PLACES = {n: [str(n), f"{n}{_ENDINGS.get(n, 'th')}", roman] for roman, n in ROMANS.items() if n <= 8}


def _built() -> dict[str, str]:
    """Topics whose phrases follow from a rule: a semester, a range of semesters, a subject's first part."""
    semester = [f"{t} {p}" for t in TERMS for own in _PLACES.values() for p in own] + [f"{p} {t}" for t in TERMS for own in _PLACES.values() for p in own]
    spans = [f"{t} {a} to {b}" for t in [*TERMS, "semesters", "sems"] for i in (0, 2) for x, a in ((n, own[i]) for n, own in _PLACES.items()) for y, b in ((n, own[i]) for n, own in _PLACES.items()) if x < y]
    return {"semester": ", ".join(semester), "semesters": ", ".join(spans), "first part": ", ".join(f"{w} {p}" for w in NUMBERED for p in ("1", "i"))}


@dataclass(frozen=True)
class Intent:
    some: tuple[str, ...] = ()
    every: tuple[str, ...] = ()
    none: tuple[str, ...] = ()


#: A course code is a topic of its own.
CODE = "code"
_CODE = re.compile(r"[a-z]{2,6}\d{3,}")

INTENTS = {
    "asks_attribute": Intent(("asking",)),
    "asks_for_list": Intent(("all", "detail", "listing")),
    "asks_info": Intent(("info",)),
    "asks_programmes": Intent(("available", "studies")),
    "asks_staff": Intent(every=("people", "department")),
    "counts": Intent(("count",)),
    "counts_experiments": Intent(every=("count", "experiment")),
    "counts_modules": Intent(every=("count", "module")),
    "is_assessment_query": Intent(("assessment",)),
    "is_credit_query": Intent(("credit share",)),
    "is_degree_credits": Intent(("degree", "whole"), ("credit",), (CODE,)),
    "is_lab_query": Intent(("experiment", "lab")),
    "is_outline_query": Intent(("aim", "assignment", "book", "content", "experiment", "lab", "module", "outcome", "teaching term")),
    "is_semester_catalogue": Intent(every=("semester",), none=(CODE, "experiment", "lab", "module")),
    "is_semester_range": Intent(every=("semesters",), none=(CODE, "experiment", "lab", "module")),
    "is_strict_module_query": Intent(("content", "module", "teaching term")),
    "names_books": Intent(("book", "text")),
    "names_code": Intent((CODE,)),
    "names_first_part": Intent(("first part",)),
    "names_labs": Intent(("lab",)),
    "names_semester": Intent(("semester",)),
    "names_theory": Intent(("theory",)),
    "only_labs": Intent(("only lab",)),
    "only_online": Intent(every=("online",), none=("book", "both", "text")),
    "only_references": Intent(every=("reference",), none=("all", "both", "online", "refer", "text")),
    "only_textbooks": Intent(every=("text",), none=("all", "both", "online", "reading", "reference")),
    "only_theory": Intent(("only theory",)),
    "studies_online": Intent(every=("online", "study")),
    "wants_activities": Intent(("activity",)),
    "wants_assessment": Intent(("assessment",)),
    "wants_assignments": Intent(("assignment",)),
    "wants_books": Intent(("assignment", "book", "text", "tool")),
    "wants_both": Intent(("both", "mixed")),
    "wants_credits": Intent(("credit",)),
    "wants_deployment": Intent(("deployment",)),
    "wants_detailed": Intent(("each",)),
    "wants_electives": Intent(("elective",)),
    "wants_evaluation": Intent(("assessment", "oral")),
    "wants_exam_scheme": Intent(("exam scheme",)),
    "wants_experiments": Intent(("experiment",)),
    "wants_guidelines": Intent(("guide",)),
    "wants_modules": Intent(("module",)),
    "wants_objectives": Intent(("aim",)),
    "wants_outcomes": Intent(("outcome",)),
    "wants_scheme": Intent(("scheme",)),
    "wants_short_list": Intent(every=("listing",), none=("all", "detail", "experiment")),
    "wants_some_modules": Intent(every=("module",), none=("full",)),
    "wants_structure": Intent(("structure",)),
    "wants_syllabus": Intent(("content", "module")),
    "wants_teaching_hours": Intent(("hours",)),
    "wants_teams": Intent(("team",)),
    "wants_term_courses": Intent(("content", "course", "credit"), ("semester",)),
    "wants_whole": Intent(("whole structure",)),
}


def phrases() -> dict[str, list[str]]:
    """The phrases of each topic, in their notation."""
    return {topic: [p.strip() for p in text.split(",")] for topic, text in (PHRASES | _built()).items()}


def pattern(intent: str) -> str:
    """A regular expression for an intent that excludes and needs nothing, on lower-case text."""
    own = INTENTS[intent]
    if own.every or own.none or CODE in own.some:
        raise ValueError(f"{intent} is more than a choice of topics")
    word = lambda w: re.escape(w.rstrip("~*")) + {"~": "s?", "*": "[a-z0-9]*"}.get(w[-1], "")
    each = [r"[^a-z0-9]+".join(word(w) for w in p.split()) for topic in own.some for p in phrases()[topic]]
    return rf"(?<![a-z0-9])(?:{'|'.join(each)})(?![a-z0-9])"


def _automaton(topics: list[str]):
    """All phrases between spaces; a phrase's value is the bits of its topics."""
    import ahocorasick

    bits: dict[str, int] = {}
    for topic, own in phrases().items():
        for phrase in own:
            forms = [""]
            for w in phrase.split():
                ends = {"~": ["", "s"]}.get(w[-1], [""])
                forms = [f"{f} {w.rstrip('~*')}{e}" for f in forms for e in ends]
            for f in forms:
                key = f if phrase.endswith("*") else f + " "
                bits[key] = bits.get(key, 0) | 1 << topics.index(topic)
    found = ahocorasick.Automaton()
    for key, value in bits.items():
        found.add_word(key, value)
    found.make_automaton()
    return found


_WORD = re.compile("[a-z0-9]+")


def with_intents(queries: DataFrame, text: str = "text", name: str = "intents") -> DataFrame:
    """``queries`` with a map from every intent to whether the text has it; a null text has none."""
    topics = [*phrases(), CODE]
    number = {t: 1 << i for i, t in enumerate(topics)}
    mask = lambda some: sum(number[t] for t in some)
    formulas = [(mask(i.some), mask(i.every), mask(i.none)) for i in INTENTS.values()]

    @pandas_udf("array<boolean>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(topics)
        for batch in batches:
            out = []
            for x in batch:
                words = _WORD.findall((x or "").lower())
                held = number[CODE] if any(_CODE.fullmatch(w) for w in words) else 0
                for _, bits in automaton.iter(f" {' '.join(words)} "):
                    held |= bits
                out.append([(not some or bool(held & some)) and held & every == every and not held & none for some, every, none in formulas])
            yield pd.Series(out)

    return queries.withColumn(name, F.map_from_arrays(F.array(*[F.lit(i) for i in INTENTS]), judged(F.coalesce(F.col(text), F.lit("")))))


def has(intent: str, name: str = "intents") -> Column:
    return F.col(name)[intent]
