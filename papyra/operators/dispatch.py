"""Queries that several tables answer: courses named in a query, answers clause by clause, whole semesters, special tables.

Queries are rows ``qkey, text``; courses, aliases, items and other dimensions are
tables that the caller gives. All joins are on codes, words, semesters or routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ROMANS, requested, selected, semester_of
from .intents import pattern
from .relational import first_of
from .understanding import flags

#: What the words of a query ask for: the intents that the operators below go by.
ASKED = """
wants_experiments wants_modules wants_scheme wants_detailed only_theory only_labs names_labs names_theory wants_electives
wants_structure wants_whole is_credit_query wants_books wants_assessment wants_teams wants_objectives
""".split()
PREDICATES = {name: pattern(name) for name in ASKED}
#: What lies between two requests: marks, and words that join.
JOINING = ["and also", "and", "along with", "as well as"]
CONJUNCTIONS = r"\s*(?:[,;&]|" + "|".join(rf"\b{j}\b" for j in sorted(JOINING, key=len, reverse=True)) + r")\s*"
#: A semester by word and number, the number before or after.
TERM = r"(?:term|sem(?:ester)?)"
SEMESTER = rf"\b{TERM}\s*([1-8]|{'|'.join(sorted((r for r, n in ROMANS.items() if n <= 8), key=len, reverse=True))})\b"
COURSE = r"^[A-Z]{2,6}\d{3,}[A-Z0-9/]*$"
EXPERIMENT_NOUN = r"(?:experiment|practical|task|prac|exp)"
MODULE_NOUN = r"(?:module|unit)"


def predicates(queries: DataFrame, text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """One boolean column per pattern, and the semester that the query names."""
    return queries.select("*", *flags(F.col(text), patterns or PREDICATES), named_semester(F.col(text)).alias("semester"))


def named_semester(text: Column) -> Column:
    return semester_of(F.regexp_extract(F.lower(text), SEMESTER, 1))


def in_second_term(low: Column) -> Column:
    """Whether a lower-case text names the second semester, with the number after the word or before it."""
    after = F.regexp_extract_all(low, F.lit(r"\bsem(?:ester)?\s*([a-z0-9]+)"), F.lit(1))
    before = F.regexp_extract_all(low, F.lit(r"\b([a-z0-9]+)\s*\bsem(?:ester)?\b"), F.lit(1))
    return F.exists(F.concat(after, before), lambda n: F.coalesce(semester_of(n) == 2, F.lit(False)))


def tokens(text: Column) -> Column:
    """Upper-case words of a query; parentheses go, and so do hyphens, slashes and underscores between words."""
    return F.regexp_extract_all(F.upper(F.regexp_replace(text, r"\(.*?\)", "")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def title_tokens(text: Column) -> Column:
    """The same with roman numerals up to eight as digits."""
    digits = F.create_map(*[F.lit(v) for roman, n in ROMANS.items() for v in (roman.upper(), str(n))])
    return F.transform(tokens(text), lambda w: F.coalesce(F.try_element_at(digits, w), w))


def codes_by_name(courses: DataFrame, least: int = 5) -> DataFrame:
    """``title, codes``: the codes of each course name of ``least`` characters or more, in order of code."""
    title = F.array_join(title_tokens(F.col("name")), " ")
    named = courses.select(title.alias("title"), "code").where(F.length("title") >= least)
    return named.groupBy("title").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def _disjoint(hits: Column) -> Column:
    """Hits in order less those that overlap one kept before."""
    none = F.slice(hits, 1, 0)
    apart = lambda kept, h: ~F.exists(kept, lambda k: (h["start"] < k["stop"]) & (k["start"] < h["stop"]))
    return F.aggregate(F.array_sort(hits), none, lambda kept, h: F.when(apart(kept, h), F.concat(kept, F.array(h))).otherwise(kept))


def phrases_of(queries: DataFrame, keys: list[str], text: str, longest: int, heads: DataFrame | None, written: Column) -> DataFrame:
    """``keys, second, start, kind, phrase``: what a query may name: words for which ``written`` holds (kind 0), phrases (1), phrases with digits (2).

    Phrases begin with a word of ``heads``, a bounded table ``kind, head, sizes``,
    and have one of its sizes; without it all of up to ``longest`` words are given.
    """
    second = in_second_term(F.lower(text))
    # A generator's output is computed once; a plain projection would be folded into what follows.
    split = F.struct(second.alias("second"), tokens(F.col(text)).alias("plain"), title_tokens(F.col(text)).alias("digit"))
    each = queries.select(*keys, F.inline(F.array(split))).select("*", F.posexplode("plain").alias("start", "word"))
    after = lambda words: F.slice(words, F.col("start") + 1, F.lit(longest))
    begun = [(0, F.when(written, F.array("word"))), (1, after("plain")), (2, after("digit"))]
    each = each.select(*keys, "second", "start", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), near.alias("near")) for kind, near in begun])))
    each = each.where("near is not null").withColumn("head", F.get("near", F.lit(0)))
    codes, begun = each.where("kind = 0"), each.where("kind > 0")
    sized = begun.withColumn("sizes", F.sequence(F.lit(1), F.size("near"))) if heads is None else begun.join(F.broadcast(heads), ["kind", "head"])
    sized = sized.select(*keys, "second", "start", "kind", "near", F.explode("sizes").alias("size")).where(F.col("size") <= F.size("near"))
    phrase = F.array_join(F.slice("near", F.lit(1), F.col("size")), " ").alias("phrase")
    return codes.select(*keys, "second", "start", "kind", F.col("head").alias("phrase")).unionByName(sized.select(*keys, "second", "start", "kind", phrase))


#: First words of names and aliases that go to every task; with more of them every word of a query begins phrases.
MOST_HEADS = 20_000


def mentions(queries: DataFrame, keys: list[str], text: str, courses: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``keys, place, code, start``: the courses that a query names, in order of place.

    Codes come first, then aliases (longest first, none over another hit), then
    whole names, which only yield to longer names. A name of several courses is
    the one whose code's first digit is the term's. A course or a title counts
    once, a written code always. Aliases and names meet whole phrases of a query
    that begin with their first word and have as many words; of a bounded number
    of first words this is seen before anything is shuffled.
    """
    known = courses.select("code", F.array_join(title_tokens(F.col("name")), " ").alias("title"))

    def called(rows: DataFrame, kind: int, words: Column, one: Column, two: Column) -> DataFrame:
        rows = rows.select(F.lit(kind).alias("kind"), F.array_join(words, " ").alias("phrase"), F.size(words).alias("size"), F.get(words, F.lit(0)).alias("head"), one.alias("one"), two.alias("two"), "title")
        return rows.where("size > 0")

    def of_term(digit: str) -> Column:
        own = F.filter("codes", lambda c: F.regexp_extract(c, r"^[A-Z]+(\d)", 1) == digit)
        return F.when(F.size("codes") > 1, F.get(own, F.lit(0))).otherwise(F.get("codes", F.lit(0)))

    first = F.get("codes", F.lit(0))
    names = called(codes_by_name(courses), 2, F.split("title", " "), F.coalesce(of_term("1"), first), F.coalesce(of_term("2"), first))
    if aliases is not None:
        listed = aliases.join(known, "code").select("code", "title", F.inline(F.array(F.struct(tokens(F.col("alias")).alias("words")))))
        names = names.unionByName(called(listed, 1, F.col("words"), F.col("code"), F.col("code")))
    heads = names.groupBy("kind", "head").agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    few = heads.limit(MOST_HEADS + 1).collect()
    longest = (names if len(few) > MOST_HEADS else heads.select(F.explode("sizes").alias("size"))).agg(F.max("size")).first()[0] or 1
    written = F.col("word").rlike(COURSE)
    phrases = phrases_of(queries, keys, text, longest, None if len(few) > MOST_HEADS else queries.sparkSession.createDataFrame(few, heads.schema), written)
    names = names.unionByName(called(known, 0, F.array("code"), F.col("code"), F.col("code")))
    met = phrases.join(names.drop("head"), ["kind", "phrase"])
    code = F.when(F.col("second"), F.col("two")).otherwise(F.col("one"))
    hit = F.struct("kind", (-F.col("size")).alias("size"), "start", (F.col("start") + F.col("size")).alias("stop"), code.alias("code"), "title")
    grouped = met.select(*keys, hit.alias("hit")).groupBy(*keys).agg(
        F.collect_list(F.when(F.col("hit.kind") < 2, F.col("hit"))).alias("sure"),
        F.collect_list(F.when(F.col("hit.kind") == 2, F.col("hit"))).alias("names"),
    )
    kept = grouped.select(*keys, F.explode(F.concat(_disjoint(F.col("sure")), _disjoint(F.col("names")))).alias("hit"))
    kept = kept.select(*keys, "hit.kind", "hit.start", "hit.code", "hit.title")
    once = first_of(kept, [*keys, "code"], ["kind", "start"])
    # A title's first course stays, and every written code.
    title = Window.partitionBy(*keys, "title").orderBy("start", "kind")
    once = once.withColumn("nth", F.row_number().over(title)).where("nth = 1 or kind = 0")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "kind", "code"))
    return once.select(*keys, place.alias("place"), "code", "start")


def course_answers(queries: DataFrame, qkey: str, text: str, courses: DataFrame, items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``qkey, place, code, number, title``: modules or experiments of each course that a query names.

    ``courses`` have ``code, name, is_lab, partner`` (the lab of a theory course),
    ``items`` ``code, number, title``. Each course is asked for by the first clause
    that names it. A theory course stands for its lab if experiments are asked
    for and its clause has no modules. Queries for schemes, for no number of
    modules, or without a course give nothing.
    """
    q = F.lower(text)
    experiments, modules = q.rlike(PREDICATES["wants_experiments"]), q.rlike(PREDICATES["wants_modules"])
    asked = queries.where((experiments | modules) & ~q.rlike(PREDICATES["wants_scheme"]) & (experiments | q.rlike(r"\d")))
    # The whole query counts as part 0, what lies between conjunctions as 1, 2 and so on: all are searched at once.
    between = F.filter(F.transform(F.split(text, f"(?i){CONJUNCTIONS}"), lambda p: F.trim(p)), lambda p: p != "")
    parts = asked.select(qkey, F.posexplode(F.concat(F.array(F.col(text)), between)).alias("part", "clause"))
    found = mentions(parts, [qkey, "part"], "clause", courses, aliases)
    found = found.groupBy(F.col(qkey).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("part", "place", "code", "start"))).alias("found"))
    rows = asked.select(qkey, F.col(text).alias("__q"), F.inline(F.array(F.struct(between.alias("parts"), tokens(F.col(text)).alias("words")))))
    rows = rows.join(found, rows[qkey] == found["__key"]).withColumn("named", F.filter("found", lambda f: f["part"] == 0))
    # Courses go with the first part that names them; if parts are fewer than courses, each with the words up to the next course.
    few = F.size("parts") < F.size("named")
    rows = rows.select(qkey, "__q", "parts", "words", "found", "named", few.alias("few"), F.posexplode("named").alias("i", "n"))
    until = F.coalesce(F.get("named", F.col("i") + 1)["start"], F.size("words"))
    by_place = F.array_join(F.slice("words", F.col("n.start") + 1, until - F.col("n.start")), " ")
    part = F.array_min(F.transform(F.filter("found", lambda f: (f["part"] > 0) & (f["code"] == F.col("n.code"))), lambda f: f["part"]))
    clause = F.coalesce(F.when(F.col("few"), by_place).otherwise(F.get("parts", part - 1)), F.col("__q"))
    rows = rows.select(qkey, F.col("n.place").alias("place"), F.col("n.code").alias("code"), F.lower(clause).alias("clause"), "__q")
    rows = rows.join(courses.select("code", "is_lab", "partner"), "code")
    clause = F.col("clause")
    whole = F.lower("__q").rlike(PREDICATES["wants_experiments"])
    swap = ~F.col("is_lab") & whole & ~clause.rlike(PREDICATES["wants_modules"]) & F.col("partner").isNotNull()
    labs = courses.where("is_lab").select(F.col("code").alias("partner"), F.lit(True).alias("has_lab"))
    rows = rows.join(labs, "partner", "left").withColumn("swap", swap & F.coalesce("has_lab", F.lit(False)))
    rows = rows.select(qkey, "place", F.when(F.col("swap"), F.col("partner")).otherwise(F.col("code")).alias("code"), (F.col("is_lab") | F.col("swap")).alias("is_lab"), "clause")
    rows = first_of(rows, [qkey, "code"], ["place"])
    # A clause without the noun is read as if it ended in it.
    with_noun = lambda noun, word: F.when(clause.rlike(PREDICATES[word]), clause).otherwise(F.concat(clause, F.lit(noun)))
    labs, theory = with_noun(" experiments", "wants_experiments"), with_noun(" modules", "wants_modules")
    request = F.when(F.col("is_lab"), requested(labs, EXPERIMENT_NOUN, 99)).otherwise(requested(theory, MODULE_NOUN))
    there = items.groupBy("code").agg(F.array_sort(F.collect_set("number")).alias("there"), F.collect_list(F.struct("number", "title")).alias("items"))
    asked = rows.select(qkey, "place", "code", F.inline(F.array(F.struct(request.alias("r"))))).join(there, "code")
    asked = asked.select(qkey, "place", "code", "items", F.inline(F.array(F.struct(selected(F.col("r"), F.col("there")).alias("chosen")))))
    return asked.select(qkey, "place", "code", F.inline(F.filter("items", lambda i: F.array_contains("chosen", i["number"]))))


def semester_syllabus(queries: DataFrame, qkey: str, text: str, core: DataFrame, sections: DataFrame, structure: DataFrame) -> DataFrame:
    """``qkey, part, ord, code, line``: a semester's table (part 0) and the outlines of its core courses (part 1).

    Only for queries that want details of a semester. ``core`` is ``semester, ord,
    code, is_lab``, ``sections`` ``code, line_no, line``, ``structure`` ``semester,
    ord, code, line``. Queries for theory or labs only get these.
    """
    asked = predicates(queries.select(qkey, F.col(text).alias("__q")), "__q").where("wants_detailed and semester is not null")
    theory = F.col("only_theory") & ~F.col("names_labs")
    labs = ~theory & F.col("only_labs") & ~F.col("names_theory")
    asked = asked.select(qkey, "semester", theory.alias("theory"), labs.alias("labs"))
    table = asked.join(structure, "semester").select(qkey, F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("line_no"), "code", "line")
    courses = asked.join(core, "semester").where("not (theory and is_lab) and not (labs and not is_lab)")
    lines = courses.join(sections, "code").select(qkey, F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("line_no").cast("int").alias("line_no"), "code", "line")
    return table.unionByName(lines)


def structure_or_electives(queries: DataFrame, qkey: str, text: str, structure: DataFrame, electives: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """``qkey, part, code``: a semester's courses (part 0) and electives (part 1), as a query wants one, the other or both.

    A query that names a course (a row in ``named``) wants no structure unless it says that of a whole programme.
    """
    asked = predicates(queries.select(qkey, F.col(text).alias("__q")), "__q").where("semester is not null")
    with_term = F.col("wants_structure") | F.lower("__q").rlike(r"\b(subjects?|courses?|curriculum|syllabus|credits?)\b")
    if named is not None:
        asked = asked.join(named.select(qkey, F.lit(True).alias("names_course")).distinct(), qkey, "left")
        with_term = with_term & (F.col("names_course").isNull() | F.col("wants_whole"))
    asked = asked.withColumn("whole", with_term)
    parts = [(0, "whole", structure), (1, "wants_electives", electives)]
    first, second = (asked.where(flag).join(rows, "semester").select(qkey, F.lit(n).alias("part"), "code") for n, flag, rows in parts)
    return first.unionByName(second)


def special_tables(queries: DataFrame, qkey: str, text: str, routes: list[tuple[str, str]], tables: DataFrame) -> DataFrame:
    """``qkey, route, ord, cells``: rows of the first special table that a query asks for and that has some.

    ``routes`` are names and patterns in order of precedence; a pattern's group, if
    it has one, is the number of the table that is meant. ``tables`` hold ``route,
    number, ord, cells``; rows without a number answer whatever number.
    """
    q = F.lower(text)
    asked = []
    for i, (name, pattern) in enumerate(routes):
        number = semester_of(F.regexp_extract(q, f"(?:{pattern})|()$", 1))
        asked.append(F.when(q.rlike(pattern), F.struct(F.lit(i).alias("turn"), F.lit(name).alias("route"), number.alias("asked"))))
    each = queries.select(qkey, F.explode(F.array_compact(F.array(*asked))).alias("r")).select(qkey, "r.*")
    met = each.join(tables, "route").where("number is null or number = asked")
    first = F.min("turn").over(Window.partitionBy(qkey))
    return met.withColumn("first", first).where("turn = first").select(qkey, "route", "ord", "cells")
