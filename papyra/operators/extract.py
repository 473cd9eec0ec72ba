"""Facts from text: parts between headings, numbered items, books, assessment, prerequisites, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url

#: Headings that end a part of a course text.
HEADINGS = r"text\s?books?|references?(?:\s+books?)?|online\s+(?:resources?|references?)|assessment|evaluation|prerequisites?|course\s+(?:objectives?|outcomes?)|end\s+sem(?:ester)?\s+exam\w*|assignments?|activities|scheme|modules?|[1-9]\.0"


def between_headings(text: Column, heading: str, stop: str = HEADINGS, most_chars: int | None = None) -> Column:
    """What stands from a heading line to the next one; empty if the heading is missing."""
    part = F.regexp_extract(text, rf"(?ims)^[ \t]*(?:{heading})[ \t]*:?[ \t]*(.*?)(?=^[ \t]*(?:{stop})\b|\z)", 1)
    part = F.trim(F.regexp_replace(part, r"^\s+|\s+$", ""))
    return part if most_chars is None else F.left(part, F.lit(most_chars))


def numbered_items(text: Column) -> Column:
    """Items of a numbered list, each with the lines that continue it."""
    items = F.split(F.concat(F.lit("\n"), text), r"\n\s*\d{1,2}\s*[.)]\s+", -1)
    cleaned = F.transform(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(cleaned, lambda x: x != "")


def bullets(text: Column) -> Column:
    """Lines without bullet marks."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s*[•*\-–]+\s*", "")))
    return F.filter(lines, lambda x: x != "")


def books(sections: DataFrame, key: str) -> DataFrame:
    """Textbooks, references and online sources of each course: of its pages, the first that lists any."""
    kinds = {"textbooks": r"text\s?books?", "references": r"references?(?:\s+books?)?", "online": r"online\s+(?:resources?|references?)"}
    each = sections.select(key, "page", *[numbered_items(between_headings(F.col("text"), h)).alias(k) for k, h in kinds.items()])
    each = each.where(" or ".join(f"size({k}) > 0" for k in kinds))
    w = Window.partitionBy(key).orderBy("page")
    return each.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prerequisites(text: Column) -> Column:
    """Named prerequisites; null for a missing part or one that says there are none."""
    part = between_headings(text, r"pre-?requisites?")
    bare = F.lower(F.regexp_replace(F.substring_index(part, "\n", 1), r"[^A-Za-z]", ""))
    items = F.filter(F.transform(F.split(part, r"[,;\n]|\band\b"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((bare != "") & ~bare.isin("nil", "none", "na", "nill", "no"), items)


def scheme_numbers(text: Column, label: str) -> Column:
    """Numbers of a scheme line that starts with a label."""
    line = F.regexp_extract(text, rf"(?im)^\s*{label}\b\s*:?\s*([\d. \t*+#&$-]+)$", 1)
    return F.transform(F.regexp_extract_all(line, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("double"))


def scheme(text: Column, label: str) -> Column:
    """Hours, credits and exam marks by how many numbers the line has."""
    n = scheme_numbers(text, label)
    at = lambda i: F.try_element_at(n, F.lit(i))
    null = F.lit(None).cast("double")
    wide, some = F.size(n) >= 6, F.size(n) >= 3
    return F.struct(
        F.when(wide | some, at(1)).otherwise(null).alias("theory"),
        F.when(wide | some, at(2)).otherwise(null).alias("practical"),
        F.when(wide, at(3)).otherwise(null).alias("tutorial"),
        F.when(some, at(-1)).otherwise(null).alias("credits"),
    )


def exam_pattern(text: Column, most_chars: int = 700, default: str = "The general pattern applies.") -> Column:
    part = between_headings(text, r"end\s+sem(?:ester)?\s+exam\w*(?:\s+pattern)?", most_chars=most_chars)
    return F.coalesce(F.nullif(part, F.lit("")), F.lit(default))


def assessment(text: Column, default: str = "The general scheme applies.") -> Column:
    part = between_headings(text, r"assessment|evaluation")
    return F.coalesce(F.nullif(part, F.lit("")), F.lit(default))


def with_self_learning(text: Column) -> Column:
    """The text with its self-learning part under a heading, added once."""
    marked = F.contains(text, F.lit("**Self-learning**"))
    return F.when(marked, text).otherwise(F.regexp_replace(text, r"(?im)^\s*self[- ]?learning(?:\s+topics?)?\s*:?\s*", "\n**Self-learning**\n"))


def course_card(sections: DataFrame, key: str) -> DataFrame:
    """All facts of each course section in one row."""
    t = F.col("text")
    return sections.select(
        key, course_name(t).alias("name"), prerequisites(t).alias("prerequisites"),
        numbered_items(between_headings(t, r"course\s+outcomes?")).alias("outcomes"),
        numbered_items(between_headings(t, r"text\s?books?")).alias("textbooks"),
        numbered_items(between_headings(t, r"references?(?:\s+books?)?")).alias("references"),
        exam_pattern(t).alias("exam_pattern"), assessment(t).alias("assessment"),
    )


def course_name(header: Column) -> Column:
    """The header up to its first digits or dashes at the end, without the code; else its first line."""
    first = F.trim(F.regexp_extract(header, r"\A\s*([^\n]*)", 1))
    name = F.trim(F.regexp_replace(F.regexp_replace(first, r"^\s*[A-Z]{2,6}\s?\d{3}[A-Z]?\b", ""), r"[\s\d\-–]+$", ""))
    return F.coalesce(F.nullif(name, F.lit("")), first)


#: Classes of a profile's lines, in order of precedence: keys that a structured line has.
PROFILE = [("award", ["award", "recognition"]), ("publication", ["journal", "conference", "paper title", "publisher"]), ("development", ["workshop", "training", "fdp"]), ("experience", ["experience", "designation"]), ("course", ["subject", "course"])]


def profile_lines(lines: DataFrame, by: str, order: str) -> DataFrame:
    """Lines of a personal page by class; text counts as biography only before the first structured line."""
    low = F.lower("line")
    kind = None
    for name, words in PROFILE:
        found = F.lit(False)
        for word in words:
            found |= F.contains(low, F.lit(f"{word}:"))
        kind = F.when(found, name) if kind is None else kind.when(found, name)
    lines = lines.withColumn("kind", kind)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    structured = F.max(F.col("kind").isNotNull().cast("int")).over(w)
    return lines.withColumn("kind", F.coalesce("kind", F.when(structured == 0, "bio")))


def markdown_table(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of each group as a markdown table."""
    head = F.lit("| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    ordered = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("ls"))
    return ordered.select(by, F.concat_ws("\n", head, F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("table"))


def read_page(text: Column, offset: int = 0, size: int = 6000) -> Column:
    """A page's text from an offset, with a mark if more follows."""
    piece = F.substring(text, offset + 1, size)
    more = F.length(text) > offset + size
    return F.when(piece == "", "No more content.").when(more, F.concat(piece, F.lit(f"\n\n[Continues at offset {offset + size}.]"))).otherwise(piece)


def snippets(hits: DataFrame, url: str, text: str, order: str, size: int = 140) -> DataFrame:
    """One snippet per URL, of its first hit."""
    w = Window.partitionBy(url).orderBy(order)
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumn("snippet", F.left(F.regexp_replace(text, r"\s+", " "), F.lit(size)))


def contexts(hits: DataFrame, by: str, order: str, size: int = 250) -> DataFrame:
    """Hits less those whose first characters, white space aside, repeat an earlier hit of the group."""
    key = F.left(F.regexp_replace(F.lower("text"), r"\s+", " "), F.lit(size))
    w = Window.partitionBy(by, key).orderBy(order)
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def grouped_sources(hits: DataFrame, by: str) -> DataFrame:
    """Sources with their pages, titled with the page or pages."""
    pages = hits.groupBy(by).agg(F.array_sort(F.collect_set("page")).alias("pages"))
    listed = F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ")
    return pages.withColumn("title", F.concat(F.col(by), F.when(F.size("pages") > 1, F.concat(F.lit(" (Pages "), listed, F.lit(")"))).otherwise(F.concat(F.lit(" (Page "), listed, F.lit(")")))))


def without_sources_tail(x: Column, within: int = 800) -> Column:
    """An answer without a list of sources that starts in its last characters."""
    return F.trim(F.regexp_replace(x, rf"(?is)\n\s*(?:#+\s*|\*\*)?sources?\b[^\n]{{0,40}}(?:\n(?=.{{0,{within}}}\z).*)?\z", ""))


#: What a reader is told of an address that is not indexed.
NOT_FOUND = "No page has this address."


def upper_headings(lines: Column, mark: str = "## ") -> Column:
    """Lines as one text, headings in capitals without their mark."""
    return F.array_join(F.transform(lines, lambda x: F.when(x.startswith(mark), F.upper(F.substring(x, len(mark) + 1, 1_000_000))).otherwise(x)), "\n")


def read_pages(requests: DataFrame, pages: DataFrame, size: int = 6000, not_found: str = NOT_FOUND) -> DataFrame:
    """``requests`` (``url, offset``) with the ``piece`` of the page (``url, lines``) that each asks for.

    Addresses are compared in their normal form. A piece has ``size`` characters
    at most and says where the rest begins; pages that are not there and offsets
    past the end get messages.
    """
    own = pages.select(normalize_url(F.col("url")).alias("__url"), upper_headings(F.col("lines")).alias("__text")).dropDuplicates(["__url"])
    asked = requests.withColumn("__key", normalize_url(F.col("url"))).join(own, F.col("__key") == F.col("__url"), "left")
    piece = F.substring(F.col("__text"), F.col("offset") + 1, F.lit(size))
    end = F.col("offset") + F.length(piece)
    more = F.concat(piece, F.lit("\n\n[Continues at offset "), end, F.lit(".]"))
    shown = F.when(F.col("__text").isNull(), not_found).when(end < F.length("__text"), more).when(piece == "", "No more content.").otherwise(piece)
    return asked.withColumn("piece", shown).drop("__key", "__url", "__text")
