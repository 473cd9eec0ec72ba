"""Course sections and crawled links: predicates, scores, routing, closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .relational import first_of, union_first

#: Markers of a page that opens a course section, of module pages, and of where a lab text ends.
OPENING = r"(?i)\b(?:course|lab)\s+(?:objectives?|outcomes?)\b|\bproject\s+(?:objectives?|guidelines?)\b"
MODULE_START = r"(?m)^\s*[1-6]\.0"
SELF_LEARNING = r"(?i)self[- ]?learning"
LAB_END = r"(?im)^\s*(?:assessment|term\s?work|evaluation)\b"


def opens_section(text: Column, code: Column) -> Column:
    return code.isNotNull() & text.rlike(OPENING)


def is_module_page(text: Column) -> Column:
    return text.rlike(MODULE_START) & text.rlike(SELF_LEARNING)


def lab_text(pages: DataFrame, by: str, order: str) -> DataFrame:
    """Pages of a lab up to the assessment heading; the page that has it is cut there and the rest go."""
    ended = F.max(F.col("text").rlike(LAB_END).cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    head = F.regexp_extract("text", r"(?s)\A(.*?)(?:" + LAB_END.replace("(?im)", "(?im:") + r")|\z)", 1)
    return pages.withColumn("__ended", F.coalesce(ended, F.lit(0))).where("__ended = 0").drop("__ended").withColumn("text", head)


def section_scores(pairs: DataFrame, query: str, title: str, content: str, modules: str, score: str = "score") -> DataFrame:
    """Lexical score plus boosts of a query and a section, whose words are arrays.

    60 if the query has the whole title, else 40 for two title words or more that
    are two thirds of it; 2 for each common subject word, 1.5 for each module word;
    100 for the section's code.
    """
    common = F.size(F.array_intersect(query, title))
    whole = F.size(F.array_except(title, query)) == 0
    coverage = common / F.greatest(F.size(title), F.lit(1))
    name = F.when(whole & (F.size(title) > 0), 60.0).when((common >= 2) & (coverage >= 0.66), 40.0).otherwise(0.0)
    boost = name + 2.0 * F.size(F.array_intersect(query, content)) + 1.5 * F.size(F.array_intersect(query, modules))
    code = F.when(F.array_contains(query, F.lower("code")), 100.0).otherwise(0.0)
    return pairs.withColumn("name_boost", name).withColumn("section_score", F.col(score) + boost + code)


def matched_sections(queries: DataFrame, sections: DataFrame, qkey: str, key: str) -> DataFrame:
    """``qkey, key, name_boost, section_score`` of every query and section that share a title or module word or a code.

    ``queries`` are ``qkey, words``, ``sections`` ``key, code, title, content,
    modules``, all lists of distinct words but the code. Scores are those of
    ``section_scores`` without a lexical part. Common words are counted by a join
    on the word, so no query meets a section that has none of its words.
    """
    has = lambda c: F.array_contains(c, F.col("word")).cast("int")
    apart = F.array_except(F.array_union("title", "modules"), "content")
    held = [F.col(key), F.lower("code").alias("code"), F.size("title").alias("n_title"), "title", "modules"]
    each = sections.select(*held, F.explode("content").alias("word"), F.lit(1).alias("c")).unionByName(sections.select(*held, F.explode(apart).alias("word"), F.lit(0).alias("c")))
    coded = sections.select(key, F.lower("code").alias("code"), F.size("title").alias("n_title"), F.lower("code").alias("word"), *[F.lit(0).alias(c) for c in ("c", "t", "m")], F.lit(1).alias("named"))
    rows = each.select(key, "code", "n_title", "word", "c", has("title").alias("t"), has("modules").alias("m"), F.lit(0).alias("named")).unionByName(coded)
    met = rows.join(queries.select(qkey, F.explode("words").alias("word")), "word").groupBy(qkey, key)
    counted = met.agg(*[F.sum(c).alias(c) for c in ("c", "t", "m", "named")], F.max("n_title").alias("n_title")).where("t > 0 or m > 0 or named > 0")
    coverage = F.col("t") / F.greatest(F.col("n_title"), F.lit(1))
    name = F.when((F.col("t") == F.col("n_title")) & (F.col("n_title") > 0), 60.0).when((F.col("t") >= 2) & (coverage >= 0.66), 40.0).otherwise(0.0)
    score = name + 2.0 * F.col("c") + 1.5 * F.col("m") + F.when(F.col("named") > 0, 100.0).otherwise(0.0)
    return counted.select(qkey, key, name.alias("name_boost"), score.alias("section_score"))


def best_section(scored: DataFrame, qkey: str, key: str, least: float = 1.5) -> DataFrame:
    """Each query's best section, ties by key; none at or below zero, nor a weak one without a code or title match."""
    best = first_of(scored, [qkey], [F.col("section_score").desc(), F.col(key)])
    strong = (F.col("name_boost") > 0) | (F.col("section_score") >= least)
    return best.where((F.col("section_score") > 0) & strong)


def routed(question: Column) -> Column:
    """Which pages of a section answer a question."""
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(text\s?books?|references?|assessment|evaluation|exam)\b"), "all_pages")
        .when(q.rlike(r"\b(experiments?|practicals?|lab)\b"), "lab_pages")
        .when(q.rlike(r"\bmodules?\s+(\d|one|two|three|four|five|six)\b"), "outlines")
        .when(q.rlike(r"\b(modules?|units?|topics?)\b"), "module_pages")
        .otherwise("pages")
    )


def semester_markers(pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``filename, page, semesters``: distinct roman semesters that a page names, in order; overrides by page replace them."""
    romans = F.create_map(*[F.lit(x) for pair in zip(["I", "II", "III", "IV", "V", "VI", "VII", "VIII"], range(1, 9), strict=True) for x in pair])
    found = F.regexp_extract_all("text", F.lit(r"(?i)\bsem(?:ester)?\.?\s*[-:]?\s*(VIII|VII|VI|IV|V|III|II|I)\b"), F.lit(1))
    rows = pages.select("filename", "page", F.array_distinct(F.transform(found, lambda r: romans[F.upper(r)])).alias("semesters"))
    if overrides is not None:
        o = overrides.select("page", F.array("semester").alias("__o"))
        rows = rows.join(F.broadcast(o), "page", "left").withColumn("semesters", F.coalesce("__o", "semesters")).drop("__o")
    return rows.where(F.size("semesters") > 0).select("filename", "page", "semesters")


def semester_pages(marked: DataFrame, requests: DataFrame, qkey: str) -> DataFrame:
    """Pages that name a semester a query asks for, by a join on the semester."""
    each = marked.select("filename", "page", F.explode("semesters").alias("semester"))
    asked = requests.select(qkey, F.explode("semesters").alias("semester"))
    return each.join(asked, "semester").select(qkey, "filename", "page").distinct()


def patched(pages: DataFrame, patches: DataFrame) -> DataFrame:
    """Pages with literal corrections ``page, ord, old, new`` applied in order."""
    lists = patches.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("ord", "old", "new"))).alias("__p"))
    fixed = F.aggregate(F.coalesce("__p", F.array().cast("array<struct<ord:int,old:string,new:string>>")), F.col("text"), lambda t, p: F.replace(t, p["old"], p["new"]))
    return pages.join(lists, "page", "left").withColumn("text", fixed).drop("__p")


def pages_at(pages: DataFrame, places: DataFrame) -> DataFrame:
    """Fixed pages of fixed files, named by a dimension ``filename, page, semester``."""
    return pages.join(places, ["filename", "page"])


def pdf_links(links: DataFrame, url: str = "link") -> DataFrame:
    """Distinct links to PDF files."""
    return links.where(F.lower(F.regexp_replace(url, "[?#].*$", "")).endswith(".pdf")).select(url).distinct()


def link_closure(edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """``url, depth`` of pages reached from seeds, each at its least depth; a level is a join and an anti-join.

    Each level's new pages are written, and the next one reads these and the
    written ones before it, so no level repeats another and a plan is as large at
    any depth. It ends where a level finds nothing new. With ``most`` the first
    so many by depth and URL, as a crawl limit has it.
    """
    spark = seeds.sparkSession
    levels = [staged(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)), "level")]
    seen = lambda: spark.read.schema(levels[0].schema).parquet(*[t.staged_path for t in levels])
    links = edges.select(F.col("src").alias("url"), "dst")
    for level in range(1, depth + 1):
        reached = levels[-1].select("url").join(links, "url").select(F.col("dst").alias("url")).where("url is not null").distinct()
        found = staged(reached.join(seen().select("url"), "url", "left_anti").withColumn("depth", F.lit(level)), "level")
        if found.isEmpty():
            break
        levels.append(found)
    return seen() if most is None else seen().orderBy("depth", "url").limit(most)


def clause_union(full: DataFrame, parts: DataFrame, key: str, most: int = 8, qkey: str | None = None) -> DataFrame:
    """Hits of a query, then those of its clauses, each id once, the first ``most``; of each ``qkey``, if given."""
    if qkey is None:
        return union_first([full.select(key, "rank"), parts.select(key, "rank")], key, "rank", most)
    both = full.select(qkey, key, "rank", F.lit(0).alias("part")).unionByName(parts.select(qkey, key, "rank", F.lit(1).alias("part")))
    once = first_of(both, [qkey, key], ["part", "rank"])
    place = F.row_number().over(Window.partitionBy(qkey).orderBy("part", "rank", key))
    return once.withColumn("place", place).where(F.col("place") <= most)


def relevant_sources(sources: DataFrame, by: str, title: str, query: Column, answer: Column) -> DataFrame:
    """Sources with a title word over three letters in the query or answer; all of them if none has one."""
    words = F.filter(F.split(F.lower(title), r"[^a-z0-9]+"), lambda w: F.length(w) > 3)
    held = F.concat_ws(" ", F.lower(query), F.lower(answer))
    kept = sources.withColumn("__r", F.exists(words, lambda w: F.contains(held, w)))
    return kept.withColumn("__any", F.max("__r").over(Window.partitionBy(by))).where("__r or not __any").drop("__r", "__any")


def budgeted_pages(hits: DataFrame, qkey: str, url: str, budgets: list[int]) -> DataFrame:
    """The first distinct URLs of each query, each with its share of characters."""
    once = first_of(hits, [qkey, url], ["rank"])
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(qkey).orderBy("rank"))).where(F.col("place") <= len(budgets))
    share = F.element_at(F.array(*[F.lit(b) for b in budgets]), F.col("place"))
    return placed.withColumn("text", F.left("text", share))


def link_context(text: Column, headings: Column, description: Column, most: int = 300) -> Column:
    """What surrounds a link: its block, short headings, the page's description."""
    short = F.filter(headings, lambda h: F.length(h) < 200)
    return F.left(F.concat_ws(" | ", text, F.nullif(F.array_join(short, " | "), F.lit("")), description), F.lit(most))


def file_records(links: DataFrame) -> DataFrame:
    """One record per linked file: its hash id, a title from the link or the file name, and the first page that links it."""
    name = F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), r"(?i)\.pdf$", "")
    title = F.coalesce(F.nullif(F.trim("link_text"), F.lit("")), F.trim(F.regexp_replace(name, "[-_]+", " ")))
    rows = links.withColumn("hash_id", F.left(F.sha2("url", 256), F.lit(16))).withColumn("title", title)
    return first_of(rows, ["hash_id"], ["depth", "source_page"])
