"""Queries of the engine's operators over the given tables, each with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html, numbers, text, urls
from .operators import chunking, dispatch, extract, intents, pages, pruned, ranking, relational, robots, sections, structure, understanding
from .plans import retrieval
from .session import ship
from .sources import sinks, tables, vectors
from .sources.tables import table
from .storage import shared_dir, spread, staged
from .streaming import cache, serving

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)


# -- requests ------------------------------------------------------------------------------------------------------

#: Texts of the predicate queries, put together from these by id.
WANTS = ["list all experiments", "module wise notes", "the teaching scheme", "only theory", "lab subjects", "open electives of term 7", "course structure for sem iv",
         "total credits for the degree", "text books", "textbooks and useful links", "marks and term work", "group size", "aims of it", "semester 12", "nothing at all"]
#: What follows a message in the intent query, by turn and conversation.
MORE_WANTS = [*WANTS, "tell me about csa101", "how many modules", "number of experiments in physics 1", "courses offered, intake and degrees", "who is the HOD of computer", "where to study online",
              "reference books only", "total credits of the degree, altogether", "semester 1 to 4", "sem 3 subjects", "3rd semester syllabus", "self-learning topics", "hosting and deployment rules",
              "viva, oral and rubrics", "course outcomes (COs)", "ESE and ISE", "contact hours per week", "both theory and lab", "give me the full list of units", "activities, assignments"]


# -- tokens in SQL ------------------------------------------------------------------------------------------------

_STEM = """CASE WHEN length(t) > 5 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y'
 WHEN length(t) > 7 AND t LIKE '%ing' THEN
  CASE WHEN length(t) - 3 > 2 AND substr(t, length(t) - 3, 1) = substr(t, length(t) - 4, 1) THEN left(t, length(t) - 4) ELSE left(t, length(t) - 3) END
 WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"""
STEMMED_SQL = rf"""list_filter(list_transform(list_concat(regexp_extract_all(lower(%s), '[a-z0-9]+'),
 list_transform(regexp_extract_all(lower(%s), '\b[a-z0-9]+(?:-[a-z0-9]+)+\b'), lambda c: replace(c, '-', ''))),
 lambda t: {_STEM}), lambda t: t NOT IN ({listed(text.STOP_WORDS)}))"""
PLURAL_SQL = f"""list_transform(list_filter(regexp_extract_all(lower(%s), '[a-z0-9]+'), lambda t: t NOT IN ({listed(text.SITE_STOP_WORDS)})),
 lambda t: CASE WHEN length(t) > 3 AND t LIKE '%%s' THEN left(t, length(t) - 1) ELSE t END)"""


def stemmed_sql(column: str) -> str:
    return STEMMED_SQL.replace("%s'", "\0").replace("%ies", "\1").replace("%ing", "\2").replace("%ss", "\3").replace("%s", column).replace("\0", "%s'").replace("\1", "%ies").replace("\2", "%ing").replace("\3", "%ss")


def plural_sql(column: str) -> str:
    return PLURAL_SQL % column


# -- projections --------------------------------------------------------------------------------------------------


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace(text, '{text.SPACES}', ' ', 'g'))) AS cleaned,
  length(trim(regexp_replace(text, '{text.SPACES}', ' ', 'g'))) AS n_chars FROM documents""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.clean_line(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(cleaned, 256).alias("cleaned"), F.length(cleaned).cast("long").alias("n_chars"))


def _markup_sql(column: str) -> str:
    for pattern in text.MARKUP:
        column = f"regexp_replace({column}, {quoted(pattern)}, '', 'g')"
    column = rf"regexp_replace({column}, '[ \t]+\n', chr(10), 'g')"
    return rf"trim(regexp_replace({column}, '\n{{3,}}', chr(10) || chr(10), 'g'))"


@query(f"""SELECT doc_id, sha256({_markup_sql("'![a](data:x) ' || text || chr(10) || '<!-- c --> <img src=1>'")}) AS stripped FROM documents""")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("![a](data:x) "), "text", F.lit("\n<!-- c --> <img src=1>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_markup(noisy), 256).alias("stripped"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', ''), '/+$', '')
  || regexp_extract(regexp_replace(url, '#.*$', ''), '(\?.*)$', 1) AS normalized FROM pages""")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '\.(php|html)$', '', 'g'), '[-_]', ' ', 'g')), ''), 'home') AS label FROM pages""")
def page_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.page_label(F.col("url")).alias("label"))


_SCOPE_SQL = " AND ".join(
    [f"NOT (lower(regexp_replace(url, '[?#].*$', '')) LIKE '%{e}')" for e in urls.SKIP_EXTENSIONS] + [f"NOT contains(lower(url), '{p}')" for p in urls.SKIP_PARTS]
)


@query(rf"""WITH h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, (host = 'example.com' OR host LIKE '%.example.com') AND lower(split_part(url, '://', 1)) IN ('http', 'https') AND {_SCOPE_SQL} AS in_scope FROM h""")
def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(url).alias("host"), urls.in_scope(url, "example.com").alias("in_scope"))


@query(r"""WITH s AS (SELECT *, trim(regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '(?i)\.pdf$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages)
SELECT page_id, left(CASE WHEN slug = '' THEN 'document' ELSE slug END, 70) || '_' || left(sha256(url), 16) AS file_key, left(sha256(url), 16) AS hash_id,
  sha256(url || '|' || '0' || '|' || html) AS chunk_id FROM s""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.file_key(url).alias("file_key"), text.hash_id(url).alias("hash_id"), text.chunk_id(url, F.lit(0), F.col("html")).alias("chunk_id")
    )


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct, sha256(string_agg(href, chr(10) ORDER BY href)) AS links FROM l GROUP BY page_id""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(html.html_links("html")).alias("l")).select("page_id", "l.href")
    return links.groupBy("page_id").agg(
        F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"), F.sha2(F.array_join(F.sort_array(F.collect_list("href")), "\n"), 256).alias("links")
    )


@query(rf"""WITH b AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
r AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS link,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM b WHERE href LIKE '/%')
SELECT host, count(DISTINCT link) AS n_links FROM r WHERE NOT contains(lower(link), '.js') AND NOT contains(lower(link), 'the') GROUP BY host""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    links = table(spark, sf_dir, "pages").select("url", F.explode(html.html_links("html")).alias("l"))
    kept = links.select(urls.host(F.col("url")).alias("host"), urls.resolved(F.col("l.href"), F.col("url")).alias("link"))
    bad = F.contains(F.lower("link"), F.lit(".js")) | F.contains(F.lower("link"), F.lit("the"))
    return kept.where(~bad).groupBy("host").agg(F.countDistinct("link").alias("n_links"))


@query()
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.html_to_lines("html")).alias("line_no", "line"))


@query()
def html_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", html.html_to_lines("html").alias("lines"))
    return chunking.drop_boilerplate(pages, "page_id", "lines", 0.05).select("page_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("kept"))


@query(r"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[.] ', '; ', 'g'), '(^|; )([^ \t\n\f\r]+) ', '\1\2: ', 'g') AS x FROM documents),
p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(x, ';'), lambda i: trim(i)), lambda i: contains(i, ': '))) AS pair, generate_subscripts(list_filter(string_split(x, ';'), lambda i: contains(trim(i), ': ')), 1) AS i FROM l),
k AS (SELECT doc_id, left(pair, position(': ' IN pair) - 1) AS name, arg_max(substr(pair, position(': ' IN pair) + 2), i) AS value FROM p GROUP BY ALL)
SELECT doc_id, count(*) AS n_keys, sha256(string_agg(name || '=' || value, chr(10) ORDER BY name || '=' || value)) AS pairs FROM k GROUP BY doc_id""")
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as pairs of their first word and the rest; of a repeated word the last sentence counts."""
    line = F.regexp_replace(F.regexp_replace("text", "[.] ", "; "), r"(^|; )([^ \t\n\f\r]+) ", "$1$2: ")
    # A generator's output is computed once; a plain projection would be computed for the filter and for each column.
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.inline(F.array(F.struct(text.key_values(line).alias("m"))))).where(F.size("m") > 0)
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("doc_id", F.size("m").cast("long").alias("n_keys"), F.sha2(F.array_join(pairs, "\n"), 256).alias("pairs"))


@query(r"""SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cache_key FROM conversations""".replace(r"\s+", text.SPACES))
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cache_key(F.col("text")).alias("cache_key"))


# -- filters and generators ---------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS n_docs FROM l GROUP BY line HAVING count(*) > 1""")
def line_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return chunking.line_doc_freq(docs, "doc_id", F.split("text", "\n", -1)).where("n_docs > 1")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT doc_id) > 0.02 * (SELECT count(*) FROM documents))
SELECT doc_id, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY i)) AS kept FROM l WHERE line NOT IN (SELECT line FROM f) GROUP BY doc_id""")
def drop_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    kept = chunking.drop_boilerplate(docs, "doc_id", "lines", 0.02)
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("kept"))


@query("""WITH p AS (SELECT doc_id, trim(substr(text, 1200 * i + 1, 1200)) AS chunk, i FROM documents, unnest(range(greatest(ceil(length(text) / 1200.0), 1)::BIGINT)) AS t(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM p WHERE chunk <> '')
SELECT doc_id, chunk_index, length(chunk) AS n_chars, sha256(chunk) AS chunk FROM k""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_fixed(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk"))


@query(r"""WITH RECURSIVE base AS (SELECT doc_id, regexp_replace(text, '^[\s]+|[\s]+$', '', 'g') AS t FROM documents),
cut AS (SELECT doc_id, t, 0 AS begin, 0 AS stop, '' AS chunk FROM base
  UNION ALL
  SELECT doc_id, t, nb, e, substr(t, nb + 1, e - nb) FROM (
    SELECT doc_id, t, nb, CASE WHEN nb + 1500 < length(t) AND b > nb + 750 THEN b ELSE least(nb + 1500, length(t)) END AS e FROM (
      SELECT doc_id, t, nb, nb + greatest(
        1500 - CASE WHEN position((chr(10) || chr(10)) IN w) > 0 THEN position((chr(10) || chr(10)) IN w) - 1 + 2 ELSE 100000 END,
        1500 - CASE WHEN position(' .' IN w) > 0 THEN position(' .' IN w) - 1 + 2 ELSE 100000 END,
        1500 - CASE WHEN position(' ' IN w) > 0 THEN position(' ' IN w) - 1 + 1 ELSE 100000 END) AS b
      FROM (SELECT doc_id, t, nb, reverse(substr(t, nb + 1, 1500)) AS w FROM (
        SELECT doc_id, t, CASE WHEN stop = 0 THEN 0 ELSE greatest(begin + 1, stop - 250) END AS nb FROM cut WHERE stop < length(t)))))),
kept AS (SELECT doc_id, begin, regexp_replace(chunk, '^[\s]+|[\s]+$', '', 'g') AS c FROM cut WHERE stop > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY begin) - 1 AS chunk_index, length(c) AS n_chars, sha256(c) AS chunk FROM kept WHERE c <> ''""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    chunks = chunking.chunk_overlapping(_texts(spark, sf_dir))
    return chunks.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk"))


@query(r"""WITH RECURSIVE base AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
walk AS (SELECT doc_id, a, 0 AS i, 0 AS size, 0 AS chunk, 0 AS held FROM base
  UNION ALL
  SELECT doc_id, a, i + 1,
    CASE WHEN held > 0 AND size + length(a[i + 1]) > 1500 THEN length(a[i + 1]) + 1 ELSE size + length(a[i + 1]) + 1 END,
    CASE WHEN held > 0 AND size + length(a[i + 1]) > 1500 THEN chunk + 1 ELSE chunk END, 1
  FROM walk WHERE i < len(a)),
packed AS (SELECT doc_id, chunk, string_agg(a[i], chr(10) ORDER BY i) AS c FROM walk WHERE i > 0 GROUP BY doc_id, chunk)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS chunk_index, length(c) AS n_chars, sha256(c) AS chunk FROM packed WHERE length(c) >= 40""")
def chunk_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    chunks = chunking.chunk_by_budget(docs, "lines")
    return chunks.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk"))


@query(r"""SELECT doc_id, len(p) AS n_clauses, array_to_string(p, '|') AS clauses FROM (
  SELECT item_id AS doc_id, list_filter(list_transform(regexp_split_to_array(text, '(?i)\s+(?:and|also)\s+|[,;&]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM benchmark)""")
def query_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), understanding.clauses(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n_clauses"), F.array_join("p", "|").alias("clauses"))


# -- tokens, statistics, ranking ----------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts for work that is heavy for its bytes."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _token_rows(tokens, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


def _token_sql(tokens: str) -> str:
    return f"SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {tokens} AS t FROM documents)"


@query(_token_sql(stemmed_sql("text")))
def tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(text.tokens_stemmed, spark, sf_dir)


@query(_token_sql(plural_sql("text")))
def tokens_plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(text.tokens_plural, spark, sf_dir)


@query(_token_sql(r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"))
def tokens_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(text.tokens_unicode, spark, sf_dir)


@query(f"""WITH t AS (SELECT doc_id, unnest({stemmed_sql("text")}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.term_stats(ranking.postings(_texts(spark, sf_dir), "doc_id", text.tokens_stemmed(F.col("text"))))


def _bm25_sql(tokens, idf: str, repeated: bool, k1: float = 1.2, b: float = 0.7, where: str = "") -> str:
    weight = "qtf" if repeated else "1"
    return f"""
d AS (SELECT doc_id, source, lang, {tokens("text")} AS ts FROM documents {where}),
stat AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1.0) AS avgdl FROM d),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum({weight} * ln({'1 + ' if idf == 'plus_one' else ''}(n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), stat GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def _bm25(spark: SparkSession, sf_dir: str, tokens=text.tokens_stemmed, k: int = 5, **options) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pruned.bm25_top(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", tokens, k, **options)


@query(f"WITH {_bm25_sql(stemmed_sql, 'plus_one', False)} SELECT item_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the five best documents for every benchmark item."""
    return _bm25(spark, sf_dir).select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(f"WITH {_bm25_sql(plural_sql, 'okapi', True, 1.5, 0.75)} SELECT item_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 6")
def bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bm25(spark, sf_dir, text.tokens_plural, 6, k1=1.5, b=0.75, idf="okapi", repeated=True)
    return found.select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


_WORD_SQL = "string_split(trim(text), ' ')[1]"


@query(f"""WITH d AS (SELECT doc_id, {plural_sql("text")} AS ts FROM documents),
stat AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1.0) AS avgdl FROM d),
q AS (SELECT DISTINCT item_id, unnest({plural_sql(_WORD_SQL)}) AS term FROM benchmark),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), stat GROUP BY item_id, doc_id),
a AS (SELECT b.item_id, d.doc_id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN d LEFT JOIN s ON s.item_id = b.item_id AND s.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM a)
SELECT item_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 15""")
def zero_score_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of 15 for queries of one word, documents without it at the end."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.get(F.split(F.trim("text"), " "), F.lit(0)).alias("text"))
    ranked = pruned.bm25_top(docs, items, "doc_id", "item_id", text.tokens_plural, 15, 1.5, 0.75)
    return ranking.listed_in_full(ranked, docs, items, "item_id", "doc_id", 15).select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


_DENSE_SQL = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS ql, b.label AS dl, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM c)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranking.dense(rows.select(F.col("vec_id").alias("id"), "embedding"), queries, "id", "query_id", k)


@query(f"WITH {_DENSE_SQL} SELECT query_id, id, rank, round(score, 4) AS score FROM dr WHERE rank <= 8")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 50 are the stated queries."""
    return _dense(spark, sf_dir, 8).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _bm25(spark, sf_dir, text.tokens_unicode, 15), _bm25(spark, sf_dir, text.tokens_plural, 15, k1=1.5, b=0.75)


def _fusion_sql(how: str) -> str:
    one = _bm25_sql(lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')", "plus_one", False)
    two = _bm25_sql(plural_sql, "plus_one", False, 1.5, 0.75)
    part = lambda c: f"coalesce(1.0 / (60 + {c}), 0)"
    score = f"{part('rank_a')} + {part('rank_b')}" if how == "sum" else f"greatest({part('rank_a')}, {part('rank_b')})"
    return f"""WITH a AS (WITH {one} SELECT item_id, doc_id, rank AS rank_a FROM r WHERE rank <= 15),
b AS (WITH {two} SELECT item_id, doc_id, rank AS rank_b FROM r WHERE rank <= 15),
m AS (SELECT item_id, doc_id, {score} AS score FROM a FULL JOIN b USING (item_id, doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m)
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM o WHERE rank <= 5"""


def _fused(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    fused = ranking.rrf(*_two_lists(spark, sf_dir), "item_id", "doc_id", how)
    return ranking.top_k(fused, "item_id", "doc_id", 5).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(_fusion_sql("sum"))
def rrf_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "sum")


@query(_fusion_sql("max"))
def rrf_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "max")


_VOTE_SQL = f"""WITH {_bm25_sql(stemmed_sql, 'plus_one', False)},
h AS (SELECT r.item_id, r.doc_id, r.rank, d.source FROM r JOIN d USING (doc_id) WHERE rank <= 8),
t AS (SELECT item_id, source, sum(pow(2, -(rank - 1))) AS vote, min(rank) AS first_rank FROM h GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY vote DESC, first_rank) AS n FROM t)"""


@query(_VOTE_SQL + " SELECT item_id, source, round(vote, 6) AS vote, first_rank FROM w WHERE n = 1")
def source_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir, k=8).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return ranking.source_vote(hits, "item_id", "source", 8).select("item_id", "source", F.round("vote", 6).alias("vote"), "first_rank")


@query(_VOTE_SQL + " SELECT h.item_id, h.doc_id, h.rank, h.source FROM h JOIN w ON w.n = 1 AND w.item_id = h.item_id AND w.source = h.source")
def one_source_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the voted source only."""
    hits = _bm25(spark, sf_dir, k=8).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    voted = ranking.source_vote(hits, "item_id", "source", 8).select("item_id", "source")
    return hits.join(voted, ["item_id", "source"], "left_semi").select("item_id", "doc_id", "rank", "source")


@query(f"""WITH {_bm25_sql(plural_sql, 'plus_one', True, 1.5, 0.75)},
qt AS (SELECT item_id, list_distinct({plural_sql("text")}) AS asked FROM benchmark),
m AS (SELECT s.item_id, s.doc_id, s.score, d.lang, score / (CASE WHEN max(score) OVER (PARTITION BY s.item_id) = 0 THEN 1.0 ELSE max(score) OVER (PARTITION BY s.item_id) END)
  + len(list_intersect(list_distinct(string_split(d.lang || ' ' || d.source, ' ')), asked)) / greatest(len(asked), 1)
  + CASE WHEN item_id % 2 = 0 AND d.lang = 'en' THEN 0.5 ELSE 0 END + CASE WHEN d.source = 'src0' THEN -0.25 ELSE 0 END AS final
  FROM s JOIN d USING (doc_id) JOIN qt USING (item_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(final, 9) DESC, doc_id DESC) AS rank FROM m)
SELECT item_id, doc_id, rank, round(final, 4) AS final FROM o WHERE rank <= 6 AND final > 0 AND (score > 0 OR final > 0.5)""")
def boosted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised score, overlap with labels and rule weights; of equal scores the higher id first; the cut follows the limit."""
    ship(spark)
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    scored = pruned.bm25_by_group(docs, items, "doc_id", "item_id", text.tokens_plural, ["lang", "source"], 6, 1.5, 0.75, repeated=True)
    rows = scored.join(items.select("item_id", text.tokens_plural(F.col("text")).alias("asked")), "item_id")
    rules = [(F.col("item_id") % 2 == 0, F.col("lang") == "en", 0.5), (F.lit(True), F.col("source") == "src0", -0.25)]
    final = ranking.boosted(rows, "item_id", rules, F.array("lang", "source"), F.col("asked"), F.col("best"))
    ranked = ranking.top_k(final, "item_id", "doc_id", 6, "final", higher_id_first=True)
    return ranking.cut_after_limit(ranked, 6).select("item_id", "doc_id", "rank", F.round("final", 4).alias("final"))


@query(f"""WITH {_bm25_sql(stemmed_sql, 'plus_one', False)},
exact AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
u AS (SELECT item_id, doc_id, 0 AS stage FROM exact UNION ALL SELECT item_id, doc_id, 1 FROM r WHERE rank <= 3),
m AS (SELECT *, min(stage) OVER (PARTITION BY item_id) AS f FROM u)
SELECT item_id, doc_id, stage FROM m WHERE stage = f""")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact passages if there are any, else the ranked hits."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    exact = relational.passages(docs, items, "doc_id", "text", "item_id", "passage")
    ranked = _bm25(spark, sf_dir, k=3).select("item_id", "doc_id")
    return ranking.cascade([exact, ranked], "item_id")


@query(f"""WITH {_DENSE_SQL}, m AS (SELECT query_id, min(CASE WHEN ql = dl THEN rank END) AS f FROM dr WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, f IS NOT NULL AS hit, round(coalesce(1.0 / f, 0), 6) AS mrr FROM m""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _dense(spark, sf_dir, 5).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    found = found.join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("dl")), "id")
    return ranking.quality(found, "query_id", F.col("ql") == F.col("dl")).select("query_id", "hit", F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {_bm25_sql(stemmed_sql, 'plus_one', False)},
h AS (SELECT item_id, doc_id, score AS lexical, (doc_id * 37 % 100) / 100.0 AS distance FROM s),
x AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE lexical END AS lex FROM h)
SELECT item_id, count(*) AS n_hits, sum(doc_id)::BIGINT AS ids FROM x WHERE (lex > 0 OR distance <= 0.85) GROUP BY item_id""")
def admitted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that words or vectors admit."""
    scored = ranking.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", text.tokens_stemmed)
    hits = scored.withColumn("distance", (F.col("doc_id") * 37 % 100) / 100.0)
    hits = hits.withColumn("lexical", F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(F.col("score")))
    return ranking.admitted(hits, "item_id").groupBy("item_id").agg(F.count("*").alias("n_hits"), F.sum("doc_id").alias("ids"))


# -- pages as an answer shows them --------------------------------------------------------------------------------

_SHOWN_CHARS = 700
#: Sections of the query below: lines with marks, questions and long lines.
_PAGE_SECTIONS = [
    pages.Section("### Marked", lambda s: s.rlike("[#%$*]{3}"), lambda s: F.concat(F.lit("- "), F.regexp_replace(s, "[#%$*]{3}", ""))),
    pages.Section("### Long", lambda s: F.length(s) > 300, lambda s: s),
]


@query(r"""WITH a AS (SELECT page_id, url, list_filter(list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: trim(x)), lambda x: x <> '') AS lines,
  coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), ''), 'none') AS title FROM pages),
p AS (SELECT *, CASE WHEN len(lines) = 0 THEN 'fallback' WHEN contains(url, '/en/') THEN 'profile'
  WHEN len(list_filter(lines, lambda x: starts_with(x, 'Le'))) > 0 THEN 'roster' ELSE 'generic' END AS kind FROM a),
l AS (SELECT page_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM p WHERE kind = 'profile'),
c AS (SELECT *, CASE WHEN regexp_matches(x, '[#%$*]{3}') THEN 2 WHEN length(x) > 300 THEN 1 ELSE 0 END AS k FROM l),
o AS (SELECT *, max(k) OVER (PARTITION BY page_id ORDER BY i) > 0 AS begun FROM c),
t AS (SELECT page_id, k, CASE k WHEN 0 THEN '### Overview & Academic Background' WHEN 1 THEN '### Long' ELSE '### Marked' END || chr(10)
  || string_agg(CASE k WHEN 2 THEN '- ' || regexp_replace(x, '[#%$*]{3}', '', 'g') ELSE x END, chr(10) ORDER BY i) AS part
  FROM o WHERE k > 0 OR NOT begun GROUP BY page_id, k),
b AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
profiles AS (SELECT page_id, string_agg(left(part, greatest(700 - before, 0)::BIGINT), chr(10) || chr(10) ORDER BY k) FILTER (before < 700) AS base, sum(length(part)) + 2 * (count(*) - 1) AS size FROM b GROUP BY page_id),
extra AS (SELECT page_id, base, size, 700 - size AS room, title FROM profiles JOIN p USING (page_id)),
shown AS (
  SELECT page_id, CASE WHEN room > 300 AND NOT contains(base, title) THEN base || chr(10) || chr(10) || '### Additional Relevant Records' || chr(10) || trim(left(title, room::BIGINT), chr(10) || ' ') ELSE base END AS s FROM extra
  UNION ALL SELECT page_id, url FROM p WHERE kind = 'fallback'
  UNION ALL SELECT page_id, trim(left(array_to_string(lines[1:10], chr(10)), 400), chr(10) || ' ') || chr(10) || chr(10) || '### Faculty Roster' || chr(10)
    || array_to_string(list_concat(list_filter(lines, lambda x: starts_with(x, 'Le') AND contains(lower(x), 'tion')), list_filter(lines, lambda x: starts_with(x, 'Le') AND NOT contains(lower(x), 'tion'))), chr(10)) FROM p WHERE kind = 'roster'
  UNION ALL SELECT page_id, CASE WHEN length(array_to_string(lines, chr(10))) <= 700 THEN array_to_string(lines, chr(10))
    WHEN contains(title, string_split(trim(left(array_to_string(lines[1:10], chr(10)), 600), chr(10) || ' '), chr(10))[1]) THEN title
    ELSE trim(left(array_to_string(lines[1:10], chr(10)), 600), chr(10) || ' ') || chr(10) || chr(10) || title END FROM p WHERE kind = 'generic')
SELECT page_id, kind, length(trim(left(s, 700), chr(10) || ' ')) AS n_chars, sha256(trim(left(s, 700), chr(10) || ' ')) AS shown FROM shown JOIN p USING (page_id)""")
def page_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one language by section, those with lines of a label as rosters, others as they begin; all within one budget."""
    rows = table(spark, sf_dir, "pages")
    lines = F.filter(F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)", 1))
    asked = rows.select("page_id", "url", lines.alias("lines"), F.array(F.when(title == "", "none").otherwise(title)).alias("hits"), F.lit("tell about tion").alias("query"), F.col("url").alias("fallback"))
    found = pages.represented(asked, _SHOWN_CHARS, F.contains("url", F.lit("/en/")), "Le", _PAGE_SECTIONS, ["### Long", "### Marked"])
    return found.select("page_id", "kind", F.length("shown").cast("long").alias("n_chars"), F.sha2("shown", 256).alias("shown"))


# -- whole chains -------------------------------------------------------------------------------------------------

_HYBRID_SQL = f"""{_bm25_sql(stemmed_sql, 'plus_one', False, where="WHERE doc_id IN (SELECT vec_id FROM embeddings)")},
e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
n AS (SELECT b.item_id, e.vec_id AS doc_id, 1 - list_dot_product(v.embedding::DOUBLE[], e.e) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(e.e, e.e)) AS distance
  FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id, e),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(1 - distance, 9) DESC, doc_id) AS dense_rank FROM n) WHERE dense_rank <= 120),
j AS (SELECT c.*, coalesce(s.score, 0) AS lexical, d.source FROM c LEFT JOIN s ON s.item_id = c.item_id AND s.doc_id = c.doc_id JOIN d ON d.doc_id = c.doc_id),
l AS (SELECT *, CASE WHEN lexical > 0 THEN row_number() OVER (PARTITION BY item_id, lexical > 0 ORDER BY round(lexical, 9) DESC, dense_rank) END AS lexical_rank,
  max(lexical) OVER (PARTITION BY item_id) > 0 OR min(distance) OVER (PARTITION BY item_id) <= 0.85 AS ok FROM j),
fu AS (SELECT *, greatest(1.0 / (60 + dense_rank), coalesce(1.0 / (60 + lexical_rank), 0)) AS fused FROM l WHERE ok AND (lexical > 0 OR distance <= 0.85)),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, round(lexical, 9) DESC, dense_rank) AS pos FROM fu),
votes AS (SELECT item_id, source, sum(pow(2.0, 1 - pos)) AS vote, min(pos) AS first FROM g WHERE pos <= 8 AND source IS NOT NULL GROUP BY ALL),
w AS (SELECT item_id, source FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY vote DESC, first) AS i FROM votes) WHERE i = 1),
h AS (SELECT g.*, row_number() OVER (PARTITION BY g.item_id ORDER BY pos) AS i FROM g LEFT JOIN w USING (item_id) WHERE w.source IS NULL OR w.source = g.source),
o AS (SELECT item_id, doc_id, source, fused, 1 AS part, i FROM h WHERE i <= 8 UNION ALL
  SELECT item_id, doc_id, source, NULL, 0, 1 FROM benchmark JOIN documents ON doc_id = item_id * 3 AND item_id % 4 = 0),
u AS (SELECT o.*, row_number() OVER (PARTITION BY item_id, o.doc_id % 10, o.source, x.text ORDER BY part, i) AS nth FROM o JOIN documents x ON x.doc_id = o.doc_id),
hybrid AS (SELECT item_id, doc_id, source AS file, fused, row_number() OVER (PARTITION BY item_id ORDER BY part, i) AS place FROM u WHERE nth = 1 QUALIFY place <= 8)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, near = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    all_ = rows.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("file"), (F.col("doc_id") % 10).alias("page"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = items.join(near.select(F.col("id").alias("query_id"), "embedding"), "query_id")
    docs = all_.join(near.select("id"), "id", "left_semi")
    forced = items.where("query_id % 4 = 0").select("query_id", (F.col("query_id") * 3).alias("id"), F.lit(1).alias("ord"))
    # Forced rows may be documents without a vector, which the search does not see.
    found = retrieval.hybrid(docs, near.join(docs.select("id"), "id", "left_semi"), asked, 8, 120)
    extra = forced.join(all_.select("id"), "id", "left_semi")
    return retrieval.with_forced(found, extra, all_, 8)


@query(f"WITH {_HYBRID_SQL} SELECT item_id AS query_id, doc_id AS id, place, file, round(fused, 6) AS fused FROM hybrid")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by vector, admitted by word or distance, fused, cut to the file they vote for, after the forced ones."""
    return _hybrid(spark, sf_dir).select("query_id", "id", "place", "file", F.round("fused", 6).alias("fused"))


#: What comes before an item's text in the cascade query: a catalogue, credits, nothing, modules of a semester, a course by its code.
_OPENINGS = ["sem iv subjects of ", "total credits of the degree: ", "", "semester 2 module on ", "csa%d and "]


@query(f"""WITH {_HYBRID_SQL},
m AS (SELECT doc_id, source, doc_id % 10 AS page, CASE WHEN doc_id % 40 < 8 THEN doc_id % 40 + 1 END AS semester FROM documents),
k AS (SELECT item_id, item_id % 5 AS turn FROM benchmark),
pages_of AS (SELECT DISTINCT source, page, semester FROM m WHERE semester IS NOT NULL),
structure AS (SELECT DISTINCT item_id, m.doc_id FROM k JOIN pages_of g ON g.semester = CASE turn WHEN 0 THEN 4 WHEN 3 THEN 2 END JOIN m ON m.source = g.source AND m.page = g.page
  UNION SELECT item_id, doc_id FROM k JOIN m ON turn = 1 AND page = 3),
v AS (SELECT item_id, doc_id, 0 AS stage FROM structure JOIN k USING (item_id) WHERE turn IN (0, 1)
  UNION ALL SELECT item_id, doc_id, 1 FROM k JOIN m ON turn = 4 AND doc_id = 100 + item_id
  UNION ALL SELECT item_id, doc_id, 2 FROM structure
  UNION ALL SELECT item_id, doc_id, 3 FROM hybrid),
x AS (SELECT *, min(stage) OVER (PARTITION BY item_id) AS low FROM v)
SELECT item_id AS query_id, doc_id AS id, stage FROM x WHERE stage = low""")
def retrieval_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure pages for catalogues and credits, a course's section, pages of a semester, or the hybrid search, whatever answers first."""
    items = table(spark, sf_dir, "benchmark")
    opening = F.element_at(F.array(*[F.lit(o) for o in _OPENINGS]), (F.col("item_id") % 5 + 1).cast("int"))
    queries = items.select(F.col("item_id").alias("query_id"), F.concat(F.replace(opening, F.lit("%d"), (F.col("item_id") + 100).cast("string")), "text").alias("text"))
    roman = F.element_at(F.array(*[F.lit(r) for r in numbers.ROMANS]), (F.col("doc_id") % 40 + 1).cast("int"))
    heading = F.when(F.col("doc_id") % 40 < 8, F.concat(F.lit("Semester "), F.upper(roman))).otherwise("")
    pages_ = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), (F.col("doc_id") % 10).alias("page"), heading.alias("text"))
    marked = sections.semester_markers(pages_.withColumnRenamed("file", "filename"))
    told = intents.with_intents(queries)
    semester = dispatch.named_semester(F.col("text"))
    asked = told.select("query_id", F.when(semester.isNull(), F.array().cast("array<int>")).otherwise(F.array(semester)).alias("semesters"), intents.has("is_credit_query").alias("is_credit"))
    code = F.regexp_extract("text", "csa([0-9]+)", 1).try_cast("long")
    section = queries.select("query_id", code.alias("id")).join(pages_.select("id"), "id").select("query_id", "id")
    return retrieval.retrieve(queries, retrieval.semester_stage(pages_, marked, asked), section, _hybrid(spark, sf_dir))


# -- ingestion ----------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT doc_id, length(text) > 4000 AS bad FROM documents WHERE doc_id % 3 <> 2), b AS (SELECT doc_id, length(text) > 4000 AS bad FROM documents)
SELECT 'first' AS batch, count(*) FILTER (NOT bad) AS new, 0::BIGINT AS skipped, count(*) FILTER (bad) AS failed, (SELECT count(*) FROM b WHERE NOT bad) AS n_rows FROM a
UNION ALL SELECT 'second', count(*) FILTER (NOT bad AND doc_id % 3 = 2), count(*) FILTER (NOT bad AND doc_id % 3 <> 2), count(*) FILTER (bad), count(*) FILTER (NOT bad) FROM b
UNION ALL SELECT 'second again', count(*) FILTER (NOT bad AND doc_id % 3 = 2), count(*) FILTER (NOT bad AND doc_id % 3 <> 2), count(*) FILTER (bad), count(*) FILTER (NOT bad) FROM b""")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of documents, long ones failing, and the second once more: counts of each and all rows at the end."""
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs, long = table(spark, sf_dir, "documents"), F.length("text") > 4000
    counts = [(name, sinks.ingest_batch(rows, path, name.split()[0], "doc_id", failed=long)) for name, rows in (("first", docs.where("doc_id % 3 <> 2")), ("second", docs), ("second again", docs))]
    n = sinks.ingested(spark, path).count()
    return spark.createDataFrame([(name, c["new"], c["skipped"], c["failed"], n) for name, c in counts], "batch string, new long, skipped long, failed long, n_rows long")


# -- the vector store ---------------------------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> vectors.VectorStore:
    ship(spark)
    return vectors.VectorStore.create(table(spark, sf_dir, "embeddings"), f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", "vec_id")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND b.label % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM c)
SELECT query_id, vec_id, rank, round(score, 4) AS score FROM r WHERE rank <= 12""")
def vector_store_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors with an odd label, from all lists of the store."""
    found = _store(spark, sf_dir).query(_asked_vectors(spark, sf_dir), "query_id", 12, "label % 2 = 1", exact=True)
    return found.select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))


@query()
def vector_store_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's eight nearest vectors the lists that it reads give, and how many of the best hold."""
    store, asked = _store(spark, sf_dir), _asked_vectors(spark, sf_dir)
    found = store.query(asked, "query_id", 8).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = store.query(asked, "query_id", 8, exact=True).select("query_id", "vec_id")
    return exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))


@query("""SELECT label, count(*) AS n, (SELECT count(*) FROM embeddings) AS n_all, min(vec_id) AS first, sum(len(embedding))::BIGINT AS width FROM embeddings
WHERE label <> 0 AND vec_id % 3 = 0 GROUP BY label""")
def vector_store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows that pass a filter, by label, beside the store's whole count."""
    store = _store(spark, sf_dir)
    rows = store.get((F.col("label") != 0) & (F.col("vec_id") % 3 == 0))
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.lit(store.count()).cast("long").alias("n_all"), F.min("vec_id").alias("first"), F.sum(F.size("embedding")).alias("width")
    )


# -- windows, joins, sets, aggregates -----------------------------------------------------------------------------


@query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS active FROM events""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading in force at each row, or the default before any."""
    rows = table(spark, sf_dir, "events")
    found = relational.forward_filled(rows, F.when(F.col("event_type") == "signup", F.col("event_id")), "active", "user_id", ["ts", "event_id"], -1)
    return found.select("event_id", "user_id", "active")


@query("""SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM events""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.islands(table(spark, sf_dir, "events"), F.col("event_type") == "purchase", ["user_id"], ["ts", "event_id"])
    return rows.select("event_id", "user_id", "island")


@query("""SELECT user_id, event_id AS start_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) AS next_start
  FROM events WHERE event_type = 'signup'""")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"))
    return relational.ranges(starts, "user_id", "start_id", F.lit(1_000_000_000))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 500 THEN left(text, 500) ELSE text END AS text, back FROM r WHERE back <= 3""")
def last3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_messages(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text", "back")


@query("""SELECT conv_id, count(*) AS n_messages, coalesce(bool_and(role IN ('user', 'assistant') AND length(text) BETWEEN 1 AND 100000)
  AND count(*) <= 20 AND arg_max(role, turn) = 'user', false) AS valid FROM conversations GROUP BY conv_id""")
def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.valid_requests(table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.new_only(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')
UNION ALL SELECT doc_id, 1, 0 FROM documents WHERE lang = 'de'""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return sinks.upserted(table(spark, sf_dir, "labels"), rows, "doc_id")


@query("""WITH x AS (SELECT d.doc_id, d.source, coalesce(l.quality = 1, false) AS c FROM documents d LEFT JOIN labels l USING (doc_id)),
g AS (SELECT *, bool_or(c) OVER (PARTITION BY source) AS a FROM x)
SELECT doc_id, source FROM g WHERE c OR NOT a""")
def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's marked documents, or all of them if none is marked."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return relational.cited_or_all(rows, "source", F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id", "source")


@query("""SELECT n_nationkey, coalesce(r_name, n_name) AS name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def alias_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("name"), "n_name")
    mapping = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("k"), "r_name")
    mapped = relational.mapped_or_same(rows, mapping, "name", "k", "r_name")
    return mapped.select("n_nationkey", F.when(F.col("name").rlike("^[0-9]+$"), F.col("n_name")).otherwise(F.col("name")).alias("name"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_size % 2 = 0 AS flag, trim(regexp_replace(lower(p_name), '\\b(lab|laboratory|practical)s?\\b|s\\b', '', 'g')) AS n FROM part)
SELECT a.p_partkey, a.p_name, min(b.p_partkey) AS pair FROM p a JOIN p b ON a.flag <> b.flag AND split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1)
  AND (a.n = b.n OR (length(a.n) > 5 AND contains(b.n, a.n)) OR (length(b.n) > 5 AND contains(a.n, b.n))) GROUP BY ALL""")
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 2 == 0).alias("flag"))
    return relational.paired(items, "p_partkey", "p_name", "flag")


@query("""WITH w AS (SELECT n_nationkey AS k, string_split(lower(n_name), ' ') AS a FROM nation), t AS (SELECT r_regionkey AS r, string_split(lower(r_name), ' ') AS b FROM region),
e AS (SELECT k, unnest(a) AS x FROM w), g AS (SELECT r, unnest(b) AS x FROM t)
SELECT DISTINCT k, r FROM e JOIN g USING (x)""")
def overlap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose word sets overlap, by a join on the words."""
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.split(F.lower("n_name"), " ")).alias("x"))
    right = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.explode(F.split(F.lower("r_name"), " ")).alias("x"))
    return left.join(right, "x").select("k", "r").distinct()


@query("""WITH u AS (SELECT 0 AS part, doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT 1, doc_id FROM documents WHERE source = 'src3'
  UNION ALL SELECT 2, doc_id FROM labels WHERE toxic = 1),
f AS (SELECT doc_id, min(part) AS part FROM u GROUP BY doc_id)
SELECT doc_id, part, row_number() OVER (ORDER BY part, doc_id) AS place FROM f QUALIFY place <= 200""")
def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered union without repeats, cut at its limit."""
    docs = table(spark, sf_dir, "documents")
    parts = [docs.where("lang = 'fr'"), docs.where("source = 'src3'"), table(spark, sf_dir, "labels").where("toxic = 1")]
    return relational.union_first([p.select("doc_id") for p in parts], "doc_id", "doc_id", 200).select("doc_id", "part", "place")


@query(f"""WITH q AS (SELECT item_id, list_distinct({plural_sql("text")}) AS t FROM benchmark),
n AS (SELECT item_id, lead(t) OVER (ORDER BY item_id) AS o, t FROM q)
SELECT item_id, len(list_intersect(t, o)) AS n_common, len(list_filter(t, lambda x: NOT list_contains(o, x))) AS n_own,
  len(list_filter(t, lambda x: NOT list_contains(o, x))) = 0 AS is_subset FROM n WHERE o IS NOT NULL""")
def term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common and own terms of each item and the next."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(text.tokens_plural(F.col("text"))).alias("t"))
    rows = rows.withColumn("o", F.lead("t").over(Window.orderBy("item_id"))).where("o is not null")
    own = F.size(F.array_except("t", "o"))
    return rows.select("item_id", F.size(F.array_intersect("t", "o")).alias("n_common"), own.alias("n_own"), (own == 0).alias("is_subset"))


@query("""WITH p AS (SELECT o_orderpriority AS category, sum(CASE WHEN year(o_orderdate) = 1993 THEN o_totalprice END) AS year_1993,
  sum(CASE WHEN year(o_orderdate) = 1994 THEN o_totalprice END) AS year_1994, sum(CASE WHEN year(o_orderdate) = 1995 THEN o_totalprice END) AS year_1995, sum(o_totalprice) AS total
  FROM orders GROUP BY ROLLUP (o_orderpriority))
SELECT coalesce(category, 'Total') AS category, round(year_1993, 2) AS year_1993, round(year_1994, 2) AS year_1994, round(year_1995, 2) AS year_1995, round(total, 2) AS total FROM p""")
def credit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by category and period with totals of both."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.year("o_orderdate").alias("year"), "o_totalprice")
    found = relational.pivot_totals(rows, "category", "year", [1993, 1994, 1995], F.col("o_totalprice"))
    return found.select("category", *[F.round(c, 2).alias(c) for c in ("year_1993", "year_1994", "year_1995", "total")])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag, l_linestatus)::BIGINT AS level
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().cast("long").alias("level"))


@query("""SELECT d.source, count(*) AS n_docs, count(DISTINCT d.lang) AS n_langs, count(*) FILTER (l.quality = 1) AS n_good, count(l.doc_id) AS n_labelled,
  array_to_string(list_sort(list(DISTINCT d.lang)), ',') AS langs FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def module_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct counts and sorted sets by group."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.count_if(F.col("quality") == 1).alias("n_good"),
        F.count("quality").alias("n_labelled"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"),
    )


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS name FROM documents),
v AS (SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS name FROM benchmark) WHERE length(name) >= 6),
m AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS n FROM w JOIN v USING (name))
SELECT doc_id, name AS matched FROM m WHERE n = 1""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest known word that each document holds."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("name")
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("name")).where("length(name) >= 6").distinct()
    met = table(spark, sf_dir, "documents").select("doc_id", words).join(known, "name")
    return relational.first_of(met, ["doc_id"], [F.length("name").desc(), "name"]).select("doc_id", F.col("name").alias("matched"))


@query("""SELECT source, array_to_string(list_sort(list(DISTINCT doc_id % 10)), ', ') AS pages,
  source || CASE WHEN count(DISTINCT doc_id % 10) > 1 THEN ' (Pages ' ELSE ' (Page ' END || array_to_string(list_sort(list(DISTINCT doc_id % 10)), ', ') || ')' AS title
  FROM documents GROUP BY source""")
def grouped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 10).alias("page"))
    found = extract.grouped_sources(hits, "source")
    return found.select("source", F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ").alias("pages"), "title")


@query("""WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source, left(regexp_replace(lower(text), '\\s+', ' ', 'g'), 250) ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, source FROM k WHERE n = 1""")
def context_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.contexts(table(spark, sf_dir, "documents"), "source", "doc_id").select("doc_id", "source")


@query("""SELECT page_id, CASE WHEN substr(html, 1001, 500) = '' THEN 'No more content.' WHEN length(html) > 1500
  THEN substr(html, 1001, 500) || chr(10) || chr(10) || '[Continues at offset 1500.]' ELSE substr(html, 1001, 500) END AS piece FROM pages""")
def read_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", extract.read_page(F.col("html"), 1000, 500).alias("piece"))


# -- query understanding ------------------------------------------------------------------------------------------

#: Our own rules, over the words of the given tables.
REWRITES = [
    (r"(^|[ \n])th([ ,.\n]|$)", "$1the$2"),
    (r"the the", "the"),
    (r"(^|[ \n])re([ ,.\n]|$)", "$1are$2"),
    (r"the ([a-z]+ing)([ ,.\n]|$)", "that $1$2"),
    (r"that", "that one"),
    (r"dept", "department"),
]
INTENTS = [
    ("project", r"\b(nomenclature|projects?)\b"),
    ("website", r"\b(faculty|campus|that)\b"),
    ("document", r"\b(policy|brochure|was|und)\b"),
    ("syllabus", r"\b(syllabus|module|semester|and|les)\b"),
]


def _rewrite_sql(column: str) -> str:
    for pattern, replacement in REWRITES:
        column = f"regexp_replace({column}, {quoted('(?i)' + pattern)}, {quoted(replacement.replace('$', chr(92)))}, 'g')"
    return column


@query(f"SELECT conv_id, turn, {_rewrite_sql('text')} AS rewritten FROM conversations")
def rewrite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", understanding.rewritten(F.col("text"), REWRITES).alias("rewritten"))


def _intent_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), {quoted(p)}) THEN {quoted(n)}" for n, p in INTENTS) + " END"


@query(f"SELECT conv_id, turn, coalesce({_intent_sql('text')}, {_intent_sql('(' + _rewrite_sql('text') + ')')}, 'website') AS intent FROM conversations")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", understanding.intent_with_rewrite(F.col("text"), INTENTS, REWRITES, "website").alias("intent"))


def _numbers(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 7 AS turn, p_size % 6 + 1 AS a, p_partkey // 7 % 6 + 1 AS b FROM part),
n AS (SELECT *, CASE turn WHEN 0 THEN 'first' WHEN 1 THEN 'last' WHEN 2 THEN 'range' WHEN 3 THEN 'range' WHEN 4 THEN 'list' WHEN 5 THEN 'list' ELSE 'all' END AS kind FROM p)
SELECT p_partkey, kind, array_to_string(list_filter(range(1, 7), lambda x: CASE turn WHEN 0 THEN x <= a WHEN 1 THEN x > 6 - a WHEN 2 THEN x BETWEEN least(a, b) AND greatest(a, b)
  WHEN 3 THEN x BETWEEN least(a, b) AND greatest(a, b) WHEN 4 THEN x = a OR x = b WHEN 5 THEN x = a OR x = b ELSE true END), ',') AS numbers FROM n""")
def number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases made of each part's numbers, and the modules of 1 to 6 that they ask for."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6 + 1).alias("a"), F.expr("p_partkey div 7 % 6 + 1").cast("int").alias("b"))
    word = lambda c, words: F.element_at(F.array(*[F.lit(w) for w in words]), F.col(c))
    phrases = [
        F.concat(F.lit("show the first "), word("a", numbers.CARDINALS), F.lit(" modules")), F.concat(F.lit("last "), "a", F.lit(" modules please")),
        F.concat(F.lit("modules between "), "a", F.lit(" and "), "b"), F.concat(F.lit("explain modules "), "a", F.lit("-"), "b"),
        F.concat(F.lit("modules "), "a", F.lit(", "), word("b", numbers.CARDINALS)), F.concat(word("a", numbers.ORDINALS), F.lit(" and "), word("b", numbers.ORDINALS), F.lit(" modules")), F.lit("the whole course"),
    ]
    asked = rows.select("p_partkey", numbers.requested(F.element_at(F.array(*phrases), (F.col("p_partkey") % 7 + 1).cast("int")), "module").alias("r"))
    return asked.select("p_partkey", "r.kind", _numbers(numbers.selected(F.col("r"), F.array(*[F.lit(i) for i in range(1, 7)]))).alias("numbers"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS turn, p_size % 8 + 1 AS a, p_partkey // 5 % 8 + 1 AS b FROM part)
SELECT p_partkey, array_to_string(list_filter(range(1, 9), lambda x: CASE turn WHEN 0 THEN x BETWEEN least(a, b) AND greatest(a, b) WHEN 1 THEN x = a OR x = b WHEN 2 THEN x = a WHEN 3 THEN x = b ELSE false END), ',') AS semesters FROM p""")
def semester_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases made of each part's numbers, and the semesters that they name."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8 + 1).alias("a"), F.expr("p_partkey div 5 % 8 + 1").cast("int").alias("b"))
    word = lambda c, words: F.element_at(F.array(*[F.lit(w) for w in words]), F.col(c))
    phrases = [
        F.concat(F.lit("semester "), word("a", list(numbers.ROMANS)), F.lit(" to "), word("b", list(numbers.ROMANS))), F.concat(F.lit("sem "), "a", F.lit(" and sem "), "b"),
        F.concat(word("a", numbers.ORDINALS), F.lit(" semester")), F.concat(F.lit("semester "), "b"), F.lit("no term named"),
    ]
    asked = rows.select("p_partkey", F.element_at(F.array(*phrases), (F.col("p_partkey") % 5 + 1).cast("int")).alias("phrase"))
    return asked.select("p_partkey", _numbers(understanding.requested_semesters(F.col("phrase"))).alias("semesters"))


_PLAIN = "list_filter(string_split(regexp_replace(lower(%s), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""WITH g AS (SELECT 'B' || item_id AS code, {_PLAIN % "text"} AS ws FROM benchmark UNION ALL SELECT 'L' || item_id, {_PLAIN % "split_part(text, chr(10), 1)"} FROM benchmark
  UNION ALL SELECT 'N' || n_nationkey, {_PLAIN % "n_name"} FROM nation),
a AS (SELECT DISTINCT code, ws, len(ws) AS n FROM g WHERE len(ws) > 0),
d AS (SELECT doc_id, {_PLAIN % "text"} AS ws FROM documents),
t AS (SELECT doc_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
h AS (SELECT doc_id, code, a.ws AS aws, n, i FROM t JOIN a ON w = a.ws[1] WHERE t.ws[i:i + n - 1] = a.ws)
SELECT doc_id, array_to_string(aws, ' ') AS alias, code, i - 1 AS place FROM h x
WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.doc_id = x.doc_id AND y.n > x.n AND y.i < x.i + x.n AND x.i < y.i + y.n)""")
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, their first lines and nations that texts hold, at every place, unless a longer alias covers it."""
    items = table(spark, sf_dir, "benchmark")
    named = lambda prefix, key, alias: (alias.alias("alias"), F.concat(F.lit(prefix), key).alias("code"))
    aliases = items.select(*named("B", "item_id", F.col("text"))).unionByName(items.select(*named("L", "item_id", F.split_part("text", F.lit("\n"), F.lit(1)))))
    aliases = aliases.unionByName(table(spark, sf_dir, "nation").select(*named("N", "n_nationkey", F.col("n_name"))))
    ship(spark)
    return understanding.alias_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), aliases.distinct(), "doc_id", "text")


@query()
def entity_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the items whose whole text a document holds, at any place."""
    ship(spark)
    aliases = table(spark, sf_dir, "benchmark").select(F.col("text").alias("alias"), F.concat(F.lit("B"), "item_id").alias("code"))
    return understanding.entities(table(spark, sf_dir, "documents"), aliases, "doc_id", "text")


CATEGORIES = [("notice", ["notice", "the"]), ("report", ["report", "fr/", "de/"]), ("form", ["form", "page"]), ("library", ["library", "book"])]


@query("SELECT page_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(url), {quoted(w)})" for w in ws) + f" THEN {quoted(c)}" for c, ws in CATEGORIES) + " ELSE 'general' END AS category FROM pages")
def category_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.first_match(F.col("url"), CATEGORIES, "general").alias("category"))


@query("""WITH n AS (SELECT DISTINCT lower(n_name) AS n FROM nation WHERE length(n_name) >= 4)
SELECT string_agg(regexp_replace(n, '([\\\\.^$|?*+()\\[\\]{}])', '\\\\\\1', 'g'), '|' ORDER BY -length(n), n) AS pattern FROM n""")
def catalogue_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.catalogue_pattern(table(spark, sf_dir, "nation"), "n_name")


@query(r"""WITH s AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1)), '\.(php|html)$', ''), '[-_.]')) AS token FROM pages)
SELECT DISTINCT token FROM s WHERE length(token) >= 3 AND regexp_matches(token, '^[a-z]+$') AND token NOT IN ('www', 'com')""")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.name_tokens(table(spark, sf_dir, "pages"), ["www", "com"])


@query(rf"""WITH p AS (SELECT url, list_filter(list_transform(list_concat(regexp_extract_all(html, '<li><a[^>]*>([^<]*)<', 1), regexp_extract_all(html, '<h1>([^<]*)<', 1)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
sl AS (SELECT lower(regexp_replace(string_split(url, '/en/')[-1], '^/+|/+$', '', 'g')) AS s FROM p WHERE contains(url, '/en/')),
first AS (SELECT unnest(lines[1:4]) AS x FROM p WHERE contains(url, '/en/')),
kept AS (SELECT trim(regexp_replace(regexp_replace(x, '^(?i:dr|mr|mrs|ms|prof)(?:[.]\s*|\s+)', ''), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')) AS x FROM first WHERE NOT (contains(x, '@') OR contains(x, 'Home') OR contains(x, 'Serving') OR starts_with(x, '##'))),
w AS (SELECT list_filter(regexp_split_to_array(x, '\s+'), lambda t: t <> '') AS ws FROM kept),
st AS (SELECT list_filter(regexp_split_to_array(regexp_replace(regexp_replace(trim(regexp_extract(unnest(lines), '^Les\s*([^;]+)', 1)), '^(?i:dr|mr|mrs|ms|prof)(?:[.]\s*|\s+)', ''), '[.-]+', ' ', 'g'), '\s+'), lambda t: t <> '') AS ws FROM p),
g AS (SELECT list_filter(list_transform(ws, lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ('the', 'and')) AS ws FROM (SELECT ws FROM w WHERE len(ws) BETWEEN 1 AND 4 UNION ALL SELECT ws FROM st)),
names AS (
  SELECT unnest(string_split(s, '-')) AS name FROM sl UNION SELECT trim(replace(s, '-', ' ')) FROM sl UNION SELECT regexp_extract(s, '^([a-z]{{4,}})[a-z]$', 1) FROM sl
  UNION SELECT unnest(ws) FROM g UNION SELECT array_to_string(ws, ' ') FROM g WHERE len(ws) >= 2),
a AS (SELECT DISTINCT name, {_PLAIN % "name"} AS ws FROM names WHERE length(name) >= 3 AND name NOT IN ('the', 'and')),
d AS (SELECT conv_id * 100 + turn AS id, {_PLAIN % "text"} AS ws FROM conversations),
t AS (SELECT id, ws, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
h AS (SELECT id, name, len(a.ws) AS n, i FROM t JOIN a ON x = a.ws[1] WHERE t.ws[i:i + len(a.ws) - 1] = a.ws)
SELECT id, name, i - 1 AS place FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.id = x.id AND y.n > x.n AND y.i < x.i + x.n AND x.i < y.i + y.n)""")
def names_in_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from addresses, first lines and labelled lines of pages, wherever a message has them."""
    ship(spark)
    found = F.concat(F.regexp_extract_all("html", F.lit("<li><a[^>]*>([^<]*)<"), F.lit(1)), F.regexp_extract_all("html", F.lit("<h1>([^<]*)<"), F.lit(1)))
    lines = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")
    names = understanding.name_dictionary(table(spark, sf_dir, "pages").select("url", lines.alias("lines")), ["the", "and"], "/en/", "Les")
    messages = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return understanding.names_in(messages, names, "id")


# -- structure and extraction over pages made of parts -------------------------------------------------------------


def _course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a course for each part, with the part's name, brand, kind and size in it."""
    lines = [
        F.concat(F.lit("CSA"), F.col("p_partkey") % 900 + 100, F.lit(" "), F.initcap("p_name")),
        F.concat(F.lit("Prerequisites: Algebra, Logic and "), F.initcap("p_type")),
        F.concat(F.lit("1.0 Records "), F.col("p_size") % 9 + 1),
        F.concat(F.lit("1.1 Rows of "), "p_name"),
        F.lit("continued over lines\n802.11 a foreign number\nCO1 1.2 Keys"),
        F.concat(F.lit("Self-learning topics: "), "p_name", F.lit(" cards")),
        F.concat(F.lit("2.0 Joins "), F.col("p_size") % 7 + 1),
        F.concat(F.lit("2.1 Hash joins\nText Books\n1. The "), "p_name", F.lit("\nsecond line\n2. Other book\nReferences\n1) A paper\n2.2 Sort joins")),
        F.concat(F.lit("End Semester Exam Pattern: "), F.col("p_size") % 5 + 3, F.lit(" questions, two to answer")),
        F.concat(F.lit("Assessment: tests of "), "p_size", F.lit(" marks")),
        F.concat(F.lit("Scheme: "), F.col("p_size") % 4 + 1, F.lit(" "), F.col("p_partkey") % 3 + 1, F.lit(" - 3 1 - "), F.col("p_size") % 6 + 2),
    ]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("filename"), F.lit(1).alias("page"), F.concat_ws("\n", *lines).alias("text"))


_TITLE_SQL = "array_to_string(list_transform(string_split(%s, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query(f"""SELECT p_partkey AS filename, '1. The ' || p_name || chr(10) || 'second line' || chr(10) || '2. Other book' AS textbooks_part, 2 AS n_textbooks, 'The ' || p_name || ' second line' AS first_textbook,
  (p_size % 5 + 3) || ' questions, two to answer' AS exam, 'tests of ' || p_size || ' marks' AS assessed, 'Algebra|Logic|' || {_TITLE_SQL % "p_type"} AS needs FROM part""")
def between_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    part = extract.between_headings(t, r"text\s?books?")
    return _course(spark, sf_dir).select(
        "filename", part.alias("textbooks_part"), F.size(extract.numbered_items(part)).alias("n_textbooks"), F.get(extract.numbered_items(part), 0).alias("first_textbook"),
        extract.exam_pattern(t).alias("exam"), extract.assessment(t).alias("assessed"), F.array_join(extract.prerequisites(t), "|").alias("needs"),
    )


@query("SELECT p_partkey AS filename, (p_size % 4 + 1)::DOUBLE AS theory, (p_partkey % 3 + 1)::DOUBLE AS practical, (p_size % 6 + 2)::DOUBLE AS credits, 5 AS n FROM part")
def scheme_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _course(spark, sf_dir).select("filename", extract.scheme(F.col("text"), "scheme").alias("s"), F.size(extract.scheme_numbers(F.col("text"), "scheme")).alias("n"))
    return found.select("filename", "s.theory", "s.practical", "s.credits", "n")


@query("""SELECT p_partkey AS part, number, title FROM part, unnest([{'number': 1, 'title': 'Load a ' || p_name || ' with many rows'}, {'number': 2, 'title': 'Join two of ' || lower(p_type)},
  {'number': 4, 'title': 'Window sums 9 out of order'}]) AS t(e), (SELECT 1) AS one, LATERAL (SELECT e.number AS number, e.title AS title) AS x""")
def numbered_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of experiments for each part; a number out of order goes on the line before."""
    ship(spark)
    lines = ["Experiments\n1 Load a ", "p_name", "\nwith many rows\n2\nJoin two of ", "type", "\n4 Window sums\n9 out of order\nReferences\n1. A manual"]
    rows = table(spark, sf_dir, "part").withColumn("type", F.lower("p_type"))
    rows = rows.select("p_partkey", F.concat(*[F.col(x) if x in ("p_name", "type") else F.lit(x) for x in lines]).alias("text"))
    return rows.select(F.col("p_partkey").alias("part"), F.explode(structure.lab_experiments("text")).alias("e")).select("part", "e.number", "e.title")


@query("""SELECT p_partkey AS filename, 1 AS number, 'Records' AS title, p_size % 9 + 1 AS hours, '1.1 Rows of ' || p_name || ' continued over lines 802.11 a foreign number|1.2 Keys' AS units, p_name || ' cards' AS self_learning FROM part
UNION ALL SELECT p_partkey, 2, 'Joins', p_size % 7 + 1, '2.1 Hash joins|2.2 Sort joins', '' FROM part""")
def module_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    lines = structure.page_lines(_course(spark, sf_dir))
    found = structure.module_outlines(lines, "filename")
    units = F.array_join(F.transform("units", lambda u: F.concat_ws(" ", u["number"], u["text"])), "|")
    return found.select("filename", "number", "title", "hours", units.alias("units"), F.array_join("self_learning", "|").alias("self_learning"))


@query("""WITH c AS (SELECT * FROM (VALUES (0, 'general', NULL, NULL), (1, 'module', '1', NULL), (2, 'unit', '1', '1.1'), (3, 'unit', '1', '1.2'), (4, 'self_learning', '1', '1.2'),
  (5, 'module', '2', NULL), (6, 'unit', '2', '2.1'), (7, 'unit', '2', '2.2')) AS v(chunk_index, section_type, module_no, unit_no))
SELECT p_partkey AS filename, chunk_index, section_type, 'CSA' || (p_partkey % 900 + 100) AS course_code, module_no, unit_no FROM part, c""")
def syllabus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.syllabus_chunks(_course(spark, sf_dir)).select("filename", "chunk_index", "section_type", "course_code", "module_no", "unit_no")


@query("""WITH u AS (SELECT p_partkey, unnest([{'m': 1, 't': 'Records', 'u': '1.1', 'x': 'Rows of ' || p_name || ' continued over lines 802.11 a foreign number'}, {'m': 1, 't': 'Records', 'u': '1.2', 'x': 'Keys'},
  {'m': 2, 't': 'Joins', 'u': '2.1', 'x': 'Hash joins'}, {'m': 2, 't': 'Joins', 'u': '2.2', 'x': 'Sort joins'}]) AS r FROM part)
SELECT p_partkey AS filename, r.m AS module, r.t AS title, r.u AS unit, r.x AS text FROM u""")
def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unit_rows(structure.page_lines(_course(spark, sf_dir)), "filename")


@query("""WITH u AS (SELECT p_partkey, unnest([{'u': '1.1', 'x': 'Rows of ' || p_name || ' continued over lines 802.11 a foreign number'}, {'u': '1.2', 'x': 'Keys'}, {'u': '2.1', 'x': 'Hash joins'}, {'u': '2.2', 'x': 'Sort joins'}]) AS r FROM part)
SELECT o_orderkey, r.u AS unit, r.x AS text FROM orders JOIN u ON p_partkey = o_custkey WHERE r.u = (o_orderkey % 2 + 1) || '.' || (o_orderkey % 3 + 1)""")
def unit_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that orders, read as queries, name of their customer's course; some name a unit that there is not."""
    asked = F.concat(F.lit("Explain unit "), F.col("o_orderkey") % 2 + 1, F.lit("."), F.col("o_orderkey") % 3 + 1, F.lit(" please"))
    queries = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("filename"), F.explode(structure.requested_units(asked)).alias("unit"))
    units = structure.unit_rows(structure.page_lines(_course(spark, sf_dir)), "filename")
    return queries.join(units, ["filename", "unit"]).select("o_orderkey", "unit", "text")


def _program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a programme for each part: three courses, of which one has its name on two lines; every other page states its total."""
    n = F.col("p_partkey") % 900 + 100
    lines = [
        F.lit("Semester III"), F.concat(F.lit("CSA"), n, F.lit(" "), F.initcap("p_name"), F.lit(" 3 2 1 3 1 1 5")), F.concat(F.lit("CSB"), n, F.lit(" Query Languages\nand "), F.initcap("p_type"), F.lit(" 3 1 - 4")),
        F.concat(F.lit("CSC"), n, F.lit(" Project "), F.col("p_size") % 4 + 1, F.lit(".5*")),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Total "), F.col("p_size"), F.lit(".5"))),
    ]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("filename"), F.lit(1).alias("page"), F.concat_ws("\n", *lines).alias("text"))


@query(f"""WITH p AS (SELECT *, p_partkey % 900 + 100 AS n FROM part)
SELECT p_partkey AS filename, 'CSA' || n AS code, {_TITLE_SQL % "p_name"} AS name, 'full' AS scheme, 5.0::DOUBLE AS credits FROM p
UNION ALL SELECT p_partkey, 'CSB' || n, 'Query Languages and ' || {_TITLE_SQL % "p_type"}, 'credit', 4.0 FROM p
UNION ALL SELECT p_partkey, 'CSC' || n, 'Project', 'credit', p_size % 4 + 1.5 FROM p""")
def program_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.program_rows(structure.page_lines(_program(spark, sf_dir)), "filename")
    return rows.select("filename", "code", "name", "scheme", "credits")


@query("SELECT p_partkey AS filename, 3 AS n_courses, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5 ELSE 10.5 + p_size % 4 END::DOUBLE AS credits FROM part")
def program_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.credit_totals(structure.program_rows(structure.page_lines(_program(spark, sf_dir)), "filename"), "filename")


@query("""WITH p AS (SELECT source, doc_id, text, 10 + doc_id % 3 AS n FROM documents), l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(*) AS n_lines, count(*) FILTER (length(line) > 100) AS n_long FROM l WHERE trim(line) <> '' GROUP BY source""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    lines = structure.page_lines(pages, "source")
    return lines.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(F.length("line") > 100).alias("n_long"))


@query("""SELECT doc_id, CASE WHEN trim(CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END) <> '' THEN 'text_extracted' WHEN doc_id % 2 = 0 THEN 'image_only_requires_ocr' ELSE 'no_text' END AS status FROM documents""")
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tables.extraction_status(page, F.col("doc_id") % 2 == 0).alias("status"))


# -- serving ------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id AS req_id, epoch(ts) AS s, event_type = 'click' AS token FROM events),
g AS (SELECT req_id, min(s) AS a, max(s) AS b, min(CASE WHEN token THEN s END) AS f, count(*) FILTER (token) AS tokens FROM e GROUP BY req_id)
SELECT req_id, round(b - a, 3) AS total_time, round(f - a, 3) AS ttft, tokens, round(CASE WHEN b > a THEN tokens / (b - a) ELSE 0 END, 6) AS tok_per_sec FROM g""")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("req_id"), "ts", F.when(F.col("event_type") == "click", "token").otherwise("other").alias("type"))
    found = serving.request_metrics(events)
    return found.select("req_id", F.round("total_time", 3).alias("total_time"), F.round("ttft", 3).alias("ttft"), "tokens", F.round("tok_per_sec", 6).alias("tok_per_sec"))


@query("""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows."""
    found = serving.windowed(table(spark, sf_dir, "events"), "ts", "1 day", None, None, "event_type")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: session windows."""
    found = serving.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", None, "user_id")
    return found.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(rf"""WITH a AS (SELECT 'v1|' || lower(trim(regexp_replace(text, '{text.SPACES}', ' ', 'g'))) AS cache_key, text AS answer, conv_id * 1000 + turn AS ts FROM conversations WHERE length(text) > 20)
SELECT cache_key, max(ts) AS ts FROM a GROUP BY cache_key""")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("text").alias("query"), F.col("text").alias("answer"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"))
    return serving.cacheable(rows, F.lit("v1")).select("cache_key", "ts")


@query("""WITH RECURSIVE asked AS (
  SELECT conv_id % 5 AS part, conv_id * 100 + turn AS request_id, conv_id * 60 + turn AS now, length(text) > 20 AS ok, lower(string_split(trim(text), ' ')[1]) AS k
  FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY now, request_id) AS i FROM asked),
walk AS (
  SELECT DISTINCT part, 0::BIGINT AS i, NULL::BIGINT AS request_id, '' AS k, false AS hit, []::STRUCT(k VARCHAR, saved BIGINT)[] AS held FROM asked
  UNION ALL
  SELECT part, i, request_id, k, hit, CASE WHEN hit THEN list_concat(list_filter(alive, lambda e: e.k <> k), list_filter(alive, lambda e: e.k = k))
    WHEN ok THEN list_concat(alive, [{'k': k, 'saved': now}])[-6:] ELSE alive END
  FROM (
    SELECT *, len(list_filter(alive, lambda e: e.k = k)) > 0 AS hit FROM (
      SELECT n.*, list_filter(w.held, lambda e: n.now - e.saved <= 900) AS alive FROM walk w JOIN numbered n ON n.part = w.part AND n.i = w.i + 1)))
SELECT part, request_id, k AS cache_key, hit FROM walk WHERE i > 0""")
def answer_cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by their first word, through one cache of six answers that live 15 minutes for each part."""
    ship(spark)
    rows = table(spark, sf_dir, "conversations")
    first = F.lower(F.get(F.split(F.trim("text"), " "), F.lit(0)))
    at = (F.col("conv_id") * 60 + F.col("turn")).cast("timestamp")
    asked = rows.select((F.col("conv_id") % 5).alias("part"), (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), first.alias("cache_key"), at.alias("ts"), (F.length("text") > 20).alias("cacheable"))
    return cache.answered(asked, 6, 900).select("part", "request_id", "cache_key", "hit")


@query(f"""SELECT req, total FROM (SELECT conv_id AS req, sum(len(regexp_extract_all(text, '\\S+|\\n|\\s+'))) AS total FROM conversations GROUP BY conv_id)""")
def answer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("req"), F.size(text.answer_tokens(F.col("text"))).alias("n"))
    return rows.groupBy("req").agg(F.sum("n").alias("total"))


# -- sections and links -------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
r AS (SELECT 1::BIGINT AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON url = src WHERE depth < 5)
SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def link_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachable pages and their least depth up to 5, over a link graph made of all order lines."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return sections.link_closure(edges, spark.range(1, 2).select(F.col("id").alias("url")), 5)


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of rules for each host, made of the paths of its pages."""
    at = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), robots.url_path(F.col("url")).alias("p"))
    ends = at.groupBy("host").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    part = lambda c, i: F.coalesce(F.get(F.split(c, "/"), F.lit(i)), F.lit(""))
    lines = F.concat_ws("\n", F.lit("# rules of"), F.lit("User-agent: other"), F.lit("Disallow: /"), F.lit(""), F.lit("User-Agent: *"), F.concat(F.lit("Disallow: /"), part("low", 1), F.lit("/")),
                        F.concat(F.lit("Allow: "), F.regexp_replace("low", "[?].*$", "")), F.lit("Disallow: /*?page="), F.lit("disallow: /*7$  # sevens"), F.concat(F.lit("Allow: /*"), F.left(part("high", 2), F.lit(2)), F.lit("*")),
                        F.lit("Crawl-delay: 2.5"))
    return ends.select("host", lines.alias("text"))


@query(r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
  CASE WHEN starts_with(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS path FROM pages),
h AS (SELECT host, min(path) AS low, max(path) AS high FROM p GROUP BY host),
r AS (
  SELECT host, false AS allow, '/' || split_part(low, '/', 2) || '/' AS rule, NULL AS pattern FROM h
  UNION ALL SELECT host, true, regexp_replace(low, '[?].*$', ''), NULL FROM h
  UNION ALL SELECT host, false, '/*?page=', '/%?page=%' FROM h
  UNION ALL SELECT host, false, '/*7$', '/%7' FROM h
  UNION ALL SELECT host, true, '/*' || left(split_part(high, '/', 3), 2) || '*', '/%' || left(split_part(high, '/', 3), 2) || '%' FROM h),
m AS (SELECT p.page_id, max({'n': length(rule), 'allow': allow}) AS best FROM p JOIN r ON r.host = p.host AND CASE WHEN pattern IS NULL THEN starts_with(path, rule) ELSE path LIKE pattern END GROUP BY p.page_id),
a AS (SELECT p.*, coalesce(best.allow, true) AS allowed FROM p LEFT JOIN m USING (page_id)),
o AS (SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY page_id, url) AS place FROM a WHERE allowed)
SELECT a.page_id, a.allowed, place, (place - 1) * 2.5::DOUBLE AS at FROM a LEFT JOIN o ON o.page_id = a.page_id AND place <= 3""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that their host's rules allow, and when the first three of each host are read."""
    held = robots.rules(_robots(spark, sf_dir), "papyra")
    judged = robots.allowed(table(spark, sf_dir, "pages").select("page_id", "url"), held)
    delays = held.groupBy("host").agg(F.max("delay").alias("delay"))
    asked = judged.where("allowed").withColumn("host", urls.host(F.col("url"))).join(delays, "host", "left")
    first = robots.crawl_order(asked, 3, F.col("delay"), order=("page_id",))
    return judged.select("page_id", "allowed").join(first.select("page_id", "place", "at"), "page_id", "left")


@query("""WITH l AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '/File.PDF?x=1' ELSE '' END AS link FROM pages)
SELECT DISTINCT link FROM l WHERE lower(regexp_replace(link, '[?#].*$', '')) LIKE '%.pdf'""")
def pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/File.PDF?x=1").otherwise(""))
    return sections.pdf_links(table(spark, sf_dir, "pages").select(link.alias("link")))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN replace(replace(text, 'the', 'THE'), 'THE a', 'A') ELSE text END AS text FROM documents""")
def patched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).cast("int").alias("page"), "text")
    fixes = spark.createDataFrame([(3, 1, "the", "THE"), (3, 2, "THE a", "A")], "page int, ord int, old string, new string")
    return sections.patched(pages, fixes).select("doc_id", "text")


@query(f"""WITH b AS (SELECT item_id, list_distinct(list_concat({plural_sql("text")}, CASE WHEN item_id % 3 = 0 THEN ['src' || (item_id % 20)] ELSE [] END)) AS q FROM benchmark),
d AS (SELECT doc_id, source, list_distinct({plural_sql("split_part(text, chr(10), 1)")}) AS t, list_distinct({plural_sql("text")}) AS c, list_distinct({plural_sql("split_part(text, chr(10), -1)")}) AS m FROM documents),
s AS (SELECT item_id, doc_id, len(list_intersect(q, t)) > 0 OR len(list_intersect(q, m)) > 0 OR list_contains(q, source) AS gate,
  CASE WHEN len(t) > 0 AND len(list_filter(t, lambda x: NOT list_contains(q, x))) = 0 THEN 60.0
    WHEN len(list_intersect(q, t)) >= 2 AND len(list_intersect(q, t)) / greatest(len(t), 1) >= 0.66 THEN 40.0 ELSE 0.0 END AS n,
  2.0 * len(list_intersect(q, c)) + 1.5 * len(list_intersect(q, m)) + CASE WHEN list_contains(q, source) THEN 100.0 ELSE 0.0 END AS r
  FROM b, d),
o AS (SELECT item_id, doc_id, n + r AS section_score, n, row_number() OVER (PARTITION BY item_id ORDER BY n + r DESC, doc_id) AS k FROM s WHERE gate)
SELECT item_id, doc_id, round(section_score, 4) AS section_score FROM o WHERE k = 1 AND section_score > 0 AND (n > 0 OR section_score >= 1.5)""")
def section_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best section of all for each item: first lines are titles, last lines modules, sources codes, which every third item names."""
    words = lambda c: F.array_distinct(text.tokens_plural(c))
    code = F.when(F.col("item_id") % 3 == 0, F.array(F.concat(F.lit("src"), F.col("item_id") % 20))).otherwise(F.array().cast("array<string>"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_union(words(F.col("text")), code).alias("words"))
    first, last = F.split_part("text", F.lit("\n"), F.lit(1)), F.split_part("text", F.lit("\n"), F.lit(-1))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    docs = docs.select("doc_id", F.col("source").alias("code"), words(first).alias("title"), words(F.col("text")).alias("content"), words(last).alias("modules"))
    scored = sections.matched_sections(items, staged(docs, "sections"), "item_id", "doc_id")
    return sections.best_section(scored, "item_id", "doc_id").select("item_id", "doc_id", F.round("section_score", 4).alias("section_score"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 6")
def at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with six documents of a language or more."""
    return relational.at_least(table(spark, sf_dir, "documents"), ["source", "lang"], 6)


@query(f"""WITH {_DENSE_SQL}
SELECT ql AS label, count(*) FILTER (ql = dl) AS passed, count(*) FILTER (ql <> dl) AS failed, count(*) AS n, round(count(*) FILTER (ql = dl) / count(*), 6) AS share FROM dr WHERE rank <= 5 GROUP BY ql""")
def pass_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the five nearest vectors of each query, how many have its label, by label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _dense(spark, sf_dir, 5).join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    found = found.join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("dl")), "id")
    return relational.tally(found, F.col("label") == F.col("dl"), "label").withColumn("share", F.round("share", 6))


@query("""WITH m AS (SELECT source AS filename, doc_id % 100 AS page, CASE WHEN doc_id % 100 = 10 THEN [4] WHEN doc_id % 10 < 8 THEN list_distinct([doc_id % 10 + 1, (doc_id // 10) % 8 + 1]) ELSE [] END AS own FROM documents),
e AS (SELECT filename, page, unnest(own) AS semester FROM m), q AS (SELECT item_id, unnest([item_id % 8 + 1]) AS semester FROM benchmark)
SELECT DISTINCT item_id AS query_id, filename, page::INT AS page FROM q JOIN e USING (semester)""")
def semester_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name the semester an item asks for; one page has an override."""
    roman = lambda n: F.upper(F.element_at(F.array(*[F.lit(r) for r in numbers.ROMANS]), n.cast("int")))
    heading = F.concat(F.lit("Semester "), roman(F.col("doc_id") % 10 + 1), F.lit(" and Sem "), roman(F.expr("doc_id div 10 % 8 + 1")))
    text_ = F.when(F.col("doc_id") % 10 < 8, F.concat(heading, F.lit("\n"), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("filename"), (F.col("doc_id") % 100).cast("int").alias("page"), text_.alias("text"))
    overrides = spark.createDataFrame([(10, 4)], "page int, semester int")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("subjects of semester "), F.col("item_id") % 8 + 1).alias("q"))
    asked = asked.select("query_id", understanding.requested_semesters(F.col("q")).alias("semesters"))
    return sections.semester_pages(sections.semester_markers(rows, overrides), asked, "query_id")


@query(f"""WITH {_bm25_sql(stemmed_sql, 'plus_one', False)},
u AS (SELECT item_id // 2 AS question, item_id % 2 AS part, doc_id, rank FROM r WHERE rank <= 5),
once AS (SELECT *, row_number() OVER (PARTITION BY question, doc_id ORDER BY part, rank) AS n FROM u)
SELECT question, doc_id, part, rank, row_number() OVER (PARTITION BY question ORDER BY part, rank, doc_id) AS place FROM once WHERE n = 1 QUALIFY place <= 8""")
def clause_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items as a question and its clause."""
    ranked = _bm25(spark, sf_dir).withColumn("question", F.expr("item_id div 2"))
    found = sections.clause_union(ranked.where("item_id % 2 = 0"), ranked.where("item_id % 2 = 1"), "doc_id", qkey="question")
    return found.select("question", "doc_id", "part", "rank", "place")


@query(f"""WITH {_bm25_sql(stemmed_sql, 'plus_one', False)},
h AS (SELECT r.item_id, d.source, rank, text, row_number() OVER (PARTITION BY r.item_id, d.source ORDER BY rank) AS n FROM r JOIN documents d USING (doc_id) WHERE rank <= 8),
placed AS (SELECT item_id, source, text, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM h WHERE n = 1)
SELECT item_id, source, place, sha256(left(text, CASE place WHEN 1 THEN 5000 WHEN 2 THEN 1200 ELSE 800 END)) AS piece FROM placed WHERE place <= 3""")
def budgeted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir, k=8).join(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return sections.budgeted_pages(hits, "item_id", "source", [5000, 1200, 800]).select("item_id", "source", "place", F.sha2("text", 256).alias("piece"))


@query("""WITH w AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3) AS t, lower(text) AS x FROM conversations),
l AS (SELECT *, last_value(x) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM w),
r AS (SELECT conv_id, turn, len(list_filter(t, lambda y: contains(a || ' ' || a, y))) > 0 AS k FROM l),
g AS (SELECT *, bool_or(k) OVER (PARTITION BY conv_id) AS any_k FROM r)
SELECT conv_id, turn FROM g WHERE k OR NOT any_k""")
def relevant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    whole = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("conv_id", "turn", F.col("text").alias("title"), F.last("text").over(whole).alias("a"))
    return sections.relevant_sources(rows, "conv_id", "title", F.col("a"), F.col("a")).select("conv_id", "turn")


@query(f"""WITH w AS (SELECT [{listed(MORE_WANTS)}] AS a),
q AS (SELECT conv_id, turn, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '') || ' / ' || a[(conv_id * 7 + turn) % {len(MORE_WANTS)} + 1]), '[a-z0-9]+'), ' ') || ' ' AS n FROM conversations, w)
SELECT conv_id, turn, CASE
  WHEN len(list_filter([' textbook ', ' textbooks ', ' text book ', ' text books ', ' reference ', ' references ', ' assessment ', ' evaluation ', ' exam '], lambda p: contains(n, p))) > 0 THEN 'all_pages'
  WHEN len(list_filter([' experiment ', ' experiments ', ' practical ', ' practicals ', ' lab '], lambda p: contains(n, p))) > 0 THEN 'lab_pages'
  WHEN regexp_matches(n, ' modules? ([0-9][a-z0-9]*|one|two|three|four|five|six) ') THEN 'outlines'
  WHEN len(list_filter([' module ', ' modules ', ' unit ', ' units ', ' topic ', ' topics '], lambda p: contains(n, p))) > 0 THEN 'module_pages' ELSE 'pages' END AS pages FROM q""")
def section_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages of a section answer each message and the request at its end."""
    wants = F.element_at(F.array(*[F.lit(w) for w in MORE_WANTS]), ((F.col("conv_id") * 7 + F.col("turn")) % len(MORE_WANTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" / ", F.coalesce("text", F.lit("")), wants).alias("question"))
    return rows.select("conv_id", "turn", sections.routed(F.col("question")).alias("pages"))


@query("""SELECT left(sha256('https://h/' || (doc_id % 50) || '/a-b.pdf'), 16) AS hash_id, 'a b' AS title, min(doc_id) AS source_page FROM documents GROUP BY doc_id % 50""")
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://h/"), F.col("doc_id") % 50, F.lit("/a-b.pdf"))
    links = table(spark, sf_dir, "documents").select(url.alias("url"), F.lit("").alias("link_text"), F.lit(0).alias("depth"), F.col("doc_id").alias("source_page"))
    return sections.file_records(links).select("hash_id", "title", "source_page")


@query("""WITH p AS (SELECT source, doc_id, text, doc_id % 7 = 3 AS ends FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, coalesce(max(ends::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM p)
SELECT source, doc_id, sha256(CASE WHEN ends THEN 'Lab page' ELSE text END) AS text FROM o WHERE ended = 0""")
def lab_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's pages up to the first that has an assessment, which is cut there."""
    ends = F.col("doc_id") % 7 == 3
    rows = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.when(ends, F.concat(F.lit("Lab page\nAssessment: "), "text")).otherwise(F.col("text")).alias("text"))
    found = sections.lab_text(rows, "source", "doc_id")
    return found.select("source", "doc_id", F.sha2(F.when(ends, F.regexp_replace("text", r"\s+$", "")).otherwise(F.col("text")), 256).alias("text"))


# -- pages, links and cards ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_partkey % 5 <> 0 AND p_size % 3 = 0 AS opens, p_size % 2 = 0 AS modules FROM part")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages open a section and which hold modules."""
    lines = F.concat(F.lit("1.0 A "), "p_size", F.when(F.col("p_size") % 2 == 0, F.lit("\nSelf learning: ")).otherwise(F.lit("\n")), "p_name", F.when(F.col("p_size") % 3 == 0, "\nLab objectives").otherwise(""))
    code = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", sections.opens_section(lines, code).alias("opens"), sections.is_module_page(lines).alias("modules"))


@query("SELECT p_partkey AS filename, 'The ' || p_name || ' second line|Other book' AS textbooks, 'A paper 2.2 Sort joins' AS refs, '' AS online FROM part")
def course_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered items under headings of books; a line that is neither goes on with the item before."""
    found = extract.books(_course(spark, sf_dir), "filename")
    return found.select("filename", F.array_join("textbooks", "|").alias("textbooks"), F.array_join("references", "|").alias("refs"), F.array_join("online", "|").alias("online"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Units' || chr(10) || '**Self-learning** ' || p_name ELSE 'Units' || chr(10) || chr(10) || '**Self-learning**' || chr(10) || p_name END AS text FROM part""")
def self_learning_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_size") % 4 == 0, F.lit("Units\n**Self-learning** ")).otherwise(F.lit("Units\nSelf-learning topics: "))
    return table(spark, sf_dir, "part").select("p_partkey", extract.with_self_learning(F.concat(given, "p_name")).alias("text"))


@query(r"SELECT source, left(regexp_replace(arg_min(text, doc_id), '[ \t\n\r\f\v]+', ' ', 'g'), 140) AS snippet FROM documents GROUP BY source")
def source_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.snippets(table(spark, sf_dir, "documents"), "source", "text", "doc_id").select("source", "snippet")


@query("SELECT doc_id, sha256('Course: ' || source || ' ' || lang || chr(10) || chr(10) || text) AS text FROM documents")
def chunk_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(chunking.context_text(F.col("source"), F.col("lang"), F.col("text")), 256).alias("text"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract(html, '<p>([^<]*)', 1) AS t, list_filter(regexp_extract_all(html, '<h[1-6]>([^<]*)<', 1), lambda x: length(x) < 50) AS hs, regexp_extract(html, '<title>([^<]*)', 1) AS d FROM pages)
SELECT page_id, left(concat_ws(' | ', t, nullif(array_to_string(hs, ' | '), ''), d), 300) AS context FROM h""")
def link_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds a link: its block, short headings, the page's title."""
    headings = F.filter(F.regexp_extract_all("html", F.lit("<h[1-6]>([^<]*)<"), F.lit(1)), lambda x: F.length(x) < 50)
    context = sections.link_context(F.regexp_extract("html", "<p>([^<]*)", 1), headings, F.regexp_extract("html", "<title>([^<]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", context.alias("context"))


@query("""WITH c AS (SELECT 'CSL' || p_partkey AS code, p_name AS name FROM part WHERE p_size % 2 = 0),
k AS (SELECT p_name || ' lab' AS alias, 'OLD' || p_partkey AS code FROM part WHERE p_partkey % 97 = 0)
SELECT alias, code FROM k UNION ALL SELECT alias, code FROM (SELECT name || ' ' || w AS alias, min(code) AS code FROM c, unnest(['lab', 'laboratory', 'practical']) AS t(w) GROUP BY name, w) WHERE alias NOT IN (SELECT alias FROM k)""")
def lab_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of every laboratory's name, of equal ones the first code's, beside those known."""
    rows = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " Laboratory").otherwise(""))
    courses = rows.select(F.concat(F.lit("CSL"), "p_partkey").alias("code"), name.alias("name"), (F.col("p_size") % 2 == 0).alias("is_lab"))
    known = rows.where("p_partkey % 97 = 0").select(F.concat("p_name", F.lit(" lab")).alias("alias"), F.concat(F.lit("OLD"), "p_partkey").alias("code"))
    return understanding.lab_aliases(courses, known)


@query("""WITH g AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_totalprice > 20000))
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_custkey IN (SELECT o_custkey FROM g)""")
def all_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers all of whose orders are above a price."""
    orders = table(spark, sf_dir, "orders")
    found = relational.all_found(orders.select("o_custkey", "o_orderkey"), orders.where("o_totalprice > 20000").select("o_orderkey"), "o_custkey", "o_orderkey", "o_orderkey")
    return found.select("o_custkey", "o_orderkey", "place")


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations WHERE text IS NOT NULL)
SELECT conv_id * 100 + turn AS id, len(a) + (conv_id % 2 = 0)::INT AS n, sha256(array_to_string(CASE WHEN conv_id % 2 = 0 THEN list_concat(a[1:2], ['<tool_'], a[3:]) ELSE a END, '|')) AS tokens FROM t""")
def visible_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as streams of tokens, every other with a call after its second token."""
    a = F.split("text", " ", -1)
    call = F.array(*[F.lit(x) for x in ("<tool_", "call>", "name", "</tool", "_call>")])
    with_call = F.when(F.col("conv_id") % 2 == 0, F.concat(F.slice(a, 1, 2), call, F.slice(a, 3, 1_000_000))).otherwise(a)
    rows = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.posexplode(with_call).alias("seq", "delta"))
    shown = serving.visible_tokens(rows, "id", "seq", "delta").groupBy("id")
    shown = shown.agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("place", "token"))).alias("ts"))
    return shown.select("id", "n", F.sha2(F.array_join(F.transform("ts", lambda x: x["token"]), "|"), 256).alias("tokens"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', ''), '/+$', '') || regexp_extract(regexp_replace(url, '#.*$', ''), '(\?.*)$', 1) AS u,
  regexp_extract_all(html, '<p>([^<]*)', 1) AS ls FROM pages),
t AS (SELECT u, min_by(x, page_id) AS x FROM (SELECT page_id, u, array_to_string(list_transform(ls, lambda l, i: CASE WHEN i % 3 = 1 THEN upper(replace(l, 'ß', 'SS')) ELSE l END), chr(10)) AS x FROM p) GROUP BY u),
q AS (SELECT page_id, u, page_id % 4 * 300 AS o FROM p WHERE page_id % 5 <> 0)
SELECT page_id, sha256(CASE WHEN o + 400 < length(x) THEN substr(x, o + 1, 400) || chr(10) || chr(10) || '[Continues at offset ' || (o + 400) || '.]' WHEN substr(x, o + 1, 400) = '' THEN 'No more content.' ELSE substr(x, o + 1, 400) END) AS piece
FROM q JOIN t USING (u) UNION ALL SELECT page_id, sha256('No page has this address.') FROM pages WHERE page_id % 5 = 0""")
def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of pages by address and offset; every fifth address is none of the index."""
    rows = table(spark, sf_dir, "pages")
    lines = F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    held = rows.select("page_id", F.col("url").alias("url"), lines.alias("lines"))
    held = relational.first_of(held.withColumn("u", urls.normalize_url(F.col("url"))), ["u"], ["page_id"])
    asked = rows.select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://none.example/"), "page_id")).otherwise(F.concat("url", F.lit("#top"))).alias("url"), (F.col("page_id") % 4 * 300).cast("int").alias("offset"))
    return extract.read_pages(asked, held, 400).select("page_id", F.sha2("piece", 256).alias("piece"))


# -- queries that several tables answer ---------------------------------------------------------------------------

_CODE_SQL = "'CSA' || (10000000 * (1 + (%s) %% 2) + (%s))::BIGINT"
_COURSES_SQL = """courses AS (SELECT 'CSA' || (10000000 * (1 + p_partkey % 2) + p_partkey) AS code, 'Topic-' || (p_partkey // 2) || ' II (core)' AS name,
  (p_partkey // 2) % 3 = 0 AS is_lab, CASE WHEN (p_partkey // 2) % 3 = 2 THEN 'CSA' || (10000000 * (1 + p_partkey % 2) + p_partkey + 2) END AS partner FROM part)"""


def _code(key: str) -> Column:
    return F.concat(F.lit("CSA"), (10_000_000 * (1 + F.expr(f"({key}) % 2")) + F.expr(key)).cast("long").cast("string"))


def _courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as courses: two have one name; of three pairs one has labs, which the pair before shares."""
    third = F.expr("p_partkey div 2 % 3")
    name = F.concat(F.lit("Topic-"), F.expr("p_partkey div 2"), F.lit(" II (core)"))
    return table(spark, sf_dir, "part").select(_code("p_partkey").alias("code"), name.alias("name"), (third == 0).alias("is_lab"), F.when(third == 2, _code("p_partkey + 2")).alias("partner"), "p_partkey")


_MENTION_SQL = f"""q AS (SELECT o_orderkey, CASE o_orderkey % 3
    WHEN 0 THEN 'Compare ' || {_CODE_SQL % (("o_custkey",) * 2)} || ' with topic ' || (o_orderkey % 5000 // 2) || ' ii'
    WHEN 1 THEN 'show fast-track ' || (o_custkey * 5) || ' and Topic ' || (o_orderkey % 5000 // 2) || ' 2 in semester 2'
    ELSE 'topic ' || (o_custkey // 2) || ' II, ' || {_CODE_SQL % (("o_custkey",) * 2)} || ' or track ' || (o_custkey * 10) END AS text FROM orders)"""


def _mention_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = _code("o_custkey"), F.expr("o_orderkey % 5000 div 2")
    first = F.concat(F.lit("Compare "), own, F.lit(" with topic "), other, F.lit(" ii"))
    second = F.concat(F.lit("show fast-track "), F.expr("o_custkey * 5"), F.lit(" and Topic "), other, F.lit(" 2 in semester 2"))
    third = F.concat(F.lit("topic "), F.expr("o_custkey div 2"), F.lit(" II, "), own, F.lit(" or track "), F.expr("o_custkey * 10"))
    turn = F.col("o_orderkey") % 3
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", F.when(turn == 0, first).when(turn == 1, second).otherwise(third).alias("text"))


@query(f"""WITH {_COURSES_SQL}, {_MENTION_SQL},
titled AS (SELECT code, 'TOPIC ' || regexp_extract(name, '\\d+') || ' 2' AS title FROM courses),
grouped AS (SELECT title, list_sort(list(code)) AS codes FROM titled GROUP BY title),
aliases AS (SELECT 'FAST TRACK ' || p_partkey AS phrase, {_CODE_SQL % (("p_partkey",) * 2)} AS code FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT 'TRACK ' || p_partkey, {_CODE_SQL % (("p_partkey + 1",) * 2)} FROM part WHERE p_partkey % 10 = 0),
w AS (SELECT o_orderkey, regexp_matches(lower(text), 'semester 2|second semester') AS second, regexp_extract_all(upper(text), '[A-Z0-9]+') AS a FROM q),
t AS (SELECT o_orderkey, second, a, list_transform(a, lambda x: CASE x WHEN 'I' THEN '1' WHEN 'II' THEN '2' WHEN 'III' THEN '3' ELSE x END) AS b, unnest(range(1, len(a) + 1)) AS i FROM w),
p AS (SELECT o_orderkey, second, i, n, array_to_string(a[i:i + n - 1], ' ') AS x, array_to_string(b[i:i + n - 1], ' ') AS y FROM t, unnest([1, 2, 3]) AS s(n) WHERE i + n - 1 <= len(a)),
h AS (SELECT o_orderkey, 0 AS kind, i, n, code FROM p JOIN courses c ON n = 1 AND c.code = x
  UNION ALL SELECT o_orderkey, 1, i, n, s.code FROM p JOIN aliases s ON s.phrase = x JOIN courses USING (code)
  UNION ALL SELECT o_orderkey, 2, i, n, coalesce(CASE WHEN len(codes) = 1 THEN codes[1] END, list_filter(codes, lambda c: c[4] = CASE WHEN second THEN '2' ELSE '1' END)[1], codes[1]) FROM p JOIN grouped g ON g.title = y),
k AS (SELECT * FROM h WHERE kind <> 1 OR NOT EXISTS (SELECT 1 FROM h o WHERE o.o_orderkey = h.o_orderkey AND o.kind < 2 AND (o.kind = 0 OR o.n > h.n) AND o.i < h.i + h.n AND h.i < o.i + o.n)),
once AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, code ORDER BY kind, i) AS r FROM k JOIN titled USING (code)),
kept AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, title ORDER BY i, kind) AS f FROM once WHERE r = 1)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY i, kind, code) AS place, code FROM kept WHERE f = 1 OR kind = 0""")
def course_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses that a query names by code, alias or name."""
    parts = table(spark, sf_dir, "part")
    fast = parts.where("p_partkey % 5 = 0").select(F.concat(F.lit("Fast Track "), "p_partkey").alias("alias"), _code("p_partkey").alias("code"))
    track = parts.where("p_partkey % 10 = 0").select(F.concat(F.lit("track "), "p_partkey").alias("alias"), _code("p_partkey + 1").alias("code"))
    found = dispatch.mentions(_mention_texts(spark, sf_dir), ["o_orderkey"], "text", _courses(spark, sf_dir), fast.unionByName(track))
    return found.select("o_orderkey", "place", "code")


@query(f"""WITH {_COURSES_SQL} SELECT 'TOPIC ' || regexp_extract(name, '\\d+') || ' 2' AS title, string_agg(code, ',' ORDER BY code) AS codes FROM courses GROUP BY 1""")
def codes_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.codes_by_name(_courses(spark, sf_dir)).select("title", F.array_join("codes", ",").alias("codes"))


_CLAUSE_TEXT_SQL = f"""CASE o_orderkey % 5
    WHEN 0 THEN 'Explain ' || a || ' module 3 and ' || b || ' experiments 2 to 4'
    WHEN 1 THEN 'first two experiments of ' || a || ', as well as last 2 modules of ' || b
    WHEN 2 THEN a || ' modules 1 ' || b || ' module 5'
    WHEN 3 THEN 'total credits of ' || a || ' module 2'
    ELSE 'experiments of ' || a END"""


@query(f"""WITH {_COURSES_SQL},
k AS (SELECT o_orderkey, {_CODE_SQL % (("o_custkey",) * 2)} AS a, {_CODE_SQL % (("o_orderkey % 3000",) * 2)} AS b FROM orders),
q AS (SELECT o_orderkey, {_CLAUSE_TEXT_SQL} AS text FROM k),
g AS (SELECT * FROM q WHERE regexp_matches(text, '\\b(experiments?|modules?)\\b') AND NOT regexp_matches(text, 'total credits') AND (regexp_matches(text, 'experiments?') OR regexp_matches(text, '\\d'))),
m AS (SELECT o_orderkey, text, unnest(l) AS code, generate_subscripts(l, 1) AS ord FROM (SELECT *, regexp_extract_all(text, 'CSA\\d+') AS l FROM g)),
known AS (SELECT o_orderkey, text, m.code, min(ord) AS ord FROM m JOIN courses USING (code) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) AS place, count(*) OVER (PARTITION BY o_orderkey) AS n, strpos(text, code) AS p FROM known),
parts AS (SELECT o_orderkey, list_filter(regexp_split_to_array(text, '\\s*(?:\\bas\\s+well\\s+as\\b|\\band\\b|[,;&])\\s*'), lambda c: c <> '') AS parts FROM g),
cl AS (SELECT o_orderkey, place, code, lower(coalesce(CASE WHEN n > 1 AND len(parts) < n
      THEN trim(substr(text, p, coalesce(lead(p) OVER (PARTITION BY o_orderkey ORDER BY p), length(text) + 1) - p))
      ELSE list_filter(parts, lambda c: contains(c, code))[1] END, text)) AS clause, contains(text, 'experiment') AS whole
  FROM placed JOIN parts USING (o_orderkey)),
s AS (SELECT cl.*, c.is_lab OR (whole AND NOT contains(clause, 'module') AND l.code IS NOT NULL) AS lab,
    CASE WHEN NOT c.is_lab AND whole AND NOT contains(clause, 'module') AND l.code IS NOT NULL THEN l.code ELSE cl.code END AS target
  FROM cl JOIN courses c ON c.code = cl.code LEFT JOIN courses l ON l.code = c.partner AND l.is_lab),
one AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, target ORDER BY place) AS r FROM s),
num AS (SELECT * EXCLUDE (clause), clause || CASE WHEN lab AND NOT contains(clause, 'experiment') THEN ' experiments' WHEN NOT lab AND NOT contains(clause, 'module') THEN ' modules' ELSE '' END AS clause,
  CASE WHEN lab THEN 'experiments?' ELSE 'modules?' END AS noun FROM one WHERE r = 1),
ask AS (SELECT *, CASE
    WHEN regexp_matches(clause, 'last 2 ' || noun) THEN [5, 6]
    WHEN regexp_matches(clause, 'first two ' || noun) THEN [1, 2]
    WHEN regexp_matches(clause, noun || ' \\d+ to \\d+') THEN range(regexp_extract(clause, noun || ' (\\d+) to (\\d+)', 1)::INT, regexp_extract(clause, noun || ' (\\d+) to (\\d+)', 2)::INT + 1)
    WHEN regexp_matches(clause, '\\b\\d+ ' || noun) THEN [regexp_extract(clause, '\\b(\\d+) ' || noun, 1)::INT]
    WHEN regexp_matches(clause, noun || ' \\d+') THEN [regexp_extract(clause, noun || ' (\\d+)', 1)::INT]
    ELSE range(1, 7) END AS numbers FROM num),
x AS (SELECT o_orderkey, place, target AS code, unnest(numbers) AS number FROM ask)
SELECT o_orderkey, place, code, number::INT AS number, code || ' part ' || number AS title FROM x WHERE number BETWEEN 1 AND 6""")
def course_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules or experiments of each course that a query names, by the clause that names it."""
    courses = _courses(spark, sf_dir)
    items = courses.select("code", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("number")).withColumn("title", F.concat("code", F.lit(" part "), "number"))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", _code("o_custkey").alias("a"), _code("o_orderkey % 3000").alias("b"))
    texts = [
        F.concat(F.lit("Explain "), "a", F.lit(" module 3 and "), "b", F.lit(" experiments 2 to 4")),
        F.concat(F.lit("first two experiments of "), "a", F.lit(", as well as last 2 modules of "), "b"),
        F.concat("a", F.lit(" modules 1 "), "b", F.lit(" module 5")),
        F.concat(F.lit("total credits of "), "a", F.lit(" module 2")),
        F.concat(F.lit("experiments of "), "a"),
    ]
    queries = rows.select("o_orderkey", F.element_at(F.array(*texts), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("text"))
    return dispatch.course_answers(queries, "o_orderkey", "text", courses, items)


#: Topics as SQL sees them: whole phrases between spaces, and beginnings of words.
_TOPIC_SQL = {
    "activity": ["activity", "activities"],
    "aim": ["aim", "aims", "objective", "objectives"],
    "all": ["all"],
    "asking": ["is", "are", "do", "does", "can", "which", "why", "when", "who", "how", "whether", "what is", "tell me about"],
    "assessment": ["scheme", "mark", "marks", "grade", "grades", "graded", "grading", "weightage", "ciap", "ese", "esep", "ise", "mse", "term work", "criteria", "assess*", "evaluat*", "exam*"],
    "assignment": ["assignment", "assignments"],
    "available": ["course offered", "courses offered", "course available", "courses available", "course in", "courses in", "course at", "courses at",
                  "program offered", "programs offered", "program available", "programs available", "program in", "programs in", "program at", "programs at"],
    "book": ["book", "books", "textbook", "textbooks", "reference", "references", "reading", "bibliography"],
    "both": ["both"],
    "content": ["syllabus", "curriculum", "course content", "course outline"],
    "count": ["how many", "how much", "count", "total number", "number of"],
    "course": ["course", "courses", "subject", "subjects"],
    "credit": ["credit", "credits"],
    "credit share": ["total credit", "total credits", "degree credit", "degree credits", "credit distribution", "credits distribution"]
    + [f"credit{s} for {w}" for s in ("", "s") for w in ("degree", "engineering", "program", "the degree", "the program")],
    "degree": ["b tech", "btech", "degree", "engineering", "program"],
    "department": ["computer", "it", "information", "extc", "electronics", "ecs", "mech", "mechanical", "aids", "aiml", "ai"],
    "deployment": ["cloud", "hosting", "prototype", "deploy*"],
    "detail": ["describe", "detail", "details"],
    "each": ["each subject", "every subject", "all subject", "all subjects", "all course", "all courses", "detailed syllabus", "detailed module", "module wise", "modulewise", "syllabus for each"],
    "elective": ["elective", "electives", "minor", "minors", "mdm", "mdms", "multidisciplinary"],
    "exam scheme": ["ise", "mse", "ese", "exam scheme", "examination scheme", "evaluation scheme", "assessment scheme", "marks distribution"],
    "experiment": ["experiment", "experiments", "practical", "practicals", "task", "tasks", "exp", "exps", "prac", "pracs"],
    "first part": [f"{w} {p}" for p in ("1", "i") for w in ("math", "mathematics", "applied", "project", "physics", "chemistry", "mechanics", "bee", "graphics", "part", "sem", "semester")],
    "full": ["full", "complete", "overall"],
    "guide": ["guideline", "guidelines", "rule", "rules", "instruction", "instructions", "step", "steps", "process", "procedure", "selection", "topic", "topics"],
    "hours": ["teaching scheme", "contact hour", "contact hours", "lecture hour", "lecture hours", "hours per week"],
    "info": ["information", "info", "details", "overview", "summary", "about", "explain", "give", "what is"],
    "lab": ["lab", "labs", "laboratory"],
    "listing": ["list", "give me", "show me", "what are the"],
    "module": ["module", "modules", "unit", "units"],
    "mixed": ["lab and subject", "subject and lab", "theory and lab", "lab and theory"],
    "online": ["online"],
    "only lab": ["only lab", "only labs", "lab subject", "lab subjects", "lab course", "lab courses", "practical subject", "practical subjects", "practical", "practicals"],
    "only theory": ["only theory", "theory subject", "theory subjects", "theory course", "theory courses"],
    "oral": ["oral", "viva", "presentation", "rubric", "rubrics"],
    "outcome": ["outcome", "outcomes", "co", "cos"],
    "people": ["faculty", "staff", "teacher", "professor", "hod", "head"],
    "reading": ["reading"],
    "refer": ["refer"],
    "reference": ["reference", "references"],
    "scheme": ["program structure", "curriculum structure", "teaching scheme", "all subject", "all subjects", "all course", "all courses", "credit distribution", "total credit", "total credits"],
    "semester": [f"{t} {p}" for t in ("sem", "semester", "term") for p in ("1", "2", "3", "4", "5", "6", "7", "8", "1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii")]
    + [f"{p} {t}" for t in ("sem", "semester", "term") for p in ("1", "2", "3", "4", "5", "6", "7", "8", "1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii")],
    "semesters": [f"{t} {a} to {b}" for t in ("sem", "semester", "term", "sems", "semesters") for own in ("1 2 3 4 5 6 7 8".split(), "i ii iii iv v vi vii viii".split()) for i, a in enumerate(own) for b in own[i + 1 :]],
    "structure": ["structure", "teaching scheme"],
    "studies": ["branches", "degrees", "intake", "undergraduate", "postgraduate", "ug and pg"],
    "study": ["study", "learn", "video", "videos", "nptel", "coursera", "material", "materials", "resource", "resources", "link", "links", "where"],
    "teaching term": ["topic", "topics", "chapter", "chapters", "section", "sections", "goal", "goals", "prerequisite", "prerequisites", "purpose", "self learning"],
    "team": ["team", "teams", "group", "groups", "how many students", "number of students"],
    "text": ["textbook", "textbooks", "text book", "text books"],
    "theory": ["theory"],
    "tool": ["tool", "tools", "useful link", "useful links", "web resource", "web resources", "online resource", "online resources"],
    "whole": ["overall", "total", "altogether", "entire", "complete", "whole", "in total", "four years"],
    "whole structure": ["program structure", "curriculum structure", "course structure", "teaching scheme", "all subject", "all subjects", "all course", "all courses"],
}


def _topic_sql(topic: str) -> str:
    """Whether the words ``n``, with spaces around, have a phrase of the topic."""
    if topic == "code":
        return "regexp_matches(n, ' [a-z]{2,6}[0-9]{3,} ')"
    own = _TOPIC_SQL[topic]
    whole = ", ".join(quoted(f" {p} ") for p in own if not p.endswith("*"))
    begun = "".join(f" OR contains(n, ' {p[:-1]}')" for p in own if p.endswith("*"))
    return f"(len(list_filter([{whole}], lambda p: contains(n, p))) > 0{begun})"


def _any_sql(*topics: str) -> str:
    return "(" + " OR ".join(_topic_sql(t) for t in topics) + ")"


def _only_sql(every: list[str], none: list[str]) -> str:
    return " AND ".join([_topic_sql(t) for t in every] + [f"NOT {_topic_sql(t)}" for t in none])


_INTENT_SQL = {
    "asks_attribute": _any_sql("asking"), "asks_for_list": _any_sql("listing", "all", "detail"), "asks_info": _any_sql("info"), "asks_programmes": _any_sql("studies", "available"),
    "asks_staff": _only_sql(["people", "department"], []), "counts": _any_sql("count"), "counts_experiments": _only_sql(["count", "experiment"], []),
    "counts_modules": _only_sql(["count", "module"], []), "is_assessment_query": _any_sql("assessment"), "is_credit_query": _any_sql("credit share"),
    "is_degree_credits": f"{_any_sql('whole', 'degree')} AND {_only_sql(['credit'], ['code'])}", "is_lab_query": _any_sql("lab", "experiment"),
    "is_outline_query": _any_sql("content", "module", "teaching term", "lab", "experiment", "assignment", "outcome", "aim", "book"),
    "is_semester_catalogue": _only_sql(["semester"], ["code", "module", "lab", "experiment"]), "is_semester_range": _only_sql(["semesters"], ["code", "module", "lab", "experiment"]),
    "is_strict_module_query": _any_sql("content", "module", "teaching term"), "names_books": _any_sql("book", "text"), "names_code": _topic_sql("code"), "names_first_part": _any_sql("first part"),
    "names_labs": _any_sql("lab"), "names_semester": _any_sql("semester"), "names_theory": _any_sql("theory"), "only_labs": _any_sql("only lab"),
    "only_online": _only_sql(["online"], ["text", "book", "both"]), "only_references": _only_sql(["reference"], ["text", "all", "both", "online", "refer"]),
    "only_textbooks": _only_sql(["text"], ["reference", "online", "all", "both", "reading"]), "only_theory": _any_sql("only theory"), "studies_online": _only_sql(["online", "study"], []),
    "wants_activities": _any_sql("activity"), "wants_assessment": _any_sql("assessment"), "wants_assignments": _any_sql("assignment"), "wants_books": _any_sql("book", "text", "tool", "assignment"),
    "wants_both": _any_sql("both", "mixed"), "wants_credits": _any_sql("credit"), "wants_deployment": _any_sql("deployment"), "wants_detailed": _any_sql("each"), "wants_electives": _any_sql("elective"),
    "wants_evaluation": _any_sql("assessment", "oral"), "wants_exam_scheme": _any_sql("exam scheme"), "wants_experiments": _any_sql("experiment"), "wants_guidelines": _any_sql("guide"),
    "wants_modules": _any_sql("module"), "wants_objectives": _any_sql("aim"), "wants_outcomes": _any_sql("outcome"), "wants_scheme": _any_sql("scheme"),
    "wants_short_list": _only_sql(["listing"], ["detail", "experiment", "all"]), "wants_some_modules": _only_sql(["module"], ["full"]), "wants_structure": _any_sql("structure"),
    "wants_syllabus": _any_sql("content", "module"), "wants_teaching_hours": _any_sql("hours"), "wants_teams": _any_sql("team"),
    "wants_term_courses": f"{_any_sql('course', 'content', 'credit')} AND {_topic_sql('semester')}", "wants_whole": _any_sql("whole structure"),
}


@query(f"""WITH w AS (SELECT [{listed(WANTS)}] AS a),
q AS (SELECT event_id, lower(a[event_id % {len(WANTS)} + 1] || ' / ' || a[user_id % {len(WANTS)} + 1]) AS text FROM events, w),
s AS (SELECT *, regexp_extract(text, '\\b(?:sem(?:ester)?|term)\\s*([1-8]|viii|vii|vi|iv|v|iii|ii|i)\\b', 1) AS t, ' ' || array_to_string(regexp_extract_all(text, '[a-z0-9]+'), ' ') || ' ' AS n FROM q)
SELECT event_id, {", ".join(f"{_INTENT_SQL[name]} AS {name}" for name in dispatch.ASKED)},
  CASE t WHEN 'iv' THEN 4 WHEN '7' THEN 7 END AS semester FROM s""")
def query_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in WANTS])
    pick = lambda key: F.element_at(words, (F.col(key) % len(WANTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(pick("event_id"), F.lit(" / "), pick("user_id")).alias("text"))
    return dispatch.predicates(rows).drop("text")


@query(f"""WITH w AS (SELECT [{listed(MORE_WANTS)}] AS a),
q AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' / ' || a[(conv_id * 7 + turn) % {len(MORE_WANTS)} + 1]) AS x FROM conversations, w),
s AS (SELECT conv_id, turn, ' ' || array_to_string(regexp_extract_all(x, '[a-z0-9]+'), ' ') || ' ' AS n FROM q)
SELECT conv_id, turn, concat_ws(',', {", ".join(f"CASE WHEN {sql} THEN {quoted(name)} END" for name, sql in sorted(_INTENT_SQL.items()))}) AS intents FROM s""")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a request at their end, and all that they ask for."""
    ship(spark)
    rows = table(spark, sf_dir, "conversations")
    wants = F.element_at(F.array(*[F.lit(w) for w in MORE_WANTS]), ((F.col("conv_id") * 7 + F.col("turn")) % len(MORE_WANTS) + 1).cast("int"))
    found = intents.with_intents(rows.select("conv_id", "turn", F.concat_ws(" / ", F.coalesce("text", F.lit("")), wants).alias("text")))
    held = F.filter(F.array(*[F.lit(i) for i in sorted(intents.INTENTS)]), lambda i: F.element_at(F.col("intents"), i))
    return found.select("conv_id", "turn", F.array_join(held, ",").alias("intents"))


_TERM_SQL = "list_extract(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii'], n_nationkey % 8 + 1)"


def _term() -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in numbers.ROMANS]), (F.col("n_nationkey") % 8 + 1).cast("int"))


@query(f"""WITH {_COURSES_SQL},
q AS (SELECT n_nationkey, n_nationkey % 8 + 1 AS semester, n_nationkey % 4 AS turn FROM nation),
c AS (SELECT p_partkey % 8 + 1 AS semester, p_partkey AS ord, code, is_lab FROM part JOIN courses ON code = {_CODE_SQL % (("p_partkey",) * 2)})
SELECT n_nationkey, 0 AS part, ord, 0 AS line_no, code, 'row ' || ord AS line FROM q JOIN c USING (semester) WHERE turn < 3
UNION ALL SELECT n_nationkey, 1, ord, i::INT, code, code || ' line ' || i FROM q JOIN c USING (semester), unnest([1, 2]) AS l(i)
WHERE turn = 0 OR (turn = 1 AND NOT is_lab) OR (turn = 2 AND is_lab)""")
def semester_syllabus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semester's table and the outlines of its courses; one query a nation, a stated set."""
    asks = [("detailed syllabus of sem ", ""), ("all courses of semester ", ", only theory"), ("each subject of term ", ": practicals"), ("syllabus of sem ", "")]
    texts = [F.concat(F.lit(a), _term(), F.lit(b)) for a, b in asks]
    queries = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*texts), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("text"))
    courses = _courses(spark, sf_dir)
    core = courses.select((F.col("p_partkey") % 8 + 1).cast("int").alias("semester"), F.col("p_partkey").alias("ord"), "code", "is_lab")
    lines = courses.select("code", F.explode(F.array(F.lit(1), F.lit(2))).alias("line_no")).withColumn("line", F.concat("code", F.lit(" line "), "line_no"))
    structure = core.select("semester", "ord", "code", F.concat(F.lit("row "), "ord").alias("line"))
    return dispatch.semester_syllabus(queries, "n_nationkey", "text", core, lines, structure)


@query(f"""WITH c AS (SELECT p_partkey % 8 + 1 AS semester, p_size % 2 AS elective, {_CODE_SQL % (("p_partkey",) * 2)} AS code FROM part)
SELECT n_nationkey, elective::INT AS part, code FROM nation JOIN c ON semester = n_nationkey % 8 + 1
WHERE (elective = 0 AND n_nationkey % 5 IN (0, 1, 4)) OR (elective = 1 AND n_nationkey % 5 IN (1, 2))""")
def structure_or_electives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semester's courses, its electives, or both; a named course asks for neither unless all are wanted."""
    first = _code("n_nationkey")
    texts = [
        F.concat(F.lit("structure of sem "), _term()),
        F.concat(F.lit("subjects and electives in semester "), _term()),
        F.concat(F.lit("minors of sem "), _term()),
        F.concat(F.lit("credits of "), first, F.lit(" in semester "), _term()),
        F.concat(F.lit("all courses beside "), first, F.lit(" in semester "), _term()),
    ]
    queries = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*texts), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("text"))
    kinds = table(spark, sf_dir, "part").select((F.col("p_partkey") % 8 + 1).cast("int").alias("semester"), (F.col("p_size") % 2).alias("elective"), _code("p_partkey").alias("code"))
    named = dispatch.mentions(queries, ["n_nationkey"], "text", _courses(spark, sf_dir))
    return dispatch.structure_or_electives(queries, "n_nationkey", "text", kinds.where("elective = 0"), kinds.where("elective = 1"), named)


def _named(*names: str, number: str = "") -> str:
    """A pattern for any of these names, words apart by spaces, with the number that follows."""
    return r"\b(?:" + "|".join(n.replace(" ", r"\s+") for n in names) + r")" + number + r"\b"


#: Special tables in order of precedence; a numbered one by digit or numeral up to four.
SPECIALS = [
    ("nomenclature", _named("nomenclature", "curriculum abbreviations?")),
    ("program_elective", _named("program elective", "pe", number=r"[\s_-]*(" + "|".join([str(n) for n in range(1, 5)] + sorted((r for r, n in numbers.ROMANS.items() if n <= 4), key=len, reverse=True)) + ")")),
    ("open_elective", _named("open electives?", "oe")),
    ("minors", _named("minors?", "mdms?")),
]


@query("""WITH q AS (SELECT conv_id, turn, conv_id % 5 AS k FROM conversations),
t AS (SELECT 'nomenclature' AS route, NULL AS number, r_regionkey AS ord, r_name AS cell FROM region
  UNION ALL SELECT 'program_elective', n_regionkey, n_nationkey, n_name FROM nation
  UNION ALL SELECT 'minors', NULL, n_nationkey, upper(n_name) FROM nation),
w AS (SELECT conv_id, turn, route, ord, cell FROM q JOIN t ON (k = 0 AND route = 'nomenclature') OR (k = 1 AND route = 'program_elective' AND number = 2)
  OR (k = 2 AND route = 'minors') OR (k = 3 AND route = 'program_elective' AND number = 4))
SELECT conv_id, turn, route, ord, cell FROM w""")
def special_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first special table that a query asks for: an empty one passes on to the next."""
    texts = F.array(*[F.lit(t) for t in ("Nomenclature, and PE 2?", "the Program Elective-II list", "open electives or minors", "PE 4 or MDMs", "hello")])
    asked = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("q"), F.element_at(texts, (F.col("conv_id") % 5 + 1).cast("int")).alias("text"))
    nations = table(spark, sf_dir, "nation")
    row = lambda route, number, key, cell: [F.lit(route).alias("route"), number.cast("int").alias("number"), F.col(key).cast("int").alias("ord"), F.array(cell).alias("cells")]
    tables_ = table(spark, sf_dir, "region").select(*row("nomenclature", F.lit(None), "r_regionkey", F.col("r_name")))
    tables_ = tables_.unionByName(nations.select(*row("program_elective", F.col("n_regionkey"), "n_nationkey", F.col("n_name"))))
    tables_ = tables_.unionByName(nations.select(*row("minors", F.lit(None), "n_nationkey", F.upper("n_name"))))
    found = dispatch.special_tables(asked, "q", "text", SPECIALS, tables_)
    return found.select("q.conv_id", "q.turn", "route", "ord", F.get("cells", F.lit(0)).alias("cell"))
