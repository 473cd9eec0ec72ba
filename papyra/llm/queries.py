"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import conversations, decontaminate, filter_audit, fingerprints, html_text, jaccard, language, licences, lines, mixing, secrets, suffixes, warc
from .common import shared_dir, staged, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.searched(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, path)
    found = warc.resolved(staged(warc.read(spark, path, payloads=False).drop("payload"), "records"))
    kind = dict(pages.dtypes)["page_id"]
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))["taken"]


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package sent to the Python workers first."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": _shipped(op2_suffix_dedup),
    "op3_simhash": _shipped(op3_simhash),
    "op4_decontaminate": _shipped(op4_decontaminate),
    "op5_html_text": _shipped(op5_html_text),
    "op6_language": _shipped(op6_language),
    "op7_warc": _shipped(op7_warc),
    "op8_jaccard": _shipped(op8_jaccard),
    "op9_mixing": op9_mixing,
    "op10_licences": op10_licences,
    "op11_filter_audit": op11_filter_audit,
    "op12_secrets": _shipped(op12_secrets),
    "op13_conversations": _shipped(op13_conversations),
}

def _licence_sql() -> str:
    """The scan in DuckDB's dialect, from the operator's fixed values."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cleaned = f"regexp_replace(lower(%s), {quoted(licences.COPYRIGHT_LINE)}, '', 'g')"
    for pattern, replacement in licences.SPELLINGS:
        cleaned = f"regexp_replace({cleaned}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    cleaned = f"regexp_replace({cleaned}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    joined = "trim(regexp_replace(%s, '[ \\n]+', ' ', 'g'))"
    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in licences.KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT sha256({joined % (cleaned % "t")}) AS digest, i AS licence FROM (VALUES {values}) AS v(i, t)),
cleaned AS (SELECT doc_id, {cleaned % "coalesce(text, '')"} AS c FROM documents),
units AS (
  SELECT doc_id, sha256({joined % "c"}) AS whole, unnest(list_concat([c], string_split(c, chr(10)), regexp_split_to_array(c, '\\n *\\n'))) AS u FROM cleaned),
digests AS (SELECT DISTINCT doc_id, whole, sha256({joined % "u"}) AS digest FROM units)
SELECT doc_id, whole AS digest, max(CASE WHEN k.digest = whole THEN licence END) AS licence,
  coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences, count(licence) AS n_found
FROM digests LEFT JOIN known k USING (digest) GROUP BY doc_id, whole"""


ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM parts),
worded AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM lines),
firsts AS (
  SELECT words, len(words) AS n, min(struct_pack(d := doc_id, p := pos)) AS f
  FROM worded WHERE len(words) > 0 GROUP BY words),
variants AS (
  SELECT f, n, i, list_concat(words[1:i - 1], words[i + 1:]) AS rest
  FROM firsts, unnest(range(1, n + 1)) AS t(i) WHERE n >= 5),
near AS (
  SELECT f FROM (SELECT f, min(f) OVER (PARTITION BY n, i, rest) AS m FROM variants) WHERE f <> m
  UNION
  SELECT CASE WHEN v.f > s.f THEN v.f ELSE s.f END AS f FROM variants v JOIN firsts s ON s.words = v.rest),
kept AS (SELECT f.d AS doc_id, f.p AS pos FROM firsts WHERE f NOT IN (SELECT f FROM near)),
judged AS (
  SELECT w.doc_id, w.line, w.pos, len(w.words) > 0 AS has_words, len(w.words) = 0 OR k.pos IS NOT NULL AS stays
  FROM worded w LEFT JOIN kept k ON k.doc_id = w.doc_id AND k.pos = w.pos),
rebuilt AS (
  SELECT doc_id, count(*) FILTER (has_words) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS kept
  FROM judged GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM rebuilt""",
    "op7_warc": r"""
WITH heads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hexed AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM heads),
fives AS (SELECT page_id, n, h, list_transform(range(8), lambda k: ('0x' || substr(h, 5 * k + 1, 5))::BIGINT) AS v FROM hexed),
coded AS (
  SELECT page_id, n, list_aggregate(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS digest
  FROM fives),
original AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS o FROM coded)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> o THEN o END AS refers_to FROM original""",
    "op10_licences": _licence_sql(),
    "op13_conversations": r"""
WITH RECURSIVE codes AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS t(i))),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS harm
  FROM keyed, codes),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
left_over AS (
  SELECT c, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harmed h JOIN ids ON ids.conv_id IS NOT DISTINCT FROM h.conv_id, unnest(CASE WHEN harm = 0 THEN [] WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS t(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS pos, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM left_over),
faulty AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY pos) || left(role, 1) AS pair FROM placed),
told AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c),
sizes AS (SELECT ids.c, conv_id, coalesce(n, 0) AS n FROM ids LEFT JOIN told USING (c)),
moves(kind, state, initial, next, edit, cost, named) AS (VALUES
  ('gap', 0, '', 0, '', 0, ''), ('gap', 1, '', 1, '', 0, ''), ('gap', 2, '', 2, '', 0, ''), ('gap', 3, '', 3, '', 0, ''),
  ('gap', 0, '', 2, 'I', 3, 'user'), ('gap', 1, '', 2, 'I', 3, 'user'), ('gap', 3, '', 2, 'I', 3, 'user'), ('gap', 2, '', 3, 'I', 3, 'assistant'),
  ('row', 0, 's', 1, 'K', 0, ''), ('row', 0, 'u', 2, 'K', 0, ''), ('row', 1, 'u', 2, 'K', 0, ''), ('row', 3, 'u', 2, 'K', 0, ''), ('row', 2, 'a', 3, 'K', 0, ''),
  ('row', 0, '', 2, 'R', 3, 'user'), ('row', 1, '', 2, 'R', 3, 'user'), ('row', 3, '', 2, 'R', 3, 'user'), ('row', 2, '', 3, 'R', 3, 'assistant'),
  ('row', 0, '', 0, 'D', 4, ''), ('row', 1, '', 1, 'D', 4, ''), ('row', 2, '', 2, 'D', 4, ''), ('row', 3, '', 3, 'D', 4, '')),
walk AS (
  SELECT c, n, 0 AS k, 0 AS state, 0 AS cost, '' AS audit, '' AS made FROM sizes
  UNION ALL
  SELECT c, n, k + 1, next, best.cost, best.audit, best.made FROM (
    SELECT w.c, w.n, w.k, m.next, min({'cost': w.cost + m.cost + CASE WHEN m.edit IN ('K', 'R') AND f.cut THEN 3 ELSE 0 END, 'audit': w.audit || m.edit,
      'made': w.made || CASE m.edit WHEN 'K' THEN chr(10) || f.role || ':' || f.text WHEN 'R' THEN chr(10) || m.named || ':' || f.text WHEN 'I' THEN chr(10) || m.named || ':' ELSE '' END}) AS best
    FROM walk w JOIN moves m ON m.state = w.state AND (m.kind = 'row') = ((w.k + 1) % 3 = 0) LEFT JOIN faulty f ON m.kind = 'row' AND f.c = w.c AND f.pos = (w.k + 1) // 3
    WHERE w.k < 3 * w.n + 2 AND (m.edit <> 'K' OR m.initial = left(f.role, 1)) AND (m.kind = 'gap' OR m.edit = 'D' OR NOT (f.blank OR f.again))
    GROUP BY ALL)),
best AS (SELECT c, min({'cost': cost, 'audit': audit, 'made': made}) AS b FROM walk WHERE k = 3 * n + 2 AND state IN (0, 3) GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.cost::BIGINT AS cost, b.audit AS audit, sha256(substr(b.made, 2)) AS repaired_sha256
FROM sizes JOIN best USING (c) LEFT JOIN told USING (c)""",
    "op11_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT x.part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND toxic = 1) AS bad
  FROM texts x),
counted AS (SELECT part, fails, good, bad, count(*) AS n FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, left(filter_order, step::INT - 1) AS earlier FROM orders, range(1, 6) AS s(step)),
met AS (SELECT *, contains(fails, f) AS hit, translate(fails, earlier, '') = fails AS here FROM steps, counted),
judged AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (here AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND NOT here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (here AND hit AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (here AND hit AND bad), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM judged""",
}
