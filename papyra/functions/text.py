"""Text cleaning, tokenisers, ids: functions from Column to Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the stemming tokeniser drops after normalising.
STOP_WORDS = """
a about an and are as based complete could course courses from give in is me my you your we our he him his she her it
its they them their can should would refer read use suggest recommended of on please show tell the to what which with
wise syllabus module modules topic topics self learning content outline lab labs practical practicals experiment
experiments list first initial top last final between
""".split()

#: Words that the plural-stripping tokeniser drops before stripping.
SITE_STOP_WORDS = """
a an the of in on at for to and or is are was were who what which list me tell about its it with from by be as do does
name names show give all please
""".split()

#: Line breaks of Python's splitlines, and all white space, as both regular-expression dialects read them.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


#: A bound of a word of ASCII letters, digits and underscores. Java's own depends on its version and counts other letters.
WORD_BOUND = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_bounds(pattern: str) -> str:
    r"""A pattern whose ``\b`` is the bound of an ASCII word, as SQL's is."""
    return re.sub(r"\\(.)", lambda m: WORD_BOUND if m[1] == "b" else m[0], pattern, flags=re.S)


def clean_line(x: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def split_lines(x: Column) -> Column:
    return F.split(x, LINE_BREAK, -1)


def cache_key(x: Column) -> Column:
    return clean_line(F.lower(x))


#: Removed markup: data-URI images, images, reference images, img tags, comments, bare base64 runs.
MARKUP = [
    r"!\[[^\]]*\]\(data:[^)]*\)",
    r"!\[[^\]]*\]\([^)]*\)",
    r"!\[[^\]]*\]\[[^\]]*\]",
    r"(?is)<img[^>]*>",
    r"(?s)<!--.*?-->",
    r"data:image/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=]+",
]


def strip_markup(x: Column) -> Column:
    """Markdown without images, comments and embedded data; at most one empty line in a row."""
    for pattern in MARKUP:
        x = F.regexp_replace(x, pattern, "")
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def stemmed(t: Column) -> Column:
    """Singular of -ies and -s words, -ing removed and a doubled last letter undone."""
    stem = F.substring(t, F.lit(1), F.length(t) - 3)
    doubled = (F.length(stem) > 2) & (F.right(stem, F.lit(1)) == F.substring(stem, F.length(stem) - 1, F.lit(1)))
    return (
        F.when((F.length(t) > 5) & t.endswith("ies"), F.concat(stem, F.lit("y")))
        .when((F.length(t) > 7) & t.endswith("ing"), F.when(doubled, F.left(stem, F.length(stem) - 1)).otherwise(stem))
        .when((F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1))
        .otherwise(t)
    )


def tokens_stemmed(x: Column) -> Column:
    """Words and joined hyphen compounds, stemmed; stop words go after stemming."""
    low = F.lower(x)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    compounds = F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9_])[a-z0-9]+(?:-[a-z0-9]+)+(?![a-z0-9_])"), F.lit(0))
    joined = F.transform(compounds, lambda c: F.replace(c, F.lit("-"), F.lit("")))
    return F.filter(F.transform(F.concat(words, joined), stemmed), lambda t: ~t.isin(STOP_WORDS))


def tokens_plural(x: Column) -> Column:
    """Words less stop words, then less a plural s."""
    words = F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(SITE_STOP_WORDS))
    return F.transform(words, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.left(t, F.length(t) - 1)).otherwise(t))


def tokens_unicode(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def answer_tokens(x: Column) -> Column:
    """Words, line feeds and gaps of an answer, in order."""
    return F.regexp_extract_all(x, F.lit(r"\S+|\n|\s+"), F.lit(0))


def hash_id(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(16))


def file_key(url: Column) -> Column:
    """Slug of at most 70 characters and the start of the URL's hash."""
    name = F.regexp_replace(F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1), r"(?i)\.pdf$", "")
    slug = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    slug = F.when(slug == "", "document").otherwise(slug)
    return F.concat(F.left(slug, F.lit(70)), F.lit("_"), F.left(F.sha2(url, 256), F.lit(16)))


def chunk_id(url: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", url, index.cast("string"), text), 256)


def key_values(x: Column, item: str = ";", pair: str = ": ") -> Column:
    """``a: 1; b: 2`` as a map; of repeated keys the last counts."""
    pairs = F.filter(F.transform(F.split(x, item), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit(pair)))
    entries = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, pair, 1).alias("k"), i.alias("i"), F.regexp_replace(p, f"(?s)^.*?{pair}", "").alias("v")))
    # Sorted once, the last of each key stands before another key. A lambda over an array of one binds what was sorted.
    last = lambda s: F.filter(s, lambda e, i: ~F.coalesce(F.get(s, i + 1)["k"] == e["k"], F.lit(False)))
    kept = F.flatten(F.transform(F.array(F.sort_array(entries)), last))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


def title_case(x: Column) -> Column:
    """Upper case after every non-letter, lower case else."""
    letters = F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(letters, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def non_ascii(x: Column, instead: str = "'") -> Column:
    return F.regexp_replace(x, r"[^\x00-\x7F]+", instead)
