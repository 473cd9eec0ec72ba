"""URL normalisation, scope tests, labels and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that a crawl of pages skips, and URL parts that it avoids.
SKIP_EXTENSIONS = ".pdf .jpg .jpeg .png .gif .svg .webp .zip .rar .doc .docx .xls .xlsx .ppt .pptx .mp4 .mp3".split()
SKIP_PARTS = ["login", "logout"]

URL = r"^(?i)([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize_url(url: Column) -> Column:
    """Without fragment and without slashes at the end of the path; the query stays."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    return F.concat(F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), "/+$", ""), query)


def page_label(url: Column) -> Column:
    """Last part of the path in words; ``home`` for none."""
    slug = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1)
    words = F.trim(F.regexp_replace(F.regexp_replace(slug, r"\.(php|html)$", ""), "[-_]", " "))
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("home"))


def in_scope(url: Column, domain: str) -> Column:
    """Whether a web page of the domain or a subdomain that a crawl may read."""
    low = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    allowed = scheme(url).isin("http", "https") & ((host(url) == domain) | host(url).endswith(f".{domain}"))
    for extension in SKIP_EXTENSIONS:
        allowed &= ~low.endswith(extension)
    for part in SKIP_PARTS:
        allowed &= ~F.contains(F.lower(url), F.lit(part))
    return allowed


def is_internal(url: Column, netloc: str) -> Column:
    return host(url).isin("", netloc)


def is_pdf_url(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def without_dots(x: Column) -> Column:
    """A path whose ``.`` and ``..`` parts are followed: a stack of parts, on which ``..`` takes the last away (RFC 3986, 5.2.4)."""
    parts = F.split(x, "/", -1)
    last = F.element_at(parts, -1)
    held = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda stack, part: F.when(part == ".", stack).when(part == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part))),
    )
    # A path that ends in dots ends in a folder.
    closed = F.when(last.isin(".", ".."), F.concat(held, F.array(F.lit("")))).otherwise(held)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def resolved(url: Column, base: Column) -> Column:
    """``url`` resolved against ``base`` (RFC 3986, 5.2), without its fragment: absolute, protocol-relative, rooted, a query, or relative to the base's folder."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), "^(.*/)", 1)
    plain = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(plain, r"(\?.*)$", 1)
    own = F.regexp_replace(plain, r"\?.*$", "")
    rooted = lambda p: F.concat(root, F.when(F.contains(p, F.lit("/.")), without_dots(p)).otherwise(p), query)
    return (
        F.when(plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), plain)
        .when(plain.startswith("//"), F.concat(scheme(base), F.lit(":"), plain))
        .when(plain.startswith("/"), rooted(own))
        .when(plain == "", F.regexp_replace(base, "#.*$", ""))
        .when(plain.startswith("?"), F.concat(root, path(base), plain))
        .otherwise(rooted(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own)))
    )


def kept_url(url: Column, base: Column, netloc: str, excluded: list[str]) -> Column:
    """The resolved URL if internal and free of all excluded substrings, else null."""
    full = resolved(url, base)
    bad = F.lit(False)
    for part in excluded:
        bad |= F.contains(F.lower(full), F.lit(part))
    return F.when(~bad & is_internal(full, netloc), full)


def unquoted(x: Column) -> Column:
    """Percent sequences decoded; a plus stays a plus."""
    return F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def first_match(x: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first category, in order, one of whose keywords the lower-case text contains."""
    out = None
    for category, words in rules:
        found = F.lit(False)
        for word in words:
            found |= F.contains(F.lower(x), F.lit(word))
        out = F.when(found, category) if out is None else out.when(found, category)
    return F.lit(default) if out is None else out.otherwise(default)
