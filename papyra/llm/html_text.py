"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, and each line gets a
weight. Text lengths of the lines are summed over windows of WINDOW lines. Where the
sum surges to the threshold, the text stays from where the sum last rose above
zero to where it next dives to zero.

Elements are evidence for the weights. What a page holds beside its article
(menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments), known by element, role, or the main word of a class or id,
weighs nothing; a paragraph of an article is no such part by a word that prose is
also about. Up to LINKS lines of links between two surges belong to the article,
and so do whole sentences after the last one, unless they speak of rights; more
links in a row are a menu. A page without a mark of its article has its links at no weight
either. On a page that marks its article or main part, links within that are text
like other text, any sum there is a surge, and lines elsewhere weigh nothing.

Defined results: a null or empty page, or one without text, gives an empty text;
a page without a surge keeps its densest stretches, so that a short article is
found; unclosed elements end where a browser ends them, at the latest with the
element around them; repeated rows give equal results, as do rows without a
page_id or url; an empty table gives an empty result; extra columns are ignored.
Pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 86
#: Lines of links in a row that an article may have; more are a menu.
LINKS = 4

#: What stands in a tag. A quote counts after an equals sign only, and if a space or the tag's end follows its mate: others are characters.
_INNER = r"""(?:=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(script|style|noscript|template|iframe|textarea|svg|title|head(?=>|\s))\b{_INNER}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_INNER})>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements, roles and main words of classes and ids that mark what is not the article.
APART = frozenset("nav footer aside form button select fieldset dialog menu object canvas audio video datalist input".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar"
    " sidebar aside widget widgets footer header masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " newsletter subscribe subscription signup login social share sharing related recommended"
    " comment comments disqus respond replies reply search form skip hidden copyright disclaimer".split()
)
#: Words that say where or in what shape a part is, and those that speak of another part.
SHAPE_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons center col column container content default desktop entry first global grid group"
    " heading icon icons image img inner item items label large last left line link links list main meta mobile outer page panel part post posts primary"
    " right row secondary section single site slot small stories story text thread title top unit wrap wrapper".split()
)
ABOUT_WORDS = frozenset("no not has have with without show hide js after before".split())
#: Words that a paragraph of an article may bear although other parts of these names are apart.
PROSE_WORDS = frozenset("alert alerts copyright disclaimer footer form header login overlay search".split())
#: Words of articles that speak of another page, or of readers.
OTHER_ARTICLES = frozenset("comment comments preview previews promo recommended related reply sponsored teaser teasers".split())
_KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
_ENDS_P = frozenset("p div ul ol dl table section article main header footer aside nav form h1 h2 h3 h4 h5 h6 pre blockquote hr figure address".split())


def _apart(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in APART or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in APART_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    heads = {_head(name) for k in ("class", "id") for name in found.get(k, "").split()}
    if tag in _KEPT:
        return tag == "article" and not heads.isdisjoint(OTHER_ARTICLES)
    return not heads.isdisjoint(APART_WORDS - PROSE_WORDS if tag == "p" and in_article else APART_WORDS)


def _head(name: str) -> str:
    """The main word of a class or id: its last that says more than a shape. ``cookie-notice-box`` is a notice, ``social-history`` a history."""
    words = [w.lower() for w in _NAME.findall(name)]
    if words and words[0] in ABOUT_WORDS:
        return ""
    return next((w for w in reversed(words) if len(w) > 1 and not w.isdigit() and w not in SHAPE_WORDS), "")


class _Lines:
    """Block lines of a page, and how much of each is link text."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.main = False

    def add(self, text: str, in_link: bool) -> None:
        text = entities.unescape(text)
        self.parts.append(text)
        if in_link:
            self.linked += len("".join(text.split()))

    def end(self) -> None:
        if self.parts:
            line = " ".join("".join(self.parts).split())
            if line:
                self.lines.append((line, self.linked, self.main))
            self.parts, self.linked = [], 0

    def gap(self) -> None:
        self.end()
        self.lines.append(("", 0, self.main))


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Text lines of a page, the linked length and whether in the main part; an empty line for each part left out."""
    out = _Lines()
    at = article = link = 0
    skip, depth, inside = "", 0, []
    opened: list[str] = []
    for token in _TOKEN.finditer(page):
        if not skip and token.start() > at:
            out.add(page[at : token.start()], link > 0)
        at = token.end()
        tag = (token.group(3) or "").lower()
        if not tag:
            continue
        closing = bool(token.group(2))
        if skip:
            if closing and tag == skip:
                depth -= 1
            elif closing and tag in opened and tag not in inside:
                depth = 0  # what is around the part left out ends, and it with it
            elif closing:
                if tag in inside:
                    inside.remove(tag)
                continue
            elif (skip == "p" and tag in _ENDS_P) or (skip == tag == "li"):
                depth = 0
            else:
                if tag == skip:
                    depth += 1
                elif tag not in VOID:
                    inside.append(tag)
                continue
            if depth:
                continue
            ended, skip, inside = skip, "", []
            if closing and tag == ended:
                continue
        if tag in ("br", "hr", "td", "th"):
            out.add(" ", False)
        if tag not in INLINE and tag not in ("td", "th"):
            out.end()
        if closing:
            if tag in opened:
                while True:
                    name = opened.pop()
                    article -= name in ("article", "main")
                    link -= name == "a"
                    if name == tag:
                        break
                out.main = article > 0
            continue
        if _apart(tag, token.group(4) or "", article > 0):
            out.gap()
            if tag not in VOID:
                skip, depth, inside = tag, 1, []
            continue
        if tag not in VOID and not (token.group(4) or "").endswith("/"):
            if tag == "p" and opened and opened[-1] == "p":
                opened.pop()
            opened.append(tag)
            article += tag in ("article", "main")
            link += tag == "a"
            out.main = article > 0
    if not skip:
        out.add(page[at:], False)
    out.end()
    return out.lines


def stretches(weights: list[int], window: int, surge: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines between a rise and a dive of the window sums, with a surge between.

    A range starts and ends with a line of some weight.
    """
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    limit = min(surge, max(sums, default=0))
    rise = None
    for i, total in enumerate([*sums, 0]):
        if total > 0 and rise is None:
            rise = i
        elif total == 0 and rise is not None:
            if max(sums[rise:i]) >= limit:
                yield next(j for j in range(rise, i) if weights[j]), i
            rise = None


_SENTENCE = re.compile(r"[.!?…][\"'”’»)]*$")
_IMPRINT = re.compile(r"©|\(c\)|\bcopyright\b|\ball rights reserved\b", re.I)


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's lines, joined by line feeds."""
    lines = lines_of(page or "")
    marked = any(line and main for line, _, main in lines)
    if marked:
        weights = [len(line) if main else 0 for line, _, main in lines]
    else:
        weights = [max(0, len(line) - line.count(" ") - linked) for line, linked, _ in lines]
    found = list(stretches(weights, window, 1 if marked else surge))
    if found and not marked:
        found = _joined(lines, weights, found)
    kept = [line for a, b in found for line, _, main in lines[a:b] if line and main == marked]
    return "\n".join(kept)


def _joined(lines: list[tuple[str, int, bool]], weights: list[int], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches with the short lists of links between them, and the sentences after the last one."""
    linked = lambda a, b: sum(1 for line, _, _ in lines[a:b] if line)
    end = found[-1][1]
    for i in range(end, len(lines)):
        if weights[i] and _SENTENCE.search(lines[i][0]) and not _IMPRINT.search(lines[i][0]) and linked(end, i) <= LINKS:
            end = i + 1
        elif weights[i]:
            break
    out = [found[0]]
    for a, b in [*found[1:-1], *([(found[-1][0], end)] if len(found) > 1 else [])]:
        out[-1:] = [(out[-1][0], b)] if linked(out[-1][1], a) <= LINKS else [out[-1], (a, b)]
    return out if len(found) > 1 else [(found[0][0], end)]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
