"""Pages to lines, tables and links, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKS = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))

#: Elements that are dropped whole.
DROPPED = frozenset("script style noscript svg iframe select button".split())
HEADINGS = frozenset("h1 h2 h3 h4".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd label mark q s samp small span strong sub sup time u var".split())


#: The longest cell of a table of data, and what no such cell contains.
LONGEST_CELL, HEADING_MARK = 300, "## "


def table_lines(rows: list[list[str]], most: int = LONGEST_CELL) -> list[str]:
    """A line ``header: value; ...`` for each record of a table of data, else the cells line by line.

    Data has records of one width, two columns or more, and cells that are short and hold no heading.
    """
    cells = [cell for row in rows for cell in row]
    widths = Counter(len(row) for row in rows if row)
    of_data = len(widths) == 1 and min(widths) > 1 and widths.total() > 1
    if not of_data or any(len(cell) > most or HEADING_MARK in cell for cell in cells):
        return [cell for cell in cells if cell]
    names, *records = filter(None, rows)
    named = ([": ".join(filter(None, pair)) for pair in zip(names, record, strict=True) if pair[1]] for record in records)
    return ["; ".join(fields) for fields in named if fields]


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.tables: list[list[list[str]]] = []
        self.part: list[str] = []
        self.cell: list[list[str]] = []
        self.dropped = 0
        self.heading = False
        self.link: list[str] | None = None
        self.href = ""

    def _flush(self) -> None:
        text = " ".join("".join(self.part).split())
        self.part = []
        if not text:
            return
        line = f"## {text}" if self.heading else text
        if self.cell:
            self.cell[-1].append(line)
        else:
            self.lines.append(line)

    def _end_cell(self) -> None:
        """Close the innermost table's open cell, as the next cell, row or table end does."""
        if self.cell and len(self.cell) == len(self.tables):
            self._flush()
            self.tables[-1][-1].append(" ".join(self.cell.pop()))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropped or tag in DROPPED:
            self.dropped += tag not in VOID and tag in DROPPED
            return
        if tag == "br":
            self.part.append("\n") if self.cell or self.heading else self._flush()
            return
        if tag not in INLINE:
            self._flush()
        if tag in HEADINGS:
            self.heading = True
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._end_cell()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self._end_cell()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell.append([])
        elif tag == "a":
            self.href = dict(attrs).get("href") or ""
            self.link = []

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            self.dropped -= tag in DROPPED
            return
        if tag not in INLINE:
            self._flush()
        if tag in HEADINGS:
            self.heading = False
        elif tag in ("td", "th", "tr") and self.tables:
            self._end_cell()
        elif tag == "table" and self.tables:
            self._end_cell()
            lines = table_lines(self.tables.pop())
            if self.cell:
                self.cell[-1] += lines
            else:
                self.lines += lines
        elif tag == "a" and self.link is not None:
            if self.href:
                self.links.append((self.href, " ".join("".join(self.link).split())))
            self.link = None

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.part.append(data)
            if self.link is not None:
                self.link.append(data)

    def finish(self) -> _Reader:
        self.close()
        self._flush()
        while self.tables:
            self._end_cell()
            self.lines += table_lines(self.tables.pop())
        return self


def _read(page: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(page or "")
    return reader.finish()


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_to_lines(pages: pd.Series) -> pd.Series:
    """Text lines; headings start with ``## ``, tables as ``header: value`` rows."""
    return pages.map(lambda page: _read(page).lines)


@F.pandas_udf(LINKS)
def html_links(pages: pd.Series) -> pd.Series:
    """Links with their text, in page order."""
    return pages.map(lambda page: [{"href": h, "text": t} for h, t in _read(page).links])
