"""Licence scans by canonical digest.

A text's canonical form has lower case, no copyright lines, one spelling of
words that licence texts vary, and single spaces in place of punctuation and
white space. Its SHA-256 is joined to the digests of known licence texts and
notices. Looked up are the whole text, each paragraph, each line, and each run of
as many consecutive paragraphs as a known text has, where the run's first word is
the first word of such a text.

Defined results: null and empty texts, and texts of punctuation or copyright
lines only, match nothing; a licence found several times in a document is listed
once; of two names for one digest the last by code point is the whole text's and
both are listed; repeated rows give equal results, as do rows without a doc_id,
each for its own text; texts of any length are read whole, in memory that grows
with the longest; an empty table gives an empty result; extra columns are
ignored. The known texts are a table of licence and text, by
default KNOWN and the files in ``licence_texts``; their digests are broadcast.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal (pattern, replacement), after lower-casing.
SPELLINGS = [
    ("licence", "license"),
    ("licenc", "licens"),
    ("sub[- ]licens", "sublicens"),
    ("non[- ]commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("copyright holder(s|\\(s\\))?", "copyright owner"),
    ("per cent", "percent"),
    ("https?://", ""),
]

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved|portions copyright)[^\n]*$"

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: SPDX id and text of known licences and of the notices that name one.
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n' + _AS_IS),
    ("MIT", 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n' + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
]


def _cleaned(text: Column) -> Column:
    """Canonical but for line feeds, which stay."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for pattern, replacement in SPELLINGS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")


def _joined(cleaned: Column) -> Column:
    return F.trim(F.regexp_replace(cleaned, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    return _joined(_cleaned(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def full_texts() -> list[tuple[str, str]]:
    """SPDX id and text of the licences in ``licence_texts``; also their terms alone, where what follows is how to apply them."""
    found = []
    for file in sorted((Path(__file__).resolve().parent / "licence_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        found.append((file.stem, text))
        terms, end, after = text.partition("END OF TERMS AND CONDITIONS")
        if after.strip():
            found.append((file.stem, terms + end))
    return found


def known_texts(spark: SparkSession) -> DataFrame:
    """``licence, text`` of all licences and notices that are known by default."""
    return spark.createDataFrame(KNOWN + full_texts(), "licence string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """``digest, licence`` of known texts."""
    return known.select(digest(F.col("text")).alias("digest"), "licence").distinct()


def _paragraphs(cleaned: Column) -> Column:
    """Canonical paragraphs but for empty ones."""
    return F.filter(F.transform(F.split(cleaned, r"\n *\n", -1), _joined), lambda p: p != "")


def _first_word(paragraph: Column) -> Column:
    return F.substring_index(paragraph, " ", 1)


def run_lengths(known: DataFrame) -> Column:
    """A map from a first word to the numbers of paragraphs, from 2 on, of the known texts that begin with it."""
    rows = known.select(_paragraphs(_cleaned(F.col("text"))).alias("ps")).where("size(ps) > 1")
    rows = rows.groupBy(_first_word(F.element_at("ps", 1)).alias("word")).agg(F.sort_array(F.collect_set(F.size("ps"))).alias("sizes")).collect()
    pairs = [x for r in rows for x in (F.lit(r["word"]), F.array(*[F.lit(n) for n in r["sizes"]]))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<int>>")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, licence, licences, n_found`` of every document.

    ``licence`` is what the whole text is, ``licences`` all that it, its
    paragraphs, runs of them and its lines are, sorted and joined by a comma.
    """
    texts = known_texts(docs.sparkSession) if known is None else known
    lengths = run_lengths(texts)
    digests_of = F.broadcast(known_digests(texts))
    cleaned = docs.select("doc_id", _cleaned(F.coalesce("text", F.lit(""))).alias("cleaned"))
    units = F.concat(F.array("cleaned"), F.split("cleaned", "\n", -1))
    digests = F.transform(units, lambda u: F.sha2(_joined(u), 256))

    def runs(ps: Column) -> Column:
        fitting = lambda p, i: F.filter(F.coalesce(F.try_element_at(lengths, _first_word(p)), F.array().cast("array<int>")), lambda n: i + n <= F.size(ps))
        run = lambda i, n: F.sha2(F.array_join(F.slice(ps, i + 1, n), " "), 256)
        return F.concat(F.transform(ps, lambda p: F.sha2(p, 256)), F.flatten(F.transform(ps, lambda p, i: F.transform(fitting(p, i), lambda n: run(i, n)))))

    # A lambda over an array of one binds the paragraphs, so that they are made once.
    digests = F.concat(digests, F.flatten(F.transform(F.array(_paragraphs(F.col("cleaned"))), runs)))
    each = cleaned.select(F.monotonically_increasing_id().alias("row"), "doc_id", digests.alias("digests"))
    each = each.select("row", "doc_id", F.element_at("digests", 1).alias("whole"), F.explode(F.array_distinct("digests")).alias("digest"))
    # Rows of a document stand in one task, so partial aggregation leaves one before the shuffle.
    found = each.join(digests_of, "digest", "left").groupBy("row", "doc_id", "whole").agg(
        F.max(F.when(F.col("digest") == F.col("whole"), F.col("licence"))).alias("licence"),
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"),
        F.count("licence").alias("n_found"),
    )
    return found.select("doc_id", F.col("whole").alias("digest"), "licence", "licences", "n_found")
