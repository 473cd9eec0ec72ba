"""Numbers in queries: words, ordinals, roman numerals, lists and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numerals and number words.
ROMANS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
CARDINALS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth".split()
WORDS = {w: i for words in (CARDINALS, ORDINALS) for i, w in enumerate(words, 1)}

NUMBER = r"(?:\d+(?:st|nd|rd|th)?|" + "|".join(sorted(WORDS, key=len, reverse=True)) + ")"


def number_of(token: Column) -> Column:
    """A digit string, ordinal or number word as an integer, else null."""
    low = F.lower(token)
    digits = F.regexp_extract(low, r"^(\d+)(?:st|nd|rd|th)?$", 1)
    return F.coalesce(digits.try_cast("int"), F.try_element_at(F.create_map(*[F.lit(v) for pair in WORDS.items() for v in pair]), low))


def semester_of(token: Column) -> Column:
    """A semester number from digits, an ordinal or a roman numeral up to eight, else null."""
    low = F.lower(token)
    roman = F.try_element_at(F.create_map(*[F.lit(v) for pair in ROMANS.items() for v in pair]), low)
    n = F.coalesce(roman, number_of(low))
    return F.when(n.between(1, 8), n)


def in_order(low: Column, high: Column) -> Column:
    """All integers from the smaller to the larger, both included."""
    return F.sequence(F.least(low, high), F.greatest(low, high))


def requested(query: Column, noun: str, most: int = 10) -> Column:
    """Numbers that a query asks for of numbered things called ``noun``, as ``kind`` and ``numbers``.

    In order of precedence: the last n, the first n, a range, a list before the
    noun, a list after it. Numbers of lists are limited to 1..most.
    """
    low = F.lower(query)
    part = lambda pattern, i: number_of(F.regexp_extract(low, pattern, i))
    last = rf"\b(?:last|final)\s+({NUMBER})\s+{noun}"
    first = rf"\b(?:first|initial|top)\s+({NUMBER})\s+{noun}"
    ranged = rf"(?:{noun}\w*\s+(?:from\s+)?({NUMBER})\s*(?:to|-|through)\s*({NUMBER})\b|\bbetween\s+({NUMBER})\s+and\s+({NUMBER})\b)"
    a = F.coalesce(part(ranged, 1), part(ranged, 3))
    b = F.coalesce(part(ranged, 2), part(ranged, 4))
    listed = rf"{NUMBER}(?:\s*(?:,|and|&)\s*{NUMBER})*"

    def numbers(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(rf"\b({NUMBER})\b"), F.lit(1)), number_of)
        return F.array_distinct(F.filter(found, lambda n: n.between(1, most)))

    before = numbers(F.regexp_extract(low, rf"\b({listed})\s+{noun}", 1))
    after = numbers(F.regexp_extract(low, rf"\b{noun}\w*\s+(?:no\.?\s+|number\s+)?({listed})\b", 1))
    one_to = lambda n: F.sequence(F.lit(1), n)
    return (
        F.when(part(last, 1).isNotNull(), F.struct(F.lit("last").alias("kind"), F.array(part(last, 1)).alias("numbers")))
        .when(part(first, 1).isNotNull(), F.struct(F.lit("first").alias("kind"), one_to(part(first, 1)).alias("numbers")))
        .when(a.isNotNull() & b.isNotNull(), F.struct(F.lit("range").alias("kind"), in_order(a, b).alias("numbers")))
        .when(F.size(before) > 0, F.struct(F.lit("list").alias("kind"), before.alias("numbers")))
        .when(F.size(after) > 0, F.struct(F.lit("list").alias("kind"), after.alias("numbers")))
        .otherwise(F.struct(F.lit("all").alias("kind"), F.array().cast("array<int>").alias("numbers")))
    )


def selected(request: Column, available: Column) -> Column:
    """The numbers of ``available`` (sorted) that a request names; of ``last`` the n last, of ``all`` all."""
    kind, numbers = request["kind"], request["numbers"]
    n = F.least(F.element_at(numbers, 1), F.size(available))
    return (
        F.when(kind == "all", available)
        .when(kind == "last", F.slice(available, F.size(available) - n + 1, n))
        .when(kind == "first", F.slice(available, F.lit(1), F.least(F.size(numbers), F.size(available))))
        .otherwise(F.array_intersect(available, numbers))
    )
