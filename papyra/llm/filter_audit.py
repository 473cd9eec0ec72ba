"""How filters of a corpus overlap, and what their order does.

A document fails a set of filters when it fails each of them. The numbers of
documents that fail each set, sums of products of flags, say everything: by
inclusion and exclusion (a Moebius inversion over sets) they give the survivors
of every set, so what any filter removes at any step of any order, what it alone
would remove, and what was gone before. The removals of a set of filters are a
cooperative game whose Harsanyi dividends are the same joint counts with
alternating signs; each dividend, dealt evenly to the members of its set, gives
the filters' Shapley values (Shapley 1953, Harsanyi 1963).

Only counts leave the rows: documents are first counted by their flags, at most
2**n rows a part and task, then the joint counts are summed from these.

Defined results: a null text counts as empty; a null part is the empty string; a
document with a null doc_id has no earlier text and no label; of two rows with
equal doc_id and text neither is the earlier; labels of one doc_id are joined by
or, null ones count as 0; an empty table gives an empty result; other columns
are ignored, whatever their names. Texts are read whole and told apart by their
SHA-256, so copies in any number meet as one short row a task.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import SPACE

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = "[#$%&*|]"


def text_flags(text: Column) -> dict[str, Column]:
    """Failures that a text shows by itself: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
        "C": capitals * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, n``, the flags ``A`` to ``E`` and the losses ``good`` and ``toxic``: documents counted by doc_id and flags.

    The first document of a text is joined back by its digest and doc_id, so a
    text with any number of copies meets one row, not all of them.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[f.alias(k) for k, f in text_flags(text).items()])
    counted = rows.groupBy("doc_id", "part", "digest", *"ABCD").agg(F.count("*").alias("n"))
    first = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.where("doc_id is not null").groupBy("doc_id")
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    found = counted.join(first, ["doc_id", "digest"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    flags = found.groupBy("doc_id", "part", *FILTERS).agg(F.sum("n").alias("n"))
    return flags.join(told, "doc_id", "left").select("part", "n", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def audit(rows: DataFrame, filters: str = FILTERS, losses: tuple[str, ...] = ("good", "toxic"), part: str = "part") -> DataFrame:
    """Every part, order of the filters and step: kept, removed, redundant, unique_fails, what is lost, shapley.

    ``rows`` have a part, ``n`` documents each, a boolean column a filter (one
    letter, true for a failure) and one a loss. ``shapley`` is the filter's
    Shapley value times the number of orders, a whole number.
    """
    n = len(filters)
    sets = range(1 << n)
    rows = rows.groupBy(part, *filters, *losses).agg(F.sum("n").alias("n"))

    def joint(weight: Column) -> Column:
        """By set of filters (a number, the first one's bit lowest): how many fail all of it."""
        sums = []
        for s in sets:
            product = weight
            for i, f in enumerate(filters):
                if s >> i & 1:
                    product = product * F.col(f).cast("long")
            sums.append(F.sum(product))
        return F.array(*sums)

    counts = {"all": F.col("n")} | {c: F.col("n") * F.col(c).cast("long") for c in losses}
    per = rows.groupBy(part).agg(*[joint(w).alias(f"j_{c}") for c, w in counts.items()])

    def survivors(c: str) -> Column:
        """By set: how many fail none of it."""
        numbers = F.sequence(F.lit(0), F.lit(len(sets) - 1))

        def of(s: Column) -> Column:
            signed = lambda t: F.when(t.bitwiseAND(s) != t, 0).otherwise(F.get(f"j_{c}", t) * F.when(F.bit_count(t) % 2 == 0, 1).otherwise(-1))
            return F.aggregate(numbers, F.lit(0).cast("long"), lambda sum_, t: sum_ + signed(t))

        return F.transform(numbers, of)

    per = per.select(part, "j_all", *[survivors(c).alias(f"k_{c}") for c in counts])
    # The dividend of a set, dealt to its members over all orders: n! / size is whole.
    share = [sum((-1 if s.bit_count() % 2 == 0 else 1) * (factorial(n) // s.bit_count()) * F.get("j_all", F.lit(s)) for s in sets if s >> i & 1) for i in range(n)]
    per = per.withColumn("shares", F.array(*share))
    steps = [
        {"filter_order": order, "step": k + 1, "before": sum(1 << filters.index(f) for f in order[:k]), "f": filters.index(order[k]), "bit": 1 << filters.index(order[k])}
        for order in map("".join, permutations(filters))
        for k in range(n)
    ]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, f: int, bit: int>>")
    each = per.withColumn("s", F.explode(table)).select("*", "s.*")
    bit = F.col("bit")
    after = F.col("before").bitwiseOR(bit)
    whole = F.lit(len(sets) - 1)
    gone = lambda c: F.get(f"k_{c}", F.col("before")) - F.get(f"k_{c}", after)
    return each.select(
        part, "filter_order", "step", F.get("k_all", after).alias("kept"), gone("all").alias("removed"), (F.get("j_all", bit) - gone("all")).alias("redundant"),
        (F.get("k_all", whole.bitwiseXOR(bit)) - F.get("k_all", whole)).alias("unique_fails"), *[gone(c).alias(f"{c}_lost") for c in losses], F.get("shares", F.col("f")).alias("shapley"),
    )
