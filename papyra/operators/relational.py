"""Joins, sets, windows and aggregates in the shapes that retrieval needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def union_first(parts: list[DataFrame], key: str, order: str, most: int | None = None) -> DataFrame:
    """Union in order of part and ``order``; of rows with one key the first stays. With ``most``, the first so many and their ``place``."""
    union = None
    for i, part in enumerate(parts):
        rows = part.withColumn("part", F.lit(i))
        union = rows if union is None else union.unionByName(rows)
    kept = first_of(union, [key], ["part", order])
    if most is None:
        return kept
    # A top-k first, so that only ``most`` rows are numbered in one task.
    return kept.orderBy("part", order, key).limit(most).withColumn("place", F.row_number().over(Window.orderBy("part", order, key)))


def all_found(wanted: DataFrame, rows: DataFrame, qkey: str, key: str, order: str) -> DataFrame:
    """Rows of a query's keys with their ``place`` in the query's order, for queries all of whose keys are found."""
    keys = wanted.groupBy(F.col(qkey).alias("__q")).agg(F.countDistinct(key).alias("__want"))
    joined = wanted.join(rows, key)
    have = joined.groupBy(F.col(qkey).alias("__p")).agg(F.countDistinct(key).alias("__have"))
    whole = keys.join(have, F.col("__q").eqNullSafe(F.col("__p"))).where("__have = __want").select("__q")
    place = F.row_number().over(Window.partitionBy(qkey).orderBy(order, key))
    return joined.join(whole, F.col(qkey).eqNullSafe(F.col("__q")), "left_semi").withColumn("place", place)


def mapped_or_same(rows: DataFrame, mapping: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """Keys replaced by what they map to, others kept."""
    m = mapping.select(F.col(source).alias(key), F.col(target).alias("__to"))
    return rows.join(m, key, "left").withColumn(key, F.coalesce("__to", key)).drop("__to")


def cited_or_all(rows: DataFrame, group: str, cited: Column) -> DataFrame:
    """A group's cited rows, or all of them if none is cited."""
    w = Window.partitionBy(group)
    return rows.withColumn("__c", cited).withColumn("__any", F.max("__c").over(w)).where("__c or not __any").drop("__c", "__any")


def is_cited(url: Column, answer: Column) -> Column:
    """Whether an answer holds the URL, all words of its slug (two or more), or a slug word of three letters or more."""
    slug = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$|/+$", ""), "([^/]*)$", 1))
    words = F.filter(F.split(F.regexp_replace(slug, r"\.(php|html)$", ""), "[-_]"), lambda w: w != "")
    low = F.lower(answer)
    held = lambda w: F.contains(low, w)
    return F.contains(low, F.lower(url)) | ((F.size(words) >= 2) & F.forall(words, held)) | F.exists(words, lambda w: (F.length(w) >= 3) & held(w))


def forward_filled(rows: DataFrame, value: Column, name: str, by: str, order: list[str], default) -> DataFrame:
    """The last value given up to each row, or the default."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def islands(rows: DataFrame, starts: Column, by: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Number of starts up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(w))


def ranges(starts: DataFrame, by: str, at: str, end: Column | None = None) -> DataFrame:
    """Each start with the one after it, exclusive; the last with ``end``."""
    following = F.lead(at).over(Window.partitionBy(by).orderBy(at))
    return starts.withColumn("next_start", F.coalesce(following, end) if end is not None else following)


def last_messages(messages: DataFrame, n: int = 3, most_chars: int = 500) -> DataFrame:
    """The last n messages of each conversation; long assistant texts are cut."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    cut = F.when((F.col("role") == "assistant") & (F.length("text") > most_chars), F.left("text", F.lit(most_chars))).otherwise(F.col("text"))
    return messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n).withColumn("text", cut)


def valid_requests(messages: DataFrame, most: int = 20, most_chars: int = 100_000) -> DataFrame:
    """Conversations with 1 to ``most`` messages of allowed roles and lengths that end with the user."""
    ok = F.col("role").isin("user", "assistant") & F.length("text").between(1, most_chars)
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.coalesce(F.bool_and(ok) & (F.count("*") <= most) & (F.max_by("role", "turn") == "user"), F.lit(False)).alias("valid"),
    )


def paired(items: DataFrame, key: str, name: str, flag: str) -> DataFrame:
    """Each item with the first one of the opposite flag whose name is equal or contained, less a plural s.

    Distinct names meet on their first word, so the join is an equality and items of one name meet once.
    """
    bare = F.trim(F.regexp_replace(F.lower(name), r"\b(lab|laboratory|practical)s?\b|s\b", ""))
    one = items.select(key, name, flag, bare.alias("__name"))
    names = one.groupBy("__name", flag).agg(F.min(key).alias("pair")).withColumn("__word", F.substring_index("__name", " ", 1))
    other = names.select("pair", F.col(flag).alias("__flag"), F.col("__name").alias("__other"), "__word")
    a, b = F.col("__name"), F.col("__other")
    held = (a == b) | ((F.length(a) > 5) & F.contains(b, a)) | ((F.length(b) > 5) & F.contains(a, b))
    met = names.drop("pair").join(other, "__word").where((F.col(flag) != F.col("__flag")) & held)
    firsts = met.groupBy("__name", flag).agg(F.min("pair").alias("pair"))
    return one.join(firsts, ["__name", flag]).select(key, name, "pair")


def passages(docs: DataFrame, items: DataFrame, key: str, text: str, ikey: str, passage: str) -> DataFrame:
    """``ikey, key`` of documents that hold an item's passage of three words or more, letter for letter.

    An inner word of a passage is a whole word of what holds it, so documents and
    items meet on the passage's longest one; only ids and words are joined before
    the texts are looked at.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    inner = F.slice(words(F.col(passage)), 2, F.greatest(F.size(words(F.col(passage))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = items.select(ikey, F.col(passage).alias("__passage"), longest.alias("__word")).where("__word is not null")
    each = docs.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("__word"))
    met = each.join(asked, "__word").select(ikey, key, "__passage")
    return met.join(docs.select(key, F.col(text).alias("__text")), key).where(F.contains("__text", F.col("__passage"))).select(ikey, key).distinct()


def pivot_totals(rows: DataFrame, by: str, across: str, values: list, amount: Column) -> DataFrame:
    """Sums by row and column with a total column and a total row."""
    cells = [F.sum(F.when(F.col(across) == v, amount)).alias(f"{across}_{v}") for v in values]
    sums = rows.rollup(by).agg(*cells, F.sum(amount).alias("total"), F.grouping(by).alias("__all"))
    return sums.withColumn(by, F.when(F.col("__all") == 1, "Total").otherwise(F.col(by))).drop("__all")


def longest_contained(queries: DataFrame, names: DataFrame, qkey: str, text: str, key: str, name: str) -> DataFrame:
    """For each text the key of the longest name that it contains; of equally long ones the first.

    Names are looked up by their first word, so each text meets only names that start with one of its words.
    """
    words = queries.select(qkey, F.lower(text).alias("__text"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("__word"))
    given = names.select(key, F.lower(name).alias("__name"), F.regexp_extract(F.lower(name), r"([\p{L}\p{N}]+)", 1).alias("__word"))
    met = words.join(given, "__word").where(F.contains(F.col("__text"), F.col("__name")))
    return first_of(met.select(qkey, key, F.col("__name").alias("matched")), [qkey], [F.length("matched").desc(), F.col(key)])


def at_least(rows: DataFrame, by: list[str], n: int, distinct: str | None = None) -> DataFrame:
    """Groups of ``n`` rows or more, or of ``n`` different values, with their number."""
    count = F.count("*") if distinct is None else F.countDistinct(distinct)
    return rows.groupBy(*by).agg(count.alias("n")).where(F.col("n") >= n)


def tally(checked: DataFrame, passed: Column, *by: str) -> DataFrame:
    """How many rows pass, fail and are there, and the share that passes; a null check fails."""
    ok = F.coalesce(passed, F.lit(False))
    counts = [F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count("*").alias("n")]
    return checked.groupBy(*by).agg(*counts).withColumn("share", F.when(F.col("n") > 0, F.col("passed") / F.col("n")))
