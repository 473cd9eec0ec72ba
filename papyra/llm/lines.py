"""Line dedup by a deletion-neighbourhood join (native).

A line is a text between line feeds, compared as its sequence of words; its edit
distance to another line counts inserted, deleted and replaced words. Two lines
are copies if their words are equal, and near copies if the distance is 1 and
the longer has MIN_WORDS words or more (a similarity of 0.8 or more). A line
is removed if an equal or near line occurs earlier, by doc_id and then by
place; this is judged on the input, not on what is left.

Near lines share a variant: the line as it is, or less one word. Emitting all
variants of all lines would write the text many times over, so a key join comes
first: a line of n words is cut at the halves of N = n and N = n + 1, and for
each quarter the rest of the line is a key. One edit lies in one half, so near
lines share a key, and only lines that share one emit variants, within that
half alone. A variant's hash is an exclusive or of word hashes tagged with
their place from the left or from the right, taken from running windows, so a
long line costs no more a word than a short one. Lines that share a variant with
an earlier line are verified on their words.

Defined results: null texts count as empty; a line without a word is never
removed; lines that repeat within a document, and documents that repeat under
other ids, lose all but the earliest line; rows that repeat a doc_id count as
that one document and get equal results; rows without a doc_id count as one, the
earliest, document; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

MIN_WORDS = 5
PARTS = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _words(line: Column) -> Column:
    plain = F.when(line.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(line, r"[\x09\x0B-\x0D]", " ")).otherwise(line)
    return F.filter(F.split(plain, " ", -1), lambda word: word != "")


def _cut(n: Column, part: int) -> Column:
    return F.floor(n * part / PARTS).cast("int")


def _part_key(words: Column, n: Column, more: int, part: int) -> Column:
    """Hash of what lies outside a half of a line of n words, cut as one of n + more."""
    full = n + more
    before, after = _cut(full, part), full - _cut(full, part + 1)
    key = F.xxhash64(full, F.lit(part), F.slice(words, F.lit(1), before), F.slice(words, n - after + 1, after))
    return F.when(full >= MIN_WORDS, key)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """One row per distinct line with words: its hashes, length, earliest place and part keys."""
    # Words are split once, inside the generator, and only their hashes leave it.
    hashed = F.transform(_lines(F.col("text")), lambda line: F.transform(_words(line), lambda word: F.xxhash64(word)))
    occurrences = docs.select("doc_id", F.posexplode(hashed).alias("pos", "words")).withColumn("n", F.size("words")).where("n > 0")
    names = [(more, part) for more in (0, 1) for part in range(PARTS)]
    keyed = occurrences.select(
        F.xxhash64("words").alias("h"),
        F.xxhash64(F.lit(1), "words").alias("h2"),
        "n", F.struct("doc_id", "pos").alias("place"),
        *[_part_key(F.col("words"), F.col("n"), more, part).alias(f"k{more}{part}") for more, part in names],
    )
    return keyed.groupBy("h", "h2").agg(
        F.min("place").alias("place"), F.first("n").alias("n"), *[F.first(f"k{more}{part}").alias(f"k{more}{part}") for more, part in names]
    )


def _sharing(lines: DataFrame) -> DataFrame:
    """Lines and halves that share a part key with another line."""
    parts = F.array(
        *[
            F.struct(F.lit(more).cast("byte").alias("more"), F.lit(part).cast("byte").alias("part"), F.col(f"k{more}{part}").alias("key"))
            for more in (0, 1)
            for part in range(PARTS)
        ]
    )
    keys = lines.select("h", F.explode(parts).alias("p")).select("h", "p.*").where("key is not null")
    # Two rows of more = 1 alone are lines of equal length that would also meet at more = 0.
    often = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("more").alias("least")).where("c > 1 and least = 0").select("key")
    shared = keys.join(often, "key").groupBy("h").agg(F.collect_set(F.struct("key", "more", "part")).alias("shared"))
    return lines.select("h", "h2", "n", "place").join(shared, "h")


def _with_words(docs: DataFrame, at: DataFrame) -> DataFrame:
    """Add the words of the lines at ``place``."""
    wanted = at.select(F.col("place.doc_id").alias("__doc"), F.struct("place.pos", "h", "h2", "n", "shared").alias("w"))
    wanted = wanted.groupBy("__doc").agg(F.collect_list("w").alias("ws"))
    texts = docs.select("doc_id", "text").where("text is not null")
    found = wanted.join(texts, F.col("__doc").eqNullSafe(F.col("doc_id"))).select("doc_id", _lines(F.col("text")).alias("lines"), F.explode("ws").alias("w"))
    return found.select(
        "w.h", "w.h2", "w.n", "w.shared", F.struct("doc_id", "w.pos").alias("place"),
        _words(F.element_at("lines", F.col("w.pos") + 1)).alias("words"),
    )


def _variants(lines: DataFrame) -> DataFrame:
    """Hashed variants of the shared halves: less the word at ``i``, or whole with a gap at ``i``."""
    each = lines.select("h", "place", "n", "words", F.explode("shared").alias("s")).select("h", "place", "n", "words", "s.*")
    full = F.col("n") + F.col("more")
    start = F.floor(full * F.col("part") / PARTS).cast("int")
    stop = F.floor(full * (F.col("part") + 1) / PARTS).cast("int") - F.col("more")
    size = stop - start
    # A whole half has a gap after its last word too, where a null stands.
    segment = F.concat(F.slice("words", start + 1, size), F.when(F.col("more") == 1, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    each = each.select("h", "place", "key", "more", size.alias("m"), F.posexplode(segment).alias("i", "word"))
    left = F.coalesce(F.xxhash64("word", "i"), F.lit(0))
    right = F.coalesce(F.xxhash64("word", F.col("m") - F.col("i"), F.lit("r")), F.lit(0))
    each = each.withColumn("l", F.when(F.col("word").isNotNull(), left).otherwise(F.lit(0))).withColumn("r", F.when(F.col("word").isNotNull(), right).otherwise(F.lit(0)))
    line = Window.partitionBy("h", "key")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    each = (
        each.withColumn("left", F.coalesce(F.bit_xor("l").over(before), zero))
        .withColumn("right", F.coalesce(F.bit_xor("r").over(before), zero))
        .withColumn("all_right", F.bit_xor("r").over(line))
    )
    right_of = F.col("all_right").bitwiseXOR(F.col("right"))
    right_of = F.when(F.col("more") == 1, right_of).otherwise(right_of.bitwiseXOR(F.col("r")))
    return each.select("h", "place", F.xxhash64("key", "i", "left", right_of).alias("variant"))


def _within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one inserted, deleted or replaced word at most."""
    n, m = F.size(a), F.size(b)
    shorter = F.least(n, m)
    same_left = F.coalesce(
        F.array_position(F.transform(F.sequence(F.lit(1), shorter + 1), lambda i: F.when(i <= shorter, F.element_at(a, i) == F.element_at(b, i)).otherwise(F.lit(False))), F.lit(False)) - 1,
        F.lit(0),
    ).cast("int")
    rest_a, rest_b = n - same_left, m - same_left
    tail = F.greatest(rest_a, rest_b) - 1
    equal_tail = F.slice(a, n - tail + 1, F.greatest(tail, F.lit(0))) == F.slice(b, m - tail + 1, F.greatest(tail, F.lit(0)))
    return (F.abs(n - m) <= 1) & ((F.greatest(rest_a, rest_b) == 0) | ((F.least(rest_a, rest_b) >= tail) & equal_tail))


def near_copies(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Hashes ``(h, h2)`` of the lines that have a near line which occurs earlier."""
    candidates = staged(_with_words(docs, _sharing(lines)), "near_lines")
    variants = _variants(candidates)
    groups = variants.groupBy("variant").agg(F.min(F.struct("place", "h")).alias("first"), F.count("*").alias("c")).where("c > 1")
    pairs = (
        variants.join(groups.select("variant", "first"), "variant")
        .where("h <> first.h")
        .groupBy("h", F.col("first.h").alias("first_h"))
        .agg(F.lit(1).alias("one"))
    )
    words = candidates.select("h", "h2", "words")
    other = candidates.select(F.col("h").alias("first_h"), F.col("words").alias("first_words"))
    checked = pairs.join(words, "h").join(other, "first_h").where(_within_one(F.col("words"), F.col("first_words")))
    return checked.select("h", "h2").distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_removed`` (lines with words)."""
    lines = staged(distinct_lines(docs), "lines")
    near = near_copies(docs, lines)
    kept = lines.join(near, ["h", "h2"], "left_anti").groupBy(F.col("place.doc_id").alias("__doc")).agg(F.sort_array(F.collect_list("place.pos")).alias("at"))
    # One character a line up to the last kept one: 1 for kept. Places in binary are found at once.
    flags = F.array_join(
        F.transform(F.col("at"), lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.get(F.col("at"), i - 1)).otherwise(F.lit(-1)) - 1), F.lit("1"))),
        "",
    )
    kept = kept.select("__doc", flags.cast("binary").alias("__flags"))
    has_word = lambda line: line.rlike(WORD)
    one = F.lit("1").cast("binary")
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__doc"]), "left").withColumn("__lines", _lines(F.col("text")))
    joined = joined.withColumn(
        "__kept", F.filter("__lines", lambda line, i: (F.substring(F.coalesce(F.col("__flags"), F.lit("").cast("binary")), i + 1, F.lit(1)) == one) | ~has_word(line))
    )
    n_lines = F.size(F.filter("__lines", has_word)).cast("long")
    n_removed = (F.size("__lines") - F.size("__kept")).cast("long")
    return joined.select(*[docs[c] for c in docs.columns], F.array_join("__kept", "\n").alias("kept_text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
