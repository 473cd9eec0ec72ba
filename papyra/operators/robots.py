"""Which pages a crawl may read, and in what order: exclusion rules of hosts, limits and delays.

Rules follow the public robots exclusion protocol (RFC 9309): a group of rules is
for the agents named above it, the group of the named agent counts, else that of
``*``; of the rules that match a path the longest wins, and allowing wins a tie;
``*`` stands for any characters and ``$`` for the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Rules up to this many rows may be broadcast.
BROADCAST_ROWS = 100_000
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def url_path(url: Column) -> Column:
    """Path and query of a URL, the root for none."""
    found = F.regexp_extract(url, _PATH, 1)
    return F.when(found.startswith("/"), found).otherwise(F.concat(F.lit("/"), found))


def rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """``host, allow, path`` and ``host``'s ``delay`` of rows ``host, text``: the rules that hold for an agent.

    A host without rules for the agent or for all has none. Comments, blank
    lines, rules without a path and lines that cannot be read are ignored; a
    delay that is no number is null.
    """
    line = F.trim(F.regexp_replace("line", "#.*$", ""), F.lit(" \t\r"))
    lines = robots.select("host", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("line", line)
    field, value = F.lower(F.trim(F.regexp_extract("line", "^([A-Za-z-]+)\\s*:", 1))), F.trim(F.regexp_extract("line", "^[A-Za-z-]+\\s*:(.*)$", 1))
    said = lines.select("host", "i", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    # A group begins at a line of an agent that follows no other line of one.
    order = Window.partitionBy("host").orderBy("i")
    starts = (F.col("field") == "user-agent") & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    grouped = said.withColumn("starts", starts).withColumn("group", F.sum(F.col("starts").cast("int")).over(order)).where("group > 0")
    agents = grouped.where("field = 'user-agent'").select("host", "group", F.lower("value").alias("agent")).where(F.col("agent").isin("*", agent.lower()))
    best = agents.withColumn("own", F.max(F.col("agent") != "*").over(Window.partitionBy("host"))).where((F.col("agent") != "*") == F.col("own"))
    held = grouped.where("field <> 'user-agent'").join(best.select("host", "group").distinct(), ["host", "group"])
    delay = F.max(F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))).over(Window.partitionBy("host"))
    found = held.withColumn("delay", delay).where("field <> 'crawl-delay' and value <> ''")
    return found.select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), "delay").distinct()


def allowed(pages: DataFrame, held: DataFrame, url: str = "url", name: str = "allowed") -> DataFrame:
    """``pages`` with whether their host's rules allow them; each URL is judged once.

    A rule is met by its beginning, the part before the first ``*`` or ``$``. The
    lengths of a host's beginnings are few, so a URL gives a row for each of them
    that it has, and these are joined to the rules.
    """
    head = F.regexp_extract("path", r"^([^*$]*)", 1)
    own = held.select("host", "allow", "path", head.alias("head"))
    sizes = own.groupBy("host").agg(F.collect_set(F.length("head")).alias("sizes"))
    n = held.count()
    small = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df
    asked = pages.select(F.col(url).alias("__url")).distinct().select("__url", urls.host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("p"))
    begun = asked.join(small(sizes), "host").select("__url", "host", "p", F.explode(F.filter("sizes", lambda s: s <= F.length("p"))).alias("size"))
    begun = begun.withColumn("head", F.left("p", F.col("size")))
    # What stands in a rule is taken as it is, but for its two signs.
    escaped = F.regexp_replace("path", r"([\\.\[\]{}()+?^|/-])", r"\\$1")
    form = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*+", ".*"), r"\$(?!$)", r"\\\$"))
    met = begun.join(small(own), ["host", "head"]).where(F.regexp_like("p", form))
    best = met.groupBy("__url").agg(F.max(F.struct(F.length("path").alias("n"), "allow")).alias("best"))
    refused = best.where("not best.allow").select("__url", F.lit(False).alias("__ok"))
    return pages.join(refused, pages[url] == refused["__url"], "left").withColumn(name, F.coalesce("__ok", F.lit(True))).drop("__ok", "__url")


def crawl_order(pages: DataFrame, most: int, delay: float | Column = 1.0, url: str = "url", order: tuple[str, ...] = ("depth",)) -> DataFrame:
    """The first ``most`` pages of each host with their ``place`` and the seconds ``at`` which they are read."""
    by_host = Window.partitionBy("__host").orderBy(*order, url)
    placed = pages.withColumn("__host", urls.host(F.col(url))).withColumn("place", F.row_number().over(by_host)).where(F.col("place") <= most)
    wait = F.lit(delay) if isinstance(delay, float) else delay
    return placed.withColumn("at", (F.col("place") - 1) * F.coalesce(wait, F.lit(1.0))).drop("__host")
