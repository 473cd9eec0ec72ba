"""Robots rules, URL resolution and link closure against brute force."""

import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from papyra.functions import urls
from papyra.operators import robots, sections

ROBOTS = """# comment
User-agent: first
User-agent: Papyra  # ours
Disallow: /private/
Allow: /private/open
Disallow: /*.cgi$
Disallow: /a*b/c
Disallow:
Crawl-delay: 4
nonsense
User-agent: *
Disallow: /
User-agent: second
Allow: /x
"""


def brute_rules(text, agent):
    groups, last = [], None
    for line in text.split("\n"):
        m = re.match(r"([A-Za-z-]+)\s*:(.*)$", line.split("#")[0].strip())
        if not m or m.group(1).lower() not in ("user-agent", "allow", "disallow", "crawl-delay"):
            continue
        name, value = m.group(1).lower(), m.group(2).strip()
        if name == "user-agent":
            if last != "user-agent":
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
        elif groups and name != "crawl-delay" and value:
            groups[-1][1].append((name == "allow", value))
        last = name
    wanted = agent.lower() if any(agent.lower() in names for names, _ in groups) else "*"
    return [r for names, own in groups if wanted in names for r in own]


def brute_allowed(path, rules):
    best = (0, True)
    for allow, rule in rules:
        form = "".join(".*" if c == "*" else "$" if c == "$" and i == len(rule) - 1 else re.escape(c) for i, c in enumerate(rule))
        if re.match(form, path):
            best = max(best, (len(rule), allow))
    return best[1]


def test_rules_match_brute_force(spark):
    rng = random.Random(2)
    path = lambda: "/" + "".join(rng.choice("ab/.*$?(") for _ in range(rng.randint(0, 5)))
    texts = {"h.example": ROBOTS, "none.example": "Allow: /x\nDisallow: /y", "empty.example": ""}
    for i in range(25):
        texts[f"r{i}.example"] = "\n".join(["User-agent: *"] + [rng.choice(["Allow", "Disallow"]) + ": " + path() for _ in range(6)])
    asked = [f"https://h.example{p}" for p in ("", "/", "/private/", "/private/open/1", "/private/opens", "/x.cgi", "/x.cgi?y", "/aXXb/c", "/ab/cd", "/b", "/private/#open")]
    asked += [f"http://user@{h.upper()}:80{path().replace('*', 'a').replace('$', 'b')}" for h in texts for _ in range(12)] + ["https://unknown.example/private/", asked[3]]
    held = robots.rules(spark.createDataFrame(list(texts.items()), "host string, text string"), "papyra")
    pages = spark.createDataFrame(list(enumerate(asked)), "n int, url string")
    got = {r["n"]: r["allowed"] for r in robots.allowed(pages, held).collect()}
    for n, url in enumerate(asked):
        host = re.match(r"\w+://(?:[^/@]*@)?([^/:]*)", url).group(1).lower()
        found = re.match(r"\w+://[^/?#]*([^#]*)", url).group(1)
        assert got[n] == brute_allowed(found if found.startswith("/") else "/" + found, brute_rules(texts.get(host, ""), "papyra")), url
    assert {r["delay"] for r in held.where("host = 'h.example'").collect()} == {4.0}


def test_crawl_order(spark):
    pages = spark.createDataFrame([("http://a.x/2", 1), ("http://a.x/1", 1), ("http://a.x/0", 2), ("http://b.x/", 0)], "url string, depth int")
    got = sorted((r["url"], r["place"], r["at"]) for r in robots.crawl_order(pages, 2, 0.5).collect())
    assert got == [("http://a.x/1", 1, 0.0), ("http://a.x/2", 2, 0.5), ("http://b.x/", 1, 0.0)]


def test_resolution_matches_a_table_of_cases(spark):
    base = "http://a/b/c/d;p?q"
    links = "g ./g g/ /g ?y g?y ;x g;x g;x?y . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x http:g//x //g".split()
    cases = [(base, x) for x in links if x != "http:g//x"] + [("http://h", "x/../y"), ("http://h/a/", "..//z"), ("https://h/a/b?x=/../y", "c"), (base, "https://o/../p"), (base, "")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, base string, link string")
    got = {r["n"]: r["u"] for r in rows.select("n", urls.resolved(F.col("link"), F.col("base")).alias("u")).collect()}
    for i, (b, x) in enumerate(cases):
        # The standard library drops empty parts, which the RFC keeps.
        want = {"https://o/../p": x, "..//z": "http://h//z"}.get(x, urljoin(b, x))
        assert got[i] == want, (b, x)


def test_closure_ends_where_nothing_is_new(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(0, 1), (1, 0), (5, 5), (3, None)]
    want, frontier = {0: 0, 5: 0}, {0, 5}
    for depth in range(1, 30):
        frontier = {b for a, b in edges if a in frontier and b is not None} - want.keys()
        want |= dict.fromkeys(frontier, depth)
    df = spark.createDataFrame(edges, "src int, dst int")
    seeds = spark.createDataFrame([(0,), (5,), (0,), (None,)], "url int")
    found = sections.link_closure(df, seeds, 50)
    assert {r["url"]: r["depth"] for r in found.collect()} == want
    assert {r["url"] for r in sections.link_closure(df, seeds, 1).collect()} == {u for u, d in want.items() if d <= 1}
    assert len(sections.link_closure(df, seeds, 50, most=3).collect()) == 3
    plan = lambda depth: len(sections.link_closure(df, seeds, depth)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert plan(1) == plan(4)
