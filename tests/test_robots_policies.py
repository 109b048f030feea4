"""Robots policies of many origins against their rules one by one."""

import random
import re
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from skeinlake.operators import robots


def origin(url):
    p = urlsplit(url)
    return p.scheme.lower(), (p.hostname or "").rstrip("."), p.port or (443 if p.scheme.lower() == "https" else 80)


def brute(url, held, rules):
    own = origin(url)
    if own not in held:
        return True
    if held[own]:
        return False
    p = urlsplit(url)
    target = (p.path or "/") + ("?" + p.query if p.query else "")
    best = None
    for allow, path in rules.get(own, []):
        if path:
            body = path[:-1] if path.endswith("$") else path
            pattern = ".*".join(map(re.escape, body.split("*"))) + (r"\Z" if path.endswith("$") else "")
            if re.match(pattern, target):
                weight = len(path.replace("*", "").replace("$", "")), allow
                best = weight if best is None or weight > best else best
    return True if best is None else best[1]


PATHS = ["/", "/a", "/a/", "/a/b", "/a*", "/*/b", "/*.pdf$", "/a/b$", "/q?x=", "*", "$", "/a.b", "/a*c$", "", "/\\E.x", "/ä", "/a$b", "/(", "/a/*/c", "/a/b/c/d/e"]
TARGETS = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/x/b", "/f.pdf", "/f.pdf?x=1", "/q?x=2", "/axb", "/a.b", "/\\E.x", "/\\Eyx", "/ä/", "/a$b", "/(", "/a/b/c/d/e/f", "/abc", "?x=1", "/a/b#top"]


def test_judge(spark):
    draw = random.Random(4)
    hosts = ["http://one.example", "https://one.example", "https://one.example:8443", "HTTPS://Two.Example.", "http://deny.example", "http://none.example", "http://unknown.example"]
    held = {origin(h): "deny" in h for h in hosts if "unknown" not in h}
    rules = {origin(h): [(draw.random() < 0.5, draw.choice(PATHS)) for _ in range(12)] for h in hosts if "none" not in h and "unknown" not in h}
    urls = [draw.choice(hosts) + draw.choice(TARGETS) for _ in range(500)] + [None, "", "nonsense", "mailto:a@b"]
    name = lambda o: f"{o[0]}://{o[1]}:{o[2]}"
    held_df = spark.createDataFrame([(name(o), d) for o, d in held.items()], "origin string, deny boolean")
    rules_df = spark.createDataFrame([(name(o), a, p) for o, rs in rules.items() for a, p in rs], "origin string, allow boolean, path string")
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "id long, url string")
    for salts in (1, 5):
        got = {r.id: r.allowed for r in robots.judge(pages, held_df, rules_df, salts=salts).collect()}
        assert got == {i: not x or "://" not in x or brute(x, held, rules) for i, x in enumerate(urls)}
    assert robots.judge(pages.limit(0), held_df, rules_df).count() == 0
    assert robots.judge(pages, held_df.limit(0), rules_df.limit(0)).where("not allowed").count() == 0


def test_parsed_bodies_and_answers(spark):
    """From robots.txt answers to verdicts, the way a crawl has them."""
    body = "User-agent: *\nDisallow: /private\nAllow: /private/public\n"
    answers = spark.createDataFrame([("http://a.example/robots.txt", 200, body), ("http://b.example/robots.txt", 503, ""), ("http://c.example/robots.txt", 404, ""), ("http://d.example/robots.txt", None, None)], "url string, status int, body string")
    held = robots.policies(answers)
    rules = robots.parse(answers.where("status = 200").select(robots.origin(F.col("url")).alias("origin"), "body"))
    pages = spark.createDataFrame([(h, p) for h in "abcde" for p in ("/private/x", "/private/public/x", "/")], "h string, p string").select(F.concat(F.lit("http://"), "h", F.lit(".example"), "p").alias("url"))
    blocked = {r.url for r in robots.judge(pages, held, rules).where("not allowed").collect()}
    assert blocked == {"http://a.example/private/x"} | {f"http://{h}.example{p}" for h in "bd" for p in ("/private/x", "/private/public/x", "/")}
