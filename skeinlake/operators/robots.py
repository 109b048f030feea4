"""robots.txt: groups, and the rule that decides a URL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as u


def pattern_of(rule: str) -> str:
    body = rule[:-1] if rule.endswith("$") else rule
    return "^" + ".*".join(re.escape(x) for x in body.split("*")) + ("$" if rule.endswith("$") else "")


def allows(url: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    """Of the rules (allow, pattern) that fit path and query the longest decides, allow among equals; none allows."""
    target = _target(url)
    fits = [F.when(target.rlike(pattern_of(p)), F.struct(F.lit(len(p.replace("*", "").replace("$", ""))).alias("n"), F.lit(a).alias("allow"))) for a, p in rules if p]
    if not fits:
        return F.lit(True)
    return F.coalesce(F.array_max(F.array_compact(F.array(*fits)))["allow"], F.lit(True))


def _target(url: Column) -> Column:
    """What rules are held against: path and query."""
    path = F.when(u.path(url) == "", "/").otherwise(u.path(url))
    return F.when(u.query(url) == "", path).otherwise(F.concat_ws("?", path, u.query(url)))


def origin(url: Column) -> Column:
    """scheme://host:port in one form, the port of the scheme where none is named; null where there is no scheme or host."""
    port = F.when(u.port(url) == "", F.when(u.scheme(url) == "https", "443").otherwise("80")).otherwise(u.port(url))
    host = F.regexp_replace(u.host(url), r"\.+$", "")
    return F.when((u.scheme(url) != "") & (host != ""), F.concat(u.scheme(url), F.lit("://"), host, F.lit(":"), port))


def policies(responses: DataFrame) -> DataFrame:
    """(origin, deny): what a robots.txt response (url, status, truncated) means for its origin. Refused, failing, redirecting or broken answers deny all, a whole one of 200 gives its rules, others none."""
    status = F.col("status")
    deny = status.isNull() | status.isin(401, 403, 429) | (status >= 500) | ((status >= 300) & (status < 400))
    return responses.select(origin(F.col("url")).alias("origin"), deny.alias("deny")).where("origin is not null").groupBy("origin").agg(F.bool_or("deny").alias("deny"))


def compiled(rules: DataFrame) -> DataFrame:
    """rules (origin, allow, path) with what they start with literally, the pattern of those that have more, and their weight; one row for equal rules."""
    path = F.col("path")
    ends = F.endswith(path, F.lit("$"))
    body = F.when(ends, F.expr("substring(path, 1, length(path) - 1)")).otherwise(path)
    quoted = F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    pattern = F.concat(F.lit("^\\Q"), quoted, F.lit("\\E"), F.when(ends, "\\z").otherwise(""))
    return rules.where("path <> ''").select(
        "origin", "allow", F.substring_index(body, "*", 1).alias("prefix"), F.when(ends | F.contains(body, F.lit("*")), pattern).alias("pattern"), F.length(F.translate(path, "*$", "")).alias("n")
    ).distinct()


def judge(pages: DataFrame, held: DataFrame, rules: DataFrame, url: str = "url", salts: int = 16) -> DataFrame:
    """pages and allowed: whether the policy of a URL's own origin lets it be fetched.

    held (origin, deny) has the known origins, rules (origin, allow, path) their rules. An origin that isn't known allows all, one that
    denies blocks all; else the longest rule that fits decides, allow among equals, and none allows. A URL without origin is allowed.

    URLs meet an origin's rules by what those start with: an origin lists the lengths of its rules' literal starts (a few tens at
    most, whatever the number of rules), a URL asks for its own start of each length, and only patterns with more than a start are matched. Each URL
    is asked once, on `salts` copies of the rules, so an origin that a third of all pages have is spread over as many tasks.
    """
    own = compiled(rules)
    site = held.select("origin", "deny").join(own.groupBy("origin").agg(F.array_distinct(F.collect_set(F.length("prefix"))).alias("lengths")), "origin", "left")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    keyed = pages.withColumn("_origin", origin(F.col(url))).withColumn("_target", _target(F.col(url)))
    asked = keyed.where("_origin is not null").select("_origin", "_target").distinct().withColumn("_salt", F.pmod(F.xxhash64("_target"), F.lit(salts)).cast("int"))
    known = asked.join(site.select(F.col("origin").alias("_origin"), "deny", "lengths", spread), ["_origin", "_salt"])
    starts = known.where("not deny").select("_origin", "_salt", "_target", F.explode("lengths").alias("_l")).where("_l <= length(_target)").withColumn("_start", F.expr("substring(_target, 1, _l)"))
    copies = own.select(F.col("origin").alias("_origin"), F.col("prefix").alias("_start"), "pattern", "n", "allow", spread)
    fits = starts.join(copies, ["_origin", "_salt", "_start"]).where(F.col("pattern").isNull() | F.rlike("_target", F.col("pattern")))
    best = fits.groupBy("_origin", "_target").agg(F.max(F.struct("n", "allow")).alias("b")).select("_origin", "_target", F.col("b.allow").alias("_allow"))
    told = known.join(best, ["_origin", "_target"], "left").select("_origin", "_target", "_salt", (~F.col("deny") & F.coalesce("_allow", F.lit(True))).alias("_told"))
    out = keyed.withColumn("_salt", F.pmod(F.xxhash64("_target"), F.lit(salts)).cast("int")).join(told, ["_origin", "_target", "_salt"], "left")
    return out.select(*pages.columns, F.coalesce("_told", F.lit(True)).alias("allowed"))


def parse(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(origin, ord, allow, path) of the rules that hold for agent, from robots (origin, body).

    Lines become rows; a user-agent line after a rule opens a group, found by a running count as in sessionisation. The groups with the
    longest agent name that agent contains hold, else those of *.
    """
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("ord", "raw")).select("origin", "ord", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("line")).where("instr(line, ':') > 0")
    keyed = lines.select("origin", "ord", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).where("key in ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("origin").orderBy("ord")
    opened = keyed.withColumn("new", ((F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("none")) != "user-agent")).cast("int"))
    grouped = opened.withColumn("grp", F.sum("new").over(w)).where("grp > 0")
    own = F.lit(agent.strip().lower())
    name = F.lower("value")
    weight = F.when(F.col("key") == "user-agent", F.when((name != "*") & F.contains(own, name), F.length(name)).when(name == "*", 0).otherwise(-1))
    scored = grouped.groupBy("origin", "grp").agg(F.max(weight).alias("weight"))
    best = scored.where("weight >= 0").groupBy("origin").agg(F.max("weight").alias("best"))
    held = scored.join(best, "origin").where("weight = best").select("origin", "grp")
    return grouped.where("key <> 'user-agent' and value <> ''").join(held, ["origin", "grp"]).select("origin", "ord", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))
