"""URL allow and block rules whose block decisions spread over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .common import materialize
from .components import connected_components

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Among equally long ones allow wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "sol": "/", "colon": ":", "quest": "?", "equals": "=", "num": "#", "period": ".", "percnt": "%", "lowbar": "_", "plus": "+", "comma": ",", "semi": ";"}
_ENTITY = r"(?i)&(?:#x[0-9a-f]+;?|#[0-9]+;?|(?:amp|lt|gt|quot)(?:;|(?![a-z0-9=;]))|(?:" + "|".join(_NAMED) + r");)"


def decode_references(c: Column) -> Column:
    """Text with its character references decoded once: numbers, and the names that URLs are written with. A named one without ; before = or a letter stays, as in attributes."""
    found = F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0))
    between = F.split(c, _ENTITY, -1)

    def one(ref: Column) -> Column:
        name = F.lower(F.regexp_replace(ref, "^&|;$", ""))
        code = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 20), 16, 10)).otherwise(F.substring(name, 2, 20)).try_cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # UTF-32 of the code point; CHAR() knows Latin-1 only
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(name.startswith("#"), F.when(valid, char).otherwise(F.lit("\ufffd")))
        for n, v in _NAMED.items():
            out = out.when(name == n, F.lit(v))
        return out.otherwise(ref)

    pairs = F.arrays_zip(between.alias("between"), F.transform(found, one).alias("ref"))
    decoded = F.array_join(F.transform(pairs, lambda x: F.concat(x["between"], F.coalesce(x["ref"], F.lit("")))), "")
    return F.when(F.instr(c, "&") > 0, decoded).otherwise(c)


def _no_dots(path: Column) -> Column:
    """remove_dot_segments of RFC 3986, 5.2.4, for paths that start with /."""
    segments = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments, empty,
        lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^//$", "/")


def resolve(base: Column, target: Column) -> Column:
    """The URL that target means on a page at base, without fragment: RFC 3986, 5.2.2. Absolute ones stay as they are."""
    tail = F.regexp_extract(target, r"(?s)(\?[^#]*)", 1)
    own = urls.path(target)
    site = F.concat(urls.part(base, 1), urls.part(base, 3))
    folder = F.when((urls.path(base) == "") & (urls.authority(base) != ""), F.lit("/")).otherwise(F.regexp_replace(urls.path(base), "[^/]*$", ""))
    joined = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(urls.part(base, 1), target))
        .when(target.startswith("/"), F.concat(site, _no_dots(own), tail))
        .when(own != "", F.concat(site, _no_dots(F.concat(folder, own)), tail))
        .when(tail != "", F.concat(site, urls.path(base), tail))
        .otherwise(base)
    )
    return without_fragment(joined)


def _value(name: str) -> str:
    return rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*))"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, references decoded, white space around it cut; empty without it."""
    found = F.concat(*[F.regexp_extract(tag, _value(name), i) for i in (1, 2, 3)])
    return F.regexp_replace(decode_references(found), r"^[\s\x00]+|[\s\x00]+$", "")


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) of the redirects and canonical links that pages state: every link rel=canonical and meta refresh.

    Values may have either quotes or none, and character references; relative targets are resolved against the page's URL.
    """
    tags = F.regexp_extract_all("html", F.lit(r"""(?is)<(?:link|meta)\b(?:"[^"]*"|'[^']*'|[^"'>])*+>"""), F.lit(0))
    tags = F.filter(tags, lambda t: t.rlike("(?i)canonical|refresh"))
    found = pages.where("url is not null and html is not null").select(without_fragment(F.col("url")).alias("source"), F.explode(tags).alias("tag"))
    is_link = F.col("tag").rlike(r"(?i)^<link\b")
    canonical = F.when(F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    content = _attribute(F.col("tag"), "content")
    at = r"""(?is)^[^;,]*[;,\s]\s*url\s*=\s*(?:"([^"]*)|'([^']*)|([^"'].*))"""
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.trim(F.concat(*[F.regexp_extract(content, at, i) for i in (1, 2, 3)])))
    links = found.select("source", F.when(is_link, canonical).otherwise(refresh).alias("t")).where("t <> ''")
    return links.select("source", resolve(F.col("source"), F.col("t")).alias("target")).where("source <> target and instr(target, '://') > 0")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, group) of each row of pages (page_id, url, html).

    A URL with a rule has the rule's verdict, allow as well as block: that is the explicit precedence.
    The others look at their equivalents, the URLs that redirects (redirects: source, target) and canonical links
    connect, fragments aside: if a rule blocks one of them the URL is blocked, unless a rule
    explicitly allows one of them. With no such word it is allowed. group is the least URL of the class,
    null for a URL without links.

    Links are distinct before the components are found, and only linked URLs are in their tables; the
    rows of pages meet them in one join that Spark may split. A null url, or one without ://, has an empty host
    and path, no rule and verdict allow. Null html: no links. Repeated rows are judged each; an
    empty table gives no rows; other columns are ignored.
    """
    slim = pages.select("page_id", "url", "html")
    links = page_links(slim)
    if redirects is not None:
        links = links.unionByName(redirects.select(without_fragment(F.col("source")).alias("source"), without_fragment(F.col("target")).alias("target")).where("source <> target"))
    links = materialize(links.distinct(), "links")
    seen = slim.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = seen.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    if links.isEmpty():
        return seen.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("group"))
    classes = materialize(connected_components(links, "source", "target"), "classes")
    ruled = classes.withColumn("r", matching_rule(url_host(F.col("node")), url_path(F.col("node")), rules))
    words = ruled.groupBy("component").agg(F.max(F.col("r.verdict") == "block").alias("blocked"), F.max(F.col("r.verdict") == "allow").alias("allowed"))
    spread = words.select("component", F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow").alias("spread"))
    of = classes.join(spread, "component").select(F.col("node").alias("alias"), F.col("component").alias("group"), "spread")
    return seen.join(of, without_fragment(seen["url"]) == of["alias"], "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "spread", F.lit("allow")).alias("verdict"), "group"
    )
