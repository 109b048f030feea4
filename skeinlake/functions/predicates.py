"""Filters over URLs, texts and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as u

#: Fixed values.
FILE_EXTENSIONS = ("pdf", "txt", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z", "tar", "gz", "bz2", "exe", "msi", "iso", "img", "sql", "db", "bak", "old", "log", "csv")
PLACEHOLDERS = (
    "xxx", "example", "changeme", "change_me", "your_", "your-", "placeholder", "dummy", "sample", "todo", "fixme", "insert", "replace", "enter_", "enter-", "senha_aqui", "sua_senha", "sua-senha",
    "test123", "123456", "password123", "secret_here", "api_key_here", "apikey_here", "0000000000", "1111111111", "abcdefgh", "qwerty", "asdfgh", "null", "undefined", "none", "n/a",
)
SPA_MARKERS = ("id=\"root\"", "id='root'", "id=\"__next\"", "id='__next'", "id=\"__nuxt\"", "id='__nuxt'", "<app-root", "data-reactroot", "ng-version=", "__next_data__")
#: First and last IPv4 address of ranges that aren't reached.
BLOCKED_NETS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4",
)


def contains_any(text: Column, marks: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def is_file_url(url: Column) -> Column:
    return F.lower(u.path(url)).rlike(rf"\.({'|'.join(FILE_EXTENSIONS)})$")


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"), number)


def cidr_bounds(net: str) -> tuple[int, int]:
    import ipaddress

    n = ipaddress.ip_network(net)
    return int(n[0]), int(n[-1])


def in_networks(ip: Column, nets: Sequence[str]) -> Column:
    number = ipv4_number(ip)
    out = F.lit(False)
    for net in nets:
        lo, hi = cidr_bounds(net)
        out = out | number.between(lo, hi)
    return out


def is_placeholder(value: Column) -> Column:
    low = F.lower(value)
    return contains_any(low, PLACEHOLDERS) | (F.size(F.array_distinct(F.split(low, ""))) <= 2)


def looks_like_xml(url: Column, content: Column) -> Column:
    sample = F.regexp_replace(F.substring(F.coalesce(content, F.lit("")), 1, 2000), r"^[﻿ \t\r\n]+", "")
    return F.lower(u.path(url)).rlike(r"\.(xml|rss|atom)$") | sample.startswith("<?xml") | sample.rlike(r"(?i)^<(urlset|sitemapindex|rss|feed)\b")


def looks_like_spa(html: Column) -> Column:
    """Shell markers, or a container named app with little visible text; never for very long pages."""
    low = F.lower(html)
    visible = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"(?s)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"<[^>]+>", " "), r"\s+", " "))
    app = F.contains(low, F.lit('id="app"')) | F.contains(low, F.lit("id='app'"))
    return F.coalesce((F.length(html) < 200_000) & (contains_any(low, SPA_MARKERS) | (app & (F.length(visible) <= 160))), F.lit(False))


def is_soft_fail(body: Column, baseline_hash: Column, baseline_length: Column) -> Column:
    """Equal to the site's not-found page, or within 3 % of its length."""
    near = (baseline_length > 0) & (F.abs(F.length(body) - baseline_length) / baseline_length <= 0.03)
    return F.coalesce((F.length(body) > 0) & ((F.sha2(body, 256) == baseline_hash) | near), F.lit(False))


def has_response_delta(status: Column, length: Column, base_status: Column, base_length: Column) -> Column:
    return (status != base_status) | (F.abs(length - base_length) > F.greatest(F.lit(100), F.floor(base_length * 0.20)))


def matches_category(category: str, event: Column, others: Sequence[Column] = ()) -> Column:
    """The events that a category word asks for: aliases by prefix, other words anywhere; an empty word asks for all."""
    wanted = category.strip().lower()
    event = F.lower(F.coalesce(event, F.lit("")))
    said = F.lit(False)
    for c in others:
        said = said | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(wanted))
    if not wanted:
        return F.lit(True)
    if wanted in ("scanner", "vulnerability", "vulnerabilities"):
        return event.startswith("vulnerability.") | (event == "surface.hint") | said
    if wanted in ("dork", "dorks", "search", "busca"):
        return event.startswith("search.") | said
    if wanted in ("api", "apis", "integration", "integrations"):
        return (event == "integration.status") | said
    if wanted in ("crawl", "crawler"):
        return event.startswith("crawl.") | event.startswith("javascript.") | said
    return F.contains(event, F.lit(wanted)) | said
