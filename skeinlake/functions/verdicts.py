"""Verdicts on captured answers, names and texts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Fixed values.
DNS_LABEL = "[a-z0-9]([a-z0-9-]*[a-z0-9])?"
NO_DNS = r"[/\\@?#:]"
IPV4 = r"[0-9]{1,3}(\.[0-9]{1,3}){3}"
GREP_ALLOWED = r"[a-zA-Z0-9.\-_*?|^$\s\[\](){}+\\]+"
GREP_FORBIDDEN = r"\$\(|\|\||[\n\r]"
LOG_PARTS = ("_wordlist", "_endpoints", "_dorks_", "_nmap_", "_report.", "_findings.csv")
STAGES = ("POSSIBLE", "PROBABLE", "CONFIRMED")
SAFE_METHODS = ("GET", "HEAD")
SECRET = r"(?i)(authorization|cookie|set-cookie|api[-_]?key|token|password|secret)\s*[:=]\s*[^\s,;]+"
QUERY_LENGTH = 8


def dns_name(name: Column) -> Column:
    """A host name in lower case without trailing dots; null where a label is malformed, longer than 63, or the whole than 253. Names must be ASCII (IDNA form)."""
    bare = F.lower(F.rtrim(F.trim(name), F.lit(".")))
    labels = F.split(bare, r"\.")
    right = ~bare.rlike(NO_DNS) & (F.length(bare) <= 253) & F.forall(labels, lambda x: x.rlike(f"^{DNS_LABEL}$") & (F.length(x) <= 63))
    return F.when(right, bare)


def dns_domain(name: Column) -> Column:
    """dns_name(), but null for what is an IPv4 address."""
    found = dns_name(name)
    octets = F.forall(F.split(found, r"\."), lambda x: x.cast("int") < 256)
    return F.when(~(found.rlike(f"^{IPV4}$") & octets), found)


def scope_url(url: Column) -> Column:
    """A URL as scope rules read it: ws as http, wss as https, no fragment."""
    told = F.regexp_replace(urls.scheme(url), "^ws", "http")
    return F.concat(told, F.regexp_extract(url, r"^[^:]+(://[^#]*)", 1))


def host_text(raw: Column) -> Column:
    """What stands for the host in typed text: no scheme, path, query, fragment or port."""
    return F.regexp_extract(F.regexp_replace(F.trim(raw), "(?i)^https?://", ""), "^[^/?#:]*", 0)


def domain_input(raw: Column) -> Column:
    found = F.lower(F.trim(host_text(raw)))
    return F.when(found != "", found).otherwise(F.trim(raw))


def file_stem(raw: Column) -> Column:
    """A domain as the safe stem of a file name; `alvo` where nothing is left."""
    found = F.trim(F.regexp_replace(host_text(raw), r"[^a-zA-Z0-9\-]+", "_"), F.lit("_"))
    return F.when(found != "", found).otherwise("alvo")


def grep_pattern_ok(pattern: Column) -> Column:
    """Whether a user's pattern has only characters that no shell reads as a command."""
    return F.coalesce(pattern.rlike(f"^{GREP_ALLOWED}$") & ~pattern.rlike(GREP_FORBIDDEN), F.lit(False))


def is_log_part(path: Column) -> Column:
    """Whether a file holds a part of a run rather than its main report."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    return F.exists(F.array(*map(F.lit, LOG_PARTS)), lambda tag: F.contains(name, tag))


def render_method_is_safe(method: Column) -> Column:
    return F.upper(method).isin(*SAFE_METHODS)


def changed_from_baseline(length: Column, baseline: Column) -> Column:
    """Whether an answer's length lies further from the baseline's than 50 and 15 percent of it."""
    base = F.coalesce(baseline, F.lit(0))
    return F.abs(F.coalesce(length, F.lit(0)) - base) > F.greatest(F.lit(50), F.floor(base * 0.15))


def wildcard_confidence(state: Column, answers: Column, wildcard: Column) -> Column:
    """unverified, wildcard_ambiguous (a detected wildcard gives all of these answers) or confirmed."""
    same = (state == "detected") & (F.size(F.array_except(answers, wildcard)) == 0)
    return F.when(state == "unverified", "unverified").when(same, "wildcard_ambiguous").otherwise("confirmed")


def cors_severity(origin: Column, allowed: Column, credentials: Column) -> Column:
    """Severity of an origin that is let in; null where it isn't."""
    return F.when(allowed.isin("*") | (allowed == origin), F.when((F.lower(credentials) == "true") & (allowed != "*"), "CRITICO").otherwise("MEDIO"))


def redirects_to(location: Column, host: str, path: str) -> Column:
    """Whether a resolved Location leads to a canary's host and path, by http or https."""
    return F.coalesce(urls.scheme(location).isin("http", "https") & (urls.host(location) == host) & (urls.path(location) == path), F.lit(False))


def https_check(url: Column) -> Column:
    """struct(check, passed, detail)"""
    found = F.lower(urls.scheme(url))
    return F.struct(F.lit("https").alias("check"), (found == "https").alias("passed"), F.concat(F.lit("scheme="), F.when(found != "", found).otherwise("unknown")).alias("detail"))


def cookie_checks(cookies: Column) -> Column:
    """For each Set-Cookie value whether it is Secure and HttpOnly: array of struct(check, passed, detail)."""

    def flag(cookie: Column, mark: str, shown: str) -> Column:
        name = F.trim(F.substring_index(cookie, "=", 1))
        has = F.contains(F.lower(cookie), F.lit(mark))
        return F.struct(F.concat(F.lit("cookie:"), F.when(name != "", name).otherwise("<unnamed>"), F.lit(f":{mark}")).alias("check"), has.alias("passed"), F.concat(F.lit(f"{shown} flag "), F.when(has, "present").otherwise("missing")).alias("detail"))

    return F.flatten(F.transform(cookies, lambda c: F.array(flag(c, "secure", "Secure"), flag(c, "httponly", "HttpOnly"))))


def event_stage(stage: Column) -> Column:
    found = F.upper(F.trim(stage))
    return F.when(found.isin(*STAGES), found).otherwise("POSSIBLE")


def row_url(row: Column) -> Column:
    """The URL of a crawl row in JSON, whichever of the known fields has it, without its fragment; empty if none has."""
    held = [F.nullif(F.get_json_object(row, p), F.lit("")) for p in ("$.url", "$.request.endpoint", "$.request.url")]
    return F.substring_index(F.coalesce(*held, F.lit("")), "#", 1)


def wordlist_category(category: Column, known: Sequence[str]) -> Column:
    """A known category, or custom:<field> in lower case; null for what is neither."""
    value = F.trim(category)
    field = F.trim(F.regexp_extract(value, "^custom:(.*)$", 1))
    return F.when(value.isin(*known), value).when(value.startswith("custom:") & field.rlike("^[A-Za-z0-9_-]{1,64}$"), F.concat(F.lit("custom:"), F.lower(field)))


def wordlist_label(name: Column) -> Column:
    found = F.trim(F.regexp_replace(F.regexp_extract(name, "[^/]*$", 0), "[^a-zA-Z0-9_.-]+", "_"), F.lit("._-"))
    return F.substring(F.when(found != "", found).otherwise("wordlist"), 1, 80)


def clip(text: Column, length: int = 500) -> Column:
    """The beginning of a text, cut and then freed of secrets."""
    return F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, length), SECRET, "$1=<redacted>")


def contains_query(text: Column, queries: Column) -> Column:
    """Whether a text, read as form data, echoes one of the queries of eight characters or more."""
    decoded = F.lower(F.coalesce(F.try_url_decode(text), text))
    return F.exists(queries, lambda q: (F.length(q) >= QUERY_LENGTH) & F.contains(decoded, F.lower(q)))


def omit_queries(text: Column, queries: Sequence[str]) -> Column:
    """A text with the queries of eight characters or more taken out, whatever their case; the longest first."""
    for q in sorted((q for q in queries if len(q) >= QUERY_LENGTH), key=lambda q: (-len(q), q)):
        text = F.regexp_replace(text, "(?i)" + "".join(f"\\x{{{ord(c):x}}}" for c in q), "[QUERY OMITTED]")
    return text


def spf_networks(record: Column) -> Column:
    """The addresses and networks that an SPF record names, each once."""
    return F.array_distinct(F.regexp_extract_all(record, F.lit(r"(?i)\bip[46]:([0-9a-fA-F.:]+(?:/[0-9]+)?)"), F.lit(1)))


def replace_query(url: Column, name: str, value: str) -> Column:
    """A URL whose first parameter of a name has another value; all are encoded anew."""
    encode = lambda c: F.regexp_replace(F.regexp_replace(F.url_encode(c), r"\*", "%2A"), "%7E", "~")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.filter(F.split(urls.query(url), "&"), lambda p: p != "")
    names = F.transform(pairs, lambda p: decode(F.substring_index(p, "=", 1)))
    first = F.array_position(names, F.lit(name))
    own = F.transform(pairs, lambda p, i: F.concat(encode(names[i]), F.lit("="), F.when(i + 1 == first, encode(F.lit(value))).otherwise(encode(decode(F.regexp_replace(p, "^[^=]*=?", ""))))))
    asked = F.array_join(own, "&")
    after = F.regexp_extract(url, "#.*$", 0)
    return F.concat(F.regexp_extract(url, "^[^?#]*", 0), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""), F.when(after != "#", after).otherwise(""))
