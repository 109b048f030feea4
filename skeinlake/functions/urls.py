"""URL and host functions as Column expressions.

URLs are cut by the pattern of RFC 3986, appendix B, which never fails, instead of parse_url, which rejects much of what crawlers meet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3986 = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, RFC3986, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 2))


def authority(url: Column) -> Column:
    return part(url, 4)


def path(url: Column) -> Column:
    return part(url, 5)


def query(url: Column) -> Column:
    return part(url, 7)


def has_userinfo(url: Column) -> Column:
    return F.instr(authority(url), "@") > 0


def host_port(url: Column) -> Column:
    return F.regexp_replace(authority(url), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-cased host without userinfo, port and brackets."""
    return F.lower(F.regexp_replace(F.regexp_replace(host_port(url), r":[0-9]*$", ""), r"^\[(.*)\]$", "$1"))


def port(url: Column) -> Column:
    return F.regexp_extract(host_port(url), r":([0-9]+)$", 1)


def _or_slash(p: Column) -> Column:
    return F.when(p == "", F.lit("/")).otherwise(p)


def _with_query(base: Column, q: Column) -> Column:
    return F.when(q == "", base).otherwise(F.concat_ws("?", base, q))


def bound(url: Column, make) -> Column:
    """make() of a URL that has been cut once: its parts are fields of one struct, and not patterns that are matched anew at each mention."""
    parts = F.struct(url.alias("url"), scheme(url).alias("scheme"), authority(url).alias("authority"), path(url).alias("path"), query(url).alias("query"), host(url).alias("host"), port(url).alias("port"))
    return F.element_at(F.transform(F.array(parts), make), 1)


def _place(x: Column, of_host: Column) -> Column:
    shown = F.when(F.instr(of_host, ":") > 0, F.concat(F.lit("["), of_host, F.lit("]"))).otherwise(of_host)
    is_default = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        is_default = is_default | ((x["scheme"] == name) & (x["port"] == number))
    return F.when((x["port"] == "") | is_default, shown).otherwise(F.concat_ws(":", shown, x["port"]))


def normalize(url: Column) -> Column:
    """Frontier form: scheme and host lower, no default port, no fragment, / for an empty path; the query stays as it is. What has userinfo or no host stays whole."""

    def make(x: Column) -> Column:
        h = F.regexp_replace(x["host"], r"\.+$", "")
        whole = F.concat(x["scheme"], F.lit("://"), _place(x, h), _or_slash(x["path"]))
        return F.when((x["scheme"] == "") | (h == "") | (F.instr(x["authority"], "@") > 0), x["url"]).otherwise(_with_query(whole, x["query"]))

    return bound(url, make)


def normalize_legacy(url: Column) -> Column:
    """Legacy form: authority and path lower, no trailing /, query pairs sorted, empty ones dropped, no fragment."""
    pairs = F.array_join(F.array_sort(F.filter(F.split(query(url), "&"), lambda x: x != "")), "&")
    p = _or_slash(F.lower(F.regexp_replace(path(url), "/+$", "")))
    return _with_query(F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), p), pairs)


def normalize_target(raw: Column) -> Column:
    """Identity of a scan target: https unless http is said, no default port, no fragment, no trailing /; empty for other schemes and no host."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    hint = F.lower(F.split_part(text, F.lit("://"), F.lit(1)))
    named = F.instr(text, "://") > 0
    full = F.when(named, text).otherwise(F.concat(F.lit("https://"), text))

    def make(x: Column) -> Column:
        p = _or_slash(F.regexp_replace(F.regexp_replace(x["path"], ";[^/]*$", ""), "/+$", ""))
        origin = F.concat(x["scheme"], F.lit("://"), _place(x, x["host"]))
        out = F.when((p == "/") & (x["query"] == ""), origin).otherwise(_with_query(F.concat(origin, p), x["query"]))
        return F.when(x["host"] == "", F.lit("")).otherwise(out)

    return F.when((text == "") | (named & ~hint.isin("http", "https")), F.lit("")).otherwise(bound(full, make))


def sanitize(url: Column) -> Column:
    """For evidence: scheme and host lower, any port kept, no userinfo and fragment, every query value redacted; empty without scheme or host."""

    def make(x: Column) -> Column:
        shown = F.when(F.instr(x["host"], ":") > 0, F.concat(F.lit("["), x["host"], F.lit("]"))).otherwise(x["host"])
        place = F.when(x["port"] == "", shown).otherwise(F.concat_ws(":", shown, x["port"]))
        pairs = F.filter(F.split(x["query"], "&"), lambda p: p != "")
        keys = F.transform(pairs, lambda p: F.concat(F.url_encode(F.url_decode(F.split_part(p, F.lit("="), F.lit(1)))), F.lit("=%5Bredacted%5D")))
        whole = F.concat(x["scheme"], F.lit("://"), place, _or_slash(x["path"]))
        return F.when((x["scheme"] == "") | (x["host"] == ""), F.lit("")).otherwise(_with_query(whole, F.array_join(keys, "&")))

    return bound(url, make)


#: Fixed value: query keys whose values are never shown.
SENSITIVE_KEY = r"(?i)(?:^|[_-])(?:api[_-]?key|access[_-]?token|auth|authorization|code|credential|jwt|password|passwd|secret|session|signature|token)(?:$|[_-])"


def in_scope(url: Column, domain: str) -> Column:
    """The URL in canonical form, sensitive values redacted, if it is a web URL on domain or below it; else null."""

    def make(x: Column) -> Column:
        h = F.regexp_replace(x["host"], r"\.+$", "")
        pairs = F.filter(F.split(x["query"], "&"), lambda p: p != "")
        key = lambda p: F.split_part(p, F.lit("="), F.lit(1))
        shown = F.transform(pairs, lambda p: F.when(key(p).rlike(SENSITIVE_KEY), F.concat(key(p), F.lit("=%5BREDACTED%5D"))).when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
        whole = F.concat(x["scheme"], F.lit("://"), _place(x, h), _or_slash(x["path"]))
        ok = x["scheme"].isin("http", "https") & (F.instr(x["authority"], "@") == 0) & ((h == domain) | h.endswith("." + domain))
        return F.when(ok, _with_query(whole, F.array_join(shown, "&")))

    return F.when((F.length(url) <= 4096) & ~url.rlike(r"[\x00-\x1f]"), bound(url, make))


def query_params(url: Column, limit: int = 24) -> Column:
    """Distinct keys in order, at most limit."""
    pairs = F.filter(F.split(query(url), "&"), lambda x: x != "")
    keys = F.filter(F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda k: k != "")
    return F.slice(F.array_distinct(keys), 1, limit)


def endpoint(url: Column) -> Column:
    """The path without trailing /; null for none."""
    return F.when(~path(url).isin("", "/"), F.regexp_replace(path(url), "/+$", ""))


def event_target(url: Column) -> Column:
    """Scheme, host and non-default port of a web URL without userinfo."""

    def make(x: Column) -> Column:
        h = F.regexp_replace(x["host"], r"\.+$", "")
        ok = x["scheme"].isin("http", "https") & (h != "") & (F.instr(x["authority"], "@") == 0)
        return F.when(ok, F.concat(x["scheme"], F.lit("://"), _place(x, h))).otherwise(F.lit("[target omitted]"))

    return bound(url, make)


def is_valid_host(h: Column) -> Column:
    """IPv4 literal or RFC 1123 labels."""
    labels = F.forall(F.split(h, r"\."), lambda x: x.rlike(r"^[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?$"))
    return (h != "") & ~h.startswith("-") & (F.length(h) <= 253) & labels


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


#: Paths that every origin is asked for.
WELL_KNOWN = ("/.well-known/security.txt", "/.well-known/assetlinks.json")


def well_known(url: Column) -> Column:
    return F.array(*[F.concat(origin(url), F.lit(p)) for p in WELL_KNOWN])


def host_matches(h: Column, rule: str) -> Column:
    """A plain rule means the domain and all below it, *.rule only what is below, other wildcards are globs, an address is itself."""
    import re

    rule = rule.strip().lower().rstrip(".")
    if rule.startswith("*."):
        return h.endswith("." + rule[2:])
    if "*" in rule or "?" in rule:
        return h.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in rule) + "$")
    if re.fullmatch(r"[0-9.]+|.*:.*", rule):
        return h == rule
    return (h == rule) | h.endswith("." + rule)


def path_in_prefix(p: Column, prefix: str) -> Column:
    """On borders of segments: /api holds /api and /api/x, not /apiary."""
    prefix = "/" + prefix.strip("/") if prefix.strip("/") else "/"
    candidate = _or_slash(p)
    return candidate.startswith("/") if prefix == "/" else (candidate == prefix) | candidate.startswith(prefix + "/")


def request_sha256(method: str, url: Column) -> Column:
    return F.sha2(F.concat(F.lit(method.upper() + "\n"), url), 256)
