"""Passive rules over captured responses: built-in checks, and declarative templates compiled to columns.

Every rule becomes one nullable finding struct; a response is scanned once for all of them, and the position in the array is the emission order that
deduplication relies on. Headers are map<string, array<string>> with lower-case keys.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import findings as fn
from ..functions import urls as u

#: Signatures in response bodies.
SECRET = r"(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*[\"']?(?:[A-Za-z0-9_\-]{8,})"
DEBUG = r"(?i)(?:traceback \(most recent call last\)|stack trace|debug\s*[=:]\s*(?:true|1|on)\b|django debug page|whitelabel error page)"
LISTING_HEAD = r"(?is)<(?:title|h1)\b[^>]*>\s*(?:index\s+of\b|directory\s+listing\s+for\b)"
LISTING_LINK = r"""(?is)<a\b[^>]*href\s*=\s*["'](?:\.\./|/\.\.)["'][^>]*>\s*(?:\.\./|parent\s+directory\b)"""
PHPINFO = r"(?is)<title\s*>\s*phpinfo\(\)\s*</title\s*>"
PRIVATE_IP = r"(?<![\d.])(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3})(?!\d)(?!\.\d)"
SESSION_NAME = r"(?i)(?:^|[._-])(?:session|sessionid|sess|sessid|auth|token|jwt|sid)(?:$|[._-])"
SESSION_NAMES = ("phpsessid", "jsessionid", "asp.net_sessionid", "connect.sid")
SQL_ERRORS = (
    r"(?i)(SQL syntax error|error in your SQL syntax|SQLite(?:3)?(?:::SQL)?(?:Exception| error)|MySQL(?: server)? (?:error|syntax error)|MariaDB.{0,40}(?:error|syntax)|PostgreSQL\s+(?:error|syntax error)|ORA-\d{4,5}|"
    r"ODBC.{0,40}(?:SQLSTATE|SQL error)|JDBC.{0,40}(?:Exception|error)|syntax error at or near|unclosed quotation mark)"
)
LDAP_ERRORS = r"(?i)(invalid DN syntax|LDAPException|LDAP:\s*error code\s+\d+|javax\.naming\.(?:NamingException|InvalidNameException))"
COMMAND_ERRORS = r"(?i)(?:\b(?:sh|bash):\s*[^:\r\n]{1,80}:\s*command not found\b|\bcommand not found\b|cannot execute (?:binary file|command)|syntax error near unexpected token|is not recognized as an internal or external command)"
TRAVERSAL = r"(?i)(?:root:x:0:0|[A-Z]:\\Windows\\System32(?:\\|\b))"
XXE = r"(?i)(?:XML parser error|SAXParseException|failed to load external entity|external entity (?:resolution|processing) failed)"
DOM_SOURCE = r"(?i)(?:location\.(?:search|hash)|document\.(?:URL|documentURI|referrer)|window\.name)"
DOM_SINK = r"(?i)(?:\.innerHTML\s*=|\.outerHTML\s*=|document\.write\s*\(|insertAdjacentHTML\s*\()"
REQUIRED = (("content-security-policy", "headers.csp"), ("x-content-type-options", "headers.xcto"), ("strict-transport-security", "tls.hsts"), ("referrer-policy", "headers.referrer-policy"))

#: Passive rules that read the body for what it discloses.
BODY_RULES = ("directory-listing", "source-map-reference", "possible-secret-disclosure", "debug-information-disclosure", "phpinfo-page-exposed", "private-address-disclosure")

FINDING = "struct<id:string,severity:string,confidence:string,evidence:string>"


def finding(holds: Column, rule: str, severity: str | Column, confidence: str | Column, evidence: str | Column) -> Column:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(rule).alias("id"), text(severity).alias("severity"), text(confidence).alias("confidence"), F.substring(text(evidence), 1, 500).alias("evidence")))


def header(headers: Column, name: str) -> Column:
    """The header's values joined, null where it is absent."""
    return F.when(F.map_contains_key(headers, F.lit(name)), F.array_join(F.try_element_at(headers, F.lit(name)), ", "))


def secure_context(url: Column) -> Column:
    h = u.host(url)
    return (u.scheme(url) == "https") | (h == "localhost") | h.endswith(".localhost") | h.rlike(r"^127\.") | (h == "::1")


def _cookies(url: Column, headers: Column) -> Column:
    """Findings of each Set-Cookie value, in order."""
    https = F.startswith(F.lower(url), F.lit("https://"))
    secure = secure_context(url)

    def one(value: Column, i: Column) -> Column:
        parts = F.transform(F.split(value, ";"), lambda x: F.trim(x))
        raw = F.trim(F.split_part(F.element_at(parts, 1), F.lit("="), F.lit(1)))
        attributes = F.transform(F.slice(parts, 2, 100), lambda p: F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))))
        pairs = F.transform(F.slice(parts, 2, 100), lambda p: F.concat_ws("=", F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))), F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(2))))))
        session = F.lower(raw).isin(*SESSION_NAMES) | raw.rlike(SESSION_NAME)
        severity, confidence = F.when(session, "LOW").otherwise("INFO"), F.when(session, "MEDIUM").otherwise("LOW")
        has = lambda a: F.array_contains(attributes, a)
        number = F.concat(F.lit("Set-Cookie #"), (i + 1).cast("string"))
        bad_secure = ~has("secure") | ~secure
        return F.array(
            finding(https & ~has("secure"), "cookie-secure", severity, confidence, number), finding(~has("httponly"), "cookie-httponly", severity, confidence, number), finding(~has("samesite"), "cookie-samesite", severity, confidence, number),
            finding(raw.startswith("__Secure-") & bad_secure, "cookie.prefix-secure", "INFO", "HIGH", number),
            finding(raw.startswith("__Host-") & (bad_secure | ~F.array_contains(pairs, "path=/") | has("domain")), "cookie.prefix-host", "INFO", "HIGH", number),
            finding(F.array_contains(pairs, "samesite=none") & bad_secure, "cookie.samesite-none-secure", "INFO", "HIGH", number),
        )

    values = F.coalesce(F.try_element_at(headers, F.lit("set-cookie")), F.array().cast("array<string>"))
    return F.flatten(F.transform(values, one))


def listing(body: Column) -> Column:
    head = F.substring(body, 1, 20_000)
    return head.rlike(LISTING_HEAD) & head.rlike(LISTING_LINK)


def private_ip(text: Column) -> Column:
    """The first private address whose parts are no more than 255."""
    found = F.filter(F.regexp_extract_all(text, F.lit(PRIVATE_IP), F.lit(0)), lambda x: F.forall(F.split(x, r"\."), lambda p: p.cast("int") <= 255))
    return F.try_element_at(found, F.lit(1))


def passive(url: Column, headers: Column, body: Column) -> Column:
    """Findings about headers, cookies and body, in emission order."""
    https = F.startswith(F.lower(url), F.lit("https://"))
    head = F.substring(body, 1, 100_000)
    low = F.lower(head)
    h = lambda n: header(headers, n)
    missing = [finding(h(n).isNull() & (https if n == "strict-transport-security" else F.lit(True)), i, "LOW", "HIGH", f"Missing {n}") for n, i in REQUIRED]
    first = F.array(
        *missing, finding(https & body.rlike(r"(?i)(?:src|href)=[\"']http://"), "mixed-content-reference", "LOW", "MEDIUM", "HTTPS page references an HTTP resource"), finding(h("server").rlike(r"\d"), "server-disclosure", "INFO", "HIGH", F.coalesce(h("server"), F.lit(""))),
        finding(h("x-powered-by").isNotNull(), "x-powered-by-disclosure", "INFO", "HIGH", F.coalesce(h("x-powered-by"), F.lit(""))),
    )
    ip = private_ip(head)
    last = F.array(
        finding((F.trim(h("access-control-allow-origin")) == "*") & (F.lower(h("access-control-allow-credentials")) == "true"), "cors.invalid-credentialed-wildcard", "INFO", "HIGH", "wildcard origin with credentials"),
        finding(listing(body), "directory-listing", "LOW", "MEDIUM", "Directory listing marker"), finding(body.rlike(r"(?i)sourceMappingURL=.*\.map(?:\b|$)"), "source-map-reference", "INFO", "MEDIUM", "Source map referenced"),
        finding(body.rlike(SECRET), "possible-secret-disclosure", "MEDIUM", "MEDIUM", "value redacted"), finding(head.rlike(DEBUG), "debug-information-disclosure", "MEDIUM", "MEDIUM", "Debug signature"),
        finding(head.rlike(PHPINFO) & F.contains(low, F.lit("php version")) & F.contains(low, F.lit("loaded configuration file")), "phpinfo-page-exposed", "LOW", "MEDIUM", "phpinfo() page"),
        finding(ip.isNotNull(), "private-address-disclosure", "LOW", "MEDIUM", F.concat(F.lit("Private address pattern: "), F.coalesce(ip, F.lit("")))),
    )
    return F.array_compact(F.concat(first, _cookies(url, headers), last))


def extended(url: Column, status: Column, headers: Column, body: Column) -> Column:
    """Further findings about policies, CORS, methods, caching and error detail, in emission order."""
    text = F.substring(F.coalesce(body, F.lit("")), 1, 150_000)
    h = lambda n: header(headers, n)
    said = lambda n: F.lower(F.coalesce(h(n), F.lit("")))
    csp, kind, acao = said("content-security-policy"), said("content-type"), F.coalesce(h("access-control-allow-origin"), F.lit(""))
    is_html = F.contains(kind, F.lit("text/html"))
    methods = F.transform(F.split(F.upper(F.coalesce(h("allow"), F.lit(""))), ","), lambda x: F.trim(x))
    return F.array_compact(
        F.array(
            finding(F.contains(csp, F.lit("'unsafe-inline'")), "csp-unsafe-inline", "MEDIUM", "HIGH", "unsafe-inline"), finding(F.contains(csp, F.lit("'unsafe-eval'")), "csp-unsafe-eval", "MEDIUM", "HIGH", "unsafe-eval"),
            finding(said("referrer-policy").isin("unsafe-url", "no-referrer-when-downgrade"), "referrer-policy-weak", "LOW", "HIGH", said("referrer-policy")), finding(h("permissions-policy").isNull(), "permissions-policy-missing", "INFO", "HIGH", "Permissions-Policy absent"),
            finding(h("content-security-policy").isNull() & (is_html | F.contains(F.lower(text), F.lit("<html"))), "csp-missing", "LOW", "HIGH", "HTML without CSP"), finding(listing(text), "directory-listing", "LOW", "HIGH", "Generated index"),
            finding(text.rlike(r"(?i)sourceMappingURL\s*=\s*[^\s<]+\.map"), "source-map-reference", "INFO", "HIGH", "Source map referenced"),
            finding(text.rlike(r"(?i)(?:password|passwd|secret|api[_-]?key|token)\s*[=:]\s*[\"'][^\"']{8,}[\"']"), "potential-secret-disclosure", "HIGH", "LOW", "value redacted"),
            finding((acao == "*") & h("access-control-allow-credentials").isNull(), "cors-wildcard", "INFO", "LOW", "wildcard origin"),
            finding((said("access-control-allow-credentials") == "true") & (acao != "") & (acao != "*"), "cors-credentialed-origin-review", "INFO", "MEDIUM", "credentials for one origin"),
            finding(F.array_contains(methods, "TRACE"), "http-trace-advertised", "LOW", "HIGH", "TRACE allowed"),
            finding(url.rlike(r"(?i)(?:/account|/profile|/dashboard|/admin|/settings|/api/)") & F.contains(said("cache-control"), F.lit("public")), "sensitive-response-public-cache", "LOW", "MEDIUM", "public cache"),
            finding(h("cross-origin-resource-policy").isNull() & (is_html | F.contains(kind, F.lit("javascript"))), "corp-missing", "INFO", "MEDIUM", "CORP absent"),
            finding((status >= 500) & text.rlike(r"(?i)(exception|traceback|stack trace|line \d+)"), "server-error-detail-confirmed", "MEDIUM", "HIGH", "5xx with detail"),
        )
    )


def categories(url: Column, headers: Column, body: Column) -> Column:
    """Signature rules by category of weakness, in emission order."""
    text = F.substring(body, 1, 100_000)
    h = lambda n: header(headers, n)
    return F.array_compact(
        F.array(
            finding(text.rlike(SQL_ERRORS), "sqli.error-indicator", "MEDIUM", "LOW", "database error signature"), finding(text.rlike(COMMAND_ERRORS), "cmdi.execution-indicator", "MEDIUM", "LOW", "shell error signature"),
            finding(text.rlike(TRAVERSAL), "directory-traversal.file-indicator", "LOW", "LOW", "system file signature"), finding(text.rlike(XXE) & F.contains(F.lower(h("content-type")), F.lit("xml")), "xxe.xml-indicator", "LOW", "LOW", "XML parser error"),
            finding(text.rlike(DOM_SOURCE) & text.rlike(DOM_SINK), "xss.dom-source-sink-indicator", "INFO", "LOW", "source and sink"), finding(F.startswith(F.lower(url), F.lit("http://")), "ssl-tls.http-only", "MEDIUM", "HIGH", "plaintext transport"),
            finding(h("server").rlike(r"\d"), "information-disclosure.server", "INFO", "HIGH", F.coalesce(h("server"), F.lit(""))), finding(F.startswith(F.lower(h("www-authenticate")), F.lit("basic ")), "csrf.auth-basic-review", "INFO", "LOW", "Basic authentication"),
            finding(text.rlike(LDAP_ERRORS), "ldap.error-indicator", "LOW", "LOW", "LDAP error signature"), finding(F.coalesce(h("x-content-type-options"), F.lit("")) == "", "headers-security.xcto", "LOW", "HIGH", "Header missing"),
        )
    )


# templates


class TemplateError(ValueError):
    """A template that breaks the schema."""


_KINDS, _PARTS, _CONDITIONS = ("word", "regex", "status"), ("body", "header", "all"), ("and", "or")


def safe_regex(pattern: str) -> None:
    """Refuses patterns whose matching may explode: quantified groups, many unbounded quantifiers, more than one .*"""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "x", pattern)
    if not pattern or len(pattern) > 256 or re.search(r"\)[*+?{]", bare) or len(re.findall(r"[*+]|\{\d*,\}", bare)) > 8 or bare.count(".*") > 1:
        raise TemplateError(f"unsafe pattern: {pattern[:60]}")
    re.compile(pattern)


def validate(template: Mapping) -> None:
    """Closed key sets, enumerations, and bounds of a template."""
    if set(template) - {"id", "info", "matchers", "matchers-condition", "extractors"} or not re.fullmatch(r"[a-z0-9][a-z0-9._-]{1,99}", str(template.get("id", ""))):
        raise TemplateError("unknown keys, or no id")
    matchers = template.get("matchers")
    if not isinstance(matchers, Sequence) or not 1 <= len(matchers) <= 12 or template.get("matchers-condition", "or") not in _CONDITIONS:
        raise TemplateError("1 to 12 matchers, joined by and or or")
    for m in matchers:
        if set(m) - {"type", "part", "condition", "negative", "values"} or m.get("type") not in _KINDS or m.get("part", "body") not in _PARTS or m.get("condition", "or") not in _CONDITIONS or not m.get("values"):
            raise TemplateError("matcher breaks the schema")
        if m["type"] == "regex":
            for p in m["values"]:
                safe_regex(str(p))


def compile_template(template: Mapping, status: Column, headers_text: Column, body: Column) -> Column:
    """The template as one condition over a response: words and patterns in a window of 20 000 characters, ignoring case."""
    validate(template)
    parts = {"body": body, "header": headers_text, "all": F.concat_ws("\n", headers_text, body)}

    def joined(how: str, conditions: list[Column]) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c if how == "and" else out | c
        return out

    each = []
    for m in template["matchers"]:
        text = F.substring(parts[m.get("part", "body")], 1, 20_000)
        if m["type"] == "status":
            own = status.isin(*[int(v) for v in m["values"]])
        else:
            tests = [F.contains(F.lower(text), F.lit(str(v).lower())) if m["type"] == "word" else text.rlike(f"(?im){v}") for v in m["values"]]
            own = joined(m.get("condition", "or"), tests)
        own = F.coalesce(own, F.lit(False))
        each.append(~own if m.get("negative") else own)
    return joined(template.get("matchers-condition", "or"), each)


def evaluate(responses: DataFrame, templates: Sequence[Mapping], body: str = "body", headers_text: str = "headers_text", status: str = "status") -> DataFrame:
    """responses with matched, the ids of the templates that hold: all are columns of one projection, so a page is read once for all of them."""
    tests = [F.when(compile_template(t, F.col(status), F.col(headers_text), F.col(body)), F.lit(t["id"])) for t in templates]
    return responses.withColumn("matched", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def all_findings(responses: DataFrame) -> DataFrame:
    """(obs_id, url, ord, id, severity, confidence, evidence, stage, score) of responses (obs_id, url, status, headers, body), first wins for each rule and URL."""
    from .dedupe import first_wins

    every = F.concat(passive(F.col("url"), F.col("headers"), F.col("body")), extended(F.col("url"), F.col("status"), F.col("headers"), F.col("body")), categories(F.col("url"), F.col("headers"), F.col("body")))
    rows = responses.select("obs_id", "url", F.posexplode(every).alias("ord", "f")).select("obs_id", "url", "ord", "f.*")
    rows = rows.withColumn("id", fn.alias_id(F.col("id")))
    kept = first_wins(rows.withColumn("o", F.struct("obs_id", "ord")), [F.col("id"), F.col("url")], "o").drop("o")
    kept = kept.withColumn("stage", fn.stage(F.col("id")))
    factors = {"direct_observation": F.lit(True), "heuristic_only": F.col("stage") == "POSSIBLE", "high_quality_fingerprint": F.startswith(F.col("id"), F.lit("cve."))}
    return kept.withColumn("score", fn.score(F.col("stage"), factors))
