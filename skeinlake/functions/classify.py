"""Labels of pages, links and search results."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as u
from .predicates import contains_any

#: Fixed values.
STATIC = ("js", "mjs", "css", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "woff", "woff2", "ttf", "map", "pdf", "zip")
LISTING = r"(?i)index of /|directory listing|parent directory"
ERROR = r"(?i)stack trace|traceback \(most recent call last\)|internal server error|fatal error"
LOGIN = r"(?i)\b(sign in|log in|login|authenticate|password|senha)\b"
LINK_CLASSES = (
    ("[Admin/Login]", ("/admin", "/administrator", "/login", "/signin", "/dashboard", "/cpanel", "/wp-admin")),
    ("[API]", ("/api", "/swagger", "/v1", "/v2", "/v3", "/graphql", "/api-docs")),
    ("[Parametros]", None),
    ("[Config/Backup]", ("/backup", "/dump", "/sql", "/database", "/config", "/settings", "/.env", "/.git")),
    ("[Teste/Dev]", ("/debug", "/test", "/dev", "/stage", "/staging", "/beta")),
)
FILES = r"\.(pdf|doc|docx|xls|xlsx|zip|rar|sql|bak|log)$"
PATH_HINTS = {
    "exposed_admin": ("/admin", "/administrator", "/login", "/wp-admin", "/cpanel"),
    "backup_files": (r"\.bak$", r"\.old$", r"\.sql$", r"\.dump$", "backup", r"\.env$", r"\.git/"),
    "debug_panels": ("/debug", "/test", "/dev", "/staging", "/beta", "/phpinfo"),
    "sensitive_endpoints": ("/api/v[0-9]", "/graphql", "/swagger", "/config", "/settings"),
    "info_disclosure": ("/server-status", "/phpmyadmin", "/mysql", "/database", "/logs?$"),
}
SEVERITIES = {"CRITICO": "CRITICAL", "CRÍTICO": "CRITICAL", "ALTO": "HIGH", "MEDIO": "MEDIUM", "MÉDIO": "MEDIUM", "BAIXO": "LOW"}


def title(html: Column) -> Column:
    """First title of the first 200 000 characters, white space collapsed."""
    found = F.regexp_extract(F.substring(html, 1, 200_000), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def page_class(url: Column, content_type: Column, status: Column, body: Column, has_form: Column, has_password: Column) -> Column:
    """The first sign that holds, in order: redirect, error, static, listing, error text, login, form, api, page."""
    path, kind, own = F.lower(u.path(url)), F.lower(F.coalesce(content_type, F.lit(""))), title(body)
    head = F.substring(body, 1, 100_000)
    return (
        F.when(status.between(300, 399), "redirect")
        .when(status >= 400, "error")
        .when(path.rlike(rf"\.({'|'.join(STATIC)})$") | contains_any(kind, ("javascript", "css", "image/", "font/")), "static_asset")
        .when(own.rlike(LISTING) | (head.rlike(LISTING) & F.contains(F.lower(head), F.lit('href="../"'))), "listing")
        .when(own.rlike(ERROR) | head.rlike(ERROR), "error")
        .when(has_password | own.rlike(LOGIN) | path.rlike(r"/(?:login|signin|sign-in|auth)(?:/|$)"), "login")
        .when(has_form, "form")
        .when(F.contains(kind, F.lit("json")) | path.rlike(r"\.(json|graphql|gql)$") | F.contains(path, F.lit("/api/")), "api_endpoint")
        .otherwise("page")
    )


def link_class(url: Column) -> Column:
    low = F.lower(url)
    out = None
    for label, marks in LINK_CLASSES:
        holds = contains_any(low, marks) if marks else (F.instr(low, "?") > 0) & (F.instr(low, "=") > 0)
        out = F.when(holds, label) if out is None else out.when(holds, label)
    return out.when(low.rlike(FILES), "[Arquivo]").otherwise("[Comum]")


def path_hints(url: Column) -> Column:
    """The categories whose patterns a URL has."""
    low = F.lower(url)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(p)), k) for k, p in PATH_HINTS.items()]))


#: Forms of credentials in search results.
CREDENTIALS = (
    r"\bAKIA[0-9A-Z]{16}\b", r"(?i)\b(?:ghp|github_pat|glpat)-[A-Za-z0-9_-]{16,}\b", r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"(?i)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?i)\b(?:api[_-]?key|access[_-]?token|client[_-]?secret|password|passwd|authorization)\b\s*[:=]\s*['\"]?[^\s'\",;<>]{4,}",
)
#: Weight, reason, what is looked at, pattern; the signals of one reason count once.
SIGNALS = (
    (5, "sensitive file", "path", r"(?:^|/)(?:\.env|\.git(?:/|$)|\.svn(?:/|$)|[^/]+\.(?:sql|bak|backup|old|dump|pem|key|p12|pfx|log|conf|ini|yml|yaml|cfg))(?:$|/)"),
    *((6, "credential", "raw", p) for p in CREDENTIALS),
    (5, "directory listing", "title", r"index of|directory listing|parent directory"),
    (5, "directory listing", "path", r"(?:^|/)(?:index\.of|directory|listing)(?:/|$)"),
    (3, "api documentation", "path", r"(?:^|/)(?:swagger(?:-ui)?|api-docs|openapi(?:\.json)?|graphql|graphiql)(?:/|$)"),
    (4, "diagnostics", "path", r"(?:^|/)(?:phpinfo(?:\.php)?|server-status|server-info|debug|\.git)(?:/|$)"),
    (3, "error text", "text", r"stack trace|traceback|internal server error|fatal error|exception"),
    (2, "administration", "path", r"(?:^|/)(?:admin|administrator|dashboard|login|signin|auth|sso)(?:/|$)"),
)


def search_score(link: Column, text: Column, title: Column | None = None) -> Column:
    """struct(score, confidence, reason) of a search result: weights of its signals, 10 at most; the first one is the reason."""
    title = F.lit("") if title is None else F.coalesce(title, F.lit(""))
    raw = F.concat_ws(" ", title, text)
    seen = {"path": F.lower(u.path(link)), "title": F.lower(title), "text": F.lower(raw), "raw": raw}
    reasons = dict.fromkeys((r, w) for w, r, *_ in SIGNALS)
    holds = {r: reduce(or_, [seen[on].rlike(p) for _, reason, on, p in SIGNALS if reason == r]) for r, _ in reasons}
    found = F.array_compact(F.array(*[F.when(holds[r], F.struct(F.lit(w).alias("w"), F.lit(r).alias("r"))) for r, w in reasons]))
    score = F.least(F.lit(10), F.aggregate(found, F.lit(0), lambda a, x: a + x["w"]))
    return F.struct(score.alias("score"), F.when(score >= 6, "high").when(score >= 3, "medium").otherwise("low").alias("confidence"), F.coalesce(F.try_element_at(found, F.lit(1))["r"], F.lit("in scope")).alias("reason"))


def severity(value: Column) -> Column:
    """English severity of an English or Portuguese one; INFO for others."""
    up = F.upper(F.trim(value))
    out = F.when(up.isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), up)
    for k, v in SEVERITIES.items():
        out = out.when(up == k, v)
    return out.otherwise("INFO")
