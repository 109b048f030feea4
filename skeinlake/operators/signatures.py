"""Signature tables over responses: services, errors, versions, methods, headers, technologies, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u
from ..functions.predicates import contains_any
from .rules import header

#: Services by what they answer for a name that nobody claims.
TAKEOVER = (
    ("GitHub Pages", "There isn't a GitHub Pages site here"), ("Heroku", "No such app"), ("Fastly", "Fastly error: unknown domain"), ("Shopify", "Sorry, this shop is currently unavailable"), ("Tumblr", "There's nothing here"),
    ("WordPress.com", "Do you want to register"), ("Ghost", "The thing you were looking for is no longer here"), ("Surge.sh", "project not found"), ("AWS S3", "NoSuchBucket"), ("Azure", "404 Web Site not found"), ("Pantheon", "The gods are wise"),
    ("Zendesk", "Help Center Closed"), ("Unbounce", "The requested URL was not found"), ("HubSpot", "Domain not found"), ("Bitbucket", "Repository not found"), ("Intercom", "This page is reserved for artistic inspiration"),
    ("Freshdesk", "There is no helpdesk here"), ("Fly.io", "404 Not Found"), ("Netlify", "Not Found - Request ID"), ("ReadTheDocs", "unknown to Read the Docs"), ("Tilda", "Please renew your subscription"),
)
#: Expected headers and how grave their absence is.
HEADERS = (
    ("strict-transport-security", "MEDIUM"), ("content-security-policy", "MEDIUM"), ("x-frame-options", "LOW"), ("x-content-type-options", "LOW"), ("referrer-policy", "INFO"), ("permissions-policy", "INFO"), ("cross-origin-opener-policy", "INFO"),
    ("cross-origin-resource-policy", "INFO"), ("cache-control", "INFO"),
)
#: Name, pattern, first safe version.
VERSIONS = (
    ("Apache", r"Apache/([12]\.\d+\.\d+)", "2.4.50"), ("nginx", r"nginx/(\d+\.\d+\.\d+)", "1.24.0"), ("PHP", r"PHP/(\d+\.\d+\.\d+)", "8.1.0"), ("OpenSSL", r"OpenSSL/(\d+\.\d+\.\d+)", "3.0.0"), ("IIS", r"IIS/(\d+\.\d+)", "10.0"),
    ("Tomcat", r"Tomcat/(\d+\.\d+\.\d+)", "9.0.70"),
)
#: Kinds of errors by their text.
ERRORS = (
    ("Python Traceback", r"Traceback \(most recent call last\)"), ("Java Stack Trace", r"at [\w\$]+\.[\w\$]+\([\w\.]+:\d+\)"), ("ASP.NET Exception", r"System\.Web\.Http|System\.Web\.Mvc|\.NET Framework"),
    ("PHP Fatal Error", r"Fatal error:.+in .+\.php on line \d+"), ("PHP Warning", r"<b>Warning</b>:.+on line <b>\d+</b>"), ("Rails Error", r"ActiveRecord::\w+Error|ActionController::\w+Error"), ("Django Error", r"django\.core\.exceptions|Django Version:"),
    ("Oracle Error", r"ORA-\d{5}:"), ("MySQL Error", r"You have an error in your SQL syntax|MySQL server version"), ("MSSQL Error", r"Microsoft OLE DB Provider for SQL Server"), ("PostgreSQL Error", r"pg_query\(\)|ERROR:  syntax error at or near"),
    ("MongoDB Error", r"MongoError:|MongoServerError:"), ("PDO SQL Error", r"SQLSTATE\["), ("Node.js Error", r"Error: Cannot find module|UnhandledPromiseRejection"),
    ("Spring Boot Error", r"org\.springframework\.|java\.lang\.\w+Exception"),
)
LISTING = ("Index of /", "Directory listing for", "Parent Directory", "[PARENTDIR]", "<title>Index of", "Last modified</a>")
METHODS = ("PUT", "DELETE", "TRACE", "CONNECT")
#: Parameter names by what they may feed.
PARAMETERS = {
    "ldap_injection": ("username", "user", "uid", "cn", "dn", "filter", "search"), "nosql_injection": ("query", "filter", "where", "search", "username", "id"), "ssti": ("template", "view", "name", "content", "message", "subject"),
    "ssrf": ("url", "uri", "dest", "destination", "redirect", "next", "target", "callback", "webhook"),
}


def first_match(text: Column, table, how=lambda t, p: t.rlike(p)) -> Column:
    """The name of the first entry whose pattern text has."""
    out = None
    for name, pattern in table:
        out = F.when(how(text, pattern), name) if out is None else out.when(how(text, pattern), name)
    return out


def takeover(body: Column) -> Column:
    return first_match(F.lower(body), [(n, m.lower()) for n, m in TAKEOVER], lambda t, m: F.contains(t, F.lit(m)))


def error_kind(body: Column) -> Column:
    return first_match(body, ERRORS)


def is_listing(status: Column, body: Column) -> Column:
    return (status == 200) & contains_any(body, LISTING)


def missing_headers(headers: Column) -> Column:
    """struct(header, severity) of each expected header that isn't there."""
    return F.filter(F.array(*[F.struct(F.lit(h).alias("header"), F.lit(s).alias("severity")) for h, s in HEADERS]), lambda x: ~F.map_contains_key(headers, x["header"]))


def versions(headers: Column, compare: bool = False) -> Column:
    """struct(software, version, safe_from) of the versions that headers tell; with compare only of those before safe_from."""
    from .correlate import version_key

    text = F.array_join(F.flatten(F.map_values(headers)), " ")
    every = []
    for name, pattern, safe in VERSIONS:
        v = F.regexp_extract(text, pattern, 1)
        holds = v != ""
        if compare:
            holds = holds & (version_key(v) < version_key(F.lit(safe)))
        every.append(F.when(holds, F.struct(F.lit(name).alias("software"), v.alias("version"), F.lit(safe).alias("safe_from"))))
    return F.array_compact(F.array(*every))


def dangerous_methods(allow: Column) -> Column:
    up = F.upper(F.coalesce(allow, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(up, F.lit(m)), m) for m in METHODS]))


def technologies(headers: Column, body: Column) -> Column:
    """struct(name, version, source, confidence) of what headers and body give away; the first of equal (name, version) counts."""
    low = F.lower(F.coalesce(body, F.lit("")))
    h = lambda n: F.coalesce(header(headers, n), F.lit(""))
    has = lambda *marks: contains_any(low, marks)

    def tech(holds: Column, name: str | Column, version: Column | None, source: str, confidence: str | Column) -> Column:
        text = lambda c: F.lit(c) if isinstance(c, str) else c
        return F.when(holds, F.struct(text(name).alias("name"), (F.lit(None).cast("string") if version is None else version).alias("version"), F.lit(source).alias("source"), text(confidence).alias("confidence")))

    def family(n: str) -> Column:
        shown = F.trim(F.split_part(h(n), F.lit("/"), F.lit(1)))
        known = F.lower(shown).isin("nginx", "apache", "php", "openresty", "microsoft-iis", "express")
        v = F.regexp_extract(h(n), r"/v?([0-9]+(?:\.[0-9]+)*)", 1)
        return tech(h(n) != "", shown, F.when(known & (v != ""), v), f"header:{n}", "MEDIUM")

    press = F.regexp_extract(F.coalesce(body, F.lit("")), r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*wordpress[/ ]([0-9.]+)""", 1)
    every = [
        family("server"), family("x-powered-by"), tech(has("wp-content/", "wp-includes/"), "WordPress", F.nullif(press, F.lit("")), "html", F.when(press != "", "HIGH").otherwise("MEDIUM")), tech(low.rlike("__next_data__|/_next/static/"), "Next.js", None, "html", "MEDIUM"),
        tech(has("graphql"), "GraphQL", None, "html", "LOW"), tech(has("swagger-ui") | (has("swagger") & has("openapi")), "Swagger/OpenAPI", None, "html", "MEDIUM"), tech(low.rlike(r"react(?:\.|/| )"), "React", None, "html", "LOW"),
        tech(F.contains(F.lower(h("set-cookie")), F.lit("laravel_session")) | has("laravel"), "Laravel", None, "header/html", "MEDIUM"), tech(F.contains(F.lower(h("x-powered-by")), F.lit("django")) | has("csrfmiddlewaretoken"), "Django", None, "header/html", "MEDIUM"),
        tech(has("__vite", "/@vite/client"), "Vite", None, "html", "MEDIUM"), tech(F.contains(F.lower(h("server")), F.lit("cloudflare")) | F.map_contains_key(headers, F.lit("cf-ray")), "Cloudflare", None, "header", "HIGH"),
    ]
    found = F.array_compact(F.array(*every))
    same = lambda a, b: (F.lower(a["name"]) == F.lower(b["name"])) & a["version"].eqNullSafe(b["version"])
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: same(x, y)))


def parameter_candidates(rows: DataFrame, url: str = "url") -> DataFrame:
    """(url, param, category) of query keys whose names are in one of the sets."""
    pairs = rows.select(F.col(url).alias("url"), F.explode(u.query_params(F.col(url), 1 << 20)).alias("param")).distinct()
    every = F.array_compact(F.array(*[F.when(F.lower("param").isin(*names), k) for k, names in PARAMETERS.items()]))
    return pairs.select("url", "param", F.explode(every).alias("category"))


def differential(pairs: DataFrame) -> DataFrame:
    """pairs (base_status, base_length, base_sig, status1, length1, sig1, status2, length2, sig2) with confirmed: a signature that the baseline lacks stands in two like answers."""
    near = F.abs(F.col("length1") - F.col("length2")) <= F.greatest(F.lit(64), F.floor(F.greatest("length1", "length2") * 0.10))
    holds = (F.coalesce("base_sig", F.lit("")) == "") & (F.coalesce("sig1", F.lit("")) != "") & (F.lower("sig1") == F.lower("sig2")) & (F.col("status1") == F.col("status2")) & near
    return pairs.withColumn("confirmed", F.coalesce(holds, F.lit(False)))
