"""Queries of rules, signatures and scanners over pages taken as responses, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as u
from ..functions import web
from ..operators import frontier, rules, signatures, sinks
from ..sources.tables import findings, findings_sql, links, table, urls
from .url_plans import PARTS

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def responses(spark, d):
    """Pages as responses: status and headers follow from page_id."""
    k = F.col("page_id")
    server = F.when(k % 3 == 0, F.concat(F.lit("nginx/1."), (k % 30).cast("string"), F.lit(".0"))).when(k % 3 == 1, "Apache/2.4.49").otherwise("cloudflare")
    headers = F.map_filter(
        F.create_map(F.lit("server"), F.array(server), F.lit("content-type"), F.array(F.lit("text/html")), F.lit("x-content-type-options"), F.when(k % 2 == 0, F.array(F.lit("nosniff"))), F.lit("allow"), F.when(k % 5 == 0, F.array(F.lit("GET, put, Trace")))),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, d, "pages").select(k.alias("obs_id"), "url", F.when(k % 7 == 0, 500).otherwise(200).alias("status"), headers.alias("headers"), F.col("html").alias("body"))


_R = "SELECT page_id AS obs_id, url, html AS body, CASE WHEN page_id % 7 = 0 THEN 500 ELSE 200 END AS status, CASE page_id % 3 WHEN 0 THEN 'nginx/1.' || CAST(page_id % 30 AS VARCHAR) || '.0' WHEN 1 THEN 'Apache/2.4.49' ELSE 'cloudflare' END AS server, page_id % 2 = 0 AS nosniff, CASE WHEN page_id % 5 = 0 THEN 'GET, put, Trace' END AS allow FROM pages"


def _passive(spark, d):
    return responses(spark, d).select(F.explode(rules.passive(F.col("url"), F.col("headers"), F.col("body"))).alias("f")).select("f.id")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(f"""SELECT id, count(*) AS n FROM (SELECT unnest([CASE WHEN true THEN 'headers.csp' END, CASE WHEN NOT nosniff THEN 'headers.xcto' END, CASE WHEN lower(url) LIKE 'https://%' THEN 'tls.hsts' END, 'headers.referrer-policy',
 CASE WHEN lower(url) LIKE 'https://%' AND regexp_matches(body, '(?i)(src|href)=["'']http://') THEN 'mixed-content-reference' END, CASE WHEN regexp_matches(server, '[0-9]') THEN 'server-disclosure' END]) AS id FROM ({_R})) WHERE id IS NOT NULL GROUP BY id""")
def rul_01_passive(spark, d):
    """The passive findings about headers and transport; those about bodies are rul_01_passive_bodies."""
    return _passive(spark, d).where(~F.col("id").isin(*rules.BODY_RULES)).groupBy("id").agg(F.count("*").alias("n"))


_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_PRIVATE = rf"(^|[^0-9.])(10\.{_OCTET}|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\.{_OCTET}\.{_OCTET}($|[^0-9.]|\.($|[^0-9]))"
_BODY = {
    "directory-listing": " AND ".join(f"regexp_matches(body[1:20000], {_text(x)})" for x in (rules.LISTING_HEAD, rules.LISTING_LINK)),
    "source-map-reference": r"regexp_matches(body, '(?i)sourceMappingURL=[^\n\r\x{85}\x{2028}\x{2029}]*\.map\b')",
    "possible-secret-disclosure": f"regexp_matches(body, {_text(rules.SECRET)})",
    "debug-information-disclosure": f"regexp_matches(body[1:100000], {_text(rules.DEBUG)})",
    "phpinfo-page-exposed": f"regexp_matches(body[1:100000], {_text(rules.PHPINFO)}) AND contains(lower(body[1:100000]), 'php version') AND contains(lower(body[1:100000]), 'loaded configuration file')",
    "private-address-disclosure": f"regexp_matches(body[1:100000], {_text(_PRIVATE)})",
}


@query(f"SELECT id, count(*) AS n FROM (SELECT unnest([{', '.join(f'CASE WHEN {v} THEN {_text(k)} END' for k, v in _BODY.items())}]) AS id FROM ({_R})) WHERE id IS NOT NULL GROUP BY id")
def rul_01_passive_bodies(spark, d):
    return _passive(spark, d).where(F.col("id").isin(*rules.BODY_RULES)).groupBy("id").agg(F.count("*").alias("n"))


@query(f"""SELECT id, count(*) AS n FROM (SELECT unnest(['permissions-policy-missing', 'csp-missing', CASE WHEN regexp_matches(upper(allow), 'TRACE') THEN 'http-trace-advertised' END, 'corp-missing', CASE WHEN status >= 500 AND regexp_matches(body[1:150000], '(?i)(exception|traceback|stack trace|line [0-9]+)') THEN 'server-error-detail-confirmed' END]) AS id FROM ({_R})) WHERE id IS NOT NULL GROUP BY id""")
def rul_02_extended(spark, d):
    found = responses(spark, d).select(F.explode(rules.extended(F.col("url"), F.col("status"), F.col("headers"), F.col("body"))).alias("f"))
    return found.groupBy("f.id").agg(F.count("*").alias("n"))


@query(f"SELECT obs_id, array_to_string(list_filter([CASE WHEN lower(url) LIKE 'http://%' THEN 'ssl-tls.http-only' END, CASE WHEN regexp_matches(server, '[0-9]') THEN 'information-disclosure.server' END, CASE WHEN NOT nosniff THEN 'headers-security.xcto' END], lambda x: x IS NOT NULL), ',') AS ids FROM ({_R})")
def rul_03_categories(spark, d):
    return responses(spark, d).select("obs_id", F.array_join(F.transform(rules.categories(F.col("url"), F.col("headers"), F.col("body")), lambda f: f["id"]), ",").alias("ids"))


TEMPLATES = (
    {"id": "has-ad", "matchers": [{"type": "word", "values": ['CLASS="AD"', "never there"]}]},
    {"id": "errors-in-french", "matchers-condition": "and", "matchers": [{"type": "status", "values": [500]}, {"type": "regex", "values": ['lang="fr"']}]},
    {"id": "no-nginx", "matchers": [{"type": "word", "part": "header", "negative": True, "values": ["NGINX"]}]},
)


@query(f"""SELECT obs_id, array_to_string(list_filter([CASE WHEN instr(lower(body[1:20000]), 'class="ad"') > 0 THEN 'has-ad' END, CASE WHEN status = 500 AND regexp_matches(body[1:20000], '(?i)lang="fr"') THEN 'errors-in-french' END, CASE WHEN server NOT LIKE 'nginx%' THEN 'no-nginx' END], lambda x: x IS NOT NULL), ',') AS matched FROM ({_R})""")
def rul_08_templates(spark, d):
    held = responses(spark, d).withColumn("headers_text", F.array_join(F.flatten(F.map_values("headers")), "\n"))
    return rules.evaluate(held, TEMPLATES).select("obs_id", F.array_join("matched", ",").alias("matched"))


@query(f"SELECT header, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT nosniff THEN 'x-content-type-options' END, {', '.join(repr(h) for h, _ in signatures.HEADERS if h != 'x-content-type-options')}]) AS header FROM ({_R})) WHERE header IS NOT NULL GROUP BY header")
def rul_10_missing_headers(spark, d):
    return responses(spark, d).select(F.explode(signatures.missing_headers(F.col("headers"))).alias("m")).groupBy("m.header").agg(F.count("*").alias("n"))


@query(f"SELECT obs_id, CASE WHEN server LIKE 'nginx%' THEN 'nginx' ELSE 'Apache' END AS software, split_part(server, '/', 2) AS version FROM ({_R}) WHERE server <> 'cloudflare'")
def rul_11_versions(spark, d):
    return responses(spark, d).select("obs_id", F.explode(signatures.versions(F.col("headers"))).alias("v")).select("obs_id", "v.software", "v.version")


_TAKE = "CASE " + " ".join("WHEN instr(lower(t), '{}') > 0 THEN '{}'".format(m.lower().replace("'", "''"), n) for n, m in signatures.TAKEOVER) + " END"


@query(f"SELECT doc_id, {_TAKE} AS service FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' no such app' WHEN 1 THEN ' There''s nothing here, 404 not found' WHEN 2 THEN ' nosuchbucket' ELSE '' END AS t FROM documents)")
def rul_12_takeover(spark, d):
    k = F.col("doc_id") % 4
    t = F.concat("text", F.when(k == 0, " no such app").when(k == 1, " There's nothing here, 404 not found").when(k == 2, " nosuchbucket").otherwise(""))
    return table(spark, d, "documents").select("doc_id", signatures.takeover(t).alias("service"))


_ERR = "CASE " + " ".join("WHEN regexp_matches(t, '{}') THEN '{}'".format(p.replace("'", "''"), n) for n, p in signatures.ERRORS) + " END"


@query(f"SELECT doc_id, {_ERR} AS kind, status = 200 AND instr(t, 'Parent Directory') > 0 AS listing FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 200 ELSE 404 END AS status, text || CASE doc_id % 5 WHEN 0 THEN ' ORA-00942: x' WHEN 1 THEN ' SQLSTATE[42] in MongoError: x' WHEN 2 THEN ' Parent Directory' ELSE '' END AS t FROM documents)")
def rul_13_errors_listings(spark, d):
    k = F.col("doc_id")
    t = F.concat("text", F.when(k % 5 == 0, " ORA-00942: x").when(k % 5 == 1, " SQLSTATE[42] in MongoError: x").when(k % 5 == 2, " Parent Directory").otherwise(""))
    return table(spark, d, "documents").select("doc_id", signatures.error_kind(t).alias("kind"), signatures.is_listing(F.when(k % 2 == 0, 200).otherwise(404), t).alias("listing"))


@query(f"SELECT obs_id, CASE WHEN allow IS NULL THEN '' ELSE 'PUT,TRACE' END AS dangerous FROM ({_R})")
def rul_14_methods(spark, d):
    return responses(spark, d).select("obs_id", F.array_join(signatures.dangerous_methods(rules.header(F.col("headers"), "allow")), ",").alias("dangerous"))


@query(f"SELECT obs_id, split_part(server, '/', 1) AS name, CASE WHEN server LIKE '%/%' THEN split_part(server, '/', 2) END AS version FROM ({_R}) WHERE server <> 'cloudflare' UNION ALL SELECT obs_id, 'cloudflare', NULL FROM ({_R}) WHERE server = 'cloudflare'")
def rul_18_fingerprint(spark, d):
    found = responses(spark, d).select("obs_id", F.explode(signatures.technologies(F.col("headers"), F.col("body"))).alias("t"))
    return found.where("t.source = 'header:server'").select("obs_id", "t.name", "t.version")


@query(f"""SELECT DISTINCT url, param, category FROM (SELECT url, unnest(list_transform(string_split(regexp_extract(url, '[?](.*)$', 1), '&'), lambda x: split_part(x, '=', 1))) AS param FROM (
 SELECT regexp_replace(url, '#.*$', '') || CASE WHEN instr(url, '?') > 0 THEN '&Search=1' ELSE '?Search=1' END AS url FROM pages)) JOIN (VALUES {", ".join(f"('{n}', '{k}')" for k, names in signatures.PARAMETERS.items() for n in names)}) c(name, category) ON lower(param) = name""")
def rul_21_parameters(spark, d):
    return signatures.parameter_candidates(urls(spark, d).withColumn("url", F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.instr("url", "?") > 0, "&Search=1").otherwise("?Search=1"))))


@query()
def rul_04_all_findings(spark, d):
    """All rules, first wins, with stage and score."""
    return rules.all_findings(responses(spark, d)).select("obs_id", "id", "severity", "stage", "score")


@query()
def ext_01_bundle(spark, d):
    b = web.with_bundle(table(spark, d, "pages")).select("page_id", "bundle.*")
    return b.select("page_id", F.size("urls").alias("n_urls"), F.size("forms").alias("n_forms"), F.size("js_endpoints").alias("n_endpoints"), F.array_join("scripts", " ").alias("scripts"))


@query()
def ext_10_javascript(spark, d):
    scripts = table(spark, d, "pages").select("page_id", "url", F.concat(F.regexp_extract("html", r"(?is)<script>(.*?)</script>", 1), F.lit(";fetch('/api/p/"), F.col("page_id").cast("string"), F.lit("')")).alias("source"))
    return web.with_analysis(scripts).select("page_id", F.array_join("analysis.urls", " ").alias("urls"))


@query()
def ext_20_main_text(spark, d):
    return web.with_main_text(table(spark, d, "pages").select("page_id", "html")).select("page_id", F.length("main_text").alias("n"), F.sha2("main_text", 256).alias("sha"))


@query()
def agg_15_simhash(spark, d):
    return web.with_simhash(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "simhash")


#: The names of the pages' query parameters are plain, so that a twin can hide their values with one pattern; a query without = and a fragment behind it are told apart.
_REDACTED = "CASE WHEN instr(url, '?') = 0 THEN url WHEN instr(split_part(split_part(url, '#', 1), '?', 2), '=') = 0 THEN split_part(url, '?', 1) || '?query=%5BREDACTED%5D' ELSE regexp_replace(split_part(url, '#', 1), '([?&])([A-Za-z0-9_.~-]+)=[^&]*', '\\1\\2=%5BREDACTED%5D', 'g') END"


@query(f"SELECT page_id, 'see ' || {_REDACTED.replace('url', 'u')} || ' and token=<redacted>' AS safe FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '?a=' || page_id || '&b_c=x%20y' WHEN 1 THEN '?plain' WHEN 2 THEN '?q=1#part' ELSE '' END AS u FROM pages WHERE instr(url, '?') = 0 AND instr(url, '#') = 0) UNION ALL SELECT page_id, 'see ' || {_REDACTED} || ' and token=<redacted>' FROM pages WHERE instr(url, '?') > 0 OR instr(url, '#') > 0")
def fn_01_redact(spark, d):
    k, plain = F.col("page_id") % 4, (F.instr("url", "?") == 0) & (F.instr("url", "#") == 0)
    tail = F.when(~plain, "").when(k == 0, F.concat(F.lit("?a="), F.col("page_id").cast("string"), F.lit("&b_c=x%20y"))).when(k == 1, "?plain").when(k == 2, "?q=1#part").otherwise("")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("see "), "url", tail, F.lit(" and token: abcdef")).alias("t"))
    return web.with_redacted(rows, "t", "safe").select("page_id", "safe")


@query(f"SELECT DISTINCT u AS resolved FROM (SELECT s || '://' || a || href AS u FROM ({PARTS}) JOIN (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) l ON l.page_id = seq WHERE regexp_full_match(href, '/[A-Za-z0-9]+'))")
def url_17_urljoin(spark, d):
    found = links(spark, d).join(urls(spark, d), "seq").where(F.col("href").rlike("^/[A-Za-z0-9]+$"))
    return web.with_joined(found, "url", "href").select("resolved").distinct()


@query(f"SELECT lower(severity) AS severity, CAST(count(*) AS BIGINT) AS n FROM {findings_sql(50)} GROUP BY severity")
def snk_10_severity_shares(spark, d):
    return sinks.severity_shares(findings(spark, d, 50).withColumn("all", F.lit(1)), "all").select(F.lower("severity").alias("severity"), "n")


@query(f"SELECT ordinal, upper(severity) AS severity, id AS name, '' AS cwe FROM {findings_sql(50)}")
def snk_04_csv(spark, d):
    f = findings(spark, d, 50)
    return sinks.findings_csv(f.withColumn("name", F.col("id")).withColumn("evidence", F.col("ordinal").cast("string"))).select(F.col("evidence").cast("long").alias("ordinal"), "severity", "name", "cwe")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey % 997 AS s, l_partkey % 997 AS t FROM lineitem ), r(node, depth) AS (SELECT 1, 0 UNION SELECT l.t, r.depth + 1 FROM r JOIN l ON l.s = r.node WHERE r.depth < 3) SELECT CAST(node AS VARCHAR) AS url, min(depth) AS depth FROM r GROUP BY node""")
def win_10_bfs(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_suppkey") % 997).cast("string").alias("source"), (F.col("l_partkey") % 997).cast("string").alias("target")).distinct()  # noqa: E741
    return frontier.expand(l, spark.createDataFrame([("1",)], "url string"), 3)


@query(f"""SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN depth > 2 THEN 'depth' WHEN NOT (h = 'example.com' OR h LIKE '%.example.com') THEN 'scope' WHEN rn > 1 THEN 'duplicate' ELSE 'scheduled' END AS disposition FROM (
 SELECT *, row_number() OVER (PARTITION BY s, h, p, q ORDER BY seq) AS rn, len(regexp_extract_all(p, '/')) AS depth FROM ({PARTS}))) GROUP BY disposition""")
def win_09_schedule_gate(spark, d):
    c = F.col("url")
    rows = urls(spark, d).withColumn("key", u.normalize(c))
    first = rows.groupBy("key").agg(F.min("seq").alias("first"))
    word = F.when(F.regexp_count(u.path(c), F.lit("/")) > 2, "depth").when(~u.host_matches(u.host(c), "example.com"), "scope").when(F.col("seq") > F.col("first"), "duplicate").otherwise("scheduled")
    return rows.join(first, "key").groupBy(word.alias("disposition")).agg(F.count("*").alias("n"))
