"""Queries of the URL functions, and scope predicates, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as u
from ..sources.tables import links, table, urls

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_P = u.RFC3986
_g = lambda n, c="url": f"regexp_extract({c}, '{_P}', {n})"
#: parts of url in DuckDB
PARTS = f"""SELECT page_id AS seq, url, lower({_g(2)}) AS s, {_g(4)} AS a, {_g(5)} AS p, {_g(7)} AS q,
 lower(regexp_replace(regexp_replace({_g(4)}, '^.*@', ''), ':[0-9]*$', '')) AS h, regexp_extract(regexp_replace({_g(4)}, '^.*@', ''), ':([0-9]+)$', 1) AS port FROM pages"""
_AUTH = "CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN regexp_replace(h, '\\.+$', '') ELSE regexp_replace(h, '\\.+$', '') || ':' || port END"
_PATH = "CASE WHEN p = '' THEN '/' ELSE p END"
_QUERY = lambda q: f"CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"
_PAIRS = "list_filter(string_split(q, '&'), lambda x: x <> '')"


@query(f"SELECT seq, CASE WHEN s = '' OR h = '' OR a LIKE '%@%' THEN url ELSE s || '://' || {_AUTH} || {_PATH} || {_QUERY('q')} END AS url FROM ({PARTS})")
def url_01_normalize(spark, d):
    return urls(spark, d).select("seq", u.normalize(F.col("url")).alias("url"))


@query(f"""SELECT seq, s || '://' || lower(a) || CASE WHEN lower(regexp_replace(p, '/+$', '')) = '' THEN '/' ELSE lower(regexp_replace(p, '/+$', '')) END
 || CASE WHEN len({_PAIRS}) = 0 THEN '' ELSE '?' || array_to_string(list_sort({_PAIRS}), '&') END AS url FROM ({PARTS})""")
def url_02_normalize_legacy(spark, d):
    return urls(spark, d).select("seq", u.normalize_legacy(F.col("url")).alias("url"))


_TARGET = f"CASE WHEN rtrim(p, '/') = '' AND q = '' THEN s || '://' || {_AUTH} ELSE s || '://' || {_AUTH} || CASE WHEN rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END || {_QUERY('q')} END"


@query(f"SELECT seq, {_TARGET} AS target FROM ({PARTS})")
def url_03_normalize_target(spark, d):
    return urls(spark, d).select("seq", u.normalize_target(F.col("url")).alias("target"))


@query(f"SELECT min(seq) AS first_seq, target FROM (SELECT seq, {_TARGET} AS target FROM ({PARTS})) WHERE target <> '' GROUP BY target ORDER BY first_seq LIMIT 50")
def url_04_normalize_targets(spark, d):
    """The limit is the feature: the first 50 distinct targets in the order given."""
    found = urls(spark, d).select("seq", u.normalize_target(F.col("url")).alias("target")).where("target <> ''")
    return found.groupBy("target").agg(F.min("seq").alias("first_seq")).orderBy("first_seq").limit(50)


@query(f"SELECT seq, s || '://' || h || CASE WHEN port = '' THEN '' ELSE ':' || port END || {_PATH} || CASE WHEN len({_PAIRS}) = 0 THEN '' ELSE '?' || array_to_string(list_transform({_PAIRS}, lambda x: split_part(x, '=', 1) || '=%5Bredacted%5D'), '&') END AS url FROM ({PARTS})")
def url_05_sanitize(spark, d):
    return urls(spark, d).select("seq", u.sanitize(F.col("url")).alias("url"))


@query(f"""SELECT seq, CASE WHEN s IN ('http', 'https') AND a NOT LIKE '%@%' AND (h = 'example.com' OR h LIKE '%.example.com') THEN s || '://' || {_AUTH} || {_PATH}
 || CASE WHEN len({_PAIRS}) = 0 THEN '' ELSE '?' || array_to_string(list_transform({_PAIRS}, lambda x: CASE WHEN regexp_matches(split_part(x, '=', 1), '{u.SENSITIVE_KEY}') THEN split_part(x, '=', 1) || '=%5BREDACTED%5D' WHEN instr(x, '=') > 0 THEN x ELSE x || '=' END), '&') END END AS url FROM ({PARTS})""")
def url_06_in_scope(spark, d):
    return urls(spark, d).select("seq", u.in_scope(F.col("url"), "example.com").alias("url"))


_KEYS = f"list_filter(list_transform({_PAIRS}, lambda x: split_part(x, '=', 1)), lambda k: k <> '')"


@query(f"SELECT seq, array_to_string(list_distinct_ordered, ',') AS params FROM (SELECT seq, list_filter({_KEYS}, lambda k, i: list_position({_KEYS}, k) = i)[1:24] AS list_distinct_ordered FROM ({PARTS}))")
def url_09_query_params(spark, d):
    return urls(spark, d).select("seq", F.array_join(u.query_params(F.col("url")), ",").alias("params"))


@query(f"SELECT DISTINCT url, param FROM (SELECT url, unnest({_KEYS}) AS param FROM ({PARTS}))")
def url_10_urls_with_params(spark, d):
    return urls(spark, d).select("url", F.explode(u.query_params(F.col("url"), 1 << 20)).alias("param")).distinct()


@query(f"SELECT DISTINCT rtrim(p, '/') AS endpoint FROM ({PARTS}) WHERE p NOT IN ('', '/')")
def url_11_endpoints(spark, d):
    return urls(spark, d).select(u.endpoint(F.col("url")).alias("endpoint")).where("endpoint is not null").distinct()


@query(f"SELECT param, count(DISTINCT url) AS n_urls, min(seq) AS first_seq FROM (SELECT seq, url, unnest({_KEYS}) AS param FROM ({PARTS})) GROUP BY param")
def url_12_parameters(spark, d):
    found = urls(spark, d).select("seq", "url", F.explode(u.query_params(F.col("url"), 1 << 20)).alias("param"))
    return found.groupBy("param").agg(F.count_distinct("url").alias("n_urls"), F.min("seq").alias("first_seq"))


@query(f"SELECT seq, CASE WHEN s IN ('http', 'https') AND h <> '' AND a NOT LIKE '%@%' THEN s || '://' || {_AUTH} ELSE '[target omitted]' END AS target FROM ({PARTS})")
def url_13_event_target(spark, d):
    return urls(spark, d).select("seq", u.event_target(F.col("url")).alias("target"))


@query(r"""SELECT c_custkey AS id, n AS name, n <> '' AND n NOT LIKE '-%' AND length(n) <= 253 AND len(list_filter(string_split(n, '.'), lambda x: NOT regexp_full_match(x, '[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?'))) = 0 AS valid
 FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_name) || '.example' WHEN 1 THEN '-' || lower(c_name) WHEN 2 THEN replace(c_name, '#', '-') || '.org' ELSE '10.0.0.' || CAST(c_custkey % 256 AS VARCHAR) END AS n FROM customer)""")
def url_16_valid_host(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lower("c_name"), F.lit(".example"))).when(k % 4 == 1, F.concat(F.lit("-"), F.lower("c_name"))).when(k % 4 == 2, F.concat(F.regexp_replace("c_name", "#", "-"), F.lit(".org"))).otherwise(F.concat(F.lit("10.0.0."), (k % 256).cast("string")))
    return table(spark, d, "customer").select(k.alias("id"), name.alias("name")).select("id", "name", u.is_valid_host(F.col("name")).alias("valid"))


@query(f"SELECT DISTINCT s || '://' || a || unnest(['{u.WELL_KNOWN[0]}', '{u.WELL_KNOWN[1]}']) AS url FROM ({PARTS}) WHERE s <> '' AND a <> ''")
def url_18_well_known(spark, d):
    return urls(spark, d).select(F.explode(u.well_known(F.col("url"))).alias("url")).distinct()


@query(f"""WITH seeds AS (SELECT seq * 3 AS o, url FROM ({PARTS}) WHERE h = 'example.com' OR h LIKE '%.example.com' UNION ALL
 SELECT seq * 3 + i, s || '://' || a || w FROM (SELECT seq, s, a, unnest([1, 2]) AS i, unnest(['{u.WELL_KNOWN[0]}', '{u.WELL_KNOWN[1]}']) AS w FROM ({PARTS}) WHERE h = 'example.com' OR h LIKE '%.example.com'))
 SELECT url, min(o) AS ordinal FROM seeds GROUP BY url""")
def url_19_seed_urls(spark, d):
    own = urls(spark, d).where(u.host_matches(u.host(F.col("url")), "example.com"))
    all_ = own.select((F.col("seq") * 3).alias("o"), "url").unionByName(own.select("seq", F.posexplode(u.well_known(F.col("url"))).alias("i", "url")).select((F.col("seq") * 3 + F.col("i") + 1).alias("o"), "url"))
    return all_.groupBy("url").agg(F.min("o").alias("ordinal"))


@query("SELECT page_id AS seq, sha256('GET' || chr(10) || url) AS request_sha256, sha256(html) AS body_sha256 FROM pages")
def url_20_hashes(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("seq"), u.request_sha256("get", F.col("url")).alias("request_sha256"), F.sha2("html", 256).alias("body_sha256"))


@query(f"""SELECT seq, s IN ('http', 'https') AND h <> '' AND a NOT LIKE '%@%' AND (h = 'm.example.org' OR h LIKE '%.example.com' OR h = 'example.com' OR h LIKE '%.example.net')
 AND ({_PATH} = '/en' OR {_PATH} LIKE '/en/%' OR {_PATH} = '/fr' OR {_PATH} LIKE '/fr/%') AND NOT ({_PATH} LIKE '%/1%' OR h LIKE 'blog.%') AS allowed FROM ({PARTS})""")
def prd_01_scope_allows(spark, d):
    c = F.col("url")
    h, p = u.host(c), u.path(c)
    domain = (h == "m.example.org") | u.host_matches(h, "example.com") | u.host_matches(h, "*.example.net")
    prefix = u.path_in_prefix(p, "/en") | u.path_in_prefix(p, "/fr/")
    excluded = F.contains(p, F.lit("/1")) | u.host_matches(h, "blog.*")
    return urls(spark, d).select("seq", (u.scheme(c).isin("http", "https") & (h != "") & ~u.has_userinfo(c) & domain & prefix & ~excluded).alias("allowed"))


@query(f"""SELECT seq, CASE WHEN s NOT IN ('http', 'https') OR h = '' OR a LIKE '%@%' THEN 'scheme or host' WHEN NOT (h = 'example.com' OR h LIKE '%.example.com') THEN 'domain' WHEN NOT ({_PATH} = '/en' OR {_PATH} LIKE '/en/%') THEN 'path' WHEN NOT regexp_matches(url, '[0-9]{{3}}') THEN 'regex' WHEN h LIKE 'm.%' THEN 'excluded' END AS reason FROM ({PARTS})""")
def prd_02_scope_guard(spark, d):
    c = F.col("url")
    reason = F.when(~u.scheme(c).isin("http", "https") | (u.host(c) == "") | u.has_userinfo(c), "scheme or host").when(~u.host_matches(u.host(c), "example.com"), "domain").when(~u.path_in_prefix(u.path(c), "/en"), "path").when(~c.rlike("[0-9]{3}"), "regex").when(u.host_matches(u.host(c), "m.*"), "excluded")
    return urls(spark, d).select("seq", reason.alias("reason"))


@query(f"SELECT seq, h = 'example.com' OR h LIKE '%.example.com' AS plain, h LIKE '%.example.net' AS below, regexp_full_match(h, '.\\..*\\.example\\.org') AS glob FROM ({PARTS})")
def prd_04_host_rules(spark, d):
    h = u.host(F.col("url"))
    return urls(spark, d).select("seq", u.host_matches(h, "example.com").alias("plain"), u.host_matches(h, "*.example.net").alias("below"), u.host_matches(h, "?.*.example.org").alias("glob"))


@query(f"SELECT seq, {_PATH} = '/en' OR {_PATH} LIKE '/en/%' AS en, {_PATH} = '/e' OR {_PATH} LIKE '/e/%' AS e FROM ({PARTS})")
def prd_05_path_prefix(spark, d):
    p = u.path(F.col("url"))
    return urls(spark, d).select("seq", u.path_in_prefix(p, "/en/").alias("en"), u.path_in_prefix(p, "e").alias("e"))


#: allow, pattern
ROBOTS = ((False, "/en/"), (True, "/en/1"), (False, "/fr/*2"), (True, "/fr/"), (False, "/de/"), (True, "/de/"), (False, "/*.html$"))


@query(f"""WITH rules(allow, pat, rx, len) AS (VALUES {", ".join("(%s, '%s', '%s', %d)" % (a, p, "^" + p.replace(".", "\\.").replace("*", ".*"), len(p.replace("*", "").replace("$", ""))) for a, p in ROBOTS)}),
 hits AS (SELECT seq, max(len * 2 + CASE WHEN allow THEN 1 ELSE 0 END) AS best FROM (SELECT seq, {_PATH} || {_QUERY('q')} AS t FROM ({PARTS})) JOIN rules ON regexp_matches(t, rx) GROUP BY seq)
 SELECT page_id AS seq, COALESCE(best % 2 = 1, true) AS allowed FROM pages LEFT JOIN hits ON page_id = seq""")
def prd_06_robots_allows(spark, d):
    from ..operators.robots import allows

    return urls(spark, d).select("seq", allows(F.col("url"), ROBOTS).alias("allowed"))


@query(f"SELECT seq, regexp_matches(lower(p), '\\.(pdf|txt|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z|tar|gz|bz2|exe|msi|iso|img|sql|db|bak|old|log|csv)$') AS is_file FROM ({PARTS})")
def prd_17_file_url(spark, d):
    from ..functions.predicates import is_file_url

    return urls(spark, d).select("seq", is_file_url(F.col("url")).alias("is_file"))


@query(f"""SELECT seq, rank, depth, discovery, parameter FROM (SELECT seq, depth, discovery, parameter, row_number() OVER (ORDER BY depth, discovery, parameter, seq) AS rank FROM (
 SELECT min(seq) AS seq, len(regexp_extract_all(any_value(p), '/')) AS depth, CASE WHEN regexp_matches(lower(any_value(n)), '\\.js|api|graphql|openapi|swagger|sitemap|robots') THEN 0 ELSE 1 END AS discovery, CASE WHEN instr(any_value(n), '?') > 0 THEN 1 ELSE 0 END AS parameter
 FROM (SELECT *, CASE WHEN s = '' OR h = '' OR a LIKE '%@%' THEN url ELSE s || '://' || {_AUTH} || {_PATH} || {_QUERY('q')} END AS n FROM ({PARTS})) GROUP BY n) WHERE depth <= 2) WHERE rank <= 200""")
def win_07_frontier(spark, d):
    """The cap is the feature: max_items of the frontier."""
    from ..operators.frontier import schedule

    found = urls(spark, d).withColumn("depth", F.regexp_count(u.path(F.col("url")), F.lit("/")).cast("long"))
    return schedule(found, max_depth=2, max_items=200).select("seq", "rank", "depth", "discovery", "parameter")


@query(f"""SELECT seq, CASE WHEN regexp_matches(lower(url), '/admin|/administrator|/login|/signin|/dashboard|/cpanel|/wp-admin') THEN '[Admin/Login]' WHEN regexp_matches(lower(url), '/api|/swagger|/v1|/v2|/v3|/graphql|/api-docs') THEN '[API]'
 WHEN instr(url, '?') > 0 AND instr(url, '=') > 0 THEN '[Parametros]' WHEN regexp_matches(lower(url), '/backup|/dump|/sql|/database|/config|/settings|/\\.env|/\\.git') THEN '[Config/Backup]' WHEN regexp_matches(lower(url), '/debug|/test|/dev|/stage|/staging|/beta') THEN '[Teste/Dev]'
 WHEN regexp_matches(lower(url), '\\.(pdf|doc|docx|xls|xlsx|zip|rar|sql|bak|log)$') THEN '[Arquivo]' ELSE '[Comum]' END AS kind FROM (SELECT page_id AS seq, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages)""")
def cls_02_link_class(spark, d):
    from ..functions.classify import link_class

    return links(spark, d).select("seq", link_class(F.col("href")).alias("kind"))


def first_by(df, keys, order):
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
