"""Queries of verdicts, lookups and queues, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import findings as fn
from ..functions import urls as u
from ..functions import verdicts as v
from ..operators import lookups
from ..sources.tables import findings, findings_sql, table, urls
from .url_plans import PARTS

Q, SQL = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_NAME = "h || CASE seq % 5 WHEN 0 THEN '.' WHEN 1 THEN '' WHEN 2 THEN '-' WHEN 3 THEN '/x' ELSE '..a' END"


@query(f"""SELECT seq, n, CASE WHEN regexp_full_match(n, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') THEN NULL ELSE n END AS domain FROM (SELECT seq, CASE WHEN regexp_full_match(x, '[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)*') AND strlen(x) <= 253 THEN x END AS n
 FROM (SELECT seq, rtrim({_NAME}, '.') AS x FROM ({PARTS}) UNION ALL SELECT -c_custkey, (c_custkey % 300) || '.1.2.3' FROM customer))""")
def url_15_dns_names(spark, d):
    k = F.col("seq") % 5
    tail = F.when(k == 0, ".").when(k == 1, "").when(k == 2, "-").when(k == 3, "/x").otherwise("..a")
    names = urls(spark, d).select("seq", F.concat(u.host(F.col("url")), tail).alias("x"))
    numbers = table(spark, d, "customer").select((-F.col("c_custkey")).alias("seq"), F.concat((F.col("c_custkey") % 300).cast("string"), F.lit(".1.2.3")).alias("x"))
    rows = names.unionByName(numbers)
    # a number above 255 is no address, but the twin tells all of four numbers apart
    return rows.select("seq", v.dns_name(F.col("x")).alias("n"), F.when(~F.col("x").rlike(f"^{v.IPV4}$"), v.dns_domain(F.col("x"))).alias("domain"))


@query("SELECT page_id AS seq, CASE WHEN page_id % 2 = 0 THEN regexp_replace(split_part(url, '#', 1), '^(?i)https?', CASE WHEN lower(url) LIKE 'https%' THEN 'https' ELSE 'http' END) ELSE split_part(url, '#', 1) END AS scope FROM pages")
def url_21_scope_url(spark, d):
    raw = F.when(F.col("seq") % 2 == 0, F.regexp_replace("url", "^http", "ws")).otherwise(F.col("url"))
    return urls(spark, d).select("seq", v.scope_url(raw).alias("scope"))


_HOST_TEXT = "regexp_extract(regexp_replace(url, '^(?i)https?://', ''), '^[^/?#:]*', 0)"


@query(f"SELECT page_id AS seq, lower({_HOST_TEXT}) AS host, trim(regexp_replace({_HOST_TEXT}, '[^a-zA-Z0-9-]+', '_', 'g'), '_') AS stem FROM pages")
def url_22_names(spark, d):
    return urls(spark, d).select("seq", v.domain_input(F.col("url")).alias("host"), v.file_stem(F.col("url")).alias("stem"))


@query("""SELECT page_id AS seq, regexp_replace(url, '[?#].*$', '') || '?a=%3Cx%3E&' || 'b=' || page_id || '&' || 'a=2' AS replaced FROM pages""")
def url_08_replace_query(spark, d):
    asked = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?a=1&b="), F.col("seq").cast("string"), F.lit("&a=2"))
    return urls(spark, d).select("seq", v.replace_query(asked, "a", "<x>").alias("replaced"))


@query("SELECT doc_id, regexp_full_match(t, '[a-zA-Z0-9.\\-_*?|^$\\s\\[\\](){}+\\\\]+') AND NOT regexp_matches(t, '\\$\\(|\\|\\||[\\n\\r]') AS ok FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def prd_12_grep_pattern(spark, d):
    return table(spark, d, "documents").select("doc_id", v.grep_pattern_ok(F.col("text")).alias("ok"))


@query("SELECT event_id, event_type IN ('view', 'click') AS safe, event_id % 6 <> 5 AS part FROM events")
def prd_26_names_and_methods(spark, d):
    k = F.col("event_id") % 6
    tags = F.when(k == 5, "main.json").otherwise(F.concat(F.lit("x"), F.element_at(F.array(*map(F.lit, v.LOG_PARTS)), (k + 1).cast("int"))))
    method = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "Head").otherwise("post")
    return table(spark, d, "events").select("event_id", v.render_method_is_safe(method).alias("safe"), v.is_log_part(F.concat(F.lit("/logs_report.d/"), tags)).alias("part"))


@query("SELECT o_orderkey, abs(o_orderkey % 900 - o_custkey % 700) > greatest(50, floor((o_custkey % 700) * 0.15)) AS changed FROM orders")
def prd_25_changed_from_baseline(spark, d):
    return table(spark, d, "orders").select("o_orderkey", v.changed_from_baseline(F.col("o_orderkey") % 900, F.col("o_custkey") % 700).alias("changed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unverified' WHEN o_orderkey % 3 = 1 AND o_custkey % 4 IN (1, 2) AND o_orderkey % 4 IN (1, 2) THEN 'wildcard_ambiguous' ELSE 'confirmed' END AS confidence FROM orders")
def cls_07_wildcard_confidence(spark, d):
    k = F.col("o_orderkey")
    state = F.when(k % 3 == 0, "unverified").when(k % 3 == 1, "detected").otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", v.wildcard_confidence(state, F.array(F.col("o_custkey") % 4, k % 4), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("confidence"))


@query("""SELECT base, arg_min(severity, event_id) AS severity, arg_min(origin, event_id) AS origin FROM (SELECT user_id AS base, event_id, 'https://o' || event_id % 3 AS origin,
 CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 0 THEN 'MEDIO' WHEN event_id % 3 = event_id % 4 THEN CASE WHEN event_id % 2 = 0 THEN 'CRITICO' ELSE 'MEDIO' END END AS severity FROM events) WHERE severity IS NOT NULL GROUP BY base""")
def rul_15_cors(spark, d):
    k = F.col("event_id")
    allowed = F.when(k % 5 == 4, "").when(k % 5 == 0, "*").otherwise(F.concat(F.lit("https://o"), (k % 4).cast("string")))
    answers = table(spark, d, "events").select(F.col("user_id").alias("base"), k.alias("seq"), F.concat(F.lit("https://o"), (k % 3).cast("string")).alias("origin"), allowed.alias("allowed"), F.when(k % 2 == 0, "True").otherwise("").alias("credentials"))
    return lookups.cors_findings(answers)


@query(f"SELECT seq, s IN ('http', 'https') AND h = 'www.example.com' AND p = '/en/0' AS canary FROM ({PARTS})")
def rul_16_open_redirect(spark, d):
    return urls(spark, d).select("seq", v.redirects_to(F.col("url"), "www.example.com", "/en/0").alias("canary"))


@query(f"SELECT seq, 'https' AS \"check\", s = 'https' AS passed, 'scheme=' || s AS detail FROM ({PARTS}) UNION ALL SELECT -event_id, 'cookie:' || event_type || ':' || m, has, n || ' flag ' || CASE WHEN has THEN 'present' ELSE 'missing' END FROM (SELECT event_id, event_type, 'secure' AS m, 'Secure' AS n, event_id % 2 = 0 AS has FROM events UNION ALL SELECT event_id, event_type, 'httponly', 'HttpOnly', event_id % 3 = 0 FROM events)")
def rul_23_validators(spark, d):
    k = F.col("event_id")
    cookie = F.concat(F.col("event_type"), F.lit("=1"), F.when(k % 2 == 0, "; Secure").otherwise(""), F.when(k % 3 == 0, "; HttpOnly").otherwise(""))
    cookies = table(spark, d, "events").select((-k).alias("seq"), F.explode(v.cookie_checks(F.array(cookie))).alias("c"))
    return urls(spark, d).select("seq", v.https_check(F.col("url")).alias("c")).unionByName(cookies).select("seq", "c.*")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'PROBABLE' WHEN 'error' THEN 'CONFIRMED' ELSE 'POSSIBLE' END AS stage FROM events")
def fn_10_event_stage(spark, d):
    said = F.when(F.col("event_type") == "click", " probable ").when(F.col("event_type") == "error", "Confirmed").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", v.event_stage(said).alias("stage"))


@query("SELECT page_id AS seq, CASE WHEN page_id % 4 = 3 THEN '' ELSE split_part(url, '#', 1) END AS found FROM pages")
def fn_18_row_url(spark, d):
    k, x = F.col("seq") % 4, F.concat(F.col("url"), F.lit("#f"))
    row = F.when(k == 0, F.to_json(F.struct(x.alias("url")))).when(k == 1, F.to_json(F.struct(F.lit("").alias("url"), F.struct(x.alias("endpoint")).alias("request")))).when(k == 2, F.to_json(F.struct(F.struct(x.alias("url")).alias("request")))).otherwise("{}")
    return urls(spark, d).select("seq", v.row_url(row).alias("found"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'paths' WHEN 1 THEN 'custom:size_' || p_size ELSE NULL END AS category, CASE p_partkey % 2 WHEN 0 THEN 'a_b-' || p_size || '.txt' ELSE 'wordlist' END AS label FROM part")
def fn_13_wordlist_names(spark, d):
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    category = F.when(k == 0, " paths").when(k == 1, F.concat(F.lit("custom: Size_"), size)).when(k == 2, "custom:a b").otherwise("other")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/x/y/..a?b-"), size, F.lit(".txt_"))).otherwise("/x/__")
    return table(spark, d, "part").select("p_partkey", v.wordlist_category(category, ("paths", "params")).alias("category"), v.wordlist_label(name).alias("label"))


#: Ends of texts that are cut: names, signs and blanks of several kinds, values that end in several ways, and what only looks like a secret.
_ENDS = (" token=abcdefgh rest", " Cookie :  a;b=c", " API_KEY=", " x-set-cookie:k v,w", " password = p\u00e4ss\u6f22,", " secret token:a secret=b", " authorization Bearer", " api-key:z")


@query("SELECT doc_id, regexp_replace(left(left(coalesce(text, ''), 470 + (doc_id % 40)::INTEGER) || [" + ", ".join(f"'{e}'" for e in _ENDS) + "][1 + doc_id % 8], 500), '(authorization|cookie|set-cookie|api[-_]?key|token|password|secret)\\s*[:=]\\s*[^\\s,;]+', '\\1=<redacted>', 'gi') AS clipped FROM documents")
def fn_06_clip(spark, d):
    k = F.col("doc_id")
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (k % 8 + 1).cast("int"))
    text = F.concat(F.substring(F.coalesce("text", F.lit("")), F.lit(1), (470 + k % 40).cast("int")), end)
    return table(spark, d, "documents").select("doc_id", v.clip(text).alias("clipped"))


@query("SELECT page_id AS seq, instr(lower(url), 'example.com') > 0 AS echoed, regexp_replace(url, 'example\\.com', '[QUERY OMITTED]', 'gi') AS omitted FROM pages")
def prd_13_fn_05_queries(spark, d):
    queries = ("Example.COM", "short")
    return urls(spark, d).select("seq", v.contains_query(F.col("url"), F.array(*map(F.lit, queries))).alias("echoed"), v.omit_queries(F.col("url"), queries).alias("omitted"))


@query("SELECT s_suppkey, 's' || s_suppkey % 9 || '|10.' || s_suppkey % 9 || '.0.0/16|2001:db8::1' AS nets FROM supplier")
def ext_26_spf(spark, d):
    k = (F.col("s_suppkey") % 9).cast("string")
    net = F.concat(F.lit("10."), k, F.lit(".0.0/16"))
    record = F.concat(F.lit("v=spf1 include:_spf.x ip4:"), net, F.lit(" IP6:2001:db8::1 ip4:"), net, F.lit(" ~all"))
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), k, F.lit("|"), F.array_join(v.spf_networks(record), "|")).alias("nets"))


_IP = "(o_orderkey % 40) || '.' || (o_custkey % 256) || '.' || (o_orderkey % 256) || '.7'"
_INSIDE = "(o_orderkey % 40 = 10) OR (o_orderkey % 40 = 20 AND o_custkey % 256 BETWEEN 64 AND 127) OR (o_orderkey % 40 BETWEEN 32 AND 35)"


@query(f"SELECT ip, min_by(o_orderkey, o_orderkey) AS host FROM (SELECT {_IP} AS ip, o_orderkey FROM orders WHERE NOT ({_INSIDE})) GROUP BY ip".replace("min_by", "arg_min"))
def jn_14_origin_candidates(spark, d):
    nets = lookups.cidr_lines(spark.createDataFrame([(" 10.0.0.0/8 ",), ("20.64.0.0/10",), ("# note",), ("32.0.0.0/6",), ("",)], "value string"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ip = F.concat_ws(".", (o % 40).cast("string"), (c % 256).cast("string"), (o % 256).cast("string"), F.lit("7"))
    return lookups.origin_candidates(table(spark, d, "orders").select(o.alias("host"), ip.alias("ip"), o.alias("seq")), nets)


@query("SELECT p_partkey AS banner, min(s_suppkey) AS row FROM part JOIN supplier ON p_brand = 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 3) WHERE (p_size % 7) = s_suppkey % 7 AND s_suppkey % 4 <> 0 GROUP BY p_partkey")
def jn_15_banner_rows(spark, d):
    s = F.col("s_suppkey")
    product = F.concat(F.lit("Brand#"), (1 + s % 5).cast("string"), (1 + s % 3).cast("string"))
    cached = table(spark, d, "supplier").select(s.alias("row"), product.alias("product"), F.concat(F.when(s % 4 == 0, "EDB-").otherwise("CVE-2024-"), s.cast("string")).alias("id"), F.concat(F.lit("Flaw in "), F.upper(product), F.lit(" v"), (s % 7).cast("string"), F.lit(".1rc;")).alias("text"))
    banners = table(spark, d, "part").select(F.col("p_partkey").alias("banner"), F.col("p_brand").alias("product"), F.concat(F.lit("V"), (F.col("p_size") % 7).cast("string"), F.lit(".1RC")).alias("version"))
    return lookups.banner_rows(banners, cached)


@query(f"SELECT ordinal AS key, seen_at AS last_seen FROM {findings_sql()} ORDER BY seen_at DESC, ordinal LIMIT 500")
def win_13_recent_findings(spark, d):
    return lookups.recent_findings(findings(spark, d).select(F.col("ordinal").alias("key"), F.col("seen_at").alias("last_seen")))


@query("SELECT page_id FROM pages ORDER BY page_id % 3 DESC, length(url) DESC, url DESC, page_id DESC LIMIT 1")
def win_14_overflow(spark, d):
    return lookups.overflow(table(spark, d, "pages"), F.desc(F.col("page_id") % 3), F.desc(F.length("url")), F.desc("url"), F.desc("page_id")).select("page_id")


@query(f"SELECT count(*) AS findings, (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM part)) AS technologies FROM {findings_sql()}")
def agg_20_run_totals(spark, d):
    found = lookups.run_totals(findings(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("name")))
    return found.select("findings", F.array_join("technologies", ",").alias("technologies"))


_W = "CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1 ELSE 0 END"


@query(f"SELECT target, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (id = 'click') AS probable, round_even(least(10.0, CAST(sum({_W}) AS DOUBLE) / count(*) + least(2.0, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) * 0.25)), 1) AS risk FROM {findings_sql()} GROUP BY target")
def agg_06_report_counts(spark, d):
    f = findings(spark, d)
    stage = v.event_stage(F.when(F.col("id") == "click", "probable"))
    stages = f.groupBy("target").agg(F.count_if(stage == "PROBABLE").alias("probable"))
    counts = fn.severity_counts(f).select("target", "critical", "high")
    return counts.join(stages, "target").join(fn.risk_scores(f).select("target", F.col("mean_bonus").alias("risk")), "target")
