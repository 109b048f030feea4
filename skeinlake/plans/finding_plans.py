"""Queries over findings, advisories, events and pages, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, predicates
from ..functions import findings as fn
from ..functions import urls as u
from ..operators import correlate, dedupe
from ..sources.tables import ADVISORIES_SQL, TECHNOLOGIES_SQL, advisories, findings, findings_sql, table, technologies, urls
from .url_plans import PARTS

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_W = "CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1 ELSE 0 END"
_RISK = f"""SELECT target, count(*) AS n, count(*) FILTER (severity <> 'INFO') AS k, sum({_W}) AS w, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS top,
 count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info FROM {findings_sql()} GROUP BY target"""


@query(f"SELECT target, critical, high, medium, low, info, CASE WHEN k = 0 THEN 0.0 ELSE round_even(least(10.0, CAST(w AS DOUBLE) / 2.0), 1) END AS risk FROM ({_RISK})")
def entry_severity_risk(spark, d):
    """Events as findings, filtered by category, counted by severity and scored for each target."""
    found = findings(spark, d).where(predicates.matches_category("", F.col("id")))
    return fn.severity_counts(found).join(fn.risk_scores(found).select("target", F.col("saturating").alias("risk")), "target")


@query(f"SELECT target, critical, high, medium, low, info FROM ({_RISK})")
def agg_01_severity_counts(spark, d):
    return fn.severity_counts(findings(spark, d))


def _risk(column: str):
    return lambda spark, d: fn.risk_scores(findings(spark, d)).select("target", F.col(column).alias("risk"))


for _name, _column, _sql in (
    ("agg_02_risk_mean_bonus", "mean_bonus", "round_even(least(10.0, CAST(w AS DOUBLE) / greatest(1, n) + least(2.0, CAST(top AS DOUBLE) * 0.25)), 1)"),
    ("agg_03_risk_mean", "mean", "CASE WHEN k = 0 THEN 0.0 ELSE round_even(least(10.0, CAST(w AS DOUBLE) / k), 1) END"),
    ("agg_04_risk_saturating", "saturating", "CASE WHEN k = 0 THEN 0.0 ELSE round_even(least(10.0, CAST(w AS DOUBLE) / 2.0), 1) END"),
    ("agg_05_risk_legacy", "legacy", "CAST(0.0 AS DOUBLE)"),
):
    Q[_name] = _risk(_column)
    SQL[_name] = f"SELECT target, CAST({_sql} AS DOUBLE) AS risk FROM ({_RISK})"


@query("SELECT user_id, count(*) AS responses, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, count(*) FILTER (json_extract_string(props, '$.k') = '1') AS rate_limited, count(*) FILTER (event_type = 'error') AS server_errors FROM events GROUP BY user_id")
def agg_07_telemetry_counters(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.get_json_object("props", "$.k") == "1", 429).when(F.col("event_type") == "error", 500).otherwise(200)
    return e.groupBy("user_id").agg(F.count("*").alias("responses"), F.sum(F.col("event_id") % 1000).cast("long").alias("bytes"), F.count_if(F.get_json_object("props", "$.k") == "1").alias("rate_limited"), F.count_if((F.col("event_type") == "error") & (status >= 429)).alias("server_errors"))


@query("SELECT user_id, len(l) AS samples, round(median, 6) AS median, l[least(len(l), CAST(floor(0.95 * len(l)) AS BIGINT) + 1)] AS p95 FROM (SELECT user_id, list_sort(list(value)) AS l, quantile_cont(value, 0.5) AS median FROM events WHERE value IS NOT NULL GROUP BY user_id)")
def agg_08_latency_snapshot(spark, d):
    """Median of the two middles, and the 95th percentile by index, not interpolated."""
    from ..operators.metrics import latency_snapshot

    return latency_snapshot(table(spark, d, "events"), "user_id", "value").select("user_id", "samples", F.round("median", 6).alias("median"), "p95")


@query("SELECT event_type AS metric, round(quantile_cont(value, 0.5), 6) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def agg_09_benchmark_summary(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


_PRED = "SELECT lang AS kind, quality AS truth, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


@query(f"""SELECT kind, tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS "precision", round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity FROM (
 SELECT kind, count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) FILTER (truth = 0 AND predicted = 0) AS tn FROM ({_PRED}) GROUP BY kind)""")
def agg_10_confusion(spark, d):
    from ..operators.metrics import confusion

    return confusion(_labelled(spark, d), "kind", "truth", "predicted")


def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("kind"), F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("predicted"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id")


@query(f"""SELECT round(avg(f1), 6) AS macro_f1, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall FROM (SELECT p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM (
 SELECT CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM (
 SELECT kind, count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn FROM ({_PRED}) GROUP BY kind)))""")
def agg_11_macro_f1(spark, d):
    from ..operators.metrics import macro_f1

    return macro_f1(_labelled(spark, d), "kind", "truth", "predicted")


@query("""SELECT count(*) AS raw, count(*) FILTER (dom) AS in_scope, count(*) FILTER (NOT dom) AS out_of_scope, count(*) FILTER (dom AND n > 1) AS duplicates FROM (
 SELECT dom, row_number() OVER (PARTITION BY dom, link ORDER BY page_id) AS n FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS link, regexp_matches(url, '^https?://[^/?#]*example\\.com([/?#]|$)') AS dom FROM pages))""")
def agg_12_search_counters(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("link"), u.host_matches(u.host(F.col("url")), "example.com").alias("dom"))
    by_link = p.groupBy("dom", "link").agg(F.count("*").alias("n"))
    return by_link.agg(F.sum("n").alias("raw"), F.coalesce(F.sum(F.when(F.col("dom"), F.col("n"))), F.lit(0)).alias("in_scope"), F.coalesce(F.sum(F.when(~F.col("dom"), F.col("n"))), F.lit(0)).alias("out_of_scope"), F.coalesce(F.sum(F.when(F.col("dom"), F.col("n") - 1)), F.lit(0)).alias("duplicates"))


@query("""SELECT path, n, any_5xx FROM (SELECT l_partkey AS path, count(*) AS n, bool_or(l_linestatus = 'F') AS any_5xx FROM lineitem GROUP BY l_partkey) WHERE n > 1 ORDER BY n DESC, path LIMIT 10""")
def agg_13_repeat_requests(spark, d):
    """The limit is the feature: the ten paths asked for most often."""
    l = table(spark, d, "lineitem")  # noqa: E741
    by_path = l.groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_linestatus") == "F").alias("any_5xx"))
    return by_path.where("n > 1").orderBy(F.desc("n"), "path").limit(10)


@query("""SELECT doc_id, round(-sum(c / t * log2(c / t)), 6) AS entropy FROM (SELECT doc_id, CAST(c AS DOUBLE) AS c, CAST(sum(c) OVER (PARTITION BY doc_id) AS DOUBLE) AS t FROM (
 SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY doc_id, ch)) GROUP BY doc_id""")
def agg_14_entropy(spark, d):
    from ..functions.text import entropy_rows

    return entropy_rows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("SELECT count(*) AS crawled, count(DISTINCT url) AS unique_urls, count(DISTINCT regexp_replace(url, '[?#].*$', '')) AS unique_paths, count(DISTINCT sha256(html)) AS contents FROM pages")
def agg_18_crawl_snapshot(spark, d):
    p = table(spark, d, "pages")
    return p.agg(F.count("*").alias("crawled"), F.count_distinct("url").alias("unique_urls"), F.count_distinct(F.regexp_replace("url", r"[?#].*$", "")).alias("unique_paths"), F.count_distinct(F.sha2("html", 256)).alias("contents"))


_FP = "sha256(concat_ws('|', CAST(user_id % 50 AS VARCHAR), event_type, COALESCE(json_extract_string(props, '$.k'), '')))"


@query(f"SELECT {_FP} AS fp, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS occurrences FROM events GROUP BY 1")
def agg_19_history(spark, d):
    """Two batches, one after the other: history must come out as from one."""
    found = findings(spark, d, 50).select(fn.fingerprint(F.regexp_extract("url", r"t(\d+)\.", 1), F.col("id"), F.col("parameter")).alias("fp"), "seen_at", "ordinal", "severity")
    state = dedupe.history(dedupe.history(None, found.where("ordinal % 2 = 0")), found.where("ordinal % 2 = 1"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return state.select("fp", stamp("first_seen"), stamp("last_seen"), "occurrences")


def _first_sql(keys: str) -> str:
    return f"SELECT ordinal, id FROM (SELECT ordinal, id, row_number() OVER (PARTITION BY {keys} ORDER BY ordinal) AS n FROM {findings_sql(50)}) WHERE n = 1"


@query(_first_sql("id, url, parameter"))
def win_01_first_wins_pipeline(spark, d):
    return dedupe.first_wins(findings(spark, d, 50), [fn.alias_id(F.col("id")), F.col("url"), F.col("parameter")], "ordinal").select("ordinal", "id")


@query(_first_sql("target, id"))
def win_02_first_wins_orchestrator(spark, d):
    return dedupe.first_wins(findings(spark, d, 50), [F.col("target"), F.col("id")], "ordinal").select("ordinal", "id")


@query(_first_sql("severity, url, parameter"))
def win_03_first_wins_legacy(spark, d):
    return dedupe.first_wins(findings(spark, d, 50), [F.col("severity"), F.col("url"), F.substring("parameter", 1, 160)], "ordinal").select("ordinal", "id")


@query(_first_sql("scan_id, id, url"))
def win_04_insert_or_ignore(spark, d):
    return dedupe.first_wins(findings(spark, d, 50), [F.col("scan_id"), fn.fingerprint(F.col("id"), F.col("url"))], "ordinal").select("ordinal", "id")


@query("SELECT doc_id AS seq, CASE WHEN f < doc_id THEN CAST(f AS VARCHAR) END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents)")
def win_05_content_duplicates(spark, d):
    docs = table(spark, d, "documents").withColumn("u", F.col("doc_id").cast("string"))
    return dedupe.content_duplicates(docs, "doc_id", "u", "text").select("seq", "duplicate_of")


@query()
def win_06_simhash_pairs(spark, d):
    """Near pairs of 64-bit SimHashes; tests hold it against all pairs."""
    from ..functions.web import with_simhash

    hashed = with_simhash(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "simhash")
    return dedupe.near_pairs(hashed, "doc_id", "simhash")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS started FROM orders ORDER BY o_orderkey DESC LIMIT 200")
def win_11_recent_scans(spark, d):
    """The limit is the feature: the latest 200 scans."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started")).orderBy(F.desc("id")).limit(200)


@query(f"SELECT fp, occurrences FROM (SELECT {_FP} AS fp, max(ts) AS last_seen, count(*) AS occurrences FROM events GROUP BY 1) ORDER BY last_seen DESC, fp LIMIT 500")
def win_12_history_top(spark, d):
    """The limit is the feature: the 500 findings seen last."""
    found = findings(spark, d, 50).select(fn.fingerprint(F.regexp_extract("url", r"t(\d+)\.", 1), F.col("id"), F.col("parameter")).alias("fp"), "seen_at", "ordinal", "severity")
    return dedupe.history(None, found).orderBy(F.desc("last_seen"), "fp").limit(500).select("fp", "occurrences")


@query(f"SELECT page_id, n FROM (SELECT page_id, row_number() OVER (PARTITION BY origin ORDER BY page_id) AS n FROM (SELECT seq AS page_id, s || '://' || a AS origin FROM ({PARTS}))) WHERE n = 1")
def win_17_once_per_origin(spark, d):
    rows = urls(spark, d).select(F.col("seq").alias("page_id"), u.origin(F.col("url")).alias("origin"))
    return dedupe.first_wins(rows, [F.col("origin")], "page_id").select("page_id", F.lit(1).cast("long").alias("n"))


_KEY = "CASE WHEN regexp_matches({v}, '^v?[0-9]+(\\.[0-9]+)*$') THEN CASE WHEN regexp_matches(regexp_replace({v}, '(\\.0+)+$', ''), '^0+$') THEN [] ELSE list_transform(string_split(regexp_replace(regexp_replace({v}, '^v', ''), '(\\.0+)+$', ''), '.'), lambda x: CAST(x AS BIGINT)) END END"
_MATCH = f"""CASE WHEN start_in IS NULL AND start_ex IS NULL AND end_in IS NULL AND end_ex IS NULL THEN version NOT IN ('', '*', '-', 'NA') AND tv = version
 ELSE (version IN ('', '*', '-', 'NA') OR tv = version) AND (start_in IS NULL OR {_KEY.format(v='tv')} >= {_KEY.format(v='start_in')}) AND (start_ex IS NULL OR {_KEY.format(v='tv')} > {_KEY.format(v='start_ex')})
 AND (end_in IS NULL OR {_KEY.format(v='tv')} <= {_KEY.format(v='end_in')}) AND (end_ex IS NULL OR {_KEY.format(v='tv')} < {_KEY.format(v='end_ex')}) END"""
_JOINED = f"(SELECT t.part_id, t.name, t.version AS tv, t.confidence, a.* FROM {TECHNOLOGIES_SQL} t JOIN {ADVISORIES_SQL} a ON regexp_replace(lower(t.name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(a.product), '[^a-z0-9]+', '', 'g') WHERE a.vulnerable)"


@query(f"SELECT part_id, cve, severity, CASE WHEN start_in IS NULL AND start_ex IS NULL AND end_in IS NULL AND end_ex IS NULL THEN 'exact-version' ELSE 'version-range' END AS tag FROM {_JOINED} WHERE NOT context_required AND confidence IN ('HIGH', 'MEDIUM') AND {_MATCH}")
def jn_01_correlate(spark, d):
    found = correlate.correlate(technologies(spark, d), advisories(spark, d))
    return found.select("part_id", "cve", "severity", F.when(F.coalesce("start_in", "start_ex", "end_in", "end_ex").isNull(), "exact-version").otherwise("version-range").alias("tag"))


@query(f"SELECT part_id, cve, 'MEDIUM' AS confidence FROM {_JOINED} WHERE {_MATCH}")
def jn_02_correlate_exact(spark, d):
    return correlate.correlate(technologies(spark, d), advisories(spark, d), confident=False).select("part_id", "cve", F.lit("MEDIUM").alias("confidence"))


@query("SELECT c_custkey AS id, c_custkey % 3 = 0 AND (c_custkey % 200) BETWEEN 16 AND 31 OR c_custkey % 3 = 1 AS private, c_custkey % 3 = 0 AND (c_custkey % 200) BETWEEN 64 AND 127 AS cdn FROM customer")
def prd_07_09_networks(spark, d):
    k = F.col("c_custkey")
    ip = F.when(k % 3 == 0, F.concat_ws(".", F.lit("172"), (k % 200).cast("string"), F.lit("1"), (k % 250).cast("string"))).when(k % 3 == 1, F.concat(F.lit("10.1.2."), (k % 250).cast("string"))).otherwise(F.concat(F.lit("8.8.8."), (k % 250).cast("string")))
    return table(spark, d, "customer").select(k.alias("id"), predicates.in_networks(ip, predicates.BLOCKED_NETS).alias("private"), predicates.in_networks(ip, ["172.64.0.0/10"]).alias("cdn"))


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def prd_10_category(spark, d):
    e = table(spark, d, "events").withColumn("event", F.when(F.col("event_type").isin("error", "purchase"), "vulnerability.candidate").when(F.col("event_type") == "click", "search.response").when(F.col("event_type") == "view", "integration.status").otherwise("crawl.summary"))
    return e.where(predicates.matches_category("Scanner", F.col("event"))).select("event_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)rights reserved|public license') ORDER BY doc_id LIMIT 200")
def prd_11_grep(spark, d):
    """The limit is the feature: the first 200 matches."""
    return table(spark, d, "documents").where(F.col("text").rlike("(?i)rights reserved|public license")).select("doc_id").orderBy("doc_id").limit(200)


@query("SELECT doc_id, " + " OR ".join(f"instr(lower(v), '{m}') > 0" for m in predicates.PLACEHOLDERS) + " OR len(list_distinct(string_split(lower(v), ''))) <= 2 AS placeholder FROM (SELECT doc_id, regexp_extract(text, '^(\\S+)', 1) AS v FROM documents)")
def prd_14_placeholder(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"^(\S+)", 1).alias("v")).select("doc_id", predicates.is_placeholder(F.col("v")).alias("placeholder"))


@query(f"SELECT seq, regexp_matches(lower(p), '\\.(xml|rss|atom)$') AS xml FROM ({PARTS})")
def prd_15_xml(spark, d):
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("seq"), predicates.looks_like_xml(F.col("url"), F.col("html")).alias("xml"))


@query("SELECT page_id AS seq, instr(lower(html), 'data-reactroot') > 0 OR instr(lower(html), '__next_data__') > 0 AS spa FROM pages")
def prd_16_spa(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("seq"), predicates.looks_like_spa(F.col("html")).alias("spa"))


@query(f"""SELECT q.seq, length(q.html) > 0 AND (sha256(q.html) = b.hash OR abs(length(q.html) - b.len) / CAST(b.len AS DOUBLE) <= 0.03) AS soft FROM (SELECT page_id AS seq, html, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages) q
 JOIN (SELECT h, arg_min(hash, seq) AS hash, arg_min(len, seq) AS len FROM (SELECT page_id AS seq, regexp_extract(url, '://([^/?#]*)', 1) AS h, sha256(html) AS hash, length(html) AS len FROM pages) GROUP BY h) b ON q.h = b.h""")
def jn_11_soft_fail(spark, d):
    """The first page of a site stands for its not-found page."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("seq"), "html", u.authority(F.col("url")).alias("h"))
    base = p.groupBy("h").agg(F.min_by(F.struct(F.sha2("html", 256).alias("hash"), F.length("html").alias("len")), "seq").alias("b"))
    return p.join(base, "h").select("seq", predicates.is_soft_fail(F.col("html"), F.col("b.hash"), F.col("b.len")).alias("soft"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html[1:200000], '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def ext_28_title(spark, d):
    return table(spark, d, "pages").select("page_id", classify.title(F.col("html")).alias("title"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*\"([^\"]*)\"', 1))), ' ') AS hrefs FROM pages")
def ext_01_anchors(spark, d):
    from ..functions.text import anchors

    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(anchors(F.col("html")))), " ").alias("hrefs"))


@query("SELECT page_id, regexp_matches(lower(html), '\\bgraphql\\b|__schema|__typename|query\\s*\\{') AS detected, instr(lower(html), '__schema') > 0 OR instr(lower(html), '__typename') > 0 AS introspection FROM pages")
def ext_14_graphql(spark, d):
    from ..functions.text import graphql

    return table(spark, d, "pages").select("page_id", graphql(F.col("html"))["detected"].alias("detected"), graphql(F.col("html"))["introspection"].alias("introspection"))


@query("""SELECT host, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, unnest(regexp_extract_all('<urlset><url><loc> ' || url || ' </loc></url></urlset>', '(?is)<loc>\\s*(.*?)\\s*</loc>', 1)) AS loc, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) GROUP BY host""")
def ext_18_sitemap_locs(spark, d):
    from ..functions.text import sitemap_locs

    xml = F.concat(F.lit("<urlset><url><loc> "), F.col("url"), F.lit(" </loc></url></urlset>"))
    found = table(spark, d, "pages").select("page_id", F.explode(sitemap_locs(xml)).alias("loc"))
    return found.groupBy(u.authority(F.col("loc")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""SELECT doc_id, key, array_to_string(list(v ORDER BY o), '|') AS vals FROM (SELECT doc_id, lower(trim(split_part(line, ':', 1))) AS key, trim(substr(line, instr(line, ':') + 1)) AS v, o FROM (
 SELECT doc_id, unnest(['Contact: mailto:a' || CAST(doc_id AS VARCHAR), '# note', 'Policy : https://x.example/p', 'contact: b', 'no colon']) AS line, unnest([1, 2, 3, 4, 5]) AS o FROM documents) WHERE line NOT LIKE '#%' AND instr(line, ':') > 0) GROUP BY doc_id, key""")
def ext_19_security_txt(spark, d):
    from ..functions.text import security_txt

    body = F.concat(F.lit("Contact: mailto:a"), F.col("doc_id").cast("string"), F.lit("\n# note\nPolicy : https://x.example/p\ncontact: b\nno colon"))
    return security_txt(table(spark, d, "documents").select("doc_id", body.alias("body")), "doc_id", "body")


@query("SELECT s_suppkey AS id, 'a' AS part, 'acme' || CAST(s_suppkey % 7 AS VARCHAR) AS vendor, s_name AS product, '1.' || CAST(s_suppkey AS VARCHAR) AS version FROM supplier")
def ext_23_cpe(spark, d):
    from ..functions.text import cpe_fields

    k = F.col("s_suppkey")
    cpe = F.concat(F.lit("cpe:2.3:a:acme"), (k % 7).cast("string"), F.lit(":"), F.col("s_name"), F.lit(":1."), k.cast("string"), F.lit(":*:*:*:*:*:*:*"))
    f = cpe_fields(cpe)
    return table(spark, d, "supplier").select(k.alias("id"), f[2].alias("part"), f[3].alias("vendor"), f[4].alias("product"), f[5].alias("version"))


@query("SELECT c_custkey AS id, 'SID' || CAST(c_custkey AS VARCHAR) AS name, c_custkey % 2 = 0 AS secure, c_custkey % 3 = 0 AS httponly, CASE WHEN c_custkey % 5 = 0 THEN 'Lax' END AS samesite FROM customer")
def ext_24_cookie(spark, d):
    from ..functions.text import cookie

    k = F.col("c_custkey")
    raw = F.concat(F.lit("SID"), k.cast("string"), F.lit("=x y; Path=/"), F.when(k % 2 == 0, "; Secure").otherwise(""), F.when(k % 3 == 0, ";HttpOnly").otherwise(""), F.when(k % 5 == 0, "; SameSite=Lax").otherwise(""))
    c = cookie(raw)
    return table(spark, d, "customer").select(k.alias("id"), c["name"].alias("name"), F.map_contains_key(c["attributes"], F.lit("secure")).alias("secure"), F.map_contains_key(c["attributes"], F.lit("httponly")).alias("httponly"), c["attributes"]["samesite"].alias("samesite"))


@query(f"""SELECT category, count(*) AS n FROM (SELECT DISTINCT category, url FROM (VALUES {", ".join(f"('{c}', '{'|'.join(p)}')" for c, p in classify.PATH_HINTS.items())}) h(category, rx) JOIN pages ON regexp_matches(lower(url), rx)) GROUP BY category""")
def cls_03_path_hints(spark, d):
    return urls(spark, d).select("url", F.explode(classify.path_hints(F.col("url"))).alias("category")).distinct().groupBy("category").agg(F.count("*").alias("n"))


@query(f"""SELECT seq, CASE WHEN regexp_matches(title, '{classify.LISTING}') THEN 'listing' WHEN regexp_matches(title, '{classify.ERROR}') OR regexp_matches(html[1:100000], '{classify.ERROR}') THEN 'error' WHEN regexp_matches(title, '{classify.LOGIN}') OR regexp_matches(lower(p), '/(login|signin|sign-in|auth)(/|$)') THEN 'login'
 WHEN regexp_matches(lower(p), '\\.(json|graphql|gql)$') OR instr(lower(p), '/api/') > 0 THEN 'api_endpoint' ELSE 'page' END AS kind FROM (SELECT x.*, trim(regexp_replace(regexp_extract(html[1:200000], '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) AS title FROM (SELECT t.*, g.html FROM ({PARTS}) t JOIN pages g ON g.page_id = t.seq) x)""")
def cls_01_page_class(spark, d):
    p = table(spark, d, "pages")
    kind = classify.page_class(F.col("url"), F.lit("text/html"), F.lit(200), F.col("html"), F.lit(False), F.lit(False))
    return p.select(F.col("page_id").alias("seq"), kind.alias("kind"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'click' THEN 'MEDIUM' WHEN 'view' THEN 'LOW' WHEN 'signup' THEN 'HIGH' ELSE 'INFO' END AS severity FROM events")
def cls_08_severity(spark, d):
    raw = F.when(F.col("event_type") == "error", " crítico ").when(F.col("event_type") == "click", "Medio").when(F.col("event_type") == "view", "BAIXO").when(F.col("event_type") == "signup", "high").otherwise("?")
    return table(spark, d, "events").select("event_id", classify.severity(raw).alias("severity"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'CONFIRMED' WHEN 'purchase' THEN 'PROBABLE' ELSE 'POSSIBLE' END AS stage, CASE event_type WHEN 'error' THEN 90 WHEN 'purchase' THEN 55 WHEN 'click' THEN 10 ELSE 20 END AS score FROM events")
def fnd_01_02_stage_score(spark, d):
    kind = F.col("event_type")
    fid = F.when(kind == "error", "Headers.CSP").when(kind == "purchase", "server-disclosure").when(kind == "click", "cve.2024").otherwise("other")
    e = table(spark, d, "events").select("event_id", kind, fn.stage(fid).alias("stage"))
    factors = {"direct_observation": kind == "error", "high_quality_fingerprint": kind == "purchase", "unresolved_context": kind == "click"}
    return e.select("event_id", "stage", fn.score(F.col("stage"), factors).alias("score"))


@query("SELECT event_id, sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, COALESCE(json_extract_string(props, '$.k'), ''), '', '')) AS fp FROM events")
def fnd_09_fingerprint(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", fn.fingerprint(F.col("user_id"), F.col("event_type"), F.get_json_object("props", "$.k"), F.lit(None), F.lit("")).alias("fp"))


@query("""SELECT COALESCE(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'fn' WHEN b.k IS NULL THEN 'fp' ELSE 'tp' END AS verdict FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) b ON a.k = b.k""")
def jn_16_set_03_04_labels(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct().withColumn("x", F.lit(1))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct().withColumn("y", F.lit(1))
    return a.join(b, "k", "full").select("k", F.when(F.col("x").isNull(), "fn").when(F.col("y").isNull(), "fp").otherwise("tp").alias("verdict"))


@query("SELECT DISTINCT url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE url LIKE '%/en/%')")
def jn_10_not_seen(spark, d):
    from ..operators.frontier import not_seen

    p = table(spark, d, "pages").select("url")
    return not_seen(p, p.where(F.col("url").like("%/en/%"))).distinct()


@query("SELECT event_id, round(CASE WHEN isfinite(value) THEN least(50.0, greatest(0.0, value)) ELSE 0.0 END, 3) AS v FROM events")
def fn_09_bounded(spark, d):
    from ..functions.text import bounded

    return table(spark, d, "events").select("event_id", F.round(bounded(F.col("value"), 0.0, 50.0), 3).alias("v"))


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '^\\s*[=+\\-@]') THEN '''' || t ELSE t END AS cell FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' ELSE ' x' END || text AS t FROM documents)")
def snk_06_csv_guard(spark, d):
    from ..functions.text import csv_cell

    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(" x"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", csv_cell(t).alias("cell"))


@query("SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS url FROM pages")
def snk_12_url_list(spark, d):
    from ..sources.tables import links

    return links(spark, d).select(F.col("href").alias("url")).distinct()


@query("SELECT user_id, k, v FROM (SELECT user_id, json_extract_string(props, '$.k') AS k, value AS v, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts DESC, event_id DESC) AS n, ts FROM events) WHERE n = 1 AND ts >= TIMESTAMP '2024-01-10'")
def rep_05_cache(spark, d):
    from ..operators.store import cache_view

    e = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("v"), "ts", "event_id")
    return cache_view(e, ["user_id", "k"], F.struct("ts", "event_id"), F.col("ts"), F.lit("2024-01-10").cast("timestamp")).select("user_id", "k", "v")


@query("SELECT row_number() OVER (ORDER BY event_id) + 1000 AS id, event_id FROM events WHERE event_type = 'error'")
def rep_01_append_ids(spark, d):
    from ..operators.store import number

    return number(table(spark, d, "events").where("event_type = 'error'").select("event_id"), "event_id", 1000)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_05_telemetry_windows(spark, d):
    from ..streaming.telemetry import windowed

    w = windowed(table(spark, d, "events"), "ts", "1 hour", "event_type", "value")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type AS topic, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) AS rank FROM events)")
def win_16_event_order(spark, d):
    pr = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return table(spark, d, "events").select(F.col("event_type").alias("topic"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(pr, "event_id")).cast("long").alias("rank"))
