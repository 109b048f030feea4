"""Queries over crawl state and logs: sliding near-duplicate memory, robots policies, numbered lines, with their twins."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import functions as F

from ..functions import addresses
from ..operators import dedupe, lookups, metrics, migrations, reports, robots, wordlists
from ..operators.store import Store
from ..runtime import new_folder
from ..sources import files
from ..sources.tables import findings, findings_sql, table, urls
from ..streaming import extraction, memory
from .url_plans import _PATH, _QUERY, PARTS

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Hashes from ids: one of 97 at a time, with up to four bits turned; the sign bit among them. Some rows have none.
_TURNED = ((7, 3, 61), (11, 1, 53), (5, 1, 47), (3, 1, 59))
_HASH = "CASE WHEN {k} % 23 <> 0 THEN " + "".join("xor(" for _ in range(5)) + "({k} * {k} % 97) * 90071992547408819" + "".join(f", CASE WHEN {{k}} % {m} < {n} THEN 1::BIGINT << ({{k}} % {b})::INTEGER ELSE 0 END)" for m, n, b in _TURNED) + ", CASE WHEN {k} % 2 = 0 THEN -9223372036854775808 ELSE 0 END) END"


def _hash(k):
    out = (k * k % 97) * F.lit(90071992547408819)
    for m, n, b in _TURNED:
        out = out.bitwiseXOR(F.when(k % m < n, F.expr(f"shiftleft(1L, cast(event_id % {b} as int))")).otherwise(F.lit(0).cast("long")))
    return F.when(k % 23 != 0, out.bitwiseXOR(F.when(k % 2 == 0, F.lit(-(2**63))).otherwise(F.lit(0).cast("long"))))


def _hashes(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("crawl"), "event_id", _hash(F.col("event_id")).alias("h"))


def _memory_sql(by: str, kept: str) -> str:
    hashed = f"SELECT 'c' || (event_id % 3) AS crawl, event_id AS seq, {_HASH.format(k='event_id')} AS h FROM events"
    return f"""WITH placed AS (SELECT *, row_number() OVER ({by} ORDER BY seq) AS place FROM ({hashed})),
 asked AS (SELECT *, unnest(range(1, 129)) AS back FROM placed),
 met AS (SELECT a.seq, bool_or(bit_count(xor(a.h, b.h)) <= 3) AS near FROM asked a JOIN placed b ON b.place = a.place - a.back {kept} GROUP BY a.seq)
 SELECT crawl, seq, coalesce(near, false) AS duplicate FROM placed LEFT JOIN met USING (seq)"""


@query(_memory_sql("PARTITION BY crawl", "AND a.crawl = b.crawl"))
def win_06_sliding_memory(spark, d):
    return dedupe.sliding_duplicates(_hashes(spark, d), "event_id", "h", 3, 128, ["crawl"])


@query(_memory_sql("PARTITION BY crawl", "AND a.crawl = b.crawl"))
def str_03_sliding_stream(spark, d):
    """The same as state of a stream that starts twice on one checkpoint."""
    path = new_folder(spark, "sliding")
    rows = _hashes(spark, d)
    half = rows.agg(F.max("event_id")).first()[0] or 0
    before = {k: spark.conf.get(k, None) for k in memory.STORE}
    for k, v in memory.STORE.items():
        spark.conf.set(k, v)
    try:
        for part in (rows.where(F.col("event_id") * 2 < half), rows.where(F.col("event_id") * 2 >= half)):
            part.write.mode("append").parquet(f"{path}/in")
            marked = memory.sliding_duplicates(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), "crawl", "event_id", "h", 3, 128)
            marked.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema("crawl string, seq long, duplicate boolean").parquet(f"{path}/out")


#: (allow, path) of the rules of which every origin has some.
POLICY = ((False, "/en/"), (True, "/en/4*"), (False, "/*.html$"), (False, "/fr/*?page="), (True, "/*ref=x"), (False, "/es/"), (True, "/es/*5$"), (False, "/de"), (False, "/fr/1*"), (True, "/fr/12"))


def _pattern(path: str) -> str:
    body = path.removesuffix("$")
    return "^" + ".*".join(map(re.escape, body.split("*"))) + ("$" if body != path else "")


@query(f"""WITH seen AS (SELECT seq, s || '://' || regexp_replace(h, '\\.+$', '') || ':' || CASE WHEN port <> '' THEN port WHEN s = 'https' THEN '443' ELSE '80' END AS origin, {_PATH} || {_QUERY('q')} AS t, s <> '' AND h <> '' AS known FROM ({PARTS})),
 rules(i, allow, rx, n) AS (VALUES {", ".join(f"({i}, {a}, '{_pattern(p)}', {len(p.translate({42: None, 36: None}))})" for i, (a, p) in enumerate(POLICY))}),
 best AS (SELECT seq, max(n * 2 + CASE WHEN allow THEN 1 ELSE 0 END) AS b FROM seen JOIN rules ON length(origin) % 7 < 5 AND i % 5 <> length(origin) % 7 AND regexp_matches(t, rx) WHERE known GROUP BY seq)
 SELECT seq, CASE WHEN known AND length(origin) % 7 = 5 THEN false ELSE coalesce(b % 2 = 1, true) END AS allowed FROM seen LEFT JOIN best USING (seq)""")
def jn_09_robots_policies(spark, d):
    """Pages under the policies of their origins: one in seven denies all, one isn't known, the others have different rules."""
    pages = urls(spark, d)
    sites = pages.select(robots.origin(F.col("url")).alias("origin")).where("origin is not null").distinct().withColumn("k", F.length("origin") % 7)
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("allow"), F.lit(p).alias("path")) for i, (a, p) in enumerate(POLICY)]))
    own = sites.where("k < 5").select("origin", "k", rules.alias("r")).where("r.i % 5 <> k").select("origin", "r.allow", "r.path")
    return robots.judge(pages, sites.where("k < 6").select("origin", (F.col("k") == 5).alias("deny")), own).select("seq", "allowed")


@query("SELECT event_id % 4 AS grp, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line, event_id AS id FROM events")
def src_02_line_numbers(spark, d):
    """Events written as four JSONL files, and read back with their line numbers."""
    path = new_folder(spark, "lines")
    events = table(spark, d, "events").select((F.col("event_id") % 4).alias("grp"), "event_id", F.to_json(F.struct(F.col("event_id").alias("id"), "event_type", "props")).alias("value"))
    events.repartition("grp").sortWithinPartitions("grp", "event_id").select("grp", "value").write.partitionBy("grp").text(path)
    lines = files.numbered_lines(spark, path)
    return lines.select(F.regexp_extract("file", "grp=([0-9]+)", 1).cast("long").alias("grp"), "line", F.get_json_object("value", "$.id").cast("long").alias("id"))


@query("""SELECT event_type, event_id, value FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id)) AS place FROM events) WHERE place <= 128""")
def win_15_latency_sample(spark, d):
    """At most 128 latencies of each kind of event, drawn from all."""
    return metrics.sample(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", 128, "7")


#: Networks that hold one another, of both families; those that BROKEN adds are none, or have bits after their length.
NETS = ("0.0.0.0/1", "128.0.0.0/2", "172.64.0.0/10", "172.100.0.0/16", "172.100.1.0/25", "172.100.1.72/29", "2001:db8::/32", "2001:DB8:8::/45", "2001:db8:c:0002::/64", "2001:db8:c:2::800/117", "2a00::/12", "::/3")
BROKEN = ("172.100.1.1/16", "172.100.1.0/33", "2001:db8::1/32", "2001:db8:::/48", "::ffff:172.0.0.0/64", "10.0.0.0", "/8")


def _nets_sql() -> str:
    made = [(n, ipaddress.ip_network(n)) for n in NETS]
    return ", ".join(f"('{n}', {w.version}, '{int(w[0])}'::UHUGEINT, '{int(w[-1])}'::UHUGEINT, {w.prefixlen})" for n, w in made)


@query(f"""WITH seen AS (SELECT event_id, event_id AS k FROM events),
 hosts AS (SELECT event_id, k, CASE WHEN k % 5 < 2 THEN 4 WHEN k % 5 < 4 THEN 6 END AS family, CASE WHEN k % 2 = 0 THEN 8193 ELSE 10752 END AS head,
  ((172 * 256 + k % 200) * 256 + k % 3) * 256 + k % 250 AS v4 FROM seen),
 numbers AS (SELECT *, CASE WHEN family = 4 THEN v4::UHUGEINT ELSE head::UHUGEINT * {1 << 112}::UHUGEINT + 3512::UHUGEINT * {1 << 96}::UHUGEINT + (k % 16)::UHUGEINT * {1 << 80}::UHUGEINT + (k % 7)::UHUGEINT * {1 << 64}::UHUGEINT + (k % 4096)::UHUGEINT END AS n FROM hosts),
 nets(net, family, low, high, size) AS (VALUES {_nets_sql()}),
 held AS (SELECT event_id, arg_max(net, size) AS net FROM numbers h JOIN nets w ON h.family = w.family AND h.n BETWEEN w.low AND w.high GROUP BY event_id)
 SELECT event_id, net, CASE WHEN family = 4 THEN k % 200 BETWEEN 16 AND 31 WHEN family = 6 THEN head = 8193 END AS blocked FROM hosts LEFT JOIN held USING (event_id)""")
def jn_14_longest_network(spark, d):
    """Addresses of both families in five forms, with their longest network and whether they are reached; one in five is none."""
    k = F.col("event_id")
    part = lambda n: F.lower(F.hex(k % n))
    wide = lambda n: F.lpad(F.hex(k % n), 4, "0")
    dotted = F.concat_ws(".", F.lit("172"), *[(k % n).cast("string") for n in (200, 3, 250)])
    head = F.when(k % 2 == 0, "2001").otherwise("2a00")
    short = F.concat_ws(":", head, F.lit("db8"), part(16), part(7), F.lit(""), part(4096))
    whole = F.concat_ws(":", F.upper(head), F.lit("0DB8"), wide(16), wide(7), F.lit("0000:0:0"), wide(4096))
    ip = F.when(k % 5 == 0, dotted).when(k % 5 == 1, F.concat(F.lit("::FFFF:"), dotted)).when(k % 5 == 2, short).when(k % 5 == 3, whole).otherwise(F.concat(dotted, F.lit(".1")))
    nets = spark.createDataFrame([(n,) for n in (*NETS, *BROKEN)], "net string")
    hosts = table(spark, d, "events").select("event_id", ip.alias("ip"))
    return lookups.with_longest_network(hosts, nets, unwrap=True).select("event_id", "net", addresses.is_blocked(F.col("ip")).alias("blocked"))


@query("""WITH own AS (SELECT page_id, page_id % 3 AS n, len(regexp_extract_all(coalesce(html, ''), '(?i)<form[\\s/>]')) AS more FROM pages)
 SELECT page_id, -1 AS place, n + more AS n_forms, NULL AS action, NULL AS fields FROM own
 UNION ALL SELECT page_id, j, NULL, 'https://h.example/' || page_id || '/' || j, 'csrf_token|q' || j FROM (SELECT page_id, unnest(range(n)) AS j FROM own)""")
def str_02_page_stream(spark, d):
    """Pages with up to two forms put before their HTML, as a stream that starts twice on one checkpoint; rows of both of its outputs."""
    path = new_folder(spark, "extraction")
    form = lambda j: F.concat(F.lit('<form method="post" action="https://h.example/'), F.col("page_id").cast("string"), F.lit(f'/{j}"><input name="csrf_token"><input name="q{j}"></form>'))
    added = F.when(F.col("page_id") % 3 == 2, F.concat(form(0), form(1))).when(F.col("page_id") % 3 == 1, form(0)).otherwise("")
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(added, F.coalesce("html", F.lit(""))).alias("html"))
    for rest in (0, 1):
        pages.where(F.pmod("page_id", F.lit(2)) == rest).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(pages.schema).parquet(f"{path}/in")
        extraction.write(stream, f"{path}/out", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    found = extraction.read(spark, f"{path}/out", "pages", "page_id long, n_forms int").select("page_id", F.lit(-1).alias("place"), F.col("n_forms").cast("long").alias("n_forms"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("fields"))
    forms = extraction.read(spark, f"{path}/out", "forms", extraction.FORMS).where("startswith(form.action, 'https://h.example/')")
    page = F.regexp_extract("form.action", "^https://h[.]example/([0-9]+)/", 1).cast("long")
    return found.union(forms.select(page.alias("page_id"), "place", F.lit(None).cast("long"), "form.action", F.array_join("form.fields.name", "|")))


@query(f"""WITH lines AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN event_type || CASE WHEN event_id % 11 = 0 THEN ' ' ELSE '-' END || (event_id * 7919 % 9001) END AS value FROM events),
 held AS (SELECT value, row_number() OVER (ORDER BY min(event_id)) - 1 AS ordinal FROM lines WHERE value IS NOT NULL GROUP BY value),
 chunks AS (SELECT ordinal // {wordlists.CHUNK} AS c, sha256(string_agg(value, chr(10) ORDER BY ordinal) || chr(10)) AS sha FROM held GROUP BY 1),
 whole AS (SELECT CASE WHEN count(*) = 1 THEN min(sha) ELSE sha256(string_agg(sha, chr(10) ORDER BY c) || chr(10)) END AS sha FROM chunks)
 SELECT ordinal, value, 'names_' || sha[:16] AS list FROM held, whole""")
def snk_19_wordlist(spark, d):
    """Lines with repeats, blank ones and carriage returns, imported as a list and read back with its digest checked."""
    k = F.col("event_id")
    value = F.when(k % 50 != 0, F.concat("event_type", F.when(k % 11 == 0, " ").otherwise("-"), (k * 7919 % 9001).cast("string"), F.when(k % 7 == 0, "\r").otherwise(""))).otherwise(F.when(k % 3 == 0, "\r").otherwise(""))
    store = Store(spark, new_folder(spark, "lists"))
    found = wordlists.add(store, table(spark, d, "events").select("event_id", value.alias("value")), ["event_id"], "names", "events.txt", ["names"])
    return wordlists.read(store, found["id"]).withColumn("list", F.lit(found["id"]))


def _read_back(spark, path: str):
    """(line, value) of a file that a query has written."""
    return files.numbered_lines(spark, path).select("line", "value")


#: Values that need quotes, or a quote in front.
_VALUES = ("plain", "a,b", 'say ""x""', "=1+1", " -2", "é漢")


def _items_sql() -> str:
    cell = "CASE WHEN regexp_matches({v}, '^\\s*[=+\\-@]') THEN '''' || {v} ELSE {v} END"
    quoted = "CASE WHEN regexp_matches({c}, '[,\"]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
    field = lambda v: quoted.format(c="(" + cell.format(v=v) + ")")
    values = "[" + ", ".join("'" + v.replace('""', '"') + "'" for v in _VALUES) + "][1 + event_id % 6]"
    return f"""WITH own AS (SELECT event_id, event_id % 4 AS k, {values} AS v, CASE WHEN event_id % 5 = 0 THEN 'HIGH' ELSE 'INFO' END AS severity FROM events),
 made AS (SELECT CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS place, event_id,
  CASE k WHEN 0 THEN 'Subdomain Takeover,' || severity || ',' || {field('v')} || ',s' WHEN 1 THEN 'Secrets em JavaScript,' || severity || ',https://h.example/' || event_id || ',' || {field("v || ': [REDACTED]'")}
   WHEN 2 THEN 'CORS Misconfiguration,' || severity || ',u,' || {field("'origin=' || v || ' acao=*'")} ELSE 'Subdominio (crt.sh),INFO,' || {field('v')} || ',' END AS value FROM own)
 SELECT 1::BIGINT AS line, 'categoria,severidade,alvo,detalhe' AS value UNION ALL SELECT 1 + row_number() OVER (ORDER BY place, event_id), value FROM made"""


@query(_items_sql())
def snk_05_csv_sections(spark, d):
    """Events as items of four sections, written as one CSV file by many tasks and read back line by line."""
    k = F.col("event_id")
    v = F.element_at(F.array(*[F.lit(x.replace('""', '"')) for x in _VALUES]), (k % 6 + 1).cast("int"))
    severity = F.when(k % 5 == 0, "HIGH")
    named = lambda **c: F.to_json(F.struct(severity.alias("severity"), *[x.alias(n) for n, x in c.items()]))
    item = (
        F.when(k % 4 == 0, named(subdomain=v, service=F.lit("s")))
        .when(k % 4 == 1, named(url=F.concat(F.lit("https://me:pw@H.example/"), k.cast("string"), F.lit("#f")), tipo=v, valor=F.lit("s3cr3t")))
        .when(k % 4 == 2, named(url=F.lit("u"), origin_testada=v, acao=F.lit("*")))
        .otherwise(v)
    )
    section = F.element_at(F.array(*map(F.lit, ("subdomain_takeover", "secrets_js", "cors", "subdomains"))), (k % 4 + 1).cast("int"))
    path = new_folder(spark, "report") + "/sections.csv"
    reports.write_csv(table(spark, d, "events").select(section.alias("section"), k.alias("ordinal"), item.alias("item")), path)
    return _read_back(spark, path)


@query(f"""WITH found AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS i FROM {findings_sql(50)}),
 annex AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS i FROM pages QUALIFY i <= 500),
 kinds AS (SELECT count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l, count(*) FILTER (severity = 'INFO') AS n FROM found),
 texts(section, item, lines) AS (
  SELECT 0, 0, ['{'=' * 80}', 'REPORT', '{'=' * 80}', 'ALVO: https://h.example/ | IP: unknown | DATA: 2024-01-01',
   'DURAÇÃO: unknown | MODO: Scan | RISK SCORE: ' || CASE WHEN c + h + m + l = 0 THEN '0.0' ELSE printf('%.1f', round_even((10 * c + 7 * h + 4 * m + l) / (c + h + m + l), 1)) END || '/10', '{'=' * 80}', '', '[RESUMO EXECUTIVO]',
   '- CRÍTICO: ' || c || ' | ALTO: ' || h || ' | MÉDIO: ' || m || ' | BAIXO: ' || l || ' | INFO: ' || n, '- Superfície analisada: ' || (SELECT count(*) FROM pages) || ' endpoints',
   '- Evidências limitadas a 500 caracteres e segredos são redigidos.', ''] FROM kinds
  UNION ALL SELECT 1, i, ['[' || i || '] ' || id || ' — ' || severity || ' — POSSIBLE — CONFIDENCE: MEDIUM — SCORE: 0/100', '    URL: ' || url] || CASE WHEN parameter <> '' THEN ['    Parâmetro: ' || parameter] ELSE []::VARCHAR[] END
   || ['    Evidência:', '      ' || CASE WHEN ordinal % 3 = 0 THEN 'token=<redacted> ' || repeat('x', 500 - 9 - (ordinal % 7)::INTEGER) ELSE '' END, '    Impacto: Requer validação contextual do impacto.', '    Remediação: ', '    CWE:  | CVE: ', ''] FROM found
  UNION ALL SELECT 2, 0, ['[ANEXO A] ENDPOINTS DISCOVERED'] UNION ALL SELECT 2, i, ['  - /p/' || page_id] FROM annex
  UNION ALL SELECT 3, 0, ['', '[ANEXO B] TECHNOLOGIES DETECTED'])
 SELECT row_number() OVER (ORDER BY section, item, part) AS line, value FROM (SELECT section, item, unnest(lines) AS value, generate_subscripts(lines, 1) AS part FROM texts)""")
def snk_09_text_report(spark, d):
    """All findings as one text report, numbered and with secrets of up to seven characters in evidence that is longer than a report shows; read back line by line."""
    own = findings(spark, d, 50)
    secret = F.concat(F.lit("token: "), F.expr("repeat('s', cast(ordinal % 7 + 1 as int))"), F.lit(" "), F.expr("repeat('x', 491)"))
    own = own.withColumn("evidence", F.when(F.col("ordinal") % 3 == 0, secret))
    endpoints = table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("value"))
    path = new_folder(spark, "report") + "/report.txt"
    reports.write_text(own, path, title="REPORT", target="https://h.example/#x", date="2024-01-01", endpoints=endpoints)
    return _read_back(spark, path)


@query(f"""SELECT ordinal, 'POSSIBLE' AS stage, 0 AS confidence_score, '{{}}' AS evidence_metadata, count(*) OVER w AS occurrences, min(seen_at) OVER w AS first_seen, 1 + 2 + 0 AS applied
 FROM {findings_sql(50)} WINDOW w AS (PARTITION BY id, coalesce(parameter, ''))""")
def rep_04_migrations(spark, d):
    """Findings of a store of the first version, brought to the last one, twice; with the history that was made of them."""
    store = Store(spark, new_folder(spark, "migrated"))
    applied = migrations.migrate(store, migrations.MIGRATIONS[:1])
    rows = findings(spark, d, 50).select(F.col("scan_id").cast("long").alias("scan_id"), F.concat_ws("|", "id", F.coalesce("parameter", F.lit(""))).alias("fp"), "ordinal", "seen_at", F.col("id").alias("name"), "severity")
    store.write("findings", store.read("findings").unionByName(rows, allowMissingColumns=True))
    applied += migrations.migrate(store) + migrations.migrate(store)
    seen = store.read("history").select("fp", "occurrences", "first_seen")
    return store.read("findings").join(seen, "fp").select("ordinal", "stage", "confidence_score", "evidence_metadata", "occurrences", "first_seen", F.lit(applied).alias("applied"))
