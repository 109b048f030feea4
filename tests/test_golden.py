"""Labelled rows for operators that the tables hold no case of."""

import json

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import findings as fn
from skeinlake.functions import urls as u
from skeinlake.functions import web
from skeinlake.operators import correlate, dedupe, frontier, robots, rules, sinks
from skeinlake.sources import files, providers


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).coalesce(1).select(column).collect()]


def test_urls(spark):
    x = F.col("x")
    assert values(spark, u.normalize(x), ["HTTP://Ex.COM:80/A?b=2&a=1#f", "https://ex.com:8443", "https://u:p@ex.com/", "nothing", "https://ex.com./x"]) == ["http://ex.com/A?b=2&a=1", "https://ex.com:8443/", "https://u:p@ex.com/", "nothing", "https://ex.com/x"]
    assert values(spark, u.normalize_legacy(x), ["https://Ex.com/A/?b=2&&a=1#f"]) == ["https://ex.com/a?a=1&b=2"]
    assert values(spark, u.normalize_target(x), ["Example.com", "HTTPS://a.b:443/x/", "ftp://a", "", "http://a:80", "http://a:8080/?q"]) == ["https://example.com", "https://a.b/x", "", "", "http://a", "http://a:8080/?q"]
    assert values(spark, u.sanitize(x), ["https://u:p@Ex.com:443/a?k=1&k=2&z#f", "x"]) == ["https://ex.com:443/a?k=%5Bredacted%5D&k=%5Bredacted%5D&z=%5Bredacted%5D", ""]
    assert values(spark, u.path_in_prefix(x, "/api"), ["/api", "/api/v1", "/apiary", ""]) == [True, True, False, False]
    assert values(spark, u.host_matches(x, "ex.com"), ["ex.com", "a.ex.com", "notex.com"]) == [True, True, False]
    assert values(spark, u.in_scope(x, "ex.com"), ["https://a.ex.com:443/?api_key=1&q=2", "https://other.com/"]) == ["https://a.ex.com/?api_key=%5BREDACTED%5D&q=2", None]


def test_versions(spark):
    cols = [F.col(c) for c in "vabcde"]
    rows = [("1.2.0", "*", "1.2.0", None, None, "1.4.0"), ("1.3.9", "*", "1.2.0", None, None, "1.4.0"), ("1.1.9", "*", "1.2.0", None, None, "1.4.0"), ("1.4.0", "*", "1.2.0", None, None, "1.4.0"), ("1.2", "1.2", None, None, None, None), ("1.2.0", "1.2", None, None, None, None), ("x", "*", "1.0", None, None, None), ("1.10", "*", "1.9", None, None, None), ("1.2", "*", None, "1.2.0", None, None), ("2", "*", "junk", None, None, None)]
    assert values(spark, correlate.version_matches(*cols), rows, "v string, a string, b string, c string, d string, e string") == [True, True, False, False, True, False, False, True, False, False]


RESPONSE = "obs_id long, url string, status int, headers map<string,array<string>>, body string"
CATEGORY_FIXTURES = [
    ("sqli.error-indicator", True, "You have an error in your SQL syntax near FROM", {}), ("sqli.error-indicator", False, "This service stores records in MySQL.", {}), ("cmdi.execution-indicator", True, "sh: archive.sh: command not found", {}),
    ("cmdi.execution-indicator", False, "PowerShell and child_process are runtime APIs.", {}), ("directory-traversal.file-indicator", True, "root:x:0:0:root:/root:/bin/bash", {}), ("directory-traversal.file-indicator", False, "A directory traversal guide mentions /etc/passwd and missing paths.", {}),
    ("xxe.xml-indicator", True, "XML parser error: failed to load external entity", {"content-type": ["application/xml"]}), ("xxe.xml-indicator", False, "DOCTYPE and external entities are covered in this guide.", {"content-type": ["application/xml"]}),
    ("xss.dom-source-sink-indicator", True, "<script>const q=location.search; document.querySelector('#x').innerHTML=q;</script>", {}), ("xss.dom-source-sink-indicator", False, "<script>const version=1; alert('static')</script><img onerror='handle()'>", {}),
    ("ldap.error-indicator", True, "javax.naming.InvalidNameException: invalid DN syntax", {}), ("ldap.error-indicator", False, "This guide explains LDAP query syntax.", {}),
]
PASSIVE_FIXTURES = [
    ("debug-information-disclosure", True, "Traceback (most recent call last): internal error"), ("debug-information-disclosure", False, "Laravel and Django are frameworks; this page describes debug settings."),
    ("private-address-disclosure", True, "Internal service: 10.0.0.5."), ("private-address-disclosure", False, "Example value: 192.168.999.999; public: 203.0.113.8."),
]


def test_signature_rules(spark):
    rows = [(i, "https://fixture.test/", 200, h, b) for i, (_, _, b, h) in enumerate(CATEGORY_FIXTURES)]
    got = spark.createDataFrame(rows, RESPONSE).select("obs_id", rules.categories(F.col("url"), F.col("headers"), F.col("body")).alias("f")).collect()
    for r in got:
        rule, expected, *_ = CATEGORY_FIXTURES[r["obs_id"]]
        assert (rule in {f["id"] for f in r["f"]}) is expected, CATEGORY_FIXTURES[r["obs_id"]]
    rows = [(i, "https://fixture.test/", 200, {}, b) for i, (_, _, b) in enumerate(PASSIVE_FIXTURES)]
    for r in spark.createDataFrame(rows, RESPONSE).select("obs_id", rules.passive(F.col("url"), F.col("headers"), F.col("body")).alias("f")).collect():
        rule, expected, _ = PASSIVE_FIXTURES[r["obs_id"]]
        assert (rule in {f["id"] for f in r["f"]}) is expected


def test_cookies(spark):
    cookies = ["analytics=secure-httponly-samesite; Securely; X-HttpOnly; SameSite-Mode=Lax", "sessionid=fixture-secret", "prefs=ok; Secure; HttpOnly; SameSite=Lax", "__Secure-session=secret-one; HttpOnly", "__Host-session=secret-two; Secure; Domain=example.test; Path=/", "cross-site=secret-three; SameSite=None", "__Host-valid=secret-four; Secure; HttpOnly; Path=/; SameSite=Lax", "__Secure-valid=secret-five; Secure; HttpOnly", "cross-site-valid=secret-six; SameSite=None; Secure"]
    df = spark.createDataFrame([(1, "https://fixture.test/", 200, {"set-cookie": cookies}, "")], RESPONSE)
    found = df.select(F.explode(rules.passive(F.col("url"), F.col("headers"), F.col("body"))).alias("f")).select("f.*").where("id like 'cookie%'").collect()
    assert not any("secret" in str(f["evidence"]) for f in found)
    of = lambda n: {f["id"]: (f["severity"], f["confidence"]) for f in found if f["evidence"] == f"Set-Cookie #{n}"}
    assert of(1) == dict.fromkeys(("cookie-secure", "cookie-httponly", "cookie-samesite"), ("INFO", "LOW"))
    assert of(2) == dict.fromkeys(("cookie-secure", "cookie-httponly", "cookie-samesite"), ("LOW", "MEDIUM")) and of(3) == {}
    for rule in ("cookie.prefix-secure", "cookie.prefix-host", "cookie.samesite-none-secure"):
        assert sum(f["id"] == rule for f in found) == 1


def test_all_findings_score_and_dedupe(spark):
    df = spark.createDataFrame([(1, "http://a/", 500, {"server": ["nginx/1.2"], "content-type": ["text/html"]}, "<html>Traceback (most recent call last) line 3"), (2, "http://a/", 500, {"server": ["nginx/1.2"]}, "")], RESPONSE)
    got = {r["id"]: r for r in rules.all_findings(df).collect()}
    assert got["server-disclosure"]["obs_id"] == 1 and got["server-disclosure"]["stage"] == "PROBABLE" and got["server-disclosure"]["score"] == 65
    assert got["headers.csp"]["score"] == 90 and "csp-missing" not in got and got["server-error-detail-confirmed"]["stage"] == "PROBABLE"


def test_templates(spark):
    t = {"id": "debug-page", "matchers-condition": "and", "matchers": [{"type": "word", "values": ["Debug"]}, {"type": "regex", "values": [r"^line \d+$"]}, {"type": "status", "values": [500]}, {"type": "word", "part": "header", "negative": True, "values": ["x-ok"]}]}
    df = spark.createDataFrame([("DEBUG\nline 3\n", "a: b", 500), ("DEBUG\nline 3\n", "X-OK: b", 500), ("DEBUG\nline x\n", "", 500), ("DEBUG\nline 3\n", "", 200)], "body string, headers_text string, status int")
    assert [r["matched"] for r in rules.evaluate(df, [t]).collect()] == [["debug-page"], [], [], []]
    for bad in ("(a+)+", "a" * 257, ".*x.*", ""):
        with pytest.raises(rules.TemplateError):
            rules.safe_regex(bad)
    with pytest.raises(rules.TemplateError):
        rules.validate({"id": "x1", "matchers": [{"type": "word", "values": ["a"], "other": 1}]})


def test_robots(spark):
    body = "User-agent: *\nDisallow: /\nUser-agent: Skein\nDisallow: /private\nAllow: /private/public # yes\nSitemap: https://e.com/s.xml\n"
    got = robots.parse(spark.createDataFrame([("https://e.com", body)], "origin string, body string"), "Skein/1").orderBy("ord").collect()
    assert [(r["allow"], r["path"]) for r in got] == [(False, "/private"), (True, "/private/public")]
    held = [(r["allow"], r["path"]) for r in got]
    assert values(spark, robots.allows(F.col("x"), held), ["https://e.com/private/x", "https://e.com/private/public", "https://e.com/other"]) == [False, True, True]
    star = robots.parse(spark.createDataFrame([("https://e.com", body)], "origin string, body string"), "other").collect()
    assert [(r["allow"], r["path"]) for r in star] == [(False, "/")]


def test_scripts():
    source = r"""
      import './entry.js?v=4';
      import { shared } from "./static/shared.js";
      export { default } from '../widgets/card.mjs';
      const lazy = import(`./chunks/lazy.js`);
      importScripts('/sw/bootstrap.js', './sw/one.js');
      new Worker(new URL('./worker.js', import.meta.url));
      const example = "import './not-a-module.js'";
      // import './commented-out.js';
      /* export * from './also-commented.js'; */
      import(`./chunks/${chunkName}.js`);
      import(packageName);
      import('bare-package-name');
    """
    base = "https://example.test/assets/"
    assert web.analyze_javascript(base + "app.js", source)["scripts"] == [base + "chunks/lazy.js", base + "entry.js?v=4", base + "static/shared.js", base + "sw/one.js", base + "worker.js", "https://example.test/sw/bootstrap.js", "https://example.test/widgets/card.mjs"]
    app = "https://example.test/app.js"
    assert web.analyze_javascript(app, "// fetch('/api/commented')\rfetch('/api/live'); /* '/api/also-commented' */")["urls"] == ["https://example.test/api/live"]
    source = r"""
      const documentation = "Example: fetch('/api/not-live') and new WebSocket('wss://ws.example.test/not-live')";
      const routeNote = "/api/not-live is a documented endpoint";
      const routePattern = /"\/api\/regex-only"/;
      const socketPattern = /"wss:\/\/ws\.example\.test\/regex-only"/;
      fetch('/api/live');
      fetch(`/api/users/${userId}?token=${token}`);
      new WebSocket('/socket/live');
    """
    found = web.analyze_javascript(app, source)
    assert (found["urls"], found["websockets"], found["route_templates"]) == (["https://example.test/api/live"], ["wss://example.test/socket/live"], ["https://example.test/api/users/{param}"])
    assert web.analyze_javascript(base + "app.js", 'const example = "//# sourceMappingURL=fake.map"; /*# sourceMappingURL=real.map */')["source_maps"] == [base + "real.map"]
    source = "const xhr = new XMLHttpRequest(); xhr.open('GET', '/api/users'); const c = axios.create({baseURL: '/v1/items'}); const route = '/graphql'; fetch(`/api/static`); axios.post('/api/p'); new WebSocket('/socket');"
    found = web.analyze_javascript(app, source)
    assert found["urls"] == [f"https://example.test{p}" for p in ("/api/p", "/api/static", "/api/users", "/graphql", "/v1/items")] and found["websockets"] == ["wss://example.test/socket"]
    assert web.analyze_source_map(app, json.dumps({"sourcesContent": ["fetch('/api/x')", None, 3]})) == {"urls": ["https://example.test/api/x"], "websockets": [], "scripts": [], "route_templates": [], "sources_analyzed": 1}


def test_pages(spark):
    page = """<a href="/x">x</a><script src="/assets/app.js?v=1"></script><script>fetch("/api/users"); fetch(`/api/u/${id}`)</script><script type="application/json">fetch('/api/no')</script><template><script>fetch('/api/not')</script></template>
      <form action="/in" method="post"><input name="csrf_token" type="hidden" value="1"><textarea name="t"></textarea></form> wss://socket.example/ws https://other.example/p"""
    got = web.with_bundle(spark.createDataFrame([("https://e.test/a", page, 1), (None, None, 2)], "url string, html string, n int")).orderBy("n").collect()
    b = got[0]["bundle"]
    assert b["urls"] == ["https://e.test/api/users", "https://e.test/assets/app.js?v=1", "https://e.test/x"] and b["js_endpoints"] == ["https://e.test/api/users"] and b["route_templates"] == ["https://e.test/api/u/{param}"]
    assert b["forms"][0]["action"] == "https://e.test/in" and b["forms"][0]["method"] == "POST" and b["forms"][0]["csrf_fields"] == ["csrf_token"] and b["forms"][0]["fields"][1]["type"] == "text"
    assert "https://other.example/p" in b["apis"] and b["websockets"] == ["wss://socket.example/ws"] and got[1]["bundle"]["urls"] == []
    assert web.main_text("<p>a <b>b</b></p><script>no</script><svg>no</svg>c") == "a b c"


def test_redaction():
    marker = "PAYLOAD"
    cleaned = json.dumps(web.redact_data({"dorks": [marker], "response": {"title": "Useful", "url": f"https://e.test/?q={marker}&view=api"}}))
    assert marker not in cleaned and "Useful" in cleaned and "[QUERY OMITTED]" in cleaned and "%5BREDACTED%5D" in cleaned
    assert "site%3A" not in web.redact("https://e.test/search?site%3Ae.test") and marker not in web.redact(f"query: {marker}; token=private-value")
    assert web.redact_data({"api_key": "k", "nested": {"access_token": "t", "status": "on"}}) == {"api_key": "[REDACTED]", "nested": {"access_token": "[REDACTED]", "status": "on"}}
    text = web.redact('{"api_key":"private-json-key","query":"site:e.test secret","response":"useful"}')
    assert "private" not in text and "site:" not in text and "useful" in text


def test_simhash(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o p"), (3, ""), (4, None), (5, "other words")]
    got = {r["id"]: r["simhash"] for r in web.with_simhash(spark.createDataFrame(rows, "id long, t string"), "t").collect()}
    assert got[1] == got[2] and got[3] == got[4] == -1 and got[5] not in (got[1], -1)
    h = spark.createDataFrame([(i, (v ^ (1 << (i % 5))) if i % 3 else v) for i, v in enumerate([12345678901234] * 9 + [-1] * 3 + [77] * 3)], "k long, h long")
    pairs = {(r["a"], r["b"]) for r in dedupe.near_pairs(h, "k", "h").collect()}
    held = {r["k"]: r["h"] for r in h.collect()}
    parent = {k: k for k in held}
    for a, b in pairs:
        assert bin((held[a] ^ held[b]) & (2**64 - 1)).count("1") <= 3
        x, y = parent[a], parent[b]
        parent = {k: (x if v == y else v) for k, v in parent.items()}
    for a in held:
        for b in held:
            if bin((held[a] ^ held[b]) & (2**64 - 1)).count("1") <= 3:
                assert parent[a] == parent[b]


def test_advisory_feed(spark, tmp_path):
    node = {"operator": "AND", "cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:ac\\:me:widget:*:*:*:*:*:*:*:*", "versionStartIncluding": "1.2.0", "versionEndExcluding": "1.4.0"}]}
    feed = {"vulnerabilities": [{"cve": {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "t"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 7.5}}]}, "configurations": [{"nodes": [node]}]}}, {"cve": {"id": "CVE-2", "vulnStatus": "Rejected"}}]}
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    rows = files.advisories(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["vendor"] == "ac:me" and rows[0]["version_start_including"] == "1.2.0" and rows[0]["context_required"] and rows[0]["severity"] == "7.5" and len(rows[0]["snapshot_sha256"]) == 64


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url":"https://a.e.test/1"}\n\nnot json\n[1]\n{"url":"https://o.test/"}\n')
    assert files.jsonl(spark, str(tmp_path / "a.jsonl"), "url string").count() == 2
    with pytest.raises(ValueError, match="line 3"):
        files.jsonl_strict(spark, str(tmp_path / "a.jsonl"), "url string")
    (tmp_path / "b.jsonl").write_text('{"url":"https://a.e.test/1"}\n{"url":"https://o.test/"}\n')
    rows, dropped = files.jsonl_strict(spark, str(tmp_path / "b.jsonl"), "url string", ["e.test"])
    assert rows.count() == 1 and dropped == 1
    assert [(r["line"], r["content"]) for r in files.report_lines(spark, str(tmp_path / "b.jsonl")).orderBy("line").collect()][1] == (2, '{"url":"https://o.test/"}')
    assert files.discover(spark, str(tmp_path), "*.jsonl").count() == 2


def test_providers(spark):
    assert values(spark, providers.status(F.col("s"), F.col("b")), [(200, "{}"), (200, "x"), (200, "[1]"), (429, ""), (503, ""), (302, ""), (422, ""), (418, "")], "s int, b string") == ["ok", "invalid_json", "invalid_response", "rate_limited", "provider_unavailable", "redirect_blocked", "invalid_request", "http_error"]
    body = json.dumps({"result": {"resource": {"ip": "1.2.3.4", "services": [{"port": 443}, {"port": 80}, {"port": 443}, {"port": "x"}], "autonomous_system": {"asn": 5, "name": "n"}, "dns": {"names": ["a.test"]}}}})
    s = providers.host_services(spark.createDataFrame([(body,)], "body string")).first()["summary"]
    assert s["ports"] == [80, 443] and s["service_count"] == 4 and s["asn"] == 5 and s["dns_names"] == ["a.test"]
    s = providers.leaks(spark.createDataFrame([(json.dumps({"Services": [{"host": "h", "leak": {"type": "t"}}], "leaks": None}),)], "body string")).first()["summary"]
    assert s["services_count"] == 1 and s["leaks_count"] == 0 and s["services"][0]["leak_type"] == "t"
    names = providers.certificate_names(spark.createDataFrame([(json.dumps([{"name_value": "*.A.ex.com\nex.com\nother.org"}]),)], "body string").withColumn("body", F.lower("body")), "ex.com")
    assert [r["name"] for r in names.collect()] == ["a.ex.com", "ex.com"]
    found = providers.mail_findings(spark.createDataFrame([("d", "d", "v=spf1 ~all"), ("d", "_dmarc.d", "v=DMARC1; p=none")], "domain string, name string, txt string"))
    assert {r["issue"] for r in found.collect()} == {"spf softfail", "dmarc p=none", "no dkim selector"}


def test_sinks_and_history(spark, tmp_path):
    rows = spark.createDataFrame([("HIGH", "=1|2", "https://u:p@e.com/?a=1", "x" * 600)], "severity string, name string, url string, evidence string")
    one = sinks.findings_csv(rows).first()
    assert one["name"] == "'=1|2" and one["url"] == "https://e.com/?a=%5Bredacted%5D" and len(one["evidence"]) == 500 and one["cve"] == ""
    assert "=1\\|2" in sinks.markdown_rows(rows).first()["line"]
    assert sinks.write_jsonl(rows, str(tmp_path / "j")) == 1
    ev = spark.createDataFrame([(1, "t", "vulnerability.x", '{"id":1}'), (2, "t", "integration.status", '{"provider":"p","s":1}'), (3, "t", "integration.status", '{"provider":"p","s":2}'), (4, "t", "scan.summary", "{}")], "ordinal long, target string, event string, data string")
    r = sinks.event_reports(ev).first()
    assert r["summary"] == "{}" and r["findings"] == ['{"id":1}'] and r["integrations"] == {"p": '{"provider":"p","s":2}'}


def test_risk_scores(spark):
    rows = [("a", "CRITICAL")] + [("a", "INFO")] * 100 + [("b", "INFO")] + [("c", "LOW")] * 3
    got = {r["target"]: r for r in fn.risk_scores(spark.createDataFrame(rows, "target string, severity string")).collect()}
    assert got["a"]["saturating"] == 5.0 and got["a"]["mean"] == 10.0 and got["b"]["mean"] == got["b"]["saturating"] == 0.0 and got["c"]["saturating"] == 1.5


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    got = {r["url"]: r["depth"] for r in frontier.expand(links, spark.createDataFrame([("a",)], "url string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_stream_equals_batch(spark, tmp_path):
    from skeinlake.streaming.telemetry import windowed

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", "6 hours", "event_type", "value", "40 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r["window"]["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in rows)
    assert key(spark.sql("select * from w").collect()) == key(windowed(events, "ts", "6 hours", "event_type", "value").collect())


def test_api_descriptions(spark):
    from skeinlake.operators import api

    doc = json.dumps({"openapi": "3.0.0", "security": [{"k": []}], "paths": {"/users/{id}": {"get": {"operationId": "one", "security": [], "parameters": [{"name": "user_id", "in": "path"}]}, "delete": {}, "x-other": {}}, "/open": {"post": {}}}})
    df = spark.createDataFrame([("http://a/openapi.json", doc), ("https://b", "{}"), ("https://c", "no json")], "url string, body string")
    assert {(r["path"], r["method"], r["operation_id"]) for r in api.operations(df).collect()} == {("/users/{id}", "GET", "one"), ("/users/{id}", "DELETE", None), ("/open", "POST", None)}
    got = {(r["path"], r["method"], r["id"]) for r in api.review(df).collect()}
    assert ("/users/{id}", "GET", "openapi-operation-security-empty") in got and ("/users/{id}", "GET", "api-object-reference-review") in got and ("/users/{id}", "DELETE", "api-state-change-auth-review") not in got
    assert values(spark, api.graphql_review(F.lit("https://x/graphql"), F.col("x")), ['{"__schema":1}', 'errors: [stack', "{}"]) == [["graphql-introspection"], ["graphql-error-detail"], []]
    assert values(spark, api.api_urls(F.col("x")), ["a 'https://h/x' \"/api/v1\" '/other' wss://s/y"]) == [["https://h/x", "wss://s/y", "/api/v1"]]


def test_secrets_never_show_values(spark):
    from skeinlake.functions import secrets

    key = "AKIA" + "ABCDEFGH12345678"
    rows = [(2, f"x {key} y"), (1, f"{key} password = 'changeme123' api_key: 'aB3dE5fG7hI9jK1lM3nO5'"), (3, "nothing")]
    got = secrets.scan(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert {(r["id"], r["kind"], r["length"]) for r in got} == {(1, "AWS Access Key", 20), (1, "API Key generica", 21)}
    assert key not in str(got)
    assert values(spark, secrets.jwt_algorithm(F.col("x")), ["eyJhbGciOiJub25lIn0.e30.", "junk"]) == ["none", None]


def test_evidence_and_small_functions(spark):
    from skeinlake.functions import evidence as ev

    df = spark.createDataFrame([("https://a/", 200, "héllo", 404, "hello"), ("https://a/", 200, "x", None, None)], "url string, status int, body string, s0 int, b0 string")
    a, b = (r["e"] for r in df.select(ev.evidence("get", F.col("url"), F.col("status"), F.col("body"), F.col("s0"), F.col("b0")).alias("e")).collect())
    assert a["response"]["body_length"] == 6 and a["delta"]["body_length_delta"] == 1 and a["delta"]["status_changed"] and not b["delta"]["compared"] and b["baseline"]["status"] == 200
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert values(spark, ev.retry_after(F.col("x"), now), ["120", "-5", "Mon, 01 Jan 2024 00:01:00 GMT", "soon"]) == [120.0, 0.0, 60.0, None]
    stored = ev.storage_rows(spark.createDataFrame([("n", "e" * 900)], "name string, evidence string"), F.lit(7)).first()
    assert stored["scan_id"] == 7 and len(stored["evidence"]) == 500 and stored["severity"] == "INFO" and stored["cve"] == "" and len(stored) == 21
    done = ev.normalise(spark.createDataFrame([("csp-missing", "https://u@A/?q=1")], "id string, url string")).first()
    assert done["id"] == "headers.csp" and done["stage"] == "CONFIRMED" and done["confidence_score"] == 90 and done["url"] == "https://a/?q=%5Bredacted%5D"
    forms = web.with_bundle(spark.createDataFrame([("https://e/", "<form method=post><input name=q></form><form method=post><input name=authenticity_token></form><form><input name=z></form>")], "url string, html string"))
    assert forms.select(F.size(ev.unprotected_forms(F.col("bundle.forms"), F.lit(False))).alias("n")).first()["n"] == 1
    line = values(spark, ev.log_line(F.lit("integration.status"), F.lit("2024-01-01T00:00:00Z"), F.lit("t"), F.col("x")), ['{"provider":"p\\u0007q","status":"ok"}'])
    assert line == ["2024-01-01 00:00:00 | API p q: ok"]


def test_store(spark, tmp_path):
    from skeinlake.operators.store import Store

    store = Store(spark, str(tmp_path / "db"))
    f = spark.createDataFrame([(1, "t", "a", "HIGH", "2024-01-01"), (2, "t", "a", "LOW", "2024-01-02"), (3, "t", "b", "LOW", "2024-01-01")], "ordinal long, target string, id string, severity string, seen_at string")
    assert store.add_scan({"target": "t"}, f) == 1
    assert store.add_scan({"target": "t"}, f.where("id = 'a'").withColumn("seen_at", F.lit("2024-02-01"))) == 2
    h = {r["occurrences"]: (r["first_seen"], r["last_seen"], r["severity"]) for r in store.top_history().collect()}
    assert h == {4: ("2024-01-01", "2024-02-01", "LOW"), 1: ("2024-01-01", "2024-01-01", "LOW")}
    assert store.read("findings").count() == 3 and [r["id"] for r in store.recent_scans().collect()] == [2, 1]
    assert set(store.problems().values()) == {0}


def test_event_streams(spark, tmp_path):
    from skeinlake.streaming import events

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.jsonl").write_text('{"schema_version":"1.0","event":"scan.summary","target":"t","data":{"a":1}}\nnot json\n')
    (tmp_path / "log" / "2.jsonl").write_text('{"event":"surface.hint","data":{}}\n')
    q = events.records(events.tail(spark, str(tmp_path / "log"), 1)).writeStream.format("memory").queryName("ev").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["event"], r["data"]) for r in spark.sql("select * from ev").collect()}
    assert got == {("scan.summary", '{"a":1}'), ("surface.hint", "{}")}


def test_template_files_and_options(tmp_path):
    pytest.importorskip("yaml")
    from skeinlake.sources import templates

    (tmp_path / "a.yaml").write_text("id: one-rule\nmatchers:\n  - type: word\n    values: [x]\n")
    (tmp_path / "b.yml").write_text("id: one-rule\nmatchers:\n  - type: word\n    values: [x]\n")
    (tmp_path / "c.yaml").write_text("id: two-rule\nid: three\n")
    (tmp_path / "d.yaml").write_text("[]")
    found, errors = templates.load(str(tmp_path))
    assert [t["id"] for t in found] == ["one-rule"] and [e[0] for e in errors] == ["b.yml", "c.yaml", "d.yaml"]
    (tmp_path / "o.json").write_text('{"max_depth": 5}')
    assert templates.Options.load(str(tmp_path / "o.json"), {"SKEINLAKE_MAX_ITEMS": "7"}) == templates.Options(max_depth=5, max_items=7)
    with pytest.raises(ValueError):
        templates.Options.load(None, {"SKEINLAKE_MAX_DEPTH": "99"})
    assert templates.plugins() == {}
