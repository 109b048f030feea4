import csv
import io
import json

from pyspark.sql import functions as F

from skeinlake.operators import reports
from skeinlake.sources import onefile

RULE = "=" * 80
TEXT = f"""{RULE}
REPORT
{RULE}
ALVO: https://a.example/x?q=%5Bredacted%5D | IP: 192.0.2.1 | DATA: 2024-01-01
DURAÇÃO: 3s | MODO: Scan | RISK SCORE: 5.5/10
{RULE}

[RESUMO EXECUTIVO]
- CRÍTICO: 1 | ALTO: 0 | MÉDIO: 0 | BAIXO: 1 | INFO: 1
- Superfície analisada: 2 endpoints
- Evidências limitadas a 500 caracteres e segredos são redigidos.

[1] first.id — INFO — POSSIBLE — CONFIDENCE: MEDIUM — SCORE: 0/100
    URL: 
    Evidência:
      
    Impacto: Requer validação contextual do impacto.
    Remediação: 
    CWE:  | CVE: 

[2] Second — CRITICAL — CONFIRMED — CONFIDENCE: HIGH — SCORE: 95/100
    URL: https://a.example/b
    Parâmetro: p
    Evidência:
      token=<redacted> seen
    Impacto: bad
    Remediação: fix it
    CWE: CWE-79 | CVE: CVE-2024-1
    Observado em: 2024-01-02
    Origem: passive
    Resposta: HTTP 200 | SHA-256 ab
    Baseline: HTTP None | SHA-256 
    Diferencial: {{}}

[3] Third — LOW — POSSIBLE — CONFIDENCE: MEDIUM — SCORE: 0/100
    URL: 
    Evidência:
      
    Impacto: Requer validação contextual do impacto.
    Remediação: 
    CWE:  | CVE: 

[ANEXO A] ENDPOINTS DISCOVERED
  - /b
  - /a

[ANEXO B] TECHNOLOGIES DETECTED
  - nginx

[ANEXO C] RAW NMAP OUTPUT
80/tcp password=<redacted>
"""


def test_text_report_is_byte_equal_to_its_golden_form(spark, tmp_path):
    names = "ordinal long, name string, id string, severity string, stage string, confidence string, confidence_score int, url string, parameter string, evidence string, impact string, remediation string, cwe string, cve string, observed_at string, source string, response_status int, response_sha256 string"
    rows = [
        (9, "Third", "c", "low", None, None, None, None, None, None, "", None, None, None, "", None, None, None),
        (2, None, "first.id", None, None, None, None, None, "", None, None, None, None, None, None, None, None, None),
        (5, "Second", "b", "critical", "CONFIRMED", "high", 95, "https://u:p@A.example/b#f", "p", "token: abc seen", "bad", "fix it", "CWE-79", "CVE-2024-1", "2024-01-02", "passive", 200, "ab"),
    ]
    findings = spark.createDataFrame(rows, names)
    endpoints = spark.createDataFrame([(2, "/a"), (1, "/b")], "ordinal long, value string")
    technologies = spark.createDataFrame([(1, "nginx")], "ordinal long, value string")
    path = f"{tmp_path}/report.txt"
    reports.write_text(findings.repartition(3), path, title="REPORT", target="https://a.example/x?q=1", date="2024-01-01", ip="192.0.2.1", duration="3s", endpoints=endpoints, technologies=technologies, raw="80/tcp password=abc")
    with open(path, encoding="utf-8") as f:
        assert f.read() == TEXT


def test_text_report_without_findings_and_with_few_columns(spark, tmp_path):
    path = f"{tmp_path}/r.txt"
    reports.write_text(spark.createDataFrame([], "ordinal long, x int"), path, title="T", target="no url", date="d")
    with open(path, encoding="utf-8") as f:
        lines = f.read().split("\n")
    assert "RISK SCORE: 0.0/10" in lines[4] and lines[3].startswith("ALVO: no url |") and lines[12:] == [reports.ENDPOINTS, "", reports.TECHNOLOGIES, ""]


def test_sections_as_csv(spark, tmp_path):
    made = [
        ("subdomains", 1, "a.example"), ("cors", 2, {"url": "https://x/", "origin_testada": "null", "acao": "*", "severity": "HIGH"}), ("cors", 1, {"url": "=1+1", "acao": 'say "a, b"'}),
        ("secrets_js", 1, {"url": "https://u:p@H.example/j?k=v#z", "tipo": "key", "valor": "s3cr3t"}), ("http_methods", 1, {"url": "u", "dangerous": ["PUT", "TRACE"]}), ("other", 1, {"url": "x"}), ("cors", 3, None),
        ("search", 1, {"link": "l", "titulo": "t\nu", "snippet": "é" * 301}), ("search", 2, {"link": "l", "confidence": "alta"}), ("security_headers", 1, {"header": "CSP", "desc": "-missing"}), ("jwt_weaknesses", 1, "no object"),
    ]
    items = spark.createDataFrame([(s, o, i if i is None or isinstance(i, str) else json.dumps(i)) for s, o, i in made], "section string, ordinal long, item string")
    path = f"{tmp_path}/r.csv"
    reports.write_csv(items.repartition(5), path)
    want = [
        ["categoria", "severidade", "alvo", "detalhe"], ["Secrets em JavaScript", "INFO", "https://h.example/j?k=%5Bredacted%5D", "key: [REDACTED]"], ["CORS Misconfiguration", "INFO", "'=1+1", 'origin= acao=say "a, b"'],
        ["CORS Misconfiguration", "HIGH", "https://x/", "origin=null acao=*"], ["HTTP Methods Perigosos", "INFO", "u", "PUT, TRACE"], ["Busca automatizada — respostas", "INFO", "l", "[baixa] t\nu — " + "é" * 300],
        ["Busca automatizada — respostas", "INFO", "l", "[alta]  — "], ["Security Header Ausente", "INFO", "CSP", "'-missing"], ["Subdominio (crt.sh)", "INFO", "a.example", ""],
    ]
    golden = io.StringIO(newline="")
    csv.writer(golden).writerows(want)
    with open(path, newline="", encoding="utf-8") as f:
        assert f.read() == golden.getvalue()


def test_event_log_and_other_forms_of_report_files(spark, tmp_path):
    events = spark.createDataFrame([(3, "scan.summary", None), (1, "crawl.page", 'a "b"'), (2, "crawl.page", "é")], "ordinal long, event string, value string")
    log = f"{tmp_path}/log.jsonl"
    reports.write_events(events, log)
    with open(log, encoding="utf-8") as f:
        assert [json.loads(x) for x in f] == [{"event": "crawl.page", "value": 'a "b"'}, {"event": "crawl.page", "value": "é"}, {"event": "scan.summary"}]
    with open(log, "a") as f:
        f.write('no json\n{"token": "abc", "extra": "x,y"}\n5\n')
    reports.export_file(spark, log, f"{tmp_path}/out.csv", "csv")
    with open(f"{tmp_path}/out.csv", newline="", encoding="utf-8") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["event", "extra", "token", "value"] and len(rows) == 6 and rows[1][3] == 'a "b"' and rows[4][1] == "x,y" and "abc" not in rows[4][2] and rows[5] == ["", "", "", "5"]
    with open(f"{tmp_path}/plain.txt", "w") as f:
        f.write("one\n\ntwo")
    reports.export_file(spark, f"{tmp_path}/plain.txt", f"{tmp_path}/out.jsonl", "jsonl")
    with open(f"{tmp_path}/out.jsonl") as f:
        assert [json.loads(x) for x in f] == [{"line": 1, "content": "one"}, {"line": 2, "content": ""}, {"line": 3, "content": "two"}]


def test_numbers_go_on_over_ranges(spark, tmp_path):
    """Blocks of many findings, in order and numbered without a gap."""
    path = f"{tmp_path}/many.txt"
    findings = spark.range(3000).selectExpr("(id * 7) % 3000 AS ordinal", "concat('n', (id * 7) % 3000) AS name")
    lines = reports.text_lines(findings, "T", "t", "d")
    assert onefile.write(lines, ("section", "item", "part"), "line", path)
    with open(path, encoding="utf-8") as f:
        heads = [x for x in f if x.startswith("[") and "CONFIDENCE" in x]
    assert [h.split(" — ")[0] for h in heads] == [f"[{i + 1}] n{i}" for i in range(3000)]


def test_a_text_report_is_dealt_by_blocks(spark, tmp_path, monkeypatch):
    """One row for each finding goes to the file's writer, not one for each of its lines; the bytes are those of the lines."""
    found = spark.range(7).select(F.col("id").alias("ordinal"), F.lit("x").alias("id"), F.when(F.col("id") % 2 == 0, "a\nb").alias("evidence"))
    options = {"title": "R", "target": "t", "date": "d", "raw": "raw\ntext"}
    lines = [r["line"] for r in reports.text_lines(found, **options).orderBy("section", "item", "part").collect()]
    seen = []
    write = onefile.write
    monkeypatch.setattr(onefile, "write", lambda rows, *a, **k: (seen.append(rows.count()), write(rows, *a, **k))[1])
    path = tmp_path / "r.txt"
    size = reports.write_text(found, str(path), **options)
    assert path.read_text(encoding="utf-8") == "".join(f"{x}\n" for x in lines) and size == path.stat().st_size
    assert seen[0] < len(lines) / 3
