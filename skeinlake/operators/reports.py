"""Reports that are one file: text, sections as CSV, event logs, and other forms of report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import findings as fn
from ..functions import urls as u
from ..functions.text import csv_cell, csv_line
from ..functions.verdicts import clip
from ..functions.web import with_redacted
from ..sources import files, onefile
from .store import number

# The wording of the text report.
RULE = "=" * 80
SUMMARY, LIMITS = "[RESUMO EXECUTIVO]", "- Evidências limitadas a 500 caracteres e segredos são redigidos."
LEVELS = (("CRÍTICO", "CRITICAL"), ("ALTO", "HIGH"), ("MÉDIO", "MEDIUM"), ("BAIXO", "LOW"), ("INFO", "INFO"))
IMPACT = "Requer validação contextual do impacto."
ENDPOINTS, TECHNOLOGIES, RAW = "[ANEXO A] ENDPOINTS DISCOVERED", "[ANEXO B] TECHNOLOGIES DETECTED", "[ANEXO C] RAW NMAP OUTPUT"

# Header, and key, label, target and detail of the sections of the CSV report. {field} stands for a field of the item.
HEADER = ("categoria", "severidade", "alvo", "detalhe")
SECTIONS = (
    ("secrets_js", "Secrets em JavaScript", "url", "{tipo}: [REDACTED]"),
    ("cors", "CORS Misconfiguration", "url", "origin={origin_testada} acao={acao}"),
    ("subdomain_takeover", "Subdomain Takeover", "subdomain", "{service}"),
    ("open_redirect", "Open Redirect", "url", "param={param}"),
    ("outdated_versions", "Versao Desatualizada", "software", "{version_detected}"),
    ("cache_poisoning", "Web Cache Poisoning", "url", "header={header}"),
    ("http_smuggling", "HTTP Request Smuggling", "url", "{technique}"),
    ("jwt_weaknesses", "JWT Weakness", "url", "{issue}"),
    ("error_disclosure", "Error Disclosure", "url", "{tipo}"),
    ("http_methods", "HTTP Methods Perigosos", "url", "{dangerous}"),
    ("search", "Busca automatizada — respostas", "link", "[{confidence}] {titulo} — {snippet}"),
    ("security_headers", "Security Header Ausente", "header", "{desc}"),
    ("subdomains", "Subdominio (crt.sh)", "", ""),
)

#: Columns of a CSV file, at most: a line of more is no table, and the file an error.
WIDTH = 10_000


def _lines(rows: DataFrame, section: int, item: Column, lines: Column) -> DataFrame:
    """(section, item, lines) of an array of lines a row; null ones are left out."""
    return rows.select(F.lit(section).alias("section"), item.cast("long").alias("item"), F.filter(lines, lambda x: x.isNotNull()).alias("lines"))


def text_blocks(
    findings: DataFrame, title: str, target: str, date: str, *, ip: str = "unknown", duration: str = "unknown", mode: str = "Scan", endpoints: DataFrame | None = None, technologies: DataFrame | None = None, raw: str | None = None
) -> DataFrame:
    """(section, item, lines): the blocks of a text report, each an array of lines; in the order of the first two columns they are the report.

    findings (ordinal, and any of name, id, severity, stage, confidence, confidence_score, url, parameter, evidence, impact, remediation, cwe, cve; observed_at,
    source, response_status, response_sha256, baseline_status, baseline_sha256 and delta where evidence was kept) are numbered in the order of ordinal, all
    of them. endpoints and technologies (ordinal, value) are an annex each, of the first 500 and 200 as the report has it; the summary counts all endpoints.
    A null or a missing column has the report's default. Line feeds in values stay, so such a value takes several lines of the file.
    Equal ordinals stand in any order. No findings: risk 0.0 and no blocks.
    """
    spark = findings.sparkSession

    def held(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in findings.columns else F.lit(default)

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    one = spark.range(1)
    severity = F.upper(held("severity", "INFO"))
    safe = u.sanitize(F.lit(target))
    n_endpoints = (endpoints if endpoints is not None else one.where("false")).agg(F.count("*").cast("string").alias("n"))
    risk = fn.risk_scores(findings.select(severity.alias("severity")), ()).select(F.format_number("mean", 1).alias("risk"))
    counts = findings.select(severity.alias("s")).agg(*[F.count_if(F.col("s") == s).alias(s) for _, s in LEVELS])
    levels = [x for shown, s in LEVELS for x in (f" | {shown}: ", F.col(s).cast("string"))]
    levels[0] = f"- {LEVELS[0][0]}: "
    out = [
        _lines(one, 0, F.lit(0), F.array(F.lit(RULE), F.lit(title), F.lit(RULE), text("ALVO: ", F.when(safe != "", safe).otherwise(target), f" | IP: {ip} | DATA: {date}"))),
        _lines(risk, 0, F.lit(1), F.array(text(f"DURAÇÃO: {duration} | MODO: {mode} | RISK SCORE: ", F.col("risk"), "/10"), F.lit(RULE), F.lit(""), F.lit(SUMMARY))),
        _lines(counts, 0, F.lit(2), F.array(text(*levels))),
        _lines(n_endpoints, 0, F.lit(3), F.array(text("- Superfície analisada: ", F.col("n"), " endpoints"), F.lit(LIMITS), F.lit(""))),
    ]
    impact, parameter, kept = held("impact"), held("parameter"), held("observed_at") != ""
    name = F.coalesce(F.col("name").cast("string"), held("id", "Unnamed")) if "name" in findings.columns else held("id", "Unnamed")
    block = F.array(
        text("] ", name, " — ", severity, " — ", held("stage", "POSSIBLE"), " — CONFIDENCE: ", F.upper(held("confidence", "MEDIUM")), " — SCORE: ", held("confidence_score", "0"), "/100"),
        text("    URL: ", u.sanitize(held("url"))),
        F.when(parameter != "", text("    Parâmetro: ", parameter)),
        F.lit("    Evidência:"),
        text("      ", clip(held("evidence"))),
        text("    Impacto: ", clip(F.when(impact != "", impact).otherwise(IMPACT))),
        text("    Remediação: ", clip(held("remediation"))),
        text("    CWE: ", held("cwe"), " | CVE: ", held("cve")),
        F.when(kept, text("    Observado em: ", held("observed_at"))),
        F.when(kept, text("    Origem: ", held("source"))),
        F.when(kept, text("    Resposta: HTTP ", held("response_status", "None"), " | SHA-256 ", held("response_sha256"))),
        F.when(kept, text("    Baseline: HTTP ", held("baseline_status", "None"), " | SHA-256 ", held("baseline_sha256"))),
        F.when(kept, text("    Diferencial: ", held("delta", "{}"))),
        F.lit(""),
    )
    numbered = number(findings.select("ordinal", block.alias("lines")), "ordinal", 0)
    own = F.transform("lines", lambda x, i: F.when(i == 0, F.concat(F.lit("["), F.col("id").cast("string"), x)).otherwise(x))
    out.append(_lines(numbered, 1, F.col("id"), own))
    for section, title_of, rows, most in ((2, ENDPOINTS, endpoints, 500), (3, TECHNOLOGIES, technologies, 200)):
        out.append(_lines(one, section, F.lit(0), F.array(*([F.lit("")] if section == 3 else []), F.lit(title_of))))
        if rows is not None:
            first = number(rows.orderBy("ordinal").limit(most).select("ordinal", "value"), "ordinal", 0)
            out.append(_lines(first, section, F.col("id"), F.array(text("  - ", F.coalesce(F.col("value").cast("string"), F.lit(""))))))
    if raw:
        out.append(_lines(one, 4, F.lit(0), F.array(F.lit(""), F.lit(RAW), clip(F.lit(raw)))))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def text_lines(findings: DataFrame, *args, **options) -> DataFrame:
    """(section, item, part, line): the lines of text_blocks(); in the order of the first three columns they are the report."""
    return text_blocks(findings, *args, **options).select("section", "item", F.posexplode("lines").alias("part", "line"))


def write_text(findings: DataFrame, path: str, **options) -> int:
    """Writes text_blocks() as one file and gives its bytes; a block is dealt and placed as one text, not line by line."""
    blocks = text_blocks(findings, **options).where(F.size("lines") > 0)
    return onefile.write(blocks.select("section", "item", F.array_join("lines", "\n").alias("text")), ("section", "item"), "text", path)


def csv_lines(items: DataFrame) -> DataFrame:
    """(section, ordinal, line): the header and the rows of the CSV report, from items (section: a key of SECTIONS, ordinal, item: JSON).

    Values of secrets aren't shown and their URLs are sanitised, severities are INFO where none is given, cells that a spreadsheet would take for a formula
    get a quote in front, and fields are quoted where they must be. Items of other sections, null ones and those that are no JSON object (subdomains: text) are left out.
    """
    value = lambda name, default="": F.coalesce(F.get_json_object("item", f"$.{name}"), F.lit(default))

    def field(name: str) -> Column:
        if name == "confidence":
            return value(name, "baixa")
        if name == "snippet":
            return F.substring(value(name), 1, 300)
        return F.array_join(F.from_json(value(name, "[]"), "array<string>"), ", ") if name == "dangerous" else value(name)

    def filled(form: str) -> Column:
        parts = [x for piece in form.split("{") for x in ([piece] if "}" not in piece else [field(piece.split("}")[0]), piece.split("}")[1]])]
        return F.concat(F.lit(""), *[F.lit(x) if isinstance(x, str) else x for x in parts])

    place, cells = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    for i, (key, label, target, detail) in enumerate(SECTIONS):
        here = F.col("section") == key
        whose = F.col("item") if key == "subdomains" else u.sanitize(value(target)) if key == "secrets_js" else value(target)
        severity = F.lit("INFO") if key == "subdomains" else value("severity", "INFO")
        place = F.when(here, i + 1).otherwise(place)
        cells = F.when(here, F.array(F.lit(label), severity, whose, filled(detail))).otherwise(cells)
    known = items.where("item is not null").where((F.col("section") == "subdomains") | files.is_object(F.col("item")))
    rows = known.select(place.alias("section"), F.col("ordinal").cast("long").alias("ordinal"), csv_line(F.transform(cells, csv_cell)).alias("line")).where("section is not null")
    return items.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("ordinal"), csv_line(F.array(*map(F.lit, HEADER))).alias("line")).unionByName(rows)


def write_csv(items: DataFrame, path: str) -> int:
    """Writes csv_lines() as one file and gives its bytes."""
    return onefile.write(csv_lines(items), ("section", "ordinal", "line"), "line", path, end="\r\n")


def write_events(events: DataFrame, path: str, order: Sequence[str] = ("ordinal",)) -> int:
    """Writes all columns of events but those of the order as an event log of JSON lines, one file; null fields are left out."""
    rows = events.select(*order, F.to_json(F.struct(*[c for c in events.columns if c not in order])).alias("_line"))
    return onefile.write(rows, order, "_line", path)


def export_file(spark, path: str, out: str, kind: str) -> int:
    """A report file, redacted, as one CSV or JSONL file; gives its bytes. Several files follow one another by name.

    Lines that are JSON are its rows; of a file without any the rows are line and content. As CSV the columns are the sorted union of the keys (at most
    WIDTH, else an error), and content without any rows; cells have no quote in front: open no file of strangers in a spreadsheet.
    """
    if kind not in ("csv", "jsonl"):
        raise ValueError(f"{kind} is neither csv nor jsonl")
    plain = F.to_json(F.struct("line", "content"))
    rows = files.report_rows(spark, path).select("file", "line", F.coalesce("object", plain).alias("value"))
    if kind == "jsonl":
        return onefile.write(rows, ("file", "line"), "value", out)
    held = rows.select("file", "line", F.from_json("value", "map<string,string>").alias("m"))
    keys = [r["k"] for r in held.select(F.explode(F.map_keys("m")).alias("k")).distinct().orderBy("k").limit(WIDTH + 1).collect()]
    if len(keys) > WIDTH:
        raise ValueError(f"{path} has more than {WIDTH} keys")
    names = F.array(*map(F.lit, keys or ["content"]))
    head = spark.range(1).select(F.lit("").alias("file"), F.lit(0).cast("long").alias("line"), csv_line(names).alias("text"))
    cells = F.transform(names, lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit("")))
    return onefile.write(head.unionByName(held.select("file", "line", csv_line(cells).alias("text"))), ("file", "line"), "text", out, end="\r\n")
