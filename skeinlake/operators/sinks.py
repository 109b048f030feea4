"""Writers of findings, event rows and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u
from ..functions.findings import WEIGHTS
from ..functions.text import csv_cell

#: Fixed value: columns of the findings table as CSV.
CSV_COLUMNS = ("severity", "stage", "confidence", "confidence_score", "name", "url", "cwe", "cve", "remediation", "evidence", "observed_at", "request_sha256", "response_sha256", "baseline_sha256")


def _safe(findings: DataFrame) -> DataFrame:
    out = findings
    for c in ("evidence", "remediation"):
        if c in out.columns:
            out = out.withColumn(c, F.substring(F.coalesce(c, F.lit("")), 1, 500))
    return out.withColumn("url", u.sanitize(F.col("url"))) if "url" in out.columns else out


def findings_csv(findings: DataFrame) -> DataFrame:
    """The fixed columns, empty where they are missing, URLs and formulas made safe."""
    own = _safe(findings)
    return own.select(*[(csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in own.columns else F.lit("")).alias(c) for c in CSV_COLUMNS])


def write_csv(findings: DataFrame, path: str) -> None:
    findings_csv(findings).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Writes rows as JSONL and gives their number, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation("jsonl")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def findings_json(findings: DataFrame) -> Column:
    return F.to_json(F.struct(*_safe(findings).columns))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """(line): a table row for each finding, bars escaped."""
    own = _safe(findings)
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in own.columns else F.lit(""), F.lit("|"), F.lit("\\|"))
    first = F.concat_ws(" / ", cell("severity"), cell("stage"))
    second = F.concat_ws(" / ", cell("confidence"), cell("confidence_score"))
    return own.select(F.concat(F.lit("| "), F.concat_ws(" | ", first, second, *[cell(c) for c in ("name", "url", "cwe", "cve")]), F.lit(" |")).alias("line"))


def severity_shares(findings: DataFrame, by: str) -> DataFrame:
    """(by, severity, n, from_pct, to_pct): segments of a ring chart, from the gravest severity on."""
    from pyspark.sql.window import Window

    rank = F.lit(len(WEIGHTS))
    for i, s in enumerate(WEIGHTS):
        rank = F.when(F.upper("severity") == s, i).otherwise(rank)
    counts = findings.groupBy(by, F.upper("severity").alias("severity")).agg(F.count("*").alias("n"), F.min(rank).alias("rank"))
    w = Window.partitionBy(by)
    upto = F.sum("n").over(w.orderBy("rank", "severity"))
    total = F.sum("n").over(w)
    return counts.select(by, "severity", "n", (100 * (upto - F.col("n")) / total).alias("from_pct"), (100 * upto / total).alias("to_pct"))


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """Distinct lines, sorted."""
    rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).write.mode("overwrite").text(path)


def category_export(events: DataFrame, category: str, path: str, kind: str = "jsonl") -> None:
    """Events (event, line: their JSON) of a category, redacted. As CSV the columns are the sorted union of their keys, category without any."""
    from ..functions.predicates import matches_category
    from ..functions.web import with_redacted

    kept = with_redacted(events.where(matches_category(category, F.col("event"))).select("line"), "line", "safe")
    if kind == "jsonl":
        kept.select("safe").write.mode("overwrite").text(path)
        return
    held = kept.select(F.from_json("safe", "map<string,string>").alias("m"))
    keys = [r["k"] for r in held.select(F.explode(F.map_keys("m")).alias("k")).distinct().orderBy("k").collect()] or ["category"]
    held.select(*[csv_cell(F.try_element_at("m", F.lit(k))).alias(k) for k in keys]).write.mode("overwrite").option("header", True).csv(path)


def event_reports(events: DataFrame) -> DataFrame:
    """(target, summary, findings, integrations) from events (ordinal, target, event, data): the first summary, findings of vulnerability events in order, the last word of each provider."""
    first = events.where("event = 'scan.summary'").groupBy("target").agg(F.min_by("data", "ordinal").alias("summary"))
    found = events.where("startswith(event, 'vulnerability.')").groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "data"))), lambda x: x["data"]).alias("findings"))
    words = events.where("event = 'integration.status'").withColumn("provider", F.get_json_object("data", "$.provider")).where("provider is not null").groupBy("target", "provider").agg(F.max_by("data", "ordinal").alias("data"))
    last = words.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("provider", "data"))).alias("integrations"))
    return events.select("target").distinct().join(first, "target", "left").join(found, "target", "left").join(last, "target", "left")
