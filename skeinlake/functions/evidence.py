"""Evidence of findings without bodies, and rows for storage and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import findings as fn
from . import urls as u


def evidence(method: str, url: Column, status: Column, body: Column, base_status: Column, base_body: Column) -> Column:
    """struct(request, response, baseline, delta) of hashes and lengths in bytes; without a baseline the response is its own."""
    text = F.coalesce(body, F.lit(""))
    has = base_body.isNotNull()
    base = F.coalesce(base_body, text)
    return F.struct(
        F.struct(F.lit(method.upper()).alias("method"), u.request_sha256(method, url).alias("sha256")).alias("request"),
        F.struct(status.alias("status"), F.octet_length(text).alias("body_length"), F.sha2(text, 256).alias("body_sha256")).alias("response"),
        F.struct(F.when(has, base_status).otherwise(status).alias("status"), F.octet_length(base).alias("body_length"), F.sha2(base, 256).alias("body_sha256")).alias("baseline"),
        F.struct(has.alias("compared"), F.when(has, ~status.eqNullSafe(base_status)).alias("status_changed"), F.when(has, F.sha2(text, 256) != F.sha2(base, 256)).alias("body_hash_changed"), F.when(has, F.octet_length(text) - F.octet_length(base)).alias("body_length_delta")).alias("delta"),
    )


def summary(row: DataFrame, column: str = "evidence") -> DataFrame:
    """row with only what may be shown of evidence: hashes of 64 hex digits, lengths and states."""
    e = F.col(column)
    sha = lambda c: F.when(c.rlike("^[0-9a-fA-F]{64}$"), c)
    return row.withColumn(column, F.struct(e["request"]["method"].alias("request_method"), sha(e["request"]["sha256"]).alias("request_sha256"), e["response"]["status"].alias("response_status"), sha(e["response"]["body_sha256"]).alias("response_body_sha256"), e["baseline"]["status"].alias("baseline_status"), e["delta"].alias("delta")))


#: name, default
STORED = (
    ("name", ""), ("severity", "INFO"), ("confidence", "MEDIUM"), ("url", ""), ("evidence", ""), ("remediation", ""), ("cwe", ""), ("cve", ""), ("stage", "POSSIBLE"), ("confidence_score", 0), ("observed_at", ""), ("source", ""), ("request_sha256", ""), ("response_sha256", ""),
    ("baseline_sha256", ""), ("evidence_json", ""), ("cve_source", ""), ("cve_schema_version", ""), ("cve_retrieved_at", ""), ("cve_dataset_sha256", ""),
)


def storage_rows(findings: DataFrame, scan_id: Column) -> DataFrame:
    """The stored columns with their defaults; defaults are empty texts, not nulls."""
    cols = []
    for name, default in STORED:
        c = F.coalesce(F.col(name), F.lit(default)) if name in findings.columns else F.lit(default)
        cols.append((F.substring(c.cast("string"), 1, 500) if name == "evidence" else c).alias(name))
    return findings.select(scan_id.alias("scan_id"), *cols)


def normalise(findings: DataFrame) -> DataFrame:
    """findings (id, url, evidence, stage, ...) as the pipeline stores them: canonical id, stage by policy where none is given, score, safe URL."""
    fid = fn.alias_id(F.col("id"))
    given = F.col("stage") if "stage" in findings.columns else F.lit(None).cast("string")
    stage = F.coalesce(F.when(given.isin(*fn.BASE), given), fn.stage(fid))
    out = findings.withColumn("id", fid).withColumn("stage", stage).withColumn("url", u.sanitize(F.col("url")))
    return out.withColumn("confidence_score", fn.score(F.col("stage"), {"direct_observation": F.lit(True), "heuristic_only": F.col("stage") == "POSSIBLE", "high_quality_fingerprint": F.startswith(F.col("id"), F.lit("cve."))}))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, as a number or an HTTP date; null if it is neither."""
    date = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.coalesce(F.trim(value).try_cast("int").cast("double"), date.cast("double") - now.cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))  # greatest alone would pass over a null


#: Names of tokens in forms and pages.
TOKEN_FIELDS, TOKEN_NAMES = "csrf|xsrf|authenticity|requestverification|antiforgery|nonce", ("token", "formtoken")
TOKEN_METAS = ("csrf", "csrftoken", "xsrf", "xsrftoken", "authenticitytoken", "requestverificationtoken")


def unprotected_forms(forms: Column, has_meta_token: Column) -> Column:
    """Forms that are posted without a token of theirs or of the page."""
    bare = lambda n: F.regexp_replace(F.lower(F.coalesce(n, F.lit(""))), "[^a-z0-9]", "")
    token = lambda f: F.exists(f["fields"], lambda x: bare(x["name"]).rlike(TOKEN_FIELDS) | bare(x["name"]).isin(*TOKEN_NAMES))
    return F.filter(forms, lambda f: (F.lower(f["method"]) == "post") & ~token(f) & ~has_meta_token)


def log_line(event: Column, timestamp: Column, target: Column, data: Column) -> Column:
    """One line for the viewer of an event record, control characters blanked."""
    get = lambda p: F.coalesce(F.get_json_object(data, f"$.{p}"), F.lit(""))
    text = (
        F.when(event == "scan.summary", F.concat(F.lit("SCAN "), target, F.lit(" | "), get("pages_crawled"), F.lit(" pages")))
        .when(event.isin("vulnerability.confirmed", "vulnerability.candidate"), F.concat(F.lit("FINDING "), get("stage"), F.lit(" ["), get("severity"), F.lit("] "), get("name"), F.lit(" | "), get("url")))
        .when(event == "search.response", F.concat(F.lit("RESULT "), get("provider"), F.lit(" ["), get("confidence"), F.lit("] "), get("titulo"), F.lit(" | "), get("link")))
        .when(event == "integration.status", F.concat(F.lit("API "), get("provider"), F.lit(": "), get("status")))
        .when(event == "crawl.summary", F.concat(F.lit("CRAWL | "), get("pages"), F.lit(" pages | "), get("endpoints"), F.lit(" endpoints")))
        .otherwise(data)
    )
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Cc}", " "), r"\s+", " "))
    return F.concat(F.regexp_replace(F.substring(timestamp, 1, 19), "T", " "), F.lit(" | "), clean)
