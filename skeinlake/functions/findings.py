"""Findings: stage policy, evidence score, fingerprints, risk scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
CONFIRMED = (
    "headers.csp", "headers.xcto", "tls.hsts", "headers.referrer-policy", "csp-missing", "security header ausente", "headers-security", "headers_security", "ssl_tls", "cookie.prefix-secure", "cookie.prefix-host",
    "cookie.samesite-none-secure", "cors.invalid-credentialed-wildcard",
)
PROBABLE_FIRST = ("sqli.error-differential", "server-error-detail-confirmed")
PROBABLE = ("directory-listing", "server-disclosure", "x-powered-by-disclosure", "directory_listing", "open_redirect", "cors", "information_disclosure")
POSSIBLE = ("potential-secret-disclosure", "possible-secret-disclosure")
BASE = {"POSSIBLE": 20, "PROBABLE": 50, "CONFIRMED": 75}
FACTORS = {
    "direct_observation": 15, "baseline_compared": 10, "differential_signal": 15, "unique_marker": 10, "repeatable": 10, "high_quality_fingerprint": 5, "heuristic_only": -10, "lexical_only": -15, "unresolved_context": -10, "partial_response": -5,
}
WEIGHTS = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 1, "INFO": 0}
LEGACY_WEIGHTS = {"CRITICO": 10, "ALTO": 7, "MEDIO": 4, "BAIXO": 1, "INFO": 0}
ALIASES = {"csp-missing": "headers.csp", "headers-security.xcto": "headers.xcto", "potential-secret-disclosure": "possible-secret-disclosure", "information-disclosure.server": "server-disclosure"}


def stage(finding_id: Column, default: str = "POSSIBLE") -> Column:
    """Only what can be seen directly is confirmed; the order of the rules counts."""
    key = F.lower(F.coalesce(finding_id, F.lit("")))
    return (
        F.when(key.isin(*CONFIRMED), "CONFIRMED").when(key.isin(*PROBABLE_FIRST), "PROBABLE").when(F.contains(key, F.lit("cve")) | (key == "vulnerable_components"), "POSSIBLE")
        .when(key.isin(*PROBABLE), "PROBABLE").when(key.isin(*POSSIBLE), "POSSIBLE").otherwise(default if default in BASE else "POSSIBLE")
    )


def score(of_stage: Column, factors: Mapping[str, Column]) -> Column:
    """Strength of evidence, 0 to 100: the stage's base and the weights of the factors that hold."""
    total = F.lit(BASE["POSSIBLE"])
    for name in ("PROBABLE", "CONFIRMED"):
        total = F.when(of_stage == name, BASE[name]).otherwise(total)
    for name, holds in factors.items():
        total = total + F.when(holds, FACTORS.get(name, 0)).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), total))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns joined by |; null counts as empty, as concat_ws would leave it out."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def weight(of_severity: Column, weights: Mapping[str, int] = WEIGHTS) -> Column:
    out = F.lit(0)
    for name, w in weights.items():
        out = F.when(F.upper(of_severity) == name, w).otherwise(out)
    return out


def alias_id(finding_id: Column) -> Column:
    out = finding_id
    for a, b in ALIASES.items():
        out = F.when(finding_id == a, b).otherwise(out)
    return out


def risk_scores(findings: DataFrame, by: Sequence[str] = ("target",), severity: str = "severity") -> DataFrame:
    """(by, n, mean_bonus, mean, saturating, legacy): the four risk scores from one aggregation. 0 where only INFO was found."""
    up = F.upper(F.coalesce(F.col(severity), F.lit("INFO")))
    sums = findings.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(up != "INFO").alias("k"), F.sum(weight(up)).alias("w"), F.count_if(up.isin("CRITICAL", "HIGH")).alias("top"), F.sum(weight(up, LEGACY_WEIGHTS)).alias("lw")
    )
    ten = lambda c: F.bround(F.least(F.lit(10.0), c), 1)
    return sums.select(
        *by, "n", ten(F.col("w") / F.greatest(F.lit(1), F.col("n")) + F.least(F.lit(2.0), F.col("top") * 0.25)).alias("mean_bonus"), F.when(F.col("k") == 0, 0.0).otherwise(ten(F.col("w") / F.col("k"))).alias("mean"),
        F.when(F.col("k") == 0, 0.0).otherwise(ten(F.col("w") / 2.0)).alias("saturating"), ten(F.col("lw") / F.greatest(F.lit(1), F.col("k"))).alias("legacy"),
    )


def severity_counts(findings: DataFrame, by: Sequence[str] = ("target",), severity: str = "severity") -> DataFrame:
    """(by, one column for each severity), 0 where there is none."""
    return findings.groupBy(*by).agg(*[F.count_if(F.upper(severity) == s).alias(s.lower()) for s in WEIGHTS])
