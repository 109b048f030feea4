"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from . import crawl_plans, finding_plans, rule_plans, url_plans, verdict_plans

QUERIES = {**finding_plans.Q, **url_plans.Q, **rule_plans.Q, **verdict_plans.Q, **crawl_plans.Q}
ORACLE_SQL = {**finding_plans.SQL, **url_plans.SQL, **rule_plans.SQL, **verdict_plans.SQL, **crawl_plans.SQL}
