"""API descriptions and GraphQL responses: endpoints and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
HINTS = r"(?i)/api/|/graphql|/swagger|/openapi"


def operations(docs: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, path, method, operation_id, operation, document_security) of OpenAPI and Swagger documents; others give no rows."""
    held = docs.select(F.col(url).alias("url"), F.col(body).alias("doc")).where(F.coalesce(F.get_json_object("doc", "$.openapi"), F.get_json_object("doc", "$.swagger")).isNotNull())
    paths = held.select("url", F.get_json_object("doc", "$.security").alias("document_security"), F.explode(F.from_json(F.get_json_object("doc", "$.paths"), "map<string,string>")).alias("path", "item"))
    each = paths.select("url", "path", "document_security", F.explode(F.from_json("item", "map<string,string>")).alias("method", "operation"))
    return each.where(F.lower("method").isin(*VERBS) & F.startswith(F.trim("operation"), F.lit("{"))).select("url", "path", F.upper("method").alias("method"), F.get_json_object("operation", "$.operationId").alias("operation_id"), "operation", "document_security")


def review(docs: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, path, method, id, severity) of what operations leave open.

    security: [] switches off what the document declares, which is another thing than none declared at all.
    """
    ops = operations(docs, url, body)
    own = F.get_json_object("operation", "$.security")
    security = F.coalesce(own, F.col("document_security"))
    open_ = security.isNull() | (F.regexp_replace(security, r"\s", "") == "[]")
    names = F.from_json(F.get_json_object("operation", "$.parameters"), "array<struct<name:string>>")
    object_ids = F.exists(F.coalesce(names, F.array().cast("array<struct<name:string>>")), lambda p: F.coalesce(p["name"].rlike(r"(?i)(?:^|_)(?:id|uuid|uid)$"), F.lit(False)))
    one = lambda holds, rule, severity: F.when(holds, F.struct(F.lit(rule).alias("id"), F.lit(severity).alias("severity")))
    found = F.array_compact(
        F.array(
            one(object_ids & open_, "api-object-reference-review", "INFO"), one(F.startswith(F.col("url"), F.lit("http://")), "api-cleartext-transport", "MEDIUM"), one(F.col("method").isin("PUT", "PATCH", "DELETE") & open_, "api-state-change-auth-review", "INFO"),
            one(F.regexp_replace(own, r"\s", "") == "[]", "openapi-operation-security-empty", "MEDIUM"), one(security.isNull(), "openapi-no-security", "INFO"),
        )
    )
    return ops.select("url", "path", "method", F.explode(found).alias("f")).select("url", "path", "method", "f.*")


def graphql_review(url: Column, body: Column) -> Column:
    """Rules that a GraphQL answer breaks; none for others."""
    text = F.substring(F.coalesce(body, F.lit("")), 1, 100_000)
    about = F.contains(F.lower(url), F.lit("graphql")) | text.rlike(r"(?i)\b(query|mutation|subscription)\s+[A-Za-z_]")
    detail = text.rlike(r"(?i)errors?\s*[:\[]") & text.rlike("(?i)stack|traceback|exception")
    return F.array_compact(F.array(F.when(about & text.rlike("(?i)__schema|__type"), "graphql-introspection"), F.when(about & detail, "graphql-error-detail")))


def api_urls(body: Column) -> Column:
    """Absolute web and socket URLs and quoted API paths of a body, in order."""
    absolute = F.regexp_extract_all(body, F.lit(r"""((?:wss?|https?)://[^"'\s<>\\]+)"""), F.lit(1))
    quoted = F.filter(F.regexp_extract_all(body, F.lit(r"""["'](/[^"']{1,200})["']"""), F.lit(1)), lambda x: x.rlike(HINTS))
    return F.array_distinct(F.concat(absolute, quoted))
