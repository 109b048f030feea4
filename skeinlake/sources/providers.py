"""Payloads of outside providers, as captured: status words and compact projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
STATUS = {401: "authentication_failed", 402: "plan_limit", 403: "permission_denied", 404: "asset_not_found", 400: "invalid_request", 422: "invalid_request", 408: "provider_timeout", 429: "rate_limited", 204: "no_content"}


def status(http_status: Column, body: Column) -> Column:
    """What a provider's answer means."""
    out = F.when(http_status.between(300, 399), "redirect_blocked")
    for code, word in STATUS.items():
        out = out.when(http_status == code, word)
    parsed = F.try_parse_json(body)
    return out.when(http_status.between(500, 599), "provider_unavailable").when(http_status != 200, "http_error").when(parsed.isNull(), "invalid_json").when(~F.ltrim(body).startswith("{"), "invalid_response").otherwise("ok")


def _ports(services: Column) -> Column:
    numbers = F.transform(F.filter(services, lambda s: s["port"].rlike("^[0-9]+$")), lambda s: s["port"].cast("int"))
    return F.slice(F.array_sort(F.array_distinct(F.coalesce(numbers, F.array().cast("array<int>")))), 1, 100)


def host_services(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with struct summary(ip, service_count, ports, asn, organization, dns_names) of a host document."""
    inner = "struct<ip:string,service_count:int,services:array<struct<port:string>>,autonomous_system:struct<asn:long,name:string>,dns:struct<names:array<string>>>"
    both = F.from_json(body, f"struct<result:struct<resource:{inner}>>")["result"]["resource"]
    r = F.coalesce(both, F.from_json(body, inner))
    return rows.withColumn("summary", F.struct(
        F.coalesce(r["ip"], F.lit("")).alias("ip"), F.coalesce(r["service_count"], F.greatest(F.size(r["services"]), F.lit(0))).alias("service_count"), _ports(r["services"]).alias("ports"), r["autonomous_system"]["asn"].alias("asn"),
        F.substring(F.coalesce(r["autonomous_system"]["name"], F.lit("")), 1, 200).alias("organization"), F.transform(F.slice(F.coalesce(r["dns"]["names"], F.array().cast("array<string>")), 1, 50), lambda n: F.substring(n, 1, 253)).alias("dns_names"),
    ))


def host_software(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with struct summary(type, ip, organization, asn, ports, domains, software)."""
    r = F.from_json(body, "struct<type:string,ip:string,organization:string,asn:struct<number:string>,ports:array<struct<port:string>>,domains:array<string>,software:array<struct<name:string,tag:array<struct<name:string,fullname:string>>>>>")
    software = F.coalesce(r["software"], F.array().cast("array<struct<name:string,tag:array<struct<name:string,fullname:string>>>>"))
    names = F.flatten(F.transform(software, lambda s: F.concat(F.array(s["name"]), F.coalesce(F.flatten(F.transform(s["tag"], lambda t: F.array(t["name"], t["fullname"]))), F.array().cast("array<string>")))))
    clean = F.array_sort(F.array_distinct(F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.substring(F.trim(n), 1, 120))))
    clip = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return rows.withColumn("summary", F.struct(
        clip(r["type"], 32).alias("type"), clip(r["ip"], 64).alias("ip"), clip(r["organization"], 200).alias("organization"), r["asn"]["number"].alias("asn"), _ports(r["ports"]).alias("ports"),
        F.transform(F.slice(F.coalesce(r["domains"], F.array().cast("array<string>")), 1, 50), lambda n: F.substring(n, 1, 253)).alias("domains"), F.slice(clean, 1, 50).alias("software"),
    ))


def leaks(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with struct summary(services_count, leaks_count, services, leaks), 25 of each at most."""
    item = "struct<host:string,ip:string,port:string,protocol:string,event_type:string,leak:struct<type:string,severity:string>>"
    read = lambda name: F.from_json(body, f"struct<{name}:array<{item}>>")[name]
    some = lambda a, b: F.coalesce(read(a), read(b), F.array().cast(f"array<{item}>"))
    clip = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    compact = lambda c: F.transform(F.slice(c, 1, 25), lambda x: F.struct(clip(x["host"], 253).alias("host"), clip(x["ip"], 64).alias("ip"), x["port"].alias("port"), clip(x["protocol"], 32).alias("protocol"), clip(x["event_type"], 120).alias("event_type"), clip(x["leak"]["type"], 120).alias("leak_type"), clip(x["leak"]["severity"], 32).alias("severity")))
    services, found = some("services", "Services"), some("leaks", "Leaks")
    return rows.withColumn("summary", F.struct(F.size(services).alias("services_count"), F.size(found).alias("leaks_count"), compact(services).alias("services"), compact(found).alias("leaks")))


def certificate_names(rows: DataFrame, domain: str, body: str = "body") -> DataFrame:
    """(name), sorted: names on domain in certificate-transparency documents."""
    entries = rows.select(F.explode(F.from_json(body, "array<struct<name_value:string>>")).alias("e"))
    names = entries.select(F.explode(F.split("e.name_value", "\r?\n")).alias("raw")).select(F.regexp_replace(F.trim("raw"), r"^[*.]+", "").alias("name"))
    return names.where((F.col("name") == domain) | F.col("name").endswith("." + domain)).select(F.lower("name").alias("name")).distinct().orderBy("name")


def mail_findings(txt: DataFrame) -> DataFrame:
    """(domain, issue, severity) from TXT answers (domain, name, txt): SPF, DMARC and DKIM."""
    own = F.col("name") == F.col("domain")
    dmarc = F.col("name") == F.concat(F.lit("_dmarc."), "domain")
    said = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = txt.groupBy("domain").agg(
        said(own & F.contains("txt", F.lit("v=spf1"))).alias("spf"), said(own & F.contains("txt", F.lit("v=spf1")) & F.contains("txt", F.lit("~all"))).alias("soft"), said(dmarc & F.contains("txt", F.lit("v=DMARC1"))).alias("dmarc"),
        said(dmarc & F.contains("txt", F.lit("v=DMARC1")) & F.contains("txt", F.lit("p=none"))).alias("none"), said(F.contains("name", F.lit("._domainkey."))).alias("dkim"),
    )
    issue = lambda holds, what, severity: F.when(holds, F.struct(F.lit(what).alias("issue"), F.lit(severity).alias("severity")))
    every = F.array_compact(F.array(issue(~F.col("spf"), "spf missing", "MEDIUM"), issue(F.col("soft"), "spf softfail", "LOW"), issue(~F.col("dmarc"), "dmarc missing", "MEDIUM"), issue(F.col("none"), "dmarc p=none", "MEDIUM"), issue(~F.col("dkim"), "no dkim selector", "INFO")))
    return flags.select("domain", F.explode(every).alias("i")).select("domain", "i.*")


def certificate_expiry(certs: DataFrame, now: Column, not_after: str = "not_after") -> DataFrame:
    """certs with days_left and severity."""
    end = F.to_timestamp(F.regexp_replace(not_after, r"\s+", " "), "MMM d HH:mm:ss yyyy z")
    out = certs.withColumn("days_left", F.datediff(end, now))
    return out.withColumn("severity", F.when(F.col("days_left") < 0, "HIGH").when(F.col("days_left") < 30, "MEDIUM"))


def open_ports(scans: DataFrame, xml: str = "xml") -> DataFrame:
    """scans with ports (open ones as port/protocol - name), cves and os of port-scan XML."""
    at = lambda what: F.xpath(F.col(xml), F.lit(f"//port[state/@state='open']/{what}"))
    ports = F.transform(F.arrays_zip(at("@portid").alias("p"), at("@protocol").alias("t"), at("service/@name").alias("n")), lambda x: F.concat(x["p"], F.lit("/"), x["t"], F.lit(" - "), F.coalesce(x["n"], F.lit(""))))
    cves = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(xml, F.lit(r"(CVE-\d{4}-\d{4,7})"), F.lit(1)))), 1, 20)
    return scans.withColumn("ports", ports).withColumn("cves", cves).withColumn("os", F.xpath_string(F.col(xml), F.lit("//osmatch[1]/@name")))
