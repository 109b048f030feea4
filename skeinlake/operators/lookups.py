"""Joins against small tables of ranges and rows, queues and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses, predicates, urls, verdicts


def cidr_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(net) of the lines of a list of networks: those with a slash, trimmed."""
    return lines.select(F.trim(line).alias("net")).where("net <> '' and instr(net, '/') > 0").distinct()


def network_bounds(nets: DataFrame) -> DataFrame:
    """(net, low, high, octet) of IPv4 networks (net): one row for each first octet that they reach, so that a join on it meets all of their addresses."""
    net = F.when(F.col("net").rlike(rf"^{verdicts.IPV4}/[0-9]+$"), F.col("net"))
    size = F.pow(F.lit(2), 32 - F.substring_index(net, "/", -1).cast("int")).cast("long")
    address = predicates.ipv4_number(F.substring_index(net, "/", 1))
    low = (address - address % size).alias("low")
    bounds = nets.select("net", low, size.alias("size")).where("low is not null").withColumn("high", F.col("low") + F.col("size") - 1)
    octet = lambda c: F.floor(F.col(c) / (1 << 24))
    return bounds.select("net", "low", "high", F.explode(F.sequence(octet("low"), octet("high"))).alias("octet"))


def with_networks(hosts: DataFrame, nets: DataFrame, ip: str = "ip", name: str = "nets") -> DataFrame:
    """hosts with the networks that hold their address: an equality on the first octet and a range within it, so no side meets all of the other.

    The hosts' distinct addresses are joined, not their rows, so an address that many rows have is looked up once.
    """
    bounds = network_bounds(nets)
    number = predicates.ipv4_number(F.col("_ip"))
    found = hosts.select(F.col(ip).alias("_ip")).distinct().withColumn("_n", number).withColumn("octet", F.floor(F.col("_n") / (1 << 24)))
    held = found.join(bounds, "octet").where("_n between low and high").groupBy("_ip").agg(F.array_sort(F.collect_set("net")).alias(name))
    return hosts.join(held, F.col(ip) == F.col("_ip"), "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("_ip")


def with_longest_network(hosts: DataFrame, nets: DataFrame, ip: str = "ip", name: str = "net", unwrap: bool = False, salts: int = 8) -> DataFrame:
    """hosts with the longest of the IPv4 and IPv6 networks (net) that hold their address; null where none does or it is no address.

    Longest-prefix match by equality: each distinct address goes out once for each prefix length that its family's networks have (at most 33 and 129,
    so the lengths are broadcast), and meets the networks of that length on its first bits. Networks are copied over salts, so one that holds
    a large part of all addresses is no single task. Networks with bits after their length, and what is none, are passed over; of equal ones
    in several forms the least text stands. unwrap: IPv4-mapped addresses are looked up as the IPv4 addresses in them.
    """
    own = nets.select("net", addresses.network(F.col("net")).alias("n")).where("n is not null").groupBy("n").agg(F.min("net").alias("net")).select("n.*", "net")
    lengths = own.select("size", "length").distinct()
    found = hosts.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().withColumn("_key", addresses.key(F.col("_ip"), unwrap)).where("_key is not null")
    asked = found.withColumn("size", F.length("_key")).join(F.broadcast(lengths), "size").withColumn("bits", addresses.prefix(F.col("_key"), F.col("length"))).withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)))
    copies = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    held = asked.join(copies, ["size", "length", "bits", "_salt"]).groupBy("_ip").agg(F.max_by("net", "length").alias("_net"))
    return hosts.drop(name).join(held, F.col(ip) == F.col("_ip"), "left").withColumn(name, F.col("_net")).drop("_ip", "_net")


def origin_candidates(hosts: DataFrame, nets: DataFrame, host: str = "host", ip: str = "ip", order: str = "seq") -> DataFrame:
    """(ip, host) of the addresses outside all networks of a CDN, with the first host that has them."""
    outside = with_networks(hosts, nets, ip).where(F.size("nets") == 0)
    return outside.groupBy(ip).agg(F.min_by(host, order).alias(host))


def banner_rows(banners: DataFrame, cached: DataFrame, salts: int = 32) -> DataFrame:
    """(banner, row) of banners (banner, product, version) and the first cached row (row, product, id, text) of their product that has a CVE id and names product and version in text or id, in any case.

    What banners ask, a product and a version, meets the cached rows once, however many banners ask it. A product's cached rows are dealt over salts
    and what is asked copied to them, so that a product that most rows have is no single task.
    """
    n = max(2, int(banners.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = banners.select("banner", F.lower("product").alias("p"), F.lower("version").alias("v")).where("v <> ''")
    c = cached.where(F.startswith("id", F.lit("CVE-"))).select(F.lower("product").alias("p"), "row", F.lower(F.concat_ws(" ", "text", "id")).alias("said")).where(F.contains("said", F.col("p")))
    dealt = c.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts))).repartition(n, "p", "_salt")
    asked = own.select("p", "v").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))).repartition(n, "p", "_salt")
    first = dealt.join(asked, ["p", "_salt"]).where(F.contains("said", F.col("v"))).groupBy("p", "v").agg(F.min("row").alias("row"))
    return own.join(first, ["p", "v"]).groupBy("banner").agg(F.min("row").alias("row"))


def cors_findings(answers: DataFrame) -> DataFrame:
    """(base, severity, origin) of the first answer (base, seq, origin, allowed, credentials) of each base URL that lets an origin in."""
    hit = answers.withColumn("severity", verdicts.cors_severity(F.col("origin"), F.col("allowed"), F.col("credentials"))).where("severity is not null")
    first = hit.groupBy("base").agg(F.min_by(F.struct("severity", "origin"), "seq").alias("f"))
    return first.select("base", "f.severity", "f.origin")


def legacy_queue(found: DataFrame, url: str = "url", seq: str = "seq", priority: str = "priority") -> DataFrame:
    """(place, url) in which a queue gives URLs out: each legacy key once, at its first entry; priority ones in front, the last of them first."""
    keyed = found.withColumn("key", urls.normalize_legacy(F.col(url)))
    first = keyed.groupBy("key").agg(F.min_by(F.struct(url, seq, priority), seq).alias("f")).select("f.*")
    turn = F.when(F.col(priority), -F.col(seq)).otherwise(F.col(seq))
    return first.select(url, F.when(F.col(priority), 0).otherwise(1).alias("front"), turn.alias("turn"))


def overflow(frontier: DataFrame, *order: Column) -> DataFrame:
    """The entry that a full frontier drops: the last one by its order."""
    return frontier.orderBy(*order).limit(1)


def recent_findings(findings: DataFrame, limit: int = 500) -> DataFrame:
    """The findings seen last, at most limit of them; ties by their key."""
    return findings.orderBy(F.desc("last_seen"), "key").limit(limit)


def run_totals(findings: DataFrame, technologies: DataFrame) -> DataFrame:
    """One row: the number of findings, and the distinct technologies in order."""
    techs = technologies.agg(F.array_sort(F.collect_set(F.col("name").cast("string"))).alias("technologies"))
    return findings.agg(F.count("*").alias("findings")).withColumn("one", F.lit(1)).join(techs.withColumn("one", F.lit(1)), "one").drop("one")
