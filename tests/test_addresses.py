"""Addresses of both families against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import addresses
from skeinlake.operators import lookups

AWKWARD = (
    "::", "::1", "1::", "1::8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", ":::", "1:::2", "1::2::3", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "12345::", "g::",
    "::ffff:1.2.3.4", "::FFFF:10.0.0.1", "::ffff:0a00:0001", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::1.2.3.256", "1.2.3.4::", "::1.2.3.4:5", "fe80::1%eth0", "fe80::1%", "%eth0", "fe80::1%a%b",
    "1.2.3.4", "01.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "1.2.3.4%a", "", " ", "::1 ", "::1\n", "1.2.3.4\n", "\n::1", "2001:DB8::A", "0:0:0:0:0:0:0:0", "2001:1::1", "2001:1::2", "2001:1::3", "2001:4:112::9", "fec0::1", "2002::1",
)


def parsed(text):
    try:
        return ipaddress.ip_address(text)
    except (ValueError, TypeError):
        return None


def unwrapped(a):
    return a.ipv4_mapped or a if a is not None and a.version == 6 else a


def digits(a):
    return None if a is None else f"{int(a):0{a.max_prefixlen // 4}x}"


def made(n, seed):
    draw, out = random.Random(seed), []
    for _ in range(n):
        v4 = ipaddress.IPv4Address((draw.choice([0x0A000000, 0x68100000, 0xC0000200, 0xE0000000, 0x08080808]) ^ draw.getrandbits(draw.choice([4, 12, 22, 32]))) & 0xFFFFFFFF)
        high = draw.choice([0x2001 << 112, 0x20010DB8 << 96, 0xFE80 << 112, 0x26004700 << 96, 0xFFFF << 32, 0x2A00 << 112, 0xFEC0 << 112, draw.getrandbits(128)])
        v6 = ipaddress.IPv6Address(high ^ draw.getrandbits(draw.choice([2, 30, 64, 110])))
        out.append(draw.choice([str(v4), f"::ffff:{v4}", str(v6), v6.exploded, v6.exploded.upper(), v6.compressed]))
    return out


@pytest.mark.parametrize("unwrap", [False, True])
def test_keys(spark, unwrap):
    texts = [None, *AWKWARD, *made(600, 1)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string").select("i", addresses.key(F.col("a"), unwrap).alias("k"))
    got = {r.i: r.k for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == [digits(unwrapped(parsed(t)) if unwrap else parsed(t)) for t in texts]


def test_blocked(spark):
    texts = sorted({*AWKWARD, *made(900, 2)})
    got = {r.a: r.b for r in spark.createDataFrame([(t,) for t in texts], "a string").select("a", addresses.is_blocked(F.col("a")).alias("b")).collect()}
    own = [ipaddress.ip_network(n) for n in (*addresses.BLOCKED_NETS, "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32")]
    for t in texts:
        a = unwrapped(parsed(t))
        said = None if a is None else not a.is_global or a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or any(a in n for n in own)
        assert got[t] == said, t


def test_longest_network(spark):
    """Against all networks in turn, with broken, repeated and nested ones, repeated and null addresses, and one network that holds most of them."""
    draw = random.Random(3)
    nets = ["::/0", "10.0.0.0/8", "10.0.0.0/33", "10.0.0.1/8", "10.0.0.0", "x/8", "/8", "2001:db8::/32", "2001:DB8:0::/32", "2001:db8::1/32", "::ffff:10.0.0.0/104", "::1/129", "10.0.0.0/", "fe80::%a/64", None]
    for t in made(150, 4):
        a = ipaddress.ip_address(t)
        nets.append(str(ipaddress.ip_network((int(a) if a.version == 4 else a.packed, draw.randrange(a.max_prefixlen + 1)), strict=False)))
    texts = [None, None, *AWKWARD, *made(500, 5), *["10.9.9.9"] * 300]
    valid = []
    for n in {n for n in nets if n and "/" in n}:
        try:
            valid.append((ipaddress.ip_network(n), n))
        except ValueError:
            continue
    valid = [(w, n) for w, n in valid if "%" not in n]

    def best(t, unwrap):
        a = unwrapped(parsed(t)) if unwrap else parsed(t)
        held = [(-w.prefixlen, n) for w, n in valid if a is not None and w.version == a.version and a in w]
        return min(held)[1] if held else None

    hosts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, ip string, size string")
    listed = spark.createDataFrame([(n,) for n in nets], "net string")
    for unwrap in (False, True):
        got = {r.i: r.net for r in lookups.with_longest_network(hosts, listed, unwrap=unwrap).collect()}
        assert [got[i] for i in range(len(texts))] == [best(t, unwrap) for t in texts]
    assert lookups.with_longest_network(hosts.limit(0), listed).count() == 0
    assert {r.net for r in lookups.with_longest_network(hosts, listed.limit(0)).collect()} == {None}
