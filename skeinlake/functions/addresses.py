"""IPv4 and IPv6 addresses as keys in the addresses' order, and the networks that hold them."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import BLOCKED_NETS, ipv4_number

#: IPv6 networks that aren't reached, by a guard's own list and by the public registries of special, multicast and reserved addresses.
BLOCKED_V6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5",
    "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
#: Networks within 2001::/23 that are reached.
GLOBAL_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
#: IPv4 networks that aren't reached beside those of predicates.BLOCKED_NETS.
BLOCKED_V4 = ("192.0.2.0/24", "240.0.0.0/4")

_GROUP = "[0-9a-f]{1,4}"
_WHOLE = rf"^({_GROUP}:)*{_GROUP}\z"
_SHORT = rf"^(({_GROUP}:)*{_GROUP})?::(({_GROUP}:)*{_GROUP})?\z"


def _let(value: Column, make) -> Column:
    """make() of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def _dotted(text: Column) -> Column:
    """A last group in dotted form as two groups; null if it is no IPv4 address."""
    tail = ipv4_number(F.substring_index(text, ":", -1))
    words = F.concat(_hex(F.shiftright(tail, 16), 4), F.lit(":"), _hex(tail.bitwiseAND(0xFFFF), 4))
    return F.when(F.instr(text, ".") > 0, F.concat(F.regexp_extract(text, "^(.*:)", 1), words)).otherwise(text)


def _spread(text: Column) -> Column:
    """The 32 digits of a form that may leave out a run of zero groups."""
    short = F.instr(text, "::") > 0
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    left = groups(F.substring_index(text, "::", 1))
    right = F.when(short, groups(F.substring_index(text, "::", -1))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    return F.when((short & text.rlike(_SHORT) & (missing > 0)) | (~short & text.rlike(_WHOLE) & (missing == 0)), digits)


def key(address: Column, unwrap: bool = False) -> Column:
    """Lower-case hex digits of an address, 8 for IPv4 and 32 for IPv6: within a family, strings stand in the addresses' order. Null for null and for whatever is no address.

    All text forms of RFC 4291 are read, in any case, with a run of zero groups left out and the last 32 bits dotted; a zone after % is left aside.
    IPv4 parts have no leading zeros. unwrap: IPv4-mapped addresses count as the IPv4 addresses in them.
    """
    bare = F.regexp_replace(F.lower(address), r"^([^%]+)%[^%]+\z", "$1")
    v6 = _let(_let(bare, _dotted), _spread)
    if unwrap:
        v6 = _let(v6, lambda k: F.when(F.startswith(k, F.lit("0" * 20 + "ffff")), F.substring(k, 25, 8)).otherwise(k))
    return F.when(address.rlike(r"\s"), None).when(F.instr(address, ":") > 0, v6).otherwise(_hex(ipv4_number(address), 8))


def prefix(of_key: Column, length: Column) -> Column:
    """The first bits of a key: whole digits, and of the digit that the length cuts its upper bits."""
    at = F.floor(length / 4).cast("int")
    digit, out = F.substr(of_key, at + 1, F.lit(1)), F.lit("")
    for bits in (1, 2, 3):
        upper = "".join(f"{d & (0xF << (4 - bits)) & 0xF:x}" for d in range(16))
        out = F.when(length % 4 == bits, F.translate(digit, "0123456789abcdef", upper)).otherwise(out)
    return F.concat(F.substr(of_key, F.lit(1), at), out)


def network(net: Column, strict: bool = True) -> Column:
    """struct (size: digits of its keys, length, bits) of address/length; null where it is no network, or, if strict, where bits stand after its length.

    Lengths in dotted form (as /255.0.0.0) are not read.
    """
    length = F.regexp_extract(net, r"/([0-9]{1,3})\z", 1).try_cast("int")
    own = F.struct(key(F.regexp_extract(net, r"^([^/%]+)/[0-9]{1,3}\z", 1)).alias("key"), length.alias("length"))

    def made(x):
        size, bits = F.length(x["key"]), prefix(x["key"], x["length"])
        sound = x["key"].isNotNull() & (x["length"] <= size * 4)
        if strict:
            sound = sound & (F.rpad(bits, size, "0") == x["key"])
        return F.when(sound, F.struct(size.alias("size"), x["length"].alias("length"), bits.alias("bits")))

    return _let(own, made)


def within(of_key: Column, nets: Sequence[str]) -> Column:
    """Whether a key lies in one of a few stated networks; many of them are joined by lookups.with_longest_network()."""
    out = F.lit(False)
    for net in map(ipaddress.ip_network, nets):
        digits = net.max_prefixlen // 4
        out = out | ((F.length(of_key) == digits) & of_key.between(f"{int(net[0]):0{digits}x}", f"{int(net[-1]):0{digits}x}"))
    return out


def is_blocked(address: Column) -> Column:
    """Whether an address is private, local, reserved, multicast or otherwise not reached; mapped ones are judged by the IPv4 address in them. Null for no address."""
    nets = (*BLOCKED_NETS, *BLOCKED_V4, *BLOCKED_V6)
    return _let(key(address, unwrap=True), lambda k: within(k, nets) & ~within(k, GLOBAL_V6))
