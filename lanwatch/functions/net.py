"""Address, port and MAC functions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from . import tables


def _bind(c: Column, body) -> Column:
    """Evaluate `c` once and hand its value to `body`, however often `body` uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V4_TAIL = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def lookup(c: Column, mapping: dict, default=None) -> Column:
    """Value of a small fixed mapping, `default` when the key is absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), c)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(_V4), F.lit(False))


def _octets(c: Column, times: list[int]) -> Column:
    """Sum of the dotted numbers, each multiplied; null where one is not a number."""
    parts = F.split(c, r"\.")
    out = F.lit(0).cast("bigint")
    for i, m in enumerate(times):
        if m:
            out = out + F.get(parts, F.lit(i)).try_cast("bigint") * m
    return out


def _v6_text(c: Column) -> Column:
    """Lower-case text without zone; an embedded IPv4 tail becomes two groups."""
    bare = F.lower(F.regexp_replace(c, "%[^%]+$", ""))
    tail = F.substring_index(bare, ":", -1)
    groups = F.concat_ws(":", F.hex(_octets(tail, [256, 1, 0, 0])), F.hex(_octets(tail, [0, 0, 256, 1])))
    plain = F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.lower(groups))
    return F.when(is_ipv4(tail), plain).otherwise(bare)


def _v6_groups(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, ":"), ""))


def is_ipv6(c: Column) -> Column:
    def test(text: Column) -> Column:
        shape = text.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::)?([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$")
        full = F.when(F.instr(text, "::") > 0, _v6_groups(text) <= 7).otherwise(_v6_groups(text) == 8)
        return shape & full

    # The test is reached for text with a colon only, so IPv4 columns stay on the fast path.
    return F.when(c.contains(":"), _bind(_v6_text(c), test)).otherwise(False)


def is_valid_ip(c: Column) -> Column:
    return is_ipv4(c) | is_ipv6(c)


def ip_to_long(c: Column) -> Column:
    """IPv4 text as a 32-bit number, null for anything else."""
    return F.when(is_ipv4(c), _octets(c, [1 << 24, 1 << 16, 1 << 8, 1]))


def _v6_hex(c: Column) -> Column:
    """32 hex digits of valid IPv6 text."""
    def digits(text: Column) -> Column:
        zeros = F.repeat(F.lit("0:"), F.lit(8) - _v6_groups(text))
        filled = F.trim(F.replace(text, F.lit("::"), F.concat(F.lit(":"), zeros)), F.lit(":"))
        return F.array_join(F.transform(F.split(filled, ":"), lambda g: F.lpad(g, 4, "0")), "")

    return _bind(_v6_text(c), digits)


def ip_hex(c: Column) -> Column:
    """Address bits as hex text: 8 digits for IPv4, 32 for IPv6, null when invalid."""
    return (F.when(is_ipv4(c), F.lpad(F.lower(F.hex(ip_to_long(c))), 8, "0"))
            .when(is_ipv6(c), _v6_hex(c)))


def prefix_key(hex_ip: Column, bits: Column) -> Column:
    """Text that two addresses share exactly when they agree on their first `bits` bits."""
    whole = F.floor(bits / 4).cast("int")
    rest = (bits % 4).cast("int")
    nibble = F.conv(F.substring(hex_ip, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), F.lit(4) - rest).cast("int")
    part = F.when(rest == 0, F.lit("")).otherwise(
        F.floor(nibble / step).cast("string"))
    return F.concat_ws("/", F.length(hex_ip).cast("string"), bits.cast("string"),
                       F.substring(hex_ip, F.lit(1), whole), part)


def ip_in_subnets(c: Column, cidrs) -> Column:
    """Membership in any of a short list of CIDR blocks; invalid text is in none.

    Blocks on an octet boundary become plain text prefixes.
    """
    v4, v6 = F.lit(False), F.lit(False)
    for cidr in cidrs:
        net = ipaddress.ip_network(cidr, strict=False)
        first = str(net.network_address)
        if net.version == 6:
            mine = prefix_key(F.lit(f"{int(net.network_address):032x}"), F.lit(net.prefixlen))
            v6 = v6 | (prefix_key(_v6_hex(c), F.lit(net.prefixlen)) == mine)
        elif net.prefixlen == 32:
            v4 = v4 | (c == first)
        elif net.prefixlen in (8, 16, 24):
            v4 = v4 | c.startswith(".".join(first.split(".")[:net.prefixlen // 8]) + ".")
        else:
            v4 = v4 | ip_to_long(c).between(int(net.network_address), int(net.broadcast_address))
    hit = v4 & is_ipv4(c)
    if any(":" in cidr for cidr in cidrs):
        hit = F.when(is_ipv6(c), v6).otherwise(hit)
    return F.coalesce(hit, F.lit(False))


# IPv4 texts that are private (10/8, 172.16/12, 192.168/16, 127/8, 169.254/16, 224/4,
# broadcast), and hex prefixes of private IPv6 blocks with their public exceptions.
PRIVATE_V4 = (r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\."
              r"|2(2[4-9]|3[0-9])\.|255\.255\.255\.255$)")
PRIVATE_V6 = (r"^(0{31}[01]|0{20}ffff|0064ff9b0001|0100000000000000|200100|200101|20010db8"
              r"|2002|3fff0|f[cd]|fe[89ab])")
PUBLIC_V6 = (r"^(2001000100{23}[12]|20010003|200100040112|2001002|2001003)")


def is_private_ip(c: Column) -> Column:
    """Private, loopback, link-local or (IPv4) multicast; invalid text is not private."""
    v6 = _bind(_v6_hex(c), lambda h: h.rlike(PRIVATE_V6) & ~h.rlike(PUBLIC_V6))
    return F.coalesce(F.when(c.contains(":"), is_ipv6(c) & v6).otherwise(
        c.rlike(PRIVATE_V4) & is_ipv4(c)), F.lit(False))


def normalize_mac(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9a-fA-F]", "")
    pairs = F.regexp_replace(digits, "(..)(?=.)", "$1:")
    return F.lower(F.when(F.length(digits) == 12, pairs).otherwise(c))


def mac_vendor(c: Column) -> Column:
    return lookup(F.substring(normalize_mac(c), 1, 8), tables.OUI_VENDOR, "")


def byte_bucket(c: Column) -> Column:
    out = None
    for upper, label in tables.BYTE_BUCKETS:
        out = F.when(c < upper, label) if out is None else out.when(c < upper, label)
    return F.when(c.isNotNull(), out.otherwise(tables.BYTE_BUCKET_TOP))


def port_service(c: Column) -> Column:
    return lookup(c.cast("int"), tables.PORT_SERVICES, "")


def admin_protocol(c: Column) -> Column:
    return lookup(c.cast("int"), tables.ADMIN_PORTS)


def resolver_provider(c: Column) -> Column:
    return lookup(c, tables.DNS_RESOLVERS)
