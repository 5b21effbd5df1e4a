"""IP addresses as columns: canonical form, extraction from text, networks. All in Spark's expressions.

An IPv6 address is worked on as the list of its groups: `::` and an IPv4 address at its end are written out, so there
are eight; without their leading zeros these are the address, the longest run of zeros written as `::` again.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
#: Fixed value: runs of these characters, and so many of them, may be an address.
TOKEN = r"[0-9A-Fa-f:.]{3,45}"
#: What an IPv6 address has and a time of day hasn't: two colons side by side, or at least six.
V6_LIKE = r"::|(:[^:]*){6}"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*+"
#: Groups, at most once with a `::` among or beside them.
_V6 = rf"^(?:{_GROUPS})?+(?:::(?:{_GROUPS})?+)?+$"
BLANKS = " \t\n\r\x0b\x0c"


def canonical(text: str) -> str | None:
    """The canonical form of an address, IPv4 for an IPv4-mapped one; None if it isn't one. For single values on the driver."""
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    mapped = getattr(address, "ipv4_mapped", None)
    return str(mapped or address)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being computed once. Spark runs it apart, so it doesn't lengthen the code of the rows without a colon."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _written_out(address: Column) -> Column:
    """The eight groups of IPv6 text in lower case without a zone, without leading zeros, joined by colons; null if it isn't an address."""

    def checked(a: Column) -> Column:
        left, right = F.substring_index(a, "::", 1), F.when(F.contains(a, F.lit("::")), F.substring_index(a, "::", -1))
        count = lambda part: F.when(part == "", 0).otherwise(F.size(F.split(part, ":")))
        whole = right.isNull() & (count(left) == 8)
        gap = F.lit(8) - count(left) - count(right)
        zeros = F.array_join(F.array_repeat(F.lit("0"), gap), ":")
        full = F.when(whole, a).when(right.isNotNull() & (gap >= 1), F.concat_ws(":", F.nullif(left, F.lit("")), zeros, F.nullif(right, F.lit(""))))
        return F.when(a.rlike(_V6), F.regexp_replace(full, r"(^|:)0+(?=[0-9a-f])", "$1"))

    def groups(a: Column) -> Column:
        tail = F.substring_index(a, ":", -1)
        return F.when(~F.contains(a, F.lit(".")), a).when(tail.rlike(IPV4), F.concat(F.substring(a, F.lit(1), F.char_length(a) - F.char_length(tail)), _hex_groups(tail)))

    return _let(groups(address), checked)


def _hex_groups(ipv4: Column) -> Column:
    return _let(ipv4_number(ipv4), lambda n: F.lower(F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n % 65536))))


def _shortened(groups: Column) -> Column:
    """Eight groups with their longest run of two zeros or more, the first of several, as `::`."""

    def cut(g: Column) -> Column:
        p, run = F.concat(F.lit(":"), g, F.lit(":")), None
        for k in range(2, 9):
            zeros = ":0" * k + ":"
            run = F.when(F.contains(p, F.lit(zeros)), zeros) if run is None else F.when(F.contains(p, F.lit(zeros)), zeros).otherwise(run)

        def shown(z: Column) -> Column:
            head = F.left(p, F.instr(p, z) - 1)  # before the first run as long as that
            rest = F.substring(p, F.char_length(head) + F.char_length(z) + 1, F.char_length(p))
            return F.coalesce(F.concat(F.substring(head, 2, 64), F.lit("::"), F.substring(rest, F.lit(1), F.char_length(rest) - 1)), g)

        return _let(run, shown)

    return _let(groups, cut)


def _mapped(groups: Column) -> Column:
    """The IPv4 address of an IPv4-mapped one's groups, else null."""
    value = lambda g: F.conv(g, 16, 10).cast("bigint")

    def dotted(low: Column) -> Column:
        parts = [F.shiftright(low[0], 8), low[0] % 256, F.shiftright(low[1], 8), low[1] % 256]
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    own = F.split(groups, ":")
    return F.when(F.startswith(groups, F.lit("0:0:0:0:0:ffff:")), _let(F.array(value(F.get(own, F.lit(6))), value(F.get(own, F.lit(7)))), dotted))


def _canonical_v6(text: Column) -> Column:
    """The canonical form of text that has a colon, null if it isn't an address. What follows a % names a zone and stays."""
    zoned = F.contains(text, F.lit("%"))
    zone = F.when(zoned, F.substring(text, F.instr(text, "%"), F.char_length(text))).otherwise("")
    good_zone = ~zoned | zone.rlike(r"^%[^%]+$")
    shown = _let(_written_out(F.lower(F.substring_index(text, "%", 1))), lambda g: F.coalesce(_mapped(g), F.concat(_shortened(g), zone)))
    return F.when(good_zone, shown)


def _address(text: Column) -> Column:
    return F.when(text.rlike(IPV4), text).when(F.contains(text, F.lit(":")), _let(text, _canonical_v6))


def normalize_ip(text: Column, brackets: bool = True) -> Column:
    """The canonical address of a text, null if it isn't one. Blanks around it, and brackets if allowed, don't count."""
    t = F.btrim(text, F.lit(BLANKS))
    return _address(F.btrim(t, F.lit("[]")) if brackets else t)


def find_ips(text: Column) -> Column:
    """The canonical addresses in a line, in order."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(t, F.lit(".:")))
    own = F.transform(tokens, lambda t: F.when(t.rlike(IPV4), t).when(t.rlike(V6_LIKE), _canonical_v6(t)))
    return F.filter(own, lambda t: t.isNotNull())


def ipv4_number(ip: Column) -> Column:
    """The 32-bit number of a canonical IPv4 address, null for others."""
    part = lambda k: F.split_part(ip, F.lit("."), F.lit(k)).try_cast("bigint")
    return F.when(ip.rlike(IPV4), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def address_digits(ip: Column) -> Column:
    """A canonical address as hexadecimal digits, 8 of IPv4 and 32 of IPv6 (without its zone), so that addresses of one version sort like their numbers."""
    v6 = _let(_written_out(F.substring_index(ip, "%", 1)), lambda g: F.array_join(F.transform(F.split(g, ":"), lambda x: F.lpad(x, 4, "0")), ""))
    return F.when(F.contains(ip, F.lit(":")), v6).otherwise(F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0")))


def any_in_networks(ips: Column, networks: list[ipaddress.IPv4Network | ipaddress.IPv6Network]) -> Column:
    """Whether any canonical address of an array lies in any network; versions never mix. For many networks, see operators/networks.py."""

    def inside(width: int, ends: list[tuple[str, str]]) -> Column:
        mine = F.filter(F.transform(ips, address_digits), lambda d: F.char_length(d) == width)
        return F.exists(mine, lambda d: F.coalesce(_any([d.between(a, b) for a, b in ends]), F.lit(False)))

    hit = F.lit(False)
    for version, width in ((4, 8), (6, 32)):
        ends = [(f"{int(n.network_address):0{width}x}", f"{int(n.broadcast_address):0{width}x}") for n in networks if n.version == version]
        if ends:
            hit |= inside(width, ends)
    return hit


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out |= c
    return out


# --- networks in a table


def address_bits(digits: Column) -> Column:
    """Hexadecimal digits as binary ones."""
    return F.array_join(F.transform(F.split(digits, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def network_prefix(network: Column) -> Column:
    """The leading bits of a network such as 192.0.2.0/24 or 2001:db8::/32 behind its version (`4:11000000...`), host bits cut; null if it isn't one.

    An address without a length is a network of its own.
    """

    def prefix(ip: Column, length: Column) -> Column:
        digits = address_digits(ip)
        version, most = F.when(F.contains(ip, F.lit(":")), F.lit("6:")).otherwise("4:"), F.when(F.contains(ip, F.lit(":")), 128).otherwise(32)
        n = F.coalesce(length.try_cast("int"), F.when(length == "", most))
        return F.when((n >= 0) & (n <= most), F.concat(version, F.left(address_bits(digits), n)))

    ip, length = F.btrim(F.substring_index(network, "/", 1), F.lit(BLANKS)), F.when(F.contains(network, F.lit("/")), F.btrim(F.substring_index(network, "/", -1), F.lit(BLANKS))).otherwise("")
    shape = F.when(F.contains(network, F.lit("/")), length.rlike(r"^\d{1,3}$") & (F.size(F.split(network, "/")) == 2)).otherwise(F.lit(True))
    plain = F.when(ip.rlike(IPV4), ip).when(F.contains(ip, F.lit(":")) & ~F.contains(ip, F.lit("%")), _let(_written_out(F.lower(ip)), _shortened))
    return F.when(shape, _let(plain, lambda x: prefix(x, length)))
