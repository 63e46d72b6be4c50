"""Network facts in free text (IPs, ports, protocols, MACs) and the typed
``network_info`` struct, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

NETWORK_INFO_FIELDS = ("ip_addresses", "src_ip", "dst_ip", "ip_address", "src_port",
                       "dst_port", "protocol", "ports", "protocols", "mac_addresses")


def _all(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All matches of group 1.  ``guard`` is a cheap substring test that is
    true whenever the pattern can match; rows failing it skip the regex."""
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    if guard is None:
        return found
    return F.when(guard, found).otherwise(F.array().cast("array<string>"))


def _has(text: Column, *needles: str) -> Column:
    cond = None
    for n in needles:
        c = text.contains(n)
        cond = c if cond is None else (cond | c)
    return cond


# substring guards per pattern (on the lower-cased text), same order as
# PORT_RES / PROTOCOL_RES; a pattern can only match if its guard holds
_PORT_GUARDS = (("port",), ("src_port", "spt"), ("dst_port", "dpt"), (":",))
_PROTOCOL_GUARDS = (("proto",), ("tcp", "udp", "icmp", "http", "ftp", "ssh", "smtp", "dns",
                                 "dhcp", "snmp"))


def _none_if_empty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def _count_of(text: Column, ch: str) -> Column:
    """Occurrences of one character (byte-level replace, no regex)."""
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def _ips(text: Column) -> Column:
    # an IPv4 token holds three dots
    return _all(text, K.IP_RE, _count_of(text, ".") >= 3)


def _mac_guard(text: Column) -> Column:
    # a MAC address holds five ':' or '-' separators
    return (_count_of(text, ":") + _count_of(text, "-")) >= 5


def ip_addresses(text: Column) -> Column:
    """every IPv4-shaped token in order, duplicates kept; NULL when none."""
    return _none_if_empty(_ips(text))


def ports(text: Column) -> Column:
    """four patterns in pattern order, first occurrence of each text kept,
    only values 1..65535 (the text itself is kept, so '080' != '80')."""
    low = F.lower(text)
    found = F.concat(*[_all(text, p, _has(low, *g)) for p, g in zip(K.PORT_RES, _PORT_GUARDS)])
    in_range = F.filter(
        found, lambda p: F.coalesce(p.try_cast("bigint").between(1, 65535), F.lit(False)))
    return _none_if_empty(F.array_distinct(in_range))


def protocols(text: Column) -> Column:
    """keyed protocols, then the known protocol words; upper, distinct."""
    low = F.lower(text)
    found = F.concat(*[_all(text, p, _has(low, *g))
                       for p, g in zip(K.PROTOCOL_RES, _PROTOCOL_GUARDS)])
    return _none_if_empty(F.array_distinct(F.transform(found, lambda p: F.upper(p))))


def mac_addresses(text: Column) -> Column:
    """F5."""
    return _none_if_empty(_all(text, K.MAC_RE, _mac_guard(text)))


def protocol_name(proto: Column) -> Column:
    """Protocol number -> name; other digit strings and words unchanged."""
    pairs = []
    for k, v in K.PROTOCOL_NAMES.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), proto), proto)


def raw_arrays(text: Column) -> dict[str, Column]:
    """F1, F3, F4, F5 as plain (possibly empty) arrays, one regex pass each."""
    low = F.lower(text)
    ports_found = F.concat(*[_all(text, p, _has(low, *g)) for p, g in zip(K.PORT_RES, _PORT_GUARDS)])
    ports_ok = F.filter(
        ports_found, lambda p: F.coalesce(p.try_cast("bigint").between(1, 65535), F.lit(False)))
    protos_found = F.concat(*[_all(text, p, _has(low, *g))
                              for p, g in zip(K.PROTOCOL_RES, _PROTOCOL_GUARDS)])
    return {
        "ips": _ips(text),
        "ports": F.array_distinct(ports_ok),
        "protocols": F.array_distinct(F.transform(protos_found, lambda p: F.upper(p))),
        "macs": _all(text, K.MAC_RE, _mac_guard(text)),
    }


def network_struct(ips: Column, ports_: Column, protocols_: Column, macs: Column,
                   field_src_ip: Column, field_dst_ip: Column, field_ip_address: Column,
                   field_src_port: Column, field_dst_port: Column,
                   field_protocol: Column) -> Column:
    """The ``network_info`` struct from the found arrays (column
    references) and the fields taken from the parsed format; facts found in
    the message override the field values."""
    n = F.size(ips)
    members = {
        "ip_addresses": _none_if_empty(ips),
        "src_ip": F.when(n >= 2, F.get(ips, 0)).otherwise(field_src_ip),
        "dst_ip": F.when(n >= 2, F.get(ips, 1)).otherwise(field_dst_ip),
        "ip_address": F.when(n == 1, F.get(ips, 0)).otherwise(field_ip_address),
        "src_port": field_src_port,
        "dst_port": field_dst_port,
        "protocol": protocol_name(field_protocol),
        "ports": _none_if_empty(ports_),
        "protocols": _none_if_empty(protocols_),
        "mac_addresses": _none_if_empty(macs),
    }
    return F.struct(*[members[k].alias(k) for k in NETWORK_INFO_FIELDS])


def network_info(text: Column, field_src_ip: Column, field_dst_ip: Column,
                 field_ip_address: Column, field_src_port: Column,
                 field_dst_port: Column, field_protocol: Column) -> Column:
    """P14/P19 + F1-F5 in one expression (see ``raw_arrays`` and
    ``network_struct`` for the two-step form the parser uses)."""
    a = raw_arrays(text)
    return network_struct(a["ips"], a["ports"], a["protocols"], a["macs"], field_src_ip,
                          field_dst_ip, field_ip_address, field_src_port, field_dst_port,
                          field_protocol)


def null_if_empty_struct(col: str = "network_info") -> Column:
    """Turn an all-NULL ``network_info`` struct into NULL."""
    any_set = None
    for k in NETWORK_INFO_FIELDS:
        c = F.col(f"{col}.{k}").isNotNull()
        any_set = c if any_set is None else (any_set | c)
    return F.when(any_set, F.col(col))
