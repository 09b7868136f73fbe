"""Expressions over addresses, ports, protocols and time."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: protocol classes by port; the destination port is tried first
PORT_CLASSES = (
    ((80, 8080, 8000, 8008), "HTTP"), ((53,), "DNS"), ((5353, 5355), "mDNS"), ((1900,), "SSDP"), ((67, 68, 546, 547), "DHCP"), ((123,), "NTP"),
    ((22,), "SSH"), ((3389,), "RDP"), ((445, 139, 137, 138), "SMB/NetBIOS"), ((88, 464), "Kerberos"), ((389, 636, 3268, 3269), "LDAP"),
    ((25, 465, 587, 110, 143, 993, 995), "SMTP/IMAP/POP"), ((21, 23), "FTP/Telnet"), ((1883, 8883), "MQTT"), ((502,), "Modbus"), ((20000,), "DNP3"),
    ((44818, 2222), "EtherNet/IP"), ((102,), "S7comm"), ((4840,), "OPC UA"), ((47808,), "BACnet"), ((161, 162, 514), "SNMP/Syslog"),
    ((5432, 3306, 1433, 6379, 27017, 9200, 1521), "Database"), ((500, 4500, 1194, 51820), "VPN/IPsec"), ((5985, 5986, 135, 5900, 5901), "Remote-mgmt"),
)


def ip_long(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    number = sum(F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(4))
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits; null for anything else."""
    low = F.lower(ip)
    sides = F.split(low, "::")
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    left, right = groups(sides[0]), F.when(F.size(sides) > 1, groups(F.try_element_at(sides, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    gap = 8 - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.when(F.size(sides) > 1, F.greatest(gap, F.lit(0))).otherwise(0)), right)
    fine = low.contains(":") & low.rlike("^[0-9a-f:]+$") & (F.size(full) == 8) & (F.size(sides) <= 2)
    return F.when(fine, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def in_cidr(ip: Column, cidrs) -> Column:
    """Whether an address is in one of the networks; false for what is no address."""
    out = F.lit(False)
    for text in cidrs:
        net = ipaddress.ip_network(str(text), strict=False)
        if net.version == 4:
            low = int(net.network_address)
            out = out | ip_long(ip).between(low, low + net.num_addresses - 1)
        else:
            low, high = (f"{int(a):032x}" for a in (net.network_address, net[-1]))
            out = out | ipv6_hex(ip).between(low, high)
    return F.coalesce(out, F.lit(False))


def is_private(ip: Column) -> Column:
    """Private, link-local or loopback."""
    return in_cidr(ip, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "127.0.0.0/8", "fc00::/7", "fe80::/10", "::1/128"))


def is_multicast(ip: Column, site_broadcast=()) -> Column:
    """Multicast, broadcast, or the directed broadcast address of a private network or of the site."""
    first = F.split(ip, r"\.")[0].try_cast("int")
    directed = ip.endswith(".255") & (in_cidr(ip, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")))
    out = (ip_long(ip).isNotNull() & first.between(224, 239)) | (ip == "255.255.255.255") | directed | F.lower(ip).rlike("^ff[0-9a-f]{0,2}:")
    if site_broadcast:
        out = out | ip.isin(*site_broadcast)
    return F.coalesce(out, F.lit(False))


def classify_protocol(proto: Column, sport: Column, dport: Column) -> Column:
    """The protocol class of a packet or flow from its ports."""
    tcp = F.upper(proto) == "TCP"

    def known(port: Column) -> Column:
        out = F.when(port.isin(443, 8443), F.when(tcp, "HTTPS/TLS").otherwise("QUIC"))
        for ports, name in PORT_CLASSES:
            out = out.when(port.isin(*ports), name)
        return out

    by_port = F.coalesce(known(dport), known(sport), F.when(tcp, "other-TCP").otherwise("other-UDP"))
    kind = F.upper(proto)
    return F.when(kind.isin("ICMP", "ICMPV6"), "ICMP").when(kind == "ARP", "ARP").when(kind.isin("TCP", "UDP"), by_port).when(kind == "IPV6", "IPv6-other").otherwise("other-IP")


def coerce_proto(proto: Column) -> Column:
    up = F.upper(proto)
    return F.when(up.isin("TCP", "UDP", "ICMP"), up).otherwise("TCP")


def sender_is_originator(proto: Column, sport: Column, dport: Column, flags: Column) -> Column:
    """A SYN comes from the originator, a SYN-ACK from the responder; else the less server-like port originates."""
    rank = lambda p: F.when(p < 1024, 0).when(p < 32768, 1).otherwise(2)
    syn, ack = flags.bitwiseAND(2) != 0, flags.bitwiseAND(16) != 0
    by_port = rank(sport) >= rank(dport)
    handshake = (F.lower(proto) == "tcp") & flags.isNotNull() & syn
    return F.when(handshake, ~ack).otherwise(by_port)


def bucket(ts: Column, width: float) -> Column:
    return F.floor(ts / F.lit(float(width))).cast("bigint")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def iso_time(ts: Column) -> Column:
    """Epoch seconds as ISO 8601 in UTC; microseconds only where there are any."""
    at = F.timestamp_micros(F.round(ts * 1_000_000).cast("bigint"))
    whole = F.pmod(F.round(ts * 1_000_000).cast("bigint"), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def jitter_pct(cv: Column) -> Column:
    """The uniform jitter, in per cent of the period, that a coefficient of variation implies."""
    return F.round(cv * 3**0.5 * 100, 1)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson interval ``struct(low, high)`` of k successes in n; null for n = 0."""
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (mid - half) / (1 + zz / n)).alias("low"), F.least(F.lit(1.0), (mid + half) / (1 + zz / n)).alias("high")))


def flow_uid(a: Column, b: Column, proto: Column) -> Column:
    """First 16 hex digits of SHA-256 over ``a-b-proto``; a and b are ``address:port``."""
    return F.substring(F.sha2(F.concat_ws("-", a, b, proto), 256), 1, 16)


def parts_hash(*parts: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *parts), 256)


def segment_hash(*columns: Column) -> Column:
    """A content hash of the columns as JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*columns)), 256))


def service_key(proto: Column, port: Column) -> Column:
    return F.concat_ws("/", F.lower(proto), port.cast("string"))


RUN = "run_id"


def by_run(df, *keys) -> list:
    """Keys of a window, fold or state: where rows have a ``run_id``, each run is a world of its own."""
    return [RUN, *keys] if RUN in df.columns and RUN not in keys else list(keys)
