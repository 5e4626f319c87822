"""Addresses and flow identifiers."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.params import EPHEMERAL_MIN, INTERNAL_NETWORKS, TCP, UDP


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; null for anything else."""

    def number(parts: Column) -> Column:
        n = F.aggregate(F.transform(parts, lambda x: x.try_cast("int")), F.lit(0).cast("long"), lambda a, x: F.when(x.between(0, 255), a * 256 + x))
        return F.when(F.size(parts) == 4, n)

    return let(F.split(ip, r"\."), number)


def in_networks(ip: Column, networks: tuple[str, ...] = INTERNAL_NETWORKS) -> Column:
    """Whether an address lies in one of the networks; false for what can't be read. IPv6 needs packed_v6()."""
    four = [n for n in (ipaddress.ip_network(t, strict=False) for t in networks) if n.version == 4]

    def held(number: Column) -> Column:
        hit = F.lit(False)
        for n in four:
            lo = int(n.network_address)
            hit = hit | number.between(lo, lo + n.num_addresses - 1)
        return hit

    hit = F.coalesce(let(ipv4_number(ip), held), F.lit(False))
    v6 = [n for n in networks if ":" in n]
    if v6:
        hit = hit | F.when(ip.contains(":"), in_v6(v6)(ip)).otherwise(False)
    return F.coalesce(hit, F.lit(False))


def in_v6(networks: list[str]):
    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        nets = [ipaddress.ip_network(n, strict=False) for n in networks]

        def held(x: str | None) -> bool:
            try:
                ip = ipaddress.ip_address(x or "")
            except ValueError:
                return False
            return any(ip.version == n.version and ip in n for n in nets)

        for ips in batches:
            yield pa.array([held(x) for x in ips.to_pylist()], pa.bool_())

    return run


def packed_v6():
    """Hex of a packed IPv6 address; null for anything else."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def hexed(x: str | None) -> str | None:
            try:
                return ipaddress.IPv6Address(x).packed.hex() if x and ":" in x else None
            except ValueError:
                return None

        for ips in batches:
            yield pa.array([hexed(x) for x in ips.to_pylist()], pa.string())

    return run


def packed(ip: Column, v6: bool = False) -> Column:
    """Lower-case hex of the packed address."""
    four = F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0")
    return F.coalesce(four, packed_v6()(ip)) if v6 else four


def community_id(src: Column, dst: Column, sport: Column, dport: Column, proto: Column, v6: bool = False, seed: int = 0) -> Column:
    """Community ID v1: the same for both directions; ports count for TCP and UDP only."""
    a, b = packed(src, v6), packed(dst, v6)
    ports = proto.isin(TCP, UDP)
    pa_, pb = F.when(ports, sport).otherwise(0), F.when(ports, dport).otherwise(0)
    straight = (a < b) | ((a == b) & (pa_ <= pb))
    two = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 4, "0")
    ends = F.when(straight, F.concat(a, b)).otherwise(F.concat(b, a))
    tail = F.when(straight, F.concat(two(pa_), two(pb))).otherwise(F.concat(two(pb), two(pa_)))
    text = F.concat(F.lit(f"{seed:04x}"), ends, F.lpad(F.lower(F.hex(proto.cast("long"))), 2, "0"), F.lit("00"), tail)
    return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(text)))))


def probable_reply(mode: Column, sport: Column, dport: Column) -> Column:
    """In records without direction: from a service port to an ephemeral one."""
    return (mode == "flow") & (sport < EPHEMERAL_MIN) & (dport >= EPHEMERAL_MIN)


def proto_name(proto: Column) -> Column:
    return F.when(proto == TCP, "TCP").when(proto == UDP, "UDP").otherwise(proto.cast("string"))


def handshake_failed(syn: Column, synack: Column) -> Column:
    return syn & ~synack


def answered(pkts_bwd: Column, rst: Column, synack: Column) -> Column:
    return (pkts_bwd > 0) & ~(rst & ~synack)
