"""Decoders of bytes: pcap and pcapng, DNS messages, TLS client hellos, NetFlow v5."""

from __future__ import annotations

import ipaddress
import socket
import struct
from collections.abc import Iterator

TCP, UDP = 6, 17
SYN, ACK, RST = 0x02, 0x10, 0x04
ETHERNET, COOKED = 1, 113
RAW_IP = (12, 14, 101)


class ParseError(ValueError):
    """The bytes aren't what they should be."""


# ---- captures


def frames(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    """(time, link type, bytes) of each packet of a pcap or pcapng file."""
    return _pcapng(data) if data[:4] == b"\x0a\x0d\x0d\x0a" else _pcap(data)


def _pcap(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    magic = data[:4]
    order = {b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9), b"\x4d\x3c\xb2\xa1": ("<", 1e9)}.get(magic)
    if order is None or len(data) < 24:
        raise ParseError("not a capture")
    end, unit = order
    (link,) = struct.unpack_from(f"{end}I", data, 20)
    at = 24
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack_from(f"{end}IIII", data, at)
        at += 16
        if at + size > len(data):
            return
        yield sec + frac / unit, link & 0xFFFF, data[at : at + size]
        at += size


def _pcapng(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    at, end, links = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            end = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
        kind, size = struct.unpack_from(f"{end}II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            links.append((struct.unpack_from(f"{end}H", body)[0], _resolution(body[8:], end)))
        elif kind == 6 and len(body) >= 20:
            which, high, low, kept, _ = struct.unpack_from(f"{end}IIIII", body)
            if which < len(links):
                link, unit = links[which]
                yield ((high << 32) | low) / unit, link, body[20 : 20 + kept]
        at += size


def _resolution(options: bytes, end: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(f"{end}HH", options, at)
        if code == 9 and size:
            r = options[at + 4]
            return float(2 ** (r & 0x7F)) if r & 0x80 else 10.0**r
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1e6


def network_layer(frame: bytes, link: int) -> bytes | None:
    """The IP packet inside a frame; None for other payloads."""
    if link in RAW_IP:
        return frame
    if link == ETHERNET:
        at, kind = 14, frame[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = frame[at + 2 : at + 4], at + 4
    elif link == COOKED:
        at, kind = 16, frame[14:16]
    else:
        raise ParseError(f"link type {link} isn't read")
    return frame[at:] if kind in (b"\x08\x00", b"\x86\xdd") else None


def packet(ts: float, frame: bytes, link: int) -> tuple | None:
    """(ts, src, dst, sport, dport, proto, ip_len, ttl, flags, payload) of a TCP or UDP packet."""
    ip = network_layer(frame, link)
    if not ip:
        return None
    try:
        if ip[0] >> 4 == 4:
            head = (ip[0] & 15) * 4
            size, proto, ttl = struct.unpack_from(">H", ip, 2)[0], ip[9], ip[8]
            if struct.unpack_from(">H", ip, 6)[0] & 0x1FFF:
                return None
            src, dst = socket.inet_ntoa(ip[12:16]), socket.inet_ntoa(ip[16:20])
        elif ip[0] >> 4 == 6:
            head = 40
            size, proto, ttl = struct.unpack_from(">H", ip, 4)[0] + 40, ip[6], ip[7]
            src, dst = str(ipaddress.IPv6Address(ip[8:24])), str(ipaddress.IPv6Address(ip[24:40]))
        else:
            return None
        rest = ip[head:size] if size else ip[head:]
        if proto == TCP:
            sport, dport = struct.unpack_from(">HH", rest)
            return ts, src, dst, sport, dport, proto, size, ttl, rest[13], rest[(rest[12] >> 4) * 4 :]
        if proto == UDP:
            sport, dport = struct.unpack_from(">HH", rest)
            return ts, src, dst, sport, dport, proto, size, ttl, 0, rest[8:]
    except (IndexError, struct.error):
        return None
    return None


# ---- DNS


def dns_message(data: bytes) -> dict:
    """query, qtype, is_response, rcode (responses) and size of a message's first question."""
    if len(data) < 12:
        raise ParseError("DNS message is cut short")
    _, flags, questions = struct.unpack_from(">HHH", data)
    if not questions:
        raise ParseError("DNS message has no question")
    parts, at = [], 12
    while True:
        if at >= len(data):
            raise ParseError("DNS name is cut short")
        n = data[at]
        if n & 0xC0:
            raise ParseError("DNS question is compressed")
        at += 1
        if not n:
            break
        if at + n > len(data):
            raise ParseError("DNS name is cut short")
        parts.append(data[at : at + n].decode("latin-1"))
        at += n
    if at + 4 > len(data):
        raise ParseError("DNS question is cut short")
    response = bool(flags & 0x8000)
    return {
        "query": ".".join(parts).lower().rstrip("."),
        "qtype": struct.unpack_from(">H", data, at)[0],
        "is_response": response,
        "rcode": flags & 15 if response else None,
        "size": len(data),
    }


# ---- TLS


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left():
            raise ParseError("TLS message is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def block(self, n: int) -> bytes:
        return self.take(self.number(n))


def _pairs(data: bytes) -> list[int]:
    return list(struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2]))


def client_hello(payload: bytes) -> dict:
    """Fields of a TLS ClientHello that its fingerprints need."""
    if len(payload) < 6 or payload[0] != 22 or payload[5] != 1:
        raise ParseError("not a ClientHello")
    c = _Cursor(payload)
    c.take(9)
    out: dict = {"legacy_version": c.number(2), "extensions": [], "groups": [], "point_formats": [], "sig_algs": [], "supported_versions": [], "sni": None, "alpn": []}
    c.take(32)
    c.block(1)
    out["ciphers"] = _pairs(c.block(2))
    c.block(1)
    if c.left() < 2:
        return out
    exts = _Cursor(c.block(2))
    while exts.left() >= 4:
        kind, body = exts.number(2), exts.block(2)
        out["extensions"].append(kind)
        if kind == 0 and len(body) >= 5:
            names = _Cursor(body)
            names.take(2)
            if names.number(1) == 0:
                out["sni"] = names.block(2).decode("ascii", "replace")
        elif kind == 10 and len(body) >= 2:
            out["groups"] = _pairs(body[2:])
        elif kind == 11 and body:
            out["point_formats"] = list(body[1 : 1 + body[0]])
        elif kind == 13 and len(body) >= 2:
            out["sig_algs"] = _pairs(body[2:])
        elif kind == 43 and body:
            out["supported_versions"] = _pairs(body[1 : 1 + body[0]])
        elif kind == 16 and len(body) >= 2:
            protocols = _Cursor(body[2:])
            while protocols.left():
                out["alpn"].append(protocols.block(1).decode("ascii", "replace"))
    return out


# ---- NetFlow


def netflow_v5(data: bytes) -> list[dict]:
    """The records of one NetFlow v5 datagram; each is a flow in one direction."""
    if len(data) < 24:
        raise ParseError("NetFlow datagram is shorter than its header")
    version, count, uptime, secs, nanos = struct.unpack_from(">HHIII", data)
    if version != 5:
        raise ParseError(f"NetFlow version {version} isn't read")
    if len(data) < 24 + 48 * count:
        raise ParseError("NetFlow datagram is cut short")
    now, out = secs + nanos / 1e9, []
    for at in range(24, 24 + 48 * count, 48):
        pkts, octets, first, last, sport, dport, _, flags, proto = struct.unpack_from(">IIIIHHBBB", data, at + 16)
        out.append({
            "src_ip": socket.inet_ntoa(data[at : at + 4]), "dst_ip": socket.inet_ntoa(data[at + 4 : at + 8]), "src_port": sport, "dst_port": dport, "proto": proto,
            "first_ts": now - (uptime - first) / 1000, "last_ts": now - (uptime - last) / 1000, "bytes_fwd": octets, "pkts_fwd": pkts, "flags": flags,
        })
    return out
