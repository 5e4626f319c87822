"""Media columns: progressive JPEG, read by accumulating its scans into coefficient arrays.

``decode`` reads progressive (SOF2) and sequential-Huffman-free streams of one to four components:
spectral-selection scans place bands of coefficients, successive-approximation scans add a
bit each, and the arrays are then dequantised, inverse-transformed in numpy, chroma is
upsampled by replication, and a full-resolution RGB tensor results. Stretches of equal
structure (a run of coefficients under one code, the correction bits of an end-of-band run, a
refinement of DC) are read as arrays; whatever else the stream holds is read code by code.

``encode`` stores bytes losslessly. The format's exact unit is the quantised coefficient, not
the sample, so a byte is a coefficient: of the 256 values of magnitude 128 to 255 the one whose
additional bits are the byte. 384 bytes are four 8 x 8 blocks of luma and one of each chroma
(4:2:0), quantised by steps that grow with the frequency; all coefficients are sent with the
lowest bit left out in bands, then refined.

Nulls are empty; a payload is padded by spaces to a positive multiple of 192 bytes. Equal
texts give equal bytes. Repeated rows repeat results; an empty table gives an empty
table. The columns of the input stay; results are in one column each for media and contents.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, frugal

UNIT = 192
#: The writer's sampling: blocks of a unit by component; most units across and down.
SAMPLING = ((2, 2), (1, 1), (1, 1))
BLOCKS = sum(h * v for h, v in SAMPLING)
WIDE, TALL = 8, 4095
BANDS = ((1, 5), (6, 63))
#: Code tables of the writer: symbols by code length. AC has one short code for size 7, and the end-of-band runs.
DC_CODES = (b"", b"", b"", bytes(range(12)))
AC_CODES = (b"\x07", b"", b"", b"", bytes(i << 4 for i in range(15)))
_NEXT = re.compile(rb"\xff+[\x01-\xcf\xd8-\xfe]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    places = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in places])


ZIGZAG = _zigzag()
#: Quantisation steps of luma and chroma in zigzag order: small, as the magnitudes are large.
STEPS = tuple(np.where(ZIGZAG == 0, dc, 1 + (ZIGZAG // 8 + ZIGZAG % 8) // slow).astype(np.uint8).tobytes() for dc, slow in ((4, 6), (3, 4)))


@lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """Matrix from 64 coefficients in zigzag order to 64 samples."""
    x = np.arange(8)
    base = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(base, base).T[ZIGZAG].copy()


@lru_cache(maxsize=256)
def _lookup(spec: bytes) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Length and symbol for every 16-bit prefix, and the code of each symbol, of a table in DHT form."""
    length, symbol, codes = bytearray(65_536), bytearray(65_536), {}
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            lo, span = code << (16 - n), 1 << (16 - n)
            length[lo : lo + span] = bytes([n]) * span
            symbol[lo : lo + span] = bytes([spec[at]]) * span
            codes[spec[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return bytes(length), bytes(symbol), codes


def _table(by_length: tuple[bytes, ...]) -> bytes:
    by_length = (*by_length, *[b""] * (16 - len(by_length)))
    return bytes(map(len, by_length)) + b"".join(by_length)


DC_TABLE, AC_TABLE = _table(DC_CODES), _table(AC_CODES)


class Bits:
    """Bits of one unstuffed segment of a scan."""

    def __init__(self, data: bytes):
        self.size = len(data) * 8
        self.raw = data + b"\0\0\0\0"
        self.pos = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        i, p = self.pos >> 3, self.pos
        self.pos += n
        return int.from_bytes(self.raw[i : i + 4], "big") >> (32 - (p & 7) - n) & ((1 << n) - 1)

    def symbol(self, table: tuple) -> int:
        i, p = self.pos >> 3, self.pos & 7
        raw = self.raw
        if self.pos >= self.size:
            raise ValueError("scan is cut short")
        peek = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) >> (8 - p)) & 0xFFFF
        n = table[0][peek]
        if not n:
            raise ValueError("no such code")
        self.pos += n
        return table[1][peek]

    def value(self, size: int) -> int:
        got = self.take(size)
        return got if not size or got >> (size - 1) else got - (1 << size) + 1

    def array(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        off = self.pos & 7
        self.pos += n
        if self.pos > self.size:
            raise ValueError("scan is cut short")
        return np.unpackbits(np.frombuffer(self.raw, np.uint8, b - a, a))[off : off + n]


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks, padded to whole units
    tall: int = 0
    own_wide: int = 0  # blocks of a scan of this component alone
    own_tall: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)

    def frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        for i in range(n):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.components[c] = Component(hv >> 4, hv & 15, q)
        most_h, most_v = (max(getattr(c, a) for c in self.components.values()) for a in "hv")
        for c in self.components.values():
            c.wide, c.tall = -(-self.width // (8 * most_h)) * c.h, -(-self.height // (8 * most_v)) * c.v
            c.own_wide, c.own_tall = -(-(-(-self.width * c.h // most_h)) // 8), -(-(-(-self.height * c.v // most_v)) // 8)
            c.coef = np.zeros((c.wide * c.tall, 64), np.int32)

    def rgb(self) -> np.ndarray:
        """height x width x 3 tensor of bytes."""
        most_h, most_v = (max(getattr(c, a) for c in self.components.values()) for a in "hv")
        planes = []
        for c in self.components.values():
            samples = np.rint((c.coef * self.quants[c.quant]).astype(np.float64) @ _inverse() + 128).clip(0, 255).astype(np.float32)
            plane = samples.reshape(c.tall, c.wide, 8, 8).swapaxes(1, 2).reshape(c.tall * 8, c.wide * 8)
            if c.h < most_h:
                plane = plane.repeat(most_h // c.h, axis=1)
            if c.v < most_v:
                plane = plane.repeat(most_v // c.v, axis=0)
            planes.append(plane[: self.height, : self.width])
        if len(planes) < 3:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, b, r = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        out = np.empty((self.height, self.width, 3), np.float32)
        out[..., 0] = y + np.float32(1.402) * r
        out[..., 1] = y - np.float32(0.344136) * b - np.float32(0.714136) * r
        out[..., 2] = y + np.float32(1.772) * b
        return np.rint(out).clip(0, 255).astype(np.uint8)


def decode(data: bytes) -> Image:
    """Coefficients of a progressive JPEG; Image.rgb() gives its samples."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, restart, at = Image(), {}, 0, 2
    while True:
        m = _NEXT.match(data, at) or _NEXT.search(data, at)
        if not m:
            raise ValueError("no end of image")
        kind, at = m[0][-1], m.end()
        if kind == 0xD9:
            return image
        if kind in (0x01, 0xD8):
            continue
        (n,) = struct.unpack_from(">H", data, at)
        body = data[at + 2 : at + n]
        if len(body) < n - 2:
            raise ValueError("segment is cut short")
        at += n
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                image.quants[body[i] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int32)
                i += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            i = 0
            while i < len(body):
                size = 16 + sum(body[i + 1 : i + 17])
                tables[body[i]] = _lookup(body[i + 1 : i + 1 + size])
                i += 1 + size
        elif kind == 0xC2:
            image.frame(body)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif kind == 0xFE:
            image.comments.append(body)
        elif kind == 0xDA:
            end = _NEXT.search(data, at)
            stop = end.start() if end else len(data)
            _scan(image, tables, restart, body, data[at:stop])
            at = stop


def _scan(image: Image, tables: dict, restart: int, head: bytes, data: bytes) -> None:
    n = head[0]
    chosen = [(image.components[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(n)]
    first, last, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if n > 1:
        units = _interleaved([c for c, _ in chosen])
    else:
        c = chosen[0][0]
        units = [(np.arange(c.own_tall)[:, None] * c.wide + np.arange(c.own_wide)[None, :]).reshape(-1, 1)]
    total = len(units[0])
    step = restart or total
    parts = _RESTART.split(data) if restart else [data]
    for i, part in zip(range(0, total, step), parts, strict=False):
        bits = Bits(part.replace(b"\xff\x00", b"\xff"))
        some = [u[i : i + step] for u in units]
        if first == 0:
            _dc(bits, [c for c, _ in chosen], some, [tables.get(t >> 4) for _, t in chosen], high, low)
        else:
            c, t = chosen[0]
            (_refine if high else _place)(bits, c.coef, some[0][:, 0], tables[0x10 | t & 15], first, last, low)


def _interleaved(components: list[Component]) -> list[np.ndarray]:
    """For each component its blocks by unit: an array of units x blocks."""
    out = []
    for c in components:
        y, x = np.arange(c.tall // c.v)[:, None, None, None], np.arange(c.wide // c.h)[None, :, None, None]
        v, h = np.arange(c.v)[None, None, :, None], np.arange(c.h)[None, None, None, :]
        out.append(((y * c.v + v) * c.wide + x * c.h + h).reshape(-1, c.v * c.h))
    return out


def _dc(bits: Bits, components: list[Component], units: list[np.ndarray], tables: list, high: int, low: int) -> None:
    order = np.concatenate([np.stack([np.full(u.shape, i), u], axis=2) for i, u in enumerate(units)], axis=1).reshape(-1, 2)
    if high:
        more = bits.array(len(order)).astype(np.int32) << low
        for i, c in enumerate(components):
            own = order[:, 0] == i
            c.coef[order[own, 1], 0] |= more[own]
        return
    last, got = [0] * len(components), []
    symbol, value = bits.symbol, bits.value
    for i in order[:, 0].tolist():
        last[i] += value(symbol(tables[i]))
        got.append(last[i])
    values = np.array(got, np.int32) << low
    for i, c in enumerate(components):
        own = order[:, 0] == i
        c.coef[order[own, 1], 0] = values[own]


def _run(bits: Bits, table: tuple, blocks: int, band: int) -> tuple[int, np.ndarray | None]:
    """Whole blocks ahead in which each coefficient has the code that is next, and their values."""
    start = bits.pos
    s = bits.symbol(table)
    bits.pos = start
    if s >> 4 or not s:
        return 0, None
    code, n = table[2][s]
    step = n + s
    most = min(blocks * band, (bits.size - start) // step)
    if step == 8 and not start & 7:
        raw = np.frombuffer(bits.raw, np.uint8, most, start >> 3)
        same = raw >> s == code
        extra = (raw & ((1 << s) - 1)).astype(np.int32)
    else:
        rows = bits.array(most * step).reshape(most, step)
        bits.pos = start
        weights = 1 << np.arange(step - 1, -1, -1)
        whole = rows.astype(np.int32) @ weights.astype(np.int32)
        same, extra = whole >> s == code, whole & ((1 << s) - 1)
    good = most if same.all() else int(np.argmin(same))
    q = good // band
    if not q:
        return 0, None
    bits.pos = start + q * band * step
    extra = extra[: q * band]
    return q, np.where(extra >> (s - 1), extra, extra - (1 << s) + 1).reshape(q, band)


def _place(bits: Bits, coef: np.ndarray, blocks: np.ndarray, table: tuple, first: int, last: int, low: int) -> None:
    """First scan of a band: new values."""
    i, n, patience = 0, len(blocks), 0
    while i < n:
        if patience <= 0:
            q, values = _run(bits, table, n - i, last - first + 1)
            if q:
                coef[blocks[i : i + q], first : last + 1] = values << low
                i += q
                continue
            patience = 64
        patience -= 1
        k, row = first, coef[blocks[i]]
        while k <= last:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                row[k] = bits.value(s) << low if s else 0
                k += 1
            elif r == 15:
                k += 16
            else:
                i += (1 << r) + bits.take(r) - 1
                break
        i += 1


def _correct(bits: Bits, coef: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    """One more bit for every coefficient of a band that isn't zero."""
    part = coef[blocks, first : last + 1]
    held = part != 0
    more = bits.array(int(held.sum())).astype(np.int32) << low
    part[held] += np.where(part[held] > 0, more, -more)
    coef[blocks, first : last + 1] = part


def _refine(bits: Bits, coef: np.ndarray, blocks: np.ndarray, table: tuple, first: int, last: int, low: int) -> None:
    """Later scan of a band: correction bits, and values that become one."""
    i, n, one = 0, len(blocks), 1 << low
    while i < n:
        k, row = first, coef[blocks[i]]
        while k <= last:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if not s and r < 15:
                rest = (1 << r) + bits.take(r)
                if k > first:
                    _correct(bits, coef, blocks[i : i + 1], k, last, low)
                    if rest > 1:
                        _correct(bits, coef, blocks[i + 1 : i + rest], first, last, low)
                else:
                    _correct(bits, coef, blocks[i : i + rest], first, last, low)
                i += rest - 1
                break
            new = (one if bits.take(1) else -one) if s else 0
            while k <= last:
                if row[k]:
                    if bits.take(1):
                        row[k] += one if row[k] > 0 else -one
                elif r:
                    r -= 1
                else:
                    break
                k += 1
            if new and k <= last:
                row[k] = new
            k += 1
        i += 1


# ---- writing


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _sos(components: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, 0)), first, last, high << 4 | low]))


def _packed(bits: np.ndarray) -> bytes:
    """Bits padded by ones, with stuffing."""
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _spelled(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n - 1, -1, -1)]


def _dc_bits(values: np.ndarray) -> np.ndarray:
    """Differences of interleaved DC values (units x blocks) under DC_TABLE, all of whose codes have four bits."""
    parts, at = [], 0
    for h, v in SAMPLING:
        own = values[:, at : at + h * v]
        parts.append(np.diff(own.reshape(-1), prepend=np.zeros(1, values.dtype)).reshape(own.shape))
        at += h * v
    diff = np.concatenate(parts, axis=1).reshape(-1)
    size = np.zeros(len(diff), np.int64)
    for i in range(12):
        size += np.abs(diff) >> i > 0
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    word = (size << 12 | extra << (12 - size)).astype(">u2")  # four bits of code, then the value, at the top
    rows = np.unpackbits(word.view(np.uint8)).reshape(-1, 16)
    return rows[np.arange(16)[None, :] < 4 + size[:, None]]


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose quantised coefficients are the payload (a multiple of 192 bytes)."""
    n = -(-len(payload) // (BLOCKS * 64))
    wide = min(n, WIDE) if n <= WIDE * TALL else -(-n // TALL)
    tall = -(-n // wide)
    raw = np.frombuffer(payload + b" " * (wide * tall * BLOCKS * 64 - len(payload)), np.uint8).reshape(-1, BLOCKS, 64)
    value = raw.astype(np.int16)
    value = np.where(value >= 128, value, value - 255)
    size = np.abs(value)
    half = np.where(value > 0, size >> 1, ~(size >> 1) & 127).astype(np.uint8)  # size 7: one bit of code, seven of value
    odd = (size & 1).astype(np.uint8)
    most_h, most_v = (max(x) for x in zip(*SAMPLING, strict=True))
    sampled = b"".join(bytes([i + 1, h << 4 | v, i > 0]) for i, (h, v) in enumerate(SAMPLING))
    frame = struct.pack(">BHHB", 8, tall * most_v * 8, wide * most_h * 8, len(SAMPLING)) + sampled
    image = Image()
    image.frame(frame)
    order = _placed(image)
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload=%d" % len(payload)),
        _segment(0xDB, b"\0" + STEPS[0] + b"\1" + STEPS[1]),
        _segment(0xC2, frame),
        _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE),
        _sos((1, 2, 3), 0, 0, 0, 1),
        _packed(_dc_bits(value[:, :, 0].astype(np.int64) >> 1)),
    ]
    rows = half.reshape(-1, 64)
    for first, last in BANDS:
        for c, blocks in enumerate(order):
            out += [_sos((c + 1,), first, last, 0, 1), rows[blocks, first : last + 1].tobytes()]
    out += [_sos((1, 2, 3), 0, 0, 1, 0), _packed((value[:, :, 0] & 1).astype(np.uint8).reshape(-1))]
    codes = _lookup(AC_TABLE)[2]
    rows = odd.reshape(-1, 64)
    for c, blocks in enumerate(order):
        bits = []
        for i in range(0, len(blocks), 32_767):
            part = rows[blocks[i : i + 32_767], 1:].reshape(-1)
            r = (len(part) // 63).bit_length() - 1
            code, length = codes[r << 4]
            bits += [np.array(_spelled(code, length) + _spelled(len(part) // 63 - (1 << r), r), np.uint8), part]
        out += [_sos((c + 1,), 1, 63, 1, 0), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def _placed(image: Image) -> list[np.ndarray]:
    """For each component the numbers of its blocks in the interleaved order, row by row."""
    units = _interleaved(list(image.components.values()))
    out, at, whole = [], 0, sum(u.shape[1] for u in units)
    for u in units:
        number = np.arange(len(u))[:, None] * whole + at + np.arange(u.shape[1])
        place = np.empty(u.size, np.int64)
        place[u.reshape(-1)] = number.reshape(-1)
        out.append(place)
        at += u.shape[1]
    return out


def payload_of(image: Image) -> bytes:
    """The bytes that encode() stored."""
    n = next(int(c[8:]) for c in image.comments if c.startswith(b"payload="))
    components = list(image.components.values())
    value = np.concatenate([c.coef[u] for c, u in zip(components, _interleaved(components), strict=True)], axis=1)
    return np.where(value > 0, value, value + 255).astype(np.uint8).tobytes()[:n]


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


# ---- columns

CONTENTS = "struct<payload:binary,width:int,height:int,rgb:binary,means:array<double>>"


def store(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with each whole text stored in a progressive JPEG (binary column ``out``)."""
    bounded_batches(df.sparkSession, "2m")

    @F.arrow_udf("binary")

    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([encode(padded(t)) for t in texts.to_pylist()], pa.binary())

    return df.withColumn(out, run(F.col(text)))


def load(df: DataFrame, media: str = "media", out: str = "contents", pixels: bool = True) -> DataFrame:
    """df with what the media column holds: payload, and the RGB tensor with its size and channel means."""
    bounded_batches(df.sparkSession, "2m")

    @F.arrow_udf(CONTENTS)

    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("payload", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("means", pa.list_(pa.float64()))])
        for files in batches:
            rows = []
            for data in files.to_pylist():
                image = decode(data)
                rgb = image.rgb() if pixels else None
                rows.append({
                    "payload": payload_of(image), "width": image.width, "height": image.height,
                    "rgb": rgb.tobytes() if pixels else None,
                    "means": (rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (image.width * image.height)).tolist() if pixels else None,
                })
            yield pa.array(rows, kind)

    return df.withColumn(out, run(F.col(media)))
