"""TLS client fingerprints over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JA4's names of versions.
VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}
SNI_EXTENSION, ALPN_EXTENSION = 0x0000, 0x0010


def is_grease(v: Column) -> Column:
    low = v.bitwiseAND(F.lit(0xFF))
    return (v.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (low == F.shiftright(v, 8))


def plain(values: Column) -> Column:
    """Values without GREASE."""
    return F.filter(values, lambda v: ~is_grease(v))


def _dashed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), "-")


def ja3_string(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    return F.array_join(F.array(version.cast("string"), _dashed(plain(ciphers)), _dashed(plain(extensions)), _dashed(plain(groups)), _dashed(formats)), ",")


def ja3(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    return F.md5(ja3_string(version, ciphers, extensions, groups, formats).cast("binary"))


def version_label(legacy: Column, supported: Column) -> Column:
    best = F.coalesce(F.array_max(plain(supported)), legacy)
    out = F.lit("00")
    for number, name in VERSIONS.items():
        out = F.when(best == number, name).otherwise(out)
    return out


def _hex4(v: Column) -> Column:
    return F.lpad(F.lower(F.hex(v.cast("long"))), 4, "0")


def _prefix(text: Column, empty: Column) -> Column:
    return F.when(empty, "0" * 12).otherwise(F.substring(F.sha2(text.cast("binary"), 256), 1, 12))


def ja4(legacy: Column, ciphers: Column, extensions: Column, sig_algs: Column, supported: Column, sni: Column, alpn: Column) -> Column:
    c, e = plain(ciphers), plain(extensions)
    first = F.try_element_at(alpn, F.lit(1))
    ends = lambda t: F.concat(t.substr(F.lit(1), F.lit(1)), t.substr(F.length(t), F.lit(1)))
    edge = F.when(first.isNull() | (first == ""), "00").when(ends(first).rlike("^[A-Za-z0-9]{2}$"), ends(first)).otherwise(ends(F.lower(F.hex(first.cast("binary")))))
    two = lambda n: F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")
    head = F.concat(F.lit("t"), version_label(legacy, supported), F.when(F.length(sni) > 0, "d").otherwise("i"), two(F.size(c)), two(F.size(e)), edge)
    kept = F.filter(e, lambda x: (x != SNI_EXTENSION) & (x != ALPN_EXTENSION))
    ciphers_text = F.array_join(F.array_sort(F.transform(c, _hex4)), ",")
    exts = F.array_join(F.array_sort(F.transform(kept, _hex4)), ",")
    algs = F.array_join(F.transform(plain(sig_algs), _hex4), ",")
    tail = F.when(F.size(plain(sig_algs)) > 0, F.concat(exts, F.lit("_"), algs)).otherwise(exts)
    return F.concat_ws("_", head, _prefix(ciphers_text, F.size(c) == 0), _prefix(tail, F.size(kept) == 0))


def looks_like_client_hello(payload: Column) -> Column:
    byte = lambda i: F.hex(F.substring(payload, i, 1))
    return (F.octet_length(payload) > 5) & (byte(1) == "16") & (byte(6) == "01")
