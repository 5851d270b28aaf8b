"""Scalar expressions and output formatters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_M32 = 0xFFFFFFFF


def _mul32(a: Column, k: int) -> Column:
    """a * k modulo 2**32 from 16-bit halves: no 64-bit overflow."""
    lo, hi = F.lit(k & 0xFFFF), F.lit(k >> 16)
    low = a.bitwiseAND(F.lit(0xFFFF))
    high = F.shiftright(a, 16)
    cross = (high * lo + low * hi).bitwiseAND(F.lit(0xFFFF))
    return (low * lo + F.shiftleft(cross, 16)).bitwiseAND(F.lit(_M32))


def murmur_finalize(column: Column) -> Column:
    """The public MurmurHash3 32-bit finaliser of the low 32 bits."""
    h = column.cast("long").bitwiseAND(F.lit(_M32))
    for shift, k in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = _mul32(h.bitwiseXOR(F.shiftright(h, shift)), k)
    return h.bitwiseXOR(F.shiftright(h, 16))


def knuth_hash(column: Column, bits: int) -> Column:
    """Multiplicative hash by 2654435761 into ``bits`` bits."""
    return F.shiftright(_mul32(column.cast("long").bitwiseAND(F.lit(_M32)), 2654435761), 32 - bits)


def fuzzy_match(column: Column, letters: str) -> Column:
    """The letters occur in this order, ignoring case."""
    # letters may lie on different lines
    return F.lower(column).rlike("(?s)" + ".*".join(re.escape(c) for c in letters.lower()))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def depth(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("long")


#: Bytes a second that a plain scan is taken to read (fixed value).
SCAN_SPEED = 6.5e9


def scan_ms(size: Column) -> Column:
    """Milliseconds that a plain scan of so many bytes is estimated to take."""
    return size / F.lit(SCAN_SPEED) * 1000


def show_float(x: float) -> str:
    """Integers without a point, else at most six decimals without trailing zeros."""
    return str(int(x)) if x == int(x) else f"{x:.6f}".rstrip("0").rstrip(".")


def show_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def show_rows(n: int) -> str:
    for limit, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if n >= limit:
            return f"{n / limit:.1f}{unit}"
    return str(n)


def show_time(seconds: float) -> str:
    if seconds < 1e-3:
        return f"{seconds * 1e6:.0f} us"
    return f"{seconds * 1e3:.1f} ms" if seconds < 1 else f"{seconds:.2f} s"
