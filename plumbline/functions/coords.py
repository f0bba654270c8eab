"""Coordinates: lenient number parsing, validity, fixed-point units."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space that number parsing trims.
JS_SPACE = "\t\n\x0b\x0c\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
SCALE = 1_000_000


def js_number(c: Column, blank_as_zero: bool = True) -> Column:
    """A cell as a double by browser rules: blank is 0, 0x/0o/0b integers count, anything else malformed is NaN."""
    s = F.trim(F.coalesce(c, F.lit("\x00")), F.lit(JS_SPACE))
    decimal = s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    based = [F.when(s.rlike(p), F.conv(F.substr(s, F.lit(3)), b, 10).cast("double")) for p, b in ((r"^0[xX][0-9a-fA-F]+$", 16), (r"^0[oO][0-7]+$", 8), (r"^0[bB][01]+$", 2))]
    infinite = F.when(s.rlike(r"^[+]?Infinity$"), F.lit(float("inf"))).when(s == "-Infinity", F.lit(float("-inf")))
    blank = F.when(s == "", F.lit(0.0) if blank_as_zero else F.lit(float("nan")))
    return F.coalesce(blank, F.when(decimal, s.try_cast("double")), *based, infinite, F.lit(float("nan")))


def valid_coord(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def finite(lat: Column, lon: Column) -> Column:
    """What a map plots: any finite pair, in range or not."""
    ok = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(ok(lat) & ok(lon), F.lit(False))


def quantize(c: Column) -> Column:
    """Degrees in millionths, halves up."""
    return F.floor(c * F.lit(float(SCALE)) + F.lit(0.5)).cast("int")


def dequantize(c: Column) -> Column:
    return c / F.lit(float(SCALE))
