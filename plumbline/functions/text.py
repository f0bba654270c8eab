"""Names, cleaning and colours."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

#: Texts that stand for a missing value in retail territory tables.
SENTINELS = ("NOT AVAILABLE", "NOT-AVAILABLE", "N/A", "NULL", "UNKNOWN")
#: The qualitative palette of features, in order; fallbacks of points and polygons.
PALETTE = (
    "#e6194b", "#3cb44b", "#4363d8", "#f58231", "#911eb4", "#46f0f0", "#f032e6", "#bcf60c", "#fabebe",
    "#008080", "#9a6324", "#800000", "#aaffc3", "#808000", "#ffd8b1", "#000075", "#a9a9a9", "#00a5ff",
)
POINT_COLOR, POLYGON_COLOR = "#ff4444", "#3388ff"
LAT_NAMES, LON_NAMES = re.compile(r"(lat|latitude|y|northing)", re.I), re.compile(r"(lon|lng|longitude|x|easting)", re.I)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def slug_name(s: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "_", s).strip("_")


def output_names(base: str, properties: list[tuple[str, str]], selected: Iterable[str]) -> list[tuple[str, str]]:
    """(key, column) of the selected properties in the order in which they are available. The first property is named
    by the base alone. A name that would be empty, or that two properties of a layer share, is refused."""
    chosen, out = set(selected), []
    for i, (key, label) in enumerate(properties):
        if key in chosen:
            out.append((key, slug_name(base) if i == 0 else slug_name(f"{base}_{label}")))
    names = [n for _, n in out]
    if "" in names or len(set(names)) < len(names):
        raise ValueError(f"output columns of layer {base!r} are empty or repeat: {names}")
    return out


def detect_coordinates(columns: list[str]) -> tuple[str | None, str | None]:
    first = lambda rx: next((c for c in columns if rx.fullmatch(c.strip())), None)
    return first(LAT_NAMES), first(LON_NAMES)


def clean_space(c: Column) -> Column:
    """Runs of white space, no-break space included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+", " "))


def clean_text_sentinel(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.upper(t).isin(*SENTINELS), F.lit("")).otherwise(t)


def clean_number_sentinel(c: Column) -> Column:
    """A number as text; missing, negative or infinite values are empty, whole numbers have no point."""
    n = c.cast("double")
    ok = n.isNotNull() & ~F.isnan(n) & (n >= 0) & (n != float("inf"))
    whole = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return F.when(ok, whole).otherwise(F.lit(""))


def iso_or(code: Column, fallback: Column | None = None) -> Column:
    """An ISO code unless it is blank or -99."""
    own = F.when((code != "") & (code != "-99"), code)
    return own if fallback is None else F.coalesce(own, fallback)


def megabytes(n: Column) -> Column:
    """Bytes as megabytes with one decimal, halves up."""
    return F.format_string("%.1f", F.floor(n / F.lit(1048576.0) * 10 + 0.5) / 10)


def size_warning(n: Column) -> Column:
    """What to say of a file of n bytes; null up to 50 MB."""
    mb = n / F.lit(1048576.0)
    return F.when(mb > 100, F.concat(F.lit("File is "), megabytes(n), F.lit("MB — may cause memory issues."))).when(mb > 50, F.concat(F.lit("File is "), megabytes(n), F.lit("MB — consider using a smaller file.")))


def percent_done(done: Column, total: Column) -> Column:
    """Progress in percent, 95 at most while anything is left to do."""
    return F.floor(done / total * 95 + 0.5).cast("int")


def base_name(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+$", "")


def auto_color(c: Column) -> Column:
    """A stable colour of a text: FNV-1a over its UTF-16 units, modulo the palette."""
    raw = F.encode(c, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substr(raw, (i * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
    units = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.length(raw) / 2 - 1, F.lit(0)).cast("int")), unit)).otherwise(F.array().cast("array<bigint>"))
    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), step)
    return F.element_at(F.array(*map(F.lit, PALETTE)), (h % len(PALETTE)).cast("int") + 1)


def first_segment(c: Column) -> Column:
    """The value that colours a joined cell: its first part."""
    return F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), "; "), 1))


def color_or(value: Column, fallback: str = POINT_COLOR) -> Column:
    return F.when(value != "", auto_color(value)).otherwise(F.lit(fallback))
