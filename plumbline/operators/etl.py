"""Preparation of boundary tables: attribute joins, code tables, cleaning, order of specificity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import approx_area
from ..functions.text import clean_number_sentinel, clean_space, clean_text_sentinel, iso_or

#: What the build exposes of each source file: (exposed key, source property, label), the default first.
PROJECTIONS = {
    "countries.geojson": (("ADMIN", "ADMIN", "Name"), ("ISO_A3", "ISO_A3", "ISO code (3)"), ("ISO_A2", "ISO_A2", "ISO code (2)"), ("CONTINENT", "CONTINENT", "Continent")),
    "us-states.geojson": (("NAME", "NAME", "Name"), ("USPS", "STUSPS", "USPS code"), ("FIPS", "STATEFP", "FIPS code")),
    "us-counties.geojson": (("NAME", "NAME", "Name"), ("COUNTY", "COUNTYFP", "County FIPS"), ("STATEFP", "STATEFP", "State FIPS")),
    "us-zctas.geojson": (("ZCTA5", "ZCTA5CE20", "ZIP Code (ZCTA)"),),
    "balancing-authorities.geojson": (("BAL_AUTH", "BAL_AUTH", "Name"), ("BA_Abbrev", "BA_Abbrev", "Abbreviation")),
    "nerc-regions.geojson": (("NERC_Label", "NERC_Label", "Name"), ("NERC", "NERC", "Code")),
    "admin1.geojson": (("name", "name", "Name"), ("country", "country", "Country"), ("iso_a3", "iso_a3", "Country ISO (3)")),
    "control-areas.geojson": (("NAME", "NAME", "Name"), ("ID", "ID", "EIA ID"), ("STATE", "STATE", "State")),
    "retail-territories.geojson": (
        ("name", "name", "Name"), ("type", "type", "Ownership type"), ("state", "state", "State"),
        ("hold_co", "hold_co", "Holding company"), ("ctrl_area", "ctrl_area", "Control area"), ("customers", "customers", "Customers"),
    ),
}
#: Columns of the retail territory table and the keys they get.
RETAIL_COLUMNS = {"NAME": "name", "TYPE": "type", "STATE": "state", "HOLDING_CO": "hold_co", "CNTRL_AREA": "ctrl_area", "CUSTOMERS": "customers"}


def project(df: DataFrame, source: str) -> DataFrame:
    """The exposed keys of a source file as columns, missing values blank and white space cleaned; other columns go."""
    return df.select(*[clean_space(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(k) for k, c, _ in PROJECTIONS[source]])


def projected(features: DataFrame, source: str) -> DataFrame:
    """Features (fi, props, polygons) with the exposed properties of a source file alone. A file without a projection
    exposes its default property."""
    own = PROJECTIONS.get(source)
    if own is None:
        key = default_property(features)
        own = ((key, key, key),) if key else ()
    pairs = [x for k, c, _ in own for x in (F.lit(k), clean_space(F.coalesce(F.try_element_at("props", F.lit(c)), F.lit(""))))]
    return features.withColumn("props", F.create_map(*pairs).cast("map<string,string>"))


def default_property(features: DataFrame) -> str | None:
    """Of a file without a projection: the first key of the first feature that has properties."""
    first = features.where(F.size("props") > 0).select("fi", F.get(F.map_keys("props"), F.lit(0)).alias("key")).orderBy("fi").first()
    return first["key"] if first else None


def rename_retail(df: DataFrame) -> DataFrame:
    """The retail territory columns under their keys; the others are dropped."""
    return df.select(*RETAIL_COLUMNS).withColumnsRenamed(RETAIL_COLUMNS)


def polygons_only(df: DataFrame, kind: str = "geometry.type") -> DataFrame:
    """Rows that have a polygon or multipolygon; before features are numbered."""
    return df.where(F.coalesce(F.col(kind).isin("Polygon", "MultiPolygon"), F.lit(False)))


def attribute_join(left: DataFrame, right: DataFrame, on: str, position: str, columns: list[str]) -> DataFrame:
    """Left join on a code; of right rows of equal code the last by position counts; missing values are blank."""
    last = right.groupBy(on).agg(F.max_by(F.struct(*columns), position).alias("_r"))
    out = left.join(last, on, "left")
    return out.select(*left.columns, *[F.coalesce(iso_or(F.col("_r").getField(c).cast("string")), F.lit("")).alias(c) for c in columns])


def territories(candidates: DataFrame, present: DataFrame, code: str, skip: tuple[str, ...] = ("PSE",)) -> DataFrame:
    """Candidates whose real code is not present and not skipped."""
    real = candidates.where(iso_or(F.col(code)).isNotNull() & ~F.col(code).isin(*skip))
    return real.join(present.select(F.col(code)).distinct(), code, "left_anti").select(*candidates.columns)


def numbered(df: DataFrame, order: list[str], out: str = "fi") -> DataFrame:
    """out: the place of a row in an order of columns that tell rows apart. Only these columns are brought together; rows
    of any width stay where they are and are joined with their numbers."""
    ids = df.select(*order).withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    ids = ids.select(*[F.col(c).alias(f"_{c}") for c in order], out)
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(ids, same).drop(*[f"_{c}" for c in order])


def ordered_union(parts: list[DataFrame], position: str) -> DataFrame:
    """Parts one after another, each in its own order, numbered as features: the order decides ties. position is unique
    within a part."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return numbered(out, ["_part", position]).drop("_part")


def lookup(df: DataFrame, names: DataFrame, code: str, name: str, out: str, position: str | None = None) -> DataFrame:
    """A dimension's name, or the code itself. Of names of equal code the last by position counts."""
    last = F.max_by(name, position) if position else F.max(name)
    named = names.groupBy(code).agg(last.alias("_name"))
    return df.join(named, code, "left").withColumn(out, F.coalesce("_name", code)).drop("_name")


def distinct_codes(df: DataFrame, code: str, out: str = "countries") -> DataFrame:
    """How many different codes there are, a missing one included."""
    return df.agg((F.count_distinct(code) + F.max(F.col(code).isNull().cast("int"))).alias(out)).select(F.coalesce(out, F.lit(0)).alias(out))


def translation_table(features: DataFrame, short: str, long: str) -> DataFrame:
    """short, long: one row per code that is not blank, from its first feature, in order of appearance (first_fi)."""
    s, value = F.coalesce(F.element_at("props", short), F.lit("")), F.coalesce(F.element_at("props", long), F.lit(""))
    rows = features.select("fi", s.alias("short"), value.alias("long")).where("short <> ''")
    return rows.groupBy("short").agg(F.min_by("long", "fi").alias("long"), F.min("fi").alias("first_fi"))


def translate(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """The long name of a code column; blank where the table has none."""
    t = table.select(F.col("short").alias("_s"), F.col("long").alias("_l"))
    return df.join(t, F.col(column) == F.col("_s"), "left").withColumn(out, F.coalesce("_l", F.lit(""))).drop("_s", "_l")


def clean_columns(df: DataFrame, texts: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    return df.withColumns({c: clean_text_sentinel(F.col(c)) for c in texts} | {c: clean_number_sentinel(F.col(c)) for c in numbers})


def sentinel_counts(df: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """For each column how many values that were there are cleaned to nothing."""
    def count(c, clean):
        return F.count_if((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "") & (clean(F.col(c)) == "")).alias(c)

    return df.agg(*[count(c, clean_text_sentinel) for c in texts], *[count(c, clean_number_sentinel) for c in numbers])


def by_specificity(features: DataFrame, position: str) -> DataFrame:
    """Features numbered by approximate area, smallest first, ties in their order (position is unique): so the first
    match is the most specific."""
    return numbered(features.withColumn("area", approx_area(F.col("polygons"))), ["area", position])
