"""Coordinate reference systems as text: codes, horizontal parts of compounds, UTM zones. Column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How codes and zones are written.
EPSG = r"(?i)EPSG[:\s]*([0-9]{4,6})"
UTM = r"(?i)UTM(?:\s+ZONE)?[:\s]*([0-9]{1,2})([NS])?"


def epsg_codes(text: Column) -> Column:
    """All EPSG codes that a description names, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(EPSG), F.lit(1)), lambda c: c.cast("int"))


def utm_code(text: Column) -> Column:
    """WGS 84 UTM code of a named zone (north unless it says south); null for none or a zone beyond 60."""
    zone = F.regexp_extract(text, UTM, 1)
    number = F.when(zone != "", zone.cast("int"))
    return F.when(number.between(1, 60), F.when(F.upper(F.regexp_extract(text, UTM, 2)) == "S", 32700).otherwise(32600) + number)


def vertical_only(text: Column) -> Column:
    """Whether a description is of a height system without a horizontal part."""
    return F.regexp_like(text, F.lit(r"(?i)^\s*VERT(?:CRS|_CS|ICALCRS)\b"))


def horizontal(text: Column) -> Column:
    """Code of the horizontal part: the first code of ``EPSG:a+b``, of a compound in words the last one that its horizontal
    part names, else the only one, else the UTM zone. A vertical system alone is an error; null stays null."""
    parts = F.split(text, r"\+")
    inner = F.regexp_extract(text, r"(?is)^\s*COMP(?:D_CS|OUNDCRS)\s*\[.*?((?:PROJ|GEO[GD])\w*\s*\[.*)$", 1)
    own = F.when(inner != "", F.split(inner, r"(?i)VERT(?:CRS|_CS|ICALCRS)")[0]).otherwise(parts[0])
    codes = epsg_codes(own)
    found = F.coalesce(F.when(F.size(codes) > 0, F.element_at(codes, F.when(inner != "", -1).otherwise(1))), utm_code(own))
    return F.when(vertical_only(text), F.raise_error(F.concat(F.lit("a vertical system has no horizontal part: "), text))).otherwise(found)
