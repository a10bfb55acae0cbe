"""Per-namespace id normalizers: one expression each, ``""`` for what is no id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Trimmed; ``""`` for null, blank, nan, none, na."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.when(F.lower(t).isin("", "nan", "none", "na"), F.lit("")).otherwise(t)


def pubchem(x: Column) -> Column:
    """``PUBCHEM:<int>`` from a number with or without prefix; ``""`` if it is no number."""
    n = F.trim(F.replace(F.replace(strip(x), F.lit("PUBCHEM:"), F.lit("")), F.lit("CID:"), F.lit(""))).try_cast("double").try_cast("bigint")
    return F.coalesce(F.concat(F.lit("PUBCHEM:"), n.cast("string")), F.lit(""))


def chebi(x: Column) -> Column:
    """``CHEBI:<int>``: repeated prefixes and leading zeros go, nothing left is 0."""
    body = F.regexp_replace(F.regexp_replace(F.upper(strip(x)), "^(CHEBI:)+", ""), "^0+", "")
    return F.when(strip(x) == "", F.lit("")).otherwise(F.concat(F.lit("CHEBI:"), F.when(body == "", F.lit("0")).otherwise(body)))


def hmdb(x: Column) -> Column:
    """``HMDB:HMDB...``; ``""`` where the value does not begin with HMDB."""
    body = F.upper(F.regexp_replace(strip(x), "^(?i)HMDB:", ""))
    return F.when(body.startswith("HMDB"), F.concat(F.lit("HMDB:"), body)).otherwise(F.lit(""))


def prefixed(x: Column, ns: str) -> Column:
    """One prefix of the name space, in upper case; the value as it is."""
    s = strip(x)
    return F.when(s == "", s).otherwise(F.concat(F.lit(f"{ns}:"), F.regexp_replace(s, f"^(?i){ns}:", "")))


def hmdb_padded(x: Column) -> Column:
    """Number padded to seven digits behind ``HMDB:HMDB``; longer values stay whole."""
    s = strip(x)
    body = F.regexp_replace(s, "^(?i)(HMDB:)?HMDB", "")
    return F.when(s == "", s).otherwise(F.concat(F.lit("HMDB:HMDB"), F.when(F.length(body) < 7, F.lpad(body, 7, "0")).otherwise(body)))


def namespace_of(x: Column) -> Column:
    """What is before the first colon; ``OTHER`` without one."""
    return F.when(F.contains(x, F.lit(":")), F.substring_index(x, ":", 1)).otherwise(F.lit("OTHER"))


def by_prefix(x: Column) -> Column:
    """The normal form of the name space that the id's own prefix names, in any case; ``""`` where there is none."""
    ns = F.upper(F.substring_index(strip(x), ":", 1))
    return (
        F.when(ns.isin("PUBCHEM", "CID"), pubchem(x)).when(ns == "CHEBI", chebi(x)).when(ns == "HMDB", hmdb(x)).when(ns == "KEGG", prefixed(x, "KEGG")).when(ns == "MESH", prefixed(x, "MESH")).otherwise(F.lit(""))
    )


def packed(text: Column) -> Column:
    """A map from ``key=value|key=value`` text."""
    return F.str_to_map(text, F.lit("[|]"), F.lit("="))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share as text, ``-`` where there is nothing to divide by."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit("-")).otherwise(F.concat(F.format_number(100 * part / whole, digits), F.lit("%")))
