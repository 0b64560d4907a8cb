"""Tag and address strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FT_TO_M = 0.3048
STOP_NAMES = ("hall", "building", "center", "centre")
SILHOUETTE_WORDS = ("extend", "extrude", "taller", "wider", "add a wing", "remove the roof", "reshape")


def parse_osm_length(raw: Column) -> Column:
    """Metres of a length tag: 25'6", 82', 82 ft, 20,7 m or bare metres; null if it can't be read."""
    feet = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*'\s*(?:([0-9]+(?:\.[0-9]+)?)\s*\"\s*)?$"
    plain = r"(?i)^\s*([0-9]+(?:[.,][0-9]+)?)\s*(m|metres?|meters?|ft|feet|foot)?\s*$"
    inches = F.coalesce(F.regexp_extract(raw, feet, 2).try_cast("double"), F.lit(0.0))
    value = F.regexp_replace(F.regexp_extract(raw, plain, 1), ",", ".").try_cast("double")
    imperial = F.lower(F.regexp_extract(raw, plain, 2)).isin("ft", "feet", "foot")
    return F.when(raw.rlike(feet), (F.regexp_extract(raw, feet, 1).try_cast("double") + inches / 12.0) * FT_TO_M).when(
        raw.rlike(plain), F.when(imperial, value * FT_TO_M).otherwise(value)
    )


def housenumber(address: Column) -> Column:
    """The first word if it is all digits, else null."""
    first = F.regexp_extract(F.trim(address), r"^([0-9]+)(?:\s|$)", 1)
    return F.when(first != "", first)


def names_match(name: Column, number: Column, address: Column) -> Column:
    """House numbers agree, or the name stands in the address, or all its significant words do."""
    low, where = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.coalesce(address, F.lit("")))
    words = F.filter(F.split(F.replace(low, F.lit(","), F.lit(" ")), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_NAMES))
    by_words = (F.size(words) > 0) & F.forall(words, lambda w: where.contains(w))
    by_number = F.coalesce(housenumber(address) == number, F.lit(False))
    return by_number | ((low != "") & (where != "") & (where.contains(low) | by_words))


def query_name(address: Column) -> Column:
    return F.trim(F.split(address, ",", 2)[0])


def address_tail(address: Column) -> Column:
    return F.trim(F.coalesce(F.try_element_at(F.split(address, ",", 2), F.lit(2)), F.lit("")))


def cache_slug(address: Column) -> Column:
    """Lower case, other than letters and digits to underscores, 48 characters, and eight digits of the hash."""
    return F.concat(F.substring(F.regexp_replace(F.lower(address), "[^a-z0-9]", "_"), 1, 48), F.lit("_"), F.substring(F.sha2(address, 256), 1, 8))


def prompt_problem(prompt: Column) -> Column:
    """Whether an edit prompt asks to change the silhouette."""
    return prompt.rlike("(?i)(" + "|".join(SILHOUETTE_WORDS) + ")")
