"""Cleaning and parsing of trip records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6365.079  # fixed value: km, as the distances are to be


def clean_station(name: Column) -> Column:
    """The station's name without the known recording errors: white space before commas goes
    wholly, double spaces once."""
    name = F.replace(name, F.lit("Lansdown "), F.lit("Lansdowne "))
    name = F.regexp_replace(name, " +,", ",")
    for old, new in (("  ", " "), ("_OLD", ""), (" road", " Road"), (", Haggerston ", ", Haggerston")):
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def seconds_since(text: Column, epoch: str, reversed_date: bool = False) -> Column:
    """Seconds from epoch ('yyyy-MM-dd') to 'dd/MM/yyyy HH:mm' text (or 'yyyy/MM/dd HH:mm'), both UTC; null if it doesn't parse."""
    when = F.try_to_timestamp(F.rtrim(F.regexp_replace(text, r"[\r\n]+$", "")), F.lit("yyyy/MM/dd HH:mm" if reversed_date else "dd/MM/yyyy HH:mm"))
    return F.unix_timestamp(when) - F.unix_timestamp(F.to_timestamp(F.lit(epoch)))


def minutes_since(text: Column, epoch: str, jitter_seed: int | None = None) -> Column:
    """Minutes since epoch; with a seed, plus a share of a minute that the text gives, the same in every run."""
    minutes = seconds_since(text, epoch) / 60.0
    if jitter_seed is None:
        return minutes
    return minutes + F.pmod(F.xxhash64(text, F.lit(jitter_seed)), F.lit(1 << 30)) / float(1 << 30)


def week_of(minutes: Column) -> Column:
    """The middle of the week that a minute falls in."""
    return F.floor(minutes / (24 * 60) / 7) + 0.5


def haversine(lat_1: Column, lon_1: Column, lat_2: Column, lon_2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle distance of places in degrees."""
    lat_1, lon_1, lat_2, lon_2 = map(F.radians, (lat_1, lon_1, lat_2, lon_2))
    h = F.pow(F.sin((lat_1 - lat_2) / 2), 2) + F.cos(lat_1) * F.cos(lat_2) * F.pow(F.sin((lon_1 - lon_2) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
