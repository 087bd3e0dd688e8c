"""Scalar expressions: great-circle distance, clock times, flight statuses, designators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points given in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def hhmm_minutes(text: Column) -> Column:
    """Minutes of a HHMM text; null if it is none."""
    ok = F.coalesce(text.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$"), F.lit(False))
    return F.when(ok, F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 3, 2).try_cast("int"))


def clock_minutes(text: Column) -> Column:
    """Minutes of four digits read as hours and minutes, beyond a day too; null if the text is none."""
    return F.when(F.length(text) == 4, F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 3, 2).try_cast("int"))


def effective_date(text: Column) -> Column:
    """Date of a DDMMMYY text, months in any case; years 70 to 99 are of the last century. Null if it is none."""
    ok = F.coalesce(text.rlike("(?i)^[0-9]{2}[a-z]{3}[0-9]{2}$"), F.lit(False))
    year = F.concat(F.when(F.substring(text, 6, 2).try_cast("int") >= 70, "19").otherwise("20"), F.substring(text, 6, 2))
    return F.when(ok, F.try_to_timestamp(F.concat(F.substring(text, 1, 2), F.initcap(F.substring(text, 3, 3)), year), F.lit("ddMMMyyyy")).cast("date"))


def is_codeshare(company: Column, number: Column, op_company: Column, op_number: Column, duplicates: Column) -> Column:
    """Whether a flight has another designator than its operating one."""
    return (F.coalesce(F.size(duplicates), F.lit(0)) > 0) | ~company.eqNullSafe(op_company) | ~number.eqNullSafe(op_number)


def minutes_hhmm(minutes: Column) -> Column:
    """HHMM of minutes of a day; null outside it."""
    return F.when(minutes.between(0, 1439), F.format_string("%02d%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")))


def day_variation(code: Column) -> Column:
    """Days of a date-variation byte: blank or 0 is 0, digits count, A and J are the day before, others null."""
    c = F.trim(F.coalesce(code, F.lit("")))
    return F.when(c.isin("", "0"), 0).when(c.isin("A", "J"), -1).when(c.rlike("^[1-9]$"), c.try_cast("int"))


def chunks(text: Column, width: int, n: int) -> Column:
    """Non-blank trimmed pieces of ``width`` characters."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.trim(F.substring(text, i * width + 1, F.lit(width)))), lambda x: x != "")


def designator(text: Column) -> Column:
    """(company, flight_number, operational_suffix) of an 8-byte designator; null without company or number."""
    t = F.rpad(F.trim(text), 8, " ")
    part = lambda a, n: F.nullif(F.trim(F.substring(t, a, n)), F.lit(""))
    return F.when(part(1, 3).isNotNull() & part(4, 4).isNotNull(), F.struct(part(1, 3).alias("company"), part(4, 4).alias("flight_number"), part(8, 1).alias("operational_suffix")))


def leg_status(country_a: Column, country_b: Column) -> Column:
    """D within one country, I between two, null if one is unknown."""
    return F.when(country_a.isNotNull() & country_b.isNotNull(), F.when(country_a == country_b, "D").otherwise("I"))


def city_key(country: Column, city: Column) -> Column:
    """Normalised country and city; null if either is blank."""
    a, b = F.upper(F.trim(country)), F.upper(F.trim(city))
    return F.when((a != "") & (b != ""), F.concat_ws("|", a, b))
