"""What file names and identifiers say, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The file name without folders and its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def tokens(name: Column) -> Column:
    return F.split(name, "_")


def _first(items: Column, k: int = 1) -> Column:
    return F.try_element_at(items, F.lit(k))


def acquisition_date(name: Column) -> Column:
    """The last token of exactly eight digits, as a date; null if there is none or it is no date."""
    token = _first(F.filter(tokens(name), lambda t: t.rlike("^[0-9]{8}$")), -1)
    return F.to_date(F.try_to_timestamp(token, F.lit("yyyyMMdd")))


def plausible_date(date: Column) -> Column:
    """False for dates before the mission, which come of names whose last eight digits are no date."""
    return date >= F.lit("2018-01-01").cast("date")


def family(name: Column) -> Column:
    """gt1, gt2 or gt3, from the first token that begins so."""
    token = _first(F.filter(tokens(F.lower(name)), lambda t: t.rlike("^gt[123]")))
    return F.substring(token, 1, 3)


def track_number_legacy(name: Column) -> Column:
    """The first token of four digits, else the first four of the first longer run of digits (which may be a date)."""
    exact = _first(F.filter(tokens(name), lambda t: t.rlike("^[0-9]{4}$")))
    runs = F.filter(F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r) >= 4)
    return F.coalesce(exact, F.substring(_first(runs), 1, 4))


def reference_track(name: Column) -> Column:
    """The reference ground track of a granule name: leading digits of its first eight-digit token, else a four-digit one."""
    base = tokens(stem(name))
    eight = F.substring(_first(F.filter(base, lambda t: t.rlike("^[0-9]{8}$"))), 1, 4)
    four = _first(F.filter(base, lambda t: t.rlike("^[0-9]{4}$")))
    loose = F.nullif(F.substring(F.regexp_extract(name, r"[_.\-]([0-9]{8})[_.\-]", 1), 1, 4), F.lit(""))
    looser = F.nullif(F.regexp_extract(name, r"[_.\-]([0-9]{4})[_.\-]", 1), F.lit(""))
    return F.lpad(F.coalesce(eight, four, loose, looser), 4, "0")


def granule_date(name: Column) -> Column:
    """Date digits of a granule name: the part after the product, or the first dated run."""
    second = F.try_element_at(tokens(name), F.lit(2))
    loose = F.nullif(F.regexp_extract(name, r"_([0-9]{8})(?:[0-9]{6})?_([0-9]{4})", 1), F.lit(""))
    return F.when(second.rlike("^[0-9]{8}"), F.substring(second, 1, 8)).otherwise(loose)


def granule_track(name: Column) -> Column:
    """Track digits of a granule name: the part after the date, or what follows the first dated run."""
    third = F.try_element_at(tokens(name), F.lit(3))
    loose = F.nullif(F.regexp_extract(name, r"_([0-9]{8})(?:[0-9]{6})?_([0-9]{4})", 2), F.lit(""))
    return F.when(third.rlike("^[0-9]{4}"), F.substring(third, 1, 4)).otherwise(loose)


def old_name(name: Column) -> Column:
    """struct(day, track) of names with a prefix before the product, by position: digits of the third part and of the fourth."""
    part = lambda k, n: F.substring(F.try_element_at(tokens(name), F.lit(k)), 1, n)
    return F.struct(part(3, 8).alias("day"), part(4, 4).alias("track"))


def beam_file(name: Column) -> Column:
    """struct(track_id, gt, acq_date) of a name like ATL06_0129_gt1l_20190105; null if it is not so made."""
    pattern = r"ATL06_([0-9]{4})_(gt[123][lr])_([0-9]{8})"
    group = lambda k: F.regexp_extract(name, pattern, k)
    day = F.to_date(F.try_to_timestamp(group(3), F.lit("yyyyMMdd")))
    return F.when(name.rlike(pattern), F.struct(group(1).alias("track_id"), group(2).alias("gt"), day.alias("acq_date")))


def track_normalised(track: Column) -> Column:
    """Four digits at least for whole numbers, the text as it is otherwise."""
    number = track.try_cast("int").cast("string")
    return F.coalesce(F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0")), track.cast("string"))


def key_text(value: Column) -> Column:
    """An identifier as trimmed text; null stays null."""
    return F.trim(value.cast("string"))


def regression_flag(value: Column) -> Column:
    """True, False or Missing, of a flag that came through text."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("1", "true", "1.0"), "True").when(low.isin("0", "false", "0.0"), "False").when(value.isNull(), "Missing").otherwise(value.cast("string"))
