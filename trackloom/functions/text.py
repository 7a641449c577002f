"""String rules of the command line, the model folder and the progress messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_list(text: Column) -> Column:
    """Comma-separated names, trimmed, in lower case, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.lower(F.trim(s))), lambda s: s != "")


def class_names(by_id: Column) -> Column:
    """Names of a map from id to name: in order of number where every id is one, otherwise in order of text."""
    entries = F.map_entries(by_id)
    numbers = F.forall(entries, lambda e: e["key"].rlike("^[0-9]+$"))
    key = lambda e: F.when(numbers, e["key"].cast("long")).otherwise(F.lit(0))
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct(key(e).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.transform(ranked, lambda e: e["v"])


def default_blur(wanted: Column, known: Column) -> Column:
    """Wanted classes that are known, compared in lower case."""
    low = lambda a: F.transform(a, lambda s: F.lower(F.trim(s)))
    return F.array_intersect(low(wanted), low(known))


def input_size(name: Column, default: int = 640) -> Column:
    """Size that a model file's name starts with, rounded up to a multiple of 32."""
    digits = F.regexp_extract(name, r"^(\d+)", 1)
    return F.when(digits == "", F.lit(default)).otherwise((F.ceil(digits.cast("double") / 32) * 32).cast("int"))


def blurred_name(path: Column) -> Column:
    """``<stem>_blurred<suffix>``"""
    return F.regexp_replace(path, r"^(.*?)(\.[^./]*)?$", "$1_blurred$2")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def cache_key(params: Column) -> Column:
    """One string for a map of parameters, whatever their order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def eta(seconds: Column) -> Column:
    """``H:MM:SS`` of whole seconds; ``0:00`` where none are left or known."""
    s = seconds.cast("long")
    shown = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(seconds > 0, shown).otherwise(F.lit("0:00"))


def progress_message(prefix: Column, rate: Column, units_left: Column) -> Column:
    """Prefix and rate, and the time left where the units left are known."""
    left = F.when(rate > 0, units_left / rate).otherwise(F.lit(0.0))
    return F.concat_ws(" | ", prefix, F.format_string("%.2ffps", rate), F.when(units_left >= 0, F.concat(F.lit("eta "), eta(left))))
