"""Timestamps as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(c: Column) -> Column:
    """ISO-8601 of a timestamp_ntz; the fraction is left out if it is zero; null stays null."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def snapshot_id(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss")


def parsed(c: Column) -> Column:
    """timestamp_ntz of ISO text without a zone; anything else, a zone included, gives null."""
    plain = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
    return F.when(c.rlike(plain), F.to_timestamp_ntz(F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" ")))))


def age_days(ts: Column, as_of: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, as_of) / F.lit(86_400e6)
