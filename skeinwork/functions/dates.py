"""Points in time as text: ISO 8601 in UTC with microseconds and a Z, which sorts as the times do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_iso(at: Column) -> Column:
    """A timestamp (without zone: taken as UTC) as text."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def now_iso() -> Column:
    return to_iso(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def from_iso(text: Column) -> Column:
    """The timestamp without zone of such a text; null for any other."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"), F.try_to_timestamp(F.rtrim(text, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).cast("timestamp_ntz"))


def civil(days: Column) -> Column:
    """The date so many days after the first of 1970."""
    return F.date_from_unix_date(days.cast("int"))
