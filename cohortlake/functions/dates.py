"""Deterministic date shifts as columns.

Strict grammar: a date that exists in the calendar, of eight digits or in ISO form, optionally followed
by a time of day to any precision, a fraction and a zone; a month or a year alone, which moves from its
first day and keeps its precision; and a range of two dates, one of which may be open. The dates move,
everything else stays as it is written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_JITTER = (-365, -1)

_HOUR, _MINUTE = "([01][0-9]|2[0-3])", "[0-5][0-9]"
_ZONE = r"([+-][0-9]{4})?"
COMPACT = rf"^[0-9]{{8}}(\.?{_HOUR}({_MINUTE}({_MINUTE}(\.[0-9]{{1,6}})?)?)?)?{_ZONE}$"
ISO = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T]{_HOUR}:{_MINUTE}(:{_MINUTE}(\.[0-9]{{1,6}})?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$"
MONTH, YEAR = rf"^[0-9]{{6}}{_ZONE}$", rf"^[0-9]{{4}}{_ZONE}$"
RANGE = "^([0-9]{8}-[0-9]{8}|[0-9]{8}-|-[0-9]{8})$"


def shift_days(patient_id: Column, low: int = DEFAULT_JITTER[0], high: int = DEFAULT_JITTER[1]) -> Column:
    """Days for a patient: always the same, low..high inclusive (in either order)."""
    low, high = min(low, high), max(low, high)
    seed = F.conv(F.substring(F.sha2(patient_id.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return (seed % F.lit(high - low + 1) + F.lit(low)).cast("int")


def shift_date(date: Column, days: Column) -> Column:
    return F.date_add(date, days)


def shift_text(value: Column, days: Column) -> Column:
    """The shifted text in its own format; null for empty or unreadable values."""
    text = F.trim(value)

    def moved(part: Column, form: str) -> Column:
        return F.date_format(F.date_add(F.try_to_timestamp(part, F.lit(form)).cast("date"), days), form)

    end = F.when(text.endswith("-"), "").otherwise(moved(F.right(text, F.lit(8)), "yyyyMMdd"))
    span = F.concat(F.when(text.startswith("-"), "").otherwise(moved(F.substring(text, 1, 8), "yyyyMMdd")), F.lit("-"), end)
    return (
        F.when(text.rlike(RANGE), span)
        .when(text.rlike(COMPACT), F.concat(moved(F.substring(text, 1, 8), "yyyyMMdd"), F.substring(text, 9, 64)))
        .when(text.rlike(ISO), F.concat(moved(F.substring(text, 1, 10), "yyyy-MM-dd"), F.substring(text, 11, 64)))
        .when(text.rlike(MONTH), F.concat(moved(F.substring(text, 1, 6), "yyyyMM"), F.substring(text, 7, 64)))
        .when(text.rlike(YEAR), F.concat(moved(F.substring(text, 1, 4), "yyyy"), F.substring(text, 5, 64)))
    )


def unreadable(value: Column) -> Column:
    """Whether a date is given that no shift can move."""
    return F.coalesce((F.trim(value) != "") & shift_text(value, F.lit(0)).isNull(), F.lit(False))


def parse_date(value: Column) -> Column:
    """An eight-digit date, or 1900-01-01 if it can't be read."""
    return F.coalesce(F.try_to_timestamp(value, F.lit("yyyyMMdd")).cast("date"), F.to_date(F.lit("1900-01-01")))
