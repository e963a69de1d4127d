"""Time helpers. All instants are ``timestamp_ntz`` read as UTC wall-clock time.

Working on NTZ values keeps every result independent of the session time zone: no
function here converts to or from the session zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsdeck.constants import MONTH_NAMES, WEEKDAY_NAMES


def as_of_lit(as_of: str | _dt.datetime) -> Column:
    """The report's "now" as a timestamp_ntz literal (an explicit parameter, never the clock)."""
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast("timestamp_ntz")


_OFFSET = r"([+-])(\d{2}):?(\d{2})$"


def parse_iso(text: Column) -> Column:
    """ISO-8601 text -> UTC wall-clock timestamp_ntz; null if unreadable.

    Accepts milliseconds or not, and a ``Z`` suffix or a numeric offset (``+01:00``,
    ``-0800``), which is subtracted to give UTC. The arithmetic is on the NTZ value, so no
    session time zone is involved.
    """
    wall = text.try_cast("timestamp_ntz")
    sign = F.when(F.regexp_extract(text, _OFFSET, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    minutes = (F.regexp_extract(text, _OFFSET, 2).cast("int") * 60
               + F.regexp_extract(text, _OFFSET, 3).cast("int")) * sign
    return F.when(text.rlike(_OFFSET), wall - F.make_dt_interval(F.lit(0), F.lit(0), minutes)).otherwise(wall)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days elapsed from ``start`` to ``end``, truncated toward zero (negative when end < start)."""
    return F.timestamp_diff("DAY", start, end)


def calendar_days(start: Column, end: Column) -> Column:
    """Difference of the calendar dates of two instants."""
    return F.datediff(F.to_date(end), F.to_date(start))


def add_hours(ts: Column, hours: Column) -> Column:
    """Instant plus a (possibly fractional) number of hours, at microsecond precision."""
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                   (hours.cast("double") * 3600).cast("decimal(18,6)"))


def _wall_clock(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.ffffff]``: the NTZ value as text (no time-zone conversion)."""
    return ts.cast("timestamp_ntz").cast("string")


def iso_z(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` text (seconds precision, fraction dropped)."""
    text = _wall_clock(ts)
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z"))


def iso_z_millis(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` text, the cloud API's launch-time form."""
    text = _wall_clock(ts)
    millis = F.rpad(F.substring(text, 21, 3), 3, "0")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), millis, F.lit("Z"))


def weekday_name(ts: Column, short: bool = False) -> Column:
    names = F.array(*[F.lit(n[:3] if short else n) for n in WEEKDAY_NAMES])
    return F.element_at(names, F.dayofweek(ts))


def month_name(ts: Column, short: bool = False) -> Column:
    names = F.array(*[F.lit(n[:3] if short else n) for n in MONTH_NAMES])
    return F.element_at(names, F.month(ts))


def created_display(ts: Column) -> Column:
    """``Tue  6 Feb, 12:14 pm``: short weekday, space-padded day, short month, 24-hour time, am/pm."""
    ampm = F.when(F.hour(ts) < 12, F.lit("am")).otherwise(F.lit("pm"))
    return _unless_null(ts, F.format_string("%s %2d %s, %02d:%02d %s", weekday_name(ts, short=True),
                                            F.dayofmonth(ts), month_name(ts, short=True), F.hour(ts),
                                            F.minute(ts), ampm))


def ordinal(n: Column) -> Column:
    """1st 2nd 3rd 4th ... 11th 12th 13th ... 21st 22nd 23rd."""
    last_two = n % 100
    last = n % 10
    suffix = (F.when(last_two.between(11, 13), F.lit("th"))
              .when(last == 1, F.lit("st")).when(last == 2, F.lit("nd")).when(last == 3, F.lit("rd"))
              .otherwise(F.lit("th")))
    return F.concat(n.cast("string"), suffix)


def expiry_phrase(ts: Column) -> Column:
    """``Friday 3rd of August``: full weekday, ordinal month day, full month."""
    return _unless_null(ts, F.concat_ws(" ", weekday_name(ts), ordinal(F.dayofmonth(ts)), F.lit("of"),
                                        month_name(ts)))


def _unless_null(value: Column, rendered: Column) -> Column:
    """``format_string`` prints nulls as the text "null"; keep a null input null instead."""
    return F.when(value.isNotNull(), rendered)
