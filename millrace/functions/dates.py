"""Date and time functions as column expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yyyymm(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM").cast("int")


def yyyymmdd(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def iso_week(ts: Column) -> Column:
    """ISO year and week as one integer, as 202653."""
    return (F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts)).cast("int")


def week_start(ts: Column) -> Column:
    """Monday midnight."""
    return F.date_trunc("week", ts)


def month_anchor(day: Column, anchor: Column) -> Column:
    """The last date up to ``day`` with the anchor's day of month, which a short month cuts to its last day."""

    def in_month(first: Column) -> Column:
        return F.date_add(first, F.least(F.dayofmonth(anchor), F.dayofmonth(F.last_day(first))) - 1)

    first = F.trunc(day, "month")
    here = in_month(first)
    return F.when(here <= day, here).otherwise(in_month(F.add_months(first, -1)))


def parse_date(s: Column) -> Column:
    """``dd/MM/yyyy``, ``yyyy-MM-dd`` or ``dd.MM.yyyy`` after trimming, else null."""
    t = F.trim(s)
    return F.coalesce(*[F.try_to_date(t, f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy")])


def day_token(day: Column, anchor: Column, first: Column) -> Column:
    """``[DATE_D0]`` for the anchor itself (where ``first`` holds), else the signed distance in days."""
    n = F.datediff(day, anchor)
    signed = F.concat(F.when(n < 0, "").otherwise("+"), n.cast("string"))
    return F.when(first, F.lit("[DATE_D0]")).otherwise(F.concat(F.lit("[DATE_D"), signed, F.lit("]")))


def epoch_day(s: Column) -> Column:
    """Seconds of a ``yyyy-MM-dd`` midnight, null for anything else."""
    return F.unix_timestamp(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def retry_after(ts: Column) -> Column:
    """Seconds to the next UTC midnight, rounded up."""
    return F.ceil((86_400_000 - F.unix_millis(ts) % 86_400_000) / 1000)


def id_millis(s: Column) -> Column:
    """The time in an id's twelve hexadecimal digits after its prefix."""
    return (F.conv(F.regexp_extract(s, r"_([0-9a-f]{12})", 1), 16, 10).cast("long") / 4096).cast("long")


def duration(seconds: Column) -> Column:
    """As ``3d 4h`` or ``2h 5m`` or ``7m``."""
    d, h, m = F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60)
    return F.when(d > 0, F.format_string("%dd %dh", d, h)).when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def monday_of(week: Column) -> Column:
    """The Monday of a week key as :func:`iso_week` makes them: the week of January 4 is the first."""
    fourth = F.make_date(F.floor(week / 100).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(fourth, F.weekday(fourth)), ((week % 100 - 1) * 7).cast("int"))


def week_bounds(ts: Column) -> tuple[Column, Column]:
    """Monday midnight and the next one."""
    start = F.date_trunc("week", ts)
    return start, start + F.expr("interval 7 days")


def month_bounds(day: Column, anchor: Column) -> tuple[Column, Column]:
    """The month around a day that starts on the anchor's day of month, and the start of the next one."""
    start = month_anchor(day, anchor)
    first = F.trunc(F.add_months(F.trunc(start, "month"), 1), "month")
    return start, F.date_add(first, F.least(F.dayofmonth(anchor), F.dayofmonth(F.last_day(first))) - 1)


def day_cutoff(now: Column, days: int) -> Column:
    """The start of the day for 0 days, else so many times 24 hours ago."""
    return F.date_trunc("day", now) if days == 0 else now - F.expr(f"interval {days * 24} hours")
