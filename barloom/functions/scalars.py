"""Scalar column functions: clipping, calendars, months, positions, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.config import CLIP


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    """True for a number; False for NaN, infinities and NULL."""
    x = _c(x).cast("double")
    return F.coalesce(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))


def clip_finite(x: Column | str, bound: float = CLIP) -> Column:
    """Clamp finite values; NaN, infinities and NULL come out as NaN, never as a bound."""
    x = _c(x)
    return F.coalesce(F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)) + x * F.lit(0.0), F.lit(float("nan")))


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """Logarithm of a / b; NaN where either is not positive, NULL where either is NULL."""
    a, b = _c(a), _c(b)
    return F.when((a > 0) & (b > 0), F.log(F.try_divide(a, b))).when(a.isNotNull() & b.isNotNull(), F.lit(float("nan")))


def date_to_ms(date: Column | str) -> Column:
    return F.unix_date(F.to_date(_c(date), "yyyy-MM-dd")).cast("long") * 86_400_000


def ms_to_date(ms: Column | str) -> Column:
    """UTC date as text, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(_c(ms) / 86_400_000).cast("int")).cast("string")


def ms_to_month(ms: Column | str) -> Column:
    return F.substring(ms_to_date(ms), 1, 7)


def months_between(start: Column | str, end: Column | str) -> Column:
    """Array of months (yyyy-MM) whose first day lies before the exclusive end date."""
    first = F.trunc(_c(start).cast("date"), "MM")
    stop = _c(end).cast("date")
    months = F.filter(F.sequence(first, F.greatest(first, stop), F.expr("interval 1 month")), lambda d: d < stop)
    return F.transform(months, lambda d: F.date_format(d, "yyyy-MM"))


def shift_month(period: Column | str, k: int | Column) -> Column:
    """yyyy-MM moved by k months."""
    day = F.to_date(F.concat(_c(period), F.lit("-01")))
    return F.date_format(F.add_months(day, k), "yyyy-MM")


def month_index(period: Column | str) -> Column:
    p = _c(period)
    return F.substring(p, 1, 4).cast("int") * 12 + F.substring(p, 6, 2).cast("int") - 1


def calendar_keys(ms: Column | str) -> dict[str, Column]:
    """Minute of day, hour, weekday (Monday 0), day of month and month, the last two from 0."""
    t = F.timestamp_millis(_c(ms))
    return {
        "minute_of_day": F.hour(t) * 60 + F.minute(t), "hour": F.hour(t), "dow": F.weekday(t),
        "dom": F.dayofmonth(t) - 1, "month": F.month(t) - 1,
    }


def parse_timestamp_ms(text: Column | str) -> Column:
    """Epoch milliseconds from a number of any usual magnitude or an ISO time; NULL if neither.

    A naive time is UTC; an explicit offset is honoured.
    """
    raw = F.trim(_c(text))
    number = raw.try_cast("double")
    size = F.abs(number)
    millis = (F.when(size > 1e17, number / 1e6).when(size > 1e14, number / 1e3)
              .when(size > 1e11, number).otherwise(number * 1e3))
    return F.when(number.isNotNull(), F.when(is_finite(number), millis.cast("bigint"))).otherwise(
        F.unix_millis(raw.try_cast("timestamp")))
