"""Bounds, ages and stamps as users type them."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"\d{4}-\d{2}-\d{2}"


def months_back(day: dt.date, months: int) -> dt.date:
    """The same day some months before, or the last day of a shorter month."""
    at = day.year * 12 + day.month - 1 - months
    year, month = divmod(at, 12)
    for last in (day.day, 30, 29, 28):
        try:
            return dt.date(year, month + 1, min(last, day.day))
        except ValueError:
            continue
    raise AssertionError


def age(text: str, today: dt.date) -> dt.date | None:
    """``3d``, ``2w``, ``1m``, ``1y`` before today, in either case; None if it isn't an age."""
    m = re.fullmatch(r"(\d{1,5})([dwmyDWMY])", text.strip())
    if not m:
        return None
    n, unit = int(m[1]), m[2].lower()
    if unit in "dw":
        return today - dt.timedelta(days=n * (7 if unit == "w" else 1))
    return months_back(today, n * (12 if unit == "y" else 1))


def bound(text: str | None, today: dt.date, end: bool) -> str | None:
    """A bound as ``YYYY-MM-DD HH:MM:SS``: a day from its first or to its last second, a minute likewise."""
    if text is None:
        return None
    day = age(text, today)
    if day is None and re.fullmatch(_DATE, text.strip()):
        day = dt.date.fromisoformat(text.strip())
    if day is not None:
        return f"{day} {'23:59:59' if end else '00:00:00'}"
    m = re.fullmatch(rf"({_DATE})[T ](\d{{2}}:\d{{2}})(:\d{{2}})?", text.strip())
    if not m:
        raise ValueError(f"no date: {text!r}")
    dt.datetime.fromisoformat(f"{m[1]} {m[2]}{m[3] or ''}")
    return f"{m[1]} {m[2]}{m[3] or (':59' if end else ':00')}"


def range_of(low: str | None, high: str | None, today: dt.date) -> tuple[str | None, str | None]:
    a, b = bound(low, today, False), bound(high, today, True)
    if a and b and a > b:
        raise ValueError(f"{low!r} is after {high!r}")
    return a, b


def read_stamp(c: Column) -> Column:
    """A stamp of a date, a minute or a second, with T or space, fraction and Z dropped; else null."""
    s = F.trim(c)
    shape = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.\d+)?Z?)?$"
    part = lambda k, other: F.when(F.regexp_extract(s, shape, k) == "", F.lit(other)).otherwise(F.regexp_extract(s, shape, k))
    return F.when(s.rlike(shape), F.concat(F.regexp_extract(s, shape, 1), F.lit(" "), part(2, "00:00"), part(3, ":00")).try_cast("timestamp_ntz"))


def bounds_of(c: Column) -> tuple[Column, Column]:
    """The first and the last second of a typed day or minute (or the second itself); null if it can't be read."""
    s = F.trim(c)
    day, minute = rf"^({_DATE})$", rf"^({_DATE})[T ](\d{{2}}:\d{{2}})(:\d{{2}})?$"
    part = lambda k: F.regexp_extract(s, minute, k)

    def at(day_time: str, second: str) -> Column:
        text = F.when(s.rlike(day), F.concat(s, F.lit(" " + day_time))).when(s.rlike(minute), F.concat(part(1), F.lit(" "), part(2), F.when(part(3) == "", F.lit(second)).otherwise(part(3))))
        return F.when(text.try_cast("timestamp_ntz").isNotNull(), text)

    return at("00:00:00", ":00"), at("23:59:59", ":59")


def age_of(n: Column, unit: Column, today: str) -> Column:
    """The day ``n`` units (d, w, m, y in either case) before today; a shorter month gives its last day."""
    day, u = F.lit(today).cast("date"), F.lower(unit)
    return F.when(u == "d", F.date_sub(day, n)).when(u == "w", F.date_sub(day, n * 7)).when(u == "m", F.add_months(day, -n)).when(u == "y", F.add_months(day, -n * 12))


def range_state(low: Column, high: Column) -> Column:
    """``ok``, ``reversed`` if low is after high, ``unreadable`` if either is missing: ``range_of`` for whole columns."""
    return F.when(low.isNull() | high.isNull(), "unreadable").when(low > high, "reversed").otherwise("ok")


def before(as_of: str, amount: int, unit: str) -> Column:
    """The moment ``amount`` units before ``as_of``."""
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(amount)} {unit}")


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)
