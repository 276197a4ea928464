"""Event-time buckets: hour, day, Monday-first week, month, year; all in UTC, whatever the session's time zone."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("hourly", "daily", "weekly", "monthly", "yearly")
DEFAULT = "default"


def _utc(ms: Column) -> Column:
    return F.timestamp_seconds(F.floor(ms / 1000)).cast("timestamp")


def bucket_name(ms: Column, granularity: str = "hourly") -> Column:
    """A bucket's name; `default` without a positive time; anything unknown counts as yearly. The session runs in UTC."""
    t = _utc(ms)
    if granularity == "weekly":
        week = F.floor((F.dayofyear(t) - 1 + 7 - F.weekday(t)) / 7)
        name = F.format_string("%d-W%02d", F.year(t), week.cast("int"))
    else:
        name = F.date_format(t, {"hourly": "yyyy-MM-dd-HH", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM"}.get(granularity, "yyyy"))
    return F.when(ms.isNull() | (ms <= 0), F.lit(DEFAULT)).otherwise(name)


def name_of(ms: int, granularity: str = "hourly") -> str:
    """The same for one time on the driver."""
    if ms <= 0:
        return DEFAULT
    form = {"hourly": "%Y-%m-%d-%H", "daily": "%Y-%m-%d", "weekly": "%Y-W%W", "monthly": "%Y-%m"}.get(granularity, "%Y")
    return datetime.fromtimestamp(ms / 1000, UTC).strftime(form)


def range_of(name: str) -> tuple[int, int] | None:
    """[start, end) in ms of a bucket; None for `default` and names that aren't buckets."""
    at = lambda *x: datetime(*x, tzinfo=UTC)
    n = [int(x) for x in re.findall(r"\d+", name)]
    if re.fullmatch(r"\d{4}-W\d\d", name):
        first = at(n[0], 1, 1)
        monday = first + timedelta((7 - first.weekday()) % 7)
        start = first if n[1] == 0 else monday + timedelta(7 * (n[1] - 1))
        end = min(monday + timedelta(7 * n[1]), at(n[0] + 1, 1, 1))
    elif re.fullmatch(r"\d{4}-\d\d-\d\d-\d\d", name):
        start = at(*n)
        end = start + timedelta(hours=1)
    elif re.fullmatch(r"\d{4}-\d\d-\d\d", name):
        start = at(*n)
        end = start + timedelta(1)
    elif re.fullmatch(r"\d{4}-\d\d", name):
        start = at(*n, 1)
        end = at(n[0] + n[1] // 12, n[1] % 12 + 1, 1)
    elif re.fullmatch(r"\d{4}", name):
        start, end = at(n[0], 1, 1), at(n[0] + 1, 1, 1)
    else:
        return None
    ms = lambda t: int(t.timestamp() * 1000)
    return ms(start), ms(end)


def _ms(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000


def bucket_start(name: Column) -> Column:
    """The first ms of a bucket by its name, null where there is none."""
    year = F.substring(name, 1, 4)
    first = F.to_date(F.concat(year, F.lit("-01-01")))
    week = F.substring(name, 7, 2).cast("int")
    monday = F.date_add(first, F.pmod(7 - F.weekday(first), F.lit(7)).cast("int"))
    return (
        F.when(name.rlike(r"^\d{4}-W\d\d$"), _ms(F.when(week == 0, first).otherwise(F.date_add(monday, (week - 1) * 7))))
        .when(name.rlike(r"^\d{4}-\d\d-\d\d-\d\d$"), _ms(F.to_date(F.substring(name, 1, 10))) + F.substring(name, 12, 2).cast("long") * 3_600_000)
        .when(name.rlike(r"^\d{4}-\d\d-\d\d$"), _ms(F.to_date(name)))
        .when(name.rlike(r"^\d{4}-\d\d$"), _ms(F.to_date(F.concat(name, F.lit("-01")))))
        .when(name.rlike(r"^\d{4}$"), _ms(first))
    )


def bucket_end(name: Column) -> Column:
    """The first ms after a bucket."""
    year = F.substring(name, 1, 4)
    first = F.to_date(F.concat(year, F.lit("-01-01")))
    after = F.add_months(first, 12)
    monday = F.date_add(first, F.pmod(7 - F.weekday(first), F.lit(7)).cast("int"))
    return (
        F.when(name.rlike(r"^\d{4}-W\d\d$"), F.least(_ms(F.date_add(monday, F.substring(name, 7, 2).cast("int") * 7)), _ms(after)))
        .when(name.rlike(r"^\d{4}-\d\d-\d\d-\d\d$"), bucket_start(name) + 3_600_000)
        .when(name.rlike(r"^\d{4}-\d\d-\d\d$"), bucket_start(name) + 86_400_000)
        .when(name.rlike(r"^\d{4}-\d\d$"), _ms(F.add_months(F.to_date(F.concat(name, F.lit("-01"))), 1)))
        .when(name.rlike(r"^\d{4}$"), _ms(after))
    )
