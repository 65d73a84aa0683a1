"""Parts and truncations of dates and times, and arithmetic on them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression, QueryError


def _part(name: str, build: Any) -> Any:
    return lambda c: build(c).cast("long")


PARTS = {
    "year": _part("year", S.year),
    "iso_year": _part("iso_year", lambda c: S.date_part(S.lit("YEAROFWEEK"), c)),
    "quarter": _part("quarter", S.quarter),
    "month": _part("month", S.month),
    "week": _part("week", S.weekofyear),
    "week_day": _part("week_day", S.dayofweek),
    "iso_week_day": _part("iso_week_day", lambda c: S.weekday(c) + 1),
    "day": _part("day", S.dayofmonth),
    "hour": _part("hour", S.hour),
    "minute": _part("minute", S.minute),
    "second": _part("second", S.second),
    "microsecond": _part("microsecond", lambda c: S.pmod(S.unix_micros(c.cast("timestamp")), S.lit(1_000_000))),
    "date": lambda c: S.to_date(c),
    "time": lambda c: c.cast("time"),
}
KINDS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def _zoned(c: Column, zone: str | None) -> Column:
    return c if zone is None else S.from_utc_timestamp(c, zone)


def trunc(c: Column, kind: str) -> Column:
    if kind not in KINDS:
        raise QueryError(f"unknown truncation {kind!r}")
    return S.date_trunc(kind, c)


def Extract(x: Any, part: str, zone: str | None = None) -> Expression:
    """An integer part of a date or time, in a zone if one is named."""
    if part not in PARTS:
        raise QueryError(f"unknown part {part!r}")
    return Call(f"extract_{part}", lambda c: PARTS[part](_zoned(c, zone)), x)


def Trunc(x: Any, kind: str, zone: str | None = None) -> Expression:
    return Call(f"trunc_{kind}", lambda c: trunc(_zoned(c, zone), kind), x)


def _extract(part: str) -> Any:
    return lambda x, zone=None: Extract(x, part, zone)


def _trunc(kind: str) -> Any:
    return lambda x, zone=None: Trunc(x, kind, zone)


ExtractYear, ExtractIsoYear, ExtractQuarter, ExtractMonth = map(_extract, ("year", "iso_year", "quarter", "month"))
ExtractWeek, ExtractWeekDay, ExtractIsoWeekDay, ExtractDay = map(_extract, ("week", "week_day", "iso_week_day", "day"))
ExtractHour, ExtractMinute, ExtractSecond, ExtractMicrosecond = map(_extract, ("hour", "minute", "second", "microsecond"))
TruncYear, TruncQuarter, TruncMonth, TruncWeek = map(_trunc, ("year", "quarter", "month", "week"))
TruncDay, TruncHour, TruncMinute, TruncSecond = map(_trunc, ("day", "hour", "minute", "second"))


def TruncDate(x: Any) -> Expression: return Call("trunc_date", S.to_date, x)
def TruncTime(x: Any) -> Expression: return Call("trunc_time", lambda c: c.cast("time"), x)
def Now() -> Expression: return Call("now", S.current_timestamp)


#: A query is its own transaction, and its moment is fixed.
TransactionNow = Now


def Shift(x: Any, days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0, months: int = 0) -> Expression:
    """A moment moved by a duration."""
    def build(c: Column) -> Column:
        if months:
            c = c + S.make_ym_interval(S.lit(0), S.lit(months))
        return c + S.make_dt_interval(S.lit(days), S.lit(hours), S.lit(minutes), S.lit(float(seconds)))
    return Call("shift", build, x)


def Difference(a: Any, b: Any, unit: str = "second") -> Expression:
    """How many whole units lie between b and a."""
    return Call("difference", lambda x, y: S.timestamp_diff(unit.upper(), y, x), a, b)
