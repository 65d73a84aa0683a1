"""Window functions; aggregates go over windows as they are."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as S

from quern.operators.expressions import QueryError, WindowFunction

MOST = 2**31 - 1


def RowNumber() -> WindowFunction: return WindowFunction("row_number", S.row_number)
def Rank() -> WindowFunction: return WindowFunction("rank", S.rank)
def DenseRank() -> WindowFunction: return WindowFunction("dense_rank", S.dense_rank)
def CumeDist() -> WindowFunction: return WindowFunction("cume_dist", S.cume_dist)
def PercentRank() -> WindowFunction: return WindowFunction("percent_rank", S.percent_rank)


def _whole(n: int, least: int, what: str) -> int:
    if not isinstance(n, int) or not least <= n <= MOST:
        raise QueryError(f"{what} must be an integer from {least} to {MOST}")
    return n


def NTile(buckets: int) -> WindowFunction: return WindowFunction("ntile", lambda: S.ntile(_whole(buckets, 1, "buckets")))
def Lag(x: Any, offset: int = 1, default: Any = None) -> WindowFunction: return WindowFunction("lag", lambda c: S.lag(c, _whole(offset, 0, "offset"), default), x)
def Lead(x: Any, offset: int = 1, default: Any = None) -> WindowFunction: return WindowFunction("lead", lambda c: S.lead(c, _whole(offset, 0, "offset"), default), x)
def FirstValue(x: Any) -> WindowFunction: return WindowFunction("first_value", S.first_value, x)
def LastValue(x: Any) -> WindowFunction: return WindowFunction("last_value", S.last_value, x, whole=True)
def NthValue(x: Any, nth: int = 1) -> WindowFunction: return WindowFunction("nth_value", lambda c: S.nth_value(c, _whole(nth, 1, "nth")), x, whole=True)
