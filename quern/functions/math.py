"""Numeric functions.  Results keep the argument's kind where the function does."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.functions.text import literal
from quern.operators.expressions import Call, Expression


def _one(name: str, build: Any) -> Any:
    return lambda x: Call(name, build, x)


Abs, Sign, Sqrt, Exp, Ln = _one("abs", S.abs), _one("sign", S.signum), _one("sqrt", S.sqrt), _one("exp", S.exp), _one("ln", S.ln)
Ceil, Floor = _one("ceil", lambda c: S.ceil(c).cast("double")), _one("floor", lambda c: S.floor(c).cast("double"))
Sin, Cos, Tan, Cot = _one("sin", S.sin), _one("cos", S.cos), _one("tan", S.tan), _one("cot", S.cot)
ASin, ACos, ATan = _one("asin", S.asin), _one("acos", S.acos), _one("atan", S.atan)
Degrees, Radians = _one("degrees", S.degrees), _one("radians", S.radians)


def ATan2(y: Any, x: Any) -> Expression: return Call("atan2", S.atan2, y, x)
def Power(x: Any, n: Any) -> Expression: return Call("power", S.pow, x, n)
def Log(base: Any, x: Any) -> Expression: return Call("log", lambda b, c: S.ln(c) / S.ln(b), base, x)
def Mod(x: Any, y: Any) -> Expression: return Call("mod", lambda a, b: a % b, x, y)
def Pi() -> Expression: return Call("pi", S.pi)
def Random(seed: int | None = None) -> Expression: return Call("random", lambda: S.rand(seed))
def Round(x: Any, digits: int = 0) -> Expression: return Call("round", lambda c: S.round(c, digits), x)


def IntDiv(x: Any, y: Any) -> Expression:
    """Integer division that truncates towards zero."""
    return Call("div", lambda a, b: S.call_function("div", a, b), x, literal(y) if not isinstance(y, str) else y)


def decimal(c: Column, scale: int) -> Column:
    return c.cast(f"decimal(38,{scale})")
