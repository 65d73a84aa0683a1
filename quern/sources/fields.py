"""Field types: the Spark type of each declared field and what a written value must satisfy."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S

# Formats of validated text.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^[a-z][a-z0-9+.-]*://[^\s/?#]+\S*$",
    "slug": r"^[A-Za-z0-9_-]+$",
    "phone": r"^\+?[0-9][0-9 ().-]{5,}[0-9]$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "ipv4": r"^\d{1,3}(\.\d{1,3}){3}$",
    "cidr": r"^\d{1,3}(\.\d{1,3}){3}/\d{1,2}$",
    "mac": r"^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$",
    "ltree": r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*$",
}


@dataclass(frozen=True)
class Field:
    """A column's Spark type with limits, choices, a format and nullability."""

    type: str
    null: bool = False
    low: Any = None
    high: Any = None
    max_length: int | None = None
    choices: tuple = ()
    format: str | None = None
    generated: str | None = None

    def valid(self, c: Column) -> Column:
        """Whether a value may be written."""
        ok = S.lit(True)
        if self.low is not None:
            ok = ok & (c >= self.low)
        if self.high is not None:
            ok = ok & (c <= self.high)
        if self.max_length is not None:
            ok = ok & (S.length(c) <= self.max_length)
        if self.choices:
            ok = ok & c.isin(list(self.choices))
        if self.format:
            ok = ok & c.rlike(FORMATS[self.format])
        return S.when(c.isNull(), S.lit(self.null)).otherwise(ok)


# Bounds of the integer kinds.
INTEGERS = {"SmallInt": ("smallint", 15), "Int": ("int", 31), "BigInt": ("bigint", 63), "Int8": ("tinyint", 7)}
UNSIGNED = {"UInt8": ("smallint", 8), "UInt16": ("int", 16), "UInt32": ("bigint", 32), "UInt64": ("decimal(20,0)", 64), "UInt128": ("decimal(38,0)", None), "Int128": ("decimal(38,0)", None), "Int256": ("decimal(38,0)", None), "UInt256": ("decimal(38,0)", None)}


def integer(kind: str, positive: bool = False, **kw: Any) -> Field:
    if kind in INTEGERS:
        return Field(INTEGERS[kind][0], low=0 if positive else None, **kw)
    type_, bits = UNSIGNED[kind]
    return Field(type_, low=0 if kind.startswith("U") or positive else None, high=None if bits in (None, 64) else 2**bits - 1, **kw)


def decimal(digits: int, places: int, **kw: Any) -> Field: return Field(f"decimal({digits},{places})", **kw)
def text(max_length: int | None = None, **kw: Any) -> Field: return Field("string", max_length=max_length, **kw)
def formatted(kind: str, **kw: Any) -> Field: return Field("string", format=kind, **kw)
def enum(*choices: Any, **kw: Any) -> Field: return Field("string" if isinstance(choices[0], str) else "smallint", choices=choices, **kw)
def array(item: Field, **kw: Any) -> Field: return Field(f"array<{item.type}>", **kw)
def map_of(key: Field, value: Field, **kw: Any) -> Field: return Field(f"map<{key.type},{value.type}>", **kw)
def record(**parts: Field) -> Field: return Field("struct<" + ",".join(f"{n}:{f.type}" for n, f in parts.items()) + ">")
def nested(**parts: Field) -> Field: return Field(f"array<{record(**parts).type}>")
def range_of(item: Field, **kw: Any) -> Field: return Field(f"struct<lower:{item.type},upper:{item.type},lower_inc:boolean,upper_inc:boolean>", **kw)
def multirange_of(item: Field, **kw: Any) -> Field: return Field(f"array<{range_of(item).type}>", **kw)
def vector(**kw: Any) -> Field: return Field("array<float>", **kw)
def generated(type_: str, sql: str) -> Field: return Field(type_, null=True, generated=sql)


#: Kinds that are a Spark type and no more.
PLAIN = {
    "Float": "double", "Float32": "float", "Boolean": "boolean", "Date": "date", "Datetime": "timestamp", "NaiveDatetime": "timestamp_ntz", "Time": "time",
    "TimeDelta": "interval day to second", "Interval": "interval year to month", "Binary": "binary", "JSON": "string", "Variant": "variant", "Dynamic": "variant",
    "Geometry": "string", "HStore": "map<string,string>", "Citext": "string collate UTF8_LCASE", "TSVector": "array<string>", "EncryptedText": "binary", "BlindIndex": "string",
}


@dataclass
class Schema:
    """The fields of a table by column."""

    fields: dict[str, Field] = field(default_factory=dict)

    def ddl(self) -> str:
        return ", ".join(f"`{n}` {f.type}" + ("" if f.null else " NOT NULL") for n, f in self.fields.items())

    def completed(self, df: DataFrame) -> DataFrame:
        """Cast to the declared types, with generated columns computed."""
        out = df.select(*[S.col(n).cast(f.type).alias(n) for n, f in self.fields.items() if not f.generated])
        return out.withColumns({n: S.expr(f.generated).cast(f.type) for n, f in self.fields.items() if f.generated}).select(*self.fields)

    def rejected(self, df: DataFrame) -> DataFrame:
        """Rows that may not be written, with the first column at fault."""
        fault = None
        for n, f in self.fields.items():
            bad = ~S.coalesce(f.valid(S.col(n)), S.lit(False))
            fault = S.when(bad, n) if fault is None else fault.when(bad, n)
        return df.withColumn("fault", fault).where("fault IS NOT NULL")

    def checked(self, df: DataFrame) -> DataFrame:
        """The rows; a write of one that is not valid fails with its column's name."""
        for n, f in self.fields.items():
            ok = S.coalesce(f.valid(S.col(n)), S.lit(False))
            df = df.withColumn(n, S.when(ok, S.col(n)).otherwise(S.raise_error(S.lit(f"{n} is not valid"))))
        return df
