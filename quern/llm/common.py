"""Pieces that several operators share: reading, sizing, and packing byte data.

Words everywhere in this subpackage are maximal runs of bytes other than
0x20 and 0x09-0x0D, which is what ``bytes.split()`` returns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from quern.sources.lineage import checkpoint

#: The six white-space characters, as a trim set and as a regular expression.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes(name: str = "text") -> Column:
    """The column's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns of a row; together they tell rows apart."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of a text column, measured in one column-pruned scan."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def parts_for(size: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(size / each))


__all__ = ["SPACES", "SPACES_RE", "checkpoint", "parts_for", "row_keys", "shuffle_partitions", "table", "text_bytes", "total_bytes", "unused"]
