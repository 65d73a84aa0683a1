"""Stored tables: dictionaries, partitioned and indexed Parquet, JDBC, and atomic replacement."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as S


class Dictionary:
    """A key to attributes table.  It is broadcast only while its size, as Spark
    estimates it, stays within ``most`` bytes; beyond that it joins by shuffle."""

    def __init__(self, df: DataFrame, key: str, most: int = 64 << 20):
        self.df, self.key, self.most = df, key, most

    def get(self, df: DataFrame, key: str, **attributes: str) -> DataFrame:
        side = self.df.select(S.col(self.key).alias("__key"), *[S.col(a).alias(n) for n, a in attributes.items()])
        size = int(str(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        side = S.broadcast(side) if size <= self.most else side
        return df.join(side, S.col(key) == S.col("__key"), "left").drop("__key")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A scan over JDBC, cut into parts by a numeric column.  The driver's jar must be on the classpath."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_table(
    df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), bloom: tuple[str, ...] = (),
) -> None:
    """Parquet with pruning aids: directories by value, sorted files for min-max
    statistics, and Bloom filters on columns looked up by equality."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return Path, Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame, path: str) -> str:
    """Write a table's new rows beside it; returns where."""
    new = f"{path}.__new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    return new


def swap(spark: SparkSession, path: str, new: str) -> None:
    """Put staged rows in a table's place by two renames.

    A failure between them leaves both folders; the next swap brings the old one
    back first, so no rows are lost."""
    Path, fs = _files(spark, path)
    old = f"{path}.__old"
    if fs.exists(Path(old)) and not fs.exists(Path(path)):
        fs.rename(Path(old), Path(path))
    fs.delete(Path(old), True)
    if fs.exists(Path(path)):
        fs.rename(Path(path), Path(old))
    fs.rename(Path(new), Path(path))
    fs.delete(Path(old), True)
    spark.catalog.refreshByPath(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Rewrite a table from a query that may read it: all new rows are complete before the old ones go."""
    swap(df.sparkSession, path, staged(df, path))


def write_projection(df: DataFrame, path: str, keys: tuple[str, ...] = (), aggregates: tuple[Any, ...] = (), sort_by: tuple[str, ...] = ()) -> None:
    """A second physical form of a table: aggregated by keys, or sorted otherwise."""
    out = df.groupBy(*keys).agg(*aggregates) if aggregates else df
    out = out.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else out
    out.write.mode("overwrite").parquet(path)


class Encrypted:
    """Ciphertext columns with a keyed hash beside them for equality lookups."""

    def __init__(self, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        self.key = S.lit(key)

    def encrypt(self, c: Any) -> Any: return S.aes_encrypt(c, self.key)
    def decrypt(self, c: Any) -> Any: return S.try_aes_decrypt(c, self.key).cast("string")
    def blind_index(self, c: Any) -> Any:
        """Equal texts have equal hashes; without the key they tell nothing."""
        inner = S.sha2(S.concat(self.key, c.cast("binary")), 256)
        return S.sha2(S.concat(self.key, inner.cast("binary")), 256)


def row_values(spark: SparkSession, schema: str, rows: Any) -> DataFrame:
    """Rows given by hand as a table."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def json_row_values(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A row for each object of a column's JSON arrays, typed by name; what doesn't fit is null."""
    return df.select(S.explode(S.from_json(S.col(column), f"array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in schema.split(','))}>>")).alias("__r")).select("__r.*")
