"""Row change capture, an outbox, and incrementally maintained aggregates on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S
from pyspark.sql.streaming.query import StreamingQuery

from quern.sources.tables import replace_table


def changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., op, old, new): rows that differ between two states of a table."""
    rest = [c for c in before.columns if c not in key]
    a = before.select(*key, S.struct(*rest).alias("old"))
    b = after.select(*[S.col(k).alias(f"__{k}") for k in key], S.struct(*rest).alias("new"))
    both = a.join(b, [S.col(k).eqNullSafe(S.col(f"__{k}")) for k in key], "full_outer")
    op = S.when(S.col("old").isNull(), "insert").when(S.col("new").isNull(), "delete").when(~S.col("old").eqNullSafe(S.col("new")), "update")
    return both.select(*[S.coalesce(k, f"__{k}").alias(k) for k in key], op.alias("op"), "old", "new").where("op IS NOT NULL")


def outbox_rows(changed: DataFrame, topic: str, key: Sequence[str]) -> DataFrame:
    """Change rows as outbox entries: topic, key, payload and an id that repeats for a repeat."""
    payload = S.to_json(S.struct("op", "old", "new"), {"ignoreNullFields": "false"})
    k = S.to_json(S.struct(*key))
    return changed.select(S.lit(topic).alias("topic"), k.alias("key"), payload.alias("payload"), S.sha2(S.concat_ws("|", S.lit(topic), k, payload), 256).alias("id"))


def enqueue(rows: DataFrame, path: str) -> None:
    """Append entries to an outbox folder."""
    rows.withColumn("at", S.current_timestamp()).write.mode("append").parquet(path)


def relay(spark: Any, path: str, schema: Any, deliver: Callable[[DataFrame, int], None], checkpoint: str, window: str = "1 day", once: bool = True, sinks: dict[str, Callable[[DataFrame, int], None]] | None = None) -> StreamingQuery:
    """Deliver outbox entries at least once, each id once within the window.

    A batch whose delivery raises is run again from the checkpoint.  ``sinks``
    routes topics to deliveries of their own."""
    stream = spark.readStream.schema(schema).parquet(path).withWatermark("at", window).dropDuplicatesWithinWatermark(["id"])

    def each(batch: DataFrame, number: int) -> None:
        routed = sinks or {}
        for topic, sink in routed.items():
            sink(batch.where(S.col("topic") == topic), number)
        deliver(batch.where(~S.col("topic").isin(list(routed))) if routed else batch, number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_kafka(servers: str) -> Callable[[DataFrame, int], None]:
    """A delivery to Kafka; its connector must be on the classpath."""

    def deliver(batch: DataFrame, _: int) -> None:
        batch.selectExpr("topic", "key", "payload AS value").write.format("kafka").option("kafka.bootstrap.servers", servers).save()

    return deliver


def maintained(
    stream: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], name: str, checkpoint: str | None = None, mode: str = "complete", path: str | None = None,
) -> StreamingQuery:
    """A materialised aggregate kept up to date as rows arrive.

    With ``path`` each batch's whole result takes the place of the stored table there;
    without it the result is a table in the driver's memory, for small results only."""
    writer = stream.groupBy(*keys).agg(*aggregates).writeStream.outputMode(mode)
    if path is None:
        writer = writer.format("memory").queryName(name)
    else:
        if mode != "complete":
            raise ValueError("a stored aggregate is replaced whole, so its mode is complete")
        writer = writer.queryName(name).foreachBatch(lambda batch, _: replace_table(batch, path))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
