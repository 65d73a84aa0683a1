"""From raw documents to mixed, sharded training rows, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, quality, sharding, simhash
from quern.llm.common import checkpoint, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps.  Null and empty texts go; equal rows stay or go together."""
    return quality.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The least id stays, a null id last; equal rows and texts without words are one group each.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.  Null and empty texts stay, as all do beside an empty benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.

    Null is a source of its own; null and empty texts weigh nothing; equal rows share their copies.
    """
    return mixing.repeated(docs, mixing.mix(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the size, checksum, shard and slot that a bounded-load ring gives them.

    Null and empty texts have size 1; equal rows get slots of their own.
    """
    return sharding.shard(docs, 8)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Fingerprint groups, the latent search and random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's rows are checkpointed for the next.

    An empty table passes through all stages; extra columns, whatever their names and
    types, stay with their rows, unless they bear the name of one that the last stage adds.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
