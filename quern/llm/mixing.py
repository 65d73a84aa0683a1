"""Mixing sources to target weights by pivotal dependent rounding.

Each document is to be copied target / source size times.  The whole part is
taken; the fraction, as a mass of words, is settled in pairs: mass moves from one
document to the other, in a random direction that keeps both expectations, until
one of them is whole.  A document much larger than those that follow would wander
through many pairs; it is settled at once against as many of them as can take or
give its mass, in shares that keep every expectation too.  Mass is never lost, so a
source misses its target by less than the one document left at the end, a small
one.  Pairs meet first within chunks of a source, then the one residual of each
chunk climbs a reduction tree, so a source with a third of all rows is many
independent tasks.  Equal rows are one row with a count.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACES, SPACES_RE, checkpoint, row_keys, unused

#: Sources up to which their table of targets is broadcast; beyond it joins by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text_col: str = "text") -> Column:
    trimmed = F.btrim(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES_RE))).cast("long")


def by_code_point(source: str | None) -> tuple[bool, str]:
    return source is None, source or ""


def cyclic_weights(sources: Sequence[str | None], cycle: Sequence[float] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last."""
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(sorted(sources, key=by_code_point))}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float = 1.0, cap: float = 3.0) -> dict[str | None, float]:
    """Words for each source: ``share`` of all words by weight, none above ``cap``
    times its size; what is above is shared again among the rest by weight."""
    left, open_, out = share * sum(sizes.values()), dict(sizes), {}
    while open_:
        whole = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / whole > cap * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / whole for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            del open_[s]
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def settle_at_once(j: int, mass: list[float], size: list[float], first: int, draw: Callable[[], float], tiny: float) -> bool:
    """Make document j whole against the documents from ``first`` on, if they can bear it.

    If j is filled, with probability mass / size, each gives up its share; if j is
    emptied, each gets a share so much larger or smaller that its expectation stays.
    """
    wanted = size[j] - mass[j]
    odds = mass[j] / wanted
    shares, found = [], 0.0
    for i in range(first, len(mass)):
        share = min(mass[i], (size[i] - mass[i]) / odds, wanted - found)
        if share > 0:
            shares.append((i, share))
            found += share
            if found >= wanted * (1 - tiny):
                break
    else:
        return False
    fill = draw() * size[j] < mass[j]
    mass[j] = size[j] if fill else 0.0
    for i, share in shares:
        mass[i] += -share if fill else share * odds
    return True


def pivot(mass: list[float], size: list[float], draw: Callable[[], float], tiny: float = 1e-9) -> int | None:
    """Round masses in place to 0 or their size, conserving the sum; the index left over, if any.

    Large documents should come first.
    """

    def whole(k: int) -> bool:
        if tiny * size[k] < mass[k] < (1 - tiny) * size[k]:
            return False
        mass[k] = 0.0 if mass[k] <= 0.5 * size[k] else size[k]
        return True

    carry, stuck = None, None
    for i in range(len(mass)):
        if whole(i):
            continue
        if carry is None:
            carry = i
            continue
        if 2 * size[i] < size[carry] and carry != stuck:
            if settle_at_once(carry, mass, size, i, draw, tiny):
                carry = None if whole(i) else i
                continue
            stuck = carry  # what follows is too little
        j = carry
        to_i = min(size[i] - mass[i], mass[j])
        to_j = min(mass[i], size[j] - mass[j])
        moved = to_i if draw() * (to_i + to_j) < to_j else -to_j
        mass[i] += moved
        mass[j] -= moved
        left = [k for k in (j, i) if not whole(k)]
        carry = left[0] if left else None
    return carry


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weigh: Callable[[Sequence[str | None]], dict[str | None, float]] = cyclic_weights,
    share: float = 1.0, cap: float = 3.0, seed: int = 42, chunk: int = 4096, fan_in: int = 256,
) -> DataFrame:
    """(id, key, key2, source, size, source_size, target, copies, taken) of every document.

    ``key`` and ``key2`` hash all columns of the row.  Random draws depend on the
    seed, the source and the chunk alone, and rows are sorted first, so reruns agree.
    Null and empty texts have size 0, so whatever their copies they take nothing; a source of size 0 has target
    0; null is a source of its own; equal rows are settled as one and share its
    copies as evenly as can be; an empty table gives no rows; extra columns, of any
    type, only enter the keys.
    """
    spark = docs.sparkSession
    key, key2 = row_keys(docs)
    own = ("id", "key", "key2", "source", "size")
    rows = checkpoint(docs.select(
        F.col(id_col).alias("id"), key.alias("key"), key2.alias("key2"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
    ).groupBy(*own).agg(F.count("*").alias("n")))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")), F.count("*")).collect()  # a row for each source
    sizes = {r[0]: int(r[1]) for r in sums}
    goal = targets(sizes, weigh(list(sizes)), share, cap)
    names = [r[0] for r in sums]
    plan = spark.createDataFrame(pa.table({
        "__s": pa.array(names, pa.string()), "source_size": pa.array([sizes[s] for s in names], pa.int64()),
        "target": pa.array([float(goal[s]) for s in names], pa.float64()),
        "rate": pa.array([goal[s] / sizes[s] if sizes[s] else 0.0 for s in names], pa.float64()),
        "chunks": pa.array([-(-r[2] // chunk) for r in sums], pa.int32()),
    }))
    plan = F.broadcast(plan) if len(sums) <= BROADCAST_SOURCES else plan
    times = F.col("rate") * F.col("n")
    start = rows.join(plan, F.col("source").eqNullSafe(F.col("__s"))).select(
        *own, "n", "source_size", "target", F.floor(times).cast("long").alias("base"), ((times - F.floor(times)) * F.col("size")).alias("mass"),
        F.pmod("key", F.col("chunks")).cast("int").alias("chunk"),
    )

    def settle(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            # From large to small, so that what is left over at the end is small.
            group = group.sort_values(["size", "key", "key2"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            source = group["source"].iloc[0]
            rng = random.Random(f"{seed}/{source!r}/{group['chunk'].iloc[0]}/{len(group)}")
            mass, size = group["mass"].tolist(), [float(s) for s in group["size"]]
            left = pivot(mass, size, rng.random)
            if left is not None and last:
                mass[left] = size[left] if rng.random() * size[left] < mass[left] else 0.0
                left = None
            group["mass"] = mass
            group["done"] = [i != left for i in range(len(group))]
            return group

        return run

    schema = f"id {rows.schema['id'].dataType.simpleString()}, key long, key2 long, source string, size long, n long, source_size long, target double, base long, mass double, chunk int, done boolean"
    most = max([1, *(-(-r[2] // chunk) for r in sums)])
    settled, level = None, start
    while True:
        out = checkpoint(level.groupBy("source", "chunk").applyInPandas(settle(most == 1), schema))
        settled = out.where("done") if settled is None else settled.union(out.where("done"))
        if most == 1:
            break
        most = -(-most // fan_in)
        level = out.where("NOT done").drop("done").withColumn("chunk", (F.col("chunk") / fan_in).cast("int") if most > 1 else F.lit(0))
    # Equal rows part again, in two steps, so that no array is long.
    each = settled.withColumn("all", F.col("base") + (F.col("mass") > 0).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    each = each.withColumn("at", F.explode(F.sequence(F.col("block") * chunk, F.least((F.col("block") + 1) * chunk, F.col("n")) - 1)))
    copies = (F.floor(F.col("all") / F.col("n")) + (F.col("at") < F.col("all") % F.col("n")).cast("long")).cast("int")
    return each.select(*own, "source_size", "target", copies.alias("copies")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def repeated(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents, each as often as ``mix`` chose.

    Rows equal in every column are summed; null and empty texts, which weigh nothing,
    come as often as their source's whole copies; an empty table gives no rows;
    columns may have any names and types.
    """
    columns = docs.columns
    k_, l_, n_ = unused(columns, "__k", "__l", "__n")
    times = chosen.groupBy(F.col("key").alias(k_), F.col("key2").alias(l_)).agg(F.sum("copies").alias(n_)).where(F.col(n_) > 0)
    key, key2 = row_keys(docs)
    keyed = docs.withColumn(k_, key).withColumn(l_, key2).dropDuplicates([k_, l_])
    return keyed.join(times, [k_, l_]).withColumn(n_, F.explode(F.sequence(F.lit(1), F.col(n_).cast("int")))).select(*columns)
