"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has equal slots; a row's slot is the top bits of a hash of its key, and
each virtual node owns the slots up to the next one.  Loads are summed per slot in
the executors, so the driver sees at most MOST_CELLS rows whatever the input's
size.  A slot goes to the first shard clockwise that still has room, and a full
shard passes it on: no shard exceeds the bound, and a shard that joins takes over
slots mainly from its neighbours.  The bound lies so little above the mean that the
least shard is near it too.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import checkpoint, parts_for, unused

#: Slots on the ring, for few and for many shards.
CELLS, MOST_CELLS = 1 << 14, 1 << 20
#: Slots for each virtual node at least.
CELLS_A_NODE = 4
#: Bytes of text that one task orders.
TASK_BYTES = 64 << 20


def cells_for(shards: int, vnodes: int) -> int:
    """Slots of the ring: a power of two, enough for the virtual nodes."""
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and virtual nodes must be positive")
    cells = max(CELLS, 1 << (CELLS_A_NODE * shards * vnodes - 1).bit_length())
    if cells > MOST_CELLS:
        raise ValueError(f"{shards} shards of {vnodes} virtual nodes need {cells} slots; the ring has {MOST_CELLS} at most")
    return cells


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(slot, shard) of each virtual node, clockwise.  A ring of more slots only has finer ones."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            point = xxhash.xxh64_intdigest(f"{shard}/{v}") * cells >> 64
            at[point] = min(shard, at.get(point, shard))
    return sorted(at.items())


def place(loads: dict[int, int], shards: int, vnodes: int = 128, slack: float = 0.002) -> dict[int, int]:
    """The shard of each slot.  Large slots choose first; each takes the first shard
    clockwise where it fits under the bound.

    The bound is the mean and ``slack`` / (shards - 1) of it more, so that no shard
    lies more than ``slack`` under the mean either.  Where slots are too large to fit
    so tightly, the room over the mean grows by a quarter until they do; with room for
    the largest slot they always do.
    """
    nodes = ring(shards, vnodes, cells_for(shards, vnodes))
    points = [p for p, _ in nodes]
    order = sorted(loads, key=lambda s: (-loads[s], s))
    mean, most = sum(loads.values()) / shards, max(loads.values(), default=0)
    room = slack * mean / max(1, shards - 1)
    while True:
        bound, held, answer = mean + min(room, most), [0] * shards, {}
        for slot in order:
            first, size = bisect_left(points, slot), loads[slot]
            tried: set[int] = set()
            for k in range(first, first + len(nodes)):
                shard = nodes[k % len(nodes)][1]
                if shard in tried:
                    continue
                if held[shard] + size <= bound:
                    held[shard] += size
                    answer[slot] = shard
                    break
                tried.add(shard)
                if len(tried) == shards:
                    break
            if slot not in answer:
                break
        else:
            return answer
        room = max(1.25 * room, 1)


def shard(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 128, slack: float = 0.002,
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Size is the text's UTF-8 bytes plus one; a null text counts as empty and has
    the checksum of no bytes.  The law is ``bytes``: shard sizes are near equal, as
    far as the largest slot allows.  Slots count from 0 without gaps in each shard,
    in ring order.  ``keep`` names the columns to return besides (default: all);
    without the text only narrow rows are shuffled.  A row's place on the ring
    depends on its id and its text, so null ids, or one id with many texts, spread;
    rows equal in both share a place and get slots of their own in the shard; an
    empty table gives no rows; columns named like the new ones are replaced.
    """
    made = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    h_, unit_, base_, n_, id_ = unused(docs.columns, "__h", "__unit", "__base", "__n", "__id")
    cells = cells_for(shards, vnodes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        *kept, F.col(id_col).alias(id_),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn(h_, F.xxhash64(F.col(id_), F.col("text_crc32"), F.col("size")))
    cell = F.shiftrightunsigned(h_, 64 - (cells.bit_length() - 1)).cast("int")
    loads = {r[0]: (r[1], r[2]) for r in sized.groupBy(cell).agg(F.sum("size"), F.count("*")).collect()}  # at most MOST_CELLS
    total = sum(s for s, _ in loads.values())
    home = place({c: s for c, (s, _) in loads.items()}, shards, vnodes, slack)
    base, filled = [], [0] * shards
    for c in sorted(loads):
        base.append(filled[home[c]])
        filled[home[c]] += loads[c][1]
    plan = docs.sparkSession.createDataFrame(pa.table({
        unit_: pa.array(sorted(loads), pa.int64()), "shard": pa.array([home[c] for c in sorted(loads)], pa.int32()), base_: pa.array(base, pa.int64()),
    }))
    fine = parts_for(total, cells * TASK_BYTES)  # tasks of a slot
    sized = sized.withColumn(unit_, cell.cast("long"))
    if fine > 1:
        # Slots too large for a task are split by hash; each part begins where the one before it ends.
        sized = sized.withColumn(unit_, F.col(unit_) * fine + F.pmod(h_, F.lit(fine)))
        counts = checkpoint(sized.groupBy(unit_).agg(F.count("*").alias(n_)))  # a row for each TASK_BYTES
        before = F.coalesce(F.sum(n_).over(Window.partitionBy(F.floor(F.col(unit_) / fine)).orderBy(unit_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        units = counts.select(F.col(unit_).alias(id_), F.floor(F.col(unit_) / fine).alias(unit_), before.alias(n_))
        plan = units.join(F.broadcast(plan), unit_).select(F.col(id_).alias(unit_), "shard", (F.col(base_) + F.col(n_)).alias(base_))
    within = Window.partitionBy(unit_).orderBy(h_, F.col(id_), "text_crc32", "size")
    # Few large tasks: each holds a sort buffer whatever it reads.
    return (
        sized.repartition(parts_for(total, TASK_BYTES), unit_).withColumn(n_, F.row_number().over(within))
        .join(F.broadcast(plan), unit_)  # a row for each slot, or for each TASK_BYTES
        .select(*kept, "size", "text_crc32", "shard", (F.col(base_) + F.col(n_) - 1).cast("long").alias("slot"))
    )
