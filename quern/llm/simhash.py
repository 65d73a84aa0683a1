"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits lie on a ring of eight segments.  If two fingerprints
differ in at most three bits, then from some segment on every chain of k
segments differs in at most floor(3k / 8) bits (the pigeonring principle): the
first two segments agree and the next three together differ in one bit at most,
so one half of those 24 bits agrees too.  Equal keys of 28 bits, two for each of
the eight starting segments, therefore find every link; the rest of the chain is
checked before the full Hamming distance.

For a lower similarity than three bits stand for, ``similar`` takes wide
fingerprints of 256 bits on a ring of 32 segments.  So many bits may differ
then that no key of bits is sure to agree, so its candidates come from KEYS keys of
DEPTH least shingle hashes each, the same number however large the corpus is; the
pigeonring chains and the full Hamming check follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, row_keys, shuffle_partitions, text_bytes, unused
from quern.llm.components import connected, stars
from quern.llm.rolling import mix

SEED = 42
BITS, SEGMENTS, TAU = 64, 8, 3
U64 = np.uint64


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, or of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=U64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=U64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    last = len(words) - shingle + 1
    return np.fromiter(
        (digest(view[s:e], seed) for s, e in zip(starts[:last].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)),
        dtype=U64, count=last,
    )


def majority(hashes: np.ndarray) -> int:
    """Each of 64 bits is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255 << 8):  # bounded for very long texts
        part = hashes[at : at + (255 << 8)]
        rows = np.zeros((-(-len(part) // 255) * 255, BITS), dtype=np.uint8)
        rows[: len(part)] = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of 255 rows fit a byte, and bytes add fast.
        ones += rows.reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    value = 0
    for bit in np.flatnonzero(2 * ones > len(hashes)).tolist():
        value |= 1 << bit
    return value


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """Majority of each bit over the XXH64 of the text's word shingles; no words give 0."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long.  A null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, dtype=U64).view(np.int64))], names=["id", "fp"]
            )

    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def _keys() -> list:
    """The sixteen (slot, bits) keys of ``fp``, each tagged with its slot in the top byte."""
    keys = []
    for start in range(SEGMENTS):
        turned = F.col("fp") if start == 0 else F.shiftleft("fp", 8 * start).bitwiseOR(F.shiftrightunsigned("fp", 64 - 8 * start))
        head = F.shiftrightunsigned(turned, 48).bitwiseAND(F.lit(0xFFFF))
        for half, shift in ((0, 36), (1, 24)):
            tail = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit(0xFFF))
            slot = 2 * start + half
            keys.append(F.lit(slot << 28).bitwiseOR(F.shiftleft(head.cast("long"), 12)).bitwiseOR(tail.cast("long")))
    return keys


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chain_ok(diff: np.ndarray, start: int, tau: int = TAU) -> np.ndarray:
    """Whether every chain from ``start`` stays within its proportional budget."""
    spent = np.zeros(diff.shape, dtype=np.uint8)
    ok = np.ones(diff.shape, dtype=bool)
    for k in range(1, SEGMENTS + 1):
        shift = (64 - 8 * (start + k)) % 64
        spent += popcount((diff >> U64(shift)) & U64(0xFF)).astype(np.uint8)
        ok &= spent <= tau * k // SEGMENTS
    return ok


def forest(fps: np.ndarray, slot: int, tau: int = TAU, split: int | None = None) -> list[tuple[int, int]]:
    """Edges that span the links among the fingerprints sharing one key.

    A search from each fingerprint meets only those not reached yet, so a dense
    family costs far less than its pairs, and at most len(fps) - 1 edges come
    out.  With ``split`` only links between the first ``split`` and the rest are
    sought, for two blocks of one hot key.
    """
    edges: list[tuple[int, int]] = []
    start = slot // 2
    left = np.ones(len(fps), dtype=bool)
    side = np.arange(len(fps)) < (split or 0)
    for first in range(len(fps)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left if split is None else left & (side != side[at]))
            if not len(rest):
                continue
            diff = fps[rest] ^ fps[at]
            near = rest[chain_ok(diff, start, tau) & (popcount(diff) <= tau)]
            if len(near):
                left[near] = False
                edges += [(at, int(x)) for x in near]
                queue += near.tolist()
    return edges


def links(fps: DataFrame, tau: int = TAU, block: int = 4096) -> DataFrame:
    """(a, b): edges whose components are those of all links within ``tau`` bits.

    ``fps`` has distinct fingerprints ``fp``.  A key that more than ``block``
    fingerprints share is cut into blocks, and each pair of blocks is one unit of
    work, so no task holds more than a few units whatever a key's size.
    """
    n = shuffle_partitions(fps.sparkSession)
    keyed = fps.select("fp", F.explode(F.array(*_keys())).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    units = (
        keyed.join(counts, "key")
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("fp", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
        .withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(16 * n)))
    )

    def run(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(U64)
        key, i, j, mine = (group.column(c).to_numpy() for c in ("key", "i", "j", "mine"))
        order = np.lexsort((fp, mine, j, i, key))
        fp, key, i, j, mine = fp[order], key[order], i[order], j[order], mine[order]
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        bounds = np.concatenate(([0], cut, [len(fp)]))
        a: list[int] = []
        b: list[int] = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            own = fp[s:e]
            split = int(np.searchsorted(mine[s:e], j[s])) if i[s] != j[s] else None
            for x, y in forest(own, int(key[s]) >> 28, tau, split):
                a.append(int(own[x]))
                b.append(int(own[y]))
        low, other = stars(np.array(a, dtype=U64).view(np.int64), np.array(b, dtype=U64).view(np.int64))
        return pa.table({"a": low, "b": other})

    return units.groupBy("part").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = TAU) -> DataFrame:
    """(id, fp, component): documents whose fingerprints link, directly or through others.

    The component is its least id.  Equal fingerprints collapse before any
    comparison, so copies cost one row.  Null and empty texts share fingerprint 0
    and so one component (with whatever lies within ``tau`` bits); an empty table
    gives no rows; repeated rows stay; a null id takes part but is never a
    component's least id unless all are null.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = connected(links(distinct.select("fp"), tau))
    named = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    return rows.join(_with_least(named, "fp"), "fp").select("id", "fp", "component")


def _with_least(named: DataFrame, node: str) -> DataFrame:
    """(node, component): the least id of each node's root.

    Both sides of the join are read from checkpoints, so it is a join of plain
    exchanges, whose partition of a very large component Spark can split."""
    named = checkpoint(named)
    least = checkpoint(named.groupBy("root").agg(F.min("least").alias("component")))
    return named.join(least, "root").select(node, "component")


#: Words of a wide fingerprint, and the columns that hold them.
WIDE = ("w0", "w1", "w2", "w3")
WIDE_SEGMENTS = 8 * len(WIDE)
#: Buckets up to this size are compared whole; larger ones by search.
SMALL = 64
#: Keys of a wide fingerprint, and the least hashes that make up a key: sets of
#: resemblance s share a key with probability 1 - (1 - s**DEPTH)**KEYS.
KEYS, DEPTH = 12, 4
_TURN = mix(np.arange(1, KEYS * DEPTH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def wide_keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS hashes, each of DEPTH least values of the set of hashes under as many orders."""
    least = np.full(KEYS * DEPTH, np.iinfo(U64).max, dtype=U64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * _TURN
        part ^= part >> U64(32)
        part *= _TURN[::-1]
        np.minimum(least, part.min(axis=0), out=least)
    out = np.arange(KEYS, dtype=U64)
    for k in range(DEPTH):
        out = mix(out ^ least[k * KEYS : (k + 1) * KEYS])
    return out


def wide_fingerprint(text: bytes, shingle: int) -> tuple[tuple[int, ...], np.ndarray]:
    """256 bits, as words, from as many mixes of each distinct shingle's hash, and the keys."""
    hashes = np.unique(shingle_hashes(text, shingle))
    return tuple(majority(mix(hashes + U64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if k else hashes) for k in range(len(WIDE))), wide_keys(hashes)


def differing_share(similarity: float) -> float:
    """The share of bits that differ, on average, for sets of this resemblance."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def wide_tau(similarity: float) -> int:
    """Seven quarters of a standard error above the mean of differing bits at this resemblance."""
    share, bits = differing_share(similarity), BITS * len(WIDE)
    return int(bits * share + 1.75 * math.sqrt(bits * share * (1 - share)))


def wide_near(diff: np.ndarray, tau: int) -> np.ndarray:
    """Rows of words within ``tau`` bits: first some chain of three segments must
    keep to its proportional budgets, then the whole distance counts."""
    parts = popcount(diff.view(np.uint8).reshape(-1, WIDE_SEGMENTS)).astype(np.int16)
    total = np.zeros_like(parts)
    ok = np.ones(parts.shape, dtype=bool)
    for k in range(1, 4):
        total += np.roll(parts, 1 - k, axis=1)
        ok &= total <= tau * k // WIDE_SEGMENTS
    out = ok.any(axis=1)
    out[out] = parts[out].sum(axis=1) <= tau
    return out


def wide_forest(words: np.ndarray, tau: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """As ``forest``, for rows of words; with ``side`` only links across it."""
    edges: list[tuple[int, int]] = []
    left = np.ones(len(words), dtype=bool)
    for first in range(len(words)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left if side is None else left & (side != side[at]))
            near = rest[wide_near(words[rest] ^ words[at], tau)] if len(rest) else rest
            left[near] = False
            edges += [(at, int(x)) for x in near]
            queue += near.tolist()
    return edges


def wide_links(fps: DataFrame, tau: int, block: int = 4096) -> DataFrame:
    """(a, b) over distinct (node, w0 to w3, keys): edges that span the links met under a
    common key.  A key that more than ``block`` fingerprints share is cut into blocks,
    all pairs of which are compared, so nothing is capped.  Each task contracts its
    links to stars, so a dense family's pairs stay inside it."""
    n = shuffle_partitions(fps.sparkSession)
    keyed = fps.select(F.explode("keys").alias("key"), "node", *WIDE)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    cut = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    units = (
        keyed.join(hot, "key", "left").withColumn("blocks", cut)
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", *WIDE)
        .withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(4 * n)))
    )

    def run(group: pa.Table) -> pa.Table:
        key, i, j, mine, node = (group.column(c).to_numpy() for c in ("key", "i", "j", "mine", "node"))
        order = np.lexsort((mine, j, i, key))
        key, i, j, mine, node = key[order], i[order], j[order], mine[order], node[order]
        words = np.stack([group.column(c).to_numpy().view(U64)[order] for c in WIDE], axis=1)
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        bounds = np.concatenate(([0], cut, [len(key)]))
        size = np.diff(bounds)
        unit = np.repeat(np.arange(len(size)), size)
        small = (size <= SMALL)[unit] & (i == j)
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for step in range(1, int(size[size <= SMALL].max(initial=1))):  # all pairs of the small units at once
            at = np.flatnonzero(small[:-step] & (unit[step:] == unit[:-step]))
            if not len(at):
                break
            at = at[wide_near(words[at] ^ words[at + step], tau)]
            a.append(node[at])
            b.append(node[at + step])
        for u in np.flatnonzero((size > SMALL) | (i != j)[bounds[:-1]]).tolist():
            s, e = int(bounds[u]), int(bounds[u + 1])
            across = (mine[s:e] == j[s]) if i[s] != j[s] else None
            found = wide_forest(words[s:e], tau, across)
            a.append(node[[s + x for x, _ in found]])
            b.append(node[[s + y for _, y in found]])
        none = np.zeros(0, dtype=np.int64)
        low, other = stars(np.concatenate([none, *a]), np.concatenate([none, *b]))
        return pa.table({"a": low, "b": other})

    return units.groupBy("part").applyInArrow(run, "a long, b long")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component): documents whose shingle sets resemble each other by ``similarity``
    or more, as wide fingerprints estimate it, directly or through others.

    The bound on differing bits lies 1.75 standard errors above the mean at the
    threshold, so most pairs at it are linked and nearly all above it.  The component is its least id.
    Null, empty and short texts, ties, repeated rows
    and empty tables are treated as in ``near_duplicates``.
    """
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            bits = np.array([f[0] for f in found], dtype=U64).reshape(-1, len(WIDE)).view(np.int64)
            keys = np.concatenate([np.zeros(0, dtype=U64), *(f[1] for f in found)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(w.copy()) for w in bits.T),
                pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * KEYS), pa.array(keys)),
            ], names=["id", *WIDE, "keys"])

    made = source.mapInArrow(run, f"id {kind}, {', '.join(f'{w} long' for w in WIDE)}, keys array<long>")
    rows = checkpoint(made.withColumn("node", F.xxhash64(*WIDE)))
    # Texts of one fingerprint are all but equal, so the keys of one of them serve.
    distinct = checkpoint(rows.groupBy("node", *WIDE).agg(F.min("id").alias("least"), F.min("keys").alias("keys")))
    nodes = connected(wide_links(distinct, wide_tau(similarity)))
    named = distinct.join(nodes.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return rows.join(_with_least(named, "node"), "node").select("id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row, with its own columns, of each group of similar documents: that of the
    least id, and of rows equal to it one.

    Null and empty texts are one group; a null id comes after all others; an empty
    table gives no rows; columns may have any names and types.
    """
    columns = docs.columns
    k_, l_, id_ = unused(columns, "__k", "__l", "__id")
    key, key2 = row_keys(docs)
    keyed = docs.withColumn(k_, key).withColumn(l_, key2)
    by = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(k_).alias("key"), F.col(l_).alias("key2"))
    found = similar(keyed.withColumn(id_, by), id_, text_col, shingle, similarity)
    kept = found.where(F.col("id") == F.col("component")).select(F.col("id.key").alias(k_), F.col("id.key2").alias(l_)).distinct()
    return keyed.join(kept, [k_, l_], "left_semi").dropDuplicates([k_, l_]).select(*columns)
