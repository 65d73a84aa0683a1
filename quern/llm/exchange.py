"""Packed exchange of hashes between groups of documents and buckets of hashes.

Documents are dealt by a hash of the row into groups of bounded bytes.  A group
sends each bucket one blob of distinct hashes, so copies inside a group cost one
entry and a row's overhead is shared by thousands of hashes.  A bucket answers
each group with the hashes that count, and the group, which reads the same
shuffled documents again, knows its positions anew.  No hash that every document
has makes more than one entry a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import parts_for, shuffle_partitions, text_bytes, total_bytes

U64 = np.uint64
LOW = U64((1 << 40) - 1)
BLOB = "bucket int, g int, kind int, blob binary"


def dealt(docs: DataFrame, id_col: str, text_col: str, most: int = 8 << 20, least: int = 1 << 20) -> tuple[DataFrame, int]:
    """(id, t, g) dealt by g, and the number of buckets; both follow the bytes of the input."""
    n = shuffle_partitions(docs.sparkSession)
    total = total_bytes(docs, text_col)
    each = min(most, max(least, total // (4 * n)))
    groups = parts_for(total, each)
    parts = parts_for(total, 4 * most, n)
    rows = docs.select(
        F.col(id_col).alias("id"), text_bytes(text_col).alias("t"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), F.lit(groups)).cast("int").alias("g"),
    )
    return rows.repartition(parts, "g"), parts_for(total, 2 * most, n)


def keyed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Keys that order hashes by bucket: the bucket above 40 bits of the hash."""
    return ((hashes >> U64(44)) % U64(buckets)) << U64(40) | (hashes & LOW)


def pack40(values: np.ndarray) -> bytes:
    """40-bit values as five planes of bytes, which compress well when sorted."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def unpack40(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, at).reshape(5, n).T
    return out.view("<u8").reshape(-1)


def by_bucket(keys: np.ndarray):
    """(bucket, first, last) of each bucket in sorted keys."""
    if not len(keys):
        return
    of = (keys >> U64(40)).astype(np.int64)
    cut = np.flatnonzero(np.diff(of)) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
        yield int(of[s]), s, e


def blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    b, g, k, x = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({
        "bucket": pa.array(b, pa.int32()), "g": pa.array(g, pa.int32()), "kind": pa.array(k, pa.int32()), "blob": pa.array(x, pa.binary()),
    })


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and the run each key is in."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


def member(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted ``found``."""
    if not len(found):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(found, keys)
    at[at == len(found)] = 0
    return found[at] == keys


def key_of_blobs(table: pa.Table, kind: int) -> np.ndarray:
    """All keys that buckets answered for one kind, sorted: blobs of plain 40-bit values."""
    parts = [
        U64(b) << U64(40) | unpack40(x, len(x) // 5)
        for b, k, x in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True) if k == kind
    ]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=U64)


def by_group(g: np.ndarray, *columns: np.ndarray):
    """(group, columns) of each group, sorted by the columns."""
    order = np.lexsort((*columns[::-1], g))
    g, columns = g[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(g)) + 1
    for s, e in zip([0, *cut.tolist()] if len(g) else (), [*cut.tolist(), len(g)]):  # noqa: B905
        yield int(g[s]), [c[s:e] for c in columns]


def answers(g: np.ndarray, values: np.ndarray, bucket: int, kind: int) -> list[tuple[int, int, int, bytes]]:
    """Rows that return values of one bucket to the groups that sent them."""
    return [(bucket, to, kind, pack40(v)) for to, (v,) in by_group(g, values)]


def checked(keys: np.ndarray, checks: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each (key, check) is among ``found``, sorted by both: every bit counts."""
    known, known_checks = found
    out = np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(known, keys)
    live = np.arange(len(keys))
    while len(live):  # one turn, unless keys collide
        live = live[at[live] < len(known)]
        live = live[known[at[live]] == keys[live]]
        out[live] |= known_checks[at[live]] == checks[live]
        live = live[~out[live]]
        at[live] += 1
    return out


def windows_of_blobs(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows that buckets answered for one kind as (keys, checks), sorted by both."""
    keys, checks = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=U64)]
    for b, k, x in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
        if k == kind:
            n = len(x) // 13
            keys.append(U64(b) << U64(40) | unpack40(x, n))
            checks.append(np.frombuffer(x, "<u8", n, 5 * n))
    key, check = np.concatenate(keys), np.concatenate(checks)
    order = np.lexsort((check, key))
    return key[order], check[order]


#: Kinds of packed window entries: 40-bit value, 64-bit check, multi bit.
def pack_windows(keys: np.ndarray, checks: np.ndarray, g: int, kind: int) -> list[tuple[int, int, int, bytes]]:
    """Distinct (key, check) pairs of a group, with a bit for those met twice or more in it."""
    order = np.lexsort((checks, keys))
    keys, checks = keys[order], checks[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    multi = np.diff(np.append(first, len(keys))) > 1
    keys, checks = keys[first], checks[first]
    return [
        (b, g, kind, np.int64(e - s).tobytes() + pack40(keys[s:e] & LOW) + checks[s:e].astype("<u8").tobytes() + np.packbits(multi[s:e]).tobytes())
        for b, s, e in by_bucket(keys)
    ]


def repeated_windows(bucket: int, rows: list[tuple[int, bytes]], kind: int) -> list[tuple[int, int, int, bytes]]:
    """Answers (40-bit values, then 64-bit checks) for the windows that occur twice or
    more over all groups; rows are (g, blob)."""
    v, c, m, g = [], [], [], []
    for of, x in rows:
        n = int(np.frombuffer(x, np.int64, 1)[0])
        v.append(unpack40(x, n, 8))
        c.append(np.frombuffer(x, "<u8", n, 8 + 5 * n))
        m.append(np.unpackbits(np.frombuffer(x, np.uint8, offset=8 + 13 * n), count=n).astype(bool))
        g.append(np.full(n, of, dtype=np.int32))
    if not v:
        return []
    value, check, multi, of = map(np.concatenate, (v, c, m, g))
    order = np.lexsort((check, value))
    value, check, multi, of = value[order], check[order], multi[order], of[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (check[1:] != check[:-1])))
    start, run = np.flatnonzero(new), np.cumsum(new) - 1
    hit = (np.diff(np.append(start, len(value))) > 1) | np.logical_or.reduceat(multi, start)
    keep = hit[run]
    return [(bucket, to, kind, pack40(v) + c.astype("<u8").tobytes()) for to, (v, c) in by_group(of[keep], value[keep], check[keep])]
