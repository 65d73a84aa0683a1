"""Substring deduplication with fixed-block anchors.

Any window of 35 words holds a whole block of 18 words that starts at a multiple
of 18 (2 * 18 - 1 = 35).  So it suffices to index those non-overlapping blocks
and to probe the index with every rolling window of 18 words: two equal windows
of 35 words hit at the same place.  Around the hits every window of 35 words is
then compared by two hashes, 40 bits within its bucket and 64 more, both where it
is counted and where words are cut; runs of repeated windows are the maximal
exact repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm import exchange as ex
from quern.llm import rolling

WINDOW = 35


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places the windows that begin at ``starts`` (true or false) cover."""
    edge = np.zeros(n + length + 1, dtype=np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge[:n]) > 0


class _Words:
    """The word hashes of a chunk of texts and where windows may start."""

    def __init__(self, texts: list[bytes]):
        data, starts = rolling.joined(texts)
        s, e = rolling.word_spans(data)
        self.hash = rolling.word_hashes(data, s, e)
        self.of = np.searchsorted(starts, s, "right") - 1
        self.count = np.bincount(self.of, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count

    def starts(self, length: int, least: int) -> np.ndarray:
        """Positions where a window of ``length`` lies in one text of ``least`` words or more."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        same = self.of[:n] == self.of[length - 1 :]
        return np.flatnonzero(same & (self.count[self.of[:n]] >= least))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, spans, kept): each document without the words that
    windows of ``window`` words found anywhere else cover.

    ``spans`` are the maximal repeats as word offsets, end exclusive; ``kept`` are
    the other words joined by one space.  A window may repeat within its own
    document, overlapping itself too.  Null, empty and short texts lose nothing;
    an empty table gives no rows; repeated rows repeat each other; extra columns
    are not read.
    """
    block = (window + 1) // 2
    rows, buckets = ex.dealt(docs, id_col, text_col)

    def anchors(group: pa.Table) -> pa.Table:
        texts, g = group.column("t").to_pylist(), group.column("g")[0].as_py()
        keys, marks = [], []
        for a, b in rolling.chunks(texts):
            w = _Words(texts[a:b])
            at = w.starts(block, window)
            keys.append(ex.keyed(rolling.windows(w.hash, block)[at], buckets))
            marks.append((at - w.first[w.of[at]]) % block == 0)
        key, mark = np.concatenate(keys), np.concatenate(marks)
        blocks = np.unique(key[mark])
        key, count = np.unique(key, return_counts=True)
        is_block, multi = ex.member(key, blocks), count > 1
        return ex.blobs([
            (p, g, 0, np.int64(e - s).tobytes() + ex.pack40(key[s:e] & ex.LOW) + np.packbits(is_block[s:e]).tobytes() + np.packbits(multi[s:e]).tobytes())
            for p, s, e in ex.by_bucket(key)
        ])

    def probe(group: pa.Table) -> pa.Table:
        """Which rolling windows hit an indexed block other than themselves."""
        bucket = group.column("bucket")[0].as_py()
        v, f, m, g = [], [], [], []
        for of, x in zip(group.column("g").to_pylist(), group.column("blob").to_pylist(), strict=True):
            n = int(np.frombuffer(x, np.int64, 1)[0])
            bits = (n + 7) // 8
            v.append(ex.unpack40(x, n, 8))
            f.append(np.unpackbits(np.frombuffer(x, np.uint8, bits, 8 + 5 * n), count=n).astype(bool))
            m.append(np.unpackbits(np.frombuffer(x, np.uint8, bits, 8 + 5 * n + bits), count=n).astype(bool))
            g.append(np.full(n, of, dtype=np.int32))
        value, mark, multi, of = map(np.concatenate, (v, f, m, g))
        order = np.argsort(value)
        value, mark, multi, of = value[order], mark[order], multi[order], of[order]
        start, run = ex.runs(value)
        hit = np.logical_or.reduceat(mark, start) & ((np.diff(np.append(start, len(value))) > 1) | np.logical_or.reduceat(multi, start))
        keep = hit[run]
        return ex.blobs(ex.answers(of[keep], value[keep], bucket, 0))

    def extend(group: pa.Table, hits: pa.Table) -> pa.Table:
        """Send every whole window that holds a hit."""
        if not group.num_rows or not hits.num_rows:
            return ex.blobs([])
        texts, g = group.column("t").to_pylist(), group.column("g")[0].as_py()
        found = ex.key_of_blobs(hits, 0)
        keys, checks = [], []
        for a, b in rolling.chunks(texts):
            w = _Words(texts[a:b])
            at = w.starts(window, window)
            if not len(at):
                continue
            hit = ex.member(ex.keyed(rolling.windows(w.hash, block), buckets), found)
            total = np.concatenate(([0], np.cumsum(hit)))
            at = at[total[at + window - block + 1] > total[at]]
            keys.append(ex.keyed(rolling.windows(w.hash, window)[at], buckets))
            checks.append(rolling.windows(w.hash, window, rolling.BASES[1])[at])
        if not keys:
            return ex.blobs([])
        return ex.blobs(ex.pack_windows(np.concatenate(keys), np.concatenate(checks), g, 0))

    def settle(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        return ex.blobs(ex.repeated_windows(bucket, list(zip(group.column("g").to_pylist(), group.column("blob").to_pylist(), strict=True)), 0))

    id_type = rows.schema["id"].dataType
    id_arrow = to_arrow_type(id_type)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("id", id_arrow), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string())])

    def cut(group: pa.Table, hits: pa.Table) -> pa.Table:
        if not group.num_rows:
            return out.empty_table()
        texts = group.column("t").to_pylist()
        found = ex.windows_of_blobs(hits, 0)
        total, removed, spans, kept = [], [], [], []
        for a, b in rolling.chunks(texts):
            w = _Words(texts[a:b])
            begins = np.zeros(len(w.hash), dtype=bool)
            at = w.starts(window, window)
            if len(at) and len(found[0]):
                key = ex.keyed(rolling.windows(w.hash, window)[at], buckets)
                maybe = np.flatnonzero(ex.member(key, found[0]))
                check = rolling.windows(w.hash, window, rolling.BASES[1])[at[maybe]]
                begins[at[maybe]] = ex.checked(key[maybe], check, found)
            gone = cover(begins, window, len(w.hash))
            for k, text in enumerate(texts[a:b]):
                s, n = int(w.first[k]), int(w.count[k])
                words, mine = text.split(), gone[s : s + n]
                lost = int(mine.sum())
                total.append(n)
                removed.append(lost)
                edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).tolist() if lost else []
                spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                if lost:
                    words = [x for x, bad in zip(words, mine.tolist(), strict=True) if not bad]
                kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table([group.column("id").combine_chunks(), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], schema=out)

    hits = rows.groupBy("g").applyInArrow(anchors, ex.BLOB).groupBy("bucket").applyInArrow(probe, ex.BLOB)
    whole = rows.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(extend, ex.BLOB)
    repeats = whole.groupBy("bucket").applyInArrow(settle, ex.BLOB)
    return rows.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(
        cut, f"id {id_type.simpleString()}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    )
