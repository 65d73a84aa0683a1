"""Exact repeats of bytes through a run-length compressed suffix index.

The corpus is cut by content: the least hash among the 32-byte substrings of a
200-byte window is the window's anchor, so equal windows share their anchor.
Windows whose anchor occurs once cannot repeat.  The others travel, joined where
neighbours share an anchor, to the anchor's bucket.  There a run-length index is
built over the distinct pieces: their Burrows-Wheeler transform as runs, sampled
at run ends with text positions.  Matching statistics stream over the pieces from
those samples alone: between samples the match length falls by one per byte.
An anchor with very many occurrences, whose pieces no bucket could hold, is
settled by whole windows instead: each is known by two hashes, 40 bits within its
bucket and 64 more, compared in full both where windows are counted and where
bytes are cut, and they spread over all buckets, so no bucket grows with a hot
passage.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm import exchange as ex
from quern.llm import rolling
from quern.llm.substring import cover

U64 = np.uint64
WINDOW, KMER = 200, 32
#: Occurrences from which an anchor is hot.
HOT = 1 << 14
#: Bytes of pieces that are indexed together; one anchor's pieces are never parted.
INDEX_BYTES = 1 << 18
#: Bytes of texts whose arrays are made at once; they then fit a core's cache.
CHUNK = 1 << 18


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of distinct byte strings.

    Each string ends in a terminator of its own, smaller than any byte.
    ``samples`` holds, for every run head (and run end), the text position and
    the match length with the suffix before (after) it in suffix order.
    """

    def __init__(self, strings: list[bytes]):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", dtype=np.uint8)
        self.end = np.repeat(self.begin + lengths, lengths + 1)
        self.text, self.size = text, len(text)
        order = self._suffixes(np.repeat(np.arange(len(strings)), lengths + 1))
        before = text[order - 1].astype(np.int16)
        before[np.isin(order, self.begin, assume_unique=True)] = -1  # a terminator of its own
        head = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] < 0)))
        tail = np.append(head[1:], True)
        self.runs = int(head.sum())
        rows = np.flatnonzero(head)
        self.samples = [self._sampled(order, rows, -1), self._sampled(order, np.flatnonzero(tail), 1)]

    def _suffixes(self, of: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling over the suffixes not yet told apart."""
        n, text, end = self.size, self.text, self.end
        real = np.flatnonzero(np.arange(n) < end)
        left = (end - np.arange(n))[real]
        one = np.concatenate((text, np.zeros(7, np.uint8))).astype(U64) + U64(1)  # seven bytes a key, nine bits each
        two = one[:-1] << U64(9) | one[1:]
        four = two[:-2] << U64(18) | two[2:]
        key = (four[: n + 1] << U64(27) | two[4 : n + 5] << U64(9) | one[6 : n + 7])[real]
        short = np.flatnonzero(left < 7)
        key[short] &= ~((U64(1) << (U64(9) * (7 - left[short]).astype(U64))) - U64(1))
        order = np.argsort(key)
        sorted_key = key[order]
        start = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        rank = np.zeros(n + 1, dtype=np.int64)  # by position: the first row of its group
        rank[real[order]] = np.repeat(start, np.diff(np.append(start, len(order))))
        second = np.where(left < 7, of[real], 0)  # short suffixes differ by their terminators
        second_at = np.zeros(n, dtype=np.int64)
        second_at[real] = second
        tied = self._tied(real[order], rank)
        tied = self._split(tied, rank, second_at[tied])
        h = 7
        while len(tied):
            inside = tied + h < end[tied]  # else the next thing is the string's own terminator
            tied = self._split(tied, rank, np.where(inside, rank[np.where(inside, tied + h, 0)] + len(self.begin), of[tied]))
            h *= 2
        out = np.empty(len(real), dtype=np.int64)
        out[rank[real]] = real
        return out

    @staticmethod
    def _tied(positions: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The positions, sorted by rank, whose rank another one has too."""
        r = rank[positions]
        same = np.concatenate(([False], r[1:] == r[:-1], [False]))
        return positions[same[:-1] | same[1:]]

    def _split(self, tied: np.ndarray, rank: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Refine groups of equal rank by a second key; returns what is still tied."""
        if not len(tied):
            return tied
        key = (rank[tied].astype(U64) << U64(32)) | second.astype(U64)
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        group = key >> U64(32)
        at = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), at, 0))
        own = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
        rank[tied] = rank[tied] + (own - first)
        return self._tied(tied, rank)

    def _sampled(self, order: np.ndarray, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of sampled rows in text order, and their match with the next row."""
        place = order[rows]
        match = np.zeros(len(rows), dtype=np.int64)
        inner = (rows + step >= 0) & (rows + step < len(order))
        p, q = place[inner], order[rows[inner] + step]
        most = np.minimum(self.end[p] - p, self.end[q] - q)
        same, live = np.zeros(len(p), dtype=np.int64), np.arange(len(p))
        padded = self.text.tobytes() + bytes(16)
        words = np.ndarray((self.size + 8,), "<u8", padded, strides=(1,))  # the eight bytes from each position
        while len(live):
            differs = words[p[live] + same[live]] ^ words[q[live] + same[live]]
            lowest = differs & (~differs + U64(1))
            same[live] += np.where(differs == 0, 8, np.bitwise_count(lowest - U64(1)) >> 3)
            live = live[(differs == 0) & (same[live] < most[live])]
        match[inner] = np.minimum(same, most)
        by_place = np.argsort(place)
        return place[by_place], match[by_place]

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest match of its suffix elsewhere."""
        best = np.zeros(self.size, dtype=np.int64)
        at = np.arange(self.size)
        for place, match in self.samples:
            sum_at = np.zeros(self.size, dtype=np.int64)
            sum_at[place] = match + place
            last = np.zeros(self.size, dtype=np.int64)
            last[place] = place
            best = np.maximum(best, sum_at[np.maximum.accumulate(last)] - at)
        return np.where(at < self.end, best, 0)


def repeated_starts(strings: list[bytes], copies: list[bool], window: int) -> list[np.ndarray]:
    """For each distinct string, at which offsets a window starts that is found elsewhere."""
    if not strings:
        return []
    index = RunLengthIndex(strings)
    long = index.matching_statistics() >= window
    out = []
    for s, text, more in zip(index.begin.tolist(), strings, copies, strict=True):
        n = len(text) - window + 1
        out.append(np.ones(n, dtype=bool) if more else long[s : s + n])
    return out


class _Pieces:
    """The windows of a chunk of texts, joined into pieces that share an anchor."""

    def __init__(self, texts: list[bytes], window: int):
        self.data, starts = rolling.joined(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts, self.window = starts, window
        self.lanes: dict[int, np.ndarray] = {}
        n = len(self.data) - window + 1
        empty = np.zeros(0, dtype=np.int64)
        self.s = self.e = self.at = empty
        if n <= 0:
            return
        self.sums = sums = rolling.prefix(self.data.astype(U64) + U64(1), rolling.BASES[0])
        many = len(self.data) - KMER + 1
        ranked = sums[KMER:] - sums[:many]
        ranked *= rolling.powers(many, rolling.BASES[0])[1][:many]
        ranked ^= ranked >> U64(32)
        ranked *= U64(0x9FB21C651E98DF25)
        ranked &= U64(0xFFFFFFFF00000000)
        ranked |= np.arange(many, dtype=U64)  # equal ranks: the leftmost
        least = (_sliding_min(ranked, window - KMER + 1)[:n] & U64(0xFFFFFFFF)).astype(np.int64)
        # A piece begins at a text's first window and wherever the anchor changes; windows
        # that cross into the next text are cut off.
        long = self.lengths >= window
        begin, end = starts[long], (starts + self.lengths)[long] - window + 1
        if not len(begin):
            return
        edge = np.unique(np.concatenate((np.flatnonzero(least[1:] != least[:-1]) + 1, begin, end)))
        text = np.searchsorted(begin, edge, "right") - 1
        stop = np.append(edge[1:], n)
        inside = (text >= 0) & (edge < end[text])
        self.s, self.e = edge[inside], stop[inside] + window - 1
        self.at = least[self.s]

    def anchors(self, buckets: int) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, dtype=U64)
        inverse = rolling.powers(len(self.data) + 1, rolling.BASES[0])[1]
        return ex.keyed(rolling.mix((self.sums[self.at + KMER] - self.sums[self.at]) * inverse[self.at]), buckets)

    def piece_hashes(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """XXH64 of the bytes of each piece, by which a group knows it again."""
        view, digest = memoryview(self.data), xxhash.xxh64_intdigest
        s, e = self.s[which].tolist(), self.e[which].tolist()
        return np.fromiter((digest(view[a:b]) for a, b in zip(s, e, strict=True)), U64, len(s))

    def window_hashes(self, lane: int) -> np.ndarray:
        """The hash of the window that begins at each place."""
        if lane not in self.lanes:
            self.lanes[lane] = rolling.byte_windows(self.data, self.window, lane)
        return self.lanes[lane]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by block prefix and suffix minima."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=x.dtype)
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _hot_table(hits: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Repeated anchors (kind 0) and hot ones (kind 1), each sorted."""
    return ex.key_of_blobs(hits, 0), ex.key_of_blobs(hits, 1)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): each document without the bytes that
    ``window``-byte strings found anywhere else cover.

    ``spans`` are maximal runs of removed bytes, ends exclusive; ``kept`` holds the
    other bytes, which need not be valid UTF-8.  A string may repeat within its own
    document, overlapping itself too; matches never cross documents.  Null, empty
    and short texts lose nothing; an empty table gives no rows; repeated rows
    repeat each other; extra columns are not read.
    """
    if window < KMER:
        raise ValueError(f"window must be {KMER} bytes or more")
    rows, buckets = ex.dealt(docs, id_col, text_col, most=4 << 20)

    def anchors(group: pa.Table) -> pa.Table:
        texts, g = group.column("t").to_pylist(), group.column("g")[0].as_py()
        key = np.concatenate([_Pieces(texts[a:b], window).anchors(buckets) for a, b in rolling.chunks(texts, CHUNK)])
        key, count = np.unique(key, return_counts=True)
        count = np.minimum(count, 0xFFFF).astype("<u2")
        return ex.blobs([(p, g, 0, np.int64(e - s).tobytes() + ex.pack40(key[s:e] & ex.LOW) + count[s:e].tobytes()) for p, s, e in ex.by_bucket(key)])

    def repeated(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        v, c, g = [], [], []
        for of, x in zip(group.column("g").to_pylist(), group.column("blob").to_pylist(), strict=True):
            n = int(np.frombuffer(x, np.int64, 1)[0])
            v.append(ex.unpack40(x, n, 8))
            c.append(np.frombuffer(x, "<u2", n, 8 + 5 * n))
            g.append(np.full(n, of, dtype=np.int32))
        value, count, of = map(np.concatenate, (v, c, g))
        order = np.argsort(value)
        value, count, of = value[order], count[order].astype(np.int64), of[order]
        start, run = ex.runs(value)
        total = np.add.reduceat(count, start)[run]
        some, many = (total > 1) & (total < hot), total >= hot
        return ex.blobs(ex.answers(of[some], value[some], bucket, 0) + ex.answers(of[many], value[many], bucket, 1))

    def send(group: pa.Table, hits: pa.Table) -> pa.Table:
        """Pieces of repeated anchors (kind 0) and hashes of the windows of hot ones (kind 1)."""
        if not group.num_rows or not hits.num_rows:
            return ex.blobs([])
        texts, g = group.column("t").to_pylist(), group.column("g")[0].as_py()
        warm, burning = _hot_table(hits)
        found: dict[tuple[int, bytes], int] = {}
        names: dict[tuple[int, bytes], int] = {}
        keys, checks = [], []
        for a, b in rolling.chunks(texts, CHUNK):
            p = _Pieces(texts[a:b], window)
            anchor = p.anchors(buckets)
            at = np.flatnonzero(ex.member(anchor, warm))
            data = p.data.tobytes()
            for a_, s_, e_, h_ in zip(anchor[at].tolist(), p.s[at].tolist(), p.e[at].tolist(), p.piece_hashes(at).tolist(), strict=True):
                piece = (a_, data[s_:e_])
                found[piece] = found.get(piece, 0) + 1
                names[piece] = h_
            for at in _windows_of(p, ex.member(anchor, burning), window):
                keys.append(ex.keyed(p.window_hashes(0)[at], buckets))
                checks.append(p.window_hashes(1)[at])
        out = []
        if keys:
            out += ex.pack_windows(np.concatenate(keys), np.concatenate(checks), g, 1)
        pieces = sorted(found)
        of = np.fromiter((a for a, _ in pieces), U64, len(pieces))
        for bucket, s, e in ex.by_bucket(of):
            part = pieces[s:e]
            blob = (
                np.int64(e - s).tobytes() + (of[s:e] & ex.LOW).tobytes() + np.fromiter((names[x] for x in part), U64, e - s).tobytes()
                + np.fromiter((len(t) for _, t in part), "<u4", e - s).tobytes()
                + bytes(found[x] > 1 for x in part) + b"".join(t for _, t in part)
            )
            out.append((bucket, g, 0, zlib.compress(blob, 1)))
        return ex.blobs(out)

    def settle(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        sent = list(zip(group.column("g").to_pylist(), group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True))
        out = ex.repeated_windows(bucket, [(g, x) for g, kind, x in sent if kind == 1], 1)
        home: dict[tuple[int, bytes], list[int]] = {}
        names: dict[tuple[int, bytes], int] = {}
        twice: set[tuple[int, bytes]] = set()
        for g, kind, x in sent:
            if kind:
                continue
            x = zlib.decompress(x)
            n = int(np.frombuffer(x, np.int64, 1)[0])
            anchor = np.frombuffer(x, U64, n, 8).tolist()
            name = np.frombuffer(x, U64, n, 8 + 8 * n).tolist()
            length = np.frombuffer(x, "<u4", n, 8 + 16 * n).tolist()
            multi, at = x[8 + 20 * n : 8 + 21 * n], 8 + 21 * n
            for a, m, size, h in zip(anchor, multi, length, name, strict=True):
                piece = (a, x[at : at + size])
                at += size
                names[piece] = h
                if piece in home:
                    home[piece].append(g)
                    twice.add(piece)
                else:
                    home[piece] = [g]
                    if m:
                        twice.add(piece)
        whole: dict[int, list[int]] = {}  # group -> pieces all of whose windows repeat
        partly: dict[int, list[tuple[int, np.ndarray]]] = {}

        distinct = Counter(a for a, _ in home)
        alone = [x for x in home if distinct[x[0]] == 1]  # all of its anchor's pieces are equal
        for piece in alone:
            if piece in twice:
                for g in home[piece]:
                    whole.setdefault(g, []).append(names[piece])
        for part in _batches(sorted(x for x in home if distinct[x[0]] > 1)):
            for piece, begin in zip(part, repeated_starts([t for _, t in part], [x in twice for x in part], window), strict=True):
                n = int(begin.sum())
                for g in home[piece] if n else ():
                    if n == len(begin):
                        whole.setdefault(g, []).append(names[piece])
                    else:
                        partly.setdefault(g, []).append((names[piece], begin))
        out += [(bucket, g, 2, np.array(told, dtype=U64).tobytes()) for g, told in whole.items()]
        for g, told in partly.items():
            bits = b"".join(np.packbits(b).tobytes() for _, b in told)
            out.append((bucket, g, 0, np.int64(len(told)).tobytes() + np.array([h for h, _ in told], dtype=U64).tobytes() + np.array([len(b) for _, b in told], dtype="<u4").tobytes() + bits))
        return ex.blobs(out)

    id_type = rows.schema["id"].dataType
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("id", to_arrow_type(id_type)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def cut(group: pa.Table, hits: pa.Table) -> pa.Table:
        if not group.num_rows:
            return out.empty_table()
        texts = group.column("t").to_pylist()
        burnt = ex.windows_of_blobs(hits, 1)
        told: dict[int, np.ndarray] = {}
        parts = [np.frombuffer(x, U64) for kind, x in zip(hits.column("kind").to_pylist(), hits.column("blob").to_pylist(), strict=True) if kind == 2]
        whole = np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=U64)
        for kind, x in zip(hits.column("kind").to_pylist(), hits.column("blob").to_pylist(), strict=True) if hits.num_rows else ():
            if kind == 0:
                n = int(np.frombuffer(x, np.int64, 1)[0])
                at = 8 + 12 * n
                for h, size in zip(np.frombuffer(x, U64, n, 8).tolist(), np.frombuffer(x, "<u4", n, 8 + 8 * n).tolist(), strict=True):
                    wide = (size + 7) // 8
                    told[h] = np.unpackbits(np.frombuffer(x, np.uint8, wide, at), count=size).astype(bool)
                    at += wide
        known = np.sort(np.fromiter(told, U64, len(told)))
        total, removed, spans, kept = [], [], [], []
        for a, b in rolling.chunks(texts, CHUNK):
            p = _Pieces(texts[a:b], window)
            begins = np.zeros(len(p.data), dtype=bool)
            hashes = p.piece_hashes() if len(known) or len(whole) else None
            if len(whole):
                hit = ex.member(hashes, whole)
                edge = np.zeros(len(p.data) + 1, dtype=np.int32)
                edge[p.s[hit]] += 1  # pieces neither share starts nor overlap in starts
                edge[p.e[hit] - window + 1] -= 1
                begins = np.cumsum(edge[:-1]) > 0
            if len(known):
                for k in np.flatnonzero(ex.member(hashes, known)).tolist():
                    begin = told[int(hashes[k])]
                    begins[p.s[k] : p.s[k] + len(begin)] = begin
            if len(burnt[0]):
                for at in _windows_of(p, np.ones(len(p.s), dtype=bool), window):
                    key = ex.keyed(p.window_hashes(0)[at], buckets)
                    at, key = at[maybe := ex.member(key, burnt[0])], key[maybe]
                    begins[at] |= ex.checked(key, p.window_hashes(1)[at], burnt)
            gone = cover(begins, window, len(p.data))
            for k, text in enumerate(texts[a:b]):
                s = int(p.starts[k])
                mine = gone[s : s + len(text)]
                lost = int(mine.sum())
                total.append(len(text))
                removed.append(lost)
                if not lost:
                    spans.append([])
                    kept.append(text)
                    continue
                edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(p.data[s : s + len(text)][~mine].tobytes())
        return pa.table([group.column("id").combine_chunks(), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], schema=out)

    hits = rows.groupBy("g").applyInArrow(anchors, ex.BLOB).groupBy("bucket").applyInArrow(repeated, ex.BLOB)
    pieces = rows.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(send, ex.BLOB)
    verdicts = pieces.groupBy("bucket").applyInArrow(settle, ex.BLOB)
    return rows.groupBy("g").cogroup(verdicts.groupBy("g")).applyInArrow(
        cut, f"id {id_type.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    )


def _windows_of(p: _Pieces, chosen: np.ndarray, window: int):
    """Starts of all windows of the chosen pieces, a bounded number at a time."""
    which = np.flatnonzero(chosen)
    counts = (p.e - p.s - window + 1)[which] if len(which) else np.zeros(0, np.int64)
    for a in range(0, len(which), 4096):
        n = counts[a : a + 4096]
        base = np.repeat(p.s[which[a : a + 4096]], n)
        yield base + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _batches(pieces: list[tuple[int, bytes]]):
    """Sorted (anchor, piece) pairs in runs of about INDEX_BYTES, whole anchors together."""
    run: list[tuple[int, bytes]] = []
    size = 0
    for piece in pieces:
        if size >= INDEX_BYTES and piece[0] != run[-1][0]:
            yield run
            run, size = [], 0
        run.append(piece)
        size += len(piece[1])
    if run:
        yield run

