"""Token counts from distinct pre-tokens.

Byte-level BPE never merges across pre-tokens, so a text's count is the sum over
its pre-tokens.  Documents are dealt into groups; each group sends its distinct
pre-tokens to buckets of their hashes, a bucket counts the pieces of each of its
pre-tokens once for the whole corpus, and the group joins the counts that come
back to the pre-token frequencies of its documents and sums.  Ids are never kept.

Pre-tokens are found for all scripts alike, by arrays over code points: runs of
letters, numbers, spaces and others, a space in front of a run drawn into it, and
contractions.  To which class a code point belongs is asked of the tokenizer
library itself, so its Unicode tables are the ones that count.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm import exchange as ex
from quern.llm import rolling

U64 = np.uint64
LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
# What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Splitter:
    """Pre-tokens and piece counts by one tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        before = said.get("pre_tokenizer") or {}
        plain = not any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if said.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or not plain:
            raise ValueError(f"{path}: only byte-level BPE without normaliser or prefix space has independent pre-tokens")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        specials = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials)).encode()) if specials else None
        self.table = np.full(0x110000, -1, dtype=np.int8)

    def classes(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        unknown = np.unique(points[out < 0])
        if len(unknown):
            self._ask(unknown)
            out = self.table[points]
        return out

    def _ask(self, points: np.ndarray) -> None:
        """Which classes the library puts code points into: those that it joins with a
        letter, a number or a sign before them; spaces are joined with none."""
        chars = [chr(p) for p in points.tolist()]
        self.table[points] = SPACE
        for kind, lead in ((LETTER, "1a"), (NUMBER, "a1"), (OTHER, "a!")):
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str("".join(lead + c for c in chars))
            cut = {start for _, (start, _) in found}
            self.table[points[[3 * i + 2 not in cut for i in range(len(chars))]]] = kind

    def pieces(self, distinct: list[str]) -> np.ndarray:
        """How many pieces each pre-token has."""
        encoded = self.tokenizer.encode_batch_fast(distinct, add_special_tokens=False)
        return np.fromiter(map(len, encoded), np.int64, len(distinct))

    def split(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(data, starts, ends, of, extra): the bytes of the texts, each pre-token's bytes
        and text, and how many special strings each text has."""
        extra = np.zeros(len(texts), dtype=np.int64)
        parts, owner = texts, np.arange(len(texts))
        if self.special and self.special.search(b"\n".join(texts)):
            divided = [self.special.split(t) for t in texts]
            extra = np.array([len(d) - 1 for d in divided], dtype=np.int64)
            parts, owner = [p for d in divided for p in d], np.repeat(owner, extra + 1)
        data = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # where code points begin
        points = raw if len(lead) == len(raw) else np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        kind = self.classes(points)
        edges = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        edges = edges if points is raw else np.searchsorted(lead, edges)
        kind[edges] = EDGE
        new = self._starts(points, kind)
        new[edges] = True
        at = np.flatnonzero(new)
        starts, ends = lead[at], lead[np.append(at[1:], len(points) - 1)]
        token = kind[at] != EDGE
        return data, starts[token], ends[token], owner[np.searchsorted(edges, at[token])], extra

    @staticmethod
    def _starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """At which code points a pre-token begins."""
        n = len(points)
        new = np.ones(n, dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        run = np.flatnonzero(new)
        after = np.append(run[1:], n)
        which = kind[run]
        # The last of several spaces before a run stands alone, or, if it is a plain one, joins the run.
        spaces = np.flatnonzero(which[:-1] == SPACE)
        spaces = spaces[which[spaces + 1] != EDGE]
        new[after[spaces] - 1] = True
        joins = spaces[points[after[spaces] - 1] == 0x20]
        new[after[joins]] = False
        # An apostrophe that begins a pre-token takes the letters of a contraction.
        quote = np.flatnonzero((which == OTHER) & (after - run == 1) & (points[run] == 0x27) & new[run])
        quote = quote[quote + 1 < len(run)]
        quote = quote[which[quote + 1] == LETTER]
        open_ = np.ones(len(quote), dtype=bool)
        for word in CONTRACTIONS:
            first, fits = run[quote] + 1, open_ & (after[np.minimum(quote + 1, len(run) - 1)] - run[quote] - 1 >= len(word))
            for k, c in enumerate(word):
                fits &= points[np.minimum(first + k, n - 1)] == ord(c)
            hit = first[fits]
            new[hit] = False
            new[hit + len(word)] |= kind[hit + len(word)] == LETTER
            open_ &= ~fits
        return new


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every document, as the library counts without
    added tokens, padding or truncation.

    ``tokenizer_path`` must exist on every executor and name a byte-level BPE without
    normaliser.  A null text counts as empty, with 0 bytes and 0 tokens; an empty
    table gives no rows; repeated rows are counted one by one; extra columns are not
    read.  Within a group pre-tokens are told apart by 64-bit hashes.
    """
    rows, buckets = ex.dealt(docs, id_col, text_col)

    def bucket_of(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> U64(44)) % U64(buckets)).astype(np.int64)

    def distinct(group: pa.Table) -> pa.Table:
        """The distinct pre-tokens of a group, by bucket and hash."""
        texts, g = group.column("t").to_pylist(), group.column("g")[0].as_py()
        known, words = np.zeros(0, dtype=U64), []
        for a, b in rolling.chunks(texts):
            data, s, e, _, _ = splitter(tokenizer_path).split(texts[a:b])
            found, first = np.unique(rolling.word_hashes(np.frombuffer(data, np.uint8), s, e), return_index=True)
            fresh = ~np.isin(found, known, assume_unique=True)
            known = np.concatenate((known, found[fresh]))
            words += [data[x:y] for x, y in zip(s[first[fresh]].tolist(), e[first[fresh]].tolist(), strict=True)]
        home = bucket_of(known)
        order = np.lexsort((known, home))
        words, home = [words[k] for k in order.tolist()], home[order]
        cut = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
        return ex.blobs([
            (int(home[s]), g, 0, zlib.compress(np.int64(e - s).tobytes() + np.fromiter(map(len, words[s:e]), "<u4", e - s).tobytes() + b"".join(words[s:e]), 1))
            for s, e in zip(cut, cut[1:]) if e > s  # noqa: B905
        ])

    def count(group: pa.Table) -> pa.Table:
        """The pieces of each pre-token of a bucket, counted once, in the order each group sent."""
        bucket = group.column("bucket")[0].as_py()
        sent = []
        for of, x in zip(group.column("g").to_pylist(), group.column("blob").to_pylist(), strict=True):
            x = zlib.decompress(x)
            n = int(np.frombuffer(x, np.int64, 1)[0])
            ends = (8 + 4 * n + np.cumsum(np.frombuffer(x, "<u4", n, 8), dtype=np.int64)).tolist()
            sent.append((of, [x[s:e] for s, e in zip([8 + 4 * n, *ends], ends)]))  # noqa: B905
        place = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in sent for w in words))}
        pieces = splitter(tokenizer_path).pieces([w.decode() for w in place]).astype("<u4")
        return ex.blobs([(bucket, of, 0, zlib.compress(pieces[[place[w] for w in words]].tobytes(), 1)) for of, words in sent])

    id_type = rows.schema["id"].dataType
    out = pa.schema([("id", to_arrow_type(id_type)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def total(group: pa.Table, counts: pa.Table) -> pa.Table:
        """Counts joined to the frequencies of each document's pre-tokens, and summed."""
        if not group.num_rows:
            return out.empty_table()
        texts = group.column("t").to_pylist()
        chunks = []
        for a, b in rolling.chunks(texts):
            data, s, e, of, extra = splitter(tokenizer_path).split(texts[a:b])
            chunks.append((a, b, rolling.word_hashes(np.frombuffer(data, np.uint8), s, e), of, extra))
        known = np.unique(np.concatenate([c[2] for c in chunks]))
        pieces = np.zeros(len(known), dtype=np.int64)
        came = sorted(zip(counts.column("bucket").to_pylist(), counts.column("blob").to_pylist(), strict=True))
        if came:
            pieces[np.lexsort((known, bucket_of(known)))] = np.concatenate([np.frombuffer(zlib.decompress(x), "<u4") for _, x in came])
        tokens = np.zeros(len(texts), dtype=np.int64)
        for a, b, hashes, of, extra in chunks:
            pair, frequency = np.unique(of * len(known) + np.searchsorted(known, hashes), return_counts=True)
            tokens[a:b] = extra
            np.add.at(tokens, a + pair // max(1, len(known)), frequency * pieces[pair % max(1, len(known))])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.table([group.column("id").combine_chunks(), pa.array(size), pa.array(tokens)], schema=out)

    counts = rows.groupBy("g").applyInArrow(distinct, ex.BLOB).groupBy("bucket").applyInArrow(count, ex.BLOB)
    return rows.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(total, f"id {id_type.simpleString()}, n_bytes long, n_tokens long")
