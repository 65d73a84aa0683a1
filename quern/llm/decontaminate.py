"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms are counted over the whole corpus.
2. The benchmark's TF-IDF passages are factorised block by block in the executors
   by a randomised SVD; a block's right singular vectors, as many as keep each of
   its passages nearly whole, span its latent space.
3. Every window of every document is projected into the latent spaces and its
   product with each passage compared with the shorter of the two: a window that
   holds a whole item counts, however short the item and whatever surrounds it.
   Windows and blocks that cannot reach the threshold, by the largest share that
   each of their terms has in any passage, are skipped, which loses nothing.
4. Candidates pass a longest-common-subsequence check against the whole item, or,
   if only moderately similar, a check that the item's answer (its last quarter)
   is there too, which keeps paraphrases.

The corpus is scanned once for the frequencies and once for each BENCHMARK_BYTES
of benchmark, and never shuffled.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm import rolling
from quern.llm.common import text_bytes, unused

DIMS = 1 << 18
#: Passages that share a latent space.
BLOCK = 128
#: Bytes of benchmark text searched in one scan, so that what workers hold is bounded.
BENCHMARK_BYTES = 1 << 20
#: Vectors added up by one task of the reduction tree; three levels take its cube.
FAN_IN = 128
#: Windows projected at once.
WINDOWS = 2048

# Terms are runs of ASCII letters and digits and of non-ASCII bytes, lower-cased.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 0x80:
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c


@dataclass(frozen=True)
class Params:
    window: int = 32
    stride: int = 8
    #: The share of its length that the latent space must keep of each passage.
    kept: float = 0.999
    #: Least product of window and passage, over the lesser of their lengths' product and the passage's square.
    near: float = 0.5
    lcs: float = 0.8
    lcs_paraphrase: float = 0.6
    answer: float = 0.9


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every term of the texts, and the text it belongs to."""
    data, starts = rolling.joined(texts)
    folded = _FOLD[data]
    s, e = rolling.word_spans(folded)
    return rolling.word_hashes(folded, s, e), np.searchsorted(starts, s, "right") - 1


def _dims(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many documents have each hashed term, and how many documents there are.

    Every task sends one compressed vector of DIMS counts; vectors are added in a
    tree, FAN_IN at a time, and only the sum reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for first, last in rolling.chunks(texts):
                hashes, of = terms(texts[first:last])
                pairs = np.unique(of.astype(np.int64) * DIMS + _dims(hashes))
                df += np.bincount(pairs % DIMS, minlength=DIMS)
        part = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "df": pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        df = np.zeros(DIMS, dtype=np.int64)
        for blob in group.column("df").to_pylist():
            df += np.frombuffer(zlib.decompress(blob), dtype=np.int64)
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int32()), "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "df": pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())})

    schema = "part int, n long, df binary"
    parts = docs.select(text_bytes(text_col).alias("t")).mapInArrow(count, schema)
    for _ in range(3):
        parts = parts.groupBy("part").applyInArrow(add, schema)
    df, n = np.zeros(DIMS, dtype=np.int64), 0
    for r in parts.collect():  # one row, up to two million tasks
        df, n = df + np.frombuffer(zlib.decompress(bytes(r["df"])), dtype=np.int64), n + int(r["n"])
    return df, n


def passages(n: int, window: int) -> list[int]:
    """Where the passages of an item of n terms begin: at half-window steps, the last one at its end."""
    return [0] if n <= window else sorted({*range(0, n - window, window // 2), n - window})


@dataclass
class Block:
    """The latent space of up to BLOCK passages."""

    item: np.ndarray  # item of each passage
    offset: np.ndarray  # where in its item each passage begins
    norm: np.ndarray  # TF-IDF length of each passage
    dims: np.ndarray  # dimensions that occur, sorted
    basis: np.ndarray  # dims x rank
    latent: np.ndarray  # passages x rank, scaled to length 1
    reach: np.ndarray  # per dimension the largest value in a passage of length 1, and that over the passage's length


@dataclass
class LatentIndex:
    """Everything a worker needs to search one part of the benchmark."""

    ids: list
    items: list[np.ndarray]  # term hashes of each item
    weight: np.ndarray  # idf of each dimension
    row: np.ndarray  # dimension -> place among those that occur, or -1
    reach: np.ndarray  # the largest of all blocks
    blocks: list[Block]


def randomised_svd(matrix: np.ndarray, kept: float, power: int = 2, seed: int = 7) -> np.ndarray:
    """An orthonormal basis (columns x k) of leading right singular vectors of a matrix
    with rows of length 1: the least k that keeps ``kept`` of the length of each row."""
    rows, width = matrix.shape
    x = np.random.default_rng(seed).standard_normal((width, min(rows + 10, width)))
    for _ in range(power):
        x = np.linalg.qr(matrix.T @ (matrix @ x))[0]
    values, turn = np.linalg.eigh((matrix @ x).T @ (matrix @ x))
    basis = x @ turn[:, np.argsort(values)[::-1][: min(rows, width)]]
    held = np.cumsum((matrix @ basis) ** 2, axis=1).min(axis=0)
    return basis[:, : int(np.searchsorted(held, kept**2)) + 1].astype(np.float32)


def build_block(chosen: list[tuple[int, int, np.ndarray]], weight: np.ndarray, p: Params) -> Block:
    """The latent space of (item, offset, term hashes) passages."""
    parts = [np.unique(_dims(words), return_counts=True) for _, _, words in chosen]
    dims = np.unique(np.concatenate([d for d, _ in parts]))
    matrix = np.zeros((len(parts), len(dims)))
    for k, (d, tf) in enumerate(parts):
        matrix[k, np.searchsorted(dims, d)] = tf * weight[d]
    norm = np.linalg.norm(matrix, axis=1)
    matrix /= norm[:, None]
    basis = randomised_svd(matrix, p.kept, seed=len(dims))
    latent = (matrix @ basis).astype(np.float32)
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    # A little room for what the latent space does not keep.
    reach = np.stack([matrix.max(axis=0), (matrix / norm[:, None]).max(axis=0)]).astype(np.float32) * 1.01
    return Block(np.array([i for i, _, _ in chosen]), np.array([o for _, o, _ in chosen]), norm.astype(np.float32), dims, basis, latent, reach)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    weight = np.log((n + 1.0) / (df + 1.0)).astype(np.float32)
    weight[weight < np.log(20)] = 0  # terms of more than one document in twenty say nothing
    return weight


def build_index(spark, ids: list, items: list[np.ndarray], weight: np.ndarray, p: Params) -> LatentIndex | None:
    """The index of some items, its blocks factorised in the executors; None if no item has a term."""
    chosen = [(k, o) for k, words in enumerate(items) if len(words) for o in passages(len(words), p.window)]
    if not chosen:
        return None
    weight = weight.copy()
    for k, o in chosen:  # passages of nothing but common terms: these count evenly
        dims = _dims(items[k][o : o + p.window])
        if not weight[dims].any():
            weight[dims] = 1
    shared = spark.sparkContext.broadcast((chosen, items, weight))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, items, weight = shared.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                mine = [(k, o, items[k][o : o + p.window]) for k, o in chosen[b * BLOCK : (b + 1) * BLOCK]]
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int64()), "made": pa.array([zlib.compress(pickle.dumps(build_block(mine, weight, p)), 1)], pa.binary())})

    n = -(-len(chosen) // BLOCK)
    made = spark.range(0, n, 1, n).mapInArrow(make, "block long, made binary").collect()
    shared.unpersist()
    blocks = [pickle.loads(zlib.decompress(bytes(r["made"]))) for r in sorted(made, key=lambda r: r["block"])]
    used = np.unique(np.concatenate([b.dims for b in blocks]))
    row = np.full(DIMS, -1, dtype=np.int32)
    row[used] = np.arange(len(used), dtype=np.int32)
    reach = np.zeros((2, len(used)), dtype=np.float32)
    for b in blocks:
        b.dims = row[b.dims]
        reach[:, b.dims] = np.maximum(reach[:, b.dims], b.reach)
    return LatentIndex(ids, items, weight, row, reach, blocks)


def masks(item: np.ndarray) -> dict[int, int]:
    """For each term the places of the item where it stands, as bits."""
    out: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        out[word] = out.get(word, 0) | 1 << k
    return out


def lcs(region: list[int], at: dict[int, int], n: int) -> int:
    """The longest common subsequence of a region and an item of n terms, all of the
    item's terms at once: each bit that falls to 0 is one more term matched."""
    left = full = (1 << n) - 1
    for word in region:
        if here := left & at.get(word, 0):
            left = (left + here | left - here) & full
    return n - left.bit_count()


def close_lcs(region: np.ndarray, item: np.ndarray) -> int:
    """The longest common subsequence within half again the item's length, so that
    words scattered over a long region don't add up to a short item."""
    at, n = masks(item), len(item)
    width, step = min(len(region), -(-3 * n // 2)), max(1, n // 4)
    words, best = region.tolist(), 0
    for s in sorted({*range(0, len(words) - width + 1, step), len(words) - width}):
        if best < n:
            best = max(best, lcs(words[s : s + width], at, n))
    return best


def _lengths(dims: np.ndarray, weights: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The TF-IDF length of each window (a row): the weights of equal terms add up."""
    w, k = np.nonzero(inside & (weights > 0))
    if not len(w):
        return np.zeros(len(dims))
    key = w * DIMS + dims[w, k]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    value = np.add.reduceat(weights[w, k][order].astype(np.float64), first)
    return np.sqrt(np.bincount(key[first] // DIMS, value**2, len(dims)))


def candidates(index: LatentIndex, dims: np.ndarray, of: np.ndarray, begin: np.ndarray, end_of: np.ndarray, p: Params):
    """(first term of the window, block, passage, cosine) arrays of windows near a passage."""
    weight, row = index.weight[dims], index.row[dims]
    starts = np.flatnonzero((np.arange(len(of)) - begin) % p.stride == 0)
    ends = np.minimum(starts + p.window, end_of[starts])

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
        return sums[ends] - sums[starts]

    least = np.sqrt(total(weight.astype(np.float64) ** 2))  # repeated terms only lengthen a window
    cosine, part = (total(np.where(row >= 0, weight * r[row], 0)) for r in index.reach)
    alive = (cosine > 0) & ((cosine >= p.near * least) | (part >= p.near))
    starts, ends = starts[alive], ends[alive]
    scratch = np.full(index.reach.shape[1], -1, dtype=np.int32)
    for first in range(0, len(starts), WINDOWS):
        s, e = starts[first : first + WINDOWS], ends[first : first + WINDOWS]
        spot = s[:, None] + np.arange(p.window)
        inside = spot < e[:, None]
        spot = np.minimum(spot, len(dims) - 1)
        length = _lengths(dims[spot], weight[spot], inside)
        w, k = np.nonzero(inside & (row[spot] >= 0) & (weight[spot] > 0))
        r, v = row[spot[w, k]], weight[spot[w, k]]
        for number, block in enumerate(index.blocks):
            scratch[block.dims] = np.arange(len(block.dims), dtype=np.int32)
            local = scratch[r]
            scratch[block.dims] = -1
            mine = local >= 0
            cosine, part = (np.bincount(w[mine], v[mine] * x[local[mine]], len(s)) for x in block.reach)
            live = (cosine > 0) & ((cosine >= p.near * length) | (part >= p.near))
            mine &= live[w]
            if not mine.any():
                continue
            window, at = np.unique(w[mine], return_index=True)
            vectors = np.add.reduceat(block.basis[local[mine]] * v[mine, None], at)
            product = vectors @ block.latent.T
            near = np.maximum(product / length[window, None], product / block.norm)
            x, q = np.nonzero(near >= p.near)
            if len(x):
                yield s[window[x]], number, q, product[x, q] / length[window[x]]


def search(index: LatentIndex, texts: list[bytes], p: Params) -> list[tuple[int, int, float, float, bool]]:
    """(text, item, cosine, lcs ratio, answer found) of every contaminated pair of a chunk."""
    hashes, of = terms(texts)
    if not len(hashes):
        return []
    edge = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    text = np.searchsorted(edge, np.arange(len(of)), "right") - 1
    begin, end_of = edge[text], edge[text + 1]
    tops: dict[tuple[int, int, int], tuple[float, int]] = {}  # place of an item in a text -> cosine, where the item would begin
    for start, number, passage, cosine in candidates(index, _dims(hashes), of, begin, end_of, p):
        block = index.blocks[number]
        for s, q, c in zip(start.tolist(), passage.tolist(), cosine.tolist(), strict=True):
            item = int(block.item[q])
            first = s - int(block.offset[q])
            key = (int(text[s]), item, first // max(p.stride, len(index.items[item]) // 4))
            if c > tops.get(key, (-1.0, 0))[0]:
                tops[key] = (c, first)
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    for (doc, item, _), (cosine, first) in sorted(tops.items()):
        wanted = index.items[item]
        n, key = len(wanted), (int(of[edge[doc]]), item)
        if key in best and best[key][1] == 1 and best[key][0] >= cosine:
            continue
        spare = p.window + n // 4
        region = hashes[max(int(edge[doc]), first - spare) : min(int(edge[doc + 1]), first + n + spare)]
        if not len(region) or np.isin(wanted, region).sum() < p.lcs_paraphrase * n:
            continue
        ratio = close_lcs(region, wanted) / n
        if ratio < p.lcs_paraphrase:
            continue
        last = wanted[-max(1, n // 4) :]
        answer = lcs(region.tolist(), masks(last), len(last)) >= p.answer * len(last)
        if (ratio >= p.lcs or answer) and (key not in best or (ratio, cosine) > best[key][1::-1]):
            best[key] = (cosine, ratio, answer)
    return [(d, i, t, r, a) for (d, i), (t, r, a) in sorted(best.items())]


def indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, text_col: str, p: Params) -> list:
    """One broadcast index for each BENCHMARK_BYTES of the benchmark."""
    spark = docs.sparkSession
    source = benchmark.select(F.col(item_col).alias("i"), text_bytes(item_text).alias("t"))
    parts = -(-int(source.agg(F.sum(F.length("t"))).first()[0] or 0) // BENCHMARK_BYTES)
    if not parts:
        return []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [terms([t])[0].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["i", "words"])

    weight = idf(*document_frequency(docs, text_col))
    shared = []
    for part in range(parts):
        mine = source.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        rows = mine.mapInArrow(read, f"i {source.schema['i'].dataType.simpleString()}, words binary").orderBy("i", "words").collect()
        index = build_index(spark, [r["i"] for r in rows], [np.frombuffer(bytes(r["words"]), np.uint64) for r in rows], weight, p)
        if index is not None:
            shared.append(spark.sparkContext.broadcast(index))
    return shared


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", params: Params = Params(),
) -> DataFrame:
    """(id, item, cosine, lcs_ratio, answer): each document with each item it leaks.

    Null and empty texts or items match nothing, an empty table on either side
    gives no rows, equal rows are judged one by one, and ties between windows
    keep the longest subsequence, then the highest cosine.
    """
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    id_type = source.schema["id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"id {id_type}, item {item_type}, cosine double, lcs_ratio double, answer boolean"
    out = None
    for shared in indexes(docs, benchmark, item_col, item_text, text_col, params):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for first, last in rolling.chunks(texts):
                    found = search(index, texts[first:last], params)
                    if found:
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array([first + f[0] for f in found])),
                            pa.array([index.ids[f[1]] for f in found]).cast(item_arrow),
                            pa.array([float(f[2]) for f in found]), pa.array([float(f[3]) for f in found]), pa.array([bool(f[4]) for f in found]),
                        ], names=["id", "item", "cosine", "lcs_ratio", "answer"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", params: Params = Params()) -> DataFrame:
    """The documents, with all their columns, that leak no item.

    Null and empty texts leak nothing and stay, as all rows do beside an empty
    benchmark; repeated rows are judged one by one and alike; columns may have any
    names.
    """
    columns = docs.columns
    (text_,) = unused(columns, "__text")
    for shared in indexes(docs, benchmark, item_col, item_text, text_col, params):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = [bytes(t) for t in batch.column(len(columns)).to_pylist()]
                keep = np.ones(len(texts), dtype=bool)
                for first, last in rolling.chunks(texts):
                    for hit in search(index, texts[first:last], params):
                        keep[first + hit[0]] = False
                yield batch.select(list(range(len(columns)))).filter(pa.array(keep))

        docs = docs.withColumn(text_, text_bytes(text_col)).mapInArrow(run, docs.schema)
    return docs
