"""Masked pseudo-likelihood scores from a bidirectional window network.

The vocabulary comes from word counts over the whole corpus: frequent words have
ids of their own, the others share hashed ids.  An id is three to five codes of eight
values, as many as the counted words need.  The network reads the two words on
either side of a masked position and predicts the codes of the word between, each
given those before it, so its softmaxes stay small.  Neighbours are shifts of one
row of words, so each word is read once for all positions that see it.  It is written and trained
in numpy: in each round every task trains on its share of the documents from the
same weights, and the weights are averaged by the number of positions in a tree.
A document's score is the sum of its words' conditional log-probabilities; a shared
id's probability is split among its words by their counts in the corpus, which are
joined in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import rolling
from quern.llm.common import checkpoint, parts_for, text_bytes

#: Values of a code, and how many codes an id has.
CODE, FEW, MANY = 8, 3, 5
#: Counts from which a word gets an id of its own, while there are ids.
LEAST_COUNT = 4
#: Words whose counts workers have at hand, the most frequent ones; those of all others are joined.
AT_HAND = 262_144
#: Positions whose arrays are made at once.
BLOCK = 16_384
#: Positions that one task trains on in all: the weights it sends are small beside their text.
TASK_POSITIONS = 4 << 20
FAN_IN = 32
OFFSETS = (-2, -1, 1, 2)


@dataclass(frozen=True)
class Vocabulary:
    """The hashes of words with ids of their own, by rank, and the number of codes of an id."""

    words: np.ndarray
    codes: int

    @property
    def ids(self) -> int:
        return CODE**self.codes

    @property
    def own(self) -> int:
        """Ids of single words; the other quarter is shared by hash."""
        return self.ids * 3 // 4


@dataclass(frozen=True)
class Params:
    width: int = 8
    hidden: int = 16
    rate: float = 0.1
    batch: int = 16384
    rounds: int = 2
    seed: int = 11


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): 64-bit word hashes and their counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in rolling.chunks(texts, 4 << 20):
                data, _ = rolling.joined(texts[first:last])
                words, n = np.unique(rolling.word_hashes(data, *rolling.word_spans(data)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(text_bytes(text_col).alias("t")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """A count that at most so many words reach, from the words in each sixteenth of a power of two."""
    step = F.floor(F.log2("n") * 16)
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.max("n").alias("most")).collect()  # at most 1,024
    met, least = 0, 1
    for r in sorted(rows, key=lambda r: -r["step"]):
        met += r["words"]
        if met > most:
            least = r["most"] + 1
            break
    return least


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words by falling count, ties by hash: all of LEAST_COUNT or more, as far as there are ids
    for all words of a count."""
    least = max(LEAST_COUNT, least_count(counts, CODE**MANY * 3 // 4))
    rows = counts.where(F.col("n") >= least).collect()  # at most 24,576, with nothing sorted in one place
    codes = next((k for k in range(FEW, MANY) if CODE**k * 3 // 4 >= len(rows)), MANY)
    words = [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]
    return Vocabulary(np.array(words, dtype=np.int64).view(np.uint64), codes)


def initial(p: Params, codes: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)

    out = {
        "embed": (0.1 * rng.standard_normal((p.width, CODE**codes))).astype(np.float32),
        "w": normal(len(OFFSETS), p.hidden, p.width), "b": np.zeros(p.hidden, np.float32),
        "out": normal(CODE * codes, p.hidden), "bias": np.zeros(CODE * codes, np.float32),
    }
    # What the codes before a code add to it.
    return out | {f"given{k}": np.zeros((CODE, CODE**k), np.float32) for k in range(1, codes)}


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32).copy()
        at += like[k].size
    return out


class Finder:
    """Places of 64-bit hashes in an array of distinct ones."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        # By the top bits of a hash the only word there, or -1 for none, -2 for several.
        self.place = np.full(1 << bits, -1, dtype=np.int32)
        top, at, n = np.unique(words >> self.shift, return_index=True, return_counts=True)
        self.place[top.astype(np.int64)] = np.where(n == 1, at, -2)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """The place of each word, -1 if it isn't there."""
        out = self.place.take((words >> self.shift).astype(np.int64)).astype(np.int64)
        alone = np.flatnonzero(out >= 0)
        out[alone[self.words.take(out[alone]) != words[alone]]] = -1
        if len(some := np.flatnonzero(out == -2)):
            near = np.minimum(np.searchsorted(self.sorted, words[some]), len(self.sorted) - 1)
            out[some] = np.where(self.sorted[near] == words[some], self.order[near], -1)
        return out


class Encoder:
    """Word ids of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.find = vocabulary, Finder(vocabulary.words, 20)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id of each word, the text it belongs to, and its hash."""
        data, starts = rolling.joined(texts)
        s, e = rolling.word_spans(data)
        words = rolling.word_hashes(data, s, e)
        at = self.find(words)
        out = np.where(at >= 0, at, (self.v.own + words % np.uint64(self.v.ids - self.v.own)).astype(np.int64))
        return out, (np.searchsorted(starts, s, "right") - 1).astype(np.int32), words


def neighbours(of: np.ndarray) -> list[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """For each offset the positions and their neighbours, as slices, and the pairs among
    them that lie in different texts."""
    out = []
    for step in OFFSETS:
        here, there = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
        apart = np.flatnonzero(of[here] != of[there])
        out.append((here, there, apart + (here.start or 0), apart + (there.start or 0)))
    return out


def forward(m: dict[str, np.ndarray], ids: np.ndarray, of: np.ndarray):
    """Of every position: the embedding, the hidden layer, and for each code its exponents,
    the largest 0, the codes before it as one number, and its value.  A neighbour that
    is missing adds nothing."""
    codes, near = len(m["bias"]) // CODE, neighbours(of)
    g = m["embed"].take(ids, axis=1)
    h = np.repeat(m["b"][:, None], len(ids), axis=1)
    for w, (here, there, a, b) in zip(m["w"], near, strict=True):
        part = w @ g
        h[:, here] += part[:, there]
        h[:, a] -= part[:, b]
    np.tanh(h, out=h)
    x = (m["out"] @ h).reshape(codes, CODE, -1)
    x += m["bias"].reshape(codes, CODE, 1)
    before = [ids // CODE ** (codes - k) for k in range(codes)]
    for k in range(1, codes):
        x[k] += m[f"given{k}"].take(before[k], axis=1)
    x -= x.max(axis=1, keepdims=True)
    return g, near, h, x, before, np.stack([ids // CODE ** (codes - 1 - k) % CODE for k in range(codes)])


def log_probabilities(m: dict[str, np.ndarray], ids: np.ndarray, of: np.ndarray, step: int = BLOCK) -> np.ndarray:
    """Of each word given its neighbours in its text."""
    out = np.zeros(len(ids))
    for first in range(0, len(ids), step):
        a, b = max(0, first - 2), min(len(ids), first + step + 2)  # with the neighbours of the outermost
        *_, x, _, code = forward(m, ids[a:b], of[a:b])
        got = np.take_along_axis(x, code[:, None], axis=1).sum(axis=(0, 1))
        got -= np.log(np.exp(x, out=x).sum(axis=1)).sum(axis=0)
        out[first : first + step] = got[first - a : first - a + step]
    return out


def gradients(m: dict[str, np.ndarray], ids: np.ndarray, of: np.ndarray, first: int = 0, last: int | None = None, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability of the positions from ``first`` to ``last``."""
    last = len(ids) if last is None else last
    codes = len(m["bias"]) // CODE
    errors = np.empty((codes, CODE, last - first), dtype=m["bias"].dtype)
    back = np.zeros((len(m["embed"]), len(ids)), dtype=m["bias"].dtype)
    out = {k: np.zeros_like(m[k]) for k in ("out", "bias", "b", "w")}
    for start in range(first, last, block):
        stop = min(start + block, last)
        low, high = max(0, start - 2), min(len(ids), stop + 2)  # with the neighbours of the outermost
        g, near, h, d, _, code = forward(m, ids[low:high], of[low:high])
        np.exp(d, out=d)
        d /= d.sum(axis=1, keepdims=True)
        flat = d.reshape(-1, high - low)
        flat[code + CODE * np.arange(codes)[:, None], np.arange(high - low)] -= 1
        flat[:, : start - low] = 0
        flat[:, stop - low :] = 0
        errors[:, :, start - first : stop - first] = d[:, :, start - low : stop - low]
        dz = m["out"].T @ flat
        dz *= 1 - h * h
        out["out"] += flat @ h.T
        out["bias"] += flat.sum(axis=1)
        out["b"] += dz.sum(axis=1)
        dg = back[:, low:high]
        for k, (here, there, a, b) in enumerate(near):
            part = m["w"][k].T @ dz
            dg[:, there] += part[:, here]
            dg[:, b] -= part[:, a]
            out["w"][k] += dz[:, here] @ g[:, there].T - dz[:, a] @ g[:, b].T
    for k in range(1, codes):
        before = ids[first:last] // CODE ** (codes - k)
        out[f"given{k}"] = np.stack([np.bincount(before, row, CODE**k) for row in errors[k]])
    out["embed"] = np.stack([np.bincount(ids, row, m["embed"].shape[1]) for row in back])
    return {k: (v / (last - first)).astype(m[k].dtype) for k, v in out.items()}


class Trainer:
    """Adagrad on batches of positions."""

    def __init__(self, weights: dict[str, np.ndarray], p: Params):
        self.m, self.p, self.seen = weights, p, 0
        self.square = {k: np.full_like(v, 1e-8) for k, v in weights.items()}

    def learn(self, ids: np.ndarray, of: np.ndarray) -> None:
        """Every position once, a batch at a time, with the neighbours of its outermost."""
        for first in range(0, len(ids), self.p.batch):
            last = min(first + self.p.batch, len(ids))
            a, b = max(0, first - 2), min(len(ids), last + 2)
            self.step(ids[a:b], of[a:b], first - a, last - a)

    def step(self, ids: np.ndarray, of: np.ndarray, first: int, last: int) -> None:
        for k, g in gradients(self.m, ids, of, first, last).items():
            self.square[k] += g * g
            g /= np.sqrt(self.square[k])
            g *= self.p.rate
            self.m[k] -= g
        self.seen += last - first


def train(docs: DataFrame, words: Vocabulary, tokens: int, text_col: str = "text", p: Params = Params()) -> dict[str, np.ndarray]:
    """Weights trained on every position of every document, one share of the documents in each round.

    ``tokens`` is the number of words of the corpus; one task trains on TASK_POSITIONS
    of them, as near as the partitions of the input allow.  Null and empty texts
    teach nothing; without any text the weights stay as they were; repeated rows
    teach as often as they come.
    """
    spark = docs.sparkSession
    weights = initial(p, words.codes)
    like = {k: v for k, v in weights.items()}
    share = F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(p.rounds))
    tasks = parts_for(tokens, TASK_POSITIONS)
    for turn in range(p.rounds):
        shared = spark.sparkContext.broadcast((pack(weights), words))

        def fit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            flat, words = shared.value
            trainer, encoder = Trainer(unpack(flat, like), p), Encoder(words)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for first, last in rolling.chunks(texts):
                    trainer.learn(*encoder.read(texts[first:last])[:2])
            if trainer.seen:
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([TaskContext.get().partitionId() // FAN_IN], pa.int32()), "n": pa.array([trainer.seen], pa.int64()),
                    "w": pa.array([pack(trainer.m).astype(np.float32).tobytes()], pa.binary()),
                })

        def average(group: pa.Table) -> pa.Table:
            n = group.column("n").to_pylist()
            mean = sum(np.frombuffer(b.as_buffer(), np.float32) * (k / sum(n)) for b, k in zip(group.column("w"), n, strict=True))
            return pa.table({
                "part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int32()), "n": pa.array([sum(n)], pa.int64()),
                "w": pa.array([mean.astype(np.float32).tobytes()], pa.binary()),
            })

        schema = "part int, n long, w binary"
        parts = docs.where(share == turn).select(text_bytes(text_col).alias("t")).coalesce(tasks).mapInArrow(fit, schema)
        parts, left = parts.groupBy("part").applyInArrow(average, schema), -(-tasks // FAN_IN)
        while left > 1:
            parts, left = parts.groupBy("part").applyInArrow(average, schema), -(-left // FAN_IN)
        rows = parts.collect()
        shared.unpersist()
        if rows:
            weights = unpack(np.frombuffer(bytes(rows[0]["w"]), np.float32), like)
    return weights


class Shares:
    """What the counts say of a word's share of its id."""

    def __init__(self, own: int, words: np.ndarray, n: np.ndarray, totals: np.ndarray):
        self.own, self.find, self.log_n = own, Finder(words, 22), np.log(np.append(n, 1))
        self.log_total = np.log(np.maximum(totals, 1))  # of each shared id

    def __call__(self, ids: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log of each word's share, and whether the log of its count is still to be added."""
        out, wanting = np.zeros(len(ids)), np.zeros(len(ids), dtype=bool)
        shared = np.flatnonzero(ids >= self.own)
        at = self.find(words[shared])
        out[shared] = self.log_n[at] - self.log_total[ids[shared] - self.own]  # place -1 adds log 1
        wanting[shared] = at < 0
        return out, wanting


def shares(counts: DataFrame, vocabulary: Vocabulary) -> Shares:
    top = counts.where(F.col("n") >= least_count(counts, AT_HAND)).toPandas()  # at most AT_HAND
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    own = np.isin(words, vocabulary.words)
    totals = np.zeros(vocabulary.ids - vocabulary.own, dtype=np.int64)
    # The number of shared ids divides 2**64, so the sign of a hash doesn't matter.
    for r in counts.groupBy(F.pmod("word", F.lit(len(totals))).alias("id")).agg(F.sum("n").alias("n")).collect():
        totals[r["id"]] = r["n"]
    frequent = pa.table({"word": pa.array(vocabulary.words.view(np.int64), pa.int64())})
    known = counts.join(F.broadcast(counts.sparkSession.createDataFrame(frequent)), "word", "left_semi")  # at most 24,576
    for r in known.groupBy(F.pmod("word", F.lit(len(totals))).alias("id")).agg(F.sum("n").alias("n")).collect():
        totals[r["id"]] -= r["n"]
    return Shares(vocabulary.own, words[~own], n[~own], totals)


def score(
    docs: DataFrame, weights: dict[str, np.ndarray], words: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
    counts: DataFrame | None = None,
) -> DataFrame:
    """(id, n_tokens, log_likelihood) of every document under a trained network.

    With the ``counts`` of the corpus each word of a shared id has a probability of its
    own; without them it has that of the id.
    Null and empty texts have no tokens and score 0; equal rows score alike, but for
    the last bits of single precision; an empty table gives no rows; extra columns are not read.
    """
    like = {k: v for k, v in weights.items()}
    shared = docs.sparkSession.sparkContext.broadcast((pack(weights), words, None if counts is None else shares(counts, words)))
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, own, share = shared.value
        m, encoder = unpack(flat, like), Encoder(own)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total = np.zeros(len(texts), dtype=np.float64)
            count = np.zeros(len(texts), dtype=np.int64)
            rare = [np.zeros(0, dtype=np.int64)]
            ends = np.zeros(len(texts) + 1, dtype=np.int32)
            for first, last in rolling.chunks(texts):
                ids, of, words = encoder.read(texts[first:last])
                n = last - first
                count[first:last] = np.bincount(of, minlength=n)
                total[first:last] += np.bincount(of, weights=log_probabilities(m, ids, of), minlength=n)
                if share is not None:
                    logs, wanting = share(ids, words)
                    total[first:last] += np.bincount(of, weights=logs, minlength=n)
                    rare.append(words[wanting].view(np.int64))
                    ends[first + 1 : last + 1] = np.bincount(of[wanting], minlength=n)
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(len(texts))), batch.column(0), pa.array(count), pa.array(total),
                pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(np.concatenate(rare))),
            ], names=["row", "id", "n_tokens", "log_likelihood", "rare"])
            row += len(texts)

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"row long, id {kind}, n_tokens long, log_likelihood double, rare array<long>")
    if counts is None:
        return out.select("id", "n_tokens", "log_likelihood")
    out = checkpoint(out)
    # Whole billionths add up to the same sum in any order.
    logs = counts.select("word", F.round(F.log("n") * 1e9).cast("long").alias("log_n"))
    added = (
        out.select("row", F.explode("rare").alias("word")).join(logs, "word")
        .groupBy("row").agg((F.sum("log_n") / 1e9).alias("added"))
    )
    whole = F.col("log_likelihood") + F.coalesce("added", F.lit(0.0))
    return out.select("row", "id", "n_tokens", "log_likelihood").join(added, "row", "left").select("id", "n_tokens", whole.alias("log_likelihood"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id, n_tokens, log_likelihood) under a network trained on the same documents.

    Null and empty texts have no tokens and log-likelihood 0; an empty table gives
    no rows; repeated rows are scored one by one and alike, but for the last bits of
    single precision; extra columns are not read.
    """
    counts = checkpoint(word_counts(docs, text_col))
    tokens = int(counts.agg(F.sum("n")).first()[0] or 0)
    words = vocabulary(counts)
    return score(docs, train(docs, words, tokens, text_col, p), words, id_col, text_col, counts)
