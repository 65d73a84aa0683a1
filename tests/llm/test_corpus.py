"""Operators over the whole corpus: sharding, mixing, decontamination and the pipeline."""

import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, queries, sharding, simhash
from quern.llm.common import table
from tests.llm.cases import SCHEMA, awkward, empty
from tests.oracle import same


def test_shards(spark, sf_dir):
    rows = queries.op1_consistent_hash_sharding(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sums, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(text) and max(sums) - min(sums) <= max(len(t.encode()) + 1 for t in text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots)


@pytest.mark.parametrize("shards", [2, 8, 60])
def test_ring_bounds_loads_on_both_sides_and_moves_little(shards):
    rng = random.Random(shards)
    loads = {c: int(rng.lognormvariate(6, 1.2)) + 1 for c in range(sharding.cells_for(shards, 128))}
    before, after = sharding.place(loads, shards), sharding.place(loads, shards + 1)
    for n, home in ((shards, before), (shards + 1, after)):
        held = [sum(loads[c] for c in home if home[c] == s) for s in range(n)]
        mean = sum(loads.values()) / n
        assert max(held) <= 1.0021 * mean and min(held) >= 0.9979 * mean
    moved = sum(loads[c] for c in loads if before[c] != after[c])
    assert moved < (1 / (shards + 1) + 0.12) * sum(loads.values())


def test_ring_with_large_slots_and_too_many_shards():
    loads = {1: 1000, 2: 10, 3: 10, 4: 10}
    home = sharding.place(loads, 3)
    assert set(home) == set(loads) and sharding.place({}, 3) == {}
    with pytest.raises(ValueError):
        sharding.cells_for(5000, 128)


def test_split_slots_keep_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_BYTES", 100)
    monkeypatch.setattr(sharding, "CELLS", 64)
    docs = spark.createDataFrame([(i % 400, f"text {i % 700}") for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(docs, 4, vnodes=8).collect()
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_awkward(spark):
    got = sharding.shard(awkward(spark, ["size", "shard", "__h"]), 3)
    assert got.count() == 10 and sharding.shard(empty(spark), 3).count() == 0


def test_targets_reshare_what_is_above():
    sizes = {"a": 100, "b": 1, "c": 100, None: 50}
    got = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)))
    assert got["b"] == 3 and sum(got.values()) == pytest.approx(251)
    assert got["c"] / got["a"] == pytest.approx(3) and got[None] / got["a"] == pytest.approx(1)


def test_pivot_conserves_mass_and_expectation():
    rng = random.Random(1)
    size = [float(rng.randint(1, 20)) for _ in range(30)]
    start = [s * rng.random() for s in size]
    total = [0.0] * 30
    for _ in range(3000):
        mass = list(start)
        left = mixing.pivot(mass, size, rng.random)
        assert sum(mass) == pytest.approx(sum(start))
        assert all(m in (0.0, s) or i == left for i, (m, s) in enumerate(zip(mass, size, strict=True)))
        total = [t + m for t, m in zip(total, mass, strict=True)]
    assert all(abs(t / 3000 - m) < 0.06 * s for t, m, s in zip(total, start, size, strict=True))


def test_a_large_document_is_settled_against_small_ones():
    rng = random.Random(4)
    size = [5000.0, *sorted((float(rng.randint(20, 200)) for _ in range(200)), reverse=True)]
    start = [s * 0.37 for s in size]
    total = [0.0] * len(size)
    for _ in range(2000):
        mass = list(start)
        left = mixing.pivot(mass, size, rng.random)
        assert sum(mass) == pytest.approx(sum(start)) and (left is None or size[left] <= 100)
        total = [t + m for t, m in zip(total, mass, strict=True)]
    assert all(abs(t / 2000 - m) < 0.05 * s for t, m, s in zip(total, start, size, strict=True))


def plain_targets(sizes):
    """Weights 1, 2, 3 by code point, null last; bisect the words a unit of weight gets."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    low, high = 0.0, float(sum(sizes.values()))
    for _ in range(200):
        unit = (low + high) / 2
        if sum(min(3 * sizes[s], unit * weight[s]) for s in order) < sum(sizes.values()):
            low = unit
        else:
            high = unit
    return {s: min(3 * sizes[s], high * weight[s]) for s in order}


@pytest.mark.parametrize("chunk", [4096, 64])
def test_mix_meets_targets_and_repeats(spark, sf_dir, chunk):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    sf_dir = larger if os.path.isdir(larger) else sf_dir
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs, chunk=chunk, fan_in=2)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, mixing.mix(docs, chunk=chunk, fan_in=2).collect()))
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("copies")).collect()
    assert len(rows) == docs.count()
    words = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()}
    sizes = Counter()
    for source, n in words.values():
        sizes[source] += n
    goal = plain_targets(sizes)
    for r in got.collect():
        assert (r["source"], r["size"]) == words[r["id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in by)
    if min(Counter(s for s, _ in words.values()).values()) >= 50:
        assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in by)
    assert mixing.repeated(docs, got).count() == sum(r["copies"] for r in got.collect())


def test_targets_equal_sql(spark, sf_dir):
    same(queries.mixing_targets(spark, sf_dir), queries.oracle_sql()["mixing_targets"], sf_dir)


def test_mix_awkward(spark):
    docs = awkward(spark, ["size", "key", "key2", "n", "target"]).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    got = mixing.mix(docs)
    assert got.count() == 10 and mixing.mix(empty(spark)).count() == 0
    again = mixing.repeated(docs, got)
    assert again.columns == docs.columns and again.count() == sum(r["copies"] for r in got.collect())


def test_equal_rows_share_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5000 + [(2, "d " * 40, "s"), (3, "e f", "t")], "doc_id long, text string, source string")
    got = mixing.mix(docs, chunk=64).groupBy("id", "source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.first("target").alias("target")).collect()
    rows = {r["id"]: r for r in got}
    assert rows[1]["n"] == 5000 and rows[1]["most"] - rows[1]["least"] <= 1
    assert abs(rows[1]["taken"] + rows[2]["taken"] - rows[1]["target"]) <= 80 and rows[3]["taken"] == 6


def leaky(spark, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(4000)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    items = [prose(rng.randint(14, 60)) for _ in range(40)]
    docs, truth = [], set()
    for d in range(300):
        text = prose(rng.randint(0, 300))
        if d % 4 == 0:
            i = rng.randrange(40)
            copy = list(items[i])
            if d % 8 == 0:  # a paraphrase: some words replaced, never the answer
                for k in rng.sample(range(int(0.7 * len(copy))), max(1, len(copy) // 8)):
                    copy[k] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = copy
            truth.add((d, i))
        docs.append((d, " ".join(text)))
    benchmark = [(i, " ".join(w).capitalize() + ".") for i, w in enumerate(items)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string"), truth


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, benchmark, truth = leaky(spark)
    got = {(r["id"], r["item"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert not got - truth and len(truth - got) <= 0.05 * len(truth)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()) == sorted(set(range(300)) - {d for d, _ in got})


def corpus_index(spark, items, texts, p=decontaminate.Params()):
    df = np.bincount(np.concatenate([np.unique(decontaminate._dims(decontaminate.terms([t])[0])) for t in texts]), minlength=decontaminate.DIMS)
    hashes = [decontaminate.terms([t])[0] for t in items]
    return decontaminate.build_index(spark, list(range(len(items))), hashes, decontaminate.idf(df, len(texts)), p)


def test_no_copy_is_lost_when_passages_are_many(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(9000)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 60))).encode() for _ in range(600)]
    texts = [b" ".join([rng.choice(words).encode() for _ in range(40)] + [t] + [rng.choice(words).encode() for _ in range(40)]) for t in items]
    index = corpus_index(spark, items, texts)
    assert len(index.blocks) > 8
    found = decontaminate.search(index, texts, decontaminate.Params())
    assert {(d, i) for d, i, *_ in found} == {(i, i) for i in range(600)}
    assert all(0 < cosine <= 1.0001 and ratio == 1 for _, _, cosine, ratio, _ in found)


@pytest.mark.parametrize("length", [3, 4, 5, 6, 8, 10, 12, 20, 26, 33, 60, 400])
def test_verbatim_items_of_any_length_are_found(spark, length):
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))) for _ in range(20_000)]
    items = [" ".join(rng.sample(words, length)) for _ in range(40)]
    texts = []
    for k, item in enumerate(items):
        prose = rng.sample(words, 80)
        prose.insert(rng.choice([0, 80, rng.randint(0, 80)]), item)
        texts.append(" ".join(prose).encode())
    texts += [" ".join(rng.sample(words, 80)).encode() for _ in range(200)]
    index = corpus_index(spark, [t.encode() for t in items], texts)
    found = {(d, i) for d, i, *_ in decontaminate.search(index, texts, decontaminate.Params())}
    assert found == {(i, i) for i in range(40)}


def test_paraphrases_are_found(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))) for _ in range(20_000)]
    items = [rng.sample(words, rng.randint(12, 60)) for _ in range(200)]
    texts = []
    for item in items:
        copy = list(item)
        for k in rng.sample(range(int(0.75 * len(copy))), len(copy) // 4):  # a quarter of the words, never the answer
            copy[k] = rng.choice(words)
        texts.append(" ".join([*rng.sample(words, 40), *copy, *rng.sample(words, 40)]).encode())
    index = corpus_index(spark, [" ".join(i).encode() for i in items], texts)
    found = {(d, i) for d, i, *_ in decontaminate.search(index, texts, decontaminate.Params())}
    assert not found - {(i, i) for i in range(200)} and len(found) >= 190


def test_a_repeated_term_has_no_cosine_above_one(spark):
    texts = [b"zeppelin " * 60, b"zeppelin over the quiet harbour town at dawn again", *(f"word{i} other{i} thing{i}".encode() for i in range(100))]
    index = corpus_index(spark, [b"zeppelin over the quiet harbour town at dawn"], texts)
    for *_, cosine in decontaminate.candidates(index, *spots(texts[:1]), decontaminate.Params()):
        assert (cosine <= 1.0001).all()
    assert {d for d, *_ in decontaminate.search(index, texts, decontaminate.Params())} == {1}


def spots(texts):
    hashes, of = decontaminate.terms(texts)
    edge = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    text = np.searchsorted(edge, np.arange(len(of)), "right") - 1
    return decontaminate._dims(hashes), of, edge[text], edge[text + 1]


def test_subsequences_equal_the_plain_table():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randint(1, 6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert decontaminate.lcs(a, decontaminate.masks(np.array(b, dtype=np.int64)), len(b)) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_long_items_and_texts_take_bounded_time(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))) for _ in range(5000)]
    item = " ".join(rng.choice(words) for _ in range(5000))
    texts = [f"{item[:9000]} other {item[9000:]}".encode(), " ".join(rng.choice(words) for _ in range(150_000)).encode()]
    index = corpus_index(spark, [item.encode()], texts + [w.encode() for w in words])
    began = time.process_time()
    assert {d for d, *_ in decontaminate.search(index, texts, decontaminate.Params())} == {0}
    assert time.process_time() - began < 30


def test_scattered_words_are_no_leak(spark):
    words = [f"w{i:03d}" for i in range(400)]
    item = words[:8]
    spread = [x for k, w in enumerate(item) for x in (w, *words[20 + 6 * k : 26 + 6 * k])]
    docs = [(0, " ".join(spread)), (1, " ".join(words[100:130] + item + words[140:160]))] + [(i, " ".join(words[(7 * i) % 300 :][:60])) for i in range(2, 60)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string"))
    assert 0 not in {r["id"] for r in got.collect()} and 1 in {r["id"] for r in got.collect()}


def test_exact_leaks_on_the_test_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    told = docs.alias("d").join(items.withColumnRenamed("text", "it"), F.col("d.text").contains(F.col("it"))).select("doc_id", "item_id")
    got = decontaminate.contaminated(docs, items).select("id", "item")
    assert not set(map(tuple, told.collect())) - set(map(tuple, got.collect()))


def test_randomised_svd_keeps_a_share_of_each_row():
    rng = np.random.default_rng(3)
    dense = rng.standard_normal((90, 6)) @ rng.standard_normal((6, 50)) + 0.01 * rng.standard_normal((90, 50))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    basis = decontaminate.randomised_svd(dense, 0.99)
    assert basis.shape[1] <= 7 and np.linalg.norm(dense @ basis, axis=1).min() >= 0.99
    assert np.linalg.norm(dense @ decontaminate.randomised_svd(dense, 0.99999), axis=1).min() >= 0.99999


def test_decontamination_awkward(spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog lay by the fire"), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.contaminated(awkward(spark, ["id", "t", "__text"]), items).collect()
    assert sorted(r["id"] for r in got) == [1, 1, 2] and {r["item"] for r in got} == {1}
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.contaminated(awkward(spark), items.limit(0)).count() == 0
    assert decontaminate.clean(awkward(spark), items).count() == 7


def near_groups(texts):
    """Components of documents that share a key and differ in few enough bits, by all pairs."""
    made = {i: simhash.wide_fingerprint((t or "").encode(), 5) for i, t in texts.items()}
    root = {i: i for i in made}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    order, tau = sorted(made), simhash.wide_tau(0.8)
    for k, i in enumerate(order):
        for j in order[:k]:
            x, y = made[i], made[j]
            if sum((a ^ b).bit_count() for a, b in zip(x[0], y[0], strict=True)) <= tau and set(x[1].tolist()) & set(y[1].tolist()):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in made}


def test_pipeline_equals_brute_force_stage_by_stage(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}

    good = stages["quality"](spark, docs, sf_dir)
    kept = {r["doc_id"] for r in queries.op8_quality_rules(spark, sf_dir).where("kept").collect()}  # held against SQL elsewhere
    assert good.columns == docs.columns and sorted(map(str, good.collect())) == sorted(str(rows[i]) for i in kept)

    one = stages["near_duplicates"](spark, good, sf_dir)
    groups = near_groups({i: rows[i]["text"] for i in kept})
    kept = {i for i in kept if groups[i] == i}
    assert one.columns == docs.columns and sorted(map(str, one.collect())) == sorted(str(rows[i]) for i in kept)

    clean = stages["decontamination"](spark, one, sf_dir)
    items = [decontaminate.terms([r["text"].encode()])[0] for r in table(spark, sf_dir, "benchmark").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and left <= kept
    for i in kept:
        words = decontaminate.terms([(rows[i]["text"] or "").encode()])[0]
        ratio = max((decontaminate.close_lcs(words, item) / len(item) if len(words) and np.isin(item, words).mean() >= 0.6 else 0.0) for item in items)
        assert i in left if ratio < 0.6 else i not in left if ratio == 1 else True

    mixed = stages["mixing"](spark, clean, sf_dir)
    times, size = Counter(r["doc_id"] for r in mixed.collect()), {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"])) for i in left}
    total = Counter()
    for i in left:
        total[rows[i]["source"]] += size[i]
    for source, goal in plain_targets(total).items():
        mine = [i for i in left if rows[i]["source"] == source]
        assert abs(sum(times[i] * size[i] for i in mine) - goal) <= max(size[i] for i in mine)
    assert mixed.columns == docs.columns and max(times.values()) <= 3 and set(times) <= left

    done = stages["sharding"](spark, mixed, sf_dir).collect()
    assert Counter(r["doc_id"] for r in done) == times
    slots = [sorted(r["slot"] for r in done if r["shard"] == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in slots)
    for r in done:
        data = rows[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data)) and r["text"] == rows[r["doc_id"]]["text"]
    assert corpus_pipeline.run(spark, sf_dir).count() == len(done)


def test_pipeline_awkward(spark, sf_dir):
    import corpus_pipeline

    rich = " ".join(f"the word{i} of page{i * 7} and some more of it" for i in range(40))
    extra = spark.createDataFrame([(50, rich, "en", None, 9), (50, rich, "en", None, 9), (None, rich + " end", "en", "s9", 9)], SCHEMA)
    for docs in (awkward(spark).union(extra), empty(spark)):
        docs = docs.withColumns({"__k": F.lit(1), "__own": F.lit("x"), "key": F.lit(2), "n_words": F.lit(3), "tags": F.create_map(F.lit("a"), F.col("doc_id"))})
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            docs = out
        assert docs.count() in (0, *range(1, 10))
