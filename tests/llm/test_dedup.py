"""Substring, suffix and SimHash operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import components, queries, rolling, simhash, substring, suffix
from quern.llm.common import table
from tests.llm.cases import awkward, empty
from tests.oracle import same

COPY = "alpha beta gamma delta " * 12


def fixture(spark, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", COPY, COPY, "a " * 200, "x" * 450, " ".join(passage)]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 250))]
        if i % 3 == 0:
            at, cut = rng.randint(0, len(words)), rng.randint(0, 20)
            words[at:at] = passage[cut : cut + rng.randint(30, 45)]
        if i % 10 == 1:
            words = words * 2
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += texts[20:26]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_word_windows(spark):
    docs, texts = fixture(spark)
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    got = {r["id"]: r for r in substring.find_repeats(docs).collect()}
    assert any(r["n_removed"] for r in got.values())
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), sum(gone), kept)
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == sum(gone)


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_byte_windows(spark, hot):
    docs, texts = fixture(spark)
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    got = {r["id"]: r for r in suffix.find_repeats(docs, hot=hot).collect()}
    for i, d in enumerate(data):
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(d), int(gone.sum()))
        assert bytes(got[i]["kept"]) == np.frombuffer(d, np.uint8)[~gone].tobytes()


def thue_morse(bits: int) -> tuple[str, str]:
    """Two strings that collide under any polynomial modulo 2**64 with an odd base."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_adversarial_words_and_bytes_are_told_apart(spark):
    one, two = thue_morse(10)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words[:20], x, *words[20:]])) for i, x in enumerate((one, two))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.find_repeats(docs).collect()] == [0, 0]
    context = "".join(random.Random(1).choices("cdefgh", k=60))
    docs = spark.createDataFrame([(i, context + x + context) for i, x in enumerate((one, two))], "doc_id long, text string")
    for hot in (suffix.HOT, 2):
        got = {r["id"]: r for r in suffix.find_repeats(docs, hot=hot).collect()}
        for i, x in enumerate((one, two)):
            mine, other = (context + x + context).encode(), (context + (two if x == one else one) + context).encode()
            seen = Counter(d[k : k + 200] for d in (mine, other) for k in range(len(d) - 199))
            gone = np.zeros(len(mine), dtype=bool)
            for k in range(len(mine) - 199):
                if seen[mine[k : k + 200]] > 1:
                    gone[k : k + 200] = True
            assert got[i]["n_removed"] == int(gone.sum())


def test_word_hashes_of_any_length():
    rng = random.Random(2)
    words = list({bytes(rng.choices(b"abcdefgh", k=n)) for n in [*range(1, 140)] * 4})
    data, _ = rolling.joined(words)
    found = rolling.word_hashes(data, *rolling.word_spans(data))
    assert len(set(found.tolist())) == len(words)
    again, _ = rolling.joined([b"some", b"other words", *words])
    assert rolling.word_hashes(again, *rolling.word_spans(again))[3:].tolist() == found.tolist()


def test_run_length_index_is_compressed_and_exact():
    rng = random.Random(5)
    for _ in range(40):
        alphabet, w = rng.choice([b"a", b"ab", b"abcd", bytes(range(255))]), rng.choice([3, 5, 9])
        strings = list({bytes(rng.choice(alphabet) for _ in range(rng.randint(w, 40))) for _ in range(rng.randint(1, 30))})
        seen = Counter(s[i : i + w] for s in strings for i in range(len(s) - w + 1))
        for s, starts in zip(strings, suffix.repeated_starts(strings, [False] * len(strings), w), strict=True):
            assert starts.tolist() == [seen[s[i : i + w]] > 1 for i in range(len(s) - w + 1)]
    base = bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    versions = [base[:i] + b"!" + base[i:] for i in range(0, 3000, 100)]
    index = suffix.RunLengthIndex(versions)
    assert index.runs < index.size / 10


def test_fingerprint_contract():
    def plain(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in ["", "One", "One TWO", "A b C d É", COPY, "x " * 5000]:
        assert simhash.fingerprint(text.encode()) == plain(text)


def test_links_lose_nothing(spark):
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            fp = centre
            for _ in range(rng.randint(0, 4)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(signed[i]), find(signed[j])
                parent[max(x, y)] = min(x, y)
    for block in (4096, 4):  # whole keys, and keys cut into blocks
        edges = simhash.links(df, block=block)
        roots = {r["node"]: r["root"] for r in components.connected(edges).collect()}
        assert {x: roots.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_similar_documents(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]

    def resemblance(x, y):
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y))
        return len(a & b) / len(a | b)

    texts, close = [], []
    for _ in range(120):
        one = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        two = list(one)
        for k in rng.sample(range(len(two)), rng.choice([1, 2, 3, 60])):
            two[k] = rng.choice(vocabulary)
        texts += [one, two]
        close.append(resemblance(one, two))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar(docs).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(120)]
    assert all(got[2 * i] == 2 * i for i in range(120))  # nothing links different texts
    near = [x for x, c in zip(linked, close, strict=True) if c >= 0.85]
    assert sum(near) >= 0.95 * len(near) and not any(x for x, c in zip(linked, close, strict=True) if c < 0.4)
    assert simhash.keep_one(docs).count() == 240 - sum(linked)


@pytest.mark.parametrize("least, most, recall", [(0.8, 0.82, 0.93), (0.85, 0.95, 0.99)])
def test_recall_of_pairs_does_not_depend_on_the_corpus(least, most, recall):
    """A pair is linked if it shares a key and differs in few bits: nothing else enters."""
    rng, found, total = random.Random(12), 0, 0
    while total < 400:
        one = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(120, 500))]
        two = list(one)
        for k in rng.sample(range(len(two)), rng.randint(1, 1 + len(two) // 30)):
            two[k] = "other"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (one, two))
        if not least <= len(a & b) / len(a | b) <= most:
            continue
        x, y = (simhash.wide_fingerprint(" ".join(t).encode(), 5) for t in (one, two))
        near = sum((a ^ b).bit_count() for a, b in zip(x[0], y[0], strict=True)) <= simhash.wide_tau(0.8)
        found += near and len(set(x[1].tolist()) & set(y[1].tolist())) > 0
        total += 1
    assert found >= recall * total


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    bits = {}
    for i, text in docs.items():
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
        bits[i] = sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(docs)
    for k, i in enumerate(order):
        for j in order[:k]:
            if (bits[i] ^ bits[j]).bit_count() <= 3:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash_neardup(spark, sf_dir).collect()}
    assert got == {i: (f"{bits[i]:016x}", top(i)) for i in docs}


def test_wide_links_in_blocks(spark):
    rng = random.Random(3)
    centre, rows = rng.getrandbits(128), set()
    for _ in range(90):
        fp = centre
        for _ in range(rng.randint(0, 6)):
            fp ^= 1 << rng.randrange(128)
        rows.add(fp)
    rows = sorted(rows)
    words = np.array([[fp & (2**64 - 1), fp >> 64] for fp in rows], dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(i, int(a), int(b), 5, 6, [7, i % 3]) for i, (a, b) in enumerate(words)], "node long, w0 long, w1 long, w2 long, w3 long, keys array<long>")
    for block in (4096, 8):  # one search, and pairs of blocks
        edges = simhash.wide_links(df, 22, block=block)
        assert {r["root"] for r in components.connected(edges).collect()} == {0}


def test_components(spark):
    rng = random.Random(1)
    for _ in range(50):
        pairs = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(rng.randint(0, 25))]
        root = {}
        for x in sorted({n for p in pairs for n in p}):
            met, todo = {x}, [x]
            while todo:
                at = todo.pop()
                near = {q for p in pairs if at in p for q in p} - met
                met |= near
                todo += near
            root[x] = min(met)
        low, other = components.stars(*(np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1)))
        assert dict(zip(other.tolist(), low.tolist(), strict=True)) == {x: r for x, r in root.items() if x != r}
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (50, 60), (60, 55), (55, 50)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 50: 50, 55: 50, 60: 50}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_awkward(spark):
    rows = simhash.near_duplicates(awkward(spark, ["fp", "component", "id"])).collect()
    assert len(rows) == 10
    of = {}
    for r in rows:
        of.setdefault(r["id"], set()).add(r["component"])
    assert of[1] == of[2] == {1} and of[3] == of[4] == of[5] == {3}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(awkward(spark, ["fp"]))
    assert kept.columns[-1] == "fp" and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 7, 8, 9]
    assert simhash.keep_one(empty(spark)).count() == 0
    tagged = awkward(spark, ["__k", "key"]).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    assert simhash.keep_one(tagged).columns == tagged.columns and simhash.keep_one(tagged).count() == 6


def test_repeats_awkward(spark):
    docs = awkward(spark, ["spans", "kept", "g", "t", "id"])
    got = substring.find_repeats(docs).collect()
    assert len(got) == 10 and {r["id"]: r["n_removed"] for r in got}[8] == 60_000
    got = suffix.find_repeats(docs).collect()
    assert len(got) == 10 and {r["id"]: r["n_removed"] for r in got}[9] == 400
    for op in (substring, suffix):
        assert op.find_repeats(empty(spark)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["op2_anchor_substring_dedup", "op5_run_length_suffix_dedup"])
def test_queries_equal_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)
