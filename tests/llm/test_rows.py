"""Operators that judge documents one by one: quality, PII, tokens, language model."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from quern.llm import pii, pseudo, quality, queries, tokens
from quern.llm.common import table
from tests.llm.cases import awkward, empty
from tests.oracle import same

public_tokenizers = pytest.importorskip("public_tokenizers")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),  # noqa: B023
                "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize("alphabet, most", [("ab@.+-0123 (%", 30), ("0123456789 -.+", 40), ("a@.é9", 25)])
def test_pii_equals_patterns(alphabet, most):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))
        assert [s for s in pii.find(text) if s[2] in pii.BASE] == brute_pii(text), text


def test_pii_additions_and_redaction(spark):
    found = pii.find('see https://bob:pw1@host.example/x and iban: DE89370400440532013000 or token = "abc12345xyz"')
    assert [k for _, _, k in found if k in ("url", "account")] == ["url", "account", "account"]
    assert pii.find("an account of the war; the token word; http://plain.example/") == []
    docs = spark.createDataFrame([(1, "mail a.b@c.de now"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("id").collect()] == ["mail <email> now", None]


def test_pii_awkward(spark):
    assert pii.detect(awkward(spark, ["spans", "id", "t"])).count() == 10
    assert pii.detect(empty(spark)).count() == 0


@pytest.mark.parametrize("unit", ["http://", "account ", "+1 +1", "a@", "a.b@c.", "7", "1.1", "4 ", "token=", "ssh://a", "no : "])
def test_pii_time_is_linear(unit):
    text = unit * ((1 << 20) // len(unit))
    began = time.process_time()
    pii.find(text)
    pii.find("account" + " " * len(text))
    assert time.process_time() - began < 4


def test_pii_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op6_anchor_pii(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        base = brute_pii(text)
        told = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x == k for _, _, x in base) for k in pii.BASE]
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith(("url", "account"))] == [x for x in told.split(",") if x]


def test_pii_query_equals_sql(spark, sf_dir):
    same(queries.op6_anchor_pii(spark, sf_dir), queries.oracle_sql()["op6_anchor_pii"], sf_dir)


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["", "   ", "I'm here, it's 1999!", "a<|endoftext|>b<|endoftext|>", "漢字 и кириллица", "x\r\n\r\n y  z\t\t", "ﬀ ① ² ½ª", "\x85a\x1c\x1d", "’s “q” — … €5"]
    texts += ["नमस्ते 😀😀 👩‍👩‍👧", "'s ''s don't 'll'll 're we'd'dx 'sabc 'v", "　x 　 y", "<|endoftext|>", "word " * 60_000, "x" * 100_000]
    texts += ["".join(rng.choice("ab's tred lvm\n\t 1!<|é漢\u2003\u3000") for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    ranges = [(0, 0x24F), (0x300, 0xD7FF), (0xE000, 0x10FFFF), (32, 126)]
    texts += ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(60)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokens.count_tokens(docs, path).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["id"]], add_special_tokens=False)), texts[r["id"]]
        assert r["n_bytes"] == len(texts[r["id"]].encode())


def test_tokens_query_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    want = dict(zip(docs, map(len, library.encode_batch(list(docs.values()), add_special_tokens=False)), strict=True))
    got = queries.op7_pretoken_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len(docs[i].encode()), n, n > 1024) for i, n in want.items()}


def test_tokens_refuse_other_tokenizers():
    with pytest.raises(ValueError):
        tokens.Splitter(public_tokenizers.path("word_bpe_49k.json"))


def test_tokens_awkward(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r["id"]: r["n_tokens"] for r in tokens.count_tokens(awkward(spark, ["n_tokens", "id", "t"]), path).collect()}
    assert got[3] == got[4] == 0
    assert tokens.count_tokens(empty(spark), path).count() == 0


def test_quality_equals_sql(spark, sf_dir):
    same(queries.op8_quality_rules(spark, sf_dir), queries.oracle_sql()["op8_quality_rules"], sf_dir)


def test_quality_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [rng.choice(["\n", " ", "\x0b"]).join(rng.choice("a b c # $x é a|b".split(" ")) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(docs).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(w, w[1:], w[2:]))  # noqa: B905
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_awkward(spark):
    got = quality.judge(awkward(spark, ["n_words", "kept", "__w"]))
    assert got.count() == 10 and quality.judge(empty(spark)).count() == 0
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[3]["n_words"] == 0 and rows[3]["base_failed"] and rows[8]["n_repeat_words"] == 60_000
    assert quality.keep_good(awkward(spark)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_needs_no_python(spark, sf_dir):
    plan = queries.op8_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_language_model_prefers_held_out_text_to_shuffled(spark):
    rng = np.random.default_rng(0)
    sentences = ["the cat sat on a mat and the dog lay by a fire", "we went to the sea and they came to the hill", "one two three four five six seven eight nine ten"]
    made = [" ".join(sentences[i] for i in rng.integers(0, 3, 8)) for _ in range(400)]
    fresh = [" ".join(sentences[i] for i in rng.integers(0, 3, 8)) for _ in range(40)]
    mixed = [" ".join(rng.permutation(t.split())) for t in fresh]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(2)
    counts = pseudo.word_counts(docs)
    frequent = pseudo.vocabulary(counts)
    weights = pseudo.train(docs, frequent, 33_000, p=pseudo.Params(batch=256))
    table = spark.createDataFrame(list(enumerate([*fresh, *mixed])), "doc_id long, text string")
    got = np.array([r["log_likelihood"] / r["n_tokens"] for r in pseudo.score(table, weights, frequent).orderBy("id").collect()])
    assert (got[:40] > got[40:] + 1).all()


def test_language_model_trains_on_every_position(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 9)) for i in range(60)], "doc_id long, text string")

    class Counting(pseudo.Trainer):
        def step(self, *batch):
            super().step(*batch)
            self.m["bias"][:] = self.seen  # the average by positions of one task is its count

    monkeypatch.setattr(pseudo, "Trainer", Counting)
    p, total = pseudo.Params(rounds=1), sum(i % 9 for i in range(60))
    weights = pseudo.train(docs, pseudo.vocabulary(pseudo.word_counts(docs)), total, p=p)
    assert weights["bias"][0] == total


@pytest.mark.parametrize("at_hand", [262_144, 1500, 1])
def test_words_of_a_shared_id_have_probabilities_of_their_own(spark, monkeypatch, at_hand):
    monkeypatch.setattr(pseudo, "AT_HAND", at_hand)  # counts at hand, and counts joined
    monkeypatch.setattr(pseudo, "LEAST_COUNT", 60)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[i : i + 3000 - 30 * k]) for k in range(40) for i in (0, 10 * k)] + ["w5 w2000 x", "w5 w2001 x", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    n = Counter(w for t in texts for w in t.split())
    counts = pseudo.word_counts(docs)
    vocabulary = pseudo.vocabulary(counts)
    assert vocabulary.codes == 4 and len(vocabulary.words) == sum(k >= 60 for k in n.values()) < 3000
    weights = pseudo.train(docs, vocabulary, sum(n.values()))
    plain = {r["id"]: r["log_likelihood"] for r in pseudo.score(docs, weights, vocabulary).collect()}
    got = {r["id"]: r["log_likelihood"] for r in pseudo.score(docs, weights, vocabulary, counts=counts).collect()}
    of = {w: int(pseudo.Encoder(vocabulary).read([w.encode()])[0][0]) for w in n}
    total = Counter()
    for w, k in n.items():
        total[of[w]] += k
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        share = sum(np.log(n[w] / total[of[w]]) for w in t.split() if of[w] >= vocabulary.own)
        assert got[i] - plain[i] == pytest.approx(share, abs=1e-2)


def plain_log_probabilities(m, ids, of, codes):
    """The network, a position at a time."""
    out = []
    for t, i in enumerate(ids):
        z = m["b"].copy()
        for w, step in zip(m["w"], pseudo.OFFSETS, strict=True):
            if 0 <= t + step < len(ids) and of[t + step] == of[t]:
                z = z + w @ m["embed"][:, ids[t + step]]
        x, total, before = m["out"] @ np.tanh(z) + m["bias"], 0.0, 0
        for k in range(codes):
            code = i // 8 ** (codes - 1 - k) % 8
            part = x[8 * k : 8 * k + 8] + (m[f"given{k}"][:, before] if k else 0)
            total += part[code] - np.log(np.exp(part - part.max()).sum()) - part.max()
            before = before * 8 + code
        out.append(total)
    return np.array(out)


@pytest.mark.parametrize("codes", [pseudo.FEW, pseudo.MANY])
def test_log_probabilities_equal_the_network(codes):
    rng = np.random.default_rng(5)
    m = {k: v + rng.standard_normal(v.shape).astype(np.float32) for k, v in pseudo.initial(pseudo.Params(), codes).items()}
    ids, of = rng.integers(0, 8**codes, 300), np.sort(rng.integers(0, 40, 300))
    for step in (4096, 7):
        assert np.allclose(pseudo.log_probabilities(m, ids, of, step), plain_log_probabilities(m, ids, of, codes), atol=1e-3)


@pytest.mark.parametrize("codes", [pseudo.FEW, pseudo.MANY])
def test_language_model_gradients(codes):
    p, rng = pseudo.Params(width=3, hidden=4), np.random.default_rng(1)
    m = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in pseudo.initial(p, codes).items()}
    ids, of = rng.integers(0, 8**codes, 12), np.array([0] * 5 + [1] + [2] * 6)
    ids[3], ids[7] = ids[1], ids[8]  # words met twice

    def loss(first, last):
        return -plain_log_probabilities(m, ids, of, codes)[first:last].mean()

    for first, last, block in ((0, 12, 100), (2, 9, 100), (1, 12, 4)):
        for k, grad in pseudo.gradients(m, ids, of, first, last, block).items():
            for at in (np.unravel_index(np.abs(grad).argmax(), grad.shape), tuple(rng.integers(0, d) for d in grad.shape)):
                m[k][at] += 1e-5
                up = loss(first, last)
                m[k][at] -= 2e-5
                down = loss(first, last)
                m[k][at] += 1e-5
                assert abs((up - down) / 2e-5 - grad[at]) < 1e-6 + 1e-4 * abs(grad[at]), k


def test_encoder_knows_its_words():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.permutation(60_000)]
    data, _ = pseudo.rolling.joined([" ".join(words).encode()])
    hashes = pseudo.rolling.word_hashes(data, *pseudo.rolling.word_spans(data))
    v = pseudo.Vocabulary(hashes[:24_576], pseudo.MANY)
    ids, _, again = pseudo.Encoder(v).read([" ".join(words).encode()])
    assert (ids[:24_576] == np.arange(24_576)).all() and (ids[24_576:] >= v.own).all() and (again == hashes).all()
    assert len(pseudo.Encoder(pseudo.Vocabulary(hashes[:0], 3)).read([b"a b"])[0]) == 2


def test_language_model_awkward(spark):
    got = {r["id"]: r for r in pseudo.pseudo_likelihood(awkward(spark, ["id", "t", "n_tokens"])).collect()}
    assert got[3]["n_tokens"] == 0 and got[3]["log_likelihood"] == 0 and got[1]["log_likelihood"] == pytest.approx(got[2]["log_likelihood"], abs=1e-4)
    assert pseudo.pseudo_likelihood(empty(spark)).count() == 0
