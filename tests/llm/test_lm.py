import collections
import math
import zlib

import numpy as np
import pytest

from tessera.llm import gru, lm


def words(text):
    return (text or "").encode().lower().split()


def brute(rows):
    """Base values of (id, text) rows."""
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for t in learned for w in words(t))
    counts[None] = len(learned)
    n, v = sum(counts.values()), len([c for c in counts.values() if c])
    out = {}
    for i, t in rows:
        own = [*words(t), None]
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    return out


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_base_equals_brute_force(spark, small, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    wanted = brute([tuple(r) for r in docs.collect()])
    found = lm.score_documents(docs).collect()
    assert len(found) == len(wanted)
    for r in found:
        held, n, known, total, base = wanted[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_the_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r for r in lm.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.91 * sum(r["base_score"] for r in out)


def test_gradients():
    rng = np.random.default_rng(0)
    m = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in gru.initial(np.log(rng.random(gru.VOCABULARY) + 0.1)).items()}
    x, y, h = rng.integers(0, gru.VOCABULARY, (5, 3)), rng.integers(0, gru.VOCABULARY, (5, 3)), np.zeros((3, gru.HIDDEN))
    x[2, 1] = 0
    g, _, _ = gru.gradients(m, x, y, h)
    w = int(y[1, 1])
    c = int(gru.CLASS_OF[w])
    rows, values = g["input"]
    g["input"] = np.zeros_like(m["input"])
    g["input"][rows] = values
    for name, at in (("input", (int(x[0, 0]), 7)), ("input", (int(x[1, 2]), gru.HIDDEN + 3)), ("input", (int(x[3, 1]), 1)), ("class", (c, 4)), ("word", (w, 2)), ("word", (w, gru.HIDDEN)), ("class", (c, gru.HIDDEN))):
        own = m[name][at]
        m[name][at] = own + 1e-4
        up = gru.gradients(m, x, y, h)[2]
        m[name][at] = own - 1e-4
        down = gru.gradients(m, x, y, h)[2]
        m[name][at] = own
        assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=2e-5)


def test_probabilities_sum_to_one_and_state_is_carried():
    rng = np.random.default_rng(1)
    m = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in gru.initial(np.log(rng.random(gru.VOCABULARY) + 0.1)).items()}
    state = rng.normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    every = gru.log_probabilities(m, np.repeat(state, gru.VOCABULARY, 0), np.arange(gru.VOCABULARY))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    documents = [np.append(rng.integers(1, gru.VOCABULARY, n), 0).astype(np.int16) for n in (0, 1, 5, 64, 65, 300, 1000)]
    together = gru.score(m, documents)
    for d, s in zip(documents, together):
        h, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for before, word in zip([0, *d[:-1]], d):
            h = one_step(m, before, h)
            total += float(gru.log_probabilities(m, h, np.array([word]))[0])
        assert s == pytest.approx(total, rel=1e-4)


def one_step(m, symbol, h):
    row = m["input"][symbol].astype(np.float64)
    z, new = 1 / (1 + np.exp(-row[: gru.HIDDEN])), np.tanh(row[gru.HIDDEN :])
    return ((1 - z) * h * (symbol != 0) + z * new).astype(np.float32)


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_the_model_learns_from_every_training_document(spark, monkeypatch):
    weights, own = [], lm.averaged

    def spy(models):
        weights.extend(r["weight"] for r in models.select("weight").collect())
        return own(models)

    monkeypatch.setattr(lm, "averaged", spy)
    monkeypatch.setattr(lm, "TRAINER_BYTES", 400)
    texts = [(i if i % 10 else None, f"word{i} and more") for i in range(300)]
    lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sum(weights) == 4 * sum(not is_held_out(i) for i, _ in texts) and len(weights) >= 2 * lm.ROUNDS


@pytest.mark.parametrize("head", [1 << 18, 0])
def test_scores_equal_brute_force(spark, small, monkeypatch, head):
    """Each document on its own, token by token, with the model that the operator trained."""
    models, own = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *rest: models.append(own(*rest)) or models[-1])
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60).collect()] + [(-1, None), (-2, ""), (-3, "never seen" * 3), (None, "no id")]
    found = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    m = models[0]
    counts = collections.Counter(w for i, t in docs if not is_held_out(i) for w in words(t))
    total = sum(counts.values()) + sum(not is_held_out(i) for i, _ in docs)
    base = lambda w: math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 2)))
    kind = lambda w: ("kind", 1 + zlib.crc32(w[-3:]) % 1023)
    vocabulary = sorted(counts, key=lambda w: (-counts[w], w))[: (gru.VOCABULARY - lm.FIRST) if head else 0]
    kinds = [("kind", k) for k in range(1, lm.FIRST)]
    mass, often = {k: 10 ** base("unseen") for k in kinds}, collections.Counter({k: 0 for k in kinds})
    for w in counts.keys() - set(vocabulary):
        mass[kind(w)] += 10 ** base(w)
        often[kind(w)] += counts[w]
    symbols = [*kinds, *vocabulary]
    often.update({w: counts[w] for w in vocabulary})
    number = {s: n for n, s in enumerate(sorted(symbols, key=lambda s: -often[s]), 1)}
    for i, text in docs:
        h, at, score = np.zeros((1, gru.HIDDEN), np.float32), 0, 0.0
        for w in [*words(text), None]:
            h = one_step(m, at, h)
            at = 0 if w is None else number.get(w) or number[kind(w)]
            score += float(gru.log_probabilities(m, h, np.array([at]))[0]) / math.log(10)
            if w is not None and w not in number:
                score += base(w) - math.log10(mass[kind(w)])
        assert found[i]["score"] == pytest.approx(score, rel=1e-4), i


def test_equally_frequent_words_at_the_edge_of_the_vocabulary(spark, monkeypatch):
    """The lesser words in bytes come first, however the rows are dealt."""
    monkeypatch.setattr(lm, "HEAD_WORDS", 1 << 18)
    rows = [(i, f"w{i:05d}") for i in range(400)]
    a, b = ({r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(x, "doc_id long, text string").repartition(n)).collect()} for x, n in ((rows, 3), (rows[::-1], 5)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)


def test_models_are_averaged(spark):
    rng = np.random.default_rng(3)
    models = [gru.initial(np.log(rng.random(gru.VOCABULARY) + 0.1), seed=i) for i in range(5)]
    rows = [(float(i + 1), bytearray(gru.pack(m))) for i, m in enumerate(models)]
    found = gru.unpack(lm.averaged(spark.createDataFrame(rows, "weight double, model binary")))
    for name in gru.SHAPES:
        assert np.allclose(found[name], sum((i + 1) * m[name] for i, m in enumerate(models)) / 15, atol=1e-5)


def test_cases(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "Hello hello WORLD", None), (3, "Hello hello WORLD", 2.0), (4, "zz " * 40000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = lm.score_documents(docs).collect()
    assert len(found) == 5 and {r["n_tokens"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert all(math.isfinite(r["score"]) for r in found)
    assert lm.score_documents(docs.limit(0)).collect() == []
