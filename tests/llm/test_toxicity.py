import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import fold
from tessera.llm.toxicity import Extractor, cleaned


def test_words_are_cleaned():
    wanted = {"Hello,": ("hello", False), "id1ot": ("idiot", True), "m.o.r.o.n!": ("moron", True), "st*pid": ("stpid", True), "self-made": ("selfmade", False), "don't": ("dont", False), "abc12": ("abc", False), "2024": ("", False), "###": ("", False), "ÉTÉ": ("été", False), "$cum": ("cum", False), "l0s3r###": ("loser", True)}
    assert {w: tuple(cleaned(w)) for w in wanted} == wanted


def plain(text, lexicon):
    """The features of a text, counted one by one."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    n = len(words)
    clean = [cleaned(w) for w in words]
    weights = [max([lexicon.get(e, 0.0) for e in toxicity.entries(c.letters)], default=0.0) for c in clean]
    hits = [i for i, w in enumerate(weights) if w >= toxicity.HIT]
    strong = sum(w >= toxicity.STRONG for w in weights)
    you = [i for i, c in enumerate(clean) if c.letters in toxicity.SECOND_PERSON]
    gaps = [min(abs(i - j) for j in you) for i in hits] if you else []
    upper, letters = sum(c.isupper() for w in words for c in w), sum(c.isalpha() for w in words for c in w)
    caps = sum(sum(map(str.isupper, w)) > 1 and all(c.isupper() for c in w if c.isalpha()) for w in words)
    marks = sum(c in toxicity.PUNCTUATION and c not in "!?" for w in words for c in w)
    runs = sum(any(w[i].lower() == w[i + 1].lower() == w[i + 2].lower() and w[i].isalpha() for i in range(len(w) - 2)) for w in words)
    return [
        math.log1p(n), len(hits) / n, sum(weights) / n, max(weights), math.log1p(len(hits)), strong / n, math.log1p(strong), len(you) / n, sum(g <= 3 for g in gaps) / max(len(gaps), 1), 1 / (1 + min(gaps)) if gaps else 0.0,
        caps / n, upper / max(letters, 1), sum(w.count("!") for w in words) / n, sum(w.count("?") for w in words) / n, marks / n, sum("!!" in w or "??" in w or "!?" in w for w in words) / n,
        sum(c.obfuscated for c in clean) / n, sum(clean[i].obfuscated for i in hits) / n, runs / n, letters / n,
    ]


def test_features_equal_plain_counts(spark, small):
    lexicon = {"=idiot": 4.0, "the": 1.6, "er": 9.0, "tion": 2.0, "=you": 1.0}
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000").collect()]
    texts += [None, "", " \n\t", "You are an id1ot!! YOU IDIOT?! sooo bad", "idiot " * 70000 + "you", "!!!", "ÀÉ du Trottel"]
    extractor = Extractor(lexicon)
    for text in texts:
        assert extractor.features(text) == pytest.approx(plain(text, lexicon), rel=1e-5, abs=1e-6), (text or "")[:60]
    assert np.allclose(extractor.features(texts[0]), Extractor(lexicon).features(texts[0]))


def test_trees_and_calibration():
    draw = np.random.default_rng(5)
    x = draw.standard_normal((4000, 5))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * (x[:, 1] > 0.5) * (x[:, 2] > 0))))
    y = (draw.random(4000) < p).astype(float)
    trees = toxicity.grow(x[:2000], y[:2000])
    margins = trees.margins(x[2000:])
    loss = -np.mean(y[2000:] * np.log(1 / (1 + np.exp(-margins))) + (1 - y[2000:]) * np.log(1 - 1 / (1 + np.exp(-margins))))
    best = -np.mean(y[2000:] * np.log(p[2000:]) + (1 - y[2000:]) * np.log(1 - p[2000:]))
    assert loss < best + 0.03
    at, share = toxicity.isotonic(margins, y[2000:])
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all() and 0 <= share.min() <= share.max() <= 1
    # the pools are the best monotone fit: no better one by brute force over few values
    values, kinds = np.array([3.0, 1, 2, 5, 4, 6]), np.array([0.0, 0, 1, 1, 0, 1])
    assert toxicity.isotonic(values, kinds)[1].tolist() == pytest.approx([0, 1 / 3, 1]) and toxicity.isotonic(values, kinds)[0].tolist() == pytest.approx([1, 3, 5.5])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).where(fold("doc_id", 4) == 2).join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("said"), F.avg(F.pow(F.col("score") - F.col("toxic"), 2)).alias("brier"))
    by = {r["toxic"]: r for r in found.collect()}
    assert by[1]["said"] >= 0.9 * by[1]["n"] and by[0]["said"] <= 0.02 * by[0]["n"] and max(r["brier"] for r in by.values()) < 0.1


def test_cases(spark):
    draw = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(400):
        text = " ".join(draw.choices(words, k=draw.randint(5, 60)))
        rows.append((i, f"{text} grumpf you" if i % 4 == 0 else text, 0.5, "clash", int(i % 4 == 0)))
    rows += [(None, "grumpf", 0.1, None, None), (900, None, 0.1, "", None), (901, "", 0.1, "", None), (902, "wab " * 50000 + "grumpf", 0.1, "", None), (0, rows[0][1], 0.5, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string, y int")
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows] + [(4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    said = {r["doc_id"]: r["predicted"] for r in found}
    assert [said[i] for i in range(400)] == [int(i % 4 == 0) for i in range(400)] and said[900] == said[901]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []
    one = toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()
    assert {(r["score"], r["predicted"]) for r in one} == {(1.0, 1)}
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_samples_are_bounded_where_one_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 300)
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    assert toxicity.labelled(docs, labels, F.col("id") < 0, "doc_id", "text", "toxic").count() <= 700
