import math

import numpy as np
import pytest

from tessera.llm import whitening
from tessera.llm.whitening import Lanczos

SCHEMA = "vec_id long, embedding array<float>, n long, x string"


def brute(rows, components=4):
    """By the covariance matrix and its eigenvectors; exact deviations."""
    usable = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in usable), default=0)
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v))) for i, v in usable]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in whole:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out.setdefault(i, []).append((deviation, (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)))
    return n, values / np.trace(centred.T @ centred / n), out


def compare(spark, rows, precision=1e-9):
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    n, explained, wanted = brute(rows)
    k = len(explained)
    assert len(found) == k * sum(map(len, wanted.values())) and {r["n"] for r in found} == {n} and {r["component"] for r in found} == set(range(1, k + 1))
    sign = {}
    for r in sorted(found, key=lambda r: (str(r["vec_id"]), r["component"])):
        c = r["component"] - 1
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9
        mine = [(d, w[c]) for d, w in wanted[r["vec_id"]]]
        assert r["deviation"] in [d for d, _ in mine]
        if len(mine) == 1:
            if abs(mine[0][1]) > 1e-6:
                assert sign.setdefault(c, np.sign(mine[0][1] * r["whitened"])) == np.sign(mine[0][1] * r["whitened"])
            assert abs(r["whitened"]) == pytest.approx(abs(mine[0][1]), abs=precision)


def made(draw, n, width, falling=0.7):
    turn = np.linalg.qr(draw.standard_normal((width, width)))[0]
    return (draw.standard_normal((n, width)) * falling ** np.arange(width)) @ turn + draw.standard_normal(width)


def test_equals_brute_force(spark):
    rows = [(int(i), [float(c) for c in v], 7, "clash") for i, v in enumerate(made(np.random.default_rng(1), 400, 24))]
    rows += [(1000 + i, rows[3][1], 7, "copy") for i in range(300)] + [(3, rows[3][1], 7, "again")]
    compare(spark, rows)


def test_the_table(spark, small):
    rows = [(r["vec_id"], r["embedding"], 0, "") for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    compare(spark, rows, 1e-7)


def test_cases(spark):
    """Unusable vectors go, short ones are filled up, ids may be null or repeat."""
    draw = np.random.default_rng(2)
    rows = [(i if i % 9 else None, [float(c) for c in v], 0, None) for i, v in enumerate(made(draw, 60, 6)) if i]
    rows += [(100, None, 0, ""), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, ""), (102, [float("nan")] * 6, 0, ""), (103, [float("-inf")] + [0.0] * 5, 0, ""), (104, [0.5, -0.25], 0, ""), (105, [], 0, ""), (106, [-0.0] * 6, 0, "")]
    compare(spark, rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {100, 101, 102, 103}.isdisjoint({r["vec_id"] for r in whitening.whiten(frame).collect()})
    assert whitening.whiten(frame.limit(0)).collect() == [] and whitening.whiten(frame.where("vec_id = 104")).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(i, [i / 8, 1.0, 2 * i / 8], 0, "") for i in range(20)], SCHEMA)).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 20 and flat[0]["explained"] == pytest.approx(1)
    huge = whitening.whiten(spark.createDataFrame([(0, [3e38, 1.0], 0, ""), (1, [-3e38, 2.0], 0, ""), (2, [0.0, 0.0], 0, "")], SCHEMA)).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 2} == {None} and all(abs(r["whitened"]) < 2 for r in huge)


def test_lanczos_converges_with_restarts_and_breakdowns():
    draw = np.random.default_rng(3)
    for values in (np.linspace(1, 2, 400), np.r_[np.full(5, 3.0), np.linspace(0, 1, 295)], np.r_[[9.0, 8, 7, 6], np.zeros(196)], np.exp(-np.arange(250) / 30.0)):
        turn = np.linalg.qr(draw.standard_normal((len(values), len(values))))[0]
        a = (turn * values) @ turn.T
        solver = Lanczos(lambda block: a @ block, len(values), 4)
        found, vectors = solver.solve()
        assert np.allclose(found, np.sort(values)[::-1][:4], rtol=0, atol=1e-12), solver.passes
        assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-12 and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
        assert solver.passes < whitening.MOST_PASSES
        print(len(values), solver.passes, solver.restarts, solver.breakdowns)
