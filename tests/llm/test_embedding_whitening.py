from fractions import Fraction

import numpy as np
import pytest
from llm_fixtures import SF, ready  # noqa: F401

from attestlake.llm import embedding_whitening as ew
from attestlake.llm.queries import QUERIES


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 30):
        for _ in range(20):
            a = rng.standard_normal((size, size))
            a = a + a.T
            for shift in rng.standard_normal(5) * 3:
                assert ew.count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    hollow = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]])  # needs a pivot of two rows, then is zero
    assert ew.count_above(hollow, 0.0) == 1


@pytest.mark.parametrize(
    "values",
    [
        [5.0, 4.0, 3.0, 2.0, 1.0],
        [1e6, 1e6, 1e6, 1.0],
        [1.0 + 1e-9, 1.0, 1.0 - 1e-9, 0.5, 0.5, 1e-6],
        [3.0] * 6,
        [2.0, 1.0, 0.0, 0.0, 0.0],
        list(np.linspace(1, 1.001, 40)),
        [7.0],
        [10.0**-k for k in range(12)],
    ],
)
def test_eigenpairs(values):
    matrix = symmetric(values)
    want = np.sort(values)[::-1]
    want = want[want > 1e-13 * want[0]]
    found, vectors = ew.leading_eigenpairs(matrix, len(values))
    scale = max(values)
    assert len(found) == len(want)
    assert np.abs(found - want).max() < 1e-13 * scale * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-11
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11 * scale
    few, _ = ew.leading_eigenpairs(matrix, 2)
    assert np.abs(few - want[:2]).max() < 1e-13 * scale * len(values)


def test_nothing_to_find():
    found, vectors = ew.leading_eigenpairs(np.zeros((3, 3)), 2)
    assert found.shape == (0,) and vectors.shape == (3, 0)


def brute(vectors, components):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in x])
    covariance = centred.T @ centred / n
    values, q = np.linalg.eigh(covariance)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    return n, deviations, centred @ q / np.sqrt(values), values / np.trace(covariance)


def test_against_brute_force(ready):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2]) + np.array([0, 100, -3, 0, 1e4, 0.5])
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(i, base[0].tolist()) for i in range(5)]  # repeated
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5), (904, [float("nan")] * 6), (905, [float("-inf")] * 6)]
    bad += [(None, base[1].tolist())]
    frame = ready.createDataFrame([(i, v, 1, 2.0, "c") for i, v in rows + bad], "vec_id bigint, embedding array<double>, deviation int, whitened double, row string")
    n, deviations, whitened, explained = brute([v for _, v in [*rows, bad[-1]]], 4)
    model = ew.fit_whitening(frame, components=4)
    assert model.n == n == 206 and np.allclose(model.explained, explained, rtol=1e-12)
    assert model.identity_error < 1e-10
    found = ew.whiten(frame, model).collect()
    assert len(found) == n and all(r.row.deviation == 1 and r.row.row == "c" for r in found)
    by_value = {tuple(v): (d, w) for v, d, w in zip([v for _, v in rows], deviations, whitened, strict=False)}
    signs = None
    for r in found:
        deviation, want = by_value[tuple(r.row.embedding)]
        got = np.array(r.whitened)
        signs = np.sign(got * want) if signs is None else signs
        assert r.deviation == deviation
        assert np.abs(got * signs - want).max() < 1e-9


def test_edge_tables(ready):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])]):
        assert ew.fit_whitening(ready.createDataFrame(rows, schema)) is None
    model = ew.fit_whitening(ready.createDataFrame([(1, [1.0, 2.0])] * 3, schema))
    assert model.n == 3 and model.explained == []
    assert [r.deviation for r in ew.whiten(ready.createDataFrame([(7, [1.0, 2.0])], schema), model).collect()] == [0]
    large = ready.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id bigint, embedding array<double>")
    model = ew.fit_whitening(large)
    assert model.sums[0] == 3_000_000 and [r.deviation for r in ew.whiten(large, model).collect()][:2] == [None, None]


def test_query(spark):
    rows = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, deviations, whitened, explained = brute(list(vectors.values()), 32)
    place = {v: i for i, v in enumerate(vectors)}
    assert len(rows) == n * whitened.shape[1]
    table = np.zeros_like(whitened)
    for r in rows:
        assert r.n == n and r.deviation == deviations[place[r.vec_id]] and r.identity_error < 1e-10
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
        table[place[r.vec_id], r.component - 1] = r.whitened
    signs = np.sign((table * whitened).sum(0))
    assert np.abs(table * signs - whitened).max() < 1e-8
    assert np.abs(np.cov(table.T, bias=True) - np.eye(table.shape[1])).max() < 1e-9
