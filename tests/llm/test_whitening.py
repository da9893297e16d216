from __future__ import annotations

import math

import numpy as np
import pytest

from llm_frames import rows_of
from millrace.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, dim string, n string, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "d", "n", "p") for i, v in rows], SCHEMA)


def brute(rows, components=4):
    """By id, the rows of whole numbers; the fit list; values and components by the plain double solver."""
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centred = np.array([[x - s / n for x, s in zip(row, sums)] for row in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in usable:
        white = (np.array([c - s / n for c, s in zip(x, sums)]) @ vectors) / np.sqrt(values)
        out[i] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), white, values / np.trace(covariance))
    return out


def samples(count=300, width=12, seed=1):
    rng = np.random.default_rng(seed)
    spread = np.linspace(2.0, 0.2, width)
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    points = (rng.normal(size=(count, width)) * spread) @ turn + 0.3
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(points)]


def check(found, want, components=4):
    by_component: dict[int, list] = {}
    for row in found:
        n, deviation, white, explained = want[row.vec_id]
        assert (row.n, row.deviation) == (n, deviation)
        assert row.explained == pytest.approx(explained[row.component - 1], rel=1e-9)
        assert row.identity_error < 1e-9
        by_component.setdefault(row.component, []).append((row.whitened, white[row.component - 1]))
    assert sorted(by_component) == list(range(1, components + 1))
    for pairs in by_component.values():
        got, wanted = map(np.array, zip(*pairs))
        assert min(np.abs(got - wanted).max(), np.abs(got + wanted).max()) < 1e-9


def test_equals_brute_force(spark):
    rows = samples() + [(1000, None), (1001, []), (1002, [float("nan")] + [0.0] * 11), (1003, [None] + [0.0] * 11),
                        (1004, [float("inf")] * 12), (1005, [0.0] * 12), (1005, [0.0] * 12), (1006, [-0.0] * 12)]
    rows += [(2000 + i, rows[3][1]) for i in range(200)]  # one vector very often: fitted once
    found = whitening.whiten(table(spark, rows).repartition(5)).collect()
    want = brute(rows)
    assert len(found) == 4 * (len(rows) - 5)
    check(found, want)


def test_shapes_without_spread(spark):
    assert rows_of(whitening.whiten(table(spark, []))) == []
    assert rows_of(whitening.whiten(table(spark, [(1, None), (2, [])]))) == []
    one = rows_of(whitening.whiten(table(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])))
    assert sorted(one, key=str) == sorted([(i, c, 1, 0, None, 0.0, None) for i in (1, None) for c in (1, 2)], key=str)
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    assert {(row.component, row.whitened is None) for row in line} == {(1, False), (2, True), (3, True)}
    assert all(row.identity_error < 1e-9 for row in line)


def test_the_commonest_length_counts(spark):
    rows = samples(40, 6) + [(100 + i, [1.0, 2.0]) for i in range(30)]
    found = whitening.whiten(table(spark, rows)).collect()
    assert {row.vec_id for row in found} == set(range(40))
    check(found, brute(rows[:40]))


def test_huge_entries(spark):
    rows = [(i, [3e38 * (-1) ** i, float(i), 0.5]) for i in range(6)]
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 18 and {row.deviation for row in found} == {None}
    rows = [(i, [1.5e6 * (-1) ** i, float(i), float(i * i)]) for i in range(6)]
    want = brute(rows, 3)
    assert all(row.deviation == want[row.vec_id][1] for row in whitening.whiten(table(spark, rows)).collect())


def residual(matrix, values, vectors):
    exact, v = matrix.astype(np.longdouble), vectors.astype(np.longdouble)
    size = float(np.abs(values).max())
    apart = np.abs(exact @ v - v * values).max() / size
    return float(apart), float(np.abs(v.T @ v - np.eye(len(matrix))).max())


@pytest.mark.parametrize("values", [
    np.linspace(1, 50, 40),
    np.concatenate([np.full(20, 3.0), np.linspace(5, 6, 20)]),
    np.concatenate([7 + np.arange(10) * 1e-12, 3 + np.arange(10) * 1e-8, [1e-3, 1e-6, 0.0, 0.0]]),
    np.full(12, 2.5),
    10.0 ** -np.arange(0, 16.0),
])
def test_refinement_with_clusters(values):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.eigen(matrix)
    assert np.all(np.diff(found) <= 0)
    apart, skew = residual(matrix, found, vectors)
    assert apart < 3e-15 and skew < 3e-15
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * values.max()


def test_refinement_is_better_than_its_start():
    rng = np.random.default_rng(5)
    half = rng.normal(size=(200, 32))
    matrix = half.T @ half / 200
    start = np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.float64)[:, ::-1]
    _, vectors = whitening.eigen(matrix)
    exact = np.linalg.eigh(matrix)[1][:, ::-1]

    def off(found):
        return max(min(np.abs(a - b).max(), np.abs(a + b).max()) for a, b in zip(found.T, exact.T))

    assert off(vectors) < 1e-12 < 1e-7 < off(start)


def test_query_equals_brute_force(spark, tables):
    rows = [(row.vec_id, row.embedding) for row in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    found = queries.QUERIES["op11_whitening"](spark, tables).collect()
    check(found, brute(rows))
