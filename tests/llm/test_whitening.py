"""Whitening against eigenvectors from numpy, and the edge cases of the vectors."""

import math

import numpy as np
import pytest

from stagewise.llm import whitening
from stagewise.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, width int, n string, place int, cell int, value int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 1, 1, 1) for i, v in rows], SCHEMA).repartition(3)


def expected(rows, components=8):
    fit = [(i, [float(np.float32(c)) for c in v]) for i, v in rows
           if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in fit], dtype=object)
    n, total = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, total))) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, total)] for row in x])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    kept = min(components, int((e > 1e-12 * e[0]).sum()))
    return [i for i, _ in fit], deviation, centred @ v[:, :kept] / np.sqrt(e[:kept]), e / e.sum()


def compare(df, rows, tolerance=1e-6):
    ids, deviation, white, explained = expected(rows)
    got = sorted(df.collect(), key=lambda r: (r.component, r.deviation, r.vec_id))
    kept = white.shape[1]
    assert len(got) == len(ids) * kept
    order = sorted(range(len(ids)), key=lambda i: (deviation[i], ids[i]))
    out = np.array([r.whitened for r in got]).reshape(kept, -1).T
    want = white[order]
    for j in range(kept):
        sign = np.sign(out[np.abs(want[:, j]).argmax(), j] * want[np.abs(want[:, j]).argmax(), j])
        np.testing.assert_allclose(out[:, j] * sign, want[:, j], atol=tolerance)
    assert [r.component for r in got] == [j for j in range(1, kept + 1) for _ in order]
    assert [r.deviation for r in got] == [deviation[i] for i in order] * kept
    assert [r.vec_id for r in got] == [ids[i] for i in order] * kept
    assert {r.n for r in got} == {len(ids)}
    for r in got:
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-6)
        assert r.identity_error <= 1e-6
    assert len({r.identity_error for r in got}) == 1


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(12, 12)) * np.logspace(0, -3, 12)[:, None]
    data = rng.normal(size=(300, 12)) @ mix + 5
    rows = [(i, data[i].astype(np.float32).tolist()) for i in range(300)]
    return rows + [rows[4], rows[4], (7, rows[9][1])]


def test_against_eigenvectors(spark, vectors):
    compare(whitening.whiten(table(spark, vectors)), vectors)


def test_vectors_that_take_no_part(spark, vectors):
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [1.0] * 11 + [None]),
           (904, [1.0] * 11 + [float("nan")]), (905, [float("-inf")] + [1.0] * 11)]
    compare(whitening.whiten(table(spark, vectors + bad)), vectors)
    short = [(906, [1.0, 2.0]), (907, [3.0])]
    compare(whitening.whiten(table(spark, vectors + short)), vectors)


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-3000, 3000, (200, 3)) / 1024
    data = np.c_[base, base[:, 0] + base[:, 1], np.full(200, 2.0)]
    rows = [(i, data[i].tolist()) for i in range(200)]
    df = whitening.whiten(table(spark, rows))
    assert df.where("component > 3").count() == 0
    compare(df, rows)


def test_widely_spread_extents(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(400, 6)) * [1e3, 1e2, 10, 1, 0.1, 0.02]
    rows = [(i, data[i].astype(np.float32).tolist()) for i in range(400)]
    compare(whitening.whiten(table(spark, rows)), rows, 1e-5)


def test_no_extent(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9, [(1, None)]):
        assert whitening.whiten(table(spark, rows)).collect() == []


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[2 ** 40, 3], [5, -2 ** 40]], np.int64)
    total = [int(c) for c in x.sum(0)]
    assert whitening.deviations(x, 2, total) == [None, None]
    x = np.array([[2 ** 30, 3], [5, 9]], np.int64)
    total = [int(c) for c in x.sum(0)]
    want = [sum((2 * int(a) - s) ** 2 for a, s in zip(row, total)) for row in x]
    assert whitening.deviations(x, 2, total) == want


def test_triangular_solve():
    rng = np.random.default_rng(2)
    r = np.triu(rng.normal(size=(70, 70))) + 9 * np.eye(70)
    a = rng.normal(size=(11, 70))
    np.testing.assert_allclose(whitening.solve(a, r) @ r, a, atol=1e-10)


def test_query_on_the_test_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(op13_whitening(spark, folder), rows)
