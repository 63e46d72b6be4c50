"""Whitening by contour integration against a dense eigensolver."""
import math

import numpy as np
import pytest

from logsift.llm import whitening as W
from logsift.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def brute(rows):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def random_rows(n, width, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * np.linspace(1.4, 0.4, width) @ rng.standard_normal((width, width)) / 9
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("width", [1, 3, 8, 32])
def test_equals_dense_eigensolver(spark, width):
    prepare(spark)
    rows = random_rows(300, width)
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, rows[5][1]), (1002, None),
             (1003, [None] + rows[1][1][1:]), (1004, [float("nan")] * width), (1005, [float("inf")] * width)]
    df = spark.createDataFrame([(i, v, 9, "clash") for i, v in rows], SCHEMA).repartition(5)
    out = W.whiten(df).collect()
    kept, n, sums, values, vectors = brute(rows)
    k = min(4, width)
    assert len(out) == k * len(kept)
    by = {}
    for r in out:
        by.setdefault((r.vec_id, r.component), r)
    signs = {}
    for i, x in kept:
        for c in range(k):
            r = by[(i, c + 1)]
            assert r.n == n and r.deviation == sum(int(d) ** 2 for d in n * x.astype(object) - sums)
            want = (x - sums / n) @ vectors[:, c] / math.sqrt(values[c])
            signs.setdefault(c, math.copysign(1, r.whitened * want))
            assert r.whitened == pytest.approx(signs[c] * want, rel=1e-8, abs=1e-9)
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-10)
            assert r.identity_error < 1e-10


@pytest.mark.parametrize("spectrum", [
    [5, 5, 5, 5, 5, 5, 5, 5], [9, 1, 1, 1, 1, 1, 1, 0], [1, 0, 0, 0, 0, 0], [4, 3, 2, 2, 2, 2, 1], [2, 1],
    [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.4999, 0.1], list(np.linspace(1, 1.2, 40)), [1e12, 1, 1e-6, 1e-6, 0, 0]])
def test_components_of_given_spectra(spectrum):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))
    v = q * spectrum @ q.T
    v = (v + v.T) / 2
    values, vectors = W.components(v)
    want = sorted(spectrum, reverse=True)[:4]
    top = want[0]
    assert values == pytest.approx(want, abs=1e-11 * top)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-9
    assert np.abs(v @ vectors - vectors * values).max() < 1e-10 * top


def test_inertia_counts():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    diag, off = W.tridiagonal(a)
    assert np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)) == pytest.approx(values, abs=1e-10)
    for shift in [*((values[1:] + values[:-1]) / 2), -100, 100]:
        assert W.count_above(diag, off, shift) == (values > shift).sum()


def test_a_missed_component_is_an_error():
    v = np.diag([4.0, 3.0, 2.0, 1.0])
    with pytest.raises(ArithmeticError):
        W.feast(v, 2.5, 5.0, 3)


def test_edge_tables(spark):
    prepare(spark)

    def run(rows):
        return W.whiten(spark.createDataFrame([(i, v, 1, "") for i, v in rows], SCHEMA)).collect()

    assert run([]) == []
    assert run([(1, None), (2, [float("nan")])]) == []
    same = run([(1, [0.5, 0.25]), (2, [0.5, 0.25])])     # one vector: no variance
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error)
            for r in sorted(same)] == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    line = sorted(run([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0]), (4, [1.0]), (5, [])]))
    first = [r for r in line if r.component == 1]
    assert [abs(r.whitened) if r.whitened is not None else None for r in first] == \
        [pytest.approx(math.sqrt(1.5)), pytest.approx(0, abs=1e-12), pytest.approx(math.sqrt(1.5)), None, None]
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component == 2)
    assert [r.deviation for r in first] == [(256 * 3) ** 2, 0, (256 * 3) ** 2, None, None]
    huge = run([(1, [1e18, 0.0]), (2, [-1e18, 0.5])])
    assert {r.deviation for r in huge} == {None}
