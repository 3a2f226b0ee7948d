"""Whitening against numpy's own eigenvectors in double precision."""

import numpy as np
import pytest

from tidewrack.llm import whitening

KIND = "vec_id long, embedding array<double>, key string, v int, component string, n int, whitened double, x array<int>"
EXTRA = ("k", 1, "c", 2, 0.5, [1])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], KIND)


def read(df):
    rows = df.orderBy("key", "component").collect()
    return rows, np.array([r.whitened for r in rows], dtype=float)


def numbers(vectors):
    return np.floor(64 * np.asarray(vectors, dtype=float)).astype(np.int64) + 1_000_000


def test_against_double_precision(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(9, 9))
    vectors = rng.normal(size=(400, 9)) @ mix + rng.normal(size=9)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [1.0] * 8 + [None]), (902, [float("nan")] * 9), (903, [float("inf")] + [0.0] * 8), (904, [])]
    found, values = read(whitening.whitened(frame(spark, rows).repartition(5), components=6))
    x = numbers(vectors)
    n, s = len(x), x.sum(axis=0)
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    want = centred @ u[:, :6] / np.sqrt(e[:6])
    got = values.reshape(400, 6)
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-8
    assert [r.key for r in found[::6]] == list(range(400))
    assert {r.n for r in found} == {400}
    assert [r.deviation for r in found[::6]] == ((n * x - s) ** 2).sum(axis=1).tolist()
    assert [r.explained for r in found[:6]] == pytest.approx((e / e.sum())[:6].tolist(), rel=1e-12)
    assert found[0].identity_error < 1e-9


def cluster(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1],
        [1 + 1e-9 * i for i in range(12)],
        [7, 7, 7, 3, 3, 1, 1 + 1e-12, 1 - 1e-12, 0, 0],
        [1e6, 1, 1e-6],
        [2] * 6,
        [10 - i / 7 for i in range(64)],
    ],
)
def test_refined_vectors(values):
    v = cluster(values, len(values))
    v = (v + v.T) / 2
    e, x = whitening.refined(v)
    top = max(np.abs(values))
    assert np.abs(np.sort(values)[::-1] - e).max() <= 1e-13 * top
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-15
    high = x.astype(np.longdouble)
    assert np.abs(v.astype(np.longdouble) @ high - high * e).max() <= 4e-16 * top * len(v)


def test_refined_beats_float32_on_close_values():
    v = cluster([1 + 1e-9 * i for i in range(12)], 5)
    v = (v + v.T) / 2
    _, rough = np.linalg.eigh(v.astype(np.float32))
    e, x = whitening.refined(v)
    inner = x.T @ v @ x
    assert np.abs(inner - np.diag(np.diag(inner))).max() < 1e-14
    rough = rough.astype(float)
    inner = rough.T @ v @ rough
    assert np.abs(inner - np.diag(np.diag(inner))).max() > 1e-11


def test_awkward_rows(spark):
    same = [0.5, 0.25, 0.0]
    found, _ = read(whitening.whitened(frame(spark, [(1, same), (1, same), (None, same), (4, [1.0, 2.0])])))
    assert len(found) == 9 and {r.n for r in found} == {3} and {r.deviation for r in found} == {0}
    assert all(r.whitened is None and r.explained is None and r.identity_error is None for r in found)
    assert [r.key for r in found[:3]] == [None] * 3
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).count() == 0


def test_copies_count_and_flat_dimensions_have_no_component(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(42)]
    found, values = read(whitening.whitened(frame(spark, rows + rows)))
    assert len(found) == 252 and {r.n for r in found} == {84}
    assert all((r.whitened is None) == (r.component == 3) for r in found)
    assert found[0].identity_error < 1e-9


def test_enormous_entries(spark):
    rows = [(1, [1e30, -1e30]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    found, values = read(whitening.whitened(frame(spark, rows)))
    assert len(found) == 6 and all(r.deviation is None for r in found)
    assert np.isfinite(values).all()


def test_large_keys_are_kept(spark):
    rows = [((1 << 60) + 1, [1.0, 2.0]), (None, [2.0, 0.0]), ((1 << 60) + 3, [0.0, 1.5])]
    found, _ = read(whitening.whitened(frame(spark, rows).coalesce(1)))
    assert {r.key for r in found} == {(1 << 60) + 1, None, (1 << 60) + 3}
