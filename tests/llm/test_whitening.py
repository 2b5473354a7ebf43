"""Whitening against whole-number covariances and an independent eigen-solver."""

import numpy as np
import pytest

from lodestone.llm import whitening
from lodestone.llm.shared import Scratch

SCHEMA = "vec_id long, embedding array<float>, v int, n long"


def rows_of(x):
    return [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)]


def expected(x):
    """n, exact deviations, eigenvalues and vectors of float32 rows."""
    steps = np.floor(64.0 * x.astype(np.float64)).astype(object) + 1_000_000
    steps = np.array([[int(c) for c in r] for r in steps], object)
    n, s = len(x), steps.sum(0)
    d = n * steps - s
    far = (d * d).sum(1)
    v = (d.T @ d).astype(float) / float(n) ** 3
    e, q = np.linalg.eigh(v)
    return n, far, e[::-1], q[:, ::-1], d.astype(float) / n, float(np.trace(v))


@pytest.mark.parametrize(("n", "dims", "scale", "shift"), [(700, 40, 1.0, 0.0), (300, 5, 3.0, 5000.0), (40, 64, 0.2, -7.0), (2500, 3, 1000.0, 1.0)])
def test_whitening(spark, n, dims, scale, shift):
    rnd = np.random.default_rng(n)
    x = (rnd.normal(size=(n, dims)) @ rnd.normal(size=(dims, dims)) * scale + shift).astype(np.float32)
    bad = [(-1, None, 1, 2), (-2, [1.0] * (dims - 1) + [None], 1, 2), (-3, [float("nan")] * dims, 1, 2), (-4, [float("inf")] + [0.0] * (dims - 1), 1, 2)]
    got = whitening.whitened(spark.createDataFrame(rows_of(x) + bad, SCHEMA).repartition(19)).collect()
    n, far, e, q, d, trace = expected(x)
    k = min(32, dims, n - 1)
    assert len(got) == n * k and {r["vec_id"] for r in got} == set(range(n)) and {r["n"] for r in got} == {n}
    assert all(int(r["deviation"]) == far[r["vec_id"]] for r in got)
    white = np.zeros((n, k))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = d @ q[:, :k] / np.sqrt(e[:k])
    sign = np.sign((white * want).sum(0))
    assert np.abs(white * sign - want).max() < 1e-6
    share = {r["component"]: r["explained"] for r in got}
    assert np.allclose([share[i + 1] for i in range(k)], e[:k] / trace, rtol=1e-9)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and max(error) < 1e-6
    assert abs(max(error) - np.abs(np.cov(white.T, bias=True).reshape(k, k) - np.eye(k)).max()) < 1e-9


def test_repeats_nulls_and_lengths(spark):
    """Repeated rows count, null ids stay, short vectors are filled with 0, and variance in two dimensions gives two components."""
    data = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, [5.0]), (3, []), (4, [0.5, 0.5])]
    got = whitening.whitened(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 12 and sum(r["vec_id"] is None for r in got) == 2 and {r["n"] for r in got} == {6}
    x = np.array([[*v, 0, 0][:2] for _, v in data], np.float32)
    far = expected(x)[1]
    assert sorted(int(r["deviation"]) for r in got) == sorted(int(f) for f in np.repeat(far, 2))


@pytest.mark.parametrize("data", [[], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, [])]])
def test_no_variance(spark, data):
    df = whitening.whitened(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert df.collect() == [] and df.columns[0] == "vec_id"


def test_huge_entries(spark):
    """Deviations beyond 64 bits stay exact; entries beyond 2^46 count as 2^46."""
    data = [(i, [3e13 * (i % 7), float(i), 1e300 if i == 3 else 0.0]) for i in range(50)]
    got = whitening.whitened(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    steps = np.array([[int(64 * min(c, 2.0**46)) for c in v] for _, v in data], object)
    d = len(data) * steps - steps.sum(0)
    far = (d * d).sum(1)
    assert max(far) > 1 << 63 and all(int(r["deviation"]) == far[r["vec_id"]] for r in got)


def test_states_merge_like_one_pass():
    rnd = np.random.default_rng(4)
    x = rnd.integers(-(1 << 50), 1 << 50, (3000, 6))
    x[:, 0] = (1 << 40) + rnd.integers(0, 100, 3000)  # a large mean with a small spread
    parts = []
    for chunk in np.split(x, [1, 700, 701, 2000]):
        parts.append(whitening.State.of(6))
        parts[-1].add(chunk)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    exact = x.astype(object)
    assert whole.n == 3000 and whole.sums() == [int(c) for c in exact.sum(0)]
    d = exact * 3000 - exact.sum(0)
    want = ((d.T @ d) / 3000**3).astype(float)
    assert np.allclose(whole.covariance(), want, rtol=1e-9, atol=1e-9 * np.sqrt(np.outer(np.diag(want), np.diag(want))).max())
    assert abs(whole.covariance()[0, 0] - want[0, 0]) < 1e-6 * want[0, 0]


def test_more_tasks_than_one_merge_takes(spark):
    x = np.random.default_rng(1).normal(size=(400, 4)).astype(np.float32)
    df = spark.createDataFrame(rows_of(x), SCHEMA).repartition(whitening.FAN * 3)
    v = df.select(whitening.steps(df["embedding"]).alias("v"))
    state = whitening.gathered(v, Scratch(spark))
    assert state.n == 400 and np.allclose(state.covariance(), np.cov(np.floor(64.0 * x.astype(float)).T, bias=True), rtol=1e-12)


def test_symmetric_qr():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        a = rnd.normal(size=(n, n))
        for m in (a @ a.T, a + a.T, np.diag(a[0]), np.ones((n, n)), np.zeros((n, n)), a[:, :1] @ a[:, :1].T * 1e-200, np.diag(10.0 ** -np.arange(n))):
            e, q = whitening.symmetric_qr(m)
            size = max(np.abs(m).max(), 1e-300)
            assert np.abs(e - np.linalg.eigvalsh(m)[::-1]).max() < 1e-13 * n * size
            assert np.abs(q.T @ q - np.eye(n)).max() < 1e-13 * n and np.abs(m @ q - q * e).max() < 1e-13 * n * size
            assert (np.diff(e) <= 0).all()
