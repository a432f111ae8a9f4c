import numpy as np
import pytest

from wearline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, y string, n string, whitened string"


def table(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], "a", "b", "c") for i, v in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def reference(x):
    y = np.floor(64 * np.float32(x).astype(float))
    centred = y - y.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(y))
    return y, centred, values[::-1], axes[:, ::-1]


def check(got, x, components):
    y, centred, values, axes = reference(x)
    n = len(x)
    assert len(got) == n
    for r in got:
        i = r["doc"]["vec_id"]
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(y[i], y.sum(0)))
        assert r["n"] == n and r["deviation"] == exact and len(r["whitened"]) == components
        assert np.allclose(r["explained"], values[:components] / values.sum(), rtol=1e-12)
        assert r["identity_error"] < 1e-10
    w = np.array([r["whitened"] for r in sorted(got, key=lambda r: r["doc"]["vec_id"])])
    want = centred @ axes[:, :components] / np.sqrt(values[:components])
    signs = np.sign((w * want).sum(0))
    assert np.abs(w - want * signs).max() < 1e-9
    return w


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 24)) * 0.9 ** np.arange(24)
    extra = [
        (9000, None, None, None, None),
        (9001, [], "a", "b", "c"),
        (9002, [1.0] * 23 + [None], "a", "b", "c"),
        (9003, [float("nan")] * 24, "a", "b", "c"),
        (9004, [float("inf")] + [0.0] * 23, "a", "b", "c"),
        (9005, [1.0] * 7, "a", "b", "c"),
        (9006, [3e38] * 24, "a", "b", "c"),
    ]
    got = whitening.whiten(table(spark, x, extra).repartition(5), components=6).collect()
    w = check(got, x, 6)
    assert np.allclose(np.cov(w.T, bias=True), np.eye(6), atol=1e-10)


def test_repeats_and_more_components_than_dimensions(spark):
    x = np.random.default_rng(3).standard_normal((40, 5))
    check(whitening.whiten(table(spark, np.vstack([x, x]))).collect(), np.vstack([x, x]), 5)


def test_components_without_variance_do_not_exist(spark):
    x = np.random.default_rng(4).standard_normal((60, 6))
    x[:, 3], x[:, 4] = x[:, 2], 0.5
    got = whitening.whiten(table(spark, x)).collect()
    assert {len(r["whitened"]) for r in got} == {4} and got[0]["identity_error"] < 1e-10
    same = whitening.whiten(table(spark, np.ones((7, 3)))).collect()
    assert [(r["whitened"], r["deviation"], r["n"]) for r in same] == [([], 0, 7)] * 7
    assert len(whitening.whiten(table(spark, x[:1])).collect()) == 1


def test_empty_tables(spark):
    assert whitening.whiten(table(spark, np.ones((1, 2))).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [], [(1, None, "a", "b", "c")])).count() == 0


def test_large_entries_stay_exact(spark):
    x = np.array([[2.0**33, 1.0], [-(2.0**33), 2.0], [0.0, 3.0]])
    got = whitening.whiten(table(spark, x)).collect()
    assert all(r["deviation"] is None or r["deviation"] >= 0 for r in got)
    assert {r["doc"]["vec_id"]: r["deviation"] for r in got}[2] == (3 * 192 - 64 * 6) ** 2 + 0


@pytest.mark.parametrize("width, wanted, scale", [(64, 32, 1.0), (200, 12, 0.9), (150, 4, 0.99), (9, 20, 0.5)])
def test_solver_reaches_double_precision(width, wanted, scale):
    x = np.random.default_rng(width).standard_normal((900, width)) * scale ** np.arange(width)
    v = x.T @ x / len(x)
    found = whitening.jacobi_davidson(lambda b: x.T @ (x @ b) / len(x), width, wanted)
    want = np.linalg.eigvalsh(v)[::-1][:wanted]
    assert np.abs(found.values - want).max() < 1e-13 * want[0]
    assert found.residuals.max() < 1e-13 * want[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(want))).max() < 1e-13


def test_minres_solves_the_correction_equation():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    a = a @ a.T
    u = np.linalg.qr(rng.standard_normal((30, 3)))[0]
    locked = np.linalg.qr(np.hstack([u, rng.standard_normal((30, 2))]))[0][:, 3:]
    theta = np.array([400.0, 300.0, 250.0])
    r = rng.standard_normal((30, 3))
    r -= locked @ (locked.T @ r)
    r -= u * (u * r).sum(0)
    t = whitening.minres_corrections(lambda b: a @ b, theta, u, locked, r, 60)

    def project(z):
        z = z - locked @ (locked.T @ z)
        return z - u * (u * z).sum(0)

    assert np.abs(project(a @ t - t * theta) + r).max() < 1e-8
