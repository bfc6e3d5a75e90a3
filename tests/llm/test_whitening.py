import numpy as np
import pytest
from pyspark.sql import types as T

from toroid.llm.whitening import covariance_product, grid_vectors, jacobi_davidson, minres, moments, whiten

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def reference(vectors):
    """Whole numbers, exact deviations, eigenvalues and whitened values by plain numpy."""
    x = [[int(np.floor(float(np.float32(c)) * 64)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    values, u = np.linalg.eigh(centred.T @ centred / n)
    return deviation, values[::-1], centred @ u[:, ::-1]


def held(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "x", 7) for i, v in zip(ids, vectors)], SCHEMA)


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 40)) * np.linspace(3, 0.5, 40)).astype(np.float32).tolist()
    vectors += vectors[:1] * 150  # repeated rows count each
    rows = held(spark, vectors).repartition(5)
    got = whiten(rows).toPandas()
    deviation, values, projected = reference(vectors)
    assert len(got) == len(vectors) * 32 and set(got["n"]) == {len(vectors)}
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation
    assert np.allclose(got.groupby("component")["explained"].first(), values[:32] / values.sum(), rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    own = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    wanted = projected[:, :32] / np.sqrt(values[:32])
    sign = np.sign((own * wanted).sum(0))
    assert abs(own * sign - wanted).max() < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0, None], [nan, 1.0], [1.0, inf], [-inf, 0.0], [1e30, 1.0], [1.0, 2.0, 3.0], [0.5, -0.5], [1.5, 0.5], [0.5, -0.5], [-1.25, 3.0]]
    got = whiten(held(spark, vectors, [*range(10), None, 11])).orderBy("vec_id", "component").toPandas()
    deviation, values, _ = reference([vectors[i] for i in (10, 8, 9, 11)])
    assert got["vec_id"].fillna(-1).astype(int).tolist() == [-1, -1, 8, 8, 9, 9, 11, 11] and got["component"].tolist() == [1, 2] * 4
    assert got["deviation"].tolist()[::2] == deviation
    assert np.allclose(got["explained"][:2], values / values.sum())
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_scale_gives_no_rows(spark, vectors):
    got = whiten(held(spark, vectors))
    assert got.count() == 0 and got.schema["whitened"].dataType == T.DoubleType()


def test_flat_directions_are_not_listed(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-9, 9, (60, 3))
    vectors = np.c_[base, base[:, :1], np.ones((60, 5))].astype(float).tolist()
    got = whiten(held(spark, vectors)).toPandas()
    assert sorted(set(got["component"])) == [1, 2, 3] and got["identity_error"][0] < 1e-10


def test_many_dimensions_and_few_rows(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((12, 700)).astype(np.float32).tolist()
    got = whiten(held(spark, vectors)).toPandas()
    _, values, _ = reference(vectors)
    assert len(got) == 12 * 11 and np.allclose(got.groupby("component")["explained"].first(), values[:11] / values.sum(), rtol=1e-9)


def test_product_and_moments_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((500, 6)).astype(np.float32).tolist()
    w = rng.standard_normal((6, 2))
    found = []
    for parts in (1, 70):  # 70 tasks are added up in two steps
        x = grid_vectors(held(spark, vectors))
        x = x.repartition(parts)
        m = moments(x)
        found.append((m.n, m.sums, covariance_product(x, m)(w)))
    assert found[0][:2] == found[1][:2] and np.allclose(found[0][2], found[1][2], rtol=1e-13)


@pytest.mark.parametrize("values", [np.linspace(1, 2, 90), np.r_[np.full(20, 5.0), np.full(40, 2.0), np.ones(30)], np.r_[7.0, np.zeros(89)], 0.9 ** np.arange(90)])
def test_solver_reaches_double_precision_without_the_whole_space(values):
    rng = np.random.default_rng(8)
    basis = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    a = basis @ np.diag(values) @ basis.T
    found, u = jacobi_davidson(lambda w: a @ w, 90, 12, block=4, space=16)
    top = np.sort(values)[::-1]
    assert abs(found - top[:12]).max() < 1e-13 * top[0]
    assert np.linalg.norm(a @ u - u * found, axis=0).max() < 1e-13 * top[0] and abs(u.T @ u - np.eye(12)).max() < 1e-13


def test_minres_solves_each_column():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 3))
    b[:, 1] = 0
    assert np.allclose(minres(lambda v: a @ v, b, 200, 1e-12), np.linalg.solve(a, b), atol=1e-6)
