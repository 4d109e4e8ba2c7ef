import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import queries
from twinframe.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def grid(rows, scale=64, offset=1_000_000):
    good = [(i, [int(np.floor(scale * float(np.float32(c)))) + offset for c in v]) for i, v in rows if v is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in rows if v is not None), default=0)
    return [(i, x) for i, x in good if len(x) == d]


def plain(rows, k=16):
    """(ids, n, deviations, whitened up to sign, shares) by exact sums and the covariance of the centred rows."""
    good = grid(rows)
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, sums = len(fit), fit.sum(axis=0)
    a = (n * fit - sums) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    x = np.array([x for _, x in good])
    off = n * x - sums
    return [i for i, _ in good], n, [sum(int(c) ** 2 for c in r) for r in off], (off / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(spark, rows, k=16):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"x": F.lit(1), "id": F.lit("a"), "whitened": F.lit(0)})
    fitted = W.fit(df, components=k, scale=64, offset=1_000_000)
    got = W.transform(df, fitted).collect()
    ids, n, deviations, z, shares = plain(rows, k)
    assert fitted.n == n and np.allclose(fitted.explained, shares, rtol=1e-9) and fitted.identity_error < 1e-9
    key = lambda t: (t[0] is not None, t[0] or 0, t[1])
    mine = sorted([(r["vec_id"], r["deviation"], r["whitened"]) for r in got], key=key)
    want = sorted(zip(ids, deviations, z.tolist()), key=key)
    assert [m[:2] for m in mine] == [w[:2] for w in want]
    a, b = np.array([m[2] for m in mine]).reshape(len(mine), -1), np.array([w[2] for w in want]).reshape(len(mine), -1)
    signs = np.sign((a * b).sum(axis=0))
    assert np.allclose(a, b * signs, atol=1e-7)
    return fitted


def rows_of(matrix, start=0):
    return [(start + i, r) for i, r in enumerate(matrix.astype(np.float32).tolist())]


def test_same_as_the_covariance(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])
    fitted = check(spark, rows_of(m), 4)
    assert fitted.components.shape == (6, 4)


def test_messy_rows_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = rows_of(rng.normal(size=(80, 5)) * [3, 2, 1.5, 1, 0.7])
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [rows[5], (None, rows[6][1]), (None, [1.0] * 5)]
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5), (304, [float("-inf")] * 5), (305, [1.0, 2.0])]
    check(spark, rows)


def test_dependent_and_constant_columns(spark):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(100, 3)) * 64) / 64
    fitted = check(spark, rows_of(np.column_stack([m, m[:, 0] + m[:, 1], np.full(100, 0.5)])))
    assert fitted.components.shape == (5, 3)


def test_ill_conditioned_columns(spark):
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=400) * 2**20)
    m = np.column_stack([base, base + rng.integers(0, 2, 400), rng.integers(-3, 3, 400)]) / 64
    df = spark.createDataFrame(rows_of(m), SCHEMA)
    fitted = W.fit(df, components=3)
    assert fitted.components.shape == (3, 3) and fitted.identity_error < 1e-4


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.fit(empty) is None and W.transform(empty, None).count() == 0
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], SCHEMA)
    fitted = W.fit(one)
    assert fitted.n == 1 and fitted.components.shape == (2, 0)
    assert [(r["deviation"], r["whitened"]) for r in W.transform(one, fitted).collect()] == [(0, []), (0, [])]


def test_query_on_the_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, n, deviations, z, shares = plain(rows)
    got = queries.op13_whitening(spark, d).toPandas()
    assert sorted(got.columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.allclose(np.abs(wide), np.abs(z), atol=1e-7)
    assert np.allclose(got[got.vec_id == ids[0]].sort_values("component").explained, shares, rtol=1e-9)
    assert got.groupby("vec_id").deviation.first().loc[ids].tolist() == deviations


@pytest.mark.parametrize("shift", [0.0, 1e-3])
def test_solve_undoes_the_factor(shift):
    a = np.random.default_rng(5).normal(size=(50, 4))
    r = W.shifted_cholesky(a.T @ a, shift)
    assert np.allclose(W.solve_rows(a, r) @ r, a) and np.allclose(np.tril(r, -1), 0)
