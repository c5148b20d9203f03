"""Embedding whitening against numpy's eigendecomposition of the exact covariance."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import whitening as w


def scatter(rows):
    centred = rows - rows.mean(0)
    return centred.T @ centred


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=5, max_size=5), min_size=1, max_size=30), st.integers(0, 30))
def test_rank_one_updates_give_the_spectrum(rows, cut):
    # small whole numbers: many equal eigenvalues, zero components and vectors that recur
    x = np.array(rows, float)
    whole, left, right = w.Spectrum(5), w.Spectrum(5), w.Spectrum(5)
    for i, row in enumerate(x):
        whole.add(row)
        (left if i < cut else right).add(row)
    left.merge(right.n, right.mean, right.values, right.vectors) if right.n else None
    for s in (whole, left):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0), atol=1e-9)
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(5), atol=1e-9)
        assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, scatter(x), atol=1e-8)


def test_secular_roots_are_between_the_poles():
    rng = np.random.default_rng(3)
    for scale in (1e-6, 1e-3, 1.0, 30.0):
        d, z = np.sort(rng.random(20)), rng.standard_normal(20) * scale
        roots, delta = w._roots(d, z, 0.7)
        assert (np.diag(delta) < 0).all() and (np.diag(delta, -1) > 0).all()
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z)), rtol=1e-12, atol=1e-14 * max(1, roots[-1]) * 20)


def test_fit_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((600, 7)) @ np.diag([9, 7, 5, 4, 3, 2, 1]) + 1000
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in enumerate(rows)], "id long, v array<double>").repartition(20)
    model = w.fit(df, "v")
    values, vectors = np.linalg.eigh(scatter(rows) / 600)
    assert model.n == 600 and np.allclose(model.mean, rows.mean(0))
    assert np.allclose(model.variances, values[::-1], rtol=1e-10)
    assert np.allclose(np.abs(np.sum(model.components * vectors[:, ::-1], axis=0)), 1, atol=1e-12)
    out = np.array([r["whitened"] for r in w.whiten(df, "v", model, 3).collect()])
    assert np.allclose(out.T @ out / 600, np.eye(3), atol=1e-10) and w.identity_error(df, "v", model, 3) < 1e-10


def test_odd_vectors(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0], "x"), (1, [0.5, 1.0], "x"), (2, [0.25, -1.0], None), (None, [0.0, 0.0], "x"), (3, None, "x"),
            (4, [None, 1.0], "x"), (5, [nan, 1.0], "x"), (6, [inf, 1.0], "x"), (7, [1.0], "x"), (8, [], "x"), (9, [1e30, 1.0], "x")]
    schema = "vec_id long, embedding array<float>, whitened string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = w.op13_embedding_whitening(spark, str(tmp_path)).collect()
    assert sorted(r["vec_id"] or 0 for r in got) == [0, 0, 1, 1, 1, 1, 2, 2] and {r["n"] for r in got} == {4}
    x = np.floor(1024 * np.array([r[1] for r in rows[:4]])) + 100000
    want = {i or 0: int(((4 * v - x.sum(0)) ** 2).sum()) for (i, _, _), v in zip(rows, x, strict=False)}
    assert all(r["deviation"] == want[r["vec_id"] or 0] for r in got)
    assert sum(r["explained"] for r in got if r["vec_id"] == 2) == pytest.approx(1)
    assert w.whiten(spark.createDataFrame(rows, schema), "embedding", w.fit(w.usable(spark.createDataFrame(rows, schema), "embedding"), "embedding"), 2).columns[-1] == "_whitened"


def test_no_rows_and_no_variance(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(1, [1.0, 2.0])]), ("same", [(1, [1.0, 2.0]), (2, [1.0, 2.0])])):
        at = tmp_path / name
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(at / "embeddings.parquet"))
        got = w.op13_embedding_whitening(spark, str(at)).collect()
        assert len(got) == 2 * len(rows)
        assert all(r["whitened"] == r["explained"] == r["identity_error"] == r["deviation"] == 0 for r in got)


def test_deviation_beyond_a_long_is_null():
    rows = np.array([[2.0 ** 31, 0.0], [0.0, 0.0]])
    assert w._deviations(rows, 2, rows.sum(0).astype(np.int64)).to_pylist() == [2 ** 62, 2 ** 62]
    assert w._deviations(rows * 4, 2, (rows * 4).sum(0).astype(np.int64)).to_pylist() == [None, None]
