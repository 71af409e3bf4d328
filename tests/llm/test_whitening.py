import math

import numpy as np
import pytest

from tallyspark.llm import whitening


def brute(rows):
    """Components by a symmetric eigenvalue solver of the covariance of exactly centred rows."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept], np.int64)
    n, sums = len(x), x.sum(0)
    off = n * x - sums
    e, v = np.linalg.eigh((off / n).T @ (off / n) / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in kept], n, (off.astype(object) ** 2).sum(1), e, (off / n) @ v / np.sqrt(np.abs(e)), e / e.sum()


def agree(out, rows, k):
    ids, n, deviation, e, w, explained = brute(rows)
    assert len(out) == n * k
    got = {}
    for r in out:
        got.setdefault(r.component, []).append(r)
    assert sorted(got) == list(range(1, k + 1))
    for c, rs in got.items():
        rs.sort(key=lambda r: (r.vec_id, r.whitened))
        assert {(r.n, r.identity_error < 1e-9) for r in rs} == {(n, True)}
        assert rs[0].explained == pytest.approx(explained[c - 1], rel=1e-9)
        assert [(r.vec_id, r.deviation) for r in sorted(rs, key=lambda r: (r.vec_id, r.deviation))] == sorted(zip(ids, deviation))
        want = sorted(zip(ids, w[:, c - 1]))
        other = sorted(zip(ids, -w[:, c - 1]))
        near = [max(abs(r.whitened - x) for r, (_, x) in zip(rs, way)) for way in (want, other)]
        assert min(near) < 1e-6


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    agree(whitening.op12(spark, sf).collect(), rows, 32)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [100, 30, 1, 0.3, 7]).tolist()) for i in range(3000)]
    rows += [(7, rows[7][1])] * 5
    bad = [(1, None), (2, [1.0, None, 1.0, 1.0, 1.0]), (3, [1.0, float("nan"), 1.0, 1.0, 1.0]), (4, [float("inf")] + [1.0] * 4), (5, [1.0]), (6, []), (8, [1e30] * 5)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<float>, n int, part int")
    table.repartition(37).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    agree(whitening.op12(spark, str(tmp_path)).collect(), rows, 5)


def test_without_variance(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    for k, rows in enumerate(([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        out = whitening.op12(spark, f"{tmp_path}/{k}")
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)] + [(None, [3.0, 1.0, 6.0])], schema)
    rows, fit = whitening.fitted(flat)
    assert len(fit.eigenvalues) == 1 and whitening.whitened(rows, fit).count() == 10 and whitening.identity_error(rows, fit) < 1e-12


def test_jacobi_keeps_small_deviations():
    """Columns of lengths from 1 to 1e-9: every singular value to 12 digits, which a covariance would lose."""
    rng = np.random.default_rng(5)
    for d in (1, 2, 7, 64):
        want = np.logspace(0, -9, d)
        u, _ = np.linalg.qr(rng.normal(size=(200, d)))
        r = whitening.triangle([u * want])
        v, long = whitening.jacobi(r)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(long, want, rtol=1e-12)


def test_joined_triangles_are_those_of_all_rows():
    x = np.random.default_rng(6).normal(size=(1000, 6))
    parts = [whitening.triangle([x[a : a + 3]]) for a in range(0, 1000, 3)]
    assert np.allclose(np.abs(whitening.triangle(parts)), np.abs(np.linalg.qr(x, mode="r")))


def test_deviations_beyond_a_double():
    x = np.array([[1, 3], [1 << 40, 2], [1 << 31, 5]], np.int64)
    sums = x.sum(0)
    want = [sum((3 * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 3, sums).to_pylist() == [w if w < 1 << 63 else None for w in want]
