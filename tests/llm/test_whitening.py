import math

import numpy as np
import pytest

from cohortspark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label string, x string, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "l", "x", "n", "c") for i, v in rows], SCHEMA)


def brute(vectors, components=8):
    """Sum of squared deviations, whitened values up to sign, explained shares, by dense algebra."""
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n, mean = len(x), x.mean(axis=0)
    values, axes = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    order = np.argsort(-values)[:components]
    whole = [[int(v) for v in row] for row in x]
    sums = [sum(column) for column in zip(*whole, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in whole]
    return deviation, (x - mean) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def table_of(rows, k):
    rows = sorted(rows, key=lambda r: (r.vec_id, r.component))
    return np.array([r.whitened for r in rows], float).reshape(-1, k), [int(r.deviation) for r in rows[::k]], [r.explained for r in rows[:k]], rows


def test_query_equals_dense_algebra(spark, sf_dir):
    got, deviation, explained, rows = table_of(whitening.op12_whitening(spark, sf_dir).collect(), 8)
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)}
    expected = brute([source[i] for i in sorted(source)])
    sign = np.sign((expected[1] * got).sum(axis=0))
    assert deviation == expected[0] and np.allclose(got * sign, expected[1], atol=1e-9) and np.allclose(explained, expected[2], rtol=1e-12)
    assert max(r.identity_error for r in rows) < 1e-10 and {r.n for r in rows} == {len(source)}


def test_unusable_vectors_and_repeated_ids(spark):
    draw = np.random.default_rng(1)
    good = [(i % 7, draw.normal(size=5).tolist()) for i in range(40)] + [(None, [0.1, 0.2, 0.3, 0.4, 0.5])]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [1.0, float("nan"), 2.0, 3.0, 4.0]), (93, [float("inf")] * 5), (94, []), (95, [1e300] * 5)]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    assert len(rows) == 5 * len(good) and {r.n for r in rows} == {len(good)}
    own = {(r.vec_id, int(r.deviation)) for r in rows}
    expected = brute([v for _, v in good])
    assert own == set(zip([i for i, _ in good], expected[0], strict=True))
    assert np.allclose(sorted({r.explained for r in rows}, reverse=True), expected[2])
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    assert whitening.whiten(frame(spark, bad)).collect() == [] and whitening.whiten(frame(spark, [])).collect() == []


def test_vectors_without_variance_and_large_entries(spark):
    rows = whitening.whiten(frame(spark, [(1, [0.5, 2.0, 0.0]), (2, [0.5, 2.0, 0.0])])).collect()
    assert len(rows) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in rows)
    line = [(i, [0.5, float(i), 0.0]) for i in range(9)]  # one dimension varies
    rows = whitening.whiten(frame(spark, line)).collect()
    assert sorted({r.component for r in rows if r.whitened is not None}) == [1] and len(rows) == 27
    large = [(i, [1e9 * math.sin(i), 1e9 * i]) for i in range(12)]  # deviations beyond 64 bits
    got, deviation, _, _ = table_of(whitening.whiten(frame(spark, large)).collect(), 2)
    expected = brute([v for _, v in large])
    assert deviation == expected[0] and max(deviation) > 1 << 63
    assert np.allclose(got * np.sign((expected[1] * got).sum(axis=0)), expected[1], atol=1e-9)


@pytest.mark.parametrize("size,wanted", [(3, 8), (40, 8), (300, 5)])
def test_jacobi_davidson_on_close_and_repeated_eigenvalues(size, wanted):
    draw = np.random.default_rng(size)
    axes = np.linalg.qr(draw.normal(size=(size, size)))[0]
    values = np.sort(draw.uniform(1, 2, size))[::-1]
    values[1:3] = values[1]  # a double one
    values[0] = values[1] * (1 + 1e-6)
    matrix = (axes * values) @ axes.T
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, vectors, worst = whitening.jacobi_davidson(product, size, wanted)
    k = min(size, wanted)
    assert np.allclose(found, np.linalg.eigvalsh(matrix)[::-1][:k], rtol=1e-12) and worst <= 1e-13
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-13 * size
    assert size < 300 or len(calls) < 250
