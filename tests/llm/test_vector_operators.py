"""Centroid clustering and whitening against plain versions, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest

from loomtext.llm import centroids, whitening

NAN, INF = float("nan"), float("inf")
CLASHING = "vec_id long, embedding array<double>, id int, x int, norms string, cluster int, h int, part int, dims int, sums int"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def plain_clusters(rows, k, rounds, dims):
    """One vector and one centroid at a time, with plain integers."""
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [x for _, x in first]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    pick = lambda x: min(range(len(cents)), key=lambda c: (far(x, cents[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(pick(x), []).append(x)
        cents = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(cents)]
    return sorted(((i is None, i or 0, pick(x), far(x, cents[pick(x)])) for i, x in kept)), cents


def test_clusters_match_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(0, 4) + rng.normal(size=8) / 3).astype(np.float32).tolist()) for i in range(150)]
    rows += [(7, rows[7][1])] * 40 + [(500 + i, rows[9][1]) for i in range(40)]  # repeated rows, equal vectors
    rows += [(None, rows[3][1]), (900, None), (901, []), (902, [1.0] * 7), (903, [None] * 8), (904, [NAN] + [0.0] * 7), (905, [INF] + [0.0] * 7), (906, [0.0] * 8)]
    got, cents = centroids.cluster(frame(spark, rows).repartition(5), k=9, dims=8, segments=4)
    want, plain = plain_clusters(rows, 9, 3, 8)
    assert sorted((r["id"] is None, r["id"] or 0, r["cluster"], r["distance"]) for r in got.collect()) == want
    assert cents.tolist() == plain


def test_screening_saves_distances_and_loses_no_tie():
    rng = np.random.default_rng(5)
    cents = rng.integers(-3, 3, (16, 64)) * 40
    cents[11] = cents[4]
    x = cents[rng.integers(0, 16, 3000)] + rng.integers(-4, 5, (3000, 64))
    got, distance, asked = centroids.nearest(x, centroids.segment_norms(x, 8), cents)
    every = np.square(x[:, None, :] - cents[None]).sum(2)
    assert (got == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert 11 not in got and len(x) <= asked < every.size / 4
    big = np.array([[1 << 26] * 64, [-(1 << 26)] * 64])
    assert centroids.nearest(big, centroids.segment_norms(big, 8), big)[1].tolist() == [0, 0]


def test_fewer_vectors_than_centroids_and_none(spark):
    got, cents = centroids.cluster(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [9.0, 9.0])]), dims=2, segments=2)
    assert len(cents) == 3 and len({r["cluster"] for r in got.collect()}) == 2
    got, cents = centroids.cluster(frame(spark, []), dims=2, segments=2)
    assert got.count() == 0 and len(cents) == 0 and got.columns == ["id", "cluster", "distance"]


def test_clustering_takes_any_other_columns_and_refuses_what_does_not_fit(spark):
    got, _ = centroids.cluster(spark.createDataFrame([(5, [1.0, 2.0], 1, 1, "n", 1, 1, 1, 1, 1), (6, [3.0, 4.0], None, None, None, None, None, None, None, None)], CLASHING), k=2, dims=2, segments=1)
    assert {r["id"] for r in got.collect()} == {5, 6}
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(frame(spark, [(1, [1e30, 0.0])], "double"), dims=2, segments=1)


def plain_whitening(rows, k):
    x = np.array([[math.floor(64 * c) + 10**6 for c in v] for _, v in rows], np.int64)
    own = np.unique(x, axis=0)
    n, s = len(own), own.sum(0)
    c = (n * own - s).astype(np.longdouble) / n
    values, vectors = np.linalg.eigh((c.T @ c / n).astype(float))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x - s).astype(np.longdouble) / n).astype(float) @ vectors / np.sqrt(values), values / np.trace((c.T @ c / n).astype(float)), [int(((n * r - s) ** 2).sum()) for r in x]


def whitened(spark, rows, k, parts=6):
    kept, dims = whitening.integer_vectors(frame(spark, rows).repartition(parts))
    distinct = kept.select("x").distinct()
    model = whitening.fit(distinct, dims, k)
    return whitening.whiten(kept, model), model, whitening.identity_error(distinct, model)


def test_whitening_matches_an_eigendecomposition(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(3, rows[3][1])]  # one row of the fit each
    bad = [(None, None), (2000, [None] * 6), (2001, [NAN] * 6), (2002, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (2003, [1.0, 2.0]), (2004, [])]
    out, model, error = whitened(spark, rows + bad + [(None, rows[5][1])], 4)
    n, want, explained, deviation = plain_whitening(rows, 4)
    assert model.n == n == 400 and error < 1e-12 and np.allclose(model.explained, explained, rtol=1e-9)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["component"], r["whitened"], r["deviation"]))
    assert set(got) == {i for i, _ in rows} | {None} and len(got[3]) == 8
    sign = np.sign(sum(np.array([w for _, w, _ in sorted(got[i])]) * want[i] for i in range(100) if i != 3))
    for i in range(400):
        if i != 3:
            assert np.allclose([w for _, w, _ in sorted(got[i])], sign * want[i], atol=1e-9) and {d for _, _, d in got[i]} == {deviation[i]}


def test_small_deviations_are_as_accurate_as_large_ones():
    """Columns over twelve orders of size: a covariance would lose the small ones, rotations do not."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(40, 5)))[0]
    sizes = np.array([1e6, 1e3, 1.0, 1e-3, 1e-6])
    singular, right = whitening.jacobi(np.linalg.qr(q * sizes, mode="r"))
    assert np.allclose(singular / sizes, 1, rtol=1e-12) and np.allclose(np.abs(right), np.eye(5), atol=1e-9)
    assert np.allclose(right.T @ right, np.eye(5), atol=1e-14)
    odd, v = whitening.jacobi(np.zeros((3, 3)))
    assert odd.tolist() == [0, 0, 0] and np.allclose(v, np.eye(3)[:, :3])


def test_rows_without_variance_have_no_component(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        out, model, error = whitened(spark, rows, 16)
        assert out.count() == 0 and model.components.shape[1] == 0 and error == 0.0
    out, model, error = whitened(spark, [(i, [float(i), float(i), 7.0]) for i in range(9)], 16)
    assert model.components.shape == (3, 1) and out.count() == 9 and error < 1e-12


def test_deviations_are_exact_beyond_float_and_null_beyond_long():
    model = whitening.Whitening(3_000_001, [3_000_001 * 10 + 2, 5], np.array([2.0, 1.0]), np.eye(2))
    x = np.array([[1_000_000, 3], [-(1 << 27), 1 << 27], [10, 0]])
    want = [sum((3_000_001 * int(a) - s) ** 2 for a, s in zip(r, model.sums, strict=True)) for r in x]
    assert model.deviation(x) == [w if w < 1 << 63 else None for w in want] and None in model.deviation(x)
    assert model.deviation(x[2:]) == [4 + 25]


def test_whitening_takes_any_other_columns(spark):
    d = spark.createDataFrame([(i, [float(i), float(i * i)], 1, 1, "n", 1, 1, 1, 1, 1) for i in range(5)], CLASHING)
    kept, dims = whitening.integer_vectors(d)
    assert dims == 2 and kept.count() == 5
