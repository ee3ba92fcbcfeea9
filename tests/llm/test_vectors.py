"""Whitening and hard negatives against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(901, None, 1), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 2), (904, [float("inf")] + [0.0] * 5, 2),
       (905, [0.5, 0.5], 1), (None, [0.25] * 6, 1), (907, [], 0), (50, [0.5, -0.5, 0.25, 0.0, 0.125, 0.75], None)]


def vectors(seed=5, n=160, dim=6, equal=30):
    """Clusters, repeated vectors (a third of all), repeated ids, ties, nulls and vectors of other lengths."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in centres[i % 4]], i % 3) for i in range(n)]
    rows += [(1000 + i, [0.5] * dim, i % 2) for i in range(equal)] + [(1050, [0.5] * dim, 0), (1050, [0.5] * dim, 0), rows[0], rows[0], rows[50]]
    return rows + ODD


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    for c in ("row", "dim", "v", "x", "cell", "wave", "n", "rank", "score", "size"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(5).cache()


def usable(rows, dim=6):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    return [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if ok(v) and len(v) == dim]


def expected_whitening(rows, k):
    kept = usable(rows)
    x = np.array([np.floor(1024 * v) + 100000 for _, v, _ in kept])
    n = len(x)
    s = [int(c) for c in x.sum(axis=0)]
    deviation = [sum((n * int(e) - t) ** 2 for e, t in zip(row, s)) for row in x]
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [i for i, _, _ in kept], n, deviation, centred @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_whitening_equals_eigenvectors(spark, frame):
    ids, n, deviation, y, share = expected_whitening(vectors(), 4)
    got = whitening.whitened(frame, components=4).collect()
    assert len(got) == 4 * n and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    for k in range(4):
        mine = [r for r in got if r["component"] == k + 1]
        assert max(abs(r["explained"] - share[k]) for r in mine) < 1e-12
        want = sorted(zip((i if i is not None else -1 for i in ids), deviation, np.abs(y[:, k])))
        have = sorted((r["vec_id"] if r["vec_id"] is not None else -1, int(r["deviation"]), abs(r["whitened"])) for r in mine)
        assert [w[:2] for w in want] == [h[:2] for h in have]
        assert max(abs(w[2] - h[2]) for w, h in zip(want, have)) < 1e-9
        signs = {np.sign(r["whitened"] * y[ids.index(r["vec_id"]), k]) for r in mine if r["vec_id"] not in (0, 50) and abs(r["whitened"]) > 1e-6}
        assert len(signs) == 1


def test_whitening_where_little_varies(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25, 1.0], 0) for i in range(9)], SCHEMA)
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(same.where("false")).count() == 0
    one = spark.createDataFrame([(1, [0.5], 0)], SCHEMA)
    assert whitening.whitened(one).count() == 0
    plane = spark.createDataFrame([(i, [float(i % 3), float(i % 5), float(i % 3)], 0) for i in range(30)], SCHEMA)
    got = whitening.whitened(plane, components=3).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_repeated_deviations_are_all_found(spark):
    axes = [(8 * s + i, [4.0 * s if j == i else 0.0 for j in range(8)], 0) for i in range(8) for s in (-1, 1)]
    got = whitening.whitened(spark.createDataFrame(axes, SCHEMA), components=8).collect()
    assert len(got) == 16 * 8 and max(r["identity_error"] for r in got) < 1e-9
    assert {round(r["explained"], 12) for r in got} == {0.125}


def test_strong_offset_and_weak_components(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 12)) @ np.diag(10.0 ** -np.arange(12) * 4000) + 300000.0
    rows = whitening.integer_rows(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"),
                                  "vec_id", "embedding", 1024.0, 100000)
    fitted = whitening.fit(whitening.cut(whitening.packed(rows)), 8)
    assert fitted.residual < 1e-12 and fitted.identity_error < 1e-9
    whole = np.floor(x * 1024)
    whole -= whole.mean(axis=0)
    e = np.linalg.svd(whole, compute_uv=False)[:8] ** 2 / len(x)
    assert np.allclose(fitted.eigenvalues, e, rtol=1e-9)


def test_sums_beyond_64_bits_and_many_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 32)
    big = [float(1 << 40), -float(1 << 40)]
    rows = spark.createDataFrame([(i, [big[i % 2], float(i)], 0) for i in range(20)], "vec_id long, embedding array<double>, label int").repartition(7)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(rows, components=1).collect()}
    x = [(int(big[i % 2]) * 1024, 1024 * i) for i in range(20)]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: sum((20 * c - t) ** 2 for c, t in zip(x[i], s)) for i in range(20)}


def test_early_stop_reaches_its_tolerance(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 40)) * np.concatenate([[50, 30, 20], np.ones(37)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    data = whitening.centred(whitening.cut(whitening.packed(whitening.integer_rows(rows, "vec_id", "embedding", 1024.0, 0))))
    s, p, left = whitening.bidiagonalise(data, 3, tolerance=1e-10)
    assert 3 <= len(s) < 40 and left > 0
    whole = np.floor(x * 1024)
    assert np.allclose(s[:3], np.linalg.svd(whole - whole.mean(axis=0), compute_uv=False)[:3], rtol=1e-9)


def expected_negatives(rows, positives=5, negatives_=3, every=50, relabel=True):
    kept = [(n, i, np.floor(256 * np.array([np.float32(x) for x in v], float)).astype(int), (lab + 1) % 10 if relabel and i is not None and i % 7 == 0 else lab)
            for n, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (1, 0) if i is None else (0, i)
    out = []
    for n, i, v, lab in kept:
        if i is None or i % every:
            continue
        scored = [(int(v @ w), j, lab2) for m, j, w, lab2 in kept if m != n and len(w) == len(v)]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for s, j, _ in [r for r in scored if r[2] == lab][:positives]:
            hard = [r for r in scored if r[2] != lab and 50 * s <= 100 * r[0] <= 95 * s][:negatives_]
            out += [(i, j, k + 1, h[1], s, h[0]) for k, h in enumerate(hard)]
    return sorted(out, key=str)


@pytest.mark.parametrize("wave,block,most", [(16384, 256, 4096), (4, 3, 7), (7, 2, 64)])
def test_negatives_equal_brute_force(spark, frame, wave, block, most):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0, label, wave=wave, block=block, most=most).collect()
    want = expected_negatives(vectors(), every=5)
    assert len(want) > 200
    assert sorted(map(tuple, got), key=str) == want


def test_negatives_without_anchors_or_rows(spark, frame):
    assert negatives.hard_negatives(frame, F.lit(False)).count() == 0
    assert negatives.hard_negatives(frame.where("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_leave_work_out(spark):
    """Candidates far from every window are not scored: the tree prunes."""
    rng = np.random.default_rng(4)
    v = np.vstack([rng.integers(90, 110, (20, 8)), rng.integers(-110, -90, (500, 8)), rng.integers(85, 105, (40, 8))])
    label = np.array([0] * 20 + [1] * 500 + [2] * 40)
    tree = negatives.spanning_tree(np.arange(20), np.arange(20), label[:20], v[:20])
    scored = 0
    for anchors, columns, exact in negatives.tree_scores(tree, v, lambda a, low, high: high >= 0):
        assert (exact == v[anchors] @ v[columns].T).all()
        scored += exact.size
    assert scored < 20 * 200


def test_large_scores_stay_exact():
    a, b = np.array([[1 << 30, 3]]), np.array([[1 << 30, 5], [(1 << 30) - 1, 7]])
    assert negatives.dots(a, b).tolist() == [[(1 << 60) + 15, (1 << 60) - (1 << 30) + 21]]
    with pytest.raises(OverflowError):
        negatives.dots(np.array([[1 << 32]]), np.array([[1 << 32]]))
