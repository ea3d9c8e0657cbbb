"""Hard negatives against brute force."""

import numpy as np
from pyspark.sql import functions as F

from loomvec.llm import negatives as M

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every=50, positives=5, negatives=3, scale=256):
    good = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v, lab in {(i, tuple(v), lab) for i, v, lab in good if i % every == 0}:
        others = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, lab2 == lab) for j, w, lab2 in good if j != i and len(w) == len(v))
        for s, j, _ in [x for x in others if x[2]][:positives]:
            fit = [(t, k) for t, k, same in others if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit[:negatives])}
    return out


def held(spark, rows, **kw):
    found, scored = M.mine(spark.createDataFrame(rows, SCHEMA), **kw)
    return {tuple(r) for r in found.collect()}, scored.agg(F.sum("scored")).first()[0]


def test_against_brute_force_with_nulls_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], int(rng.integers(0, 3)), "x") for i in range(240)]
    rows += [(300 + i, list(rows[100][1]), i % 2, "copy") for i in range(30)]  # one very common vector
    rows += [(50, list(rows[50][1]), rows[50][2], "again"), (7, list(rows[7][1]), rows[7][2], "again")]
    rows += [(None, [1.0] * 6, 1, "n"), (400, None, 1, "n"), (450, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "n"), (500, [float("nan")] * 6, 1, "n"), (550, [float("inf")] * 6, 1, "n"), (600, [1.0] * 6, None, "n")]
    rows += [(650, [], 1, "e"), (651, [], 1, "e"), (652, [], 2, "e"), (700, [1.0, 2.0], 1, "w"), (701, [2.0, 1.0], 1, "w"), (702, [1.0, 1.0], 2, "w"), (750, [0.0] * 6, 1, "zero"), (800, [1.0] * 3, 9, "alone")]
    want = brute(rows)
    got, _ = held(spark, rows, bucket=40, group=4)
    assert got == want and any(r[0] == 650 and r[4] == 0 for r in got)


def test_small_buckets_of_small_tables(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAST_BUCKET", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5) * rng.gamma(1.0)], int(rng.integers(0, 4)), "x") for i in range(400)]
    assert held(spark, rows, every=10)[0] == brute(rows, every=10)


def test_bounds_prune_where_norms_differ(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAST_BUCKET", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 8))
    x *= (np.exp(rng.normal(size=4000) * 1.5) / np.linalg.norm(x, axis=1))[:, None]
    rows = [(i, [float(y) for y in v], i % 4, "x") for i, v in enumerate(x)]
    got, scored = held(spark, rows, every=400)
    assert got == brute(rows, every=400)
    assert scored < 0.5 * 10 * 4000 * 1.25  # of what both searches could score


def test_great_components_and_empty_tables(spark):
    rows = [(0, [1e30, -1e30], 1, "x"), (1, [1e30, -1e29], 1, "x"), (2, [1e30, 1e30], 2, "x"), (3, [9e29, -0.1], 2, "x")]
    assert held(spark, rows)[0] is not None
    assert M.mine(spark.createDataFrame([], SCHEMA))[0].collect() == []


def test_lists_of_the_best():
    rng = np.random.default_rng(2)
    for k, width in ((3, 2), (3, 200), (5, 40)):
        best, names = np.full((4, k), M._LEAST), np.full((4, k), M._NO_ID)
        seen = [[] for _ in range(4)]
        for at in range(5):
            score = rng.integers(-9, 9, (4, width)).astype(np.float32)
            score[rng.random((4, width)) < 0.3] = -np.inf
            ids = np.arange(at * width, (at + 1) * width)
            for r in range(4):
                seen[r] += [(-int(s), int(i)) for s, i in zip(score[r], ids, strict=True) if s > -np.inf]
            M.take(best, names, np.arange(4), score, ids)
        for r in range(4):
            want = sorted(seen[r])[:k]
            assert [(-int(s), int(i)) for s, i in zip(best[r], names[r], strict=True) if i != M._NO_ID] == want
