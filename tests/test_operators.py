import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomvec.functions import expr as E
from loomvec.operators import allocation as B
from loomvec.operators import analytics as Y
from loomvec.operators import codebooks as C
from loomvec.operators import compressors as P
from loomvec.operators import normalize as N
from loomvec.operators import quantizers as Q
from loomvec.operators import rotations as R
from loomvec.operators import scoring as S
from loomvec.plans import evaluation, presets
from loomvec.sources import vectors as X


def table(spark, x, **more):
    rows = [(i, v.tolist(), *[c[i] for c in more.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["vec_id long, vec array<double>", *[f"{k} int" for k in more]]))


def units(n, d, seed=42):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


NAMES = ("haar", "wht", "cd4", "cd8", "hybrid", "e8block", "clifford", "kac")


@pytest.mark.parametrize("name", NAMES)
def test_rotations_are_orthogonal(name):
    r = R.make(name, 64)
    assert np.allclose(r.matrix @ r.matrix.T, np.eye(64), atol=1e-6)
    assert np.array_equal(R.make(name, 64).matrix, r.matrix)


def test_layers_and_sandwich():
    for r in (R.hypercomplex_layers(64), R.hypercomplex(64, 4, sandwich=True)):
        assert np.allclose(r.matrix @ r.matrix.T, np.eye(64), atol=1e-6)


def test_factories_refuse_what_they_do_not_know():
    for name in ("nothing", "cdabc", "cd"):
        with pytest.raises(ValueError):
            R.make(name, 64)
    with pytest.raises(ValueError):
        R.make("cd8", 100)
    with pytest.raises(ValueError):
        Q.make("nothing", 64, 3)
    with pytest.warns(UserWarning):
        Q.make("e8", 64, 3)
    r = R.haar(8)
    assert R.make(r, 8) is r


def test_rotation_on_a_table_in_both_forms(spark):
    x = units(40, 64)
    t = table(spark, x)
    got = np.array([r[0] for r in R.rotate(t, R.wht(64)).orderBy("vec_id").select("rotated").collect()])
    fast = np.array([r[0] for r in t.orderBy("vec_id").select(R.wht_column(F.col("vec"), 64)).collect()])
    assert np.allclose(got, R.wht(64).rotate(x)) and np.allclose(fast, got)


def test_pca_diagonalizes(spark):
    x = np.random.default_rng(0).standard_normal((300, 8)) @ np.diag(range(1, 9))
    y = R.pca(table(spark, x)).rotate(x)
    c = np.cov(y.T)
    assert np.allclose(c, np.diag(np.diag(c)), atol=1e-8) and (np.diff(np.diag(c)) <= 1e-9).all()


def test_lloyd_max_tables():
    for bits, want in zip((1, 2, 3, 4), (0.3634, 0.1175, 0.0345, 0.0095), strict=True):
        c, b = C.lloyd_max(128, bits)
        assert len(c) == 1 << bits and np.allclose(c, -np.array(c)[::-1], atol=1e-6) and list(b) == sorted(b)
        assert abs(C.expected_distortion(128, bits) * 128 - want) < 6e-4
    exact, _ = C.lloyd_max(64, 2, exact=True)
    assert np.allclose(exact, C.lloyd_max(64, 2)[0], rtol=0.05)
    assert C.sphere_density(0.0, 400) > 0


@settings(max_examples=60, deadline=None)
@given(st.floats(-1, 1))
def test_index_is_the_nearest_centroid(x):
    c, b = C.lloyd_max(64, 3)
    i = sum(x > y for y in b)
    assert abs(x - c[i]) <= min(abs(x - y) for y in c) + 1e-12


def test_e8_nearest_against_all_near_points():
    x = np.random.default_rng(1).standard_normal((60, 8))
    near = C.e8_nearest(x)
    offsets = np.vstack([np.zeros((1, 8)), C.e8_roots(), [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 4]])
    best = ((x[:, None, :] - (near[:, None, :] + offsets[None])) ** 2).sum(-1).min(1)
    assert np.allclose(best, ((x - near) ** 2).sum(-1))
    assert np.allclose(C.e8_nearest(C.e8_roots()), C.e8_roots()) and not C.e8_nearest(np.zeros((1, 8))).any()
    assert ((x - C.e8_nearest(x, "reference")) ** 2).mean() > ((x - near) ** 2).mean()


def test_prefix_codebooks(spark):
    sizes = [len(C.prefix_codebook(x)) for x in C.LEVELS]
    assert sizes == [2187, 2048, 1026, 512, 256, 32]
    for small in ("256", "32"):
        got = np.array([r["c"] for r in C.prefix_codebook_table(spark, small).orderBy("code").collect()])
        assert np.array_equal(got, C.prefix_codebook(small))
    with pytest.raises(ValueError):
        C.in_level((0,) * 8, "100")


def test_codebook_quantizers(spark):
    x = units(50, 64)
    for name in ("z8_256", "kmeans_64", "e8"):
        with pytest.warns(UserWarning) if name == "e8" else __import__("contextlib").nullcontext():
            q = Q.make(name, 64, 2)
        t = table(spark, x)
        with pytest.raises(ValueError):
            q.round_trip(F.col("vec"))
        y = np.array([r[0] for r in t.orderBy("vec_id").select(q.fit(t).round_trip(F.col("vec"))).collect()])
        assert y.shape == x.shape and 0 < ((x - y) ** 2).mean() < (x * x).mean()


@pytest.mark.parametrize("parts", [1, 3])
def test_per_channel_per_row_and_groups(spark, parts):
    x = np.random.default_rng(5).standard_normal((30, 20))
    t = table(spark, x).repartition(parts)
    lo, hi = x.min(0), x.max(0)
    want = np.clip(np.rint((x - lo) / ((hi - lo) / 7)), 0, 7) * (hi - lo) / 7 + lo
    got = np.array([r[0] for r in Q.quantize_channels(t, "vec", 3).orderBy("vec_id").select("restored").collect()])
    assert np.allclose(got, want)
    q = t.withColumn("q", Q.quantize_row(F.col("vec"), 3)).withColumn("r", Q.restore_row(F.col("q")))
    got = np.array([r[0] for r in q.orderBy("vec_id").select("r").collect()])
    assert np.abs(got - x).max() <= ((x.max(1) - x.min(1)) / 7).max() / 2 + 1e-9
    g = t.withColumn("p", Q.group_params(F.col("vec"), 20, 8, 4))
    g = g.withColumn("r", Q.group_dequantize(Q.group_quantize(F.col("vec"), F.col("p"), 8, 4), F.col("p"), 8, 4))
    r = g.orderBy("vec_id").select("r", F.size("p")).first()
    assert r[1] == 3 and np.abs(np.array(r[0]) - x[0]).max() < 0.4


def test_normalisation_and_back(spark):
    x = np.vstack([np.random.default_rng(6).standard_normal((40, 16)) + 5, np.zeros((1, 16))])
    t, mean = N.nsn(table(spark, x))
    back = np.array([r[0] for r in t.orderBy("vec_id").select(N.nsn_restore(F.col("normalized"), mean, F.col("norm1"), F.col("norm2"))).collect()])
    assert np.abs(back - x).max() < 1e-4


def test_window_counts(spark):
    t = spark.range(1024).withColumn("q", N.quantizes(F.col("id"), F.lit(1024), 4, 128))
    assert t.where("q").count() == 1024 - 132
    assert spark.range(10).where(N.quantizes(F.col("id"), F.lit(10), 4, 128)).count() == 6


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_error_within_twice_the_bound(spark, bits):
    t = P.Mse(128, bits, "wht").transform(table(spark, units(200, 128)))
    e = E.minus(F.col("vec"), F.col("restored"))
    assert t.agg(F.avg(E.dot(e, e))).first()[0] <= 2 * math.sqrt(3) * math.pi / 2 * 4.0**-bits


def test_estimates_are_unbiased_and_correlated(spark):
    c = P.Prod(128, 3, "wht")
    x, y = units(500, 128, 1), units(500, 128, 2)
    t = c.project(spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, vec array<double>, q array<double>"))
    t = c.compress(t).select(E.dot(F.col("q"), F.col("vec")).alias("x"), c.estimate(F.col("q"), F.col("q_proj"), F.col("k_mse"), F.col("sign_words"), F.col("residual_norm")).alias("y"))
    r = t.agg(F.avg(F.col("y") - F.col("x")), F.corr("x", "y")).first()
    assert abs(r[0]) < 0.1 and r[1] > 0.5


def test_key_compressor_finds_the_needle_in_any_partitioning(spark):
    x = units(300, 64)
    ranks = []
    for parts in (1, 7):
        k = table(spark, x).withColumnRenamed("vec_id", "k_id").repartition(parts)
        ranks.append([r["rank"] for r in evaluation.needle_retrieval(k, x[100].tolist(), 100, (3, 4)).orderBy("bits").collect()])
    assert ranks[0] == ranks[1] and max(ranks[0]) <= 5


def test_rebuilding_from_what_is_stored(spark):
    c = P.KeyCompressor(64, 3, "wht")
    t = c.compress(table(spark, units(50, 64)))
    a = {r["vec_id"]: np.array(r["k_mse"]) for r in t.select("vec_id", "k_mse").collect()}
    b = {r["vec_id"]: np.array(r["k_mse"]) for r in c.rebuild(t).select("vec_id", "k_mse").collect()}
    assert max(np.abs(a[i] - b[i]).max() for i in a) < 1e-3


def test_low_rank_is_exact_at_full_rank_of_the_data(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 16))
    t = table(spark, x).select(F.lit(0).alias("b"), F.lit(0).alias("h"), F.col("vec_id").alias("s"), "vec")
    e = Y.mse(P.svd_compress(t, 4, 6), "vec", "restored").first()["mse"]
    assert e < 0.01 * (x * x).mean()
    assert np.allclose(Y.explained_variance(table(spark, x), 4)[-1], 1)


def test_towers():
    assert P.tower(64) == [(0, 4), (4, 8), (8, 16), (16, 32), (32, 64)]
    with pytest.raises(ValueError):
        P.tower(100)
    assert set(B.tower_bits(64, 3)) == {2}


def test_top_k_recall_and_ranks(spark):
    s = spark.createDataFrame([(0, i, float(i % 7), float(i % 7) + (0.5 if i == 3 else 0)) for i in range(20)], "q_id int, k_id int, score double, est double")
    exact, est = s.select("q_id", "k_id", "score"), s.select("q_id", "k_id", F.col("est").alias("score"))
    assert [r["k_id"] for r in S.ranked(exact, k=2).orderBy("rank").collect()] == [6, 13]
    assert S.recall(exact, est, 5).first()[0] == 1.0 and S.top1_match(exact, est).first()[0] == 1.0
    assert S.needle_rank(exact, F.col("k_id") == 13).first()["rank"] == 2


def test_allocators():
    v = [.1, .5, 1, 2, 5, 10]
    bits = B.unified(v, 3.0)
    assert all(2 <= b <= 8 for b in bits) and sum(bits) <= 18 and bits == sorted(bits)
    assert B.unified(v, 3.0, metric="cosine") != bits
    assert B.allocate([], 3) == [] and B.force(0, 1.0) == 0 and B.force(3, 1.0) > B.force(2, 1.0)
    uniform = sum(B.distortion(3, x) for x in v)
    assert sum(B.distortion(b, x) for b, x in zip(bits, v, strict=True)) <= uniform


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(1e-3, 100), min_size=1, max_size=12), st.floats(2, 6))
def test_allocations_stay_within_limits(v, budget):
    assert all(2 <= b <= 6 for b in B.allocate([B.Region(3, x) for x in v], budget, 2, 6))


def test_greedy_bits_as_a_loop(spark):
    scores = [0.9, 0.1, 0.5, 0.7, 0.3]
    t = spark.createDataFrame([(0, i, s) for i, s in enumerate(scores)], "layer int, head int, sensitivity double")
    got = {r["head"]: r["bits"] for r in B.greedy_bits(t, 2.5).collect()}
    bits, total = dict.fromkeys(range(5), 1), 5
    for h in sorted(bits, key=lambda h: -scores[h]):
        while bits[h] < 4 and total < int(5 * 2.5):
            bits[h] += 1
            total += 1
    assert got == bits


def test_short_sequences_have_neutral_fidelity(spark):
    t = spark.createDataFrame([(0, 0, i, [1.0] * 8, [1.0] * 8) for i in range(2)], "b int, h int, s int, a array<double>, q array<double>")
    r = Y.fidelity_summary(t, 8).first()
    assert tuple(r) == (1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0)


def test_quartiles_put_the_rest_last(spark):
    t = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)], "k int, a double, e double")
    got = {r["quartile"]: r["mean"] for r in Y.quartile_means(t, "a", "e", "k").collect()}
    assert got == {0: 0.5, 1: 2.5, 2: 4.5, 3: 7.5}
    assert all(math.isnan(r["mean"]) for r in Y.quartile_means(t.limit(3), "a", "e", "k").collect())


def test_affinity_is_low_for_zero_divisors(spark):
    e = np.eye(16)
    t = Y.zero_divisor_affinity(table(spark, np.stack([e[1] + e[10], e[0]])))
    r = {x["vec_id"]: x["affinity"] for x in t.collect()}
    assert r[0] < 0.75 and abs(r[1] - 1) < 1e-6


def test_presets_and_storage():
    assert presets.recommended().bits == 4 and not presets.recommended().use_qjl and presets.recommended_e8().rotation == "cd8"
    assert presets.fast(100).rotation == "haar" and presets.experimental_tower().hierarchical and presets.CachePreset().recent == 128
    s = P.storage(1000, 128, 3)
    assert s["total"] < s["original"] and s["ratio"] > 1


def test_sources(spark, tmp_path):
    t = X.gaussian(spark, 100, 16)
    assert t.count() == 100 and abs(t.select(E.norm(F.col("vec")).alias("n")).agg(F.avg("n")).first()[0] - 1) < 1e-9
    x = np.arange(24.0).reshape(2, 3, 4)
    assert X.from_arrays(spark, x, ("h", "s")).where("h = 1 and s = 2").first()["vec"] == [20, 21, 22, 23]
    out = X.with_outliers(X.from_arrays(spark, x, ("h", "s")), {1: 10.0}).where("h = 0 and s = 0").first()["vec"]
    assert out == [0, 10, 2, 3]
    X.save_constants(spark, str(tmp_path / "m"), scale=2.5, mean=(1.0, 2.0))
    assert X.load_constants(spark, str(tmp_path / "m")) == {"scale": 2.5, "mean": [1.0, 2.0]}
    assert X.layered(t, t).groupBy("layer").count().count() == 2


def test_empty_tables(spark):
    t = spark.createDataFrame([], "vec_id long, vec array<double>")
    assert P.Mse(8, 2, "wht").transform(t).count() == 0 and E.require_dim(t, "vec") == 0
    with pytest.raises(ValueError):
        E.require_dim(table(spark, units(2, 12)), "vec", 8)
