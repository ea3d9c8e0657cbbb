"""Presets: their settings, and that each flag does what it says."""

import numpy as np
import pytest

from loomvec.operators import scoring as S
from loomvec.plans import presets as P
from loomvec.sources import vectors as X


def test_settings():
    assert [P.recommended(64, b).use_qjl for b in (2, 3, 4)] == [True, True, False] and P.recommended(100).rotation == "haar" and P.recommended(64).rotation == "wht"
    assert P.per_axis().keys.use_qjl and not P.per_axis().values.use_qjl and (P.per_axis().key_axis, P.per_axis().value_axis) == ("per_channel", "per_token")
    assert [P.enhanced(b, b).keys.use_qjl for b in (3, 4)] == [True, False] and not P.enhanced().values.use_qjl
    assert not P.published_default().use_sign_packing and [P.fast(64, b).use_qjl for b in (2, 3)] == [True, False]
    assert P.recommended_e8().quantizer == "e8" and P.experimental_clifford().rotation == "clifford"
    assert P.experimental_tower().hierarchical and P.experimental_tower().adaptive and P.experimental_tower().min_level_bits == 1


def test_sign_bytes():
    assert (P.Preset().sign_bytes(64), P.published_default().sign_bytes(64), P.recommended(64, 4).sign_bytes(64)) == (8, 64, 0)


@pytest.fixture(scope="module")
def keys(spark):
    x = np.random.default_rng(3).standard_normal((60, 64))
    return X.from_arrays(spark, (x / np.sqrt((x * x).sum(1, keepdims=True)))[None, None]).withColumnRenamed("s", "k_id")


def test_without_a_sketch_its_bit_goes_to_the_quantizer(spark, keys):
    q = keys.where("k_id < 5").selectExpr("b", "h", "k_id as q_id", "vec as q")
    exact = S.all_scores(q, keys.selectExpr("b", "h", "k_id", "vec as k"))
    for preset, bits in ((P.recommended(64, 4), 4), (P.recommended(64, 3), 2)):
        c = preset.keys(64)
        t = c.compress(keys)
        assert c.mse.bits == bits and (t.where("sign_words is null").count() == 60) == (not preset.use_qjl)
        assert S.errors(exact, c.scores(q, t)).first()["corr"] > 0.9


def test_towers_and_scaling_are_applied(spark, keys):
    p = P.experimental_tower(64)
    t = p.restored(keys, 64)
    x, y = (np.array([r[c] for r in t.collect()]) for c in ("vec", "restored"))
    assert np.allclose((x * y).sum(1), (x * x).sum(1), atol=1e-6)  # what scaling makes equal
    plain = np.array([r["restored"] for r in P.fast(64).restored(keys, 64).collect()])
    assert not np.allclose((x * plain).sum(1), (x * x).sum(1), atol=1e-3)
