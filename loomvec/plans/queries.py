"""Registered queries of the vector engine and the SQL that each must equal.

Every query runs over its whole table. Floats are rounded to six places on both sides; constants
(matrices, codebooks, boundaries) come from one source for both.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import catalog
from ..functions import expr as E
from ..operators import allocation as B
from ..operators import analytics as Y
from ..operators import clustering as G
from ..operators import codebooks as C
from ..operators import compressors as P
from ..operators import factors as U
from ..operators import normalize as N
from ..operators import packed as K
from ..operators import quantizers as Q
from ..operators import rotations as R
from ..operators import scoring as S
from ..sources import vectors as X
from ..sources.shared import new_path
from . import composite_sql as Z
from . import evaluation
from . import oracle as O
from . import trials as T

D = 64
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, Callable[[], str]] = {}


def query(sql: Callable[[], str] | str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql if callable(sql) else lambda: sql
        return f

    return add


def r6(c: Column, name: str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def vec() -> Column:
    return F.col("vec")


def flat(df: DataFrame, column: Column, key: str = "vec_id") -> DataFrame:
    """(key, i, x): a vector column element by element."""
    return df.select(key, F.posexplode(column).alias("i", "y")).select(key, "i", r6(F.col("y"), "x"))


def flat_sql(ctes: str, source: str, expr: str, key: str = "vec_id") -> str:
    return f"with {ctes}, o as (select {key}, {expr} as y from {source}) select {key}, (i - 1)::int as i, {O.r6('y[i]', 'x')} from o, unnest(range(1, len(y) + 1)) as t(i)"


# Scans and sources


@query(f"with {O.V} select label, count(*) as n, min(len(vec))::int as d, {O.r6('sum(list_sum(vec))', 'total')} from v group by label")
def scan_vectors(spark, d):
    return X.vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("d"), r6(F.sum(E.total(vec())), "total"))


@query(f"with {O.KV} select h, s::int as s, k_id from k")
def key_positions(spark, d):
    return X.keys(spark, d).select("h", "s", "k_id")


OUTLIERS = {3: 10.0, 31: 8.0, 47: 6.0}
_OUT = "[x * (case i - 1 when 3 then 10.0e0 when 31 then 8.0e0 when 47 then 6.0e0 else 1e0 end) for x, i in vec]"


@query(f"with {O.V}, o as (select {_OUT} as y from v) select (i - 1)::int as ch, {O.r6('max(abs(y[i]))', 'top')} from o, unnest(range(1, 65)) as t(i) group by i")
def outlier_channels(spark, d):
    return X.with_outliers(X.vectors(spark, d), OUTLIERS).select(F.posexplode("vec").alias("ch", "x")).groupBy("ch").agg(r6(F.max(F.abs("x")), "top"))


@query(f"with {O.V}, n as (select count(*) // 3 as at from v) select q.vec_id, {O.r6(O.dot('q.vec', 'q.vec'), 'self')} from v q, n where q.vec_id = n.at")
def needle_vector(spark, d):
    t = X.vectors(spark, d)
    return t.where(F.col("vec_id") == t.count() // 3).select("vec_id", r6(E.dot(vec(), vec()), "self"))


# Projections


@query(f"with {O.V} select vec_id, {O.r6(O.norm('vec'), 'norm')} from v")
def norms(spark, d):
    return X.vectors(spark, d).select("vec_id", r6(E.norm(vec()), "norm"))


@query(flat_sql(f"{O.V}, w as (select vec_id, vec, greatest({O.norm('vec')}, 1e-12) as n from v)", "w", "[x / n for x in vec]"))
def unit_vectors(spark, d):
    return flat(X.vectors(spark, d), E.unit(vec()))


@query(flat_sql(f"{O.V}, w as (select vec_id, vec, {O.norm('vec')} + 1e-8 as n from v)", "w", "[x / n for x in vec]"))
def unit_vectors_plus(spark, d):
    return flat(X.vectors(spark, d), E.unit_plus(vec()))


_PAIR = f"{O.V}, p as (select vec_id, vec as a, lead(vec) over (partition by label order by vec_id) as b from v)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return X.vectors(spark, d).select("vec_id", vec().alias("a"), F.lead("vec").over(W.partitionBy("label").orderBy("vec_id")).alias("b")).where("b is not null")


@query(f"with {_PAIR} select vec_id, {O.r6(O.dot('a', 'b'), 'dot')}, {O.r6(O.dot('a', 'b') + ' / (greatest(' + O.norm('a') + ', 1e-8) * greatest(' + O.norm('b') + ', 1e-8))', 'cosine')} from p where b is not null")
def dots_and_cosines(spark, d):
    return pairs(spark, d).select("vec_id", r6(E.dot(F.col("a"), F.col("b")), "dot"), r6(E.cosine(F.col("a"), F.col("b")), "cosine"))


@query(f"with {O.V} select vec_id, {O.r6('list_sum([greatest(-65504e0, least(65504e0, x * 1e6)) for x in vec])', 'clamped')} from v")
def clamp_half(spark, d):
    return X.vectors(spark, d).select("vec_id", r6(E.total(F.transform("vec", lambda x: E.clamp(x * 1e6))), "clamped"))


@query(f"with {O.V} select vec_id, j::int as block, {O.r6('list_sum(vec[j * 8 + 1:j * 8 + 8])', 'total')} from v, unnest(range(0, 8)) as t(j)")
def block_sums(spark, d):
    return X.vectors(spark, d).select("vec_id", F.posexplode(E.blocks(vec(), 8)).alias("block", "x")).select("vec_id", "block", r6(E.total(F.col("x")), "total"))


@query(f"with {O.V} select vec_id, {O.r6('list_sum(vec[1:16])', 'head16')}, {O.r6('list_sum(vec)', 'head100')} from v")
def prefixes(spark, d):
    return X.vectors(spark, d).select("vec_id", r6(E.total(E.head(vec(), 16)), "head16"), r6(E.total(E.head(vec(), 100)), "head100"))


@query(f"with {_PAIR} select vec_id, {O.r6('sqrt(list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, 65)]))', 'norm')} from p where b is not null")
def residual_norms(spark, d):
    return pairs(spark, d).select("vec_id", r6(E.norm(E.minus(F.col("a"), F.col("b"))), "norm"))


@query(f"with {O.KV}, n as (select *, count(*) over (partition by h) as len from k) select k_id, (s >= 4 and not (len > 16 and s >= len - 16)) as quantized from n")
def precision_windows(spark, d):
    t = X.keys(spark, d).withColumn("len", F.count("*").over(W.partitionBy("h")))
    return t.select("k_id", N.quantizes(F.col("s"), F.col("len"), 4, 16).alias("quantized"))


def _prefix_sql() -> str:
    cond = lambda prefix: "(" + " and ".join(f"p[{i + 1}] = {x}" for i, x in enumerate(prefix)) + ")"
    ctes = ["u as (select id, [((id // (3 ** (7 - i))::bigint) % 3 - 1)::int for i in range(0, 8)] as p from range(6561) t(id))", "l0 as (select id, p from u where p[1] <> 1 and list_sum(p) % 2 = 0 and len([x for x in p if x <> 0]) % 2 = 0)"]
    for n, level in enumerate(C.LEVELS[1:], 1):
        parts = [f"not {cond(c)}" for c in C.PREFIX_CUTS[level]] + ([cond(C.LEADS[level])] if level in C.LEADS else []) + (["not (p[5] = 1 and p[6] <> -1)"] if level == "32" else [])
        ctes.append(f"l{n} as (select id, p from l{n - 1} where {' and '.join(parts)})")
    return "with " + ", ".join(ctes) + " " + " union all ".join(f"select '{level}' as level, id as code from l{n}" for n, level in enumerate(C.LEVELS))


@query(_prefix_sql)
def prefix_codebooks(spark, d):
    out = None
    for level in C.LEVELS:
        t = C.prefix_codebook_table(spark, level).select(F.lit(level).alias("level"), "code")
        out = t if out is None else out.unionByName(t)
    return out


# Rotations: the same matrix on both sides


def rotation_query(name: str) -> None:
    def sql() -> str:
        return flat_sql(f"{O.V}, m as (select {O.mat(R.make(name, D).matrix)} as m)", "v, m", O.matvec("m", "vec"))

    def run(spark, d):
        return flat(X.vectors(spark, d), R.make(name, D).column(vec()))

    run.__name__ = f"rotate_{name}"
    query(sql)(run)


for _name in ("haar", "wht", "cd4", "cd8", "cd16", "hybrid", "e8block", "clifford", "kac"):
    rotation_query(_name)


@query(lambda: flat_sql(f"{O.V}, m as (select {O.mat(R.wht(D).matrix)} as m)", "v, m", O.matvec("m", "vec")))
def rotate_wht_butterfly(spark, d):
    return flat(X.vectors(spark, d), R.wht_column(vec(), D))


@query(lambda: flat_sql(f"{O.V}, m as (select {O.mat(R.hypercomplex_layers(D).matrix)} as m)", "v, m", O.matvec("m", "vec")))
def rotate_layers(spark, d):
    return flat(X.vectors(spark, d), R.hypercomplex_layers(D).column(vec()))


@query(lambda: flat_sql(f"{O.V}, m as (select {O.mat(R.hypercomplex(D, 4, sandwich=True).matrix)} as m)", "v, m", O.matvec("m", "vec")))
def rotate_sandwich(spark, d):
    return flat(X.vectors(spark, d), R.hypercomplex(D, 4, sandwich=True).column(vec()))


@query(f"with {O.V} select vec_id, (i - 1)::int as i, round(vec[i], 4) + 0.0 as x from v, unnest(range(1, 65)) as t(i)")
def rotate_and_back(spark, d):
    r = R.hybrid(D)
    t = R.rotate(R.rotate(X.vectors(spark, d), r), r, "rotated", "back", back=True)
    # Through float32, the type of the table, which takes the last bits of the products away.
    return t.select("vec_id", F.posexplode("back").alias("i", "x")).select("vec_id", "i", (F.round(F.col("x").cast("float").cast("double"), 4) + F.lit(0.0)).alias("x"))


@query()
def rotate_pca(spark, d):
    t = X.vectors(spark, d)
    # Signs of eigenvectors are free; the variances along them are not.
    return Y.distribution(R.rotate(t, R.pca(t)), "rotated").select("ch", r6(F.col("variance"), "variance"))


@query(Z.pca_invariants)
def pca_invariants(spark, d):
    """What the principal axes must keep whatever the signs of eigenvectors: the total variance, and the squares of all covariances in the variances alone."""
    t = X.vectors(spark, d)
    v = Y.distribution(R.rotate(t, R.pca(t)), "rotated").select("ch", "variance")
    falling = F.forall(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.get("v", i - 1) >= F.get("v", i) - 1e-12)
    v = v.agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "variance"))), lambda x: x["variance"]).alias("v"))
    return v.select(r6(E.total(F.col("v")), "total"), r6(E.dot(F.col("v"), F.col("v")), "squares"), F.size("v").alias("channels"), falling.alias("falling"))


@query(Z.rotation_quality)
def rotation_quality(spark, d):
    q = R.quality(X.vectors(spark, d), R.hybrid(D))
    return q.select(F.lit("hybrid").alias("rotation"), r6(F.col("invertibility_error"), "invertibility"), r6(F.col("isometry_error"), "isometry"), r6(F.col("coord_variance"), "coord_variance"), r6(F.col("max_cross_corr"), "max_cross_corr"))


# Quantizers


def _bounds(bits: int, d: int = D):
    return C.lloyd_max(d, bits)


def _q_sql(bits: int, v: str = "vec", d: int = D) -> str:
    return f"[{O.count_above('x', _bounds(bits, d)[1])} for x in {v}]"


def _deq_sql(bits: int, v: str = "vec", d: int = D) -> str:
    return f"[{O.arr(_bounds(bits, d)[0])}[{O.count_above('x', _bounds(bits, d)[1])} + 1] for x in {v}]"


@query(lambda: " union all ".join(f"select {b} as bits, i::int as idx, {O.r6(O.arr(_bounds(b)[0]) + '[i + 1]', 'centroid')} from range({1 << b}) t(i)" for b in (1, 2, 3, 4)))
def lloyd_max_tables(spark, d):
    rows = [(b, i, x) for b in (1, 2, 3, 4) for i, x in enumerate(_bounds(b)[0])]
    return spark.createDataFrame(rows, "bits int, idx int, x double").select("bits", "idx", r6(F.col("x"), "centroid"))


@query(lambda: flat_sql(O.V, "v", _q_sql(3)).replace("round(y[i], 6) + 0.0 as x", "y[i]::int as x"))
def scalar_indices(spark, d):
    return X.vectors(spark, d).select("vec_id", F.posexplode(Q.Scalar(D, 3).quantize(vec())).alias("i", "x")).select("vec_id", "i", F.col("x").cast("int").alias("x"))


@query(lambda: f"with {O.V}, o as (select label, vec, {_deq_sql(3)} as y from v) select label, {O.r6('avg(list_sum([(vec[i] - y[i]) * (vec[i] - y[i]) for i in range(1, 65)]) / 64)', 'mse')} from o group by label")
def scalar_mse(spark, d):
    return Y.mse(X.vectors(spark, d).withColumn("y", Q.Scalar(D, 3).round_trip(vec())), "vec", "y", "label").select("label", r6(F.col("mse"), "mse"))


def _mse_sql(bits: int, rotation: str) -> str:
    m = R.make(rotation, D).matrix
    return f"""{O.V}, m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt), u as (select vec_id, label, vec, {O.matvec('m', 'vec')} as y, mt from v, m),
    q as (select vec_id, label, vec, {_deq_sql(bits, 'y')} as z, mt from u), w as (select vec_id, label, vec, {O.matvec('mt', 'z')} as r from q)"""


@query(lambda: f"with {_mse_sql(3, 'wht')} select label, {O.r6('avg(list_sum([(vec[i] - r[i]) * (vec[i] - r[i]) for i in range(1, 65)]))', 'error')} from w group by label")
def compress_mse(spark, d):
    t = P.Mse(D, 3, "wht").transform(X.vectors(spark, d))
    e = E.minus(vec(), F.col("restored"))
    return t.groupBy("label").agg(r6(F.avg(E.dot(e, e)), "error"))


_E8 = """e as (select vec_id, j, [vec[j * 8 + i] * 8 for i in range(1, 9)] as x from v, unnest(range(0, 8)) as t(j)),
a0 as (select *, [round_even(t, 0) for t in x] as r, [round_even(t - 0.5e0, 0) for t in x] as h from e),
a1 as (select *, [x[i] - r[i] for i in range(1, 9)] as dr, [x[i] - 0.5e0 - h[i] for i in range(1, 9)] as dh from a0),
a2 as (select *, list_position([abs(t) for t in dr], list_max([abs(t) for t in dr])) as ir, list_position([abs(t) for t in dh], list_max([abs(t) for t in dh])) as ih from a1),
a3 as (select *, [r[i] + case when i = ir and list_sum(r) % 2 <> 0 then case when dr[i] >= 0 then 1 else -1 end else 0 end for i in range(1, 9)] as p,
  [h[i] + 0.5e0 + case when i = ih and list_sum(h) % 2 <> 0 then case when dh[i] >= 0 then 1 else -1 end else 0 end for i in range(1, 9)] as g from a2),
a4 as (select vec_id, j, list_sum([(x[i] - p[i]) * (x[i] - p[i]) for i in range(1, 9)]) as ep, list_sum([(x[i] - g[i]) * (x[i] - g[i]) for i in range(1, 9)]) as eg from a3)"""


@query(f"with {O.V}, {_E8} select vec_id, j::int as block, {O.r6('least(ep, eg)', 'error')} from a4")
def e8_errors(spark, d):
    near = Q._rounder(lambda x: C.e8_nearest(x))
    t = X.vectors(spark, d).select("vec_id", F.transform("vec", lambda x: x * 8).alias("x")).withColumn("y", near(F.col("x")))
    t = t.select("vec_id", F.posexplode(F.arrays_zip(E.blocks(F.col("x"), 8).alias("x"), E.blocks(F.col("y"), 8).alias("y"))).alias("block", "p"))
    e = E.minus(F.col("p.x"), F.col("p.y"))
    return t.select("vec_id", "block", r6(E.dot(e, e), "error"))


@query(Z.e8_scale_search)
def e8_scale_search(spark, d):
    t = X.vectors(spark, d)
    return Q.scale_errors(t, "vec", Q.table_rms(t, "vec")).select("step", r6(F.col("scale"), "scale"), r6(F.col("mse"), "mse"))


@query(Z.e8_root_counts)
def e8_root_counts(spark, d):
    t = spark.createDataFrame([(r.tolist(),) for r in C.e8_roots()], "r array<double>")
    return t.agg(F.count("*").cast("int").alias("roots"), F.max(E.dot(F.col("r"), F.col("r"))).alias("norm_sq"), F.sum((F.get("r", F.lit(0)) == F.rint(F.get("r", F.lit(0)))).cast("int")).cast("int").alias("whole"))


def _nearest_sql(codes: np.ndarray, divisor: float) -> str:
    return f"""with {O.V}, s as (select sqrt(sum(list_sum([x * x for x in vec])) / sum(len(vec))) / {O.num(divisor)} as scale from v),
    c as (select code, c from (select unnest(range(0, {len(codes)})) as code, unnest({O.mat(codes)}) as c)),
    e as (select vec_id, j, vec[j * 8 + 1:j * 8 + 8] as x, scale from v, s, unnest(range(0, 8)) as t(j)),
    n as (select vec_id, j, arg_min(list_sum([(x[i] - scale * c.c[i]) * (x[i] - scale * c.c[i]) for i in range(1, 9)]), list_sum([(x[i] / (scale + 1e-8) - c.c[i]) * (x[i] / (scale + 1e-8) - c.c[i]) for i in range(1, 9)])) as e from e, c group by vec_id, j)
    select vec_id, j::int as block, {O.r6('e', 'error')} from n"""


def _code_errors(spark: SparkSession, d: str, q: Q.Codebook) -> DataFrame:
    t = X.vectors(spark, d)
    fitted = q.fit(t)
    t = t.withColumn("y", fitted.round_trip(vec())).select("vec_id", F.posexplode(F.arrays_zip(E.blocks(vec(), 8).alias("x"), E.blocks(F.col("y"), 8).alias("y"))).alias("block", "p"))
    e = E.minus(F.col("p.x"), F.col("p.y"))
    return t.select("vec_id", "block", r6(E.dot(e, e), "error"))


@query(lambda: _nearest_sql(C.prefix_codebook("256"), C.rms(C.prefix_codebook("256")) + 1e-8))
def prefix_errors(spark, d):
    return _code_errors(spark, d, Q.Codebook("prefix", "256"))


@query(lambda: _nearest_sql(C.kmeans_codebook(64), 1.0))
def kmeans_errors(spark, d):
    return _code_errors(spark, d, Q.Codebook("kmeans", "64"))


@query(f"""with {O.V}, f as (select vec_id, i, vec[i] as x from v, unnest(range(1, 65)) as t(i)), c as (select i, min(x) as lo, greatest((max(x) - min(x)) / 3e0, 1e-8) as scale from f group by i)
select f.vec_id, (f.i - 1)::int as i, {O.r6('least(greatest(round_even((x - lo) / scale, 0), 0), 3) * scale + lo', 'x')} from f join c using (i)""")
def per_channel(spark, d):
    return flat(Q.quantize_channels(X.vectors(spark, d), "vec", 2), F.col("restored"))


@query(flat_sql(f"{O.V}, w as (select vec_id, vec, list_min(vec) as lo, greatest((list_max(vec) - list_min(vec)) / 3e0, 1e-8) as s from v)", "w", "[least(greatest(round_even((x - lo) / s, 0), 0), 3) * s + lo for x in vec]"))
def per_row(spark, d):
    t = X.vectors(spark, d).withColumn("q", Q.quantize_row(vec(), 2))
    return flat(t, Q.restore_row(F.col("q")))


_GROUPS = f"""with {O.V}, g as (select vec_id, j, vec[j * 24 + 1:least(j * 24 + 24, 64)] as x from v, unnest(range(0, 3)) as t(j)),
p as (select *, list_min(x) as lo, list_max(x) as hi from g), q as (select *, abs((lo + hi) / 2) < 0.1e0 * greatest(hi - lo, 1e-8) as sym from p),
s as (select *, case when sym then greatest(2e0 * greatest(abs(lo), abs(hi)) / 15, 1e-8) else greatest((hi - lo) / 15, 1e-8) end as scale, case when sym then 0e0 else lo end as zero from q),
o as (select *, [case when sym then (least(greatest(round_even(t / scale + 7.5e0, 0), 0), 15) - 7.5e0) * scale else least(greatest(round_even((t - zero) / scale, 0), 0), 15) * scale + zero end for t in x] as y from s)"""


@query(f"{_GROUPS} select vec_id, j::int as grp, sym as symmetric, {O.r6('scale', 'scale')}, {O.r6('list_sum([(x[i] - y[i]) * (x[i] - y[i]) for i in range(1, len(x) + 1)])', 'error')} from o")
def group_wise(spark, d):
    t = X.vectors(spark, d).withColumn("p", Q.group_params(vec(), D, 24, 4))
    t = t.withColumn("y", Q.group_dequantize(Q.group_quantize(vec(), F.col("p"), 24, 4), F.col("p"), 24, 4))
    t = t.withColumn("e", F.zip_with("vec", "y", lambda x, y: (x - y) * (x - y)))
    return t.select("vec_id", F.posexplode("p").alias("grp", "q"), "e").select("vec_id", "grp", F.col("q.symmetric").alias("symmetric"), r6(F.col("q.scale"), "scale"), r6(E.total(F.slice("e", F.col("grp") * 24 + 1, F.lit(24))), "error"))


TOWER_BITS = [5, 5, 4, 3, 2]


def _tower_sql() -> str:
    m = R.make("wht", D).matrix
    parts = " || ".join(_deq_sql(b, f"y[{lo + 1}:{hi}]", hi - lo) for (lo, hi), b in zip(P.tower(D), TOWER_BITS, strict=True))
    return f"with {O.V}, m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt), u as (select vec_id, label, vec, {O.matvec('m', 'vec')} as y, mt from v, m), z as (select vec_id, label, vec, {parts} as z, mt from u), w as (select label, vec, {O.matvec('mt', 'z')} as r from z) select label, {O.r6('avg(list_sum([(vec[i] - r[i]) * (vec[i] - r[i]) for i in range(1, 65)]) / 64)', 'mse')} from w group by label"


@query(_tower_sql)
def tower_mse(spark, d):
    return Y.mse(P.tower_transform(X.vectors(spark, d), TOWER_BITS), "vec", "restored", "label").select("label", r6(F.col("mse"), "mse"))


@query(lambda: f"""with {O.V}, m as (select {O.mat(R.make('wht', D, 142).matrix)} as m, {O.mat(R.make('wht', D, 142).matrix.T)} as mt), n as (select vec_id, label, vec, {O.norm('vec')} + 1e-8 as n, m, mt from v, m),
u as (select label, vec, n, mt, {O.matvec('m', '[x / n for x in vec]')} as y from n), z as (select label, vec, n, mt, {_deq_sql(3, 'y')} as z from u), w as (select label, vec, [x * n for x in {O.matvec('mt', 'z')}] as r from z)
select label, {O.r6('avg(list_sum([(vec[i] - r[i]) * (vec[i] - r[i]) for i in range(1, 65)]) / 64)', 'mse')} from w group by label""")
def value_compression(spark, d):
    return Y.mse(P.ValueCompressor(D, 3, "wht").transform(X.vectors(spark, d)), "vec", "restored", "label").select("label", r6(F.col("mse"), "mse"))


# Normalisation, sketches, packing

_NSN = f"""{O.V}, a as (select vec_id, vec, {O.norm('vec')} as n1 from v), u as (select vec_id, n1, [x / (n1 + 1e-8) for x in vec] as u from a),
cm as (select list(m order by i) as m from (select i, avg(u[i]) as m from u, unnest(range(1, 65)) as t(i) group by i)),
c as (select vec_id, n1, m, [u[i] - m[i] for i in range(1, 65)] as c from u, cm), w as (select vec_id, n1, m, c, {O.norm('c')} as n2 from c), z as (select vec_id, n1, n2, m, [x / (n2 + 1e-8) for x in c] as z from w)"""


@query(f"with {_NSN} select vec_id, {O.r6('n1', 'norm1')}, {O.r6('n2', 'norm2')}, {O.r6('list_sum([z[i] * i for i in range(1, 65)])', 'chk')} from z")
def nsn_normalize(spark, d):
    t, _ = N.nsn(X.vectors(spark, d))
    return t.select("vec_id", r6(F.col("norm1"), "norm1"), r6(F.col("norm2"), "norm2"), r6(E.dot(F.col("normalized"), E.literal(range(1, 65))), "chk"))


@query(flat_sql(f"{_NSN}", "z", "[(z[i] * n2 + m[i]) * n1 for i in range(1, 65)]"))
def nsn_round_trip(spark, d):
    t, mean = N.nsn(X.vectors(spark, d))
    return flat(t, N.nsn_restore(F.col("normalized"), mean, F.col("norm1"), F.col("norm2")))


@query(lambda: f"with {O.V}, q as (select vec_id, vec, {_deq_sql(2)} as y from v), f as (select vec_id, y, {O.dot('vec', 'vec')} / ({O.dot('vec', 'y')} + 1e-8) as f from q) select vec_id, {O.r6('f * list_sum(y)', 'total')} from f")
def adaptive_scaling(spark, d):
    return X.vectors(spark, d).withColumn("y", Q.Scalar(D, 2).round_trip(vec())).select("vec_id", r6(E.total(N.adaptive_scale(vec(), F.col("y"))), "total"))


@lru_cache(4)
def _sketch(seed: int = 43) -> np.ndarray:
    return P.sketch_matrix(D, D, seed)


_WORDS = "list_sum([case when p[i] >= 0 then (1::hugeint << (i - 1)) else 0::hugeint end for i in range(1, 65)])"
_SIGNED = f"(case when {_WORDS} >= 9223372036854775808::hugeint then {_WORDS} - 18446744073709551616::hugeint else {_WORDS} end)::bigint"


@query(lambda: f"with {O.V}, m as (select {O.mat(_sketch())} as m), p as (select vec_id, {O.matvec('m', 'vec')} as p from v, m) select vec_id, {_SIGNED} as word, len([x for x in p if x >= 0])::int as positive from p")
def sign_words(spark, d):
    t = X.vectors(spark, d).withColumn("s", P.sketch_signs(vec(), _sketch()))
    return t.select("vec_id", F.get(E.pack_signs(F.col("s"), D), F.lit(0)).alias("word"), F.size(F.filter("s", lambda x: x > 0)).alias("positive"))


@query(f"with {O.V} select vec_id, (i - 1)::int as i, case when vec[i] >= 0 then 1 else -1 end as x from v, unnest(range(1, 65)) as t(i)")
def sign_round_trip(spark, d):
    t = X.vectors(spark, d).select("vec_id", E.unpack_signs(E.pack_signs(E.signs(vec()), D, 32), D, 32).alias("s"))
    return t.select("vec_id", F.posexplode("s").alias("i", "x")).select("vec_id", "i", F.col("x").cast("int").alias("x"))


@query(f"with {_PAIR} select vec_id, {O.r6('list_sum([case when a[i] >= 0 then b[i] else -b[i] end for i in range(1, 65)])', 'dot')} from p where b is not null")
def packed_dots(spark, d):
    return pairs(spark, d).select("vec_id", r6(E.packed_dot(E.pack_signs(E.signs(F.col("a")), D), F.col("b"), D), "dot"))


@query(lambda: f"with {O.V}, m as (select {O.mat(_sketch())} as m), q as (select {O.matvec('m', 'vec')} as qp from v, m order by vec_id limit 1), p as (select vec_id, vec, {O.matvec('m', 'vec')} as p from v, m) select vec_id, {O.r6(O.norm('vec') + ' * ' + O.num(math.sqrt(math.pi / 2) / D) + ' * list_sum([case when p[i] >= 0 then qp[i] else -qp[i] end for i in range(1, 65)])', 'dot')} from p, q")
def sketch_dots(spark, d):
    """Inner products with the first vector, estimated from signs in words of 32 bits and norms alone."""
    t = X.vectors(spark, d)
    q = _sketch() @ np.array(t.orderBy("vec_id").first()["vec"])
    t = t.select("vec_id", E.norm(vec()).alias("n"), E.pack_signs(P.sketch_signs(vec(), _sketch()), D, 32).alias("w"))
    return t.select("vec_id", r6(E.sketch_dot(F.col("w"), E.literal(q), F.col("n"), D, 32), "dot"))


@query(f"with {O.V} select count(*) * 8 as packed, count(*) * 64 as unpacked, 8.0::double as ratio from v")
def sign_storage(spark, d):
    return X.vectors(spark, d).agg((F.count("*") * E.packed_bytes(D)).alias("packed"), (F.count("*") * E.unpacked_bytes(D)).alias("unpacked"), F.lit(E.packing_ratio(D)).alias("ratio"))


def _prod_sql() -> str:
    m = R.make("wht", D).matrix
    c = math.sqrt(math.pi / 2) / D
    return f"""with {O.V}, m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt, {O.mat(_sketch())} as sk), u as (select vec_id, vec, mt, sk, {O.matvec('m', 'vec')} as y from v, m),
    q as (select vec_id, vec, sk, mt, {_deq_sql(2, 'y')} as z from u), w as (select vec_id, vec, sk, {O.matvec('mt', 'z')} as km from q), e as (select *, [vec[i] - km[i] for i in range(1, 65)] as e from w),
    k as (select vec_id, km, {O.norm('e')} as rn, {O.matvec('sk', 'e')} as p from e), a as (select vec_id as q_id, vec as q, {O.matvec('sk', 'vec')} as qp from v, m where vec_id % 50 = 0)
    select q_id, vec_id, round({O.dot('q', 'km')} + rn * {O.num(c)} * list_sum([case when p[i] >= 0 then qp[i] else -qp[i] end for i in range(1, 65)]), 5) + 0.0 as score from a, k"""


@query(_prod_sql)
def estimate_products(spark, d):
    """Every fiftieth vector against all, from records: tiles of queries and keys meet."""
    c = K.PackedKeys(D, 3, use_nsn=False, unit=False, norm_types="<f8", sketch_seed=43)
    t = X.vectors(spark, d).select(F.lit(0).alias("g"), F.col("vec_id").alias("k_id"), "vec")
    q = t.where("k_id % 50 = 0").select("g", F.col("k_id").alias("q_id"), vec().alias("q"))
    return c.scores(q, c.compress(t), ("g",), places=5).select("q_id", F.col("k_id").alias("vec_id"), "score")


# Scores and top-k


def key_queries(spark: SparkSession, d: str, every: int = 50) -> tuple[DataFrame, DataFrame]:
    k = X.vectors(spark, d).select(F.lit(0).alias("b"), F.col("label").alias("h"), F.col("vec_id").alias("k_id"), "vec")
    return k, k.where(F.col("k_id") % every == 0).select("b", "h", F.col("k_id").alias("q_id"), vec().alias("q"))


_QK = f"{O.KV}, s as (select q.h, q.k_id as q_id, k.k_id, {O.dot('q.vec', 'k.vec')} as score from k q join k on q.b = k.b and q.h = k.h where q.k_id % 50 = 0)"


@query(f"with {_QK} select h, q_id, k_id, {O.r6('score', 'score')} from s")
def attention_scores(spark, d):
    k, q = key_queries(spark, d)
    return S.all_scores(q, k.select("b", "h", "k_id", vec().alias("k"))).select("h", "q_id", "k_id", r6(F.col("score"), "score"))


@query(f"with {_QK}, r as (select *, row_number() over (partition by q_id order by round(score, 9) desc, k_id) as rank from s) select q_id, k_id, rank::int as rank from r where rank <= 5")
def topk_exact(spark, d):
    k, q = key_queries(spark, d)
    s = S.all_scores(q, k.select("b", "h", "k_id", vec().alias("k"))).withColumn("score", F.round("score", 9))
    return S.ranked(s, ("q_id",), 5).select("q_id", "k_id", "rank")


@query(Z.topk_compressed)
def topk_compressed(spark, d):
    """The flagship: keys in three bits with normalisation, packed sketches of residuals, the top five of each query."""
    k, q = key_queries(spark, d)
    c = P.KeyCompressor(D, 3, "wht")
    return c.best(q, c.compress(k), 5).select("q_id", "k_id", "rank", r6(F.col("score"), "score"))


@query(Z.topk_packed)
def topk_packed(spark, d):
    """The same from stored records by look-up tables, without a rebuilt vector; each tile keeps its queries' best."""
    k, q = key_queries(spark, d)
    c = K.PackedKeys(D, 3, norm_types="<f4")
    return c.scores(q, c.compress(k.select("b", "h", "k_id", "vec")), k=5).select("q_id", "k_id", "rank", r6(F.col("score"), "score"))


@query(Z.rebuilt_keys)
def rebuilt_keys(spark, d):
    """Keys materialised late, from their records."""
    c = K.PackedKeys(D, 3, norm_types="<f4")
    t = c.compress(X.keys(spark, d).select("k_id", "vec"))
    return flat(t, c.rebuild(F.col("record")), "k_id")


@query(Z.estimate_quality)
def estimate_quality(spark, d):
    k, q = key_queries(spark, d)
    one = {"4": T.setting(D, 4)}
    t = T.trials(k, q.withColumn("target", F.lit(None).cast("long")), one, ("b", "h"))
    t = T.summary(t, one, ("b", "h"), ((),))
    # One row, also of an empty table.
    return t.agg(*[r6(F.max(c), c) for c in ("bias", "rmse", "corr")], F.max("top1").alias("top1_match"), F.max("top5").alias("recall"))


@query(f"with {O.V}, n as (select count(*) // 3 as at from v), s as (select v.vec_id, {O.dot('v.vec', 'q.vec')} as s, v.vec_id = n.at as hit from v, n, v q where q.vec_id = n.at) select 0 as q_id, (select count(*) from s a, s b where b.hit and (a.s > b.s or a.s = b.s and a.vec_id < b.vec_id)) + 1 as rank")
def needle_exact(spark, d):
    t = X.vectors(spark, d)
    at = t.count() // 3
    s = X.needle(t, at)
    scores = t.select(F.lit(0).alias("q_id"), F.col("vec_id").alias("k_id"), E.dot(E.literal(s), vec()).alias("score"))
    return S.needle_rank(scores, F.col("k_id") == at)


@query(Z.needle_compressed)
def needle_compressed(spark, d):
    k = X.keys(spark, d)
    at = k.count() // 3
    return evaluation.needle_retrieval(k, X.needle(k, at, "k_id"), at)


@query(f"with {O.V}, q as (select vec from v order by vec_id limit 1), c as (select vec_id // 100 as chunk_id, vec_id % 100 as pos, vec from v) select chunk_id, pos, {O.r6(O.dot('q.vec', 'c.vec'), 'score')} from c, q")
def chunked_scores(spark, d):
    t = X.vectors(spark, d)
    first = list(t.orderBy("vec_id").first()["vec"])
    return S.chunk_scores(first, t.select(F.floor(F.col("vec_id") / 100).alias("chunk_id"), (F.col("vec_id") % 100).alias("pos"), vec().alias("k"))).select("chunk_id", "pos", r6(F.col("score"), "score"))


# Aggregates and analytics

_F = "f as (select i, vec[i] as x, vec[i + 1] as nx from v, unnest(range(1, 65)) as t(i))"


@query(f"with {O.V}, {_F} select (i - 1)::int as ch, {O.r6('avg(x)', 'mean')}, {O.r6('min(x)', 'min')}, {O.r6('max(x)', 'max')}, {O.r6('avg(x * x)', 'energy')} from f group by i")
def channel_statistics(spark, d):
    return Y.channel_stats(X.vectors(spark, d)).select("ch", *[r6(F.col(c), c) for c in ("mean", "min", "max", "energy")])


@query(f"""with {O.V}, {_F}, m as (select i, avg(x) as m from f group by i), s as (select i, count(*) as n, sum(power(x - m, 2)) as c2, sum(power(x - m, 3)) as c3, sum(power(x - m, 4)) as c4, abs(corr(x, nx)) as c from f join m using (i) group by i)
select (i - 1)::int as ch, {O.r6('c2 / (n - 1)', 'variance')}, {O.r6('c3 / n / power(sqrt(c2 / (n - 1)), 3)', 'skewness')}, {O.r6('c4 / n / power(sqrt(c2 / (n - 1)), 4) - 3', 'kurtosis')}, {O.r6(f'0.5e0 * ln({O.num(2 * math.pi * math.e)} * c2 / (n - 1))', 'entropy')}, {O.r6('c', 'neighbour_corr')} from s""")
def distribution(spark, d):
    return Y.distribution(X.vectors(spark, d)).select("ch", *[r6(F.col(c), c) for c in ("variance", "skewness", "kurtosis", "entropy", "neighbour_corr")])


@query(Z.rotation_score)
def rotation_score(spark, d):
    t = R.rotate(X.with_outliers(X.vectors(spark, d), OUTLIERS), R.wht(D))
    q = Y.quality_score(t)
    return q.select(*[r6(F.col(c), c) for c in ("variance_uniformity", "mean_cross_correlation", "mean_excess_kurtosis")], *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("isometry_error", 5), ("combined_score", 4))])


@query(f"with {O.V} select (i - 1)::int as ch, {O.r6('sum(vec[i] * vec[i])', 'energy')} from v, unnest(range(1, 65)) as t(i) group by i")
def spectrum_energy(spark, d):
    """Parseval: the powers of all frequencies of a channel make its energy."""
    t = X.vectors(spark, d)
    n = t.count()
    twice = F.when((F.col("freq") == 0) | ((F.lit(n) % 2 == 0) & (F.col("freq") == n // 2)), 1.0).otherwise(2.0)
    return Y.coordinate_spectrum(t).groupBy("ch").agg(r6(F.sum(F.col("power") * twice), "energy"))


@query(f"""with {O.V}, n as (select count(*) as n from v), t as (select row_number() over (order by vec_id) - 1 as t, vec from v), f as (select unnest([0, 1, 2, 7, 50]) as freq), a as (select freq, i, vec[i] as x, {O.num(2 * math.pi)} * ((freq * t) % n) / n as w, n from t, f, n, unnest(range(1, 65)) as c(i))
select (i - 1)::int as ch, freq::int as freq, round((power(sum(x * cos(w)), 2) + power(sum(x * sin(w)), 2)) / max(n), 6) + 0.0 as power from a group by i, freq""")
def spectrum_powers(spark, d):
    """Powers of some frequencies of every channel, by the transform in steps; SQL has them by definition."""
    return Y.coordinate_spectrum(X.vectors(spark, d)).where(F.col("freq").isin(0, 1, 2, 7, 50)).select("ch", "freq", r6(F.col("power"), "power"))


_ATT = f"""{_QK}, e as (select h, q_id, k_id, exp(score - max(score) over (partition by h, q_id)) as e from s), p as (select h, q_id, greatest(e / sum(e) over (partition by h, q_id), 1e-10) as p from e),
y as (select h, q_id, sum(-p * ln(p)) as hh, max(p) as peak, count(*) as n from p group by h, q_id), a as (select h, avg(hh) / ln(max(n)) as entropy, avg(peak) as peak from y group by h)"""


def heads(spark: SparkSession, d: str) -> DataFrame:
    k, q = key_queries(spark, d)
    s = S.all_scores(q, k.select("b", "h", "k_id", vec().alias("k")))
    p = Y.softmax(s, ("h", "q_id"))
    return Y.head_sensitivity(p.select(F.lit(0).alias("layer"), F.col("h").alias("head"), F.col("q_id").alias("q"), F.col("k_id").alias("k"), "p"))


@query(f"with {_ATT} select 0 as layer, h as head, {O.r6('entropy', 'entropy')}, {O.r6('peak', 'peak')}, {O.r6('(1 - entropy) * peak', 'sensitivity')} from a")
def attention_entropy(spark, d):
    return heads(spark, d).select("layer", "head", *[r6(F.col(c), c) for c in ("entropy", "peak", "sensitivity")])


@query(f"""with {_ATT}, r as (select h, row_number() over (order by (1 - entropy) * peak desc, h) as rn, count(*) over () as n from a), b as (select h, (1 + least(greatest(floor(n * 2.5e0) - n - (rn - 1) * 3, 0), 3))::int as bits from r)
select h as head, bits, case when bits >= 4 then 'haar' else 'wht' end as rotation, case when bits >= 4 then 'scalar' when bits = 3 then 'e8' when bits = 2 then 'z8_256' else 'z8_32' end as quantizer from b""")
def greedy_allocation(spark, d):
    return B.greedy_bits(heads(spark, d), 2.5).select("head", "bits", "rotation", "quantizer")


@query(f"with {O.V}, s as (select label, var_samp(x) as v from (select label, unnest(vec) as x from v) group by label) select label, {O.r6('v', 'variance')}, {O.r6(f'v * {O.num(B.DISTORTION)} * power(4e0, -3e0)', 'distortion')}, round(3e0 * {O.num(math.log(2))} / (v * {O.num(B.DISTORTION)} * power(4e0, -3e0)), 3) + 0.0 as force from s")
def variance_and_force(spark, d):
    t = X.vectors(spark, d).select("label", F.explode("vec").alias("x")).groupBy("label").agg(F.var_samp("x").alias("v"))
    return t.select("label", r6(F.col("v"), "variance"), r6(B.distortion(3.0, F.col("v")), "distortion"), (F.round(B.force(3.0, F.col("v")), 3) + F.lit(0.0)).alias("force"))


@query(f"""with {O.V}, {_F}, e as (select i, ln(greatest(avg(x * x), 1e-30)) as l from f group by i), m as (select avg(l) as m from e) select (i - 1)::int as ch, {O.r6(f'3e0 + {O.num(B.SLOPE)} * (l - m)', 'bits')} from e, m""")
def continuous_allocation(spark, d):
    t = Y.channel_stats(X.vectors(spark, d)).select("ch", F.log(F.greatest("energy", F.lit(1e-30))).alias("l"))
    return t.crossJoin(t.agg(F.avg("l").alias("m"))).select("ch", r6(3 + F.lit(B.SLOPE) * (F.col("l") - F.col("m")), "bits"))


@query(lambda: Z.bit_allocations(B.SLOPE))
def bit_allocations(spark, d):
    t = X.vectors(spark, d)
    rows = [("spectral", i, b) for i, b in enumerate(B.spectral(t, 3.0))] + [("tower", i, b) for i, b in enumerate(B.tower_bits(D, 3 * D, variances=B.level_variances(t, D)))]
    rows += [("layer", int(k), b) for k, b in B.per_layer(t.withColumn("layer", F.col("label"))).items()]
    return spark.createDataFrame(rows, "kind string, region int, bits int")


@query(lambda: Z.spectral_bits(B.SLOPE))
def spectral_bits(spark, d):
    bits = B.spectral(X.vectors(spark, d), 3.0)
    return spark.createDataFrame(list(enumerate(bits)), "region int, bits int")


@query(lambda: Z.layer_bits(B.SLOPE))
def layer_bits(spark, d):
    bits = B.per_layer(X.vectors(spark, d).withColumn("layer", F.col("label")))
    return spark.createDataFrame([(int(k), b) for k, b in bits.items()], "layer int, bits int")


#: Blocks of two of every vector as rows: their Gram matrices have eigenvalues in closed form, which SQL can state.
_TWO = f"""{O.KV}, t as (select h, k_id, (j - 1)::int as block, vec[2 * j - 1] as x, vec[2 * j] as y from k, unnest(range(1, 33)) as t(j)),
g as (select h, block, count(*) as n, sum(x * x) as a, sum(x * y) as b, sum(y * y) as c from t group by h, block), r as (select *, sqrt(power((a - c) / 2, 2) + b * b) as r from g),
e as (select *, (a + c) / 2 + r as v1, greatest((a + c) / 2 - r, 0e0) as v2, ((a - c) / 2 + r) / (2 * r) as pxx, b / (2 * r) as pxy, (r - (a - c) / 2) / (2 * r) as pyy from r)"""


def twos(spark: SparkSession, d: str) -> DataFrame:
    return Y.in_blocks(X.keys(spark, d), 2, {"vec": "vec"}, ("h", "k_id"))


@query(f"with {_TWO} select h, block, 1 as k, {O.r6('v1 / (a + c)', 'share')} from e union all select h, block, 2, 1e0 from e")
def explained_shares(spark, d):
    return U.explained(U.eigenpairs(U.grams(twos(spark, d), ("h", "block")), ("h", "block")), ("h", "block")).select("h", "block", "k", r6(F.col("share"), "share"))


@query(f"""with {O.KV}, g as (select h, i, j, sum(vec[i] * vec[j]) as x from k, unnest(range(1, 65)) as a(i), unnest(range(1, 65)) as b(j) group by h, i, j), n as (select h, count(*) as n from k group by h)
select g.h, max(n) as n, 64::bigint as pairs, {O.r6('sum(case when i = j then x else 0e0 end)', 'total')}, {O.r6('sum(x * x)', 'square')}, true as certified, true as ordered, true as orthonormal from g join n on n.h = g.h group by g.h""")
def eigen_certificates(spark, d):
    """Each head's 64 pairs: that every residual is small, values fall, vectors are orthonormal, and that values sum to the trace and their squares to the Gram matrix's."""
    p = U.eigenpairs(U.grams(X.keys(spark, d), ("h",)), ("h",)).withColumn("next", F.lead("value").over(W.partitionBy("h").orderBy("k")))
    small = F.lit(1e-9) * F.col("total")
    flat_ = p.select("h", "k", F.posexplode("vector").alias("i", "x"))
    other = flat_.select(F.col("h").alias("h2"), F.col("k").alias("k2"), F.col("i").alias("i2"), F.col("x").alias("x2"))
    dots = flat_.join(other, (F.col("h") == F.col("h2")) & (F.col("i") == F.col("i2"))).groupBy("h", "k", "k2").agg(F.sum(F.col("x") * F.col("x2")).alias("dot"))
    right = dots.groupBy(F.col("h").alias("h3")).agg((F.max(F.abs(F.col("dot") - (F.col("k") == F.col("k2")).cast("int"))) < 1e-9).alias("orthonormal"))
    t = p.groupBy("h").agg(F.max("n").alias("n"), F.count("*").alias("pairs"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("square"), (F.max(F.col("residual") - small) < 0).alias("certified"), (F.min(F.coalesce(F.col("value") - F.col("next"), F.lit(0.0))) >= 0).alias("ordered"))
    return t.join(right, F.col("h") == F.col("h3")).select("h", "n", "pairs", r6(F.col("total"), "total"), r6(F.col("square"), "square"), "certified", "ordered", "orthonormal")


@query(f"with {_TWO}, q as (select t.* from t, (select min(k_id) as at from k) m where t.k_id = m.at), s as (select t.h, t.k_id, (q.x * (pxx * t.x + pxy * t.y) + q.y * (pxy * t.x + pyy * t.y)) as s from t join e on e.h = t.h and e.block = t.block join q on q.block = t.block) select h, k_id, {O.r6('sum(s)', 'score')} from s group by h, k_id")
def factor_scores(spark, d):
    """The first vector against all rows by the rank-one factors of every block of two: a query meets the factors, then each row's u."""
    t = twos(spark, d)
    rows, factors = U.factorize(t, 1, ("h", "block"))
    at = t.agg(F.min("k_id").alias("at")).first()["at"]
    q = t.where(F.col("k_id") == at).select("block", F.lit(0).alias("q_id"), vec().alias("q")).crossJoin(F.broadcast(t.select("h").distinct()))
    s = U.factor_scores(q, rows, factors, ("h", "block"))
    return s.groupBy("h", "k_id").agg(r6(F.sum("score"), "score"))


@query(f"with {O.KV}, n as (select h, count(*) as n from k group by h) select h, n * 64 * 16 as original, (n * 16 + 16 * 64) * 4 as compressed, {O.r6('n * 1024e0 / ((n * 16 + 1024) * 4)', 'ratio')} from n")
def factor_ratios(spark, d):
    rows, factors = U.factorize(X.keys(spark, d), 16, ("h",))
    return U.ratio(rows, factors, 4, ("h",)).select("h", "original", "compressed", r6(F.col("ratio"), "ratio"))


@query(f"""with {O.KV}, n as (select h, count(*) as n, sum({O.dot('vec', 'vec')}) as total from k group by h)
select n.h, {O.r6('total / (n * 64)', 'mse')} from n""")
def factor_energy(spark, d):
    """What rank 64 restores and what rank 16 leaves out make up the whole: the mean square of a head from both sides of its spectrum."""
    t = X.keys(spark, d)
    rows, factors = U.factorize(t, 16, ("h",))
    kept = rows.select("h", F.posexplode("u").alias("i", "u")).groupBy("h", "i").agg(F.sum(F.col("u") * F.col("u")).alias("uu")).join(factors.select("h", (F.col("k") - 1).alias("i"), E.dot(F.col("sv"), F.col("sv")).alias("ss")), ["h", "i"])
    kept = kept.groupBy("h").agg(F.sum(F.col("uu") * F.col("ss")).alias("kept"))
    p = U.eigenpairs(U.grams(t, ("h",)), ("h",)).groupBy("h").agg(F.sum(F.when(F.col("k") > 16, F.col("value")).otherwise(0.0)).alias("left"), F.max("n").alias("n"))
    return kept.join(p, "h").select("h", r6((F.col("kept") + F.col("left")) / (F.col("n") * D), "mse"))


@query(f"""with {_TWO}, z as (select h, block, n, v2, a + c as total, rank, bits, (n + 2) * rank * bits as size, (n + 2) * (2 + block % 4) as budget, case when rank = 1 then v2 else 0e0 end / (n * 2) as error from e, (values (1), (2)) x(rank), (values (1), (2), (3), (4)) y(bits)),
w as (select *, row_number() over (partition by h, block order by case when size <= budget then 0 else 1 end, case when size <= budget then round(error, 12) end, rank, bits) as o from z)
select h, block, rank, bits, {O.r6('error', 'error')}, {O.r6('n * 32e0 / size', 'ratio')} from w where o = 1""")
def ranks_and_bits(spark, d):
    """For each head and block the rank and bits of least error within a budget of its own."""
    p = U.eigenpairs(U.grams(twos(spark, d), ("h", "block")), ("h", "block"))
    t = U.rank_and_bits(p, (F.col("n") + 2) * (2 + F.col("block") % 4), (1, 2), group=("h", "block"))
    return t.select("h", "block", "rank", "bits", r6(F.col("error"), "error"), r6(F.col("ratio"), "ratio"))


_BLOCKS8 = f"{O.V}, p as (select vec_id, j, vec[8 * j - 7 : 8 * j] as x from v, unnest(range(1, 9)) as t(j)), c as (select (row_number() over (order by vec_id) - 1)::int as code, x as c from p where j = 1 order by vec_id limit 16)"


@query(f"""with {_BLOCKS8}, s as (select vec_id, j, x, code, round(list_sum([c[i] * c[i] for i in range(1, 9)]) - 2 * list_sum([x[i] * c[i] for i in range(1, 9)]), 12) as s, list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, 9)]) as e from p, c),
a as (select * from s qualify row_number() over (partition by vec_id, j order by s, code) = 1), m as (select code, i, count(*) as n, avg(x[i]) as x, sum(e) as e from a, unnest(range(1, 9)) as t(i) group by code, i)
select code, (i - 1)::int as i, n, {O.r6('x', 'x')}, {O.r6('e', 'e')} from m""")
def kmeans_round(spark, d):
    """One Lloyd round over all blocks of eight, from the first blocks of the first sixteen vectors."""
    t = X.vectors(spark, d)
    first = np.array([r["vec"][:8] for r in t.orderBy("vec_id").limit(16).collect()])
    sums = G.lloyd_sums(t, first)
    return sums.select("code", "n", "e", F.posexplode("s").alias("i", "s")).select("code", "i", "n", r6(F.col("s") / F.col("n"), "x"), r6(F.col("e"), "e"))


@query(f"with {O.V} select 32 as codes, count(*) * 8 as points, true as falls, true as fits, true as beats_universal from v")
def kmeans_training(spark, d):
    """A codebook trained on the table itself: errors fall from round to round, every code is a mean of its points, and it beats one trained on normal points."""
    t = X.vectors(spark, d)
    c, errors = G.train(t, 32, rounds=12)
    n = t.count() * 8
    universal = Q.make("kmeans_32", D, 1).fit(t)
    mse = lambda q: Y.mse(t.withColumn("y", q.round_trip(vec())), "vec", "y").first()["mse"]
    _, sizes, last = G.step(t, c)
    rows = [(len(c), int(sizes.sum()) if n else 0, all(x >= y - 1e-12 for x, y in zip(errors, [*errors[1:], last], strict=True)), bool((sizes > 0).all()), bool(last < mse(universal)))]
    return spark.createDataFrame(rows, "codes int, points long, falls boolean, fits boolean, beats_universal boolean")


@query(f"with {O.V} select count(*) * (64 * 2 / 8e0 + 8 + 4 + 4) + 128 as total, count(*) * 128e0 as original from v")
def storage_bytes(spark, d):
    s = P.storage(X.vectors(spark, d).count(), D, 3)
    return spark.createDataFrame([(float(s["total"]), float(s["original"]))], "total double, original double")


@query(f"""with {O.V}, c as (select count(*) as n from v) select layout, n, bytes::bigint as stored, n * 128 as original, {O.r6('n * 128e0 / bytes', 'ratio')} from c,
lateral (values ('hybrid', n * (64 * 2 // 8 + 8 + 2 + 2 + 4 + 4) + 64 * 4), ('keys 2', n * (64 // 8 + 8 + 8) + 128), ('keys 3', n * (64 * 2 // 8 + 8 + 8) + 128), ('keys 4', n * (64 * 3 // 8 + 8 + 8) + 128), ('values', n * (64 * 3 // 8 + 2))) t(layout, bytes)
union all select 'cache', n, n * (16 + 8 + 2 + 24), n * 256, {O.r6('256e0 / 50', 'ratio')} from c""")
def packed_layouts(spark, d):
    """Bytes of each layout as its records are, constants included, against 16-bit floats: what the accounting says is what is stored."""
    from ..streaming.cache import Cache

    t, out = X.vectors(spark, d).select("vec_id", "vec"), None
    keys = {f"keys {b}": K.PackedKeys(D, b) for b in (2, 3, 4)} | {"hybrid": K.PackedKeys(D, 3, "hybrid", full_nsn=True, norm_types=K.HYBRID), "values": K.PackedKeys(D, 3, seed=142, use_nsn=False, use_qjl=False)}
    sizes = [(name, c.compress(t), (D * (4 if name == "hybrid" else 2)) * c.use_nsn, D * 2) for name, c in keys.items()]
    both = Cache(spark, "", D).compress(t.select("vec_id", vec().alias("k"), vec().alias("v"))).select(F.concat("key", "value").alias("record"))
    for name, packed, constants, half in [*sizes, ("cache", both, 0, D * 4)]:
        one = K.stored_bytes(packed, constants).select(F.lit(name).alias("layout"), "n", "stored", (F.col("n") * half).alias("original"), r6(F.col("n") * float(half) / F.col("stored"), "ratio"))
        out = one if out is None else out.unionByName(one)
    return out


_HIST = f"with {O.V}, b as (select (vec_id % 3 + 2)::int as bits from v)"


@query(f"{_HIST} select bits, count(*) as n from b group by bits")
def bits_histogram(spark, d):
    return Y.bits_histogram(X.vectors(spark, d).select((F.col("vec_id") % 3 + 2).cast("int").alias("bits")))


@query(f"{_HIST} select {O.r6('avg(bits)', 'mean')}, min(bits) as min, max(bits) as max, count(*) as n from b")
def bits_summary(spark, d):
    return Y.bits_summary(X.vectors(spark, d).select((F.col("vec_id") % 3 + 2).cast("int").alias("bits"))).select(r6(F.col("mean"), "mean"), "min", "max", "n")


@query()
def low_rank(spark, d):
    return Y.mse(P.svd_compress(X.keys(spark, d), 16, 4), "vec", "restored", "h").select("h", r6(F.col("mse"), "mse"))


@query()
def explained_variance(spark, d):
    return spark.createDataFrame(list(enumerate(Y.explained_variance(X.vectors(spark, d), 16))), "i int, share double")


@query(Z.head_rotations)
def head_rotations(spark, d):
    return Y.per_head_rotation(X.keys(spark, d)).select("h", "rotation", r6(F.col("score"), "score"))


@query(Z.rotation_counts)
def rotation_counts(spark, d):
    """Heads by the rotation that was chosen for them."""
    return Y.rotation_counts(Y.per_head_rotation(X.keys(spark, d)))


# Hypercomplex and geometric algebra



def _ab(size: int) -> str:
    """CTE a (k_id, h, s, block, a, b, c): blocks of a vector beside those of the next two of its head."""
    block = "partition by h, block order by s"
    return f"{O.KV}, pb as (select k_id, h, s, (j - 1)::int as block, vec[{size} * j - {size - 1} : {size} * j] as a from k, unnest(range(1, {D // size + 1})) as t(j)), a as (select *, lead(a) over ({block}) as b, lead(a, 2) over ({block}) as c from pb)"


def by_block(df: DataFrame, column: Column, size: int, key: str = "k_id") -> DataFrame:
    """(key, i, x): a vector column of blocks element by element, numbered through the whole vector."""
    return df.select(key, "block", F.posexplode(column).alias("i", "y")).select(key, (F.col("block") * size + F.col("i")).alias("i"), r6(F.col("y"), "x"))


def by_block_sql(ctes: str, source: str, expr: str, size: int, key: str = "k_id") -> str:
    return f"with {ctes}, o as (select {key}, block, {expr} as y from {source}) select {key}, (block * {size} + i - 1)::int as i, {O.r6('y[i]', 'x')} from o, unnest(range(1, {size + 1})) as t(i)"


def triplets(spark: SparkSession, d: str, size: int = 8) -> DataFrame:
    t = Y.in_blocks(X.keys(spark, d), size, {"vec": "a"}, ("b", "h", "s", "k_id"))
    return Y.consecutive(t, ("a",), group=("b", "h", "block")).select("h", "s", "k_id", "block", "a", F.col("a1").alias("b"), F.col("a2").alias("c"))


def product_query(kind: str, size: int) -> None:
    def sql() -> str:
        return by_block_sql(_ab(size), "a", A.product_sql("a", "b", size, kind), size).replace("from a)", "from a where c is not null)")

    def run(spark, d):
        return by_block(triplets(spark, d, size), A.product(F.col("a"), F.col("b"), size, kind), size)

    run.__name__ = f"product_{kind}_{size}"
    query(sql)(run)


for _kind, _size in (("doubling", 2), ("doubling", 4), ("doubling", 8), ("doubling", 16), ("clifford", 8)):
    product_query(_kind, _size)


def _assoc_sql(names: tuple[str, str, str], prefix: str) -> str:
    """CTE columns for the associator norm of three lists."""
    a, b, c = names
    return f"{A.product_sql(a, b, 8)} as {prefix}ab, {A.product_sql(b, c, 8)} as {prefix}bc"


@query(lambda: f"""with {_ab(8)}, p as (select *, {_assoc_sql(('a', 'b', 'c'), '')}, {A.product_sql('b', 'a', 8)} as ba from a where c is not null), q as (select *, {A.product_sql('ab', 'c', 8)} as l, {A.product_sql('a', 'bc', 8)} as r from p)
select k_id, block, {O.r6('sqrt(list_sum([(l[i] - r[i]) * (l[i] - r[i]) for i in range(1, 9)])) / (' + O.norm('a') + ' * ' + O.norm('b') + ' * ' + O.norm('c') + ' + 1e-8)', 'assoc')}, {O.r6('sqrt(list_sum([(ab[i] - ba[i]) * (ab[i] - ba[i]) for i in range(1, 9)]))', 'comm')} from q""")
def associators(spark, d):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return triplets(spark, d).select("k_id", "block", r6(A.associator_norm_column(a, b, c, 8), "assoc"), r6(E.norm(A.commutator_column(a, b, 8)), "comm"))


@query(by_block_sql(f"{O.KV}, a as (select k_id, (j - 1)::int as block, vec[8 * j - 7 : 8 * j] as a from k, unnest(range(1, 9)) as t(j)), w as (select k_id, block, a, {O.dot('a', 'a')} + 1e-8 as n from a)", "w", "[case when i = 1 then x else -x end / n for x, i in a]", 8))
def inverses(spark, d):
    t = Y.in_blocks(X.keys(spark, d), 8, {"vec": "a"}, ("k_id",))
    return by_block(t, A.inverse_column(F.col("a")), 8)


@query(f"with {O.V}, p as (select vec_id, (j - 1)::int as block, vec[8 * j - 7 : 8 * j] as a from v, unnest(range(1, 9)) as t(j)) select vec_id, block, {O.r6('a[1]', 'real')}, {O.r6('list_sum(a[2:8])', 'imag')}, {O.r6('a[1]', 'embedded')} from p")
def real_and_imaginary(spark, d):
    t = Y.in_blocks(X.vectors(spark, d), 8, {"vec": "a"}, ("vec_id",))
    return t.select("vec_id", "block", r6(A.real_part(F.col("a")), "real"), r6(E.total(A.imag_part(F.col("a"))), "imag"), r6(E.total(A.from_real(A.real_part(F.col("a")), 8)), "embedded"))


@query(lambda: by_block_sql(f"{O.V}, z as (select vec_id, vec || [0e0, 0e0] as vec from v), r as (select vec_id, (j - 1)::int as block, [{', '.join(O.num(x) for x in _ROTOR)}] as r, [0e0, vec[3 * j - 2], vec[3 * j - 1], vec[3 * j], 0e0, 0e0, 0e0, 0e0] as w from z, unnest(range(1, 23)) as t(j)), p as (select vec_id, block, r, {A.product_sql('r', 'w', 8, 'clifford')} as p, [case when i > 4 then -x else x end for x, i in r] as rr from r)", "p", A.product_sql("p", "rr", 8, "clifford"), 8, "vec_id"))
def rotor_sandwich(spark, d):
    """Three elements after the other as vectors of Cl(3,0), the last filled up with zeros."""
    t = Y.in_blocks(X.vectors(spark, d).select("vec_id", E.head(vec(), 66).alias("vec")), 3, {"vec": "a"}, ("vec_id",))
    w = F.concat(F.array(F.lit(0.0)), F.col("a"), F.array_repeat(F.lit(0.0), 4))
    return by_block(t.select("vec_id", "block", w.alias("w"), E.literal(_ROTOR).alias("r")), A.sandwich_column(F.col("r"), F.col("w")), 8, "vec_id")


_ROTOR = A.rotor(np.random.default_rng(5)).tolist()


@query(Z.zero_divisor_pairs)
def zero_divisor_pairs(spark, d):
    e = np.eye(16)
    rows = [(1, (e[1] + e[10]).tolist(), (e[4] - e[15]).tolist()), (1, (e[1] + e[10]).tolist(), (e[5] + e[14]).tolist()), (2, e[1].tolist(), e[2].tolist())]
    t = spark.createDataFrame(rows, "pair int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    return t.groupBy("pair").agg(F.max((E.norm(A.product(a, b, 16)) < 1e-6) & (E.norm(a) > 1e-6) & (E.norm(b) > 1e-6)).alias("zero"))


@query(lambda: f"""with {O.V}, q as (select vec_id, vec as o, {_deq_sql(2)} as y from v), n as (select *, {O.norm('o')} as na, {O.norm('y')} as nb, {O.dot('o', 'y')} as ab from q)
select vec_id, {O.r6('1 - ab / (na * nb + 1e-15)', 'total')}, {O.r6('power((na - nb) / (na + 1e-15), 2)', 'magnitude')}, {O.r6('1 - greatest(-1e0, least(1e0, ab / ((na + 1e-15) * (nb + 1e-15))))', 'phase')} from n""")
def distortion_parts(spark, d):
    t = X.vectors(spark, d).withColumn("y", Q.Scalar(D, 2).round_trip(vec()))
    return t.select("vec_id", Y.decomposition(vec(), F.col("y")).alias("p")).select("vec_id", *[r6(F.col(f"p.{c}"), c) for c in ("total", "magnitude", "phase")])


@query(Z.triplet_fidelity)
def triplet_fidelity(spark, d):
    t = X.keys(spark, d).withColumn("y", Q.Scalar(D, 3).round_trip(vec()))
    f = Y.fidelity_summary(Y.in_blocks(t, 8, {"vec": "a", "y": "q"}, ("b", "h", "s")), 8, group=("b", "h", "block"))
    return f.select(*[r6(F.col(c), c) for c in ("mean", "min", "max", "std", "mean_pre", "mean_post")], "n")


@query(lambda: f"""with {_ab(8)}, p as (select *, {_assoc_sql(('a', 'b', 'c'), '')} from a), q as (select *, case when c is not null then sqrt(list_sum([(l[i] - r[i]) * (l[i] - r[i]) for i in range(1, 9)])) / ({O.norm('a')} * {O.norm('b')} * {O.norm('c')} + 1e-8) end as x
  from (select *, {A.product_sql('ab', 'c', 8)} as l, {A.product_sql('a', 'bc', 8)} as r from p)), w as (select h, s, block, count(*) over (partition by h, block) as n, row_number() over (partition by h, block order by s) as i, coalesce(sum(x) over (partition by h, block order by s rows between 2 preceding and current row), 0) as t from q)
select h, s::int as s, block, {O.r6('t / least(least(i, n - i + 1), 3)', 'value')} from w""")
def token_associators(spark, d):
    t = Y.in_blocks(X.keys(spark, d), 8, {"vec": "vec"}, ("b", "h", "s"))
    return Y.residual_associators(t, 8, group=("b", "h", "block")).select("h", "s", "block", r6(F.col("value"), "value"))


@query(Z.zero_divisor_quartiles)
def zero_divisor_quartiles(spark, d):
    t = X.vectors(spark, d).withColumn("y", Q.Scalar(D, 2).round_trip(vec())).withColumn("e", E.minus(vec(), F.col("y")))
    t = Y.zero_divisor_affinity(t.select("vec_id", F.col("e").alias("vec")).withColumn("err", E.dot(vec(), vec())))
    return Y.quartile_means(t, "affinity", "err", "vec_id").select("quartile", r6(F.col("mean"), "mean"))


# Set operations, catalogues, evaluations


@query(_prefix_sql().replace(" union all ".join(f"select '{level}' as level, id as code from l{n}" for n, level in enumerate(C.LEVELS)), " union all ".join(f"select '{b}' as level, (select count(*) from (select id from l{n} except all select id from l{n + 1}))::bigint as outside, (select count(*) from (select id from l{n + 1} except all select id from l{n}))::bigint as missing" for n, b in enumerate(C.LEVELS[:-1]))))
def nested_levels(spark, d):
    out = None
    for big, small in zip(C.LEVELS, C.LEVELS[1:], strict=False):
        a, b = (C.prefix_codebook_table(spark, x).select("code") for x in (big, small))
        t = a.exceptAll(b).agg(F.count("*").alias("outside")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("missing"))).select(F.lit(big).alias("level"), "outside", "missing")
        out = t if out is None else out.unionByName(t)
    return out


@query(lambda: "select * from (values " + ", ".join(f"({d}, {d * d}, {catalog.REDUCED_MULTIPLICATIONS.get(d, 0)})" for d in (2, 4, 8, 16, 32, 64)) + ") t(dim, standard, reduced)")
def multiplication_counts(spark, d):
    return catalog.multiplications(spark).select("dim", "standard", F.coalesce("reduced", F.lit(0)).alias("reduced"))


@query("select * from (values (1, 2), (2, 6), (4, 24), (8, 240), (16, 4320)) t(dim, roots)")
def lattice_catalogue(spark, d):
    return catalog.barnes_wall(spark).select("dim", "roots")


@query(Z.method_catalogue)
def method_catalogue(spark, d):
    return catalog.methods(spark, D)


@query(Z.evaluate_rotations)
def evaluate_rotations(spark, d):
    t = evaluation.rotation_benchmark(X.vectors(spark, d), ("haar", "wht", "cd8", "hybrid"), (2, 3))
    return t.select("rotation", "elements", "bits", *[r6(F.col(c), c) for c in ("mse", "invertibility", "isometry")])


@query(Z.evaluate_quantizers)
def evaluate_quantizers(spark, d):
    t = evaluation.quantizer_benchmark(X.vectors(spark, d), ("scalar", "e8", "z8_256"))
    return t.select("quantizer", *[r6(F.col(c), c) for c in ("bits_per_dim", "mse", "bias", "rmse", "corr")])


@query(Z.evaluate_attention)
def evaluate_attention(spark, d):
    k, q = key_queries(spark, d)
    return evaluation.attention_fidelity(k, q, (3,)).select("b", "h", *[r6(F.col(c), c) for c in ("cosine", "top1", "top5")], "bits")


@query(Z.evaluate_ablation)
def evaluate_ablation(spark, d):
    k, q = key_queries(spark, d)
    t = evaluation.ablation(X.with_outliers(k, OUTLIERS), q)
    return t.select("step", "b", "h", *[r6(F.col(c), c) for c in ("cosine", "top1", "top5")], "bytes")


@query(Z.evaluate_variants)
def evaluate_variants(spark, d):
    return evaluation.compare(X.vectors(spark, d), (3,)).select("variant", "bits", r6(F.col("mse"), "mse"))


@query(Z.trial_table)
def trial_table(spark, d):
    """Settings by layer and head: bias, correlation and retrieval of needles, two of each head, in one pass over the keys."""
    t = X.vectors(spark, d).select((F.col("vec_id") % 3).cast("int").alias("layer"), F.col("label").alias("head"), F.col("vec_id").alias("k_id"), "vec")
    first = F.row_number().over(W.partitionBy("layer", "head").orderBy("k_id"))
    q = t.withColumn("i", first).where("i <= 2").select("layer", "head", F.col("k_id").alias("q_id"), vec().alias("q"), F.col("k_id").alias("target"))
    settings = {name: T.setting(D, bits, rotation, nsn) for name, rotation, bits, nsn in Z.TRIALS}
    out = T.summary(T.trials(t, q, settings), settings)
    alone = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("layer", "head")]  # -1: all of them
    return out.select("setting", *alone, "queries", "pairs", *[r6(F.col(c), c) for c in ("bias", "rmse", "corr", "cosine", "top1", "top5", "hits", "ratio")])


@query(Z.evaluate_cache)
def evaluate_cache(spark, d):
    k = X.keys(spark, d)
    return evaluation.compress_cache({0: (k, k), 1: (k, k)}).select("layer", "kind", "n", r6(F.col("mse"), "mse"), "bytes")


@query(lambda: f"with {O.V}, q as (select vec as q from v order by vec_id limit 1), n as (select vec_id, vec, {O.norm('vec')} as n from v), z as (select vec_id, n, {_deq_sql(3, '[x / n for x in vec]')} as z from n) select vec_id, {O.r6('n * ' + O.dot('q.q', 'z.z'), 'dot')} from z, q")
def dequantized_dots(spark, d):
    """Scores straight from indices and norms: norm times the sum of query elements and centroids."""
    t = X.vectors(spark, d)
    first = E.literal(t.orderBy("vec_id").first()["vec"])
    q = Q.Scalar(D, 3)
    t = t.select("vec_id", E.norm(vec()).alias("n"), q.quantize(E.divide(vec(), E.norm(vec()))).alias("idx"))
    return t.select("vec_id", r6(F.col("n") * E.dot(first, q.dequantize(F.col("idx"))), "dot"))


@query(Z.hybrid_keys)
def hybrid_keys(spark, d):
    c = P.KeyCompressor(D, 3, "hybrid", full_nsn=True)
    t = c.compress(X.keys(spark, d))
    return Y.mse(t, "vec", "k_mse", "h").select("h", r6(F.col("mse"), "mse"))


@query(lambda: f"""with {O.V}, n as (select ceil(count(*) / 64e0)::bigint as cells from v), p as (select (vec_id * 2654435761) % 4294967296 as deal, j, vec[16 * j - 15 : 16 * j] as x from v, unnest(range(1, 5)) as t(j)),
w as (select j, deal % cells as cell, row_number() over (partition by j, deal % cells order by deal) as i, x as a, lead(x, 1) over (partition by j, deal % cells order by deal) as b, lead(x, 2) over (partition by j, deal % cells order by deal) as c from p, n),
k as (select *, {A.product_sql('a', 'b', 16)} as ab, {A.product_sql('b', 'c', 16)} as bc from w where i % 3 = 1 and c is not null), q as (select *, {A.product_sql('ab', 'c', 16)} as l, {A.product_sql('a', 'bc', 16)} as r from k),
x as (select sqrt(list_sum([(l[i] - r[i]) * (l[i] - r[i]) for i in range(1, 17)])) / ({O.norm('a')} * {O.norm('b')} * {O.norm('c')} + 1e-8) as x from q), s as (select avg({O.norm('x')}) as s16 from p), s8 as (select avg({O.norm('x')}) as s8 from (select vec[8 * j - 7 : 8 * j] as x from v, unnest(range(1, 9)) as t(j)))
select 16 as block, count(*) as triplets, {O.r6('1 + avg(x) / max(s16)', 'factor')}, {O.r6('1.96e0 * stddev_samp(x) / sqrt(count(*)) / max(s16)', 'error')}, {O.r6('max(s16)', 'size')} from x, s union all select 8, 0, 1e0, 0e0, {O.r6('s8', 'size')} from s8""")
def structure_factors(spark, d):
    """All blocks of all rows, in triplets dealt by a hash of the id."""
    t = X.vectors(spark, d)
    deal = (F.col("vec_id") * 2654435761) % 4294967296
    out = B.structure_factors(t, 16, deal=deal, cell=64).unionByName(B.structure_factors(t, 8))
    return out.select("block", "triplets", r6(F.col("factor"), "factor"), r6(F.col("error"), "error"), r6(F.col("size"), "size"))


@query(lambda: f"""with {O.V}, l as (select * from (values {', '.join(f'({k}, {lo}, {hi})' for k, (lo, hi) in enumerate(P.tower(D)))}) t(level, lo, hi)),
r as (select label, level, any_value(hi - lo) as n, {O.num(B.OPTIMAL_SLOPE)} * ln(greatest(avg(vec[i] * vec[i]), 1e-30)) as g from v, l, unnest(range(1, 65)) as t(i) where i > lo and i <= hi group by label, level),
t as (select 3.1e0 * sum(n) as total from r), p as (select 2 - g as x from r union select 4 - g from r), f as (select x, sum(n * greatest(2e0, least(4e0, x + g))) as used from p, r group by x), z as (select max(x) as x from f, t where used <= total + 1e-9),
c as (select r.*, z.x, total, case when 2 - g > z.x then -1 when 4 - g <= z.x then 1 else 0 end as side from r, z, t), y as (select (max(total) - 2 * coalesce(sum(n) filter (side < 0), 0) - 4 * coalesce(sum(n) filter (side > 0), 0) - sum(n * g) filter (side = 0)) / sum(n) filter (side = 0) as level from c),
q as (select label, r.level, n, greatest(2e0, least(4e0, y.level + g)) as goal from r, y), b as (select *, floor(goal + 1e-9)::int as b, round(greatest(goal - floor(goal + 1e-9), 0), 9) as f from q),
s as (select *, sum(case when f > 0 then n else 0 end) over (order by f desc, label * 8 + level) as ahead, floor((select total from t) + 1e-6) - sum(n * b) over () as open from b)
select label, level::int as level, {O.r6('goal', 'goal')}, (b + case when f > 0 and ahead <= open then 1 else 0 end)::int as bits from s""")
def water_filling(spark, d):
    """Bits of every tower level of every label by its mean square, at one level of water."""
    level = F.lit(0)
    for k, (lo, _) in enumerate(P.tower(D)):
        level = F.when(F.col("i") >= lo, k).otherwise(level)
    t = X.vectors(spark, d).select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", level.alias("level")).agg(F.avg(F.col("x") * F.col("x")).alias("variance"))
    size = F.element_at(F.array(*[F.lit(hi - lo) for lo, hi in P.tower(D)]), F.col("level") + 1)
    t = B.fill(t.withColumns({"n": size, "region": F.col("label") * 8 + F.col("level")}), 3.1, 2, 4)
    return t.select("label", "level", r6(F.col("goal"), "goal"), "bits")


@query(Z.compare_with_uniform)
def levels_against_uniform(spark, d):
    return B.compare_with_uniform(X.vectors(spark, d)).select("method", r6(F.col("bits"), "bits"), r6(F.col("mse"), "mse"), r6(F.col("gain"), "gain"))


@query(Z.streamed_cache)
def streamed_cache(spark, d):
    """Vectors streamed into a compressed cache, then scored against the first of them."""
    from ..streaming.cache import Cache

    t = spark.read.parquet(f"{d}/embeddings.parquet")
    path = new_path(spark, "cache")
    source = spark.readStream.schema(t.schema).parquet(f"{d}/embeddings.parquet*")
    x = E.doubles(F.col("embedding"))
    c = Cache(spark, path, D, norm_type="<f4")
    c.stream(source.select(F.col("vec_id").alias("pos"), x.alias("k"), x.alias("v")), f"{path}/check").awaitTermination()
    first = X.vectors(spark, d).orderBy("vec_id").first()["vec"]
    return c.scores(list(first)).select("pos", (F.round("score", 5) + F.lit(0.0)).alias("score"))


def in_two_batches(spark: SparkSession, d: str, start: Callable[[DataFrame, str, int], None]) -> str:
    """Streams the vectors of even and then of odd ids: start(source, path, run) runs a query to the end of what has arrived, the second time from the first one's checkpoint."""
    t, path = X.vectors(spark, d), new_path(spark, "stream")
    for part in (0, 1):
        t.where(F.col("vec_id") % 2 == part).write.mode("append").parquet(f"{path}/in")
        start(spark.readStream.schema(t.schema).parquet(f"{path}/in"), path, part)
    return path


_TURNS = f"{O.V}, e as (select label, min(x) as lo, max(x) as hi, count(distinct vec_id) as n from (select label, vec_id, unnest(vec) as x from v where vec_id % 2 = 0) group by label)"


@query(f"""with {_TURNS}, s as (select vec_id, vec, lo, hi, greatest((hi - lo) / 15, 1e-8) as s, case when vec_id % 2 = 0 then 0 else n end as before from v join e using (label))
select vec_id, before::bigint as before, {O.r6('lo', 'lo')}, {O.r6('hi', 'hi')}, list_sum([greatest(0, least(15, round_even((vec[i] - lo) / s, 0))) * i for i in range(1, 65)])::bigint as chk from s""")
def streamed_ranges(spark, d):
    """Codes by the range of each label's first batch, which a restarted query takes from its state."""
    from ..streaming.stateful import first_batch_ranges

    def start(source: DataFrame, path: str, _: int) -> None:
        q = first_batch_ranges(source, bits=4).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    t = spark.read.parquet(f"{in_two_batches(spark, d, start)}/rows")
    chk = F.aggregate(F.transform("codes", lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select("vec_id", "before", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), chk.alias("chk"))


@query(f"with {O.V} select label, count(*) as rows, count(*) * 64 as elements from v group by label")
def streamed_totals(spark, d):
    """Totals by label in the state of an aggregate, over two runs of one query."""
    from ..streaming.cache import running_totals

    def start(source: DataFrame, path: str, run: int) -> None:
        q = running_totals(source, "label").writeStream.outputMode("complete").foreachBatch(lambda t, n: t.write.mode("overwrite").parquet(f"{path}/totals"))
        q.option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()

    return spark.read.parquet(f"{in_two_batches(spark, d, start)}/totals")


@query(lambda: f"""with {O.V}, m as (select {O.mat(R.make('wht', D, 142).matrix)} as m, {O.mat(R.make('wht', D, 142).matrix.T)} as mt), n as (select count(*) as n from v), u as (select vec_id, {O.matvec('m', 'vec')} as y, mt from v, m), z as (select vec_id, mt, {_deq_sql(3, 'y')} as z from u), w as (select vec_id, {O.matvec('mt', 'z')} as r from z)
select vec_id as pos, vec_id % 2 as chunk_id, (vec_id >= 4 and not (n > 128 and vec_id >= n - 128))::int as quantized, {O.r6('list_sum([r[i] * i for i in range(1, 65)])', 'chk')}, n * 64 * 2 + n * 64 + n * 16 as key_bits, n * 64 * 3 as value_bits from w, n""")
def cache_contents(spark, d):
    """A cache fed by two runs of one stream: restored values, what a window reads quantized, and bits as stored."""
    from ..streaming.cache import Cache

    held: list[Cache] = []

    def start(source: DataFrame, path: str, _: int) -> None:
        held[:] = [Cache(spark, f"{path}/cache", D)]
        held[0].stream(source.select(F.col("vec_id").alias("pos"), vec().alias("k"), vec().alias("v")), f"{path}/check").awaitTermination()

    in_two_batches(spark, d, start)
    t = held[0].get_values().join(held[0].windowed().select("chunk_id", "pos", F.col("quantized").cast("int").alias("quantized")), ["chunk_id", "pos"])
    return t.crossJoin(F.broadcast(held[0].memory().select("key_bits", "value_bits"))).select("pos", F.col("chunk_id").cast("long").alias("chunk_id"), "quantized", r6(E.dot(F.col("v"), E.literal(range(1, 65))), "chk"), "key_bits", "value_bits")


@query(f"""with {O.V}, a as (select vec_id, vec_id % 2 as part, vec, {O.norm('vec')} as n1 from v), u as (select vec_id, part, n1, [x / (n1 + 1e-8) for x in vec] as u from a), c as (select part, list(m order by i) as m from (select part, i, avg(u[i]) as m from u, unnest(range(1, 65)) as t(i) group by part, i) group by part),
w as (select vec_id, u.part, [u[i] - m[i] for i in range(1, 65)] as c from u join c on c.part = u.part) select vec_id, part::int as batch_id, {O.r6(O.norm('c'), 'norm2')} from w""")
def streamed_normalization(spark, d):
    """Each batch around its own channel mean."""
    from ..streaming.cache import normalize_batches

    def start(source: DataFrame, path: str, _: int) -> None:
        normalize_batches(source, path, f"{path}/check", 3).awaitTermination()

    t = spark.read.parquet(f"{in_two_batches(spark, d, start)}/rows")
    return t.select("vec_id", F.col("batch_id").cast("int").alias("batch_id"), r6(F.col("norm2"), "norm2"))


@query(f"with {O.V}, q as (select vec_id, [greatest(0e0, least(255e0, round_even(x / 0.00390625e0, 0) + 120)) for x in vec] as q from v) select vec_id, list_sum([q[i] * i for i in range(1, 65)])::bigint as chk, {O.r6('list_sum([(q[i] - 120) * 0.00390625e0 * i for i in range(1, 65)])', 'restored')} from q")
def affine_codes(spark, d):
    q = Q.Affine(1 / 256, 120)
    t = X.vectors(spark, d).select("vec_id", q.quantize(vec()).alias("q"))
    weigh = lambda v: E.dot(E.doubles(v), E.literal(range(1, 65)))
    return t.select("vec_id", F.round(weigh(F.col("q"))).cast("long").alias("chk"), r6(weigh(q.dequantize(F.col("q"))), "restored"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in _SQL.items()}
