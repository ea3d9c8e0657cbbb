"""Composite evaluations: rotations, quantizers, attention fidelity, ablation, whole caches, needles."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import analytics as Y
from ..operators import compressors as P
from ..operators import normalize as N
from ..operators import quantizers as Q
from ..operators import rotations as R
from ..operators import scoring as S
from . import trials as T

ROTATIONS = ("haar", "wht", "cd4", "cd8", "cd16", "hybrid", "e8block", "clifford", "kac")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def rotation_benchmark(df: DataFrame, names: tuple[str, ...] = ROTATIONS, bits: tuple[int, ...] = (1, 2, 3, 4), column: str = "vec", seed: int = 42) -> DataFrame:
    """(rotation, elements, bits, mse, invertibility, isometry): one pass over the table a rotation."""
    d, parts = E.require_dim(df, column), []
    for name in names:
        rot = R.make(name, d, seed)
        t = df.select(F.col(column).alias("x")).withColumn("y", rot.column(F.col("x")))
        back = rot.column(F.col("y"), True)
        t = t.withColumn("back", back)
        for b in bits:
            t = t.withColumn(f"q{b}", Q.Scalar(d, b).round_trip(F.col("y")))
        err = lambda c, ref="y": F.sum(E.dot(E.minus(F.col(ref), F.col(c)), E.minus(F.col(ref), F.col(c)))) / F.sum(F.size("x"))
        one = t.agg(*[err(f"q{b}").alias(f"m{b}") for b in bits], F.sqrt(err("back", "x")).alias("invertibility"), F.avg(F.abs(E.norm(F.col("y")) / E.norm(F.col("x")) - 1)).alias("isometry"))
        cells = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.col(f"m{b}").alias("mse")) for b in bits])).alias("c")
        parts.append(one.select(F.lit(name).alias("rotation"), F.lit(rot.elements).alias("elements"), "invertibility", "isometry", cells).select("rotation", "elements", "c.*", "invertibility", "isometry"))
    return _union(parts)


def quantizer_benchmark(df: DataFrame, names: tuple[str, ...] = ("scalar", "e8", "z8_256", "kmeans_256"), bits: int = 3, key: str = "vec_id", every: int = 50, column: str = "vec", seed: int = 42) -> DataFrame:
    """(quantizer, bits_per_dim, mse, bias, rmse, corr): errors of vectors and of inner products with the queries key % every = 0.

    A stated query set against all rows, all pairs counted: their sums follow from moments (S.pair_sums), so no pair is made."""
    d, parts = E.require_dim(df, column), []
    for name in names:
        m = P.Mse(d, bits if name == "scalar" else 1, "wht", name, seed).fit(df, column)
        t = m.transform(df.select((F.col(key) % every == 0).alias("query"), F.col(column).alias("vec")).where("vec is not null"))
        s = S.pair_sums(t.select(F.coalesce("query", F.lit(False)).alias("query"), "vec", "restored"), d)
        bias, rmse = F.try_divide("d", "pairs"), F.sqrt(F.greatest(F.try_divide("dd", "pairs"), F.lit(0.0)))
        spread = lambda c, cc: F.sqrt(F.greatest(F.col("pairs") * F.col(cc) - F.col(c) * F.col(c), F.lit(0.0)))
        corr = F.try_divide(F.col("pairs") * F.col("xy") - F.col("x") * F.col("y"), spread("x", "xx") * spread("y", "yy"))
        parts.append(s.select(F.lit(name).alias("quantizer"), F.lit(m.quant.bits_per_dimension()).alias("bits_per_dim"), F.try_divide(F.col("squares"), F.col("rows") * d).alias("mse"), bias.alias("bias"), rmse.alias("rmse"), corr.alias("corr")))
    return _union(parts)


def attention_fidelity(keys: DataFrame, queries: DataFrame, bits: tuple[int, ...] = (2, 3, 4), rotation: str = "wht", quantizer: object = None, use_nsn: bool = True, seed: int = 42, group: tuple[str, ...] = ("b", "h")) -> DataFrame:
    """(bits, group, cosine, top1, top5) of estimated against exact scores. With scalar codes all bits are one pass over the keys."""
    d, parts = E.require_dim(keys, "vec"), []
    if quantizer is None:
        settings = {str(b): T.setting(d, b, rotation, use_nsn, seed) for b in bits}
        t = T.trials(keys.select(*group, "k_id", "vec"), queries.select(*group, "q_id", "q", F.lit(None).cast("long").alias("target")), settings, group)
        return T.summary(t, settings, group, (group,)).select(*group, "cosine", "top1", "top5", F.col("setting").cast("int").alias("bits"))
    exact = S.all_scores(queries, keys.select(*group, "k_id", F.col("vec").alias("k")), group)
    for b in bits:
        c = P.KeyCompressor(d, b, rotation, quantizer, seed, use_nsn)
        est = c.scores(queries, c.compress(keys), group)
        t = exact.join(est.withColumnRenamed("score", "est"), [*group, "q_id", "k_id"])
        parts.append(matches(t, group).withColumn("bits", F.lit(b)))
    return _union(parts)


def matches(t: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group, cosine, top1, top5) from (group, q_id, k_id, score, est), by aggregates that combine before the shuffle."""
    by = [*group, "q_id"]
    best = lambda c, name: F.max(F.struct(F.col(c), (-F.col("k_id")).alias("k"))).alias(name)
    q = t.groupBy(*by).agg((F.sum(F.col("score") * F.col("est")) / (F.sqrt(F.sum(F.col("score") * F.col("score"))) * F.sqrt(F.sum(F.col("est") * F.col("est"))))).alias("cos"), best("score", "a"), best("est", "e"))
    # The exact best key's place among the estimates: how many are above it.
    x = t.join(q.select(*by, (-F.col("a.k")).alias("k0")), by)
    at = x.where(F.col("k_id") == F.col("k0")).select(*by, F.col("est").alias("est0"))
    place = t.join(at, by).groupBy(*by).agg(F.sum((F.col("est") > F.col("est0")).cast("long")).alias("above"))
    return q.join(place, by).groupBy(*group).agg(F.avg("cos").alias("cosine"), F.avg((F.col("a.k") == F.col("e.k")).cast("double")).alias("top1"), F.avg((F.col("above") < 5).cast("double")).alias("top5"))


def ablation(keys: DataFrame, queries: DataFrame, bits: int = 3, seed: int = 42) -> DataFrame:
    """(step, group, cosine, top1, top5, bytes): haar, then wht, normalisation, sign packing, and post-quantization scaling on top of each other, in one pass over pairs of tiles."""
    d, n, group = E.require_dim(keys, "vec"), keys.count(), ("b", "h")
    settings, sizes = {}, []
    for i, (name, rotation, nsn, packed) in enumerate((("haar", "haar", False, False), ("wht", "wht", False, False), ("nsn", "wht", True, False), ("packing", "wht", True, True), ("scaling", "wht", True, True))):
        step, size = f"{i} {name}", P.storage(n, d, bits, nsn=nsn)
        settings[step] = T.setting(d, bits, rotation, nsn, seed)
        sizes += [F.lit(step), F.lit(float(size["total"] + (0 if packed else n * (E.unpacked_bytes(d) - E.packed_bytes(d)))))]
    t = T.trials(keys.select(*group, "k_id", "vec"), queries.select(*group, "q_id", "q", F.lit(None).cast("long").alias("target")), settings, group, ("4 scaling",))
    return T.summary(t, settings, group, (group,)).select(F.col("setting").alias("step"), *group, "cosine", "top1", "top5", F.element_at(F.create_map(*sizes), F.col("setting")).alias("bytes"))


def compress_cache(layers: dict[int, tuple[DataFrame, DataFrame]], key_bits: int = 3, value_bits: int = 3) -> DataFrame:
    """(layer, kind, n, mse, bytes) of keys and values of each layer, with seeds of their own."""
    parts = []
    for layer, (k, v) in layers.items():
        d = E.require_dim(k, "vec")
        a = P.KeyCompressor(d, key_bits, "wht", seed=1000 * layer).compress(k)
        b = P.ValueCompressor(d, value_bits, "wht", seed=1000 * layer + 500).transform(v)
        for kind, t, restored, per_row in (("k", a, "k_mse", d * (key_bits - 1) / 8 + E.packed_bytes(d) + 8), ("v", b, "restored", d * value_bits / 8 + 2)):
            parts.append(Y.mse(t, "vec", restored).crossJoin(t.agg(F.count("*").alias("n"))).select(F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), "n", "mse", (F.col("n") * per_row).alias("bytes")))
    return _union(parts)


def needle_retrieval(keys: DataFrame, needle: list[float], at: int, bits: tuple[int, ...] = (2, 3, 4), seed: int = 42) -> DataFrame:
    """(bits, rank) of the key `at` when its own vector is the query."""
    settings = {str(b): T.setting(len(needle), b, seed=seed).fit(keys) for b in bits}
    t = T.estimates(keys.where("vec is not null").select("k_id", "vec", E.literal(needle).alias("q")), settings, ["k_id"])
    own = keys.where(F.col("k_id") == at).select("k_id", "vec", E.literal(needle).alias("q")).limit(1)
    e0 = T.estimates(own, settings, ["k_id"]).first()["est"]  # one row
    above = [F.sum(((F.col("est")[i] > e + T.EQUAL) | ((F.abs(F.col("est")[i] - e) <= T.EQUAL) & (F.col("k_id") < at))).cast("long")).alias(f"r{i}") for i, e in enumerate(e0)]
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), (F.coalesce(F.col(f"r{i}"), F.lit(0)) + 1).alias("rank")) for i, b in enumerate(bits)])).alias("x")
    return t.agg(*above).select(rows).select("x.*")


def compare(df: DataFrame, bits: tuple[int, ...] = (2, 3, 4), seed: int = 42, column: str = "vec") -> DataFrame:
    """(variant, bits, mse) of plain haar and of wht with normalisation."""
    d, parts = E.require_dim(df, column), []
    unit = df.select(E.unit(F.col(column)).alias("vec"))
    for b in bits:
        parts.append(Y.mse(P.Mse(d, b, "haar", seed=seed).transform(unit), "vec", "restored").select(F.lit("haar").alias("variant"), F.lit(b).alias("bits"), "mse"))
        t, mean = N.nsn(unit, "vec", already_unit=True)
        t = P.Mse(d, b, "wht", seed=seed).transform(t, "normalized", "_z").withColumn("restored", N.nsn_restore(F.col("_z"), mean, F.col("norm1"), F.col("norm2")))
        parts.append(Y.mse(t, "vec", "restored").select(F.lit("nsn_wht").alias("variant"), F.lit(b).alias("bits"), "mse"))
    return _union(parts)


def stage_times(df: DataFrame, bits: int = 3, column: str = "vec") -> DataFrame:
    """(stage, seconds) of normalise, rotate, quantize, restore and sketch, each run to the end on its own."""
    d = E.require_dim(df, column)
    m = P.Mse(d, bits, "wht")
    v = F.col(column)
    stages = {"normalize": E.unit(v), "rotate": m.rot.column(v), "quantize": m.quant.quantize(v), "round_trip": m.restored(v), "sketch": E.pack_signs(P.sketch_signs(v, P.sketch_matrix(d, d)), d)}
    rows = []
    for name, c in stages.items():
        t = time.time()
        df.select(c.alias("x")).write.format("noop").mode("overwrite").save()
        rows.append((name, time.time() - t))
    return df.sparkSession.createDataFrame(rows, "stage string, seconds double")
