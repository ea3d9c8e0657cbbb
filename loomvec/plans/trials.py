"""Trials as a table: many settings, bits and needles scored in one pass over the keys, summed by any grouping of layers and heads.

Each setting compresses a tile of keys once; the tile meets tiles of queries and gives each query's sums,
best keys and five best estimates, among them the exact best key's. One aggregate by setting and query
puts tiles together; groupings of layers and heads are made of its sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packed import PackedKeys, array_of, tiles_met

Settings = dict[str, PackedKeys]
#: Estimates that differ by less are equal: a row's last bits depend on the batch that it is multiplied in.
EQUAL = 1e-12


def setting(d: int, bits: int, rotation: str = "wht", use_nsn: bool = True, seed: int = 42) -> PackedKeys:
    """Keys in `bits` bits with exact norms, as KeyCompressor has them."""
    return PackedKeys(d, bits, rotation, seed, use_nsn, norm_types="<f8")


def estimates(t: DataFrame, settings: Settings, keep: list[str]) -> DataFrame:
    """(keep, score, est) of rows (keep, vec, q): exact inner products and one estimate a setting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, q = (array_of(b.column(len(keep) + i), b.num_rows) for i in (0, 1))
            out = np.zeros((b.num_rows, len(settings)))
            for i, c in enumerate(settings.values()) if b.num_rows else ():
                codes, signs, norms = c.layout.unpack(c.pack(x))
                out[:, i] = (q * np.clip(c.restored(codes, norms), -65504.0, 65504.0)).sum(axis=1)
                if c.use_qjl:
                    s = 2.0 * np.unpackbits(signs, axis=1, bitorder="little", count=c.d) - 1
                    out[:, i] += norms[c.names.index("residual")] * math.sqrt(math.pi / 2) / c.d * ((q @ c.sketch.T) * s).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array((x * q).sum(axis=1) if b.num_rows else [], pa.float64()), pa.array(list(out), pa.list_(pa.float64()))], names=[*keep, "score", "est"])

    kinds = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for c in keep)
    return t.select(*keep, "vec", "q").mapInArrow(run, f"{kinds}, score double, est array<double>")


def trials(keys: DataFrame, queries: DataFrame, settings: Settings, group: tuple[str, ...] = ("layer", "head"), scaled: tuple[str, ...] = ()) -> DataFrame:
    """One row a setting, group and query, with its sums.

    keys (group, k_id, vec), queries (group, q_id, q, target): target is the key that is looked for, or
    null. Returns (setting, group, q_id, n, x, y, xx, yy, xy, cos, top1, top5, hit): counts and sums of
    exact (x) and estimated (y) scores, their cosine, whether the best keys agree, whether the exact
    best is among the five best estimates, and whether the best estimate is the target. Equal scores go
    to the lesser k_id. Settings named in `scaled` scale restored keys after quantization.

    Tiles of queries and keys meet, and a tile gives one row a setting and query: sums, both best keys and
    the five best estimates. No pair leaves a task.
    """
    keys = keys.where("vec is not null")
    means: dict[tuple[bool, bool], list[float]] = {}
    for c in settings.values():
        if c.use_nsn:
            c.mean = c.mean or means.get((c.unit, c.full_nsn))
            means[c.unit, c.full_nsn] = c.fit(keys).mean
    by, same = [*group, "q_id"], _alike(settings, scaled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids, x, rows = None, None, None, {}
        for b in batches:
            for i in range(b.num_rows):
                q_ids, k_ids, raw = (b.column(c)[i].as_py() for c in ("q_ids", "k_ids", "vecs"))
                if (k_ids, raw) != seen:
                    ids = np.frombuffer(k_ids, "<i8")
                    order = np.argsort(ids, kind="stable")
                    ids, x = ids[order], np.frombuffer(raw, "<f8").reshape(len(ids), -1)[order]
                    seen, rows = (k_ids, raw), {n: settings[n].rows(x, n in scaled) for n in same}
                q_ids = np.frombuffer(q_ids, "<i8")
                q = np.frombuffer(b.column("qs")[i].as_py(), "<f8").reshape(len(q_ids), -1)
                s = q @ x.T
                at = np.arange(len(q)), _first_best(s)
                exact = {"n": pa.array(np.full(len(q), len(ids))), "x": s.sum(axis=1), "xx": np.einsum("ij,ij->i", s, s), "best_x": s[at], "best": ids[at[1]]}
                for name, k in rows.items():
                    y = q @ k.T
                    found, lo = _first_best(y), max(0, len(ids) - 5)
                    sums = {"y": y.sum(axis=1), "yy": np.einsum("ij,ij->i", y, y), "xy": np.einsum("ij,ij->i", s, y), "y0": y[at], "found_y": y[at[0], found], "found": ids[found], "five": list(np.partition(y, lo, axis=1)[:, lo:])}
                    out = {"q_id": q_ids, **exact, **sums}
                    for setting in same[name]:
                        head = [pa.array([setting] * len(q)), *[pa.array([b.column(c)[i].as_py()] * len(q), b.schema.field(c).type) for c in group]]
                        yield pa.RecordBatch.from_arrays([*head, *[c if isinstance(c, pa.Array) else pa.array(c) for c in out.values()]], names=["setting", *group, *out])

    kinds = ", ".join(f"{c} {keys.schema[c].dataType.simpleString()}" for c in group)
    t = tiles_met(queries, keys, group, "vec", lambda c: array_of(c, len(c)), "vecs")
    t = t.mapInArrow(run, f"setting string, {kinds}, q_id long, n long, x double, xx double, best_x double, best long, y double, yy double, xy double, y0 double, found_y double, found long, five array<double>")
    sums = ("x", "y", "xx", "yy", "xy")
    t = t.groupBy("setting", *by).agg(*[F.sum(c).alias(c) for c in ("n", *sums)], F.collect_list(F.struct("best_x", "best", "y0", "found_y", "found", "five")).alias("tiles"), F.max("best_x").alias("top_x"), F.max("found_y").alias("top_y"))
    # Of the tiles whose best is the best of all, the least key.
    best = F.array_min(F.transform(F.filter("tiles", lambda e: e["best_x"] >= F.col("top_x") - EQUAL), lambda e: F.struct(e["best"].alias("k"), e["y0"].alias("y0"))))
    found = F.array_min(F.transform(F.filter("tiles", lambda e: e["found_y"] >= F.col("top_y") - EQUAL), lambda e: e["found"]))
    t = t.withColumns({"_best": best, "_found": found})
    above = F.size(F.filter(F.flatten(F.transform("tiles", lambda e: e["five"])), lambda y: y > F.col("_best.y0") + EQUAL))
    target = queries.groupBy(*group, F.col("q_id").cast("long").alias("q_id")).agg(F.max("target").alias("target"))
    t = t.withColumn("_above", above).drop("tiles").join(target, by)
    cos = F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))
    return t.select("setting", *by, "n", *sums, cos.alias("cos"), (F.col("_found") == F.col("_best.k")).cast("double").alias("top1"), (F.col("_above") < 5).cast("double").alias("top5"), (F.col("_found") == F.col("target")).cast("double").alias("hit"))


def _first_best(s: np.ndarray) -> np.ndarray:
    """The first place of each row that holds its highest score."""
    return (s >= s.max(axis=1, keepdims=True) - EQUAL).argmax(axis=1)


def _alike(settings: Settings, scaled: tuple[str, ...]) -> dict[str, list[str]]:
    """One setting of each kind, with the names of all that give the same estimates."""
    out: dict[tuple, list[str]] = {}
    for name, c in settings.items():
        kind = (c.d, c.layout, c.rot.name, c.seed, c.sketch_seed, c.use_nsn, c.full_nsn, c.use_qjl, c.unit, name in scaled, tuple(c.mean or ()))
        out.setdefault(kind, []).append(name)
    return {names[0]: names for names in out.values()}


def summary(t: DataFrame, settings: Settings, group: tuple[str, ...] = ("layer", "head"), levels: tuple[tuple[str, ...], ...] | None = None) -> DataFrame:
    """(setting, group, queries, pairs, bias, rmse, corr, cosine, top1, top5, hits, ratio) of trials(), for each set of columns in `levels` (default: all prefixes of group); others are null.

    ratio: bits of 16-bit elements over those of codes, signs and two norms of 16 bits a key.
    """
    levels = levels or tuple(group[:i] for i in range(len(group), -1, -1))
    n, p = F.sum("n"), {c: F.sum(c) for c in ("x", "y", "xx", "yy", "xy")}
    bias = (p["y"] - p["x"]) / n
    rmse = F.sqrt(F.greatest((p["yy"] - 2 * p["xy"] + p["xx"]) / n, F.lit(0.0)))
    corr = (n * p["xy"] - p["x"] * p["y"]) / (F.sqrt(n * p["xx"] - p["x"] * p["x"]) * F.sqrt(n * p["yy"] - p["y"] * p["y"]))
    sets = [[F.col("setting"), *[F.col(c) for c in level]] for level in levels]
    out = t.groupingSets(sets, "setting", *group).agg(F.count("*").alias("queries"), n.alias("pairs"), bias.alias("bias"), rmse.alias("rmse"), corr.alias("corr"), F.avg("cos").alias("cosine"), F.avg("top1").alias("top1"), F.avg("top5").alias("top5"), F.avg("hit").alias("hits"))
    ratios = F.create_map(*[x for name, c in settings.items() for x in (F.lit(name), F.lit(16.0 * c.d / (c.d * c.layout.bits + c.layout.m + 32)))])
    return out.select("setting", *group, "queries", "pairs", "bias", "rmse", "corr", "cosine", "top1", "top5", "hits", F.element_at(ratios, F.col("setting")).alias("ratio"))
