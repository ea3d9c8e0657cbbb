"""Joins of queries and keys, and what is read off their scores: top-k, matches, recall, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from .codebooks import nearest_code
from .packed import array_of, best_of, repeated, tiles_met


def all_scores(queries: DataFrame, keys: DataFrame, on: tuple[str, ...] = ("b", "h")) -> DataFrame:
    """(on, q_id, k_id, score): inner products of the queries (q_id, q) and keys (k_id, k) of a group, ids whole numbers; rows without a vector are left out.

    Tiles of bounded size meet group by group: a product of two matrices for each pair of tiles.
    """
    names = [*on, "q_id", "k_id", "score"]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, k_ids, q, k = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("q_ids", "<i8"), ("k_ids", "<i8"), ("qs", "<f8"), ("ks", "<f8")))
                s = q.reshape(len(q_ids), -1) @ k.reshape(len(k_ids), -1).T
                yield pa.RecordBatch.from_arrays([*repeated(b, on, i, s.size), pa.array(np.repeat(q_ids, len(k_ids))), pa.array(np.tile(k_ids, len(q_ids))), pa.array(s.ravel())], names=names)

    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in on)
    t = tiles_met(queries, keys, on, "k", lambda c: array_of(c, len(c)), "ks").mapInArrow(run, f"{kinds}, q_id long, k_id long, score double")
    return t.select(*on, F.col("q_id").cast(queries.schema["q_id"].dataType), F.col("k_id").cast(keys.schema["k_id"].dataType), "score")


#: Scores are compared by so many places: a row's last bits depend on the matrix that it is multiplied in.
PLACES = 12


def best_scores(queries: DataFrame, keys: DataFrame, k: int, on: tuple[str, ...] = ("b", "h")) -> DataFrame:
    """(on, q_id, k_id, score, rank): the k keys (k_id, k) of each query (q_id, q) with the highest inner products, ties (to PLACES places) to the lesser k_id.

    A tile keeps its queries' k best, so what leaves a task grows with queries and tiles and not with pairs.
    """
    names = [*on, "q_id", "k_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, k_ids, q, x = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("q_ids", "<i8"), ("k_ids", "<i8"), ("qs", "<f8"), ("ks", "<f8")))
                s = np.round(q.reshape(len(q_ids), -1) @ x.reshape(len(k_ids), -1).T, PLACES)
                at = best_of(s, k_ids, k)
                rows = np.repeat(np.arange(len(q_ids)), at.shape[1])
                yield pa.RecordBatch.from_arrays([*repeated(b, on, i, len(rows)), pa.array(q_ids[rows]), pa.array(k_ids[at.ravel()]), pa.array(s[rows, at.ravel()])], names=names)

    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in on)
    t = tiles_met(queries, keys, on, "k", lambda c: array_of(c, len(c)), "ks").mapInArrow(run, f"{kinds}, q_id long, k_id long, score double")
    return ranked(t, (*on, "q_id"), k)


def chunk_scores(query: list[float], chunks: DataFrame, column: str = "k") -> DataFrame:
    """(chunk_id, pos, score) of one query against all chunks of a cache; the query is a constant of the plan."""
    q = E.literal(query)
    return chunks.select("chunk_id", "pos", E.dot(q, F.col(column)).alias("score"))


def ranked(scores: DataFrame, group: tuple[str, ...] = ("q_id",), k: int | None = None, score: str = "score", key: str = "k_id") -> DataFrame:
    """scores with rank, from 1, by falling score and key; a limit k lets Spark drop rows before the shuffle."""
    t = scores.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.col(score).desc(), key)))
    return t.where(F.col("rank") <= k) if k else t


def top1_match(exact: DataFrame, estimated: DataFrame, group: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """One row: the share of queries whose best key is the same under both scores."""
    best = lambda t, name: ranked(t, group, 1).select(*group, F.col("k_id").alias(name))
    return best(exact, "a").join(best(estimated, "b"), list(group)).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("top1_match"))


def recall(exact: DataFrame, estimated: DataFrame, k: int = 5, group: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """One row: the share of queries whose exact best key is among the k best estimates."""
    best = ranked(exact, group, 1).select(*group, "k_id")
    hit = best.join(ranked(estimated, group, k).select(*group, "k_id", F.lit(1).alias("hit")), [*group, "k_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def needle_rank(scores: DataFrame, needle: Column, group: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """(group, rank) of the key that is the needle: one more than the keys that score above it. Counted, so no group is sorted."""
    at = scores.where(needle).select(*[F.col(g).alias(f"n_{g}") for g in group], F.col("score").alias("n_score"), F.col("k_id").alias("n_key"))
    on = [F.col(g) == F.col(f"n_{g}") for g in group]
    above = (F.col("score") > F.col("n_score")) | ((F.col("score") == F.col("n_score")) & (F.col("k_id") < F.col("n_key")))
    return scores.join(at, on).groupBy(*group).agg((F.sum(above.cast("long")) + 1).alias("rank"))


def errors(exact: DataFrame, estimated: DataFrame, on: tuple[str, ...] = ("q_id", "k_id")) -> DataFrame:
    """One row: bias, rmse and correlation of estimates."""
    t = exact.select(*on, F.col("score").alias("x")).join(estimated.select(*on, F.col("score").alias("y")), list(on))
    return t.agg(F.avg(F.col("y") - F.col("x")).alias("bias"), F.sqrt(F.avg((F.col("y") - F.col("x")) * (F.col("y") - F.col("x")))).alias("rmse"), F.corr("x", "y").alias("corr"))


def pair_sums(df: DataFrame, d: int) -> DataFrame:
    """One row (rows, squares, pairs, x, y, d, xx, xy, yy, dd) of df (query boolean, vec, restored): sums over all pairs of a query q and a row k of x = <q, k>, y = <q, restored k>, d = y - x and their products; squares sums |restored k - k|^2 over rows.

    Every sum is a product of one sum over queries and one over rows: that of x y is <sum of q q', sum
    of k r'>. So the table is read once, and what leaves a task is a few d x d matrices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            q, k, r = b.column(0).to_numpy(zero_copy_only=False).astype(bool), array_of(b.column(1), b.num_rows), array_of(b.column(2), b.num_rows)
            e, q = r - k, k[q]
            one = {("rows", 0): [len(k)], ("squares", 0): [(e * e).sum()], ("x", 1): k.sum(axis=0), ("y", 1): r.sum(axis=0), ("d", 1): e.sum(axis=0), ("xx", 2): k.T @ k, ("xy", 2): k.T @ r, ("yy", 2): r.T @ r, ("dd", 2): e.T @ e}
            one |= {("q", 0): [len(q)], ("q", 1): q.sum(axis=0), ("q", 2): q.T @ q}
            for at, x in one.items():
                held[at] = held.get(at, 0) + np.asarray(x, np.float64).ravel()
        for (part, order), x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(x)), pa.array(np.full(len(x), order, np.int32)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], names=["part", "power", "i", "x"])

    t = df.select("query", "vec", "restored").mapInArrow(run, "part string, power int, i int, x double").groupBy("part", "power", "i").agg(F.sum("x").alias("x"))
    q = t.where("part = 'q'").select("power", "i", F.col("x").alias("w"))
    t = t.where("part <> 'q'").join(q, ["power", "i"], "left")
    over = lambda c, name: F.sum(F.when(F.col("part") == name, c))
    pair = F.col("x") * F.col("w")
    return t.agg(over(F.col("x"), "rows").alias("rows"), over(F.col("x"), "squares").alias("squares"), over(pair, "rows").alias("pairs"), *[over(pair, c).alias(c) for c in ("x", "y", "d", "xx", "xy", "yy", "dd")])


def nearest_codeword(df: DataFrame, codebook, column: str = "block", out: str = "code") -> DataFrame:
    """df with the number of the nearest codeword, the lowest of equals. The codebook (at most 2187 by 8 numbers) is part of the function."""

    @F.pandas_udf("int")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(nearest_code(np.stack(v.to_numpy()), codebook)) if len(v) else pd.Series([], dtype="int32")

    return df.withColumn(out, run(F.col(column)))
