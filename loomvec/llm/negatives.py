"""Hard-negative mining by a norm-bucketed search.

Candidates are sorted by norm and cut into buckets. An inner product is at most the product of the
norms, so an anchor whose least useful score is s needs only buckets whose greatest norm reaches
s / |anchor|: a prefix of the buckets in the order of norms. What is least useful rises as the search
goes: to the lower limit of a window of scores, and to the k-th score found so far.

Both searches of the operator are that search, over windows of scores:

1. Positives: one window without limits, among rows of the anchor's own label. Buckets are cut within a
   label.
2. Negatives: for each positive the window that its score allows, among rows of other labels. Buckets
   hold all labels; a label of its own is left out while scoring.

Each search first meets every anchor with the bucket of the greatest norms, and what that gives prunes
the rest. A bucket and a group of anchors are one row each, of bounded size, so what is shipped is a
pair of rows a tile. Where norms are all alike, bounds prune nothing and every pair is scored, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop_cut, narrow, read_table

EVERY, SCALE, POSITIVES, NEGATIVES = 50, 256, 5, 3
#: Rows of a bucket and anchors of a group, at most; buckets of a small table are smaller, so that there are tiles for all cores.
BUCKET, GROUP, LEAST_BUCKET = 65_536, 32_768, 1024
#: Steps that norms are told apart by when tiles are chosen. In a task every bucket is judged by its own norm.
STEPS = 1024
_NO_ID = np.iinfo(np.int64).max
_LEAST = -(1 << 62)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector is null or a component is null or not finite.

    Components are held within +-2**31 / sqrt(length), so that a score fits in a long."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = vector.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    most = F.floor(float(1 << 31) / F.sqrt(F.greatest(F.size(vector), F.lit(1))))
    return F.when(~bad, F.transform(x, lambda v: F.floor(F.greatest(-most.cast("double"), F.least(most.cast("double"), v * scale))).cast("long")))


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all."""
    most = max(int(v.max(initial=0)), -int(v.min(initial=0)))
    return v.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def unpacked(raw: bytes, rows: int, width: int) -> np.ndarray:
    if not rows * width:
        return np.zeros((rows, width), np.int64)
    return np.frombuffer(raw, f"<i{len(raw) // (rows * width)}").reshape(rows, width)


def in_rows(t: DataFrame, keys: list[str], extra: dict[str, str], most: int) -> DataFrame:
    """Packs the rows of t, as they lie in its partitions, into one row for up to `most` neighbours with equal keys.

    t: keys, id, label, v, norm and `extra` (name -> type of an element); a packed row has their arrays
    under the same names, its vectors as bytes, its number of rows as n and its greatest norm as top.
    """
    arrays = {"id": "long", "label": "long", "norm": "double"} | extra
    schema = ", ".join([*[f"{k} long" for k in keys], "n long", "top double", "v binary", *[f"{c} array<{kind}>" for c, kind in arrays.items()]])

    def row(x: pa.Table) -> pa.RecordBatch:
        v = x.column("v").combine_chunks()
        v = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        norm = x.column("norm").to_numpy()
        head = [pa.array([x.column(k)[0].as_py()], pa.int64()) for k in keys]
        body = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.column(c).combine_chunks()) for c in arrays]
        return pa.RecordBatch.from_arrays([*head, pa.array([len(x)], pa.int64()), pa.array([float(norm.max())]), pa.array([packed(v)], pa.binary()), *body], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            carry = t if carry is None else pa.concat_tables([carry, t])
            key = np.stack([carry.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(carry)]
            cuts = [x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for x in range(lo, hi, most)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # the last run may go on in the next batch
                yield row(carry.slice(lo, hi - lo))
            carry = carry.slice(cuts[-1])
        if carry is not None:
            yield row(carry)

    return t.select(*keys, "v", *arrays).mapInArrow(run, schema)


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which sums of their products are exact."""
    top = lambda a: max(int(a.max(initial=0)), -int(a.min(initial=0)), 1)
    most = top(q) * top(x) * max(1, q.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return q.astype(kind), x.astype(kind)


def take(best: np.ndarray, names: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Puts the scores of a block (-inf or the least number: not asked for) into the lists of its rows, best first, ties to the smaller id."""
    k = best.shape[1]
    none = -np.inf if score.dtype.kind == "f" else _LEAST
    least = best[rows, -1].astype(score.dtype)
    hit = score >= least[:, None]
    hit &= score > none
    many = np.flatnonzero(hit.sum(axis=1) > 8 * k)
    if len(many) and score.shape[1] > k:  # the k-th score of the block itself leaves out most
        own = np.partition(score[many], score.shape[1] - k, axis=1)[:, -k]
        hit[many] &= score[many] >= own[:, None]
    i, j = np.nonzero(hit)
    if not len(i):
        return
    some = np.unique(i)
    at = np.concatenate([np.repeat(some, k), i])
    s = np.concatenate([best[rows[some]].ravel(), score[i, j].astype(np.int64)])
    n = np.concatenate([names[rows[some]].ravel(), ids[j]])
    order = np.lexsort((n, -s, at))
    at, s, n = at[order], s[order], n[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    best[rows[at[kept]], place[kept]], names[rows[at[kept]], place[kept]] = s[kept], n[kept]


def search(anchors: dict, bucket: dict, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor's place, window, id, score, pairs scored): of each window of each anchor the k best of a bucket.

    anchors: id, label, v, norm, and lo, hi and floor (anchors x windows): the limits of a window, and
    its k-th score so far. A window whose lo is over its hi is empty.
    """
    lo, hi = anchors["lo"], anchors["hi"]
    windows = lo.shape[1]
    best = np.full((windows, len(lo), k), _LEAST)
    names = np.full((windows, len(lo), k), _NO_ID)
    floor = np.maximum(lo, anchors["floor"]).T
    open_ = (lo <= hi).T
    # Cauchy-Schwarz, with a little more for what floats round away.
    reach = anchors["norm"] * bucket["top"] * (1 + 1e-9) + 1e-6
    scored = 0
    q, x = exact(anchors["v"], bucket["v"])
    none = -np.inf if x.dtype.kind == "f" else _LEAST
    step = max(1, (1 << 22) // max(1, len(x)))
    active = np.flatnonzero((open_ & (reach[None, :] >= floor)).any(axis=0))
    for at in range(0, len(active), step):
        rows = active[at : at + step]
        for first in range(0, len(x), 16_384):
            part = slice(first, first + 16_384)
            score = q[rows] @ x[part].T
            scored += score.size
            out = anchors["id"][rows][:, None] == bucket["id"][None, part]
            out |= (anchors["label"][rows][:, None] != bucket["label"][None, part]) if same else (anchors["label"][rows][:, None] == bucket["label"][None, part])
            score[out] = none
            for w in range(windows):
                some = open_[w, rows] & (reach[rows] >= np.maximum(floor[w, rows], best[w, rows, -1]))
                if not some.any():
                    continue
                here, s = rows[some], score[some]
                s = np.where((s >= floor[w, here][:, None]) & (s <= hi[here, w][:, None]), s, none)
                take(best[w], names[w], here, s, bucket["id"][part])
    w, i, p = np.nonzero(names != _NO_ID)
    return i, w, names[w, i, p], best[w, i, p], scored


_FOUND = "anchor long, win int, id long, score long, scored long"


def meet(k: int, same: bool):
    """A group of anchors and a bucket -> the k best of each window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("anchor", pa.int64()), ("win", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("scored", pa.int64())])
        if not len(left) or not len(right):
            return kind.empty_table()

        def read(t: pa.Table, row: int) -> dict:
            n, width = t.column("n")[row].as_py(), t.column("width")[row].as_py()
            out = {c: t.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("id", "label", "norm")}
            return out | {"v": unpacked(t.column("v")[row].as_py(), n, width), "top": t.column("top")[row].as_py(), "n": n}

        parts = []
        for r in range(len(left)):
            a = read(left, r)
            a |= {c: left.column(c)[r].values.flatten().to_numpy(zero_copy_only=False).reshape(a["n"], -1) for c in ("lo", "hi", "floor")}
            keys = left.column("anchor")[r].values.to_numpy(zero_copy_only=False)
            for s in range(len(right)):
                i, w, names, score, scored = search(a, read(right, s), k, same)
                counts = np.zeros(len(i), np.int64)
                counts[:1] = scored
                parts.append(pa.Table.from_arrays([pa.array(keys[i]), pa.array(w.astype(np.int32)), pa.array(names), pa.array(score), pa.array(counts)], schema=kind))
        return pa.concat_tables(parts)

    return run


def needed() -> Column:
    """The least norm that a candidate of any use to an anchor can have; anchors without an open window need none."""
    useful = F.zip_with(F.arrays_zip("lo", "hi"), "floor", lambda w, f: F.when(w["lo"] <= w["hi"], F.greatest(w["lo"], f)))
    return F.array_min(F.filter(useful, lambda x: x.isNotNull())).cast("double") / (F.col("norm") * (1 + 1e-9) + 1e-9)


def bucketed(rows: DataFrame, keys: list[str], n: int, bucket: int) -> DataFrame:
    """The rows of the candidates in buckets by norm within equal keys, from the greatest norm down; each has a number."""
    order = [*[F.col(k) for k in keys], F.col("norm").desc(), F.col("row")]
    t = rows.repartitionByRange(max(1, -(-n // bucket)), *order).sortWithinPartitions(*order)
    return cut(in_rows(t, keys, {}, 2 * bucket).withColumn("bucket", F.monotonically_increasing_id()))


def visit(anchors: DataFrame, buckets: DataFrame, keys: list[str], groups: int, k: int, same: bool, group: int) -> DataFrame:
    """The k best of each window of the anchors, in two rounds: the bucket of the greatest norms, then what its results leave.

    anchors: keys, anchor, id, label, v, norm, lo, hi, floor; returns (anchor, win, id, score, scored).
    """
    extra = {"anchor": "long", "lo": "array<long>", "hi": "array<long>", "floor": "array<long>"}
    sizes = buckets.select(*keys, "bucket", "top")
    first_of = sizes.groupBy(*keys).agg(F.max_by("bucket", F.struct("top", F.col("bucket"))).alias("bucket"))
    # STEPS numbers at most: a bucket's step is the number of them that lie over its norm.
    found = sizes.agg(F.percentile_approx("top", [i / STEPS for i in range(STEPS, 0, -1)], 100_000)).first()[0] or []
    steps = F.array(*[F.lit(float(x)) for x in sorted(set(found), reverse=True)]).cast("array<double>")
    sizes = sizes.withColumn("step", F.size(F.filter(steps, lambda x: x > F.col("top"))))

    def grouped(a: DataFrame) -> DataFrame:
        a = a.withColumn("need", needed()).where("need is not null")
        order = [*[F.col(c) for c in keys], F.col("need"), F.col("anchor")]
        a = a.repartitionByRange(max(1, groups), *order).sortWithinPartitions(*order)
        return cut(in_rows(a, keys, extra | {"need": "double"}, group).withColumn("grp", F.monotonically_increasing_id()))

    def round_of(g: DataFrame, tiles: DataFrame) -> DataFrame:
        """tiles (grp, bucket): each pair of rows meets in a task."""
        left = g.join(tiles.select(F.col("grp").alias("grp1"), F.col("bucket").alias("bucket1")), F.col("grp") == F.col("grp1"))
        right = buckets.join(tiles.select(F.col("grp").alias("grp2"), F.col("bucket").alias("bucket2")), F.col("bucket") == F.col("bucket2"))
        return left.groupBy("grp1", "bucket1").cogroup(right.groupBy("grp2", "bucket2")).applyInArrow(meet(k, same), _FOUND)

    on = lambda a, b: [a[c] == b[f"{c}_"] for c in keys]
    named = lambda t: t.select(*[F.col(c).alias(f"{c}_") if c in keys else F.col(c) for c in t.columns])
    g = grouped(anchors)
    first = named(first_of)
    tiles = g.select("grp", *keys).join(first, on(g, first)).select("grp", "bucket")
    seen = cut(round_of(g, cut(tiles)))
    reached = seen.groupBy("anchor", "win").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    reached = reached.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("win", "s"))).alias("reached")).withColumnRenamed("anchor", "anchor_")
    again = anchors.join(reached, F.col("anchor") == F.col("anchor_"), "left").drop("anchor_")
    again = again.withColumn("floor", F.transform("floor", lambda f, i: F.coalesce(F.try_element_at("reached", i.cast("int")), f))).drop("reached")
    g2 = grouped(again)
    g3 = g2.select("grp", *keys, F.array_min("need").alias("need"))
    g3 = g3.withColumn("step", F.explode(F.sequence(F.lit(0), F.size(F.filter(steps, lambda x: x >= F.col("need"))))))
    rest = named(sizes.select(*keys, "bucket", "step").withColumnRenamed("step", "step2"))
    tiles = g3.join(rest, [*on(g3, rest), F.col("step") == F.col("step2")]).select("grp", "bucket")
    seeds = first_of.select(F.col("bucket").alias("seed"))
    tiles = cut(tiles.join(seeds, F.col("bucket") == F.col("seed"), "left_anti"))
    return seen.unionByName(round_of(g2, tiles))


def best(found: DataFrame, k: int) -> DataFrame:
    """(anchor, win, id, score, rank): each window's k best."""
    rank = F.row_number().over(W.partitionBy("anchor", "win").orderBy(F.col("score").desc(), "id"))
    return found.select("anchor", "win", "id", "score").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, bucket: int = BUCKET, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(negatives, pairs scored): hard negatives of every row whose key is divisible by `every`.

    Negatives are (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of
    an anchor's `positives` best other rows of its label, the `negatives` best rows of other labels whose
    score is 50 to 95 hundredths of the positive's. Rows whose key, label or vector is null, or whose
    vector holds a null or a component that isn't finite, take no part; an empty vector meets only empty
    ones, with a score of 0, and vectors of unlike lengths don't meet. Equal scores go to the smaller key.
    Rows of one key are rows of their own, but an anchor leaves out all rows of its key, and repeated
    anchors are asked once. An anchor without positives, and a positive without negatives, has no row.
    Components are held within +-2**31 / sqrt(length) after scaling, so every score is exact in a long.
    An empty table gives an empty table; other columns are ignored.
    """
    t = narrow(vectors, id=F.col(key).cast("long"), label=F.col(label).cast("long"), v=whole(F.col(vector), scale)).where("id is not null and label is not null and v is not null")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    t = cut(t.withColumn("width", F.size("v").cast("long")).withColumn("norm", F.sqrt(square)).withColumn("row", F.monotonically_increasing_id()))
    n = t.count()
    size = max(1, min(bucket, max(LEAST_BUCKET, -(-n // (4 * t.sparkSession.sparkContext.defaultParallelism)))))
    a = cut(t.where(F.col("id") % every == 0).groupBy("id", "label", "v", "width", "norm").agg(F.min("row").alias("anchor")))
    groups = -(-a.count() // group)

    asked = a.withColumns({"space": F.col("label"), "lo": F.array(F.lit(_LEAST + 1)), "hi": F.array(F.lit(-_LEAST)), "floor": F.array(F.lit(_LEAST))})
    by_label = bucketed(t.withColumn("space", F.col("label")), ["width", "space"], n, size)
    near = visit(asked, by_label, ["width", "space"], groups, positives, True, group)
    near = cut(near)
    # From half of the positive's score, rounded up, to 95 hundredths, rounded down; below 0 there is nothing between them.
    window = {"lo": F.expr("if(score < 0, 1, score - score div 2)"), "hi": F.expr("if(score < 0, 0, score - (score + 19) div 20)")}
    pairs = cut(best(near, positives).select(F.col("anchor").alias("of"), F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), *[x.cast("long").alias(c) for c, x in window.items()]))

    windows = pairs.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))).alias("x"))
    asked = a.join(windows, F.col("anchor") == F.col("of")).withColumns({"lo": F.col("x.lo"), "hi": F.col("x.hi"), "floor": F.transform("x", lambda _: F.lit(_LEAST))}).drop("of", "x")
    for c, empty in (("lo", 1), ("hi", 0), ("floor", _LEAST)):  # every anchor has `positives` windows; those without a positive are empty
        asked = asked.withColumn(c, F.slice(F.concat(c, F.array_repeat(F.lit(empty).cast("long"), positives)), 1, positives))
    far = cut(visit(cut(asked), bucketed(t, ["width"], n, size), ["width"], groups, negatives, False, group))

    ids = a.select(F.col("anchor").alias("anchor2"), F.col("id").alias("anchor_id"))
    out = best(far, negatives).select("anchor", "win", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    out = out.join(pairs, (F.col("anchor") == F.col("of")) & (F.col("win") + 1 == F.col("place"))).join(ids, F.col("anchor") == F.col("anchor2"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), near.select("scored").unionByName(far.select("scored"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(t.withColumn("label", moved))[0]


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, len(c.v) + 1)]), 0)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
), p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
