"""Exact top-k inner products by a dual-tree search over cover trees.

The upper level of the data's cover tree is chosen on a bounded sample (SAMPLE rows): centres that lie
far apart, each row in the cell of its nearest one. Cells are cut into shards of bounded size; every
shard gets a cover tree of its own once, which is stored. Queries are grouped by their cells in the
same way. The search goes down both sides:

1. Each query group searches one shard of its own cell; a query's k-th score there is its floor.
2. Groups meet cells, then the shards of the cells that are left: a pair of nodes stays only if its
   centres and covering radii allow a score that reaches the worst floor of the group.
3. In a task, the tree of a group's queries walks down the stored tree of a shard, again by bounds; at
   a query leaf every query has a bound of its own. What is left is scored in blocks of integers.

A last step keeps each query's k best of all shards. Where bounds can't tell nodes apart (points that
are all about equally far from each other), every pair is scored, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop_cut, narrow, read_table

K = 10
SCALE = 1024
EVERY = 100
#: Rows to a shard, queries to a group and to a task, vectors to a leaf of data and of queries.
SHARD, GROUP, TASK, LEAF, QUERY_LEAF = 16_384, 1024, 16_384, 128, 32
#: Rows that cells are chosen on, and most cells. Every row is indexed.
SAMPLE, CELLS = 4096, 256
#: How much a covering radius shrinks from a level to the next.
SHRINK = 0.7
#: A level whose centres would be more than this share of a node's points tells nothing apart: the node is a leaf.
FLAT = 0.25
_NO_ID = np.iinfo(np.int64).max
_LEAST = -_NO_ID


def spread_out(points: np.ndarray, first: int, reach: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, each time the point farthest from those before, until all points are within reach; the nearest centre of every point and its distance."""
    near = np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    owner, centres = np.zeros(len(points), np.int64), [first]
    while near.max() > reach and len(centres) < most:
        far = int(near.argmax())
        x = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = x < near
        owner[closer], near = len(centres), np.minimum(near, x)
        centres.append(far)
    return centres, owner, near


@dataclass
class CoverTree:
    """Nodes in the order of their levels. A node's children are the nodes kids_lo..kids_hi; their centres lie farther
    apart than SHRINK times the node's radius, and all points of a node lie within its radius. A leaf (no children)
    has the points order[lo:hi]."""

    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    kids_lo: np.ndarray
    kids_hi: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    order: np.ndarray

    @staticmethod
    def over(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        """points: float64, at least one. The root's centre is the point nearest to the mean."""
        size = np.sqrt((points * points).sum(axis=1))
        mean = points.mean(axis=0)
        nodes = [[int(((points - mean) ** 2).sum(axis=1).argmin()), 0.0, 0.0, 0, 0, 0, 0]]
        todo: list[np.ndarray] = [np.arange(len(points))]
        order, at, placed = [], 0, 0
        while at < len(nodes):
            ids, node = todo[at], nodes[at]
            d = np.sqrt(((points[ids] - points[node[0]]) ** 2).sum(axis=1))
            node[1], node[2] = float(d.max()), float(size[ids].max())
            reach, groups = SHRINK * node[1], []
            if len(ids) > leaf and node[1] > 0:
                some = ids[:: max(1, len(ids) // 256)]
                probe = spread_out(points[some], 0, reach, len(some))[0]
                if len(probe) <= FLAT * len(some):
                    first = int(np.flatnonzero(ids == node[0])[0])
                    centres, owner, _ = spread_out(points[ids], first, reach, len(ids))
                    groups = [(int(ids[c]), ids[owner == j]) for j, c in enumerate(centres)]
            if len(groups) > 1:
                node[3], node[4] = len(nodes), len(nodes) + len(groups)
                nodes += [[c, 0.0, 0.0, 0, 0, 0, 0] for c, _ in groups]
                todo += [below for _, below in groups]
            else:
                node[5], node[6] = placed, placed + len(ids)
                order.append(ids)
                placed += len(ids)
            todo[at] = ids[:0]
            at += 1
        c, r, n, *rest = zip(*nodes, strict=True)
        return CoverTree(np.array(c), np.array(r), np.array(n), *[np.array(x) for x in rest], np.concatenate(order))


def bounds(dot: np.ndarray, c1: np.ndarray, r1: np.ndarray, n1: np.ndarray, c2: np.ndarray, r2: np.ndarray, n2: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The most that the inner product of a point within r1 of a centre and one within r2 of another can be.

    dot and apart: inner product and distance of the centres; c1, c2: their norms; n1, n2: the greatest
    norms below them. A little more than the exact bound, for what floats round away.
    """
    gap = np.maximum(0.0, apart - r1 - r2)
    most = np.minimum(dot + r1 * c2 + r2 * c1 + r1 * r2, (n1 * n1 + n2 * n2 - gap * gap) / 2)
    return most + 1e-9 * (n1 * n1 + n2 * n2) + 1e-6


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, object]:
    """Both in a type in which sums of products are exact, and a score below all: float64 under 2**53, int64 under 2**63, Python's integers beyond."""
    most = _top(q) * _top(x) * q.shape[1]
    if most < 1 << 53:
        return q.astype(np.float64), x.astype(np.float64), -np.inf
    if most < 1 << 63:
        return q.astype(np.int64), x.astype(np.int64), np.iinfo(np.int64).min
    return q.astype(object), x.astype(object), -(1 << 200)


def _top(a: np.ndarray) -> int:
    return max(1, int(a.max()), -int(a.min()))


def search(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, data: np.ndarray, data_ids: np.ndarray, tree: CoverTree, k: int = K) -> tuple[np.ndarray, np.ndarray, list, int]:
    """(query ids, vector ids, scores, pairs scored): of each query the k best of data that aren't below its floor, ties to the smaller id, itself left out.

    queries and data hold whole numbers (int64); data lies in the order of the tree's leaves.
    floors: for each query a score that k others reach, or None.
    """
    q, x, none = exact(queries, data)
    qf, xf = queries.astype(np.float64), data.astype(np.float64)
    size = np.sqrt((qf * qf).sum(axis=1))
    place = np.empty(len(tree.order), np.int64)
    place[tree.order] = np.arange(len(tree.order))
    centres = xf[place[tree.centre]]
    c_size = np.sqrt((centres * centres).sum(axis=1))
    asked = CoverTree.over(qf, QUERY_LEAF)
    q_centres = qf[asked.centre]
    qc_size = np.sqrt((q_centres * q_centres).sum(axis=1))

    start = np.full(len(q), none, q.dtype)
    known = np.array([f is not None and f > _LEAST for f in floors], bool)
    if known.any():
        start[known] = np.array([f for f, k_ in zip(floors, known, strict=True) if k_], q.dtype)
    best_score = np.repeat(start[:, None], k, axis=1)
    best_id = np.full((len(q), k), _NO_ID)
    scored = 0

    below: list[np.ndarray] = [np.zeros(0, np.int64)] * len(asked.centre)
    for n in range(len(below) - 1, -1, -1):
        a, b = int(asked.kids_lo[n]), int(asked.kids_hi[n])
        below[n] = np.concatenate(below[a:b]) if b > a else asked.order[asked.lo[n] : asked.hi[n]]

    def node_bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ca, cb = q_centres[a], centres[b]
        return bounds((ca * cb).sum(axis=1), qc_size[a], asked.radius[a], asked.norm[a], c_size[b], tree.radius[b], tree.norm[b], np.sqrt(((ca - cb) ** 2).sum(axis=1)))

    def worst(a: int) -> float:
        return float(best_score[below[a], -1].min())

    zero = np.zeros(1, np.int64)
    heap = [(-float(node_bounds(zero, zero)[0]), 0, 0)]
    while heap:
        upper, a, b = heapq.heappop(heap)
        if -upper < worst(a):  # not even a tie
            continue
        if asked.kids_hi[a] > asked.kids_lo[a] and (tree.kids_hi[b] == tree.kids_lo[b] or asked.radius[a] >= tree.radius[b]):
            kids = np.arange(asked.kids_lo[a], asked.kids_hi[a])
            found = node_bounds(kids, np.full(len(kids), b))
            for n, f in zip(kids.tolist(), found.tolist(), strict=True):
                heapq.heappush(heap, (-f, n, b))
            continue
        group = below[a]
        if tree.kids_hi[b] > tree.kids_lo[b]:
            kids = np.arange(tree.kids_lo[b], tree.kids_hi[b])
            if asked.kids_hi[a] > asked.kids_lo[a]:
                found = node_bounds(np.full(len(kids), a), kids)
            else:  # a leaf of queries: the greatest of the queries' own bounds that reach their k-th score
                dot = qf[group] @ centres[kids].T
                apart = np.sqrt(np.maximum(0.0, size[group][:, None] ** 2 + c_size[kids] ** 2 - 2 * dot))
                own = bounds(dot, size[group][:, None], 0.0, size[group][:, None], c_size[kids], tree.radius[kids], tree.norm[kids], apart * (1 - 1e-9) - 1e-6)
                found = np.where(own >= best_score[group, -1].astype(np.float64)[:, None], own, -np.inf).max(axis=0)
            for n, f in zip(kids.tolist(), found.tolist(), strict=True):
                if f > -np.inf:
                    heapq.heappush(heap, (-f, a, n))
            continue
        # Two leaves: only queries whose own bound reaches their k-th score are scored.
        dot = qf[group] @ centres[b]
        apart = np.sqrt(np.maximum(0.0, size[group] ** 2 + c_size[b] ** 2 - 2 * dot))
        own = bounds(dot, size[group], 0.0, size[group], c_size[b], tree.radius[b], tree.norm[b], apart * (1 - 1e-9) - 1e-6)
        group = group[own >= best_score[group, -1].astype(np.float64)]
        for lo in range(int(tree.lo[b]), int(tree.hi[b]), 4096):
            hi = min(lo + 4096, int(tree.hi[b]))
            for at in range(0, len(group), 256):
                rows = group[at : at + 256]
                score = q[rows] @ x[lo:hi].T
                scored += score.size
                score[query_ids[rows][:, None] == data_ids[None, lo:hi]] = none
                _take(best_score, best_id, rows, score, data_ids[lo:hi], none, k)
    some = best_id != _NO_ID
    return np.repeat(query_ids, k).reshape(-1, k)[some], best_id[some], [int(s) for s in best_score[some]], scored


def _take(best_score: np.ndarray, best_id: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, none: object, k: int) -> None:
    """Puts what is better in a block of scores into the lists of its queries."""
    least = best_score[rows, -1]
    if score.shape[1] > k and score.dtype != object:  # a block's own k-th score saves looking at what it can't reach
        least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
    better = (score >= least[:, None]) & (score > none)
    for i in np.flatnonzero(better.any(axis=1)):
        at = np.flatnonzero(better[i])
        r = rows[i]
        both, names = np.concatenate([best_score[r], score[i, at]]), np.concatenate([best_id[r], ids[at]])
        order = np.array(sorted(range(len(both)), key=lambda j: (-both[j], names[j]))[:k]) if both.dtype == object else np.lexsort((names, _minus(both)))[:k]
        best_score[r], best_id[r] = both[order], names[order]


def _minus(a: np.ndarray) -> np.ndarray:
    """Order turned over; the least integer has no negative."""
    return -a if a.dtype == np.float64 else ~a


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, within a long; null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    most = float(1 << 62)
    return F.when(good, F.transform(x, lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v * scale))).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def choose_cells(sample: list[list[int]], n: int, shard: int = SHARD) -> dict[int, np.ndarray]:
    """width -> centres (float64) of the upper level, as many as the table has shards, CELLS at most."""
    most, out = min(CELLS, -(-n // shard)), {}
    for width in sorted({len(v) for v in sample}):
        x = np.array([v for v in sample if len(v) == width], np.float64)
        out[width] = x[spread_out(x, 0, 0.0, most)[0]]
    return out


_HOMED = "id long, v array<long>, width int, cell int, far double, norm double"


def homes(t: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(id, v, width) with the cell of the nearest centre of that width, the distance and the norm. Widths that the sample has not met have cells without a centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.asarray(b.column(2))
            for w in np.unique(widths):
                part = b.filter(pa.array(widths == w))
                x = _matrix(part.column(1), len(part)).astype(np.float64)
                size = np.sqrt((x * x).sum(axis=1))
                c = centres.get(int(w))
                if c is None:
                    cell, far = np.full(len(x), CELLS + int(w) % CELLS), np.full(len(x), np.inf)
                else:
                    cell = ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
                    far = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(size)], names=[x.split()[0] for x in _HOMED.split(", ")])

    return t.mapInArrow(run, _HOMED)


_TREE = "centre array<int>, radius array<double>, norm array<double>, kids_lo array<int>, kids_hi array<int>, lo array<int>, hi array<int>, leaf_order array<int>"
_SHARD = f"width int, cell int, part int, ids array<long>, v array<long>, mid array<double>, reach double, top double, {_TREE}"


def plant(table: pa.Table) -> pa.Table:
    """The rows of one shard -> one row: ids and vectors in the order of the tree's leaves, the tree, and its root as a node."""
    n = len(table)
    x = _matrix(table.column("v"), n)
    tree = CoverTree.over(x.astype(np.float64))
    arrays = [tree.centre, tree.radius, tree.norm, tree.kids_lo, tree.kids_hi, tree.lo, tree.hi, tree.order]
    kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.int32()] * 5]
    head = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("width", "cell", "part")]
    ids = table.column("id").to_numpy()[tree.order]
    body = [pa.array([ids], pa.list_(pa.int64())), pa.array([x[tree.order].ravel()], pa.list_(pa.int64())), pa.array([x[tree.centre[0]].astype(np.float64)], pa.list_(pa.float64())), pa.array([float(tree.radius[0])]), pa.array([float(tree.norm[0])])]
    return pa.Table.from_arrays([*head, *body, *[pa.array([a], pa.list_(k)) for a, k in zip(arrays, kinds, strict=True)]], names=[c.split()[0] for c in _SHARD.split(", ")])


_GROUP = "width int, cell int, grp int, mid array<double>, reach double, top double"


def query_node(table: pa.Table) -> pa.Table:
    """The queries of one group -> the node that covers them."""
    x = _matrix(table.column("v"), len(table)).astype(np.float64)
    mid = x.mean(axis=0)
    reach, top = float(np.sqrt(((x - mid) ** 2).sum(axis=1)).max()), float(np.sqrt((x * x).sum(axis=1)).max())
    head = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("width", "cell", "grp")]
    return pa.Table.from_arrays([*head, pa.array([mid], pa.list_(pa.float64())), pa.array([reach]), pa.array([top])], names=[c.split()[0] for c in _GROUP.split(", ")])


_FOUND = "query_id long, vec_id long, score long, scored long"


def meet(k: int):
    """(queries of one task, one shard) -> their k best in it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")])
        if not len(left) or not len(right):
            return kind.empty_table()
        row = {c: right.column(c)[0].values for c in ("ids", "v", "centre", "radius", "norm", "kids_lo", "kids_hi", "lo", "hi", "leaf_order")}
        row = {c: x.to_numpy(zero_copy_only=False) for c, x in row.items()}
        tree = CoverTree(*[row[c] for c in ("centre", "radius", "norm", "kids_lo", "kids_hi", "lo", "hi", "leaf_order")])
        x = row["v"].reshape(len(row["ids"]), -1)
        a, b, s, scored = search(_matrix(left.column("v"), len(left)), left.column("id").to_numpy(), left.column("floor").to_pylist(), x, row["ids"], tree, k)
        s = np.array([max(_LEAST, min(_NO_ID, v)) for v in s], np.int64)
        counts = np.zeros(len(s), np.int64)
        counts[:1] = scored
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s), pa.array(counts)], schema=kind)

    return run


def visits(groups: DataFrame, shards: DataFrame, cells: dict[int, dict[int, tuple[np.ndarray | None, float, float]]]) -> DataFrame:
    """(width, cell, grp, to_cell, part): the shards that each query group still has to see.

    groups have the worst floor of their queries. Cells first (CELLS of them at most, part of the
    function), then the roots of the shards in the cells that are left, by an equality join.
    """

    def over_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], []]
            for i in range(b.num_rows):
                mid, reach, top, floor = np.array(b.column("mid")[i].as_py()), b.column("reach")[i].as_py(), b.column("top")[i].as_py(), b.column("worst")[i].as_py()
                for cell, (c, r, n) in cells.get(b.column("width")[i].as_py(), {}).items():
                    if c is not None and floor is not None:
                        most = bounds(mid @ c, np.sqrt(mid @ mid), reach, top, np.sqrt(c @ c), r, n, np.sqrt(((mid - c) ** 2).sum()))
                        if most < floor:
                            continue
                    out[0].append(i)
                    out[1].append(cell)
            at = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], pa.array(out[1], pa.int32())], names=[*b.schema.names, "to_cell"])

    kind = f"{_GROUP}, worst long"
    left = groups.select(*[c.split()[0] for c in kind.split(", ")]).mapInArrow(over_cells, f"{kind}, to_cell int")
    right = shards.select(F.col("width").alias("w2"), F.col("cell").alias("to_cell2"), "part", F.col("mid").alias("mid2"), F.col("reach").alias("reach2"), F.col("top").alias("top2"))
    t = left.join(right, (F.col("width") == F.col("w2")) & (F.col("to_cell") == F.col("to_cell2")))

    def over_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            if b.num_rows:
                reach, top, r2, t2 = (np.asarray(b.column(c)) for c in ("reach", "top", "reach2", "top2"))
                floor = np.array([-np.inf if f is None else float(f) for f in b.column("worst").to_pylist()])
                widths = np.asarray(b.column("width"))
                for w in np.unique(widths):
                    here = np.flatnonzero(widths == w)
                    part = b.take(pa.array(here))
                    a, c = _matrix(part.column("mid"), len(part)), _matrix(part.column("mid2"), len(part))
                    most = bounds((a * c).sum(axis=1), np.sqrt((a * a).sum(axis=1)), reach[here], top[here], np.sqrt((c * c).sum(axis=1)), r2[here], t2[here], np.sqrt(((a - c) ** 2).sum(axis=1)))
                    keep[here] = most >= floor[here]
            yield b.select(["width", "cell", "grp", "to_cell", "part"]).filter(pa.array(keep, pa.bool_()))

    return t.mapInArrow(over_shards, "width int, cell int, grp int, to_cell int, part int")


def search_table(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(query_id, vec_id, score, scored): candidates that hold each query's k best; scored counts the pairs scored by task, on one of its rows."""
    spark = vectors.sparkSession
    t = narrow(vectors, id=F.col(key).cast("long"), v=whole(F.col(vector), scale)).where("id is not null and v is not null").withColumn("width", F.size("v"))
    t = cut(t)
    n = t.count()
    sample = [r["v"] for r in t.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()]
    centres = choose_cells(sample, n, shard)
    homed = cut(homes(t, centres).withColumn("row", F.monotonically_increasing_id()))
    drop_cut(t)
    is_query = F.col("id") % every == 0
    # One row a cell, 2 * CELLS at most.
    stats = {r["cell"]: r for r in homed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    per_cell = lambda f: F.element_at(F.array(*[F.lit(f(stats[c]) if c in stats else 1) for c in range(2 * CELLS)]), F.col("cell") + 1)
    part_of = lambda h: F.pmod(h, per_cell(lambda s: max(1, -(-s["n"] // shard)))).cast("int")
    shards = cut(homed.withColumn("part", part_of(F.xxhash64("row", F.lit(7)))).groupBy("width", "cell", "part").applyInArrow(plant, _SHARD))
    tasks = max(1, -(-sum(s["q"] for s in stats.values()) // TASK))
    grp = F.pmod(F.xxhash64("id", F.lit(1)), per_cell(lambda s: max(1, -(-s["q"] // group)))).cast("int")
    asked = homed.where(is_query).dropDuplicates(["id", "v"]).withColumn("grp", grp)
    asked = cut(asked.select("id", "v", "width", "cell", "grp", part_of(F.xxhash64("cell", "grp")).alias("home"), F.pmod(F.xxhash64("cell", "grp", F.lit(3)), F.lit(tasks)).cast("int").alias("task")))
    groups = asked.groupBy("width", "cell", "grp").applyInArrow(query_node, _GROUP)

    def round_of(q: DataFrame) -> DataFrame:
        """q (id, v, width, to_cell, part, task, floor): each task's queries meet the shard they are sent to."""
        on = ["width", "to_cell", "part"]
        sent = q.select(*[F.col(c).alias(f"q_{c}") for c in (*on, "task")]).distinct()
        s = shards.join(sent, (F.col("width") == F.col("q_width")) & (F.col("cell") == F.col("q_to_cell")) & (F.col("part") == F.col("q_part"))).drop("width", "cell", "part")
        return q.groupBy(*on, "task").cogroup(s.groupBy("q_width", "q_to_cell", "q_part", "q_task")).applyInArrow(meet(k), _FOUND)

    first = cut(round_of(asked.select("id", "v", "width", F.col("cell").alias("to_cell"), F.col("home").alias("part"), "task", F.lit(None).cast("long").alias("floor"))))
    floors = first.groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").alias("floor")).where(F.col("m") >= k).select("query_id", "floor")
    asked2 = cut(asked.join(floors, F.col("id") == F.col("query_id"), "left").drop("query_id"))
    # The worst floor of a group; a query without one has to see everything.
    worst = asked2.groupBy("width", "cell", "grp").agg(F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("worst"), F.first("home").alias("home"))
    cells: dict[int, dict[int, tuple]] = {w: {c: (x, float(stats[c]["far"]), float(stats[c]["norm"])) for c, x in enumerate(xs) if c in stats} for w, xs in centres.items()}
    for r in homed.where(F.col("cell") >= CELLS).select("width", "cell").distinct().limit(CELLS).collect() if any(c >= CELLS for c in stats) else []:
        cells.setdefault(r["width"], {})[r["cell"]] = (None, np.inf, np.inf)
    nodes = groups.join(worst.withColumnRenamed("width", "w3").withColumnRenamed("cell", "c3").withColumnRenamed("grp", "g3"), (F.col("width") == F.col("w3")) & (F.col("cell") == F.col("c3")) & (F.col("grp") == F.col("g3")))
    left = visits(nodes, shards, cells).join(worst.select(F.col("width").alias("w3"), F.col("cell").alias("c3"), F.col("grp").alias("g3"), "home"), (F.col("width") == F.col("w3")) & (F.col("cell") == F.col("c3")) & (F.col("grp") == F.col("g3")))
    left = left.where(~((F.col("cell") == F.col("to_cell")) & (F.col("part") == F.col("home")))).select("width", "cell", "grp", "to_cell", "part")
    # From the table again, so that its columns are other ones than those that `left` came from.
    again = spark.read.schema(asked2.schema).parquet(asked2._loomvec_path).drop("home")
    rest = round_of(again.join(left, ["width", "cell", "grp"]).select("id", "v", "width", "to_cell", "part", "task", "floor"))
    return first.unionByName(rest)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose key is divisible by `every`, the k best other rows.

    Rows whose key or vector is null, whose vector is empty or holds a null or a component that isn't
    finite, take no part. Rows of one key are rows of their own; a query of that key leaves all of
    them out, and repeated queries are asked once. Vectors of unlike lengths don't meet. Equal scores
    go to the smaller key. Sums are exact; a component or score that a long can't hold is its nearest
    long (components: 2**62). An empty table gives an empty table; other columns are ignored.
    """
    found = search_table(vectors, key, vector, k, every, scale, shard, group)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with v as (
  select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(c.v) + 1)])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, n::int as rank, vec_id, score from r where n <= 10
"""
