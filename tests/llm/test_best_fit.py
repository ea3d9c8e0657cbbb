"""The first packing of all items, and that levels never make more sequences of it."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.llm import packing as P


def plain_best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            r, i = min(fits)
            room[i] -= n
        else:
            room.append(size - n)
    return len(room)


@pytest.mark.parametrize(("seed", "size", "n"), [(0, 50, 400), (1, 20, 300), (2, 2048, 900), (3, 7, 200), (4, 100, 1)])
def test_runs_are_a_best_fit(seed, size, n):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, size, n).tolist() if size > 7 else rng.integers(1, 4, n).tolist()
    runs = P.best_fit_runs(Counter(lengths), size)
    fill = defaultdict(int)
    by_length = defaultdict(list)
    for r in runs:
        by_length[r[0]].append(r)
    for x, count in Counter(lengths).items():
        own = sorted(by_length[x], key=lambda r: r[1])
        for rank in range(count):
            _, start, per, first = [r for r in own if r[1] <= rank][-1]
            fill[first + (rank - start) // per] += x
    assert max(fill.values()) <= size and len(fill) == plain_best_fit(lengths, size)


def test_items_find_their_bins_and_levels_keep_the_number(spark):
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(200, 1100, 700), np.full(500, 333)])
    t = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "row long, piece int, length long").repartition(5)
    bins = P.best_fit_bins(t, 2048)
    fill = bins.groupBy("bin").agg(F.sum("length").alias("n")).toPandas()
    assert bins.count() == 1200 and fill.n.max() <= 2048 and len(fill) == plain_best_fit(lengths.tolist(), 2048)
    level = P.pack_level(bins, 7, 2048, 0).toPandas()
    again = level.groupby(["block", "bin"]).length.sum()
    assert sorted(level.row) == list(range(1200)) and again.max() <= 2048 and len(again) <= len(fill)
