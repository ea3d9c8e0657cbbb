"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenized and cut; full pieces are sequences of their own, the rest are items. A first
packing of all items is best fit in the order of falling lengths, which follows from the number of items
of each length alone: the driver works out where runs of equal items go, items find their places by
their ranks. Its sequences are dealt to blocks of a few thousand items by a hash. For each block several
islands evolve packings from it: a crossover injects whole well-filled sequences of one parent into another, drops the sequences that
hold a duplicate, and puts the documents that lost their place where they fill best: first by exchange
for smaller ones, then by best fit. After an epoch the best packing of each island moves to its
neighbour, and a second epoch starts from it. An island whose packing meets the lower bound is done:
no packing has fewer sequences. Sequences that aren't filled move on whole to fewer blocks, where
evolution goes on from them, for a few levels. No step makes more sequences than it was given, so there
are never more than by best fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, narrow, read_table
from .tokens import encoder, paths

SIZE = 2048
#: Items to a block, islands to a block, packings to an island, generations to an epoch.
BLOCK, ISLANDS, POPULATION, GENERATIONS = 4096, 3, 5, 16
#: Bins of up to so many items are also searched for two items to exchange for one.
PAIRS = 8
#: A sequence that is filled to this share stays, by level; the others move on to the next one. Full ones only at first: what
#: they would waste is better spent among the loose ends of all blocks. The last share is also what a crossover calls well filled.
WELL = (1.0, 0.9995, 0.985)
#: Levels at most.
LEVELS = 6
#: Parts of a length's items that are ranked on their own.
SLICES = 64
#: What ends a document.
END = 0


def cut_points(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than size."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): every document's ids and an end id, cut to at most size."""
    files = tokenizer or paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(*files)
        for batch in batches:
            rows, cols = [], [[], [], [], []]
            for i, t in enumerate(batch.column(2)):
                ids = np.append(code.encode(t.as_py()), np.uint32(END)).astype("<u4")
                for j, (s, n) in enumerate(cut_points(len(ids), size)):
                    rows.append(i)
                    for c, v in zip(cols, (j, s, n, zlib.crc32(ids[s : s + n].tobytes())), strict=True):
                        c.append(v)
            at = pa.array(rows, pa.int32())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    t = narrow(docs, row=F.monotonically_increasing_id(), doc_id=F.col(doc_id).cast("long"), text=text)
    return t.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers over shared lengths."""

    def __init__(self, lengths: list[int], size: int, bins: list[list[int]]) -> None:
        self.lengths, self.size, self.bins = lengths, size, bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]

    def best_fit(self, items: list[int]) -> None:
        """Puts each item, in this order, where it leaves the least room; a new bin if there is none."""
        by_room: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(self.fill):
            room = self.size - f
            if room:
                by_room.setdefault(room, []).append(b)
                mask |= 1 << room
        for i in items:
            n = self.lengths[i]
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
                self.bins[b].append(i)
                self.fill[b] += n
            else:
                b, room = len(self.bins), self.size
                self.bins.append([i])
                self.fill.append(n)
            left = room - n
            if left:
                by_room.setdefault(left, []).append(b)
                mask |= 1 << left

    def replaced(self, free: list[int], rounds: int = 2) -> list[int]:
        """Fills bins by exchange: an item of a bin goes for a longer free one that still fits, or two items for one. Returns what is free then: the same tokens less, in smaller items."""
        at = sorted((self.lengths[i], i) for i in free)
        for _ in range(rounds):
            moved = False
            for b, items in enumerate(self.bins):
                room = self.size - self.fill[b]
                if not room or not at:
                    continue
                best = None  # (tokens gained, place in at, items that leave)
                pairs = [(items[j], items[k]) for j in range(len(items)) for k in range(j)] if len(items) <= PAIRS else []
                for out in [(i,) for i in items] + pairs:
                    have = sum(self.lengths[i] for i in out)
                    k = bisect_right(at, (have + room, 1 << 60)) - 1
                    gain = at[k][0] - have if k >= 0 else 0
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, k, out)
                        if gain == room:
                            break
                if best:
                    gain, k, out = best
                    _, i = at.pop(k)
                    self.bins[b] = [x for x in items if x not in out] + [i]
                    self.fill[b] += gain
                    for x in out:
                        insort(at, (self.lengths[x], x))
                    moved = True
            if not moved:
                break
        return [i for _, i in at]

    @property
    def cost(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: room gathered in few bins is room that another item fits in."""
        return len(self.bins), -sum((f / self.size) ** 2 for f in self.fill)

    def crossed(self, other: Packing, rng: np.random.Generator) -> Packing:
        """A child: some of the other's well-filled bins whole, then what of mine doesn't clash, then best fit."""
        well = [b for b, f in enumerate(other.fill) if f >= WELL[-1] * self.size]
        chosen = [b for b in well if rng.random() < 0.5]
        taken = {i for b in chosen for i in other.bins[b]}
        bins, displaced = [list(other.bins[b]) for b in chosen], []
        for b in self.bins:
            if taken.isdisjoint(b):
                bins.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        child = Packing(self.lengths, self.size, bins)
        child.best_fit(sorted(child.replaced(displaced), key=lambda i: (-self.lengths[i], i)))
        return child

    def shaken(self, rng: np.random.Generator) -> Packing:
        """A mutant: the worst bins and a few others are emptied and packed anew."""
        order = sorted(range(len(self.bins)), key=lambda b: self.fill[b])
        out = set(order[: max(2, len(order) // 50)]) | {int(b) for b in rng.integers(0, len(order), max(2, len(order) // 20))}
        loose = [i for b in out for i in self.bins[b]]
        child = Packing(self.lengths, self.size, [list(b) for k, b in enumerate(self.bins) if k not in out])
        child.best_fit(sorted(child.replaced(loose), key=lambda i: (-self.lengths[i] * (1 + 0.1 * rng.random()), i)))
        return child


def evolve(lengths: list[int], size: int, seed: int, elites: list[list[int]]) -> Packing:
    """One epoch of one island. elites: packings to start from, each as the bin of every item. Lengths fall."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // size)
    population = []
    for e in elites:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(e):
            bins.setdefault(b, []).append(i)
        population.append(Packing(lengths, size, list(bins.values())))
    noise = 0.0
    while len(population) < POPULATION:
        if population and min(population, key=lambda p: p.cost).cost[0] <= least:
            break
        p = Packing(lengths, size, [])
        p.best_fit(sorted(range(len(lengths)), key=lambda i: (-lengths[i] * (1 + noise * rng.random()), i)))
        population.append(p)
        noise += 0.05
    for _ in range(GENERATIONS):
        population.sort(key=lambda p: p.cost)
        if population[0].cost[0] <= least:
            break
        a, b = rng.integers(0, len(population), 2)
        child = population[a].crossed(population[b], rng) if a != b else population[a].shaken(rng)
        if rng.random() < 0.3:
            child = child.shaken(rng)
        if child.cost < population[-1].cost:
            population[-1] = child
    return min(population, key=lambda p: p.cost)


def genome(p: Packing) -> list[int]:
    out = [0] * len(p.lengths)
    for b, items in enumerate(p.bins):
        for i in items:
            out[i] = b
    return out


_GENOME = "block long, island int, genome array<int>, n_bins int"


def best_fit_runs(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, per bin, first bin): runs of equal items in a best fit by falling lengths; counts: length -> items.

    Items of a length go `per bin` at a time, in the order of their ranks, to bins counted on from the first.
    """
    out: list[tuple[int, int, int, int]] = []
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # room -> (first bin, bins)
    bins = 0
    for n in sorted(counts, reverse=True):
        left, rank, room = counts[n], 0, n
        while left:
            while room < size and not rooms[room]:
                room += 1
            first, many = rooms[room].pop() if room < size else (bins, -(-left // (size // n)))
            per = min(room // n, left)
            used = min(many, left // per)
            out.append((n, rank, per, first))
            if room == size:
                bins += used
            elif used < many:
                rooms[room].append((first + used, many - used))
            rooms[room - per * n].append((first, used))
            rank, left = rank + per * used, left - per * used
    return out


def best_fit_bins(items: DataFrame, size: int) -> DataFrame:
    """items (row, piece, length) with the bin of each in a best fit of all of them."""
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer rows than a sequence has tokens
    runs = items.sparkSession.createDataFrame(best_fit_runs(counts, size), "length2 long, rank long, per long, first long")
    # One row a length again, with its runs in the order of ranks.
    runs = runs.groupBy("length2").agg(F.array_sort(F.collect_list(F.struct("rank", "per", "first"))).alias("runs"))
    t = items.withColumn("slice", F.pmod(F.xxhash64("row", "piece"), F.lit(SLICES)))
    sizes = t.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("slice")) - F.col("n")
    # A length that very many items have is joined slice by slice, as it is ranked.
    sizes = sizes.select(F.col("length").alias("length3"), F.col("slice").alias("slice3"), before.alias("before")).join(runs, F.col("length3") == F.col("length2"))
    t = t.withColumn("own", F.row_number().over(W.partitionBy("length", "slice").orderBy("row", "piece")) - 1)
    t = t.join(sizes, (F.col("length") == F.col("length3")) & (F.col("slice") == F.col("slice3"))).withColumn("rank", F.col("own") + F.col("before"))
    run = F.element_at("runs", F.size(F.filter("runs", lambda r: r["rank"] <= F.col("rank"))))
    return t.withColumn("run", run).select("row", "piece", "length", (F.col("run.first") + F.floor((F.col("rank") - F.col("run.rank")) / F.col("run.per"))).cast("long").alias("bin"))


def pack_level(items: DataFrame, n_blocks: int, size: int, level: int) -> DataFrame:
    """items (row, piece, length, bin) -> (row, piece, length, block, bin, place, fill): one level of packing, from the bins that they are in."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(n_blocks)))
    # A block is one row; its size is bounded, for bins are dealt by a hash and hold a sequence's tokens at most.
    blocks = cut(dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("minus"), "row", "piece", "bin"))).alias("items")))
    tasks = blocks.select("block", F.transform("items", lambda x: -x["minus"]).alias("lengths"), F.array(F.transform("items", lambda x: x["bin"])).alias("elites"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))

    def epoch(number: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for r in f.itertuples(index=False):
                    start = [list(g) for g in r.elites]
                    lengths = [int(n) for n in r.lengths]
                    best = evolve(lengths, size, hash((int(r.block), int(r.island), number, level)) & 0x7FFFFFFF, start)
                    rows.append((r.block, r.island, genome(best), len(best.bins)))
                yield pd.DataFrame(rows, columns=["block", "island", "genome", "n_bins"])

        return run

    first = tasks.repartition("block", "island").mapInPandas(epoch(1), _GENOME)
    first = cut(first)
    # Blocks where no island has met the bound go on; each island gets its own and its neighbour's elite.
    least = F.ceil(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x) / size)
    open_ = first.groupBy("block").agg(F.min("n_bins").alias("found")).join(blocks.select("block", F.transform("items", lambda x: -x["minus"]).alias("lengths")), "block").where(F.col("found") > least).select("block", "lengths")
    moved = first.select("block", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)).alias("island"), "genome").groupBy("block", "island").agg(F.collect_list("genome").alias("elites"))
    second = open_.join(moved, "block").repartition("block", "island").mapInPandas(epoch(2), _GENOME)
    best = first.unionByName(second).groupBy("block").agg(F.min_by("genome", F.struct("n_bins", "island")).alias("genome"))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                bins = np.asarray(r.genome)
                lengths = np.array([-x["minus"] for x in r.items], np.int64)
                order = np.argsort(bins, kind="stable")
                b, n = bins[order], lengths[order]
                ends = np.cumsum(n)
                head = np.concatenate([[True], b[1:] != b[:-1]])
                base = (ends - n)[head]
                which = np.cumsum(head) - 1
                fill = np.add.reduceat(n, np.flatnonzero(head))
                yield pd.DataFrame({"row": np.array([x["row"] for x in r.items])[order], "piece": np.array([x["piece"] for x in r.items])[order], "length": n, "block": r.block, "bin": b, "place": ends - n - base[which], "fill": fill[which]})

    return blocks.join(best, "block").mapInPandas(spread, "row long, piece int, length long, block long, bin int, place long, fill long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, block: int = BLOCK, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone, one token. Repeated rows and pieces of equal length are
    packed each; among those, order is that of their row numbers. A null doc_id stays null. An empty
    table gives an empty table; other columns of docs are ignored. Texts of any length are cut, so
    that no item is longer than a sequence. Runs are repeatable for the same partitions of docs.
    """
    pieces = cut(pieces_of(docs, doc_id, text, size, tokenizer))
    full = pieces.where(F.col("length") == size).select("row", "piece", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [full]
    items = pieces.where(F.col("length") < size).select("row", "piece", "length")
    count = items.count()
    items = cut(best_fit_bins(items, size)) if count else items
    for level in range(LEVELS):
        if not count:
            break
        n_blocks = max(1, -(-count // block))
        packed = cut(pack_level(items, n_blocks, size, level))
        number = (F.lit(level << 55) + F.col("block") * (1 << 20) + F.col("bin")) * 2 + 1
        last = n_blocks == 1 or level == LEVELS - 1
        stays = F.lit(True) if last else F.col("fill") >= F.lit(WELL[min(level, len(WELL) - 1)] * size)
        placed.append(packed.where(stays).select("row", "piece", number.alias("sequence_id"), F.col("place").alias("offset")))
        if last:
            break
        items = packed.where(~stays).select("row", "piece", "length", number.alias("bin"))
        count = items.count()
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    return pieces.join(where, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
