"""Exact substring deduplication with a logarithmic family of suffix arrays.

Every byte that a string of LONG bytes covers which also starts elsewhere is found in four steps.

1. Each window of LONG bytes has one anchor: of the KGRAM-byte grams in it, the leftmost with the
   least hash. Equal windows have equal anchors, at the same distance, so only suffixes at anchors
   need to be sorted: about one in 85.
2. Anchors meet by the hash of their gram. Where all bytes around two anchors (up to BEFORE in front,
   LONG behind) have equal digests, both are covered whole. Repeats within one batch are settled
   before the shuffle, so a passage in a third of all documents sends one row a batch.
3. Only where anchors of one gram differ around it are their bytes fetched. They go to shards of the
   suffix space; each batch that a shard reads gets a suffix array, is merge-scanned against the
   levels that are there, and equal-sized levels merge, as in a logarithmic index.
4. The covered ranges of each document are joined to its text.

A scan compares bytes, not hashes: the suffix array of what stands behind the anchors, that of what
stands in front (reversed), and the common prefixes of neighbours give for each distance of a window's
start the classes of equal halves; a window repeats if another anchor has both its classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_spans, cut, narrow, pieces, read_table

LONG, KGRAM = 200, 32
#: Most bytes in front of an anchor within a window, and the number of places of an anchor in one.
BEFORE = LONG - KGRAM
PLACES = BEFORE + 1
#: Bytes worked on at a time, and the margin around a part of a longer text.
PART, MARGIN = 2 << 20, 512
#: Rows of a new level of the family.
LEVEL = 1 << 15

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_table: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_table.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        _table["up"], _table["down"] = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _table["up"][:n], _table["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of every window: of blocks of this width, the end of one and the beginning of the next."""
    n = len(key)
    blocks = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    blocks[:n] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """Anchors in raw[lo:hi] of the texts raw[begin:end] that begin and end there or reach beyond.

    raw may be a part of a longer text, with MARGIN bytes on each side; begin and end then lie
    outside. Returns text number, place, bytes in front, bytes behind, gram hash, digest of all these bytes.
    """
    n = len(raw)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < LONG:
        return none
    up, down = powers(n + 1)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=upto[1:])
    gram = mixed((upto[KGRAM:] - upto[:-KGRAM]) * down[: n - KGRAM + 1])
    low = np.uint64(0xFFFFFF)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    at = (window_least(key, PLACES) & low).astype(np.int64)
    inside = np.zeros(n + 2, np.int32)
    first, last = np.maximum(begin, 0), np.minimum(end, n) - LONG
    some = last >= first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some] + 1, -1)
    at = at[np.cumsum(inside)[: len(at)] > 0]
    if not len(at):
        return none
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    at = at[(at >= lo) & (at < hi)]
    text = np.searchsorted(begin, at, side="right") - 1
    front, back = np.minimum(BEFORE, at - begin[text]), np.minimum(LONG, end[text] - at)
    digest = (upto[at + back] - upto[at - front]) * down[at - front]
    digest = mixed(digest ^ ((front.astype(np.uint64) << np.uint64(48)) | (back.astype(np.uint64) << np.uint64(56))))
    return text, at, front, back, gram[at], digest


#: A row of step 2 packs where an anchor is, what surrounds it, and whether others like it were seen: place << 17 | front << 9 | back << 1 | seen.
#: A negative one is a covered range: ~(start << 31 | length).


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the same row that touch or overlap become one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Running maximum of the ends within a row: ends are shifted apart by row.
    rank = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])])
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * wide) - rank * wide
    head = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(head)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1]


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], names=list(columns))


def _ranges(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    row, start, end = joined(row, start, end)
    return {"gram": mixed(row.astype(np.uint64)), "digest": np.zeros(len(row), np.uint64), "row": row, "packed": ~((start << 31) | (end - start))}


_STEP = "gram long, digest long, row long, packed long"


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, payload<doc_id, text>) -> anchors, one of those that are alike within a part, and ranges that are covered already."""
    for batch in batches:
        raw_all, offsets = byte_spans(batch.column(1).field("text"))
        rows = np.asarray(batch.column(0))
        for first, last in pieces(offsets, PART):
            base, n = int(offsets[first]), int(offsets[last] - offsets[first])
            begin, end = offsets[first:last] - base, offsets[first + 1 : last + 1] - base
            for lo in range(0, max(n, 1), 2 * PART):  # a single long text comes in parts
                hi = min(n, lo + 2 * PART)
                left, right = max(0, lo - MARGIN), min(n, hi + MARGIN)
                text, at, front, back, gram, digest = anchors(raw_all[base + left : base + right], begin - left, end - left, lo - left, hi - left)
                if not len(at):
                    continue
                row, at = rows[first:last][text], at + left
                order = np.lexsort((digest, gram))
                row, at, front, back, gram, digest = (x[order] for x in (row, at - begin[text], front, back, gram, digest))
                same = (gram[1:] == gram[:-1]) & (digest[1:] == digest[:-1])
                head, more = np.concatenate([[True], ~same]), np.concatenate([same, [False]])
                seen = more | ~head
                if seen.any():
                    yield _batch(_ranges(row[seen], (at - front)[seen], (at + back)[seen]))
                packed = (at << 17) | (front << 9) | (back << 1) | more
                yield _batch({"gram": gram[head], "digest": digest[head], "row": row[head], "packed": packed[head]})


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return p >> 17, (p >> 9) & 255, (p >> 1) & 255, (p & 1).astype(bool)


_FOUND = "row long, start int, end int, front int, back int, ask boolean"


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _STEP, sorted by gram and digest -> covered ranges (ask null) and anchors whose bytes are wanted (ask: whether they want an answer, or only serve others).

    Holds one row of the group that a batch ends in, whatever its size.
    """
    carry: tuple | None = None  # gram, digest, row, packed of one row; whether its gram had other digests before

    def asked(row: np.ndarray, packed: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
        at, front, back, _ = unpacked(packed)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at.astype(np.int32)), pa.array((at + 1).astype(np.int32)), pa.array(front.astype(np.int32)), pa.array(back.astype(np.int32)), pa.array(~covered)], names=["row", "start", "end", "front", "back", "ask"])

    def ranges(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        row, start, end = joined(row, start, end)
        zero = pa.array(np.zeros(len(row), np.int32))
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), zero, zero, pa.nulls(len(row), pa.bool_())], names=["row", "start", "end", "front", "back", "ask"])

    for batch in batches:
        gram, digest, row, packed = (np.asarray(batch.column(i)) for i in range(4))
        done = packed < 0
        if done.any():
            x = ~packed[done]
            yield ranges(row[done], x >> 31, (x >> 31) + (x & ((1 << 31) - 1)))
            gram, digest, row, packed = (c[~done] for c in (gram, digest, row, packed))
        if not len(gram):
            continue
        opened = False
        if carry is not None:
            opened = carry[4] and carry[0] == gram[0]
            if carry[0] != gram[0] and carry[4]:
                yield asked(*(np.array([v]) for v in (carry[2], carry[3])), np.array([bool(carry[3] & 1)]))
                carry = None
            if carry is not None:
                gram, digest, row, packed = (np.concatenate([[v], c]) for v, c in zip(carry[:4], (gram, digest, row, packed), strict=True))
        head = np.concatenate([[True], (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])])
        runs = np.flatnonzero(head)
        size = np.diff(np.append(runs, len(gram)))
        at, front, back, seen = unpacked(packed)
        covered = (size > 1) | np.logical_or.reduceat(seen, runs)
        every = np.repeat(size > 1, size)
        if every.any():
            yield ranges(row[every], (at - front)[every], (at + back)[every])
        # Grams with several digests: the first row of each run is asked for. The last run may go on.
        g = gram[runs]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        group = np.cumsum(new) - 1
        several = np.bincount(group) > 1
        if opened:
            several[0] = True
        wanted = several[group]
        wanted[-1] = False
        if wanted.any():
            yield asked(row[runs[wanted]], packed[runs[wanted]], covered[wanted])
        last = runs[-1]
        carry = (gram[last], digest[last], row[last], packed[last] | int(covered[-1]), bool(several[group[-1]]))
    if carry is not None and carry[4]:
        yield asked(*(np.array([v]) for v in (carry[2], carry[3])), np.array([bool(carry[3] & 1)]))


_BYTES = "gram long, row long, start int, ask boolean, front binary, back binary"


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, payload, wanted array<struct<start, front, back, ask>>) -> the bytes around each wanted anchor; those in front reversed."""
    for batch in batches:
        raw, offsets = byte_spans(batch.column(1).field("text"))
        rows = np.asarray(batch.column(0))
        out: list[list] = [[] for _ in range(6)]
        for i, wanted in enumerate(batch.column(2)):
            text = raw[offsets[i] : offsets[i + 1]].tobytes()
            for w in wanted.as_py():
                s, f, b = w["start"], w["front"], w["back"]
                behind = text[s : s + b]
                gram = int.from_bytes(hashlib.blake2b(behind[:KGRAM], digest_size=8).digest(), "little", signed=True)
                for c, v in zip(out, (gram, int(rows[i]), s, w["ask"], text[s - f : s][::-1], behind), strict=True):
                    c.append(v)
            if sum(map(len, out[5])) > PART:
                yield _bytes_batch(out)
                out = [[] for _ in range(6)]
        if out[0]:
            yield _bytes_batch(out)


def _bytes_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _BYTES.split(", ")])


def _order(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array of rows of bytes: by bytes, a shorter row before what it begins."""
    return np.lexsort((size, np.unique(text, return_inverse=True)[1])) if len(text) else np.zeros(0, np.int64)


def _common(text: np.ndarray, size: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Common prefix of each row and the one before it in the order; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for lo in range(1, len(order), 16_384):
        a, b = order[lo - 1 : lo + 16_383], order[lo : lo + 16_384]
        a = a[: len(b)]
        x = text[a].view(np.uint8).reshape(len(a), -1)[:, :width] != text[b].view(np.uint8).reshape(len(b), -1)[:, :width]
        same = np.where(x.any(axis=1), x.argmax(axis=1), width)
        out[lo : lo + len(b)] = np.minimum(same, np.minimum(size[a], size[b]))
    return out


class Level:
    """Anchored suffixes with the array that sorts them; `least` and `most` are the nearest and farthest window starts found to repeat."""

    def __init__(self, front: np.ndarray, n_front: np.ndarray, back: np.ndarray, n_back: np.ndarray, order: np.ndarray | None = None) -> None:
        self.front, self.n_front, self.back, self.n_back = front, n_front, back, n_back
        self.order = _order(back, n_back) if order is None else order
        self.least = np.full(len(back), LONG)
        self.most = np.full(len(back), -1)

    def __len__(self) -> int:
        return len(self.back)

    @staticmethod
    def merged(a: Level, b: Level) -> Level:
        """One level of two: the sorted suffixes are merged."""
        parts = [np.concatenate([getattr(a, k), getattr(b, k)]) for k in ("front", "n_front", "back", "n_back")]
        left, right = a.back[a.order], b.back[b.order]
        place = np.concatenate([np.arange(len(left)) + np.searchsorted(right, left, side="left"), np.arange(len(right)) + np.searchsorted(left, right, side="right")])
        order = np.empty(len(place), np.int64)
        order[place] = np.concatenate([a.order, b.order + len(a)])
        out = Level(*parts, order=order)
        out.least, out.most = (np.concatenate([getattr(a, k), getattr(b, k)]) for k in ("least", "most"))
        # Equal bytes of unlike length are put in order of length, as _order() does.
        same = out.back[order]
        ties = np.flatnonzero(same[1:] == same[:-1])
        if len(ties):
            rank = np.concatenate([[0], np.cumsum(same[1:] != same[:-1])])
            out.order = order[np.lexsort((out.n_back[order], rank))]
        return out


def scan(level: Level) -> None:
    """Marks the windows of a level that repeat in it."""
    n = len(level)
    if n < 2:
        return
    by_back, by_front = level.order, _order(level.front, level.n_front)
    lcp_back, lcp_front = _common(level.back, level.n_back, by_back, LONG), _common(level.front, level.n_front, by_front, BEFORE)

    def best(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        return out

    most, least = best(by_front, lcp_front), LONG - best(by_back, lcp_back)  # window starts that could repeat: least..most bytes in front
    some = np.flatnonzero(least <= most)
    if len(some) < 2:
        return
    class_back, class_front = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(max(0, int(least[some].min())), min(BEFORE, int(most[some].max())) + 1):
        here = some[(least[some] <= d) & (d <= most[some])]
        if len(here) < 2:
            continue
        class_back[by_back] = np.cumsum(lcp_back < LONG - d)
        class_front[by_front] = np.cumsum(lcp_front < d)
        key = class_back[here] * (n + 1) + class_front[here]
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        hit = here[order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]]
        level.least[hit] = np.minimum(level.least[hit], d)
        level.most[hit] = np.maximum(level.most[hit], d)


class Family:
    """A logarithmic family of levels: a new batch is scanned in itself and against every level, then equal-sized levels merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, Level, np.ndarray]] = []

    def add(self, batch: Level, ids: np.ndarray) -> None:
        """ids are the caller's numbers of the batch's rows."""
        scan(batch)
        for _, level, _ in self.levels:
            both = Level.merged(level, batch)
            scan(both)
            for part, at in ((level, slice(0, len(level))), (batch, slice(len(level), None))):
                part.least, part.most = np.minimum(part.least, both.least[at]), np.maximum(part.most, both.most[at])
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, level, known = self.levels.pop()
            batch, ids = Level.merged(level, batch), np.concatenate([known, ids])
            rank += 1
        self.levels.append((rank, batch, ids))


_RANGE = "row long, start int, end int"


def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _BYTES of one shard -> the covered ranges around the anchors that ask."""
    family, row, start, ask = Family(), [], [], []
    held: list[pa.RecordBatch] = []
    count = 0

    def close() -> None:
        nonlocal held, count
        t = pa.Table.from_batches(held)
        base = sum(map(len, row))
        row.append(t.column(1).to_numpy())
        start.append(t.column(2).to_numpy())
        ask.append(t.column(3).to_numpy(zero_copy_only=False).astype(bool))
        fixed = []
        for i, width in ((4, BEFORE), (5, LONG)):
            raw, at = byte_spans(t.column(i))
            size = np.diff(at)
            m = np.zeros((len(size), width), np.uint8)
            m[np.arange(width) < size[:, None]] = raw
            fixed += [np.ascontiguousarray(m).view(f"S{width}").ravel(), size]
        family.add(Level(*fixed), np.arange(base, base + len(t)))
        held, count = [], 0

    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= LEVEL:
            close()
    if count:
        close()
    if not row:
        return
    all_row, all_start, all_ask = map(np.concatenate, (row, start, ask))
    for _, level, ids in family.levels:
        hit = (level.most >= 0) & all_ask[ids]
        r, s, e = joined(all_row[ids][hit], (all_start[ids] - level.most)[hit], (all_start[ids] + LONG - level.least)[hit])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["row", "start", "end"])


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, payload, ranges) -> the contract's columns, and the kept bytes' lengths that they follow from."""
    for batch in batches:
        raw, offsets = byte_spans(batch.column(1).field("text"))
        out: list[list] = [[] for _ in range(4)]
        for i, ranges in enumerate(batch.column(2)):
            text = raw[offsets[i] : offsets[i + 1]]
            found = ranges.as_py() or []
            s, e = np.array([x["start"] for x in found], np.int64), np.array([x["end"] for x in found], np.int64)
            _, s, e = joined(np.zeros(len(s), np.int64), s, e)
            keep = hashlib.sha256()
            at = 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                keep.update(text[at:a])
                at = b
            keep.update(text[at:])
            for c, v in zip(out, (len(text), int((e - s).sum()), len(s), keep.hexdigest()), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(1).field("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def covered(table: DataFrame, t: DataFrame) -> DataFrame:
    """(row, payload<doc_id, text>), as it lies and dealt out by row -> (row, start, end) of covered ranges that may overlap."""
    met = cut(table.mapInArrow(find_anchors, _STEP).repartition("gram").sortWithinPartitions("gram", "digest").mapInArrow(meet, _FOUND))
    wanted = met.where("ask is not null").groupBy("row").agg(F.collect_list(F.struct("start", "front", "back", "ask")).alias("wanted"))
    fetched = t.join(wanted, "row").mapInArrow(fetch, _BYTES)
    sorted_ = fetched.repartition("gram").mapInArrow(sort_shard, _RANGE)
    return met.where("ask is null").select("row", "start", "end").unionByName(sorted_)


def with_rows(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(row, payload) as a table, and the same dealt out by row for the joins."""
    t = narrow(docs, row=F.monotonically_increasing_id(), doc_id=F.col(doc_id).cast("long"), text=F.coalesce(F.col(text), F.lit("")).cast("binary"))
    t = cut(t)  # row numbers are fixed from here on
    # One struct, and the filter that an inner join would add, so that both joins read one and the same exchange.
    t = t.where("row is not null").select("row", F.struct("doc_id", "text").alias("payload"))
    return t, t.repartition("row")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; texts under LONG bytes are never touched; repeated rows are elsewhere to
    each other and removed whole if long enough. An empty table gives an empty table; other columns
    of docs are ignored.
    """
    table, t = with_rows(docs, doc_id, text)
    ranges = covered(table, t)
    by_row = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return t.join(by_row, "row", "left").select("row", "payload", "ranges").mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end>>, kept binary): the removed byte ranges and what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = byte_spans(batch.column(1).field("text"))
            spans, kept = [], []
            for i, ranges in enumerate(batch.column(2)):
                body = raw[offsets[i] : offsets[i + 1]]
                found = ranges.as_py() or []
                _, s, e = joined(np.zeros(len(found), np.int64), np.array([x["start"] for x in found], np.int64), np.array([x["end"] for x in found], np.int64))
                mask = np.ones(len(body), bool)
                for a, b in zip(s, e, strict=True):
                    mask[a:b] = False
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)])
                kept.append(body[mask].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(1).field("doc_id"), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])

    table, t = with_rows(docs, doc_id, text)
    ranges = covered(table, t)
    by_row = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return t.join(by_row, "row", "left").select("row", "payload", "ranges").mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))
