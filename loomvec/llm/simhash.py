"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most two
bits have a segment in which they differ in at most one, so they share one of its variants: the
segment with one bit deleted, and the bit's place. All 64 variants of every distinct fingerprint are
indexed and equal variants meet.

What meets agrees in 31 bits, and a link may differ in the deleted bit and up to two bits of the other
segment. So each fingerprint that meets any is verified by looking up the whole fingerprints that such
differences allow among those that it meets; the work is linear in the group, however many near copies
it holds, and no pairs are made. Links leave a task as a forest: components need no more.

Rows with equal fingerprints are one fingerprint, so large groups of copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_spans, cut, drop_cut, narrow, private, read_table
from .components import components

#: Bits that may differ; the segments follow from it.
REACH = 2
SEGMENT = 32
WORDS = 3
SEED = 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def fingerprint_many(raw: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Fingerprints (uint64) of texts given as bytes and offsets, over shingles of `size` words."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(out)):
        low = _LOWER[raw[offsets[i] : offsets[i + 1]]]
        if not len(low):
            continue
        low[_IS_SPACE[low]] = 32
        words = [w for w in low.tobytes().split(b" ") if w]
        if not words:
            continue
        n = max(1, len(words) - size + 1)
        ones = np.zeros(64, np.int64)
        for lo in range(0, n, 65_536):
            part = words[lo : lo + 65_536 + size - 1]
            if len(words) < size:
                hashes = [digest(b" ".join(words), SEED)]
            else:
                hashes = [digest(b" ".join(x), SEED) for x in zip(*[part[j:] for j in range(size)], strict=False)]
            h = np.array(hashes, np.uint64)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        bits = (2 * ones > n).astype(np.uint8)
        out[i] = np.packbits(bits).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, words: int = WORDS) -> DataFrame:
    """(doc_id, row, fp): the fingerprint as a signed long; null, empty and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = byte_spans(b.column(2))
            fp = fingerprint_many(raw, at, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "row", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    t = narrow(docs, doc_id=doc_id, row=F.col(row) if row else F.monotonically_increasing_id(), text=text)
    return t.mapInArrow(run, f"doc_id {kind}, row long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(seg, bit, rest, fp) for every segment and deleted bit of distinct fingerprints."""
    places = F.array(*[F.struct(F.lit(s).cast("byte").alias("seg"), F.lit(b).cast("byte").alias("bit"), F.shiftrightunsigned("fp", s * SEGMENT).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b))).alias("rest")) for s in range(64 // SEGMENT) for b in range(SEGMENT)])
    return fps.select("fp", F.explode(places).alias("v")).select("v.seg", "v.bit", "v.rest", "fp")


_ONE = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components, at most one less than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def _look_up(fp: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, x ^ mask) that both are in fp, sorted; as a forest."""
    left, right = [], []
    for m in masks:
        other = fp ^ m
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        hit = (fp[at] == other) & (fp < other)
        if hit.any():
            left.append(fp[hit])
            right.append(other[hit])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(left), np.concatenate(right))


def group_links(seg: int, bit: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that belong to the groups of one segment and deleted bit: those that differ in the deleted bit, and, where
    it is bit 0, those that don't differ in the segment. Other links of a group belong to another of its variants. A link
    changes nothing that a group's fingerprints agree in, so many groups can be looked up in one sorted array."""
    fp = np.sort(fp)
    own = _ONE[seg * SEGMENT + bit]
    other = _ONE[[i for i in range(64) if i // SEGMENT != seg]]
    masks = [own, *(own | o for o in other)]
    if bit == 0:
        masks += [*other, *(other[i] | other[j] for i in range(len(other)) for j in range(i))]
    return _look_up(fp, np.array(masks, np.uint64))


def met_links(seg: np.ndarray, bit: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """The links of whole groups; rows are sorted by (seg, bit, rest)."""
    head = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (bit[1:] != bit[:-1]) | (seg[1:] != seg[:-1])]))
    size = np.diff(np.append(head, len(fp)))
    met = np.repeat(size > 1, size)
    kind, fp = seg[met].astype(np.int64) * SEGMENT + bit[met], fp[met]
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for k in np.unique(kind):
        x, y = group_links(int(k) // SEGMENT, int(k) % SEGMENT, fp[kind == k])
        a.append(x)
        b.append(y)
    x, y = np.concatenate(a), np.concatenate(b)
    x, y = _forest(x, y) if len(x) else (x, y)
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp long), enough to make the same components as all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the group that may go on

        def flush() -> pa.RecordBatch:
            return met_links(*[np.concatenate(c) for c in zip(*held, strict=True)])

        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(3)] + [np.asarray(batch.column(3)).view(np.uint64)]
            if not len(cols[0]):
                continue
            if held and any(h[-1] != c[0] for h, c in zip(held[-1][:3], cols[:3], strict=True)):
                yield flush()
                held = []
            # The last group may go on in the next batch; its parts are joined once, when it ends.
            other = np.flatnonzero((cols[2] != cols[2][-1]) | (cols[1] != cols[1][-1]) | (cols[0] != cols[0][-1]))
            cut_at = int(other[-1]) + 1 if len(other) else 0
            if cut_at:
                held.append([c[:cut_at] for c in cols])
                yield flush()
                held = []
            held.append([c[cut_at:] for c in cols])
        if held:
            yield flush()

    v = variants(fps)
    return v.repartition("seg", "bit", "rest").sortWithinPartitions("seg", "bit", "rest").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, doc_id: str, text: str, row: str | None, words: int) -> DataFrame:
    """(doc_id, fp, component_id, row, root): root is a component's own fingerprint, for components whose least ids are equal or null."""
    t = cut(fingerprints(docs, doc_id, text, row, words))
    least = cut(t.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = cut(links(least.select("fp")))
    roots = components(found)
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = t.join(cut(named.join(ids, "root").select("fp", "component_id", "root")), "fp")
    drop_cut(found)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id, row.

    component_id is the least doc_id that links reach, a document's own included; null ids are never
    the least, and a component of null ids has null. Null, empty and blank texts have fingerprint
    zero and are linked like others; a bit that is set in exactly half of the shingles is 0. Texts of
    any length are taken whole, a part of their shingles at a time. Repeated rows are linked by their
    equal fingerprints. An empty table gives an empty table; other columns of docs are ignored.
    """
    return grouped(docs, doc_id, text, row, words).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of docs less all but one of each component: the row of the least doc_id, of equal ones the first."""
    names = docs.columns
    key = private(names, "row")
    t = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    # Rows without an id come last.
    n = grouped(t, doc_id, text, key, words)
    firsts = n.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("one"))
    kept = firsts.select(F.col("one.row").alias(private(names, "kept")))
    return t.join(kept, F.col(key) == F.col(private(names, "kept")), "left_semi").select(*names)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("row")
