"""Near-duplicates by SimHash, carried on to a Jaccard similarity of word shingles.

Texts are linked if their SimHash fingerprints are, or if the Jaccard similarity of their sets of
shingles is 0.8 or more, which 64 bits can't hold apart (about ten of them differ). Texts with equal
sets are one; every distinct set goes on. Candidates meet in bands of MinHash values: at the bound of
similarity a pair shares one of BANDS bands of ROWS values with probability
1 - (1 - 0.8 ** 5) ** 24 = 0.9999. Whatever meets is decided on the whole sets.

A band is worked on in this order, each time with what is linked already left out:

1. All its texts are compared with a lead, the one that meets most texts over all its bands: of near
   copies that is the text they were made of, or one close to it. A second lead is taken among those
   that the first did not link. This is a comparison a text and lead, however large the group.
2. Where a band still holds several components, the texts outside the first lead's component meet the
   others in blocks of bounded weight. A block's common shingles are the columns of 0/1 matrices, whose
   product has the sizes of all intersections; a block sends out its links as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_spans, cut, drop_cut, narrow, private
from .components import components
from .simhash import _IS_SPACE, _LOWER, _forest, fingerprint_many, links

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 5
#: Rows and shingles of a side of a block, about.
BLOCK, WEIGHT = 2048, 1 << 20

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None]
_ODD = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)


def shingles(raw: np.ndarray, words: int) -> np.ndarray:
    """The set of a text's shingles as sorted hashes (uint64); a shorter text is one shingle, a blank one has none."""
    low = _LOWER[raw]
    low[_IS_SPACE[low]] = 32
    w = [x for x in low.tobytes().split(b" ") if x]
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = zip(*[w[i:] for i in range(words)], strict=False) if len(w) >= words else [w]
    return np.unique(np.fromiter((digest(b" ".join(x), SEED) for x in grams), np.uint64))


def least_hashes(grams: np.ndarray) -> np.ndarray:
    """MinHash values (uint64) of a set."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for lo in range(0, len(grams), 2048):
        np.minimum(out, ((grams[None, lo : lo + 2048] ^ _FLIP) * _ODD).min(axis=1), out=out)
    return out


def sketches(t: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, fp, size, digest, bands) of (doc_id, row, text): the fingerprint, the size and a 128-bit digest of the set, and bands; sets without shingles have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = byte_spans(b.column(2))
            size, digest, bands = [], [], []
            fp = pa.array(fingerprint_many(raw, at, words).view(np.int64))
            for i in range(b.num_rows):
                g = shingles(raw[at[i] : at[i + 1]], words)
                least = least_hashes(g)
                size.append(len(g))
                digest.append(xxhash.xxh3_128_digest(g.tobytes()))
                bands.append([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))] if len(g) else [])
            flat = pa.array(np.array([x for y in bands for x in y], np.uint64).view(np.int64))
            ends = pa.array(np.cumsum([0] + [len(y) for y in bands]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "row", "fp", "size", "digest", "bands"])

    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, row long, fp long, size long, digest binary, bands array<long>")


def gram_sets(t: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(row, grams): the sets of those rows of t (row, text) that `need` (need) names, made once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = byte_spans(b.column(1))
            grams = [shingles(raw[at[i] : at[i + 1]], words).astype("<u8").tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary())], names=["row", "grams"])

    return t.join(need, t.row == need.need, "left_semi").select("row", "text").mapInArrow(run, "row long, grams binary")


def verified(t: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows of t whose sets are similar. The sets of each row that is in a pair are made once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                least, most = sorted((len(x), len(y)))
                if least + 1e-9 < similarity * most:
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both + 1e-9 >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    need = pairs.select(F.col("a").alias("need")).unionByName(pairs.select(F.col("b").alias("need"))).distinct()
    made = cut(gram_sets(t, need, words))
    left, right = made.select(F.col("row").alias("a"), F.col("grams").alias("grams_a")), made.select(F.col("row").alias("b"), F.col("grams").alias("grams_b"))
    out = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(compare, "a long, b long"))
    drop_cut(made)
    return out


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left has in common with each on the right."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    sets = [*left, *right]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    some = n[column] > 1
    column, owner = column[some], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = np.unique(column[order], return_inverse=True)[1], owner[order]
    out = np.zeros((len(left), len(right)), np.float64)
    step = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        x = np.zeros((len(sets), step), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def block_links(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of (band, i, j, minor, row, root, grams): in each cell the minor rows meet the others; links between different roots, as a forest of each cell."""

    def work(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        minor, row, root = (t.column(k).to_numpy() for k in ("minor", "row", "root"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for c in t.column("grams").chunks for x in c]
        left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
        if not len(left) or not len(right):
            return row[:0], row[:0]
        size = np.array([len(s) for s in sets])
        both = intersections([sets[k] for k in left], [sets[k] for k in right])
        either = size[left][:, None] + size[right][None, :] - both
        i, j = np.nonzero((both + 1e-9 >= similarity * either) & (root[left][:, None] != root[right][None, :]))
        return _forest(row[left[i]], row[right[j]]) if len(i) else (row[:0], row[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # parts of the cell that may go on

        def out(t: pa.Table) -> pa.RecordBatch:
            key = np.stack([t.column(k).to_numpy() for k in ("band", "i", "j")])
            heads = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(t)]
            found = [work(t.slice(lo, hi - lo)) for lo, hi in zip(heads[:-1], heads[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            last = [t.column(k)[-1].as_py() for k in ("band", "i", "j")]
            same = np.all([t.column(k).to_numpy() == v for k, v in zip(("band", "i", "j"), last, strict=True)], axis=0)
            at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if at:
                yield out(pa.concat_tables([*held, t.slice(0, at)]))
                held = []
            elif held and [held[0].column(k)[0].as_py() for k in ("band", "i", "j")] != last:
                yield out(pa.concat_tables(held))
                held = []
            held.append(t.slice(at))
        if held:
            yield out(pa.concat_tables(held))

    return cells.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "minor", "row").mapInArrow(run, "a long, b long")


def rooted(met: DataFrame, found: DataFrame) -> DataFrame:
    """met (band, row, degree, ...) with the component of each row under the links found so far."""
    roots = components(found).select(F.col("node"), F.col("root").alias("new_root"))
    t = met.drop("root").join(roots, F.col("row") == F.col("node"), "left")
    return t.withColumn("root", F.coalesce("new_root", "row")).drop("node", "new_root")


def opened(met: DataFrame) -> DataFrame:
    """The rows of bands that hold more than one component."""
    several = met.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select(F.col("band").alias("band2"))
    return met.join(several, F.col("band") == F.col("band2"), "left_semi")


def lead_pairs(met: DataFrame, lead: str) -> DataFrame:
    """(a, b): each row of a band with the band's lead (row, root), unless they are one component already."""
    t = met.where(F.col(lead).isNotNull() & (F.col("root") != F.col(f"{lead}.root")))
    return t.select(F.greatest("row", f"{lead}.row").alias("a"), F.least("row", f"{lead}.row").alias("b")).distinct()


def with_lead(met: DataFrame, name: str, outside: str | None = None) -> DataFrame:
    """met with a column name: the row and root of the band's row that meets most, of those outside the component of another lead."""
    best = F.max_by(F.struct("row", "root"), F.struct("degree", -F.col("row")))
    t = met.where(F.col("root") != F.col(f"{outside}_root")) if outside else met
    leads = t.groupBy("band").agg(best.alias(name)).withColumnRenamed("band", "band2")
    return met.join(leads, F.col("band") == F.col("band2"), "left").drop("band2")


def similar_links(t: DataFrame, sets: DataFrame, known: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links between rows of `sets` (row, size, bands), enough for the same components as all of them, known links included."""
    bands = cut(sets.select("row", F.explode("bands").alias("band")))
    counts = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("band2"), "n")
    several = cut(bands.join(counts, F.col("band") == F.col("band2")).select("band", "row", "n"))
    drop_cut(bands)
    degree = several.groupBy("row").agg(F.sum("n").alias("degree")).withColumnRenamed("row", "row2")
    met = several.join(degree, F.col("row") == F.col("row2")).select("band", "row", "degree")
    met = cut(with_lead(opened(cut(rooted(met, known))), "first"))
    drop_cut(several)
    found = cut(known.unionByName(verified(t, cut(lead_pairs(met, "first")), words, similarity)))

    roots = components(found).select(F.col("node"), F.col("root").alias("first_root"))
    after = rooted(met.select("band", "row", "degree", F.col("first.row").alias("first_row")), found)
    after = after.join(roots, F.col("first_row") == F.col("node"), "left").withColumn("first_root", F.coalesce("first_root", "first_row")).drop("node")
    met = cut(with_lead(opened(cut(after)), "second", outside="first"))
    # The first lead has met all rows already.
    pairs = lead_pairs(met.where("row <> first_row"), "second")
    found = cut(found.unionByName(verified(t, cut(pairs), words, similarity)))

    left = cut(opened(cut(rooted(met.select("band", "row", "degree", "first_row", F.col("second.row").alias("second_row")), found))))
    firsts = left.where("row = first_row").select(F.col("band").alias("band2"), F.col("root").alias("first_root"))
    left = left.join(firsts, F.col("band") == F.col("band2"), "left").drop("band2").where("row <> first_row and row <> second_row")
    left = left.withColumn("minor", F.coalesce(F.col("root") != F.col("first_root"), F.lit(True)))
    left = cut(opened(left.join(sets.select(F.col("row").alias("row2"), "size"), F.col("row") == F.col("row2")).select("band", "row", "root", "minor", "size")))
    parts = lambda rows, weight: F.greatest(F.ceil(rows / BLOCK), F.ceil(weight / WEIGHT), F.lit(1)).cast("long")
    minors = F.when(F.col("minor"), F.lit(1)), F.when(F.col("minor"), F.col("size"))
    dealt = left.groupBy("band").agg(parts(F.count("*"), F.sum("size")).alias("all"), parts(F.coalesce(F.count(minors[0]), F.lit(0)), F.coalesce(F.sum(minors[1]), F.lit(0))).alias("few")).withColumnRenamed("band", "band2")
    dealt = left.join(dealt, F.col("band") == F.col("band2"))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    others = dealt.withColumn("i", each("few")).select("band", "i", own("all").alias("j"), F.lit(False).alias("minor"), "row", "root")
    few = dealt.where("minor").withColumn("j", each("all")).select("band", own("few").alias("i"), "j", F.lit(True).alias("minor"), "row", "root")
    cells = few.unionByName(others)
    made = cut(gram_sets(t, left.select(F.col("row").alias("need")).distinct(), words)).withColumnRenamed("row", "row3")
    cells = cells.join(made, F.col("row") == F.col("row3")).select("band", "i", "j", "minor", "row", "root", "grams")
    return found.unionByName(cut(block_links(cells, similarity)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs less all but one of each component of similar texts: the row of the least doc_id, of equal ones the first.

    Two texts are linked if their SimHash fingerprints over `words` words are, or if the Jaccard
    similarity of their sets of shingles is at least `similarity`. Null, empty and blank texts are equal
    to each other; rows without an id come last; of equal ids the first row stays. Texts of any length
    are taken whole. An empty table gives an empty table; other columns pass through.
    """
    names = docs.columns
    key = private(names, "row")
    whole = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    t = narrow(whole, doc_id=doc_id, row=key, text=text)
    s = cut(sketches(t, words))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # Equal sets may have unlike fingerprints, for those count repeats.
    kinds = cut(s.groupBy("digest", "fp").agg(F.min(order).alias("one")))
    firsts = cut(kinds.groupBy("digest").agg(F.min("one").alias("one")).select("digest", F.col("one.no_id").alias("no_id"), F.col("one.doc_id").alias("doc_id"), F.col("one.row").alias("first")))
    groups = components(links(kinds.select("fp").distinct())).select("node", F.col("root").alias("fp_root"))
    held = kinds.select(F.col("digest").alias("digest2"), "fp").join(groups, F.col("fp") == F.col("node"), "left").select("digest2", F.coalesce("fp_root", "fp").alias("group")).distinct()
    held = cut(held.join(firsts, F.col("digest2") == F.col("digest")).select("group", "first"))
    heads = held.groupBy("group").agg(F.min("first").alias("head")).withColumnRenamed("group", "group2")
    known = cut(held.join(heads, F.col("group") == F.col("group2")).where("first <> head").select(F.col("first").alias("a"), F.col("head").alias("b")))
    sets = cut(s.join(firsts.select("first"), F.col("row") == F.col("first"), "left_semi").select("row", "size", "bands"))
    roots = components(similar_links(t, sets, known, words, similarity))
    ends = firsts.join(roots, F.col("first") == F.col("node"), "left").groupBy(F.coalesce("root", "first")).agg(F.min(F.struct("no_id", "doc_id", F.col("first").alias("row"))).alias("one"))
    kept = cut(ends.select(F.col("one.row").alias(private(names, "kept"))))
    drop_cut(s)
    return whole.join(kept, F.col(key) == F.col(private(names, "kept")), "left_semi").select(*names)
