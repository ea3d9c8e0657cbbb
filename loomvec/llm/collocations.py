"""Phrase collocation mining: word sequences that stand together more often than their parts would.

Level by level, all sequences of 1, 2, ... words become DataFrame rows (lang, phrase, f), counted within
a task first, a bounded number of words at a time, and then hash-aggregated by language. A sequence
occurs at most as often as its parts, so from the second level on only places whose two parts one word
shorter reached the least count are exploded: a filter of a fixed number of bits holds the phrases that
did. It has no false negatives, so no count is lost; what it lets through by chance is counted and then
fails the least count.

Candidates are joined with the counts of their first and last parts, scored in Decimal, dropped where a
candidate of one more word holds them about as often (a longer one then has such a part, so one more
word is enough), and ranked by language: first within slices of a language, then what is left.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_spans, cut, narrow, read_table

MAX_WORDS, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a candidate around it has at least so many percent of its count.
SHARE = 50
NO_LANG = "und"
#: Words that a task counts at a time, and distinct ones among them: what it holds doesn't grow with its share of the table.
FLUSH, VOCABULARY = 2_000_000, 250_000
#: Starts whose hashes are worked out at a time, and rows that leave a task at a time.
BLOCK, ROWS = 1 << 16, 1 << 15
#: Bits of the filter of phrases that reached the least count (8 MB); the number of phrases doesn't change it.
FILTER_BITS = 1 << 26
#: Parts of a language that are ranked on their own first.
SLICES = 64

_STOP, _NONE = 0, 1
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, lower-cased A-Z; b"\\n" stands where a piece ends, and empty strings may stand between."""
    return text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def roll(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one word more."""
    x = (code ^ (code >> np.uint64(29))) * _A + word * _B
    return (x ^ (x >> np.uint64(32))) * _C


def bits_of(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of the filter that a hash sets."""
    return (code % np.uint64(bits)).astype(np.int64), ((code >> np.uint64(32)) * _A % np.uint64(bits)).astype(np.int64)


class Filter:
    """Sets of phrases of one length by the hashes of their words, in a fixed number of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, code: np.ndarray) -> np.ndarray:
        size = 8 * len(self.bits)
        a, b = bits_of(code, size)
        return ((self.bits[a >> 3] >> (a & 7)) & (self.bits[b >> 3] >> (b & 7)) & 1).astype(bool)

    @staticmethod
    def over(phrases: DataFrame, size: int = FILTER_BITS) -> Filter:
        """phrases (lang, phrase). The driver gets at most size / 64 numbers, whatever the number of phrases."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                langs = [seed(x) for x in b.column(0).to_pylist()]
                code = np.zeros(b.num_rows, np.uint64)
                for i, (lang, raw) in enumerate(zip(langs, b.column(1).to_pylist(), strict=True)):
                    h = np.array([lang], np.uint64)
                    for w in raw.encode().split(b" "):
                        h = roll(h, np.array([xxhash.xxh64_intdigest(w)], np.uint64))
                    code[i] = h[0]
                at = np.unique(np.concatenate(bits_of(code, size)))
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).view(pa.int64())], names=["word", "bits"])

        held = phrases.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        out = np.zeros(size // 64, np.int64)
        rows = held.toArrow()
        out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        return Filter(out.view(np.uint8))


def seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 1)


def phrases(x: np.ndarray, hashes: np.ndarray, lang: str, size: int, known: Filter | None) -> np.ndarray:
    """Starts in x (word numbers, _STOP between pieces) of the sequences of `size` words whose parts one word shorter are known."""
    n, found = len(x) - size + 1, [np.zeros(0, np.int32)]
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        ok = x[lo:hi] != _STOP
        for k in range(1, size):
            ok &= x[lo + k : hi + k] != _STOP
        at = lo + np.flatnonzero(ok)
        for skip in (0, 1) if known else ():
            code = np.full(len(at), seed(lang), np.uint64)
            for k in range(skip, skip + size - 1):
                code = roll(code, hashes[x[at + k]])
            at = at[known.has(code)]
        found.append(at.astype(np.int32))
    return np.concatenate(found)


def counted(x: np.ndarray, at: np.ndarray, size: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(a start of each distinct sequence, how often it stands)."""
    key, range_ = np.zeros(len(at), np.int64), 1
    for k in range(size):
        if range_ * vocabulary >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            range_ = len(at) + 1
        key, range_ = key * vocabulary + x[at + k], range_ * vocabulary
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


def exploded(docs: DataFrame, size: int, known: Filter | None = None, flush: int = FLUSH, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, text) -> rows (lang, phrase, f) of sequences of `size` words, counted within a task. With size 1 a row without a phrase has the number of all words of a language."""
    kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            held: dict[bytes, int] = defaultdict(count(2).__next__)
            held[b"\n"], held[b""] = _STOP, _NONE
            return held

        number, by_lang, total = fresh(), defaultdict(list), 0

        def out() -> Iterator[pa.RecordBatch]:
            names = [b"", b"", *[w for w, i in number.items() if i > 1]]
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
            table = pa.array(names, pa.binary())
            while by_lang:
                lang, parts = by_lang.popitem()
                x = np.concatenate(parts)
                del parts
                at, n = counted(x, phrases(x, hashes, lang, size, known), size, len(names))
                for lo in range(0, len(at), ROWS):
                    some = at[lo : lo + ROWS]
                    told = [table.take(pa.array(x[some + k])) for k in range(size)]
                    text = told[0] if size == 1 else pc.binary_join_element_wise(*told, b" ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(some), np.int64))), text.cast(pa.string()), pa.array(n[lo : lo + ROWS])], schema=kind)
                if size == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([int(n.sum())])], schema=kind)

        for b in batches:
            raw, ends = byte_spans(b.column(1))
            for i, lang in enumerate(b.column(0).to_pylist()):
                words = words_of(raw[ends[i] : ends[i + 1]].tobytes())
                x = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                x = x[x != _NONE]
                by_lang[lang] += [x, np.zeros(1, np.int32)]
                total += len(x) + 1
                if total >= flush or len(number) > vocabulary:
                    yield from out()
                    number, by_lang, total = fresh(), defaultdict(list), 0
        if total:
            yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, f long")


def summed(rows: DataFrame) -> DataFrame:
    """Counts of tasks (lang, phrase, f), added. They are dealt out first: a sum within a task would hold all its phrases once more and merge hardly any."""
    return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def part(phrase: Column, start: int, words: int) -> Column:
    """`words` words of a phrase from word `start` (from 1)."""
    return F.array_join(F.slice(F.split(phrase, " "), start, words), " ")


def candidates(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(counts, totals) of docs (lang, text): phrases of 1 to max_words words that stand at least `least` times, as (lang, size, phrase, f), and (lang, n)."""
    sums = lambda size, known: summed(exploded(docs, size, known))
    words = cut(sums(1, None).where((F.col("f") >= least) | F.col("phrase").isNull()).select("lang", F.lit(1).alias("size"), "phrase", "f"))
    totals = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    out = last = words.where("phrase is not null")
    for size in range(2, max_words + 1):
        last = cut(sums(size, Filter.over(last.select("lang", "phrase"))).where(F.col("f") >= least).select("lang", F.lit(size).alias("size"), "phrase", "f"))
        out = out.unionByName(last)
    return out, totals


def scored(counts: DataFrame, max_words: int) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of phrases of two words and more, by their lowest-scoring cut."""
    held = counts.where("size > 1")
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), part(F.col("phrase"), 1, k).alias("first"), part(F.col("phrase"), k + 1, max_words).alias("rest")) for k in range(1, max_words)])
    t = held.withColumn("cut", F.explode(F.slice(cuts, F.lit(1), F.col("size") - 1))).select("lang", "size", "phrase", F.col("f").alias("a"), "cut.*")
    known = counts.where(F.col("size") < max_words)
    for name, count_ in (("first", "l"), ("rest", "r")):
        side = known.select(F.col("lang").alias("lang2"), F.col("phrase").alias("phrase2"), F.col("f").alias(count_))
        t = t.join(side, (F.col("lang") == F.col("lang2")) & (F.col(name) == F.col("phrase2"))).drop("lang2", "phrase2")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    t = t.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(38,0)")).withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    t = t.withColumn("score", F.expr("up div down"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x")
    return t.groupBy("lang", "size", "phrase", "a").agg(best).select("lang", "size", "phrase", "a", "x.l", "x.r", "x.score")


def covered(counts: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, most): of each phrase that a candidate of one word more holds, that one's greatest count."""
    longer = counts.where(F.col("size") > 2)
    parts = F.array(*[F.array_join(F.slice(F.split("phrase", " "), F.lit(start), F.col("size") - 1), " ") for start in (1, 2)])
    return longer.select(F.col("lang").alias("lang2"), F.explode(parts).alias("phrase2"), "f").groupBy("lang2", "phrase2").agg(F.max("f").alias("most"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    Null texts are empty, a null language is `und`; empty texts and texts without words add nothing.
    Texts of any length are counted whole; repeated rows count each. Equal scores go to the more
    frequent phrase, then to the lesser in UTF-8 bytes; equal cuts to the shortest first part. An empty
    table gives an empty table; other columns are ignored. Sums are longs and scores exact up to counts
    of 10**16.
    """
    t = narrow(docs, lang=F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)), text=F.coalesce(F.col(text), F.lit("")))
    counts, totals = candidates(t, max_words, least)
    c = scored(counts, max_words).join(covered(counts, max_words), (F.col("lang") == F.col("lang2")) & (F.col("phrase") == F.col("phrase2")), "left")
    c = c.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share)).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = W.partitionBy("lang", "slice").orderBy(*order)
    c = c.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).withColumn("place", F.row_number().over(near)).where(F.col("place") <= top)
    c = c.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals
    c = c.join(n.withColumnRenamed("lang", "lang3"), F.col("lang") == F.col("lang3"))
    return c.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (
  select lang, size, phrase, count(*) as f from (
    select lang, size, unnest([array_to_string(w[i : i + size - 1], ' ') for i in range(1, len(w) + 2 - size)]) as phrase from w, (values (1), (2), (3)) as s(size)
  ) group by lang, size, phrase
), n as (select lang, sum(f)::bigint as n from g where size = 1 group by lang),
c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from g where size > 1 and f >= 10),
k as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as part1, array_to_string(w[k + 1:], ' ') as part2 from c, (values (1), (2)) as s(k) where k < size),
s as (select k.lang, k.phrase, a, k, x.f as l, y.f as r, (1000000::hugeint * a * a // (x.f::hugeint * y.f))::bigint as score from k join g x on x.lang = k.lang and x.phrase = part1 join g y on y.lang = k.lang and y.phrase = part2),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
d as (
  select lang, array_to_string(w[1:2], ' ') as phrase, a as f from c where size = 3 union all select lang, array_to_string(w[2:3], ' '), a from c where size = 3
), z as (select * from b where not exists (select 1 from d where d.lang = b.lang and d.phrase = b.phrase and 100 * d.f >= 50 * b.a)),
r as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from z)
select r.lang, rank::bigint as rank, phrase, a, l, r, n, score from r join n on n.lang = r.lang where rank <= 2000
"""
