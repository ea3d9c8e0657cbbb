"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected number of copies grows with its size
class (the number of bits of its word count, so that longer, connected texts come more often) by a
factor per source that makes the expected words those of the target; it stops at `most`. Whole copies
are certain. What is left of it is the document's inclusion probability p: within a source documents of
unlike classes have unlike p, and one ranking orders them all by q = (u / (1 - u)) / (p / (1 - p)),
random odds over inclusion odds. The lowest ranks are taken until the words that p stands for are
reached. u is a hash of the document, so that reruns agree. A last step swaps at most one document a
source in or out, the one whose size is nearest to what the sample is short of or over by.

DataFrame functions only. The hot source isn't gathered: ranks are cut into cells that are summed before
the shuffle, the cell that the sum ends in is cut again until it holds few documents, and a window
orders only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, narrow, read_table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: How much the expected copies grow with each size class, in eighths.
TILT = 1
#: Bits of a rank, of a row's own hash that parts equal ranks, and of one step of refinement; documents that may be ordered together; sources that may be broadcast.
RANK_BITS, ROW_BITS, STEP, EDGE, SOURCES = 48, 24, 12, 1024, 20_000


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that depends on the document alone: 52 bits of an MD5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources by code point, null last, have the weights in turn. They share `share` times all sizes;
    a target stops at `most` times its source's size and the excess goes to the others by weight.
    The sources that stop are a prefix in order of most * size / weight, so one pass in that order
    finds them. The table has one row a source; documents never pass this window.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("stop", F.lit(most) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("stop") / F.col("w"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    t = t.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("stops", F.col("stop") <= F.col("level") * F.col("w"))
    t = t.withColumn("final", F.max(F.when(~F.col("stops"), F.col("level"))).over(everything))
    return t.select("source", "source_size", F.when(F.col("stops"), F.col("stop")).otherwise(F.col("final") * F.col("w")).alias("target"))


def plan(classes: DataFrame, goal: DataFrame, most: float = MOST, tilt: int = TILT) -> DataFrame:
    """(source, class, words), (source, source_size, target) -> (source, class, whole, p, rest): certain copies and the inclusion probability of each class, and the words that the sample of a source stands for.

    Expected copies are min(most, level * (8 + tilt * class)); the classes that stop are the highest, so
    one pass from the highest down finds the level. A few dozen rows a source.
    """
    c = classes.withColumnRenamed("source", "source_")
    t = c.join(goal, c.source_.eqNullSafe(goal.source)).drop("source_").withColumn("h", F.lit(8) + F.lit(tilt) * F.col("class"))
    above = W.partitionBy("source").orderBy(F.col("class").desc()).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("source").orderBy("class").rowsBetween(W.unboundedPreceding, 0)
    weighed = F.sum(F.col("words") * F.col("h")).over(upto)
    t = t.withColumn("level", F.when(weighed > 0, (F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(above), F.lit(0))) / weighed).otherwise(F.lit(0.0)))
    t = t.withColumn("stops", F.col("level") * F.col("h") >= F.lit(most))
    t = t.withColumn("final", F.max(F.when(~F.col("stops"), F.struct("class", "level"))).over(W.partitionBy("source"))["level"])
    t = t.withColumn("copies", F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("stops"), F.lit(most)).otherwise(F.least(F.lit(most), F.greatest(F.lit(0.0), F.col("final") * F.col("h")))))
    t = t.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.col("whole"))
    return t.withColumn("rest", F.sum(F.col("p") * F.col("words")).over(W.partitionBy("source"))).select("source", "source_size", "target", "class", "whole", "p", "rest")


def small(t: DataFrame, most: int = SOURCES) -> DataFrame:
    """t, to be broadcast if a count shows that it is small; otherwise Spark picks the join."""
    return F.broadcast(t) if t.limit(most + 1).count() <= most else t


def find_edges(t: DataFrame, few: int = EDGE) -> DataFrame:
    """(source, base, a, b, step): of each source the cell of ranks that `rest` falls in, and the words ranked before it.

    t: (source, r, x, size, rest). A cell is a prefix of r, then of x; it is cut again, 2**STEP ways, until
    no source has more than `few` documents in its cell or all bits are used. Sources whose rest is
    never reached have no row.
    """
    steps = [(F.shiftright("r", RANK_BITS - STEP * k), F.lit(0).cast("long")) for k in range(1, RANK_BITS // STEP + 1)]
    steps += [(F.col("r"), F.shiftright("x", ROW_BITS - STEP * k)) for k in range(1, ROW_BITS // STEP + 1)]
    edges = None
    for k, (a, b) in enumerate(steps):
        here = t
        if edges is not None:
            pa, pb = steps[k - 1]
            e = small(edges.select(F.col("source").alias("s_"), F.col("base").alias("base_"), F.col("a").alias("a_"), F.col("b").alias("b_")))
            here = t.join(e, t.source.eqNullSafe(F.col("s_")) & (pa == F.col("a_")) & (pb == F.col("b_")))
        start = F.first("base_") if edges is not None else F.lit(0)
        cells = here.groupBy("source", a.alias("a"), b.alias("b")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("rest").alias("rest"), start.alias("start"))
        upto = W.partitionBy("source").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
        cells = cells.withColumn("base", F.col("start") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
        edges = cut(cells.where("base <= rest and rest < base + words").select("source", "base", "a", "b", "n", F.lit(k).alias("step")))
        if (edges.agg(F.max("n").alias("n")).first()["n"] or 0) <= few:
            break
    return edges


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, row: str | None = None, tilt: int = TILT) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, row.

    size is the number of words, taken = copies * size, copies is 0, 1 or 2 under the default `most`.
    row names a column of docs that tells its rows apart; it is returned, so that the caller can join.
    Nulls: a null text has size 0, a null source is a source of its own (the last), a null doc_id is
    an id like another. Texts of any length are counted whole. Texts without words have size 0; their
    copies add no words. Repeated rows are documents of their own: they share u and rank, and a hash of
    the row orders them. An empty table gives an empty table. Other columns of docs are ignored.
    """
    t = narrow(docs, doc_id=doc_id, source=source, size=word_count(F.col(text)), u=uniform(F.col(doc_id), F.col(text)), row=F.col(row) if row else F.monotonically_increasing_id())
    # The texts are read once; from here on a row is a few numbers. A class is the place of the highest bit of the size.
    t = cut(t.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(0)).withColumn("x", F.xxhash64("row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))))
    classes = cut(t.groupBy("source", "class").agg(F.sum("size").alias("words")))
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = cut(plan(classes, goal, most, tilt))
    g = small(goal.withColumnRenamed("source", "source_").withColumnRenamed("class", "class_"))
    t = t.join(g, t.source.eqNullSafe(F.col("source_")) & (t["class"] == F.col("class_")), "left").drop("source_", "class_")
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    t = cut(t.withColumn("r", F.when(F.col("p") > 0, F.floor(odds / (1 + odds) * F.lit(float(1 << RANK_BITS))).cast("long"))))
    asked = t.where("r is not null")
    edges = find_edges(asked)
    step = edges.agg(F.max("step").alias("k")).first()["k"]
    shift = max(0, RANK_BITS - STEP * ((step or 0) + 1))
    more = max(0, (step or 0) + 1 - RANK_BITS // STEP)
    a, b = F.shiftright("r", shift), F.shiftright("x", ROW_BITS - STEP * more) if more else F.lit(0).cast("long")
    e = small(edges.select(F.col("source").alias("source_"), "base", F.col("a").alias("a_"), F.col("b").alias("b_")))
    t = t.join(e, t.source.eqNullSafe(F.col("source_")), "left").drop("source_")
    on = F.coalesce((a == F.col("a_")) & (b == F.col("b_")), F.lit(False))
    inside = W.partitionBy("source").orderBy("r", "x", "row").rowsBetween(W.unboundedPreceding, -1)
    on_edge = t.where(on).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on_edge = on_edge.withColumn("pick", (F.col("at") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("at")
    before = F.col("a_").isNull() | (a < F.col("a_")) | ((a == F.col("a_")) & (b < F.col("b_")))
    off_edge = t.where(~on).withColumn("pick", F.when(F.col("r").isNull(), 0).otherwise(before.cast("int")))
    t = cut(on_edge.unionByName(off_edge).drop("base", "a_", "b_"))

    # What the sample is short of (or, negative, over by), and the one document that mends most of it.
    some = t.where("r is not null")
    gap = some.groupBy("source").agg((F.first("rest") - F.sum(F.col("size") * F.col("pick"))).alias("gap"))
    gap = small(gap.withColumnRenamed("source", "source_"))
    x = some.join(gap, some.source.eqNullSafe(F.col("source_"))).where((F.col("gap") > 0) == (F.col("pick") == 0))
    miss = F.abs(F.abs(F.col("gap")) - F.col("size"))
    x = x.where(miss < F.abs(F.col("gap"))).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "u", "doc_id", "row")).alias("best"))
    x = small(cut(x.select(F.col("source").alias("source_"), F.col("best.row").alias("swap"))))
    t = t.join(x, t.source.eqNullSafe(F.col("source_")), "left")
    copies = (F.col("whole") + F.when(F.col("row") == F.col("swap"), 1 - F.col("pick")).otherwise(F.col("pick"))).cast("long")
    return t.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "row")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("row")


OP4_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u,
    row_number() over () as row
  from documents
), s as (select source, sum(size)::bigint as source_size from d group by source
), w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, 2.0::double * source_size as stop from s
), l as (
  select *, (1.5::double * sum(source_size) over ()::double - coalesce(sum(stop) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from w window b as (order by stop / w, source nulls last rows between unbounded preceding and 1 preceding)
), f as (select *, max(case when stop > level * w then level end) over () as final from l
), g as (select source, source_size, case when stop <= level * w then stop else final * w end as target from f
), b as (
  select d.source, case when size > 0 then length(bin(size)) - 1 else 0 end as class, sum(size)::bigint as words from d group by 1, 2
), e as (
  select b.*, g.source_size, g.target, 8 + b.class as h,
    sum(words * (8 + b.class)) over (partition by b.source order by b.class rows between unbounded preceding and current row)::bigint as weighed,
    coalesce(sum(words) over (partition by b.source order by b.class desc rows between unbounded preceding and 1 preceding), 0)::bigint as above
  from b join g on b.source is not distinct from g.source
), lv as (select *, case when weighed > 0 then (target - 2.0::double * above) / weighed else 0.0::double end as level from e
), fl as (select *, level * h >= 2.0::double as stops from lv
), fi as (select *, arg_max(level, class) filter (not stops) over (partition by source) as final from fl
), co as (select *, case when source_size = 0 then 0.0::double when stops then 2.0::double else least(2.0::double, greatest(0.0::double, final * h)) end as copies from fi
), k as (select *, floor(copies)::bigint as whole, copies - floor(copies) as p from co
), ks as (select *, sum(p * words) over (partition by source) as rest from k
), r as (
  select d.doc_id, d.source, d.size, d.u, d.row, k.source_size, k.target, k.whole, k.rest, k.p,
    case when k.p > 0 then (d.u / (1 - d.u)) * ((1 - k.p) / k.p) end as odds
  from d join ks k on d.source is not distinct from k.source and k.class = case when d.size > 0 then length(bin(d.size)) - 1 else 0 end
), o as (
  select *, case when p > 0 then coalesce(sum(size) over (partition by source, p > 0 order by floor(odds / (1 + odds) * 281474976710656::double), row rows between unbounded preceding and 1 preceding), 0) end as taken_before from r
), c as (select *, case when p > 0 and taken_before + size / 2.0::double <= rest then 1 else 0 end as pick from o
), gaps as (select source, any_value(rest) - sum(size * pick) as gap from c where p > 0 group by source
), best as (
  select c.source, arg_min(c.row, (abs(abs(gap) - size), u, doc_id, c.row)) as swap
  from c join gaps on c.source is not distinct from gaps.source
  where p > 0 and (gap > 0) = (pick = 0) and abs(abs(gap) - size) < abs(gap) group by c.source
)
select c.doc_id, c.size, c.source_size, c.target,
  ((c.whole + case when c.row = best.swap then 1 - c.pick else c.pick end) * c.size)::bigint as taken,
  (c.whole + case when c.row = best.swap then 1 - c.pick else c.pick end)::bigint as copies
from c left join best on c.source is not distinct from best.source
"""
