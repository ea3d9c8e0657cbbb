"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay in tables; the driver sees one number a round. Minima are combined before the shuffle,
and the join that hands them back can be split where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def star(links: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b), a > b. Large: of every node, its larger neighbours are linked to its least neighbour
    or itself. Small: a node and its smaller neighbours are linked to the least of them."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        out = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = links.join(least, links.a == least.n).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, root): the least node that each linked node reaches. Nodes without links are left out.

    Links with equal ends or null ends are ignored. The number of rounds grows with the logarithm of
    the longest path.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    for _ in range(most_rounds):
        after = cut(star(star(now, large=True), large=False))
        # The same links as before: stars, whose centres are the roots. A sum of hashes tells; equal sets have equal sums.
        print_ = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_cut(now)
        now = after
        if print_ == seen:
            break
        seen = print_
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
