"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm._spark import cut

#: edges up to which a star may be a window: no star has more rows than there are edges
SMALL = 5_000_000


def _with_low(rows: DataFrame, small: bool) -> DataFrame:
    """Adds m: the least v of each u.

    Beyond SMALL edges by sums that are partial before the exchange and a join whose
    hot keys Spark can split: both of its sides are plain exchanges.
    """
    if small:
        return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return rows.join(cut(rows.groupBy("u").agg(F.min("v").alias("m"))), "u")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _with_low(both, small).withColumn("m", F.least("u", "m"))
    return low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    low = _with_low(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small)
    pairs = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of comparable ids -> (u, root): the least id of u's component, for each u that isn't itself the root.

    Self-loops, repeated edges and either direction are allowed; edges with a
    null end are left out; no edges give no rows.  Neighbourhoods are never
    collected into one row, and a hub's edges are in one task only where all edges
    together are few.  Each round ends in a reliable checkpoint.
    """
    now = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )
    seen, n = None, now.count()
    for _ in range(max_rounds):
        star = _large_star(now, n <= SMALL)
        now = cut(_small_star(star if n <= SMALL else cut(star), n <= SMALL))
        # a forest of stars is its own image: the same edges again mean the end
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (mark.n, mark.h) == seen:
            return now.select("u", F.col("v").alias("root"))
        seen, n = (mark.n, mark.h), mark.n
    raise RuntimeError("components did not settle")
