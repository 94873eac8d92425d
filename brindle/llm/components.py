"""Connected components over an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, saved


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` (longs, any direction, repeats allowed) -> ``(id, component)``, component = smallest id.

    Alternates the two star contractions of Kiveris et al. (2014): each vertex hands its neighbours to the smallest
    vertex it sees, first to its larger neighbours, then among its smaller ones. Work per round is linear in the edges and
    the number of rounds logarithmic; they go on until nothing changes. Every round is one written table, so a lost executor repeats one round at
    most. Only minima are aggregated, so hubs are combined before the shuffle. Only vertices that appear in
    ``edges`` are returned. Null ends are dropped; an empty table gives an empty result.
    The result reads one table, which ``discard`` deletes.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    cur = saved(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sig = _signature(cur)
    last = None
    while sig[0] and sig != last:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = saved(new)
        discard(cur)
        cur, last, sig = nxt, sig, _signature(nxt)
    stars = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
    out._brindle_path = cur._brindle_path
    return out
