"""Connected components of a table of links, by alternating stars.

Each round replaces links with links to smaller neighbours (large star, then
small star) until every node of a component is linked to its smallest node.
Rounds are joins and grouped minima; links never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Links of the neighbours in ``pairs`` (``u``, ``v``) to the least of them and ``u``.

    The minima are written first: a join with a table that was just grouped by
    its key puts a node with very many links into one task, a join with a
    written table is divided.
    """
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return keep(pairs.join(least, "u"))


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest reachable node) of every node that has a link.

    Null ends and links of a node to itself are ignored; repeated links do no
    harm; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    edges = stored(edges, "links")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, lambda x: x.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")).distinct()
        # Small star: every u is larger than its v here, so the neighbours are all smaller.
        small = _star(large, lambda x: x.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(x.select("u", F.col("m").alias("v")))).distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
