"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Of fewer links than this the least neighbours are not stored: no hub can have enough neighbours to matter.
FEW = 4_000


def _least_neighbour(pairs: DataFrame, few: bool = False) -> DataFrame:
    """(u, v, m): every row of the stored table ``pairs`` with the least of u and all v of the same u.

    The least ones are stored, too: both sides of the join are then plain shuffles, of which adaptive execution cuts the
    part that holds a hub's neighbours into several. They are never broadcast: each round would leave a copy on the driver.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    least = least if few else stored(least)
    return pairs.join(least.hint("merge"), "u")


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; the root is the component's least node.

    Each round makes large stars, then small stars, and ends where nothing changes; the number of rounds grows with the
    logarithm of the longest chain. A round's aggregations combine before they shuffle, and its joins can be cut
    at hubs, so that no node's neighbours have to meet in one task. Every step is a stored table.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    state, few = None, edges.count() < FEW
    while True:
        both = edges.union(edges.select("v", "u"))
        large = stored(_least_neighbour(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        starred = _least_neighbour(large, few)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
