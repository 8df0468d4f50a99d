"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, small, stored

#: Links of a node at least, and nodes at most, that are told apart as hubs.
HUB, HUBS = 100_000, 500_000


def with_values(side: DataFrame, per: DataFrame, key: str, most: int) -> DataFrame:
    """side joined with per (unique key, values, n: rows of side with the key, about). most: a bound of the rows of either.

    A broadcast of a checked size; beyond it the values of hubs are broadcast, of which there are few,
    and the others meet by a shuffle without a hot key.
    """
    values = per.drop("n")
    hinted = small(values, most)
    if hinted is not values:
        return side.join(hinted, key)
    hubs = per.filter(F.col("n") > max(HUB, most // HUBS)).drop("n").withColumn("__gw_hub", F.lit(True))
    marked = side.join(F.broadcast(hubs), key, "left")
    rest = marked.filter("__gw_hub is null").select(*side.columns).join(values, key)
    return marked.filter("__gw_hub").drop("__gw_hub").union(rest)


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Links of each node's neighbours to the least of them and itself. Large: the neighbours above the
    node; small: those below it, and the node. most: a bound of the number of links. The least neighbours are found
    with map-side minima."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.filter("b < a")
    least = side.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    moved = with_values(side, least, "a", 2 * most)
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if large and small(out, 2 * most) is not out:  # few: the small star's minima take repeats, and a round is a shuffle shorter
        return out
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its least node. Each round is
    written to the shared folder; the number of rounds grows with the logarithm of the longest chain."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state, most = None, edges.count()
    while True:
        turned = stored(_star(_star(edges, True, most), False, most), "stars")  # a large star makes no more links than it finds
        now = turned.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).head()
        drop_stored(edges)
        edges, most = turned, now[0]
        if state == now:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
