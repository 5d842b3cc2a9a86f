"""Connected components of a link table, as joins and aggregates in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize


#: a node with more links than this is a hub; their list goes to all tasks up to so many
HUB, MAX_HUBS = 1024, 1_000_000


def _hung(links: DataFrame, least: DataFrame, max_hubs: int = MAX_HUBS) -> DataFrame:
    """``links(u, v)`` with the ``m`` of u from ``least(u, m, n)``, n: u's links.

    The rows of a hub are not dealt by it: hubs, a table of at most links / HUB
    rows, come to the links while their measured number allows it."""
    hubs = least.filter(F.col("n") > HUB).select("u", "m")
    n = hubs.count()
    if not n or n > max_hubs:
        return links.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs)
    rest = links.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= HUB).select("u", "m"), "u")
    return rest.unionByName(links.join(hubs, "u"))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges(a long, b long)`` -> (node, component): the smallest node each
    node reaches, for nodes with an edge to another node.

    Alternates large-star and small-star steps: each node's neighbours are
    hung on the smallest of them (larger neighbours first, then smaller), until
    nothing moves. Every step is a minimum by node (combined before the
    shuffle) and a join back that leaves the links of a hub where they lie
    (:func:`_hung`); the number of steps grows with the logarithm of the
    longest chain. Each step's table is written to the shared folder, which
    cuts the lineage.
    """
    cur = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    before = None
    while True:
        # large star: from each node, its larger neighbours point to its minimum
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _hung(both, materialize(low, label)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), label)
        # small star: smaller neighbours (and the node) point to the smallest
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), label)
        small = _hung(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        nxt = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        cur = materialize(nxt, label)
        seen = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
