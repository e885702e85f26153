"""Connected components of a link table, by alternating stars.

Null ends of a link make it no link; links of a node with itself, repeated links and links in either
direction change nothing.  An empty table has no components.  The links may have any two long columns and
no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, discard, stored_and_seen


def _pair(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("u"), F.col(b).alias("v"))


def _either(rows: DataFrame, *pairs: Column) -> DataFrame:
    """``u, v`` of every pair of every row, from one pass over the rows."""
    return rows.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, stored, with their number and a sum of their hashes that tells whether they changed."""
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    table, seen = stored_and_seen(edges.where("u > v").distinct(), mark)
    return table, (seen["rows"], seen["mark"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest reachable node) of every node with a link to another.

    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours, until
    a round changes nothing.  Minima are pre-aggregated and joined under keys dealt anew, so that a node
    with many links can be split over tasks; each round is one written table, and the one before it goes.
    """
    u, v = links.columns
    edges, mark = _written(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")))
    while True:
        both = _either(edges, _pair("u", "v"), _pair("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(lowest.select(dealt_anew("u").alias("k"), "m"), F.col("u") == F.col("k")).where("v > u")
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.select(dealt_anew("u").alias("k"), "m"), F.col("u") == F.col("k"))
        found, now = _written(_either(joined, _pair("v", "m"), _pair("u", "m")))
        discard(edges)
        if now == mark:
            centres = found.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
        edges, mark = found, now
