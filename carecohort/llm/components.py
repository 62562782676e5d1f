"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecohort.storage import written


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct links (node, to) from the greater to the smaller name."""
    return rows.where(F.col("node") != F.col("to")).select(
        F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")
    ).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
    least = both.groupBy("node").agg(F.least(F.min("to"), F.min("node")).alias("_least"))
    greater = links.select(F.col("to").alias("node"), F.col("node").alias("_other"))
    return _pairs(greater.join(least, "node").select(F.col("_other").alias("node"), F.col("_least").alias("to")))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("node").agg(F.min("to").alias("_least"))
    smaller = links.join(least, "node").select(F.col("to").alias("node"), F.col("_least").alias("to"))
    return _pairs(smaller.union(least.select("node", F.col("_least").alias("to"))))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is its smallest node.

    Links are drawn in to the smallest node by large and small stars in turn, until only
    stars are left: their number of rounds grows with the logarithm of a chain's length, and a
    star takes one.  Every round is written, so lost executors cost a re-read.  Nodes linked with
    nothing but themselves are components of their own.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("to"))
    stars, seen = written(_pairs(ends), "links"), None
    while True:
        stars = written(_small_star(_large_star(stars)), "links")
        # order does not matter to either sum; equal sums of two seeds end the rounds
        now = stars.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)")),
            F.sum(F.xxhash64(F.lit(1), "node", "to").cast("decimal(38,0)")),
        ).first()
        if now == seen:
            break
        seen = now
    nodes = ends.select("node").union(ends.select("to")).distinct()
    return written(
        nodes.join(stars.select("node", F.col("to").alias("component")), "node", "left")
        .withColumn("component", F.coalesce("component", "node")),
        "components",
    )
