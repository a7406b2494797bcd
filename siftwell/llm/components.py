"""Connected components over a table of links, by alternating star contractions.

Each round hooks every node's larger neighbours, then its smaller ones, onto its smallest
neighbour; links shrink to stars in a number of rounds that grows with the logarithm of the
longest chain. Every round is one written table in the shared folder, so lost executors cost no
more than a round, and nothing about nodes or links comes to the driver but two totals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import staged, staging_root


def _stars(links: DataFrame, both_ways: bool) -> DataFrame:
    """Hook each node's neighbours onto the smallest of them and the node itself.

    Both ways: a node sees all its neighbours and hooks the larger ones; else it sees, and hooks,
    only smaller ones. Only minima are aggregated, so a node with many neighbours is summed up
    before the shuffle and joined back as one row.
    """
    seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("least"))
    out = seen.join(least, "a").withColumn("least", F.least("a", "least"))
    if both_ways:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component for every node of links(a, b): component is its smallest reachable node."""
    place = f"{staging_root(links.sparkSession)}/links-{uuid.uuid4().hex}"
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links", f"{place}/0")
    mark = None
    for r in range(1, max_rounds + 1):
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == mark or not total[0]:
            break
        mark = tuple(total)
        now = staged(_stars(_stars(now, True), False), "links", f"{place}/{r % 2}")  # the table before the last is done with
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
