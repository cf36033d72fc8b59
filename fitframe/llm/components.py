"""Connected components of a link table, by alternating large and small stars.

Every round is joins and partially aggregated groupings over tables in the
shared folder: nothing is gathered on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> (node, root): the smallest node linked with it, directly or not.

    Only nodes with a link to another node are listed, roots included.  Null
    ends and links of a node to itself say nothing; repeated links count once;
    an empty table gives an empty result.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links")
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        # every neighbour above a node is tied to the least node around it ...
        ways = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = staged(ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = staged(ways.join(least, "u").where("v > u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        # ... then every node and those below it to the least one below
        least = staged(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        edges = staged(large.join(least, "hi").select(
            F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")),
                              F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.*").where("hi <> lo").distinct(), "small")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select("lo", "lo").distinct())
