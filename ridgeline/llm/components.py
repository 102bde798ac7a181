"""Connected components of an edge list, as repeated joins.

Alternating stars: every node hands its larger neighbours to the smallest node
it knows, then its smaller ones, until each node is tied to the smallest of its
component alone. No component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import stored


def components(edges: DataFrame, at: str, name: str) -> DataFrame:
    """(a, b) to (node, component) for every node of an edge; ``component`` is the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    e = edges.where("a <> b").select(big.alias("u"), small.alias("v")).distinct()
    e, seen, turn = stored(e, at, f"{name}-0"), None, 0
    while True:
        print_ = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == print_:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, turn = print_, turn + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), at, f"{name}-{turn}")
