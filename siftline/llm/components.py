"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v). Large: every greater neighbour is hung on the least
    neighbour of its node; small: every node and its lesser neighbours on the least of them."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
    hung = both.join(least, "n")
    if large:
        out = hung.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        out = hung.select(F.col("m").alias("u"), F.col("low").alias("v")).union(
            least.select(F.col("n").alias("u"), F.col("low").alias("v"))
        )
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of an edge ``a, b``.

    The edge list is cut by ``checkpoint()`` in each round; the number of rounds grows with the
    logarithm of the longest path. A node of very many edges is aggregated before it is shuffled,
    and its rows of the join can be split, as the other side has one row a node.
    Null ends and loops are ignored; an empty edge list gives an empty table.
    """
    edges = (
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .transform(cut)
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = cut(_stars(_stars(edges, large=True), large=False))
        # Equal sums of a mixed hash of all edges: nothing moved in this round.
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
