"""Connected components of a graph that is itself a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpack.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of the ``edges`` (src, dst, both long); nodes reach each other iff roots agree.

    Each round every node points at the neighbour, or itself, with the least hash of that round, and the
    edges between the nodes pointed at remain. Fresh hashes make the rounds logarithmic even along chains
    of growing ids. A hub costs no more than its edges: minima combine before the shuffle, and a join's
    large partitions can be split. Nothing is gathered on the driver; each round is cut by a checkpoint.
    Loops, repeated edges and edges with a null end are ignored.
    """
    rest = checkpointed(_edges(edges.where("src IS NOT NULL AND dst IS NOT NULL"), F.col("src"), F.col("dst")))
    rounds: list[DataFrame] = []
    while n := rest.count():
        seed = F.lit(len(rounds))
        both = rest.select("a", "b").union(rest.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v", seed)).alias("v"))
        to = checkpointed(least.select("u", F.when(F.xxhash64("u", seed) <= F.xxhash64("v", seed), F.col("u")).otherwise(F.col("v")).alias("p")), rows=2 * n)
        left = rest.join(to.toDF("a", "pa"), "a").select("pa", "b")
        rest = checkpointed(_edges(left.join(to.toDF("b", "pb"), "b"), F.col("pa"), F.col("pb")), rows=n)
        rounds.append(to)
    if not rounds:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(later: DataFrame, to: DataFrame) -> DataFrame:
        return to.join(later.toDF("p", "q"), "p", "left").select("u", F.coalesce("q", "p").alias("p"))

    return reduce(follow, reversed(rounds[:-1]), rounds[-1]).toDF("node", "root")


def _edges(df: DataFrame, one, other) -> DataFrame:
    return df.where(one != other).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()
