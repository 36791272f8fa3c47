"""Connected components of an edge table, by repeated contraction.

In each round every node points to itself or a neighbour, the edges are
rewritten to the pointed-to nodes and loops and repeats fall away. The first
round follows the edges as given (a to its smallest b, so a star given as leaf to
centre is done), the second goes to smaller nodes, and all later ones to the node
that comes first in a hash order drawn anew: a constant share of the nodes goes
in each expected round, also on long paths. A node with very many edges is a
partial minimum, never a list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm.common import scratch_table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); two nodes have one
    label if and only if a path joins them."""
    spark = edges.sparkSession
    left = edges.where("a <> b").select("a", "b").distinct()
    rounds: list[DataFrame] = []
    while True:
        left = scratch_table(left, "edges")
        if left.isEmpty():
            break
        n = len(rounds)
        if n == 0:
            given = left
            to = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        else:
            def first(c: str):
                return F.struct(F.xxhash64(F.lit(n), c).alias("h") if n > 1 else F.lit(0).alias("h"), F.col(c).alias("id"))
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = both.groupBy(F.col("a").alias("node")).agg(F.min(first("b")).alias("best"))
            to = best.select("node", F.least("best", first("node"))["id"].alias("to"))
        to = scratch_table(to, "contract")
        rounds.append(to)
        # a node without an entry stays
        a = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = left.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")).where("x <> y")
        left = left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if not rounds:
        return spark.createDataFrame([], "node long, label long")
    # nodes that no edge leaves have no entry in the first round
    ends = given.select(F.col("b").alias("node")).distinct().join(rounds[0], "node", "left_anti")
    labels = rounds[0].withColumnRenamed("to", "label").unionByName(ends.withColumn("label", F.col("node")))
    for to in rounds[1:]:
        step = to.select(F.col("node").alias("label"), "to")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch_table(labels, "labels")
