"""Connected components of an edge table, with DataFrame functions only.

Alternating star contractions: each node first hands its larger neighbours to
its smallest one, then each node hands its smaller neighbours (and itself) to the
smallest of them.  Both keep components whole and end in stars around each component's smallest
node.  Every step is an aggregate and a join on a node; a hub's neighbours
are combined before the shuffle, and a hub's side of the join can be split at run time.
Each round is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelearn.session import materialize


def _smallest(edges: DataFrame, more: bool) -> DataFrame:
    """Edges (a, b) with each node's smallest neighbour ``m``; the node itself counts if it is smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    if more:
        least = least.select("a", F.least("a", "m").alias("m"))
    return edges.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).select("a", "b", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is its smallest node.

    Edges may point either way, repeat, or loop; those with a null end are left out.
    An empty edge table gives no rows.  Ids may be of any ordered type.  Rounds grow
    with the logarithm of a component's width; more than ``most_rounds`` raise an error.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, seen = materialize(edges, "edges"), None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _smallest(both, True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        stars = _smallest(large, False)
        small = stars.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(stars.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == seen:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
