"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, materialize, salted_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's neighbours to the least node around it: the greater ones (large) or the smaller ones. May repeat edges."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = salted_join(both, least, ["u"], "inner", 8)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where(F.col("u") != F.col("v"))


def _is_forest(edges: DataFrame) -> bool:
    """Whether each node is either below one root or a root; no step changes that any more."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("root"))
    return per.where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("root") == 0))).isEmpty()


def star_forest(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type -> edges (u, v), u > v, that connect the same nodes; each u below its component's least node.

    Each round is written to the shared folder, and the files of the one before go. A forest with more edges may be carried on.
    """
    cur = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_forest(cur):
        old, cur = cur, materialize(_star(_star(cur, True), False).distinct(), "edges")
        discard(old)
        # Shuffle files go when their plans are collected, which a driver with little to do would not do for long.
        gc.collect()
        edges.sparkSession.sparkContext._jvm.System.gc()
    return cur


def roots_of(forest: DataFrame) -> DataFrame:
    """(node, root) for every node of a star forest."""
    return forest.select("u", "v").union(forest.select("v", "v")).toDF("node", "root").groupBy("node").agg(F.min("root").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type -> (node, root) for every node that has an edge; root is the least node reached.

    Self-loops and repeated edges do no harm; no edges give an empty result.
    """
    return roots_of(star_forest(edges))
