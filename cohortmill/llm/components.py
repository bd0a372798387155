"""Connected components of a graph given by links, by contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import materialise


def _follow(df: DataFrame, col: str, parent: DataFrame) -> DataFrame:
    """`col` replaced by its parent where it has one."""
    p = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(p, df[col] == p["_n"], "left").withColumn(col, F.coalesce("_r", col)).drop("_n", "_r")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of a link, the smallest node that links reach from it.

    Each round hooks every node to its smallest neighbour, follows those hooks twice and contracts the links; what is left
    is written to the shared folder. Rounds grow with the logarithm of the longest chain. Links that hold a null or join
    a node to itself are ignored; no links give no rows.
    """
    left = materialise(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct())
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root"))
        hook = materialise(hook)
        hook = materialise(_follow(hook, "root", hook))
        hook = materialise(_follow(hook, "root", hook))
        labels = hook if labels is None else materialise(_follow(labels, "root", hook))
        left = _follow(_follow(left, "a", hook), "b", hook)
        left = materialise(left.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
