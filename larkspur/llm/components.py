"""Connected components by minimum labels with pointer jumping, as joins and grouped minima over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import written


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id reachable.

    A hot id costs no more than its edges: its minimum is combined before the shuffle, and its label reaches its edges
    through a join whose large partitions may be split. Each round is written, so a lost executor repeats one round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null")
    both = written(both.distinct(), "edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("l"))
        jump = labels.select(F.col("id").alias("l"), F.col("component").alias("jump"))
        stepped = written(lower.join(jump, "l", "left").select("id", "was", F.least("l", F.coalesce("jump", "l")).alias("component")), "labels")
        changed = stepped.where(F.col("was") != F.col("component")).limit(1).count()
        labels = stepped.select("id", "component")
        if not changed:
            return labels
