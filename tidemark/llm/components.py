"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Every round a node takes the smallest label among its own and its neighbours'
    and then the label of that label, so chains halve.  Labels of a node are
    combined map-side, hence a hub costs each task one row; the joins of links and
    labels shuffle both sides, so that adaptive execution can split a hub's links.
    Each round is checkpointed; only whether a label moved reaches the driver.
    """
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label")
    labels = checkpointed(labels.withColumn("moved", F.lit(True)))
    while not labels.where("moved").isEmpty():
        seen = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        best = labels.select("node", "label", F.col("label").alias("own")).unionByName(seen).groupBy("node").agg(F.min("label").alias("label"), F.min("own").alias("own"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = best.join(up.hint("merge"), "label").select("node", F.least("label", "above").alias("label"), "own")
        labels = checkpointed(jumped.select("node", "label", (F.col("label") != F.col("own")).alias("moved")))
    return labels.select("node", F.col("label").alias("component"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; only components that the new links meet are worked on."""
    ends = links.select(F.col("a").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")))
    known = checkpointed(labels.unionByName(ends).groupBy("node").agg(F.min("component").alias("component")))
    for end in ("a", "b"):
        named = known.select(F.col("node").alias(end), F.col("component").alias("named"))
        links = links.join(named.hint("merge"), end).withColumn(end, F.col("named")).drop("named")
    moved = components(links.where("a != b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return checkpointed(known.join(moved.hint("merge"), "component", "left").select("node", F.coalesce("now", "component").alias("component")))
