"""Connected components of an edge table, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component): the least node that is reachable. Nodes without edges have no row.

    Each round takes the least label among the neighbours and then the label of that label, so labels travel in
    doubling steps; a round is aggregated joins whose result is written, and the rounds end when no label falls.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                     .select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low")))
        hooked = (labels.join(near, "node")
                  .select("node", F.col("component").alias("was"), F.least("component", "low").alias("component")))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        nxt = written(hooked.join(up, "component", "left")
                      .select("node", "was", F.least("component", "above").alias("component")), "labels")
        if nxt.filter("was <> component").isEmpty():
            return nxt.select("node", "component")
        labels = nxt.select("node", "component")
