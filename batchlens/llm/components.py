"""Connected components of a graph given as a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in ``links`` (a long, b long).

    Each round a node takes the smallest label among itself and its neighbours, and then that
    label's own label, so the distance covered at least doubles. Each round ends in a written table.
    """
    both = scratch.saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = scratch.saved(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    total = F.sum(F.col("component").cast("decimal(38,0)")).alias("total")
    before = labels.agg(total).first()[0]
    while before is not None:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        old, labels = labels, scratch.saved(step.join(jump, "mid").select("id", F.least("mid", "far").alias("component")), "labels")
        scratch.drop(old)
        now = labels.agg(total).first()[0]
        if now == before:
            break
        before = now
    scratch.drop(both)
    return labels
