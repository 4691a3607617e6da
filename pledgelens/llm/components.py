"""Connected components of a table of links, by the smallest label among neighbours with pointer jumping.

Every round is a table in the shared folder. Links and labels are joined as lookups, so a node with very many links and a
label that very many nodes share are answered from a small broadcast or spread, and do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.operators.lookup import lookup_join

from .common import written


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """``(a, label)``: per linked node its component, named by the smallest node reachable over the links ``a``, ``b``."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.distinct(), "components-links")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "components-0")
    for turn in range(1, rounds):
        # The smallest label among the neighbours, then the label of that label.
        asked = lookup_join(edges, labels.select(F.col("a").alias("b"), "label"), ["b"], "inner")
        near = asked.groupBy("a").agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "a").select("a", "label", F.least("label", "near").alias("lower")), f"components-near-{turn}")
        jump = lower.select(F.col("a").alias("lower"), F.col("lower").alias("further"))
        after = lookup_join(lower, jump, ["lower"]).select("a", "label", F.coalesce(F.least("lower", "further"), F.col("lower")).alias("new"))
        after = written(after, f"components-{turn}")
        changed = after.where("new < label").limit(1).count()
        labels = after.select("a", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
