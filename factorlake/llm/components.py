"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.llm.scratch import discard, kept


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every end of the links a, b (long).

    Labels spread to neighbours and then jump along themselves until nothing changes; a chain of
    n links takes about log n rounds. Each round is written, so none is recomputed after a loss.
    """
    both = kept(links.select("a", "b").union(links.select("b", "a")).distinct(), "both")
    after = kept(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.lit(0).cast("long").alias("old"), F.least("a", "l").alias("label")), "labels")
    while True:
        labels = after.select("node", "label")
        # a table of its own, so that the joins are between plain scans
        near = kept(both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near")), "near")
        spread = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        spread = kept(spread, "spread")
        discard(near, after)
        jump = spread.select(F.col("node").alias("at"), F.col("label").alias("to"))
        after = kept(spread.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("to", "label")).alias("label")), "labels")
        discard(spread)
        if after.where(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return after.select("node", F.col("label").alias("component"))
