"""Connected components of a distributed list of links.

Defined results: an empty list has no components; repeated links, links in both
directions and links of a node to itself make no difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Tables, hot_values, salted_join


def components(spark: SparkSession, tables: Tables, name: str, links: DataFrame) -> DataFrame:
    """(set, comp) for each end of ``links`` (a, b); comp is the component's least end.

    Links hang from labels: each round every node takes the least label among
    its own and its neighbours', then the label of that label.  Labels at least
    halve the remaining distance, so rounds grow with the logarithm of the
    longest chain.  Each round is a written table.  Nodes with very many links
    and labels with very many nodes are salted in the joins.
    """
    both = tables.write(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-both")
    labels = tables.write(both.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.col("set")).alias("comp"), F.count("*").alias("degree")), f"{name}-labels-0")
    hubs = hot_values(labels, "set", "degree")
    labels = labels.select("set", "comp")
    step = 0
    while True:
        near = salted_join(both, labels.select(F.col("set").alias("b"), F.col("comp").alias("near")), "b", hubs, "a").groupBy(F.col("a").alias("set")).agg(F.min("near").alias("near"))
        up = labels.select(F.col("set").alias("comp"), F.col("comp").alias("up"))
        after = salted_join(labels, up, "comp", hot_values(labels, "comp"), "set").join(near, "set").select("set", F.least("comp", "up", "near").alias("comp"), (F.least("up", "near") < F.col("comp")).alias("moved"))
        step += 1
        after = tables.write(after, f"{name}-labels-{step}")
        moved = after.where("moved").limit(1).count()
        tables.drop(f"{name}-labels-{step - 1}")
        labels = after.select("set", "comp")
        if not moved:
            tables.drop(f"{name}-both")
            return labels
