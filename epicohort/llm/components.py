"""Connected components of an edge table by least-label spreading with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import stash


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that can be reached) for the nodes of the
    undirected edges (u, v). Each round gives a node the least label among its
    neighbours and then that label's own label, so chains shorten by halves;
    it ends when no label changes. Only counts come to the driver."""
    pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    pairs = stash(pairs, "edges")
    labels = stash(pairs.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    while True:
        of_neighbour = pairs.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        near = labels.join(of_neighbour, F.col("node") == F.col("u")) \
            .select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        near = stash(near, "near")
        far = near.select(F.col("node").alias("hop"), F.col("next").alias("beyond"))
        after = stash(near.join(far, F.col("next") == F.col("hop"))
                      .select("node", F.least("next", "beyond").alias("root"), "was"), "labels")
        changed = after.where(F.col("root") != F.col("was")).limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
