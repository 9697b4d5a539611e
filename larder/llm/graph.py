"""Connected components of an undirected edge list, as DataFrame rounds.

Every vertex takes the smallest label among itself and its neighbours, then the
label of its label (pointer jumping), until nothing changes. Each round is one
aggregation and two joins on vertices; labels are written to shared storage
after every round, and nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import drop_path, shared_dir, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label) for every vertex with an edge; label is the component's smallest vertex."""
    spark = edges.sparkSession
    links = edges.select(F.col(a).alias("v"), F.col(b).alias("w")).filter("v <> w")
    path = shared_dir(spark, "links")
    both = stored(links.union(links.select("w", "v")), path)
    old_path = shared_dir(spark, "labels")
    labels = stored(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("label")), old_path)
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("near")), "w").groupBy("v").agg(F.min("near").alias("near"))
        best = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("best"))
        # Two jumps along the labels: the label of the label of the best label.
        once = labels.select(F.col("v").alias("best"), F.col("label").alias("jump"))
        twice = labels.select(F.col("v").alias("jump"), F.col("label").alias("far"))
        new_path = shared_dir(spark, "labels")
        moved = stored(best.join(once, "best").join(twice, "jump").select("v", "label", F.least("best", "jump", "far").alias("next")), new_path)
        changed = moved.filter("label <> next").limit(1).count()
        drop_path(spark, old_path)
        labels, old_path = moved.select("v", F.col("next").alias("label")), new_path
        if not changed:
            drop_path(spark, path)
            return labels
