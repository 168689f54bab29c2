"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import dropped, staged


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(v, label) of every end of ``links`` (a, b): label is the smallest end reachable; and its folder.

    Each pass gives a vertex the smallest label among itself and its neighbours,
    hooks the old label onto it and then jumps to the label's label, so the
    passes grow with the logarithm of the longest chain.  Every pass is a table
    in the shared folder.
    """
    spark = links.sparkSession
    both, both_at = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "ends")
    label, at = staged(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("near"))
        step = label.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        hooks = step.filter("next < label").groupBy(F.col("label").alias("v")).agg(F.min("next").alias("hook"))
        # a table of its own, so that the join below can split a label with very many vertices
        moved, moved_at = staged(step.join(hooks, "v", "left").select("v", F.col("label").alias("old"), F.least("next", F.coalesce("hook", "next")).alias("next")), "hooked")
        up = moved.select(F.col("v").alias("next"), F.col("next").alias("up"))
        jumped = F.least("next", F.coalesce("up", "next"))
        new, new_at = staged(moved.join(up, "next", "left").select("v", jumped.alias("label"), (jumped < F.col("old")).alias("moved")), "labels")
        done = new.filter("moved").isEmpty()
        dropped(spark, at, moved_at)
        label, at = new.select("v", "label"), new_at
        if done:
            dropped(spark, both_at)
            return label, at


def clusters(vertices: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(key, cluster) of all vertices: the smallest key each is linked with, itself included."""
    label, _ = components(links)
    out = vertices.select(key).join(label.withColumnRenamed("v", key), key, "left")
    return out.select(key, F.coalesce("label", key).alias("cluster"))
