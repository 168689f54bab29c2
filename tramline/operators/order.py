"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..stage import staged


def numbered(df: DataFrame, order: Sequence, name: str = "position") -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in ``order``, which must be total.

    Rows are dealt out by ranges of the order and written, so that a part's number
    stays; each task numbers a part, and offsets come from a table of the parts' sizes.
    """
    dealt, _ = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a part
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")
