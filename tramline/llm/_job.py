"""What the operators share on the driver: stage tables, ids, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import dropped, importable, new_path, shared_folder, staged

__all__ = ["BATCH_ROWS", "NULL_ID", "dropped", "given", "known", "new_path", "positional", "shared_folder", "small_batches", "staged", "table"]

#: Where a null id sorts, and the id by which it is compared: after all others.
NULL_ID = (1 << 63) - 1
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts can hold, and lets workers import the kernels."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def known(name: str) -> Column:
    """An id column with nulls compared as NULL_ID."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def given(name: str) -> Column:
    """The inverse of known()."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def positional(df: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """``df`` with columns _c0, _c1 ... , which no added name can meet; the text column's name there; the schema."""
    out = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    name = f"_c{df.columns.index(text_col)}"
    if dict(out.dtypes)[name] != "string":
        raise TypeError(f"{text_col} is no string column")
    return out, name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
