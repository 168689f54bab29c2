"""Sinks: sorted JSON, CSV, archives, clustered Parquet, manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """A line a row: JSON with sorted keys, in the order of ``key``."""
    return df.select(*key, F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("line")).orderBy(*key).select("line")


def csv_lines(df: DataFrame) -> DataFrame:
    """RFC 4180 fields: quoted where they hold a comma, a quote or a line end; null is blank."""

    def field(c: str):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return df.select(F.concat_ws(",", *[field(c) for c in df.columns]).alias("line"))


def archive(tables: dict[str, list[list[str]]]) -> bytes:
    """A stored zip of small CSV tables with a fixed time, so equal tables give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in sorted(tables):
            text = "".join(",".join('"' + f.replace('"', '""') + '"' if any(c in f for c in ',"\r\n') else f for f in row) + "\r\n" for row in tables[name])
            z.writestr(zipfile.ZipInfo(f"{name}.txt", (1980, 1, 1, 0, 0, 0)), text.encode())
    return out.getvalue()


def clustered(df: DataFrame, path: str, x: str, y: str, size: float, files: int) -> None:
    """Parquet sorted by cell, so that the row groups' statistics prune a box."""
    cell = [F.floor(F.col(x) / size), F.floor(F.col(y) / size)]
    df.repartitionByRange(files, *cell).sortWithinPartitions(*cell).write.parquet(path)


def manifest(df: DataFrame, layer: str) -> DataFrame:
    """Rows, bytes of their JSON, digest and partial flag of each layer.

    The digest is over counts and two sums of row digests, so neither order nor partitions matter and equal rows count each;
    a layer is partial if a row says so in a column ``partial``.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    rows = df.select(layer, F.octet_length(line).alias("_b"), F.xxhash64(line).alias("_x"), F.xxhash64(F.sha2(line, 256)).alias("_y"), (F.col("partial") if "partial" in df.columns else F.lit(False)).alias("_p"))
    half = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    out = rows.groupBy(layer).agg(F.count("*").alias("n"), F.sum("_b").alias("bytes"), half("_x").alias("_x"), half("_y").alias("_y"), F.bool_or("_p").alias("partial"))
    return out.select(layer, "n", "bytes", F.sha2(F.concat_ws(":", "n", "_x", "_y"), 256).alias("digest"), "partial")
