"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS = 40
#: Rows of one shard that are numbered by one task, about.
BLOCK_ROWS = 20_000
#: Copies of a row that one list holds.
COPIES = 10_000


def scores(key: Column, weights: Sequence[float]) -> Column:
    """(score, -shard) of every shard for a key: -weight / ln(u), u a hash of key and shard in (0, 1)."""
    table = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(float(w)).alias("w")) for s, w in enumerate(weights)])

    def score(x: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, x["s"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-x["w"] / F.ln(unit)).alias("score"), (-x["s"]).alias("minus"))

    return F.transform(table, score)


def rendezvous(df: DataFrame, weights: Sequence[float], key: str = "doc_id", grown: float | None = 1.0) -> DataFrame:
    """Adds shard (the highest score; ties to the smaller shard) and, if asked, grown_shard: with one more shard of that weight.

    Key, shard numbers and weights alone decide, so a shard that is added takes
    rows only into itself.  A null key is a key like any other.  Weights must be
    positive.  No shuffle.
    """
    if not weights or min(weights) <= 0 or (grown is not None and grown <= 0):
        raise ValueError("shards need positive weights")
    taken = key if key in df.columns else None
    if taken is None:
        raise ValueError(f"no column {key}")
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    best = F.array_max(scores(own, weights))
    out = df.withColumn("_best", best)
    extra = "shard"
    out = out.withColumn("shard", (-F.col("_best.minus")).cast("int"))
    if grown is not None:
        last = F.lit(len(weights)).cast("long")
        unit = (F.shiftrightunsigned(F.xxhash64(own, last), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        more = -F.lit(float(grown)) / F.ln(unit)
        out = out.withColumn("grown_shard", F.when(more > F.col("_best.score"), F.lit(len(weights))).otherwise(F.col(extra)).cast("int"))
    return out.drop("_best")


def numbered(df: DataFrame, group: str, order: Sequence[str], total: int, groups: int, name: str = "slot") -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each group, without gaps, in hashed blocks of about BLOCK_ROWS different rows.

    Equal rows are interchangeable: they are counted as one before anything is
    dealt, and made again from their number, so however often a row
    repeats, no task numbers its copies.  Offsets come from a table of block counts.
    """
    blocks = max(1, -(-total // (groups * BLOCK_ROWS)))
    own = list(df.columns)
    kinds = df.groupBy(*own).agg(F.count("*").alias("_copies")).withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = kinds.groupBy(group, "_block").agg(F.sum("_copies").alias("_rows"))
    offsets = counts.select(group, "_block", (F.sum("_rows").over(W.partitionBy(group).orderBy("_block")) - F.col("_rows")).alias("_before"))
    within = F.sum("_copies").over(W.partitionBy(group, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("_copies")
    placed = kinds.withColumn("_at", within).join(offsets, [group, "_block"]).withColumn("_first", F.col("_before") + F.col("_at"))
    # copies in two steps, so that a row's list is short
    step = F.lit(COPIES)
    parts = placed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / step))))
    each = F.sequence(F.col("_part") * step, F.least((F.col("_part") + 1) * step, F.col("_copies")) - 1)
    return parts.withColumn("_copy", F.explode(each)).select(*own, (F.col("_first") + F.col("_copy")).cast("long").alias(name))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard of every row, over equal shards.

    size is the text's UTF-8 bytes plus 16 and text_crc32 its unsigned checksum;
    a null text is empty.  The law is ``key``.  Null ids are one key.  Rows that
    repeat an id share its shard and have slots of their own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = rendezvous(rows, [1.0] * shards, id_col)
    out = numbered(placed, "shard", [id_col, "text_crc32", "size"], docs.count(), shards)
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
