"""Feature and shard operations: identities, envelopes, three states, batches, predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shard_union(shards: Sequence[DataFrame], identity: Sequence[str]) -> DataFrame:
    """Shards one after the other, missing columns null; of rows with one identity the first shard's stays."""
    rows = None
    for i, shard in enumerate(shards):
        part = shard.withColumn("_shard", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    order = W.partitionBy(*identity).orderBy("_shard", *[c for c in rows.columns if c not in (*identity, "_shard")])
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_shard")


def batches(items: DataFrame, most: int, size: int) -> DataFrame:
    """(id, batch): items in id order; a batch closes before an item that would pass ``most`` items or ``size``.

    The list is a work plan, which one task can hold.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        out, n, held, batch = [], 0, 0, 0
        for s in frame["size"]:
            if n and (n >= most or held + s > size):
                n, held, batch = 0, 0, batch + 1
            n, held = n + 1, held + s
            out.append(batch)
        return pd.DataFrame({"id": frame["id"], "batch": out})

    return items.groupBy().applyInPandas(run, "id long, batch int")


def layer_states(expected: DataFrame, manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """absent (not in the manifest), empty (listed, no features) or present, of each expected layer."""
    both = expected.join(manifest.withColumn("_listed", F.lit(True)), "layer", "left").join(counts, "layer", "left")
    n = F.coalesce("n", F.lit(0))
    return both.select("layer", F.when(F.col("_listed").isNull(), "absent").when(n == 0, "empty").otherwise("present").alias("state"), F.when(F.col("_listed").isNotNull(), n).alias("n"))


def signed_count(terms: DataFrame) -> DataFrame:
    """A count per curse from signed layer counts (curse, position, sign, n): no count where the first term is absent; a later absent term is 0."""
    base = F.max(F.when(F.col("position") == 0, F.col("n").isNull()))
    total = F.sum(F.col("sign") * F.coalesce("n", F.lit(0)))
    return terms.groupBy("curse").agg(F.when(~base, total).alias("n"))


def where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that hold a predicate in which double quotes name columns; a column that the layer lacks is null, so what rests on it alone holds nowhere."""
    named = {n.replace('""', '"') for n in re.findall(r'"((?:[^"]|"")*)"', re.sub(r"'(?:[^']|'')*'", "''", predicate))}
    bare = set(re.findall(r"\b[A-Za-z_][A-Za-z0-9_]*\b", re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", " ", predicate)))
    own = {c.lower() for c in df.columns}
    lacking = sorted(n for n in named | {b for b in bare if b.upper() not in WORDS} if n.lower() not in own)
    text = re.sub(r"'(?:[^']|'')*'|\"((?:[^\"]|\"\")*)\"", lambda m: m.group(0) if m.group(0)[0] == "'" else "`" + m.group(1).replace('""', '"') + "`", predicate)
    return df.withColumns({n: F.lit(None).cast("string") for n in lacking}).filter(text).drop(*lacking)


#: Words of a predicate that are no columns.
WORDS = {"AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "BETWEEN", "TRUE", "FALSE", "ILIKE", "RLIKE", "CAST", "AS", "INT", "DOUBLE", "STRING", "COALESCE"}


def manifest_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Shards' manifests (layer, ..., cell_deg) one after the other; raises where two shards name a layer or cells differ in size."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    twice = [r.layer for r in every.groupBy("layer").count().filter("count > 1").orderBy("layer").limit(5).collect()]
    if twice:
        raise ValueError(f"more than one shard holds {', '.join(twice)}")
    if every.filter("cell_deg is not null").select("cell_deg").distinct().limit(2).count() > 1:
        raise ValueError("the shards' cells differ in size")
    return every


def max_speed_kmh(tag: str):
    """The largest speed of a tag like ``160;200 mph``, in km/h."""
    numbers = F.regexp_extract_all(F.col(tag), F.lit(r"(\d+(?:\.\d+)?)\s*(?:mph|knots|km/h)?"), 1)
    units = F.transform(F.split(F.col(tag), ";"), lambda x: F.when(x.contains("mph"), 1.609344).when(x.contains("knots"), 1.852).otherwise(1.0))
    return F.array_max(F.zip_with(numbers, units, lambda n, u: n.try_cast("double") * u))
