import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tramline.llm import shards

from .corpus import empty, frame, odd, texts


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def hashed(key, shard):
    # Spark's xxhash64 of (string, long): the first value's hash seeds the second's
    seed = xxhash.xxh64_intdigest(key.encode(), 42)
    return xxhash.xxh64_intdigest(struct.pack("<q", shard), seed)


def brute(key, weights):
    score = [-w / math.log(((hashed(key, s) >> 11) + 0.5) / (1 << 53)) for s, w in enumerate(weights)]
    return max(range(len(weights)), key=lambda s: (score[s], -s))


def test_equals_brute_force(spark):
    rows = texts()
    got = shards.sharded(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        raw = by[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == brute(str(r.doc_id), [1.0] * 40)
        assert r.grown_shard == brute(str(r.doc_id), [1.0] * 41) and r.grown_shard in (r.shard, 40)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_share_rows(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = Counter(r.shard for r in shards.rendezvous(ids, [1.0, 2.0, 5.0], grown=None).collect())
    assert abs(n[0] / 20_000 - 1 / 8) < 0.02 and abs(n[2] / 20_000 - 5 / 8) < 0.02


def test_slots_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_ROWS", 50)
    ids = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 700).alias("k"))
    got = shards.numbered(ids, "g", ["k"], 3000, 2).groupBy("g").agg(F.countDistinct("slot").alias("d"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.d == r.n == r.m + 1 for r in got)


def test_a_row_written_very_often(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES", 7)
    often = spark.range(500).select(F.lit(1).alias("g"), F.lit("same").alias("k")).unionByName(spark.range(60).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("k")))
    got = shards.numbered(often, "g", ["k"], 560, 1).collect()
    assert sorted(r.slot for r in got) == list(range(560)) and sum(r.k == "same" for r in got) == 500


def test_odd_rows(spark):
    got = shards.sharded(odd(spark)).collect()
    assert len(got) == 10
    assert {r.shard for r in got if r.doc_id is None} and len({r.shard for r in got if r.doc_id is None}) == 1
    assert all(r.size == 16 and r.text_crc32 == 0 for r in got if r.doc_id in (1, 2))
    assert shards.sharded(empty(spark)).collect() == []
