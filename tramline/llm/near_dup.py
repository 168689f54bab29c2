"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import _text as T
from ._job import dropped, given, known, small_batches, staged

WORDS = 5
PERCENT = 75
BANDS, ROWS = 64, 6
HUB_ROUNDS = 1
SIGMAS = 4.5
_U = np.uint64


def shingles(chunk: T.Chunk, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles, by text, then hash; a shorter text is one shingle."""
    words = chunk.word_hashes()
    at, hashes = chunk.windows(words, k)
    doc = chunk.doc_of_word()[at]
    short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < k))
    if len(short):
        own = np.zeros(len(short), _U)
        for i, d in enumerate(short):
            a, b = chunk.word_offsets[d], chunk.word_offsets[d + 1]
            own[i] = T.window_hashes(np.append(words[a:b], _U(b - a)), int(b - a) + 1)[0]
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, own])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[first], hashes[first]


def sketches(doc: np.ndarray, hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    """Fast similarity sketch of each set: ``size`` coordinates a set.

    In round i < size each element goes to a hashed bin with a hashed value; in
    round size + j every element goes to bin j.  A coordinate keeps the smallest
    (round, value) it got, so every coordinate of a set that isn't empty fills by
    round 2 * size.  Only sets with empty coordinates enter the next round.
    """
    out = np.full(n * size, ~_U(0))
    low = (_U(1) << _U(52)) - _U(1)
    seeds = T.seeded(101, 2 * size)
    live_doc, live = doc, hashes
    for i in range(size):
        if not len(live):
            return out.reshape(n, size)
        h = T.mix(live ^ seeds[i])
        at = live_doc * size + ((h >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
        value = (_U(i) << _U(52)) | (T.mix(h) & low)
        np.minimum.at(out, at, value)
        need = (out.reshape(n, size) == ~_U(0)).any(axis=1)
        keep = need[live_doc]
        live_doc, live = live_doc[keep], live[keep]
    rest = out.reshape(n, size)
    for j in range(size if len(live) else 0):
        empty = rest[:, j] == ~_U(0)
        keep = empty[live_doc]
        if keep.any():
            value = (_U(size + j) << _U(52)) | (T.mix(live[keep] ^ seeds[size + j]) & low)
            np.minimum.at(rest[:, j], live_doc[keep], value)
    return rest


def _band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(T.seeded(202, bands), (len(sketch), bands)).copy()
    for r in range(rows):
        key = T.mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _nibbles(sketch: np.ndarray) -> np.ndarray:
    """Four hashed bits of each coordinate, 16 coordinates to a word."""
    n, size = sketch.shape
    bits = np.zeros((n, -(-size // 16) * 16), _U)
    bits[:, :size] = T.mix(sketch) & _U(15)
    return (bits.reshape(n, -1, 16) << (_U(4) * np.arange(16, dtype=_U))).sum(axis=2, dtype=_U)


def _sketched(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, chunk in T.chunks(batch, "text", lower=True):
                doc, hashes = shingles(chunk, k)
                key = _band_keys(sketches(doc, hashes, chunk.n_docs, bands * rows), bands, rows)
                count = np.bincount(doc, minlength=chunk.n_docs)
                one, two = np.zeros(chunk.n_docs, _U), np.zeros(chunk.n_docs, _U)
                np.add.at(one, doc, T.mix(hashes ^ _U(0x5851F42D4C957F2D)))
                np.add.at(two, doc, T.mix(hashes ^ _U(0x14057B7EF767814F)))
                full = count > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_k")[lo:hi], batch.column("_t")[lo:hi], pa.array(count), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), T.list_array(key[full].reshape(-1).view(np.int64), np.where(full, bands, 0), pa.int64())],
                    ["_k", "_t", "n", "d1", "d2", "bands"],
                )

    return run


def _sets(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, chunk in T.chunks(batch, "text", lower=True):
                doc, hashes = shingles(chunk, k)
                sketch = sketches(doc, hashes, chunk.n_docs, bands * rows)
                key, bits = _band_keys(sketch, bands, rows), _nibbles(sketch)
                each = np.ones(chunk.n_docs, int)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("v")[lo:hi],
                        T.list_array(hashes.view(np.int64), np.bincount(doc, minlength=chunk.n_docs), pa.int64()),
                        T.list_array(key.reshape(-1).view(np.int64), each * bands, pa.int64()),
                        T.list_array(bits.reshape(-1).view(np.int64), each * bits.shape[1], pa.int64()),
                    ],
                    ["v", "grams", "bands", "bits"],
                )

    return run


def _unequal(a: str, b: str) -> Column:
    """How many coordinates differ in their four bits."""

    def fold(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, fold), F.lit(0), lambda total, x: total + x)


def most_unequal(size: int, percent: int, sigmas: float = SIGMAS) -> int:
    """Differing coordinates that a pair at the threshold stays within, by ``sigmas`` standard deviations."""
    p = (1 - percent / 100) * 15 / 16
    return int(np.ceil(size * p + sigmas * np.sqrt(size * p * (1 - p))))


def linked_rows(docs: DataFrame, k: int, percent: int, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, _t, n, group, component, n_links) of every row: its id and text hash, its set's size, its component (null: no set) and the smallest id in that.

    Equal sets are one class, numbered as the classes are written; an id may be in several.  A class and
    another meet if a band of their sketches is equal; at the threshold a pair
    is missed with probability (1 - 0.75**rows)**bands, 4e-6 as set.  First each class
    is held against the heaviest class it meets, that is the one with the most
    partners over all buckets, near the middle of its group; then, in buckets whose classes are
    still in several components, classes outside the bucket's largest component
    are held against one member of it, HUB_ROUNDS times; after that every pair
    across components that still share a bucket is held, if four bits of each of
    its bands * rows coordinates agree to within SIGMAS standard deviations of
    a pair at the threshold (a further 3e-6).  So a bucket of one group makes links in proportion to its rows, and
    no verdict rests on transitivity that wasn't verified.  Links are confirmed
    on whole sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(known(id_col).alias("_k"), F.xxhash64(text).alias("_t"), text.alias("text"))
    made, made_at = staged(texts.mapInArrow(_sketched(k, bands, rows), "_k long, _t long, n long, d1 long, d2 long, bands array<long>"), "sketches")
    full = made.filter("n > 0")
    # a table of its own, so that the joins below can split a class with very many copies; v names a class, as an id may belong to several
    first = full.groupBy("d1", "d2").agg(F.min(F.struct("_k", "_t")).alias("first"))
    classes, _ = staged(first.select("d1", "d2", F.monotonically_increasing_id().alias("v"), F.col("first._k").alias("rep"), F.col("first._t").alias("text_key")), "classes")
    named = classes.select("d1", "d2", "v", F.col("rep").alias("_k"), F.col("text_key").alias("_t"))
    # rows that repeat a class's first id and text have the same bands: one of them is enough, found on the join's own keys
    keyed = full.join(named, ["d1", "d2", "_k", "_t"]).groupBy("d1", "d2", "_k", "_t", "v").agg(F.any_value("bands").alias("bands")).select("v", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    plain, plain_at = staged(keyed.join(shared, "key"), "buckets")
    weight = plain.groupBy("v").agg(F.sum("size").alias("weight"))
    met, met_at = staged(plain.join(weight, "v").select("key", "v", "weight"), "buckets")
    hub = met.groupBy("key").agg(F.max(F.struct("weight", F.col("v").alias("hub"))).alias("hub"))
    ids = named.join(met.select("v").distinct(), "v").select("_k", "_t", "v")
    held = texts.join(ids, ["_k", "_t"]).dropDuplicates(["_k", "_t"]).select("v", "text")
    grams, grams_at = staged(held.mapInArrow(_sets(k, bands, rows), "v long, grams array<long>, bands array<long>, bits array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = grams.select(F.col("v").alias("a"), F.col("grams").alias("ga"))
        right = grams.select(F.col("v").alias("b"), F.col("grams").alias("gb"))
        both = pairs.join(left, "a").join(right, "b")
        near = both.filter(F.least(F.size("ga"), F.size("gb")) * 100 >= F.greatest(F.size("ga"), F.size("gb")) * percent)
        inter = near.withColumn("i", F.size(F.array_intersect("ga", "gb"))).withColumn("u", F.size("ga") + F.size("gb") - F.col("i"))
        return inter.filter(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")

    def unsettled(label: DataFrame) -> tuple[DataFrame, str]:
        """Rows of the buckets whose classes are in several components; main: the bucket's largest."""
        now = met.join(label, "v", "left").select("key", "v", "weight", F.coalesce("label", "v").alias("label"))
        sizes = now.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("parts"))
        return staged(now.join(sizes.filter("parts > 1").select("key", F.col("most.label").alias("main")), "key"), "open")

    best = met.join(hub, "key").filter("v <> hub.hub").groupBy("v").agg(F.max("hub").alias("hub"))
    tried, tried_at = staged(best.select(F.greatest("v", "hub.hub").alias("a"), F.least("v", "hub.hub").alias("b")).distinct(), "pairs")
    links, links_at = staged(confirmed(tried), "links")
    label, label_at = components(links)
    spent = [tried_at, label_at]
    for _ in range(HUB_ROUNDS):
        open_, open_at = unsettled(label)
        hubs = open_.filter("label = main").groupBy("key").agg(F.max(F.struct("weight", "v")).alias("hub"))
        star = open_.filter("label <> main").join(hubs, "key").select("v", "hub")
        pairs = star.select(F.greatest("v", "hub.v").alias("a"), F.least("v", "hub.v").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs, pairs_at = staged(pairs, "pairs")
        more, more_at = staged(confirmed(pairs), "links")
        tried, links = tried.unionByName(pairs), links.unionByName(more)
        label, label_at = components(links)
        spent += [open_at, pairs_at, label_at]
    open_, open_at = unsettled(label)
    more, more_at = staged(_across(open_, grams, bands * rows, percent), "links")
    every = links.unionByName(more)
    final, final_at = components(every)
    degree = every.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n_links"))
    linked = classes.select("v", "rep").join(final, "v").join(degree, "v")
    least = linked.groupBy("label").agg(F.min("rep").alias("component"))
    grouped, _ = staged(linked.join(least, "label").select("v", "label", "component", "n_links"), "groups")
    ruled = classes.join(grouped, "v", "left").select("d1", "d2", F.coalesce("label", "v").alias("group"), F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    none = F.lit(None).cast("long")
    alone = made.filter("n = 0").select("_k", "_t", "n", none.alias("group"), F.col("_k").alias("component"), F.lit(0).cast("long").alias("n_links"))
    out = full.join(ruled, ["d1", "d2"]).select("_k", "_t", "n", "group", "component", "n_links").unionByName(alone)
    dropped(spark, plain_at, met_at, grams_at, open_at, *spent)
    return out


def _across(open_: DataFrame, grams: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between classes of different components that still share a bucket.

    Sketch bits are compared first, by semi-joins that return rows of a bucket and no
    pairs; only rows with a partner are given their sets, and the join that
    compares those emits confirmed links alone.
    """

    def sides(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        every = ("v", "label", *columns)
        left = rows.filter("label <> main").select("key", *(F.col(c).alias(f"{c}_x") for c in every))
        return left, rows.select("key", "main", *(F.col(c).alias(f"{c}_y") for c in every))

    apart = F.expr("label_x <> label_y and (label_y = main or v_x < v_y)")
    alike = (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & (_unequal("bits_x", "bits_y") <= most_unequal(size, percent))
    light = open_.join(grams.select("v", F.size("grams").alias("n"), "bits"), "v")
    left, right = sides(light, "n", "bits")
    meet = (left["key"] == right["key"]) & apart & alike
    met_x = left.join(right, meet, "left_semi").select("key", F.col("v_x").alias("v"))
    met_y = right.join(left, meet, "left_semi").select("key", F.col("v_y").alias("v"))
    some, some_at = staged(met_x.unionByName(met_y).distinct(), "partners")
    heavy = open_.join(some, ["key", "v"]).join(grams.select("v", F.size("grams").alias("n"), "bands", "bits", "grams"), "v")
    left, right = sides(heavy, "n", "bands", "bits", "grams")
    once = F.array_min(F.array_intersect("bands_x", "bands_y")) == left["key"]
    inter = F.size(F.array_intersect("grams_x", "grams_y"))
    near = inter * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    pairs = left.join(right, (left["key"] == right["key"]) & apart & alike & once & near)
    return pairs.select(F.greatest("v_x", "v_y").alias("a"), F.least("v_x", "v_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of texts whose k-word shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``id_col``, n_shingles, n_links (verified links between different
    sets that the search used), component_id, kept: one row per input row.  See
    linked_rows() for the search.

    Null or wordless texts have no shingles and no links.  A null id is compared
    as the largest id and returned as null.  Rows are judged by their texts: rows
    that repeat an id with another text belong to that text's component, so an id
    may be kept for one of its texts and not for another.
    """
    found = linked_rows(docs, k, percent, bands, rows, id_col, text_col)
    return found.select(given("_k").alias(id_col), F.col("n").alias("n_shingles"), "n_links", given("component").alias("component_id"), (F.col("_k") == F.col("component")).alias("kept"))


def distinct_texts(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that near_duplicates() keeps: of each component the rows of the smallest id in it.

    Rows that repeat id and text are one document and stay together; a component's
    smallest id may stand for several of its texts, of which the smallest hash stays.
    """
    own = "_" * (1 + max(map(len, docs.columns)))  # names that no column has
    found = linked_rows(docs, k, percent, id_col=id_col, text_col=text_col).filter("_k = component")
    full, bare = found.filter("n > 0"), found.filter("n = 0")
    one = full.groupBy("group").agg(F.min(F.struct("_k", "_t")).alias("one")).select("one.*")
    ids = one.unionByName(bare.select("_k", "_t").distinct()).select(F.col("_k").alias(own), F.col("_t").alias(own + "t"))
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(ids, (known(id_col) == F.col(own)) & (text == F.col(own + "t")), "left_semi")
