"""Benchmark decontamination: shared-token seeds, then greedy string tiling of each pair they join."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._job import new_path, positional, small_batches

#: Tokens that a match needs; seeds have this length too.
MATCH = 4
#: Share of a benchmark item's tokens that tiles must cover.
COVERAGE = 0.6
#: Benchmark tokens in one block: what a task holds of the benchmark.
BLOCK_TOKENS = 2_000_000
#: Letters and digits; everything else in ASCII parts tokens.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_U = np.uint64


def tile(pattern: Sequence[int], text: Sequence[int], least: int = MATCH) -> list[tuple[int, int, int]]:
    """Tiles (pattern place, text place, length): greedy string tiling with running Karp-Rabin hashes.

    The longest matches between unmarked tokens are marked first, ties by place
    in the pattern, then in the text; then shorter ones, down to ``least``.
    """
    used_p, used_t = [False] * len(pattern), [False] * len(text)
    tiles: list[tuple[int, int, int]] = []
    while matches := _matches(pattern, text, used_p, used_t, least):
        longest = max(n for _, _, n in matches)
        for p, t, n in sorted(matches):
            if n == longest and not any(used_p[p : p + n]) and not any(used_t[t : t + n]):
                used_p[p : p + n] = used_t[t : t + n] = [True] * n
                tiles.append((p, t, n))
    return tiles


_MODULUS = (1 << 61) - 1
_RADIX = 1_000_003


def _rolling(tokens: Sequence[int], used: Sequence[bool], k: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each run of k unmarked tokens."""
    high = pow(_RADIX, k, _MODULUS)
    value = run = 0
    for i, x in enumerate(tokens):
        if used[i]:
            value = run = 0
            continue
        value = (value * _RADIX + x) % _MODULUS
        run += 1
        if run > k:
            value = (value - tokens[i - k] * high) % _MODULUS
        if run >= k:
            yield i - k + 1, value


def _matches(pattern: Sequence[int], text: Sequence[int], used_p: Sequence[bool], used_t: Sequence[bool], k: int) -> list[tuple[int, int, int]]:
    """Maximal matches of k or more unmarked tokens."""
    places = defaultdict(list)
    for p, h in _rolling(pattern, used_p, k):
        places[h].append(p)
    out = []
    for t, h in _rolling(text, used_t, k):
        for p in places.get(h, ()):
            if p and t and not used_p[p - 1] and not used_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # part of a match that starts earlier
            n = 0
            while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                n += 1
            if n >= k:
                out.append((p, t, n))
    return out


def _tokens(items: list[tuple[int, str]], least: int) -> list[tuple[int, list[int], list[int]]]:
    """(id, token hashes, seed hashes) of each item that has tokens."""
    out = []
    for key, text in items:
        raw = np.frombuffer(pc.utf8_lower(pa.scalar(text or "")).as_py().encode(), np.uint8)
        chunk = T.Chunk(raw, np.array([0, len(raw)]), SEPARATORS)
        words = chunk.word_hashes()
        if len(words) >= least:
            out.append((key, words.tolist(), chunk.windows(words, least)[1].tolist()))
    return out


@lru_cache(maxsize=2)
def _block(folder: str, block: int, least: int) -> tuple[list[tuple[int, list[int], list[int]]], dict[int, list[tuple[int, int]]], np.ndarray]:
    """Items of one block of the staged benchmark, where their seeds stand, and the seeds in order; kept by the worker."""
    store, root = fs.FileSystem.from_uri(folder)
    rows = ds.dataset(f"{root}/block={block}", filesystem=store, format="parquet").to_table(columns=["item", "text"])
    items = _tokens(sorted(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True)), least)
    by_seed = defaultdict(list)
    for i, (_, _, seeds) in enumerate(items):
        for j, h in enumerate(seeds):
            by_seed[h].append((i, j))
    return items, by_seed, np.array(sorted(by_seed), _U)


def _tiled(folder: str, block: int, least: int, coverage: float, text_col: str):
    """Adds what a block's items find to items, best_item and coverage of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, by_seed, known = _block(folder, block, least)
        for batch in batches:
            folded = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(text_col))], [text_col])
            for lo, hi, chunk in T.chunks(folded, text_col, SEPARATORS):
                found: list[list] = [[] for _ in range(chunk.n_docs)]
                words = chunk.word_hashes()
                at, seeds = chunk.windows(words, least)
                if len(known) and len(at):
                    near = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
                    hit = np.flatnonzero(known[near] == seeds)
                    doc = np.searchsorted(chunk.word_offsets, at[hit], "right") - 1
                    joined: dict[tuple[int, int], tuple[set, set]] = {}
                    for d, p, h in zip(doc.tolist(), at[hit].tolist(), seeds[hit].tolist(), strict=True):
                        for i, j in by_seed[h]:
                            ours, theirs = joined.setdefault((d, i), (set(), set()))
                            ours.add(p)
                            theirs.add(j)
                    for (d, i), (ours, theirs) in joined.items():
                        share = _share(items[i][1], words, ours, theirs, least, coverage)
                        if share >= coverage:
                            found[d].append((items[i][0], share))
                part = batch.slice(lo, hi - lo)
                before = zip(*(part.column(c).to_pylist() for c in FOUND), strict=True)
                merged = [_merged(old, new) for old, new in zip(before, found, strict=True)]
                names = [c for c in batch.schema.names if c not in FOUND]
                arrays = [pa.array([m[k] for m in merged], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + arrays, [*names, *FOUND])

    return run


FOUND = ("items", "best_item", "coverage")


def _merged(old: tuple, new: list[tuple[int, float]]) -> tuple[list[int], int | None, float]:
    items, best, coverage = old
    every = [*new] if best is None else [*new, (best, coverage)]
    top = max(every, key=lambda x: (x[1], -x[0]), default=(None, 0.0))
    return sorted([*items, *(k for k, _ in new)]), top[0], top[1]


def _share(pattern: list[int], words: np.ndarray, ours: set[int], theirs: set[int], least: int, coverage: float) -> float:
    """Share of an item's tokens that tiles cover; 0 where its seeds can't come to ``coverage``."""
    if len({j + x for j in theirs for x in range(least)}) < coverage * len(pattern):
        return 0.0
    # only stretches of seeds can be tiled; a mark that matches nothing parts them
    text: list[int] = []
    last = None
    for p in sorted(ours):
        if last is None or p > last:
            text.append(-1)
            last = p
        for x in range(last, p + least):
            text.append(int(words[x]))
        last = max(last, p + least)
    return sum(n for _, _, n in tile(pattern, text, least)) / len(pattern)


def _staged(benchmark: DataFrame, item_col: str, size: int) -> tuple[str, int]:
    """The benchmark as a table in hashed blocks of about ``size`` tokens in the shared folder, and their number; the driver sees no text."""
    rows = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if rows.filter("item is null").limit(1).count():
        raise TypeError(f"{item_col} holds ids that are no whole numbers")
    rows = rows.distinct()
    total = rows.agg(F.sum(F.floor(F.length("text") / 4) + 1)).first()[0] or 0
    blocks = -(-total // size)
    folder = new_path(benchmark.sparkSession, "benchmark")
    if blocks:
        rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    return folder, blocks


def _searched(rows: DataFrame, schema: str, text: str, benchmark: DataFrame, item_col: str, least: int, coverage: float, block_tokens: int, only_clean: bool) -> DataFrame:
    """``rows`` with FOUND, a pass a block."""
    folder, blocks = _staged(benchmark, item_col, block_tokens)
    out = rows.withColumns({"items": F.array().cast("array<bigint>"), "best_item": F.lit(None).cast("long"), "coverage": F.lit(0.0)})
    spark = rows.sparkSession
    for block in range(blocks):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/block={block}")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):  # a block may have got no item
            out = out.mapInArrow(_tiled(folder, block, least, coverage, text), f"{schema}, items array<long>, best_item long, coverage double")
            out = out.filter(F.size("items") == 0) if only_clean else out
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every row of ``docs`` (``id_col``) with items (benchmark ids it holds), best_item, coverage and kept.

    Tokens are runs of letters and digits in lower case, in all scripts.  Documents meet the
    items with which they share a run of ``least`` tokens; each pair is tiled,
    and an item is held if the tiles cover ``coverage`` of its tokens, in
    whatever order they stand in the document.  The benchmark is the query set: a table in the shared folder, whose
    hashed blocks of about ``block_tokens`` tokens the tasks read one at a time, a pass over the documents
    a block and no shuffle, so its size isn't bounded and the driver never holds it.

    Null and empty texts hold nothing; items with fewer than ``least`` tokens or
    without an id are held nowhere; ids that are no whole numbers are refused.  Each row is judged by itself.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = _searched(rows, f"_id {kind}, text string", "text", benchmark, item_col, least, coverage, block_tokens, False)
    return out.select(F.col("_id").alias(id_col), *FOUND, (F.size("items") == 0).alias("kept"))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = MATCH, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no item; a pass a benchmark block, no shuffle."""
    small_batches(docs.sparkSession)
    rows, text, schema = positional(docs, text_col)
    return _searched(rows, schema, text, benchmark, item_col, least, coverage, block_tokens, True).drop(*FOUND).toDF(*docs.columns)
