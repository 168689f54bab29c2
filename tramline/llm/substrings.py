"""Substring dedup: a count-min prefilter over word windows, then exact grouping of the windows it lets through."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _text as T
from ._job import given, known, positional, small_batches

WORDS = 20
#: Cells of the sketch, whatever the input's size; one bit each where it is used, 32 MiB.
CELLS = 1 << 28
DEPTH = 2
TILE = 1 << 18
#: Words of the anchor inside each window by which the sketch counts windows.
ANCHOR = 8
#: Windows that a task combines at a time before the shuffle.
BLOCK = 500_000
_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15


def _anchors(chunk: T.Chunk, hashes: np.ndarray, words: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, each window's anchor (its smallest ``anchor``-word hash) and the anchor's place.

    Equal windows have equal anchors at equal offsets, so windows with an anchor
    that occurs at one place only aren't repeated.
    """
    left = np.repeat(chunk.word_offsets[1:], chunk.n_words) - np.arange(len(hashes))
    at = np.flatnonzero(left >= words)
    if not len(at):
        return at, np.zeros(0, _U), at
    small = T.window_hashes(hashes, anchor)
    span = words - anchor + 1
    best, place = small.copy(), np.arange(len(small))
    done = 1
    while done < span:  # minimum over spans that double, the last one overlapping
        step = min(done, span - done)
        better = best[step:] < best[: len(best) - step]
        best[: len(best) - step] = np.where(better, best[step:], best[: len(best) - step])
        place[: len(place) - step] = np.where(better, place[step:], place[: len(place) - step])
        done += step
    return at, best[at], place[at]


def _cells(anchor: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch."""
    width = _U(cells // DEPTH)
    salt = T.seeded(303, DEPTH)
    return [(T.mix(anchor ^ salt[r]) % width + width * _U(r)).astype(np.int64) for r in range(DEPTH)]


def _counted(words: int, anchor: int, cells: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, chunk in T.chunks(batch, "text"):
                _, best, place = _anchors(chunk, chunk.word_hashes(), words, anchor)
                if len(place):
                    found.append(best[np.unique(place, return_index=True)[1]])
            if not found:
                continue
            for row in _cells(np.concatenate(found), cells):
                cell, count = np.unique(row, return_counts=True)
                tile = cell // size
                cut = np.flatnonzero(np.diff(tile)) + 1
                first = np.concatenate([[0], cut])
                code = ((cell % size) << 1 | (count > 1)).astype("<u4")
                parts = [zlib.compress(x.tobytes(), 1) for x in np.split(code, cut)]
                yield pa.RecordBatch.from_arrays([pa.array(tile[first], pa.int32()), pa.array(parts, pa.binary())], ["tile", "part"])

    return run


def _merged(size: int):
    """One partition's tiles; sums that saturate at two, as one bit: counted twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, np.ndarray] = {}
        for batch in batches:
            for tile, part in zip(batch.column("tile").to_pylist(), batch.column("part").to_pylist(), strict=True):
                code = np.frombuffer(zlib.decompress(part), "<u4")
                sums = tiles.setdefault(tile, np.zeros(size, np.uint8))
                cell = code >> 1
                sums[cell] = np.minimum(2, sums[cell] + 1 + (code & 1))
        for tile, sums in tiles.items():
            bits = np.packbits(sums >= 2).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([zlib.compress(bits, 1)], pa.binary())], ["tile", "part"])

    return run


def _sketch(spark: SparkSession, texts: DataFrame, words: int, anchor: int, cells: int) -> np.ndarray:
    """Bits of the cells counted twice or more: cells / 8 bytes."""
    size = min(TILE, cells)
    parts = texts.mapInArrow(_counted(words, anchor, cells, size), "tile int, part binary")
    tiles = parts.repartition(max(1, min(cells // size, int(spark.conf.get("spark.sql.shuffle.partitions")))), "tile").mapInArrow(_merged(size), "tile int, part binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in tiles.collect():  # at most cells / 8 bytes
        bits[row.tile * size // 8 : (row.tile + 1) * size // 8] = np.frombuffer(zlib.decompress(bytes(row.part)), np.uint8)
    return bits


def _windows(words: int, anchor: int, cells: int, bits, most: int):
    """Windows that the sketch lets through: of equal ones in a block the earliest, the others as decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(zlib.decompress(bits.value), np.uint8)
        block: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            key, text = batch.column("_k").to_numpy(), batch.column("_t").to_numpy()
            for lo, _, chunk in T.chunks(batch, "text"):
                hashes = chunk.word_hashes()
                at, best, _ = _anchors(chunk, hashes, words, anchor)
                if not len(at):
                    continue
                keep = np.ones(len(at), bool)
                for row in _cells(best, cells):
                    keep &= (seen[row >> 3] >> (7 - (row & 7))) & 1 == 1
                at = at[keep]
                doc = np.repeat(np.arange(chunk.n_docs), chunk.n_words)[at]
                one = T.window_hashes(hashes, words)[at]
                two = T.window_hashes(chunk.word_hashes(1), words, 1)[at]
                block.append((one, two, key[lo + doc], text[lo + doc], at - chunk.word_offsets[doc]))
                held += len(at)
                if held >= most:
                    yield from _combined(block)
                    block, held = [], 0
        if held:
            yield from _combined(block)

    return run


def _combined(block: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    one, two, k, t, pos = (np.concatenate(c) for c in zip(*block, strict=True))
    order = np.lexsort((t, pos, k, two, one))
    one, two, k, t, pos = one[order], two[order], k[order], t[order], pos[order]
    head = np.ones(len(one), bool)
    head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    # a start that ties with the group's first (the same document written twice) is no later start
    first = np.maximum.accumulate(np.where(head, np.arange(len(one)), 0))
    tied = (k == k[first]) & (pos == pos[first])
    # in the order of the text: neighbours share most bytes, so the shuffle compresses
    own = np.flatnonzero(tied)
    own = own[np.lexsort((pos[own], t[own], k[own]))]
    yield _rows(one[own], k[own], t[own], pos[own], two[own] >> _U(64 - _BITS), False)
    # later starts are decided here: runs of adjacent ones become one row
    k, t, pos = k[~tied], t[~tied], pos[~tied]
    if len(k):
        order = np.lexsort((pos, t, k))
        k, t, pos = k[order], t[order], pos[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (pos[1:] != pos[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(k)) - 1
        own = T.mix(k[begin].astype(_U) * _U(_MULTIPLIER) + pos[begin].astype(_U))  # spread: nothing else decides them
        yield _rows(own, k[begin], t[begin], pos[begin], pos[end] + 1, True)


#: A code is a flag, 31 bits of the first start, and 31 bits more: with the flag, of the place after
#: the last start; without it, of the window's second hash, as such a row has one start.
_DECIDED = 1 << 62
_BITS = 31
_MASK = (1 << _BITS) - 1


def _rows(one, k, t, lo, low, decided: bool) -> pa.RecordBatch:
    code = lo.astype(np.int64) << _BITS | low.astype(np.int64) | (_DECIDED if decided else 0)
    return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(code), pa.array(k), pa.array(t)], ["h", "code", "_k", "_t"])


def _cut(words: int, text: str, drop_text: bool):
    """Removes the words that the spans' windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column("spans"), batch.column(text)
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                parts = raw.split()
                gone = np.zeros(len(parts) + 1, np.int64)
                if spans[i].is_valid and len(spans[i]):
                    code = spans[i].values.to_numpy()
                    np.add.at(gone, code >> _BITS & _MASK, 1)
                    np.add.at(gone, np.minimum((code & _MASK) + words - 1, len(parts)), -1)
                covered = np.cumsum(gone[:-1]) > 0
                removed = int(covered.sum())
                kept = b" ".join([parts[j] for j in np.flatnonzero(~covered)] if removed else parts)
                out[0].append(len(parts))
                out[1].append(removed)
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(_remaining(raw, covered) if removed else texts[i].as_py())
            keep = [n for n in batch.schema.names if n != "spans" and (n != text or not drop_text)]
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + arrays, [*keep, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _remaining(raw: bytes, covered: np.ndarray) -> str:
    """The text without its covered words and the separators that precede them."""
    data = np.frombuffer(raw, np.uint8)
    chunk = T.Chunk(data, np.array([0, len(data)]))
    drop = np.zeros(len(data) + 1, np.int64)
    before = np.append(0, chunk.ends[:-1])
    drop[before[covered]] += 1
    drop[chunk.ends[covered]] -= 1
    return data[np.cumsum(drop[:-1]) == 0].tobytes().decode().lstrip(" \t\n\r\x0b\x0c")


def remove_repeats(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR, cells: int = CELLS, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word covered by a ``words``-word window that also starts earlier.

    Earlier is a smaller id, or an earlier place of the same document; windows
    are judged on the input.  Returns ``id_col``, n_words, n_removed, kept_sha256
    (of the kept words joined by one space) and, if asked, kept_text (the text
    without the removed words and the separators before them): a row per row.

    Pass 1 counts windows in a count-min sketch, by an anchor that equal windows
    share; partitions send sparse counts, which are merged by tile into a sketch
    of ``cells`` cells.  That size is fixed, so the sketch can be broadcast at
    any input size; a fuller one only lets more windows through, and never
    stops a repeated one.  Pass 2 groups the windows let through exactly, by 95 bits
    of two hashes (128 within a task).
    A task combines equal windows in blocks before the shuffle, so a passage that
    all documents hold makes a row a block, not a row a document.

    Null or wordless texts have no words.  A null id sorts after all others.
    Rows that agree in id and text are one document written twice: neither is
    earlier than the other.
    """
    marked = _marked(docs, id_col, text_col)
    joined = marked.join(_spans(marked, words, anchor, cells), ["_k", "_t"], "left").select("_k", "text", "spans")
    out = joined.mapInArrow(_cut(words, "text", True), "_k long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(given("_k").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(known(id_col).alias("_k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.withColumn("_t", F.xxhash64("text"))


def _spans(marked: DataFrame, words: int, anchor: int, cells: int) -> DataFrame:
    """(_k, _t, spans): the window starts of each document that also start earlier."""
    spark = marked.sparkSession
    small_batches(spark)
    bits = spark.sparkContext.broadcast(zlib.compress(_sketch(spark, marked.select("text"), words, anchor, cells).tobytes(), 1))
    found = marked.mapInArrow(_windows(words, anchor, cells, bits, BLOCK), "h long, code long, _k long, _t long")
    # dealt by the first hash, grouped by both: the second one needn't travel on its own
    dealt = found.repartition("h").withColumn("low", F.col("code").bitwiseAND(F.lit(_MASK))).withColumn("lo", F.shiftright("code", _BITS))
    start = F.struct("_k", "lo")  # of rows without the flag
    late = F.col("code") >= _DECIDED
    first = F.min(F.when(~late, start)).over(W.partitionBy("h", "low"))
    span = F.when(late, F.col("code")).otherwise(F.shiftleft("lo", _BITS).bitwiseOR(F.col("lo") + 1))
    return dealt.withColumn("first", first).filter(late | (F.col("first") < start)).select("_k", "_t", span.alias("code")).groupBy("_k", "_t").agg(F.collect_list("code").alias("spans"))


def without_repeats(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the words that remove_repeats() finds taken out of the texts, and ``length_col``, if there, counted anew.

    A document all of whose words go, goes; one without words to begin with stays as it is.
    """
    rows, text, schema = positional(docs, text_col)
    key = f"_c{docs.columns.index(id_col)}"
    marked = _marked(rows, key, text)
    spans = _spans(marked, words, anchor, cells)
    tagged = rows.withColumn("_k", known(key)).withColumn("_t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = tagged.join(spans, ["_k", "_t"], "left").drop("_k", "_t")
    out = joined.mapInArrow(_cut(words, text, False), f"{schema}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    out = out.filter("n_removed < n_words or n_words = 0")
    changed = F.col("n_removed") > 0
    columns = []
    for i, name in enumerate(docs.columns):
        column = F.col(f"_c{i}")
        if name == text_col:
            column = F.when(changed, F.col("kept_text")).otherwise(column)
        elif name == length_col:
            column = F.when(changed, F.char_length("kept_text").cast(docs.schema[name].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return out.select(*columns)
