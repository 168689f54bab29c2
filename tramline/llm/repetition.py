"""Quality rules on repetition: suffix arrays of words, LCP intervals, the union of maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._job import small_batches

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 5
#: A repeat counts from this many words on; texts go beyond these limits if much of them repeats or one repeat is a passage.
#: The base rejects from 20 % in shorter repeats on, so the covered share must stay well below that to say anything.
LEAST = 8
MAX_COVERED = 0.12
MAX_LONGEST = 50
#: Words of one suffix array.
CHUNK_BYTES = 1_000_000


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by the first 1, 2, 4 ... words.

    ``symbols`` differ between texts, so no suffixes of two texts compare equal;
    ``ends`` is the end of each position's text.  After each doubling only
    groups that still tie are sorted again.
    """
    n = len(symbols)
    place = np.int32 if n < 1 << 31 else np.int64  # one is kept a doubling
    _, rank = np.unique(symbols, return_inverse=True)
    order = np.argsort(rank, kind="stable").astype(place)
    # a group's rank is the place of its first suffix, so ranks of settled groups never change
    rank = _group_ranks(rank[order], order, n).astype(place)
    levels = [rank]
    step = 1
    at = np.arange(n)
    while True:
        sorted_rank = rank[order]
        tie = np.zeros(n, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tie[1:] |= same
        tie[:-1] |= same
        slots = np.flatnonzero(tie)
        if not len(slots):
            return order, levels
        who = order[slots]
        ahead = who + step
        second = np.where(ahead < ends[who], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[who].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order = order.copy()
        order[slots] = who[by]
        key = key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        levels.append(rank)
        step *= 2


def _group_ranks(values: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    new = np.ones(n, bool)
    new[1:] = values[1:] != values[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return rank


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of each suffix and the one before it in order (0 for the first)."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    order = order.astype(np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    end_a, end_b = ends[a], ends[b]
    for i in range(len(levels) - 1, -1, -1):
        rank, step = levels[i], 1 << i
        fits = (a + step <= end_a) & (b + step <= end_b)
        equal = fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        a, b = a + step * equal, b + step * equal
    lcp[1:] = a - order[:-1]
    return lcp


def repeats(chunk: T.Chunk) -> np.ndarray:
    """For each word, the length of the longest repeat of its text that starts there (0: none).

    Maximal repeats are the LCP intervals; the longest that starts at a suffix is
    the larger of its two neighbour LCPs.
    """
    hashes = chunk.word_hashes()
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    doc = chunk.doc_of_word()
    ends = chunk.word_offsets[1:][doc]
    symbols = T.mix(hashes ^ T.mix(doc.astype(np.uint64) + np.uint64(1)))
    order, levels = suffix_ranks(symbols, ends)
    lcp = neighbour_lcp(order, levels, ends)
    most = lcp.copy()
    most[:-1] = np.maximum(most[:-1], lcp[1:])
    out = np.empty(n, np.int64)
    out[order] = most
    return out


def covered(chunk: T.Chunk, longest: np.ndarray, least: int) -> np.ndarray:
    """Words covered by a repeat of ``least`` words or more: the union of the repeats' spans."""
    n = len(longest)
    start = np.flatnonzero(longest >= least)
    change = np.zeros(n + 1, np.int64)
    change[start] += 1
    np.add.at(change, start + longest[start], -1)
    return np.cumsum(change[:-1]) > 0


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _measured(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, chunk in T.chunks(batch, "text", most=CHUNK_BYTES):
                longest = repeats(chunk)
                doc = chunk.doc_of_word()
                n = chunk.n_docs
                per = lambda mask: np.bincount(doc[mask], minlength=n)  # noqa: E731, B023
                top = np.zeros(n, np.int64)
                np.maximum.at(top, doc, longest)
                chars = _per_text(~T.SPACE[chunk.data] & (chunk.data & 0xC0 != 0x80), chunk.offsets)
                symbols = _per_text(_SYMBOL[chunk.data], chunk.offsets)
                lines = np.zeros(n, np.int64)
                for i in range(n):
                    raw = chunk.doc_bytes(i)
                    if b"\n" in raw:
                        own = [x for x in raw.split(b"\n") if x.strip(SPACES)]
                        lines[i] = len(own) - len(set(own))
                arrays = [chunk.n_words, chars, symbols, lines, per(covered(chunk, longest, WINDOW)), per(covered(chunk, longest, least)), top]
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
                yield pa.RecordBatch.from_arrays([batch.column("_id")[lo:hi]] + [pa.array(x.astype(np.int64)) for x in arrays], ["_id", *names])

    return run


def repetition(docs: DataFrame, least: int = LEAST, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word counts, repetition and verdict of every row.

    Base: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed.  Method: covered_share (words inside repeats of ``least`` words
    or more, by n_words), longest_repeat (words); a text is kept if neither the base nor
    a limit speaks against it.  Both come from one suffix array per run of whole
    texts, whose symbols keep the texts apart.

    Null and wordless texts have no words and fail the base.  A very long text is
    one suffix array: 4 bytes a word for each doubling up to its longest repeat.  Each row is judged
    by itself; ids may be null or repeat.  Words are compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"
    out = rows.mapInArrow(_measured(least), f"_id {kind}, {fields}")
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    share = F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(F.lit(0.0))
    return (
        out.withColumn("base_failed", failed).withColumn("covered_share", share)
        .withColumn("kept", ~F.col("base_failed") & (F.col("covered_share") <= max_covered) & (F.col("longest_repeat") <= max_longest))
        .select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_share", "longest_repeat", "kept")
    )
