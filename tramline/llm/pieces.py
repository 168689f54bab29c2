"""SentencePiece encoding with seeded merge dropout, and decoding.

Merge-type (BPE) segmentation on a given vocabulary: of all neighbouring
symbols whose concatenation is a piece, the pair with the best score merges
first, ties from the left.  Each candidate merge that comes up is skipped if a
hash of seed, text key, the word's place in the text, word and the candidate's place in the word says so; a skipped pair
comes up again only as part of another candidate.  So every occurrence of a word
is cut on its own; occurrences that skip the same candidates share the work.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._job import positional, small_batches

RATE = 0.1
SEED = 7
#: Words of more symbols are merged one by one with a heap.
LONG = 48
#: Characters that a task segments at a time, about; each takes some 100 bytes meanwhile.
CHUNK_CHARS = 400_000
#: Pairs of an occurrence and a candidate that a task looks at in one step.
PAIRS = 1_000_000
#: Candidates that a worker remembers, by word; beyond that it starts anew.
REMEMBERED = 4_000_000
MARK = 0x2581
#: Stands for a mark that the text itself holds; no code point.
OWN_MARK = 0x110000
_U = np.uint64
_NONE = np.int64(1 << 62)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a BPE model with byte fallback, and the table of pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        text = [model.id_to_piece(i) for i in range(n)]
        self.bytes_ = np.full(256, -1, np.int64)
        surface: list[bytes] = []
        ids: dict[str, int] = {}
        for i, piece in enumerate(text):
            if model.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                surface.append(b"")
            else:
                ids[piece] = i
                surface.append(piece.replace("▁", " ").encode())
        if (self.bytes_ < 0).any():
            raise ValueError("the model has no byte fallback")
        self.blob = np.frombuffer(b"".join(surface), np.uint8)
        self.lens = np.array([len(x) for x in surface], np.int64)
        self.offsets = np.cumsum(self.lens) - self.lens
        # symbols: pieces, then characters that occur in pieces without being one
        symbols = dict(ids)
        for c in sorted({c for piece in ids for c in piece}):
            symbols.setdefault(c, n + len(symbols) - len(ids))
        self.initial = np.full(OWN_MARK + 1, -1, np.int64)
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.initial[ord(piece)] = i
        self.cut_lines = not any("\n" in p for p in ids)
        self.cut_marks = not any("▁" in p.lstrip("▁") for p in ids)
        self.longest = max(map(len, ids))
        scores = np.array([model.get_score(ids[p]) for p in ids])
        rank = dict(zip(ids, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        keys, merged, ranks = [], [], []
        for piece, i in ids.items():
            for j in range(1, len(piece)):
                a, b = symbols.get(piece[:j]), symbols.get(piece[j:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    merged.append(i)
                    ranks.append(rank[piece])
        # candidates of words met before: sorted word hashes, where theirs stand, how many
        self.seen, self.seen_at, self.seen_n, self.store = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
        self.table = {k: (r, m) for k, m, r in zip(keys, merged, ranks, strict=True)}
        self._fill(np.array(keys, np.int64), np.array(merged, np.int64), np.array(ranks, np.int64))

    def _fill(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray) -> None:
        """An open hash table with linear probing."""
        self.bits = max(12, int(len(keys) * 6).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.merged, self.rank = np.zeros(size, np.int64), np.zeros(size, np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.key[slot[left]] < 0
            first = left[free]
            self.key[slot[first]] = keys[first]
            won = self.key[slot[left]] == keys[left]
            done = left[won]
            self.merged[slot[done]], self.rank[slot[done]] = merged[done], ranks[done]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix(keys.astype(_U)) >> _U(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged symbol, rank) of each pair of symbols; rank _NONE if they don't merge."""
        keys = a << 20 | b
        slot = self._slot(keys)
        found = self.key[slot]
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[left]]
            left = left[(found != keys[left]) & (found >= 0)]
        hit = (self.key[slot] == keys) & (a >= 0) & (b >= 0)
        return self.merged[slot], np.where(hit, self.rank[slot], _NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_WORD = (1 << 64) - 1


def _mixed(x: int) -> int:
    """T.mix() of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _WORD
    return x ^ x >> 31


def places(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of candidate merges by their place in the word."""
    return T.mix(start.astype(_U) << _U(42) ^ middle.astype(_U) << _U(21) ^ end.astype(_U))


def skipped(word: np.ndarray, place: np.ndarray, rate: float) -> np.ndarray:
    """Whether candidate merges are skipped; ``word`` is the hash of seed, text key, place in the text and word."""
    if rate <= 0:
        return np.zeros(len(place), bool)
    return (T.mix(word ^ place) >> _U(11)).astype(np.float64) < rate * float(1 << 53)


def candidates(vocab: Vocabulary, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place hashes, number a word): all merges that can come up in each word, whatever is skipped.

    A span is reached if two spans that are reached make it; spans are found by
    length, from the starts of those that are there.
    """
    n = len(symbols)
    first = np.cumsum(lens) - lens
    word = np.repeat(np.arange(len(lens)), lens)
    room = np.repeat(first + lens, lens) - np.arange(n)
    at = [np.zeros(0, np.int64), np.flatnonzero(symbols >= 0)]
    made = [symbols, symbols]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for size in range(2, min(vocab.longest, int(lens.max(initial=0))) + 1):
        out = np.full(n, -1, np.int64)
        for head in range(1, size):
            s = at[head]
            s = s[room[s] >= size]
            s = s[made[size - head][s + head] >= 0]
            if not len(s):
                continue
            merged, rank = vocab.pairs(made[head][s], made[size - head][s + head])
            good = rank != _NONE
            s = s[good]
            out[s] = merged[good]
            own = s - first[word[s]]
            found.append((word[s], places(own, own + head, own + size)))
        made.append(out)
        at.append(np.flatnonzero(out >= 0))
    if not found:
        return np.zeros(0, _U), np.zeros(len(lens), np.int64)
    of, place = (np.concatenate(x) for x in zip(*found, strict=True))
    return place[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(lens))


def known_candidates(vocab: Vocabulary, plain: np.ndarray, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place hashes, where each word's begin, how many it has); words (``plain``, sorted hashes) met before aren't searched again."""
    if len(vocab.store) > REMEMBERED:
        vocab.seen, vocab.seen_at, vocab.seen_n, vocab.store = vocab.seen[:0], vocab.seen_at[:0], vocab.seen_n[:0], vocab.store[:0]
    where = np.searchsorted(vocab.seen, plain)
    hit = np.zeros(len(plain), bool)
    inside = where < len(vocab.seen)
    hit[inside] = vocab.seen[where[inside]] == plain[inside]
    new = np.flatnonzero(~hit)
    begin = np.cumsum(lens) - lens
    place, many = candidates(vocab, symbols[T.ranges(begin[new], lens[new])], lens[new])
    head = len(vocab.store) + np.cumsum(many) - many
    vocab.store = np.concatenate([vocab.store, place])
    vocab.seen_at, vocab.seen_n = np.insert(vocab.seen_at, where[new], head), np.insert(vocab.seen_n, where[new], many)
    vocab.seen = np.insert(vocab.seen, where[new], plain[new])
    own = np.searchsorted(vocab.seen, plain)
    return vocab.store, vocab.seen_at[own], vocab.seen_n[own]


def merge_one(vocab: Vocabulary, symbols: list[int], word: int, rate: float) -> tuple[list[int], list[int]]:
    """(symbols, their starts) of one word after all merges: an agenda in a heap."""
    n = len(symbols)
    sym, end = list(symbols), list(range(1, n + 1))
    back, ahead = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int, int]] = []
    limit = rate * float(1 << 53)

    def offer(i: int) -> None:
        if i < 0 or ahead[i] < 0 or sym[i] < 0 or sym[ahead[i]] < 0:
            return
        j = ahead[i]
        hit = vocab.table.get(sym[i] << 20 | sym[j])
        if hit is not None and not (rate > 0 and _mixed(word ^ _mixed(i << 42 ^ end[i] << 21 ^ end[j])) >> 11 < limit):
            heapq.heappush(heap, (hit[0], i, hit[1], end[i], end[j]))

    for i in range(n):
        offer(i)
    gone = [False] * n
    while heap:
        _, i, m, middle, stop = heapq.heappop(heap)
        j = ahead[i]
        if gone[i] or j < 0 or end[i] != middle or end[j] != stop:
            continue
        sym[i], gone[j] = m, True
        end[i], ahead[i] = end[j], ahead[j]
        if ahead[j] >= 0:
            back[ahead[j]] = i
        offer(back[i])
        offer(i)
    live = [i for i in range(n) if not gone[i]]
    return [sym[i] for i in live], live


def merge_many(vocab: Vocabulary, symbols: np.ndarray, lens: np.ndarray, words: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, word, start) of all words after all merges, each round one merge a word."""
    w = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum(lens) - lens
    start = np.arange(len(symbols)) - first[w]
    stop = start + 1
    sym = symbols.copy()
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(lens > LONG):
        own, at = merge_one(vocab, symbols[first[i] : first[i] + lens[i]].tolist(), int(words[i]), rate)
        done.append((np.array(own, np.int64), np.full(len(own), i), np.array(at, np.int64)))
    live = (lens <= LONG)[w]
    sym, w, start, stop = sym[live], w[live], start[live], stop[live]
    while len(sym):
        pair = np.flatnonzero(w[1:] == w[:-1])
        merged, rank = vocab.pairs(sym[pair], sym[pair + 1])
        good = np.flatnonzero(rank != _NONE)
        pair, merged, rank = pair[good], merged[good], rank[good]
        ok = ~skipped(words[w[pair]], places(start[pair], stop[pair], stop[pair + 1]), rate)
        pair, merged, rank = pair[ok], merged[ok], rank[ok]
        if not len(pair):
            done.append((sym, w, start))
            break
        of = w[pair]
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        key = rank << 32 | np.arange(len(pair))
        best = (np.minimum.reduceat(key, head) & 0xFFFFFFFF).astype(np.int64)
        at = pair[best]
        sym[at] = merged[best]
        stop[at] = stop[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        open_ = np.zeros(len(lens), bool)
        open_[of[head]] = True
        busy = open_[w]
        out = keep & ~busy
        done.append((sym[out], w[out], start[out]))
        keep &= busy
        sym, w, start, stop = sym[keep], w[keep], start[keep], stop[keep]
    if not done:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    sym, w, start = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.lexsort((start, w))
    return sym[order], w[order], start[order]


def encode_many(vocab: Vocabulary, texts: list[str], keys: np.ndarray, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each); ``keys`` are hashes of the texts' keys."""
    code = np.frombuffer("".join(f" {t}" if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    if not len(code):
        return np.zeros(0, np.int64), size
    code[code == MARK] = OWN_MARK
    code[code == 0x20] = MARK
    doc_start = np.cumsum(size) - size
    cut = np.zeros(len(code), bool)
    cut[doc_start[size > 0]] = True
    if vocab.cut_marks:
        cut[1:] |= (code[1:] == MARK) & (code[:-1] != MARK)
        if vocab.cut_lines:
            cut[1:] |= (code[1:] == 10) | (code[:-1] == 10)
    start = np.flatnonzero(cut)
    lens = np.diff(np.append(start, len(code)))
    within = np.arange(len(code)) - np.repeat(start, lens)
    value = T.mix(code.astype(_U) + _U(1)) * T.powers(0x9E3779B97F4A7C15, int(lens.max()))[within]
    doc = np.searchsorted(doc_start + size, start, "right")
    plain, first, kind = np.unique(T.mix(np.add.reduceat(value, start) + lens.astype(_U)), return_index=True, return_inverse=True)
    symbols = vocab.initial[code[T.ranges(start[first], lens[first])]]
    salt = T.mix(keys.astype(_U) ^ T.mix(np.array([seed], _U)))
    word = T.mix(plain[kind] ^ T.mix(salt[doc] + (start - doc_start[doc]).astype(_U)))
    rep, back = first, kind
    if rate > 0:
        # an occurrence's cut depends on its word and on which of the word's candidates it skips
        place, head, many = known_candidates(vocab, plain, symbols, lens[first])
        total = np.concatenate([[0], np.cumsum(many[kind])])
        print_ = np.zeros(len(start), _U)
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
            own = np.repeat(np.arange(lo, hi), many[kind[lo:hi]])
            at = T.ranges(head[kind[lo:hi]], many[kind[lo:hi]])
            out = skipped(word[own], place[at], rate)
            np.add.at(print_, own[out], T.mix(place[at[out]]))
            lo = hi
        _, rep, back = np.unique(T.mix(plain[kind] ^ T.mix(print_)), return_index=True, return_inverse=True)
    n_kinds = len(rep)
    of = kind[rep]
    at = T.ranges((np.cumsum(lens[first]) - lens[first])[of], lens[first][of])
    sym, w, place = merge_many(vocab, symbols[at], lens[first][of], word[rep], rate)
    # symbols that are no piece become the bytes of their character
    width = np.ones(len(sym), np.int64)
    odd = np.flatnonzero((sym < 0) | (sym >= vocab.size))
    spelled: list[np.ndarray] = []
    for c in code[start[rep][w[odd]] + place[odd]].tolist():
        raw = chr(MARK if c == OWN_MARK else c).encode("utf-8", "surrogatepass")
        spelled.append(vocab.bytes_[list(raw)])
    width[odd] = [len(x) for x in spelled]
    ids = np.repeat(sym, width)
    if len(odd):
        ids[T.ranges((np.cumsum(width) - width)[odd], width[odd])] = np.concatenate(spelled)
    count = np.bincount(w, weights=width, minlength=n_kinds).astype(np.int64)
    place0 = np.cumsum(count) - count
    out = ids[T.ranges(place0[back], count[back])]
    return out, np.bincount(doc, weights=count[back], minlength=len(texts)).astype(np.int64)


def decode_bytes(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes that ids stand for, without the space that encoding puts first."""
    raw = vocab.blob[T.ranges(vocab.offsets[ids], vocab.lens[ids])].tobytes()
    return raw[1:] if raw[:1] == b" " else raw


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    return decode_bytes(vocab, np.asarray(ids, np.int64)).decode("utf-8", "replace")


def _encoded(path: str | None, rate: float, seed: int, text: str, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path or default_model())
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            keys = batch.column("_v").to_numpy().view(_U)
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= CHUNK_CHARS):
                    held += len(texts[hi])
                    hi += 1
                ids, count = encode_many(vocab, texts[lo:hi], keys[lo:hi], rate, seed)
                part = batch.slice(lo, hi - lo)
                names = [c for c in batch.schema.names if c != "_v"]
                arrays = [part.column(c) for c in names] + [T.list_array(ids.astype(np.int32), count, pa.int32())]
                if verify:
                    ends = np.cumsum(count)
                    arrays.append(pa.array([decode_bytes(vocab, ids[e - n : e]) == t.encode() for t, n, e in zip(texts[lo:hi], count, ends, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, [*names, "ids", *(["lossless"] if verify else [])])
                lo = hi

    return run


def encode(docs: DataFrame, model: str | None = None, rate: float = RATE, seed: int = SEED, key_col: str = "doc_id", text_col: str = "text", verify: bool = False) -> DataFrame:
    """Adds ids (array of int) to ``docs`` and, if asked, lossless: whether they decode to the text; columns of these names are replaced.

    ``model`` is the path of a model file on every executor; by default the public
    32k vocabulary.  A text's ids depend on the text, its key, the seed and the
    rate, not on its neighbours or the partitioning; equal words are cut each on its own.  Spaces
    become marks and every text but the empty one starts with one more; marks
    that the text itself holds are spelled in bytes, so decoding is exact.  At
    rate 0 the ids are those of the model's own encoder for texts without marks.

    Null and empty texts have no ids; a null key counts as the empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "lossless") if verify else docs.drop("ids")
    rows, text, schema = positional(docs, text_col)
    key = F.col(f"_c{docs.columns.index(key_col)}").cast("string")
    keyed = rows.withColumn("_v", F.xxhash64(F.coalesce(key, F.lit(""))))
    more = ["ids", "lossless"] if verify else ["ids"]
    out = keyed.mapInArrow(_encoded(model, rate, seed, text, verify), f"{schema}, ids array<int>" + ", lossless boolean" * verify)
    return out.toDF(*docs.columns, *more)


def _decoded(path: str | None, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path or default_model())
        for batch in batches:
            texts = [None if x is None else decode(vocab, x) for x in (v.values.to_numpy() if v.is_valid else None for v in batch.column(column))]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return run


def decoded(rows: DataFrame, model: str | None = None, column: str = "ids") -> DataFrame:
    """Adds decoded: the text that ``column`` stands for, null for null; a column of that name is replaced."""
    small_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decoded(model, column), f"{schema}, decoded string")


def _digests(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path or default_model())
        for batch in batches:
            rows: list[list] = [[], [], []]
            for ids in batch.column("ids"):
                own = ids.values.to_numpy()
                rows[0].append(len(own))
                rows[1].append(int(np.isin(own, vocab.bytes_).sum()))
                rows[2].append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2]), batch.column("lossless")], ["_id", "n_tokens", "n_byte_tokens", "ids_sha256", "lossless"])

    return run


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_tokens, n_byte_tokens, ids_sha256 (of little-endian int32), lossless of every row."""
    rows = encode(docs.select(F.col(id_col).alias("_id"), F.col("text").cast("string").alias("text")), model, key_col="_id", verify=True).select("_id", "ids", "lossless")
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_digests(model), f"_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, lossless boolean").withColumnRenamed("_id", id_col)
