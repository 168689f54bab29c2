"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._job import positional, small_batches

#: The scorer is fitted on at most so many rows, those with the smallest hashes.
TRAIN_ROWS = 6_000
WEIGHTS = 1 << 16
EPOCHS = 60
THRESHOLD = 0.5
LABELLERS = ("symbols", "marks", "odd_ends", "letters", "capitals", "stutter", "thrice", "runs")
#: The kinds of bad texts that the labellers know; each kind is a class of the label model.
KINDS = (("symbols", "marks", "odd_ends", "letters"), ("capitals",), ("stutter", "thrice", "runs"))
ABSTAIN, BAD, GOOD = -1, 0, 1
#: Below so many words no labeller votes.
FEW = 8
#: Words that the share of good texts counts for in a text's score.
SMOOTH_WORDS = 4
#: Where expectation-maximisation starts: how often a labeller accuses good texts, bad ones of its own kind, and of others; the share of good texts.
START = (0.05, 0.8, 0.2, 0.9)
_U = np.uint64
_TWICE = _U(0x2545F4914F6CDD1D)


def _kinds() -> np.ndarray:
    """Bytes by kind: lower, upper, digit, other script; marks are kinds of their own."""
    kind = np.arange(256, dtype=np.uint8)
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A], kind[0x80:] = 1, 2, 3, 1
    return kind


KIND = _kinds()


def _is(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


SYMBOL, COMMON = _is(b"#*$%&|<>"), _is(b".,;:'\"-()?")
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = True
MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
MARK &= ~COMMON


def votes(chunk: T.Chunk) -> np.ndarray:
    """One vote of each labeller (LABELLERS) on each text: GOOD, BAD or ABSTAIN."""
    data, n = chunk.data, chunk.n_docs
    words = np.maximum(chunk.n_words, 1)
    hashes, doc = chunk.word_hashes(), chunk.doc_of_word()
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[chunk.offsets])
    upper, letters = total(KIND[data] == 2), total((KIND[data] == 1) | (KIND[data] == 2) | (KIND[data] == 3))
    chars = np.maximum(total(~T.SPACE[data]), 1)
    key = T.mix(hashes ^ T.mix(doc.astype(_U)))
    twice = np.bincount(doc[1:][key[1:] == key[:-1]], minlength=n) if len(doc) > 1 else np.zeros(n)
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    thrice = np.bincount(doc[1:][same[1:] & same[:-1]], minlength=n) if len(doc) > 1 else np.zeros(n)
    place = np.arange(len(key))
    run = np.zeros(n)
    np.maximum.at(run, doc, place - np.maximum.accumulate(np.where(same, 0, place)) + 1 if len(key) else place)
    odd = np.bincount(doc[MARK[data[chunk.ends - 1]]], minlength=n) if len(doc) else np.zeros(n)

    def by(x: np.ndarray, good: float, bad: float, sign: int = 1) -> np.ndarray:
        """GOOD below ``good``, BAD above ``bad``, ABSTAIN between and on texts of few words; the other way round for sign -1."""
        return np.where(chunk.n_words < FEW, ABSTAIN, np.where(sign * x > sign * bad, BAD, np.where(sign * x < sign * good, GOOD, ABSTAIN)))

    out = [
        by(total(SYMBOL[data]) / words, 0.02, 0.1),
        by(total(MARK[data]) / words, 0.05, 0.15),
        by(odd / words, 0.05, 0.1),
        by(letters / chars, 0.93, 0.87, -1),
        by(upper / np.maximum(letters, 1), 0.2, 0.4),
        by(twice / words, 0.1, 0.2),
        by(thrice / words, 0.02, 0.1),
        by(run, 3, 3),
    ]
    return np.stack(out, axis=1).astype(np.int8)


def features(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash): words, their shapes (runs of a kind of character), pairs of shapes; one feature for a word said twice."""
    if not len(chunk.starts):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    kind = KIND[chunk.data]
    inside = ~T.SPACE[chunk.data]
    keep = inside.copy()
    keep[1:] &= kind[1:] != kind[:-1]
    keep[chunk.starts] = True
    at = np.flatnonzero(keep)
    word = np.searchsorted(chunk.starts, at, "right") - 1
    first = np.searchsorted(at, chunk.starts)
    within = np.arange(len(at)) - first[word]
    value = T.mix(kind[at].astype(_U) + _U(1)) * T.powers(0x9E3779B97F4A7C15, int(within.max()) + 1)[within]
    shape = T.mix(np.add.reduceat(value, first))
    doc = chunk.doc_of_word()
    pair_at, pairs = chunk.windows(shape, 2)
    words = chunk.word_hashes()
    pairs = np.where(words[pair_at] == words[np.minimum(pair_at + 1, len(words) - 1)], _TWICE, T.mix(pairs))
    return np.concatenate([doc, doc, doc[pair_at]]), np.concatenate([words, shape, pairs])


@dataclass
class LabelModel:
    """Shares of the classes (good texts, then each kind of bad ones), and how often each labeller that votes accuses texts of a class: (classes, labellers)."""

    prior: np.ndarray
    accuses: np.ndarray

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """Probabilities of the classes of each row of votes; a labeller that abstains says nothing."""
        log = np.log(self.prior)[None] + (patterns == BAD) @ np.log(self.accuses).T + (patterns == GOOD) @ np.log1p(-self.accuses).T
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that the text is good."""
        return self.classes(patterns)[:, 0]

    def accuracy(self) -> np.ndarray:
        """Of each labeller, when it votes: the chance that it is right."""
        return self.prior[0] * (1 - self.accuses[0]) + self.prior[1:] @ self.accuses[1:]


def fit_labels(patterns: np.ndarray, counts: np.ndarray, kinds: list[list[int]] | None = None, rounds: int = 300) -> LabelModel:
    """Expectation-maximisation over vote patterns with their counts.

    ``kinds`` are groups of labellers that know one kind of bad texts; a class
    each, beside the good texts, so that a kind few labellers know isn't taken for good.
    They decide only where the rounds start (START): every share and
    rate is estimated, with half a vote of each sort and one text a class added.
    """
    m = patterns.shape[1]
    own = [[LABELLERS.index(x) for x in kind] for kind in KINDS] if kinds is None else kinds
    good, known, other, share = START
    accuses = np.full((1 + len(own), m), other)
    accuses[0] = good
    for k, group in enumerate(own):
        accuses[k + 1, group] = known
    model = LabelModel(np.array([share, *[(1 - share) / len(own)] * len(own)]), accuses)
    bad_votes, good_votes = (patterns == BAD).astype(float), (patterns == GOOD).astype(float)
    for _ in range(rounds):
        weight = model.classes(patterns) * counts[:, None]
        accused, cleared = weight.T @ bad_votes, weight.T @ good_votes
        model = LabelModel((weight.sum(axis=0) + 1) / (weight.sum() + 1 + len(own)), (accused + 0.5) / (accused + cleared + 1))
    return model


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int = WEIGHTS, epochs: int = EPOCHS) -> np.ndarray:
    """Logistic weights (the last is the bias) on (features, shares) rows, by Adam on all rows; classes weigh alike."""
    weights = np.zeros(size + 1)
    if not rows:
        return weights
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f, _ in rows])
    col = np.concatenate([f for f, _ in rows]).astype(np.int32)
    value = np.concatenate([v for _, v in rows]).astype(np.float32)
    good = max(target.sum(), 1.0)
    bad = max((1 - target).sum(), 1.0)
    cost = target / good + (1 - target) / bad
    cost /= cost.sum()
    one, two = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(row, weights=value * weights[col], minlength=len(rows)) + weights[size]
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * cost
        grad = np.append(np.bincount(col, weights=value * slope[row], minlength=size), slope.sum()) + 1e-6 * weights
        one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad**2
        weights -= 0.3 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)
    return weights


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of vote patterns, a row a pattern and batch."""
    for batch in batches:
        for _, _, chunk in T.chunks(batch, "text"):
            code = ((votes(chunk).astype(np.int64) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
            kinds, count = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(count.astype(np.int64))], ["pattern", "n"])


def _unpacked(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, chunk in T.chunks(batch, "text"):
            code = ((votes(chunk).astype(np.int64) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
            doc, hashes = features(chunk)
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(chunk.n_docs + 1))
            kept, shares = [], []
            for i in range(chunk.n_docs):
                # all features, folded as score() folds them, so a row is WEIGHTS entries at most
                own, count = np.unique(hashes[order[cut[i] : cut[i + 1]]] % _U(WEIGHTS), return_counts=True)
                kept.append(own.astype("<u2").tobytes())
                shares.append((count / max(1, chunk.n_words[i])).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h")[lo:hi], pa.array(code), pa.array(kept, pa.binary()), pa.array(shares, pa.binary())], ["h", "pattern", "f", "v"])


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, chunk: T.Chunk) -> np.ndarray:
        """Probability of a good text; 0 for a text without words."""
        doc, hashes = features(chunk)
        z = np.bincount(doc, weights=self.weights[(hashes % _U(WEIGHTS)).astype(np.int64)], minlength=chunk.n_docs)
        z = z / np.maximum(chunk.n_words, 1) + self.weights[WEIGHTS]
        # a few words say little: the shorter the text, the more its score is the prior's
        z = (chunk.n_words * z + SMOOTH_WORDS * np.log(self.labels.prior[0] / (1 - self.labels.prior[0]))) / (chunk.n_words + SMOOTH_WORDS)
        return np.where(chunk.n_words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> QualityModel:
    """Fits both models.  Vote patterns are counted over all rows (their number is at most
    3 ** labellers); the scorer sees ``train_rows`` rows, those with the smallest hashes of text and id."""
    small_batches(docs.sparkSession)
    id_ = F.col(id_col).cast("string") if id_col in docs.columns else F.lit("")
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(id_, F.lit("")).alias("id"))
    counted = texts.select("text").mapInArrow(_voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes = np.array([r.pattern for r in counted], np.int64)
    labels = fit_labels(_unpacked(codes), np.array([r.n for r in counted], float))
    # rows by a hash of text and id; a cut from the count keeps what reaches the sort near train_rows
    key = F.xxhash64("text", "id")
    share = min(1.0, 2 * train_rows / max(1, sum(r.n for r in counted)))
    drawn = texts.filter("text <> ''").withColumn("h", key).filter(F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).orderBy("h", "text").limit(train_rows)
    rows = sorted(drawn.select("text", "h").mapInArrow(_drawn, "h long, pattern long, f binary, v binary").collect(), key=lambda r: (r.h, bytes(r.f)))
    target = labels.posterior(_unpacked(np.array([r.pattern for r in rows], np.int64)))
    weights = fit_scorer([(np.frombuffer(r.f, "<u2"), np.frombuffer(r.v, "<f4")) for r in rows], target)
    return QualityModel(labels, weights)


def _scored(model: QualityModel, text: str, drop_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != text or not drop_text]
            for lo, hi, chunk in T.chunks(batch, text):
                code = votes(chunk)
                yield pa.RecordBatch.from_arrays([batch.column(c)[lo:hi] for c in names] + [pa.array(model.labels.posterior(code)), pa.array(model.score(chunk))], [*names, "posterior", "score"])

    return run


def classified(docs: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, posterior, score and kept of every row.

    posterior is the label model's probability that the text is good, score the
    linear scorer's, and a text is kept if its score reaches ``threshold``.

    Null and wordless texts score 0.  Equal texts score alike; each row is
    judged by itself, ids may be null or repeat.  An empty table fits nothing
    and returns nothing.
    """
    model = fit(docs, text_col, train_rows, id_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_scored(model, "text", True), f"_id {kind}, posterior double, score double")
    return out.select(F.col("_id").alias(id_col), "posterior", "score", (F.col("score") >= threshold).alias("kept"))


def accepted(docs: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that classified() keeps; no shuffle."""
    model = fit(docs, text_col, train_rows)
    rows, text, schema = positional(docs, text_col)
    out = rows.mapInArrow(_scored(model, text, False), f"{schema}, posterior double, score double")
    return out.filter(F.col("score") >= threshold).drop("posterior", "score").toDF(*docs.columns)
