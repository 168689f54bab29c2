import collections
import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tramline.llm import _text as T
from tramline.llm import weak_labels

from .corpus import empty, frame, odd, texts, words


def test_labellers_are_told_apart():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.9
    sees = np.array([0.9, 0.8, 0.5, 0.0])  # the last accuses no one
    votes = np.where(truth[:, None], weak_labels.GOOD, np.where(rng.random((20_000, 4)) < sees, weak_labels.BAD, weak_labels.GOOD))
    votes[rng.random(votes.shape) < 0.1] = weak_labels.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.fit_labels(patterns, counts.astype(float), [[0, 1, 2, 3]])
    assert abs(model.prior[0] - truth.mean()) < 0.02
    assert np.abs(model.accuses[1, :3] - sees[:3]).max() < 0.06
    assert np.abs(model.accuracy()[:3] - (0.9 + 0.1 * sees[:3])).max() < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97


def test_false_alarms_are_estimated():
    """One labeller accuses a tenth of the good texts; no bound hides it, and the others overrule it."""
    rng = np.random.default_rng(7)
    truth = rng.random(30_000) < 0.85
    bad = np.where(truth[:, None], rng.random((30_000, 5)) < [0.1, 0.01, 0.0, 0.02, 0.0], rng.random((30_000, 5)) < [0.7, 0.9, 0.8, 0.85, 0.6])
    votes = np.where(bad, weak_labels.BAD, weak_labels.GOOD)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.fit_labels(patterns, counts.astype(float), [[0, 1, 2, 3, 4]])
    assert np.abs(model.accuses[0] - [0.1, 0.01, 0.0, 0.02, 0.0]).max() < 0.01
    assert model.posterior(np.array([[0, 1, 1, 1, 1]]))[0] > 0.9


def plain_labels(patterns, counts, kinds, rounds):
    """Expectation-maximisation in loops: (prior, accuses)."""
    m, k = len(patterns[0]), 1 + len(kinds)
    good, known, other, share = weak_labels.START
    prior = [share] + [(1 - share) / (k - 1)] * (k - 1)
    accuses = [[good] * m] + [[known if j in own else other for j in range(m)] for own in kinds]
    for _ in range(rounds):
        weight = []
        for row, n in zip(patterns, counts, strict=True):
            p = [prior[c] * np.prod([1.0 if v == -1 else accuses[c][j] if v == 0 else 1 - accuses[c][j] for j, v in enumerate(row)]) for c in range(k)]
            weight.append([n * x / sum(p) for x in p])
        total = [sum(w[c] for w in weight) for c in range(k)]
        prior = [(t + 1) / (sum(total) + k) for t in total]
        votes = lambda c, j, v: sum(w[c] for w, row in zip(weight, patterns, strict=True) if row[j] == v)
        accuses = [[(votes(c, j, 0) + 0.5) / (votes(c, j, 0) + votes(c, j, 1) + 1) for j in range(m)] for c in range(k)]
    return np.array(prior), np.array(accuses)


def test_estimation_equals_brute_force_on_small_votes():
    rng = np.random.default_rng(11)
    patterns, counts = np.unique(rng.integers(-1, 2, (60, 4)), axis=0, return_counts=True)
    kinds = [[0, 1], [2, 3]]
    model = weak_labels.fit_labels(patterns, counts.astype(float), kinds, rounds=40)
    prior, accuses = plain_labels(patterns.tolist(), counts.tolist(), kinds, 40)
    assert np.allclose(model.prior, prior) and np.allclose(model.accuses, accuses)
    for row, p in zip(patterns.tolist(), model.posterior(patterns), strict=True):
        each = [prior[c] * np.prod([1.0 if v == -1 else accuses[c][j] if v == 0 else 1 - accuses[c][j] for j, v in enumerate(row)]) for c in range(3)]
        assert abs(p - each[0] / sum(each)) < 1e-9


def plain_votes(text):
    """The labellers by their definitions, character by character."""
    raw, words = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(len(words), 1)
    ink = [b for b in raw if b not in b" \t\n\r\x0b\x0c"]
    upper = sum(65 <= b <= 90 for b in ink)
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 for b in ink)
    mark = lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"
    runs = [len(list(g)) for _, g in itertools.groupby(words)]
    measures = [
        (sum(chr(b) in "#*$%&|<>" for b in raw) / n, 0.02, 0.1), (sum(map(mark, raw)) / n, 0.05, 0.15), (sum(mark(w.encode()[-1]) for w in words) / n, 0.05, 0.1),
        (-letters / max(len(ink), 1), -0.93, -0.87), (upper / max(letters, 1), 0.2, 0.4), (sum(r - 1 for r in runs) / n, 0.1, 0.2), (sum(max(0, r - 2) for r in runs) / n, 0.02, 0.1), (max(runs, default=0), 3, 3),
    ]
    return [-1 if len(words) < weak_labels.FEW else 0 if x > bad else 1 if x < good else -1 for x, good, bad in measures]


def junk(seed=3):
    rng = random.Random(seed)
    rows = texts()[:50]
    rows += [(300 + i, " ".join(x + rng.choice(["###", "$$", "%!", ""]) for x in words(rng, 40))) for i in range(12)]
    rows += [(400 + i, " ".join(itertools.chain.from_iterable([x] * rng.randint(1, 6) for x in words(rng, 12)))) for i in range(12)]
    return rows + [(500 + i, " ".join(words(rng, 30)).upper() + " !!") for i in range(6)]


def test_votes_equal_brute_force():
    rows = [t for _, t in junk()]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])
    got = np.concatenate([weak_labels.votes(chunk) for _, _, chunk in T.chunks(batch, "text", most=3000)])
    assert got.tolist() == [plain_votes(t) for t in rows]


def test_the_query_equals_brute_force(spark):
    """Votes, estimation, features and scorer in plain loops, over every row."""
    rows = junk()
    every = [plain_votes(t) for _, t in rows]
    kinds = [[weak_labels.LABELLERS.index(x) for x in kind] for kind in weak_labels.KINDS]
    patterns = sorted(set(map(tuple, every)))
    prior, accuses = plain_labels([list(p) for p in patterns], [every.count(list(p)) for p in patterns], kinds, 300)

    def good(row):
        each = [prior[c] * np.prod([1.0 if v == -1 else accuses[c][j] if v == 0 else 1 - accuses[c][j] for j, v in enumerate(row)]) for c in range(len(prior))]
        return each[0] / sum(each)

    size, found = weak_labels.WEIGHTS, []
    for _, t in rows:
        (_, _, chunk), = T.chunks(pa.RecordBatch.from_arrays([pa.array([t])], ["text"]), "text")
        _, hashes = weak_labels.features(chunk)
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert len(hashes) == 3 * n - 1  # words, shapes, pairs of shapes
        found.append({int(h): c / n for h, c in collections.Counter((hashes % np.uint64(size)).tolist()).items()})
    target = [good(v) for v in every]
    cost = [y / max(sum(target), 1) + (1 - y) / max(sum(1 - x for x in target), 1) for y in target]
    used = sorted({f for own in found for f in own}) + [size]
    w, one, two = (dict.fromkeys(used, 0.0) for _ in range(3))
    for step in range(1, weak_labels.EPOCHS + 1):
        grad = {f: 1e-6 * w[f] for f in used}
        for own, y, c in zip(found, target, cost, strict=True):
            z = sum(w[f] * v for f, v in own.items()) + w[size]
            slope = (1 / (1 + math.exp(-z)) - y) * c / sum(cost)
            for f, v in own.items():
                grad[f] += v * slope
            grad[size] += slope
        for f in used:
            one[f], two[f] = 0.9 * one[f] + 0.1 * grad[f], 0.99 * two[f] + 0.01 * grad[f] ** 2
            w[f] -= 0.3 * (one[f] / (1 - 0.9**step)) / (math.sqrt(two[f] / (1 - 0.99**step)) + 1e-6)
    got = {r.doc_id: r for r in weak_labels.classified(frame(spark, rows)).collect()}
    for (i, t), own, y in zip(rows, found, target, strict=True):
        n = len(t.split())
        z = (n * (sum(w[f] * v for f, v in own.items()) + w[size]) + weak_labels.SMOOTH_WORDS * math.log(prior[0] / (1 - prior[0]))) / (n + weak_labels.SMOOTH_WORDS)
        assert abs(got[i].posterior - y) < 1e-6
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 2e-3, (i, got[i].score)
        assert got[i].kept == (got[i].score >= weak_labels.THRESHOLD)


def test_the_scorer_learns_a_linear_rule():
    rng = np.random.default_rng(2)
    rows = [(np.array([int(k), 10 + rng.integers(50)]), np.array([0.5, 0.5])) for k in rng.integers(0, 2, 400)]
    target = np.array([float(f[0]) for f, _ in rows])
    w = weak_labels.fit_scorer(rows, target, 64)
    z = np.array([(w[f] * v).sum() + w[64] for f, v in rows])
    assert ((z > 0) == (target > 0.5)).all()


def test_long_texts_are_fitted_on_all_their_features():
    text = " ".join(f"u{i}" for i in range(6000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["h", "text"])
    (row,) = pa.Table.from_batches(list(weak_labels._drawn(iter([batch])))).to_pylist()
    f, v = np.frombuffer(row["f"], "<u2").astype(int), np.frombuffer(row["v"], "<f4")
    (_, _, chunk), = T.chunks(batch, "text")
    _, hashes = weak_labels.features(chunk)
    expected = np.bincount((hashes % np.uint64(weak_labels.WEIGHTS)).astype(int), minlength=weak_labels.WEIGHTS) / 6000
    assert np.allclose(np.bincount(f, weights=v, minlength=weak_labels.WEIGHTS), expected)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = weak_labels.classified(spark.read.parquet(f"{path}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.99
    assert 1 - sum(bad) / len(bad) > 0.95


def test_odd_rows(spark):
    out = weak_labels.classified(odd(spark)).collect()
    assert len(out) == 10 and sum(r.score == 0 and not r.kept for r in out) == 4
    kept = weak_labels.accepted(odd(spark), threshold=-1.0)
    assert kept.count() == 10 and kept.columns == odd(spark).columns
    assert weak_labels.classified(empty(spark)).collect() == []


def test_equal_runs_give_equal_scores(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30)) + (" ###" * (i % 3))) for i in range(60)]
    score = lambda n: {r.doc_id: r.score for r in weak_labels.classified(frame(spark, rows).repartition(n)).collect()}
    assert score(2) == score(5)
