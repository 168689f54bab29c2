import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.llm import _text as T
from tramline.llm import repetition

from .corpus import empty, frame, odd, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_base_equals_brute_force(spark):
    rng = random.Random(2)
    rows = texts() + [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) + "\n\n| é# ") for i in range(40)]
    got = {r.doc_id: r for r in repetition.repetition(frame(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        n, *rest = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest), t
        assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (r.kept and r.base_failed)


def naive_repeats(w):
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_longest_repeats():
    rng = random.Random(3)
    docs = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(60)] + [["a"] * 33, ["a", "b"] * 20]
    raw = [" ".join(d).encode() for d in docs]
    data = np.frombuffer(b"".join(raw), np.uint8)
    chunk = T.Chunk(data, np.cumsum([0, *map(len, raw)]))
    got = repetition.repeats(chunk)
    for i, d in enumerate(docs):
        assert got[chunk.word_offsets[i] : chunk.word_offsets[i + 1]].tolist() == naive_repeats(d)


def test_repeated_passage_is_rejected(spark):
    rng = random.Random(4)
    body = " ".join(f"u{i}" for i in range(900))
    part = " ".join(f"p{rng.randrange(10**6)}" for _ in range(160))
    rows = [(1, body), (2, f"{body} {part} {body[:0]} x {part}")]
    got = {r.doc_id: r for r in repetition.repetition(frame(spark, rows), max_covered=1.0).collect()}
    assert got[1].kept and got[1].longest_repeat == 0
    assert got[2].longest_repeat == 160 and not got[2].kept


def test_each_limit_rejects_texts_that_pass_the_base(spark):
    body = lambda n: " ".join(f"u{i}" for i in range(n))
    part = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    twice = lambda n, *parts: " ".join([*parts, body(n), *[f"x{i} {p}" for i, p in enumerate(parts)]])
    rows = [(1, twice(600, part("a", 25), part("b", 25))), (2, twice(2000, part("a", 60))), (3, twice(600, part("a", 60))), (4, twice(1000, part("a", 40)))]
    got = {r.doc_id: r for r in repetition.repetition(frame(spark, rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i: r.longest_repeat for i, r in got.items()} == {1: 25, 2: 60, 3: 60, 4: 40}
    assert {i: r.kept for i, r in got.items()} == {1: False, 2: False, 3: False, 4: True}
    by_longest = {r.doc_id: r.kept for r in repetition.repetition(frame(spark, rows), max_covered=1.0).collect()}
    by_covered = {r.doc_id: r.kept for r in repetition.repetition(frame(spark, rows), max_longest=10**6).collect()}
    assert by_longest == {1: True, 2: False, 3: False, 4: True} and by_covered == {1: False, 2: True, 3: False, 4: True}


def test_odd_rows(spark):
    out = repetition.repetition(odd(spark)).collect()
    assert len(out) == 10 and sum(r.n_words == 0 and r.base_failed and not r.kept for r in out) == 4
    assert repetition.repetition(empty(spark)).collect() == []


@given(st.lists(st.text(alphabet="ab \n\t", max_size=40), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_any_texts_repeats(cases):
    raw = [c.encode() for c in cases]
    chunk = T.Chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = repetition.repeats(chunk)
    for i, c in enumerate(cases):
        assert got[chunk.word_offsets[i] : chunk.word_offsets[i + 1]].tolist() == naive_repeats(WORD.findall(c))
