import random
import re

from tramline.llm import licenses

from .corpus import empty, frame, odd

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def corpus():
    rng = random.Random(4)
    vocabulary = [w for p in licenses.PHRASES for w in p.split()] + ["x", "é", "under2", "K", "İ"]
    rows = [(i, "".join(rng.choice(vocabulary).upper() if rng.random() < 0.2 else rng.choice(vocabulary) + rng.choice([" ", "-", ", ", "\n", "/"]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(100, "Licensed under CC BY-NC 4.0."), (101, "Released UNDER the MIT License. under the mit license"), (102, "Licensed under the Apache License, Version 2.0."), (103, "cc by ncc by nc"), (104, "under the the mit license"), (105, "K İ CC BY NC"), (106, "...")]
    return rows


def test_base_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def brute_method(text, templates, coverage):
    """(labels, score, spans) by trying every template at every offset of the text."""
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    g, labels, score, spans = licenses.GRAM, set(), 0.0, set()
    for name, raw in templates.items():
        own = licenses.words_of(raw)
        m = len(own)
        at = {d: {j for j in range(m - g + 1) if 0 <= d + j and w[d + j : d + j + g] == own[j : j + g]} for d in range(-m, len(w))}
        for d in [d for d, js in at.items() if js]:
            hits = [(e, j) for e in range(d, d + licenses.NEAR + 1) for j in at.get(e, ())]
            agree = {j + i for _, j in hits for i in range(g)}
            inside = {e + j + i for e, j in hits for i in range(g)}
            share = len(agree) / m
            score = max(score, share)
            if share >= coverage and len(inside) >= coverage * (max(inside) + 1 - min(inside)):
                labels.add(name.partition("/")[0])
                spans.add((name, min(inside), max(inside) + 1, share))
    return labels, score, spans


def damaged(rng, words):
    """A template with words left out, put in, replaced or moved."""
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < 0.04 else [w, "very"] if r < 0.08 else ["other"] if r < 0.11 else [w]
    return out if rng.random() < 0.8 else out[len(out) // 2 :] + out[: len(out) // 2]


def test_labels_equal_brute_force(spark):
    rng = random.Random(6)
    names = list(licenses.TEXTS)
    templates = {n: licenses.TEXTS[n] for n in names}
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += ["lorem", "ipsum"] * rng.randint(0, 9) + damaged(rng, licenses.words_of(licenses.TEXTS[rng.choice(names)]))
        rows.append((i, " ".join(parts)))
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    found = 0
    for i, t in rows:
        labels, score, spans = brute_method(t, templates, licenses.COVERAGE)
        phrases = {p: p for p in licenses.PHRASES}
        assert set(filter(None, got[i].labels.split(","))) == labels | set(filter(None, got[i].base_labels.split(","))), t
        assert abs(got[i].score - max(score, brute_method(t, phrases, 1.0)[1])) < 1e-12
        assert {tuple(s) for s in got[i].spans} == spans
        found += len(labels)
    assert found > 40


def test_templates_with_words_put_in_or_left_out(spark):
    mit = licenses.words_of(licenses.TEXTS["mit/grant"])
    rows = [(0, " ".join(mit)), (1, " ".join([*mit[:8], "very", *mit[8:]])), (2, " ".join(mit[:4] + mit[6:])), (3, " ".join(mit[:20])), (4, "the quick brown fox"), (5, " ".join(mit[::-1]))]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[i][0] for i in range(6)] == ["mit", "mit", "mit", "", "", ""]
    assert got[0][1] == 1.0 and got[1][1] > 0.9 and got[5][1] == 0.0


def test_many_repeats_in_one_text(spark):
    rows = [(1, "under the mit license " * 5000)]
    r = licenses.scan(frame(spark, rows)).collect()[0]
    assert (r.n_base, r.first_word, r.last_word) == (5000, 0, 4 * 4999)


def test_odd_rows(spark):
    out = licenses.scan(odd(spark)).collect()
    assert len(out) == 10 and sum(r.n_words == 0 and r.labels == "" for r in out) == 4
    assert licenses.scan(empty(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
