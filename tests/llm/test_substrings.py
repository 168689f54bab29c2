import hashlib
import random
import re

from tramline.llm import substrings

from .corpus import empty, frame, odd, texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=20):
    first = {}
    split = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(split):
        for p in range(len(split[i]) - k + 1):
            first.setdefault(tuple(split[i][p : p + k]), (i, p))
    out = {}
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (i, p):
                gone |= set(range(p, p + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def more(seed=11):
    rng = random.Random(seed)
    rows = texts()
    shared = [words(rng, rng.randint(18, 70)) for _ in range(6)]
    for i in range(40):
        parts = [w for _ in range(rng.randint(1, 4)) for w in (*words(rng, rng.randint(0, 25)), *rng.choice(shared))]
        rows.append((500 + i, " ".join(parts)))
    rows.append((900, " ".join(["again"] * 75)))
    rows.append((901, " ".join((words(rng, 30)) * 3)))
    return rows


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = more()
    assert found(substrings.remove_repeats(frame(spark, rows).repartition(6), cells=1 << 20)) == brute(rows)


def test_a_full_sketch_loses_nothing(spark):
    """With hardly any cells every window goes on to the exact pass."""
    rows = more(12)
    assert found(substrings.remove_repeats(frame(spark, rows).repartition(4), cells=512)) == brute(rows)


def test_blocks_don_t_matter(spark, monkeypatch):
    rows = more(13)
    monkeypatch.setattr(substrings, "BLOCK", 50)
    assert found(substrings.remove_repeats(frame(spark, rows).coalesce(2), cells=1 << 20)) == brute(rows)

def test_texts_that_stay(spark):
    rows = more()
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in substrings.without_repeats(docs, cells=1 << 20).collect()}
    expected = brute(rows)
    for i, t in rows:
        n, gone, digest = expected[i]
        if n and gone == n:
            assert i not in out
        else:
            assert hashlib.sha256(" ".join(WORD.findall(out[i].text)).encode()).hexdigest() == digest
            assert out[i].text == t if not gone else out[i].n_chars == len(out[i].text)


def test_odd_rows(spark):
    rows = odd(spark)
    out = substrings.remove_repeats(rows, cells=1 << 20).collect()
    assert len(out) == 10
    by = {r.doc_id: r for r in out}
    assert by[4].n_removed == 0 and by[8].n_removed == by[8].n_words == 30_000
    assert by[1].n_words == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    kept = substrings.without_repeats(rows, cells=1 << 20)
    assert kept.columns == rows.columns and kept.count() == 9
    assert substrings.remove_repeats(empty(spark)).collect() == []
