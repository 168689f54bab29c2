import numpy as np

from tramline.llm import _text as T
from tramline.llm import near_dup

from .corpus import empty, frame, odd, texts


def grams(text, k=5):
    w = [x for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute_rows(rows):
    """(size, component, kept) of every row: rows are linked by their texts, ids only name the components."""
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    pairs = [(a, b) for a in label for b in label if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(i, least.get(x, i))
    return [(i, len(s), least[x], least[x] == i) for (i, _), s, x in zip(rows, sets, label)]


def brute(rows):
    return {r[0]: r[1:] for r in brute_rows(rows)}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = texts()
    assert found(near_dup.near_duplicates(frame(spark, rows).repartition(5))) == brute(rows)


def test_a_group_without_a_middle(spark):
    """Copies that link only in a chain still come to one component."""
    import random

    from .corpus import words

    rng = random.Random(9)
    line, rows = words(rng, 200), []
    for i in range(40):
        rows.append((i, " ".join(line)))
        line = line[8:] + words(rng, 8)
    expected = brute(rows)
    assert len({v[1] for v in expected.values()}) < 5
    assert found(near_dup.near_duplicates(frame(spark, rows))) == expected


def test_odd_rows(spark):
    out = near_dup.near_duplicates(odd(spark)).collect()
    assert len(out) == 10
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_shingles == by[2][0].n_shingles == by[3][0].n_shingles == 0
    assert by[1][0].kept and by[2][0].kept
    assert by[8][0].component_id == 4 and not by[8][0].kept
    assert [r.kept for r in by[5]] == [True, True]
    assert len(by[None]) == 2


def repeated_ids(seed=3):
    """Rows that share an id but not a text, among exact and near copies."""
    import random

    from .corpus import words

    rng = random.Random(seed)
    a, b = " ".join(words(rng, 60)), " ".join(words(rng, 60))
    rows = [(3, a), (9, a), (9, b), (12, b), (3, "")]
    some = [" ".join(words(rng, 40)) for _ in range(12)]
    for _ in range(80):
        w = rng.choice(some).split()
        w[rng.randrange(40)] = rng.choice("xyz")
        rows.append((100 + rng.randrange(25), " ".join(w)))
    return rows


def test_ids_that_repeat_with_other_texts(spark):
    rows = repeated_ids()
    got = near_dup.near_duplicates(frame(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(brute_rows(rows))
    small = sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id < 100)
    assert small == [(3, 3, True), (3, 3, True), (9, 3, False), (9, 9, True), (12, 9, False)]


def test_one_text_of_each_group_stays(spark):
    rows = repeated_ids() + [(3, repeated_ids()[0][1])]
    docs = frame(spark, rows)
    left = [(r.doc_id, r.text) for r in near_dup.distinct_texts(docs).collect()]
    groups = {}
    sets = [grams(t) for _, t in rows]
    for i, s in enumerate(sets):
        near = [g for g, own in groups.items() if s and any(100 * len(s & sets[j]) >= 75 * len(s | sets[j]) for j in own)]
        merged = [i, *(j for g in near for j in groups.pop(g))]
        groups[min(merged)] = merged
    for own in groups.values():
        kept = {rows[i] for i in own if rows[i] in left}
        assert len(kept) == 1 and kept.pop()[0] == min(rows[i][0] for i in own)
    assert left.count(rows[0]) == 2  # the same document written twice


def test_empty_table(spark):
    assert near_dup.near_duplicates(empty(spark)).collect() == []


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = T.mix(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    a, b = pool[:2000], pool[500:2500]  # similarity 0.6
    doc = np.repeat([0, 1, 2], [2000, 2000, 1])
    sketch = near_dup.sketches(doc, np.concatenate([a, b, pool[:1]]), 3, 384)
    assert (sketch != ~np.uint64(0)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.6) < 0.1
    alone = near_dup.sketches(np.zeros(2000, int), a, 1, 384)
    assert (alone[0] == sketch[0]).all()
