import random

from tramline.llm import tiling

from .corpus import empty, frame, odd, words


def naive_tiles(p, t, least):
    used_p, used_t, out = set(), set(), 0
    while True:
        best = 0, None, None
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and i + k not in used_p and j + k not in used_t:
                    k += 1
                if k > best[0]:
                    best = k, i, j
        k, i, j = best
        if k < least:
            return out
        out += k
        used_p |= set(range(i, i + k))
        used_t |= set(range(j, j + k))


def test_tiles_equal_a_naive_search():
    rng = random.Random(1)
    for _ in range(150):
        p = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        t = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        tiles = tiling.tile(p, t, 3)
        assert sum(n for _, _, n in tiles) == naive_tiles(p, t, 3)
        marked_p = [i for a, _, n in tiles for i in range(a, a + n)]
        marked_t = [j for _, b, n in tiles for j in range(b, b + n)]
        assert len(set(marked_p)) == len(marked_p) and len(set(marked_t)) == len(marked_t)
        assert all(p[a + k] == t[b + k] for a, b, n in tiles for k in range(n))


def world(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, 40))) for i in range(6)]
    body = lambda n: " ".join(words(rng, n))
    first = items[0][1].split()
    shuffled = " ".join(first[20:] + ["zz"] + first[:20])
    few = " ".join(items[1][1].split()[:10])
    rows = [(0, body(80)), (1, f"{body(30)} {items[2][1].upper()}, {body(20)}"), (2, f"{body(10)} {shuffled} {body(50)}"), (3, f"{body(30)} {few} {body(30)}"), (4, items[3][1] + " " + items[4][1])]
    bench = spark.createDataFrame([*items, (None, "a b c d"), (9, None), (10, "too short")], "item_id long, text string")
    return frame(spark, rows), bench


def test_passages_are_caught_also_out_of_order(spark):
    docs, bench = world(spark)
    got = {r.doc_id: (r["items"], r.kept) for r in tiling.contaminated(docs, bench).collect()}
    assert got == {0: ([], True), 1: ([2], False), 2: ([0], False), 3: ([], True), 4: ([3, 4], False)}


def test_blocks_give_the_same_result(spark):
    docs, bench = world(spark)
    key = lambda r: (r.doc_id, r["items"], r.best_item, r.coverage, r.kept)
    one = sorted(map(key, tiling.contaminated(docs, bench).collect()))
    many = sorted(map(key, tiling.contaminated(docs, bench, block_tokens=50).collect()))
    assert [x[:2] for x in one] == [x[:2] for x in many] and [x[3:] for x in one] == [x[3:] for x in many]
    assert [r.doc_id for r in tiling.clean(docs, bench, block_tokens=50).orderBy("doc_id").collect()] == [0, 3]


def test_odd_rows(spark):
    _, bench = world(spark)
    rows = odd(spark)
    assert len(tiling.contaminated(rows, bench).collect()) == 10
    assert tiling.clean(rows, bench).columns == rows.columns
    assert tiling.clean(rows, bench).count() == 10
    assert tiling.contaminated(empty(spark), bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.kept for r in tiling.contaminated(rows, none).collect())


def test_case_of_other_letters(spark):
    item = " ".join(f"éà{chr(97 + i)}ñö" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = tiling.contaminated(frame(spark, [(0, f"xx {item.upper()}! yy")]), bench).first()
    assert got["items"] == [1] and got.coverage == 1.0
