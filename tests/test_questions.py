"""Questions over more features than the smallest tables hold, against brute force."""

from collections import Counter

import pytest

from tramline.adapters import Tables
from tramline.plans import questions, spatial


@pytest.fixture
def tables(spark, tmp_path):
    def make(n_zones, n_pois=1):
        path = str(tmp_path / f"t{n_zones}_{n_pois}")
        spark.createDataFrame([(i, f"stop {i}") for i in range(1, n_zones + 1)], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")
        pois = [(i, f"poi {i}", "b", "PROMO" if i % 3 else "SMALL", i % 50) for i in range(1, n_pois + 1)]
        spark.createDataFrame(pois, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
        return Tables(spark, path)

    return make


def test_every_feature_of_the_category(tables):
    t = tables(5, 300)
    assert {r.feature_id for r in questions.tentacle_features(t).collect()} == {i for i in range(1, 301) if i % 3}


def test_tentacle_equals_brute_force(tables):
    t = tables(60, 300)
    zones = questions._zones(t).collect()
    asked = spatial.seekers(t).collect()
    pois = questions.S.projected(t.pois.filter("category = 'PROMO'")).collect()
    d2 = lambda ax, ay, bx, by: (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    agree = Counter()
    for s in asked:
        near = [p for p in pois if d2(p.x, p.y, s.sx, s.sy) <= 900 * 900]
        answer = {z.zone_id: -1 if d2(z.x, z.y, s.sx, s.sy) > 900 * 900 else min(((d2(p.x, p.y, z.x, z.y), p.poi_id) for p in near), default=(0, -2))[1] for z in zones}
        sizes = Counter(answer.values())
        agree.update({z: sizes[k] for z, k in answer.items()})
    assert {r.zone_id: r.agree for r in questions.tentacle(t).collect()} == agree


@pytest.mark.parametrize("n, kept", [(20, 20), (100, 100), (400, 400), (401, 134), (950, 190)])
def test_seekers_are_the_reference_sample(tables, n, kept):
    """All zones up to 400, every ceil(n / 200)th beyond."""
    stride = 1 if n <= 400 else -(-n // 200)
    ids = sorted(r.seeker_id for r in spatial.seekers(tables(n)).collect())
    assert ids == [f"z{i:06d}" for i in range(1, n + 1, stride)] and len(ids) == kept


def test_every_zone_meets_every_seeker(tables):
    assert spatial.seeker_table(tables(100)).count() == 100 * 100


def chained(keys, linked):
    label = {k: k for k in keys}
    for _ in keys:
        for a in keys:
            for b in keys:
                if linked(a, b):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_box_chains_equal_brute_force(tables):
    t = tables(3, 120)
    box = {}
    for p in t.pois.collect():
        s, w, n, e = box.get(k := f"{p.brand}/{p.category}/{p.size}", (99, 999, -99, -999))
        box[k] = min(s, p.lat), min(w, p.lon), max(n, p.lat), max(e, p.lon)

    def near(a, b):
        (s, w, n, e), (s2, w2, n2, e2) = box[a], box[b]
        return max(0, max(s, s2) - min(n, n2)) <= 0.0005 and max(0, max(w, w2) - min(e, e2)) <= 0.0005

    assert {r.id: r.chain for r in spatial.box_chains(t).collect()} == chained(sorted(box), near)


def test_spot_clusters_equal_brute_force(tables):
    from tramline.plans import scoring

    t = tables(8, 200)
    zones, pois = questions._zones(t).collect(), questions.S.projected(t.pois).collect()
    far = lambda a, b: ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5
    expected = {}
    for z in zones:
        own = {p.poi_id: p for p in pois if far(z, p) <= 300}
        if own:
            label = chained(sorted(own), lambda a, b, own=own: far(own[a], own[b]) <= 100)
            expected[z.zone_id] = (len(set(label.values())), len(own))
    assert {r.zone_id: (r.clusters, r.spots) for r in scoring.spot_clusters(t).collect()} == expected
