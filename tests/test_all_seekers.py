"""Ratings over more than 400 zones: every zone asks, whatever their number."""

import math
import os

import duckdb
import numpy as np
import pytest

from tramline import catalog
from tramline.adapters import Tables
from tramline.operators import audit
from tramline.plans import questions, scoring, spatial

N = 450
ALL = "seekers AS (SELECT zone_id AS seeker_id, x, y FROM zones_xy)"


@pytest.fixture(scope="module")
def town(spark, sf, tmp_path_factory):
    """The smallest tables with 450 zones."""
    path = str(tmp_path_factory.mktemp("town"))
    for f in os.listdir(sf):
        if f not in ("supplier.parquet", "part.parquet"):
            os.symlink(f"{sf}/{f}", f"{path}/{f}")
    spark.range(N).selectExpr("id * 3 as s_suppkey", "concat('stop ', id) as s_name").write.parquet(f"{path}/supplier.parquet")
    kinds = "element_at(array('PROMO', 'SMALL', 'LARGE', 'ECONOMY', 'STANDARD'), cast(id % 7 % 5 + 1 as int))"
    spark.range(90).selectExpr("id as p_partkey", "'p' as p_name", "concat('b', id % 3) as p_brand", f"{kinds} as p_type", "cast(id % 11 as int) as p_size").write.parquet(f"{path}/part.parquet")
    return path


@pytest.fixture
def unsampled(monkeypatch):
    def sample(t):
        raise AssertionError("a sample of the zones was taken")

    for module in (questions, scoring):
        monkeypatch.setattr(module, "seekers", sample, raising=False)


def test_qualities_of_all_rows_are_those_with_every_zone_a_seeker(spark):
    rng = np.random.default_rng(4)
    zones = spark.createDataFrame([(f"z{i}",) for i in range(30)], "seeker_id string")
    keys = [(q, f"z{i}", None if q == "holes" and i == 3 else f"k{rng.integers(0, 5)}", float(rng.integers(0, 9))) for q in ("a", "b", "holes") for i in range(30)]
    keys = [(q, z, k, None if k is None else v) for q, z, k, v in keys] + [("none", "z1", None, None)]
    rows = spark.createDataFrame(keys, "question string, zone_id string, class_key string, value double")
    for quality, column in ((audit.matching_quality, "class_key"), (audit.measuring_quality, "value")):
        df = rows.select("question", "zone_id", column)
        got, want = ({r.question: r for r in quality(df, *asked).collect()} for asked in ((), (zones,)))
        assert got.keys() == want.keys() == {"a", "b", "holes", "none"}
        assert all(got[q].quality == pytest.approx(want[q].quality, abs=1e-12) for q in got) and (got["holes"].quality, got["none"].quality) == (0.0, 0.0)
        assert 0 < got["a"].quality < 1


def test_every_zone_asks_the_audit(spark, town, unsampled):
    """Shares over all pairs of zones, by arrays."""
    t = Tables(spark, town)
    xy = np.array([(r.x, r.y) for r in spatial.S.projected(t.zones).collect()])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    even = lambda p: min(p, 1 - p) / 0.5
    got = {r.question_id: r.quality for r in questions.questions_of_all(t).collect()}
    for r in questions.RADARS:
        assert got[f"radar_{int(r)}"] == pytest.approx(even((d <= r).mean()), abs=1e-12)
    for leg in questions.LEGS:
        hot = [(p[:, None] < p[None] + leg / 2).mean() for u, v in questions.V.BEARINGS for p in [xy[:, 0] * u + xy[:, 1] * v]]
        assert got[f"thermometer_{int(leg)}"] == pytest.approx(even(np.mean(hot)), abs=1e-3)  # arrays may round a tie otherwise
    lengths = [len(f"stop {i}") for i in range(N)]
    assert got["name_length"] == pytest.approx(even(sum(lengths.count(k) ** 2 for k in set(lengths)) / N**2), abs=1e-12)


def plain(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["a40_subscores", "a41_fitness", "d11_metric_points", "d12_findings", "d13_house_rules"])
def test_a_rating_is_its_sql_with_all_zones_as_seekers(spark, town, unsampled, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(town)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{town}/{f}{'/*.parquet' if os.path.isdir(f'{town}/{f}') else ''}'")
    sql = catalog.oracle_sql()[name]
    assert spatial.SEEKERS in sql
    got = con.execute(sql.replace(spatial.SEEKERS, ALL))
    columns = [c[0] for c in got.description]
    want = sorted((tuple(map(plain, r)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in catalog.queries()[name](spark, town).select(*columns).collect()), key=repr) == want


def test_every_zone_asks_for_a_zones_survival(spark, town, unsampled):
    """Zones inside and outside each zone's disc, by arrays; repeated and missing positions count as they do with seekers."""
    t = Tables(spark, town)
    rows = [(r.zone_id, r.x, r.y) for r in spatial.S.projected(t.zones).collect()]
    xy = np.array([r[1:] for r in rows])
    inn = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) <= 800
    k = inn.sum(0)
    survival = np.where(inn, k, N - k).sum(1) / N / N
    photo = [int(z[-2:]) % 7 for z, *_ in rows]
    p = np.array([photo.count(c) / N for c in photo])
    got = {r.zone_id: r for r in scoring.zone_measures(t).select("zone_id", "pin_worst", "mean_survival").collect()}
    assert len(got) == N
    for i, (z, *_) in enumerate(rows):
        assert got[z].pin_worst == pytest.approx(max(1 - p[i], (1 - survival[i]) / 2), abs=1e-12)
        assert got[z].mean_survival == pytest.approx((p[i] + survival[i] / 2) / 1.5, abs=1e-12)


def test_a_radar_of_all_zones_is_the_radar_with_all_seekers(spark):
    rows = [("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 700.0, 0.0), ("d", 1400.0, 0.0), ("e", 1e6, 5.0), ("lost", None, None)]
    zones = spark.createDataFrame(rows, "zone_id string, x double, y double")
    asked = zones.selectExpr("zone_id as seeker_id", "x as sx", "y as sy")
    want = {r.zone_id: r.agree for r in questions.V.radar(zones, asked, 800.0).collect()}
    # a: 3 + 3 inside a's and b's discs, 4 inside c's, and outside of d's (2), e's (1) and that without a place (0) of 6 zones
    assert {r.zone_id: r.agree for r in questions.V.radar_of_all(zones, 800.0).collect()} == want and want["a"] == 3 + 3 + 4 + 4 + 5 + 6
    assert questions.V.radar_of_all(zones.limit(0), 800.0).count() == 0
