import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tramline.operators import graph, kernels, routing


def test_hull_and_circle():
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 60):
        pts = [(rng.randint(0, 20) * 1.0, rng.randint(0, 20) * 1.0) for _ in range(n)]
        hull = kernels.hull_points(pts)
        for a, b in zip(hull, hull[1:] + hull[:1], strict=True):
            assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-9 for p in pts)
        x, y, r = kernels.smallest_circle(pts)
        assert all(math.hypot(p[0] - x, p[1] - y) <= r + 1e-6 for p in pts)
        best = 0.0
        for a, b in itertools.combinations(pts, 2):
            best = max(best, math.dist(a, b) / 2)
        assert r >= best - 1e-9 and r <= best * 2 / math.sqrt(3) + 1e-6


def cover_graph(seed, n=120):
    rng = random.Random(seed)
    pts = [(rng.random() * 10, rng.random() * 10) for _ in range(n)]
    near = {a: {b for b in range(n) if b != a and math.dist(pts[a], pts[b]) <= 1} for a in range(n)}
    return near, [rng.randint(0, 5) for _ in range(n)]


def brute_cover(near, events):
    """One pick at a time: the uncovered vertex with the most uncovered neighbours, then events, then the smaller one."""
    left, out = set(near), []
    while left:
        best = min(left, key=lambda v: (-len(near[v] & left), -events[v], v))
        out.append((best, len(near[best] & left)))
        left -= near[best] | {best}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_cover_equals_one_pick_at_a_time(seed):
    near, events = cover_graph(seed)
    pairs = np.array([(a, b) for a in near for b in near[a] if a < b]).reshape(-1, 2)
    centres, degree = kernels.greedy_cover(len(near), np.array(events), pairs[:, 0], pairs[:, 1])
    assert list(zip(centres.tolist(), degree.tolist(), strict=True)) == brute_cover(near, events)


def test_cover_by_joins_equals_the_kernel(spark, monkeypatch):
    near, events = cover_graph(9, 60)
    stops = spark.createDataFrame([(f"s{v:03d}", e) for v, e in enumerate(events)], "stop_id string, events long")
    pairs = spark.createDataFrame([(f"s{a:03d}", f"s{b:03d}") for a in near for b in near[a] if a < b], "a string, b string")
    expected = {(f"s{v:03d}", events[v], d) for v, d in brute_cover(near, events)}
    assert {tuple(r) for r in kernels.cover(stops, pairs).collect()} == expected
    monkeypatch.setattr(kernels, "KERNEL_PAIRS", 0)
    assert {tuple(r) for r in kernels.cover(stops, pairs).select("stop_id", "events", "degree").collect()} == expected


def test_simplified_lines_stay_near():
    rng = np.random.default_rng(3)
    x, y = np.arange(80.0), np.cumsum(rng.normal(size=80))
    keep = kernels.rdp(x, y, 1.5)
    assert keep[0] and keep[-1] and keep.sum() < 80
    at = np.flatnonzero(keep)
    for a, b in zip(at, at[1:], strict=False):
        for i in range(a + 1, b):
            t = ((x[i] - x[a]) * (x[b] - x[a]) + (y[i] - y[a]) * (y[b] - y[a])) / ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2)
            t = min(1, max(0, t))
            assert math.hypot(x[i] - x[a] - t * (x[b] - x[a]), y[i] - y[a] - t * (y[b] - y[a])) <= 1.5 + 1e-9
    assert kernels.rdp(np.zeros(0), np.zeros(0), 1).sum() == 0


def test_segments_chain():
    lines = kernels.chained([(1, [(0, 0), (1, 0)]), (2, [(2, 0), (1, 0)]), (3, [(2, 0), (2, 2)]), (4, [(9, 9), (9, 10)])])
    assert lines[0] == ([1, 2, 3], 4.0) and lines[1] == ([4], 1.0)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300)]
    label, _ = graph.components(spark.createDataFrame(chain, "a long, b long"))
    got = {r.v: r.label for r in label.collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == got[100] == 100 and got[300] == 300


def day():
    rng = random.Random(4)
    rows = []
    for trip in range(60):
        stops, t = rng.sample(range(12), rng.randint(2, 6)), rng.randint(0, 3000)
        for seq, s in enumerate(stops):
            rows.append((trip, f"s{s:02d}", seq, t, t + 20))
            t += rng.randint(60, 400)
    events = pd.DataFrame(rows, columns=["trip_id", "stop_id", "seq", "arr_s", "dep_s"])
    walks = pd.DataFrame([("s00", "s01", 100), ("s01", "s00", 100), ("s05", "s06", 50), ("s06", "s05", 50)], columns=["from_stop", "to_stop", "walk_s"])
    return events, walks


def brute(events, walks, start, depart, legs, slack):
    """Earliest arrivals over all sequences of rides with at most one walk after the start and after each ride."""
    trips = {k: v.sort_values("seq").to_dict("records") for k, v in events.groupby("trip_id")}
    hop = [(r.from_stop, r.to_stop, r.walk_s) for r in walks.itertuples()]
    best = {start: depart}
    now = {start: depart}
    for a, b, w in hop:
        if a == start:
            now[b] = min(now.get(b, 10**9), depart + w)
    best.update(now)
    for _ in range(legs):
        rode = {}
        for rows in trips.values():
            for i, on in enumerate(rows):
                if on["stop_id"] in best and on["dep_s"] >= best[on["stop_id"]] + slack:
                    for off in rows[i + 1 :]:
                        rode[off["stop_id"]] = min(rode.get(off["stop_id"], 10**9), off["arr_s"])
        better = {s: t for s, t in rode.items() if t < best.get(s, 10**9)}
        new = dict(best)
        new.update(better)
        for a, b, w in hop:
            if a in better:
                new[b] = min(new.get(b, 10**9), better[a] + w)
        best = new
    return best


def day_frames(spark, origin, time):
    events, walks = day()
    return spark.createDataFrame(events), spark.createDataFrame(walks), spark.createDataFrame([("o", origin, time), ("far", "nowhere", 7)], "origin_id string, stop_id string, dep_s long")


def test_rounds_and_kernel_equal_brute_force(spark):
    events, walks, origins = day_frames(spark, "s00", 0)
    expected = brute(*day(), "s00", 0, 5, 30)
    got = {r.stop_id: (r.arr_s, r.legs) for r in routing.rounds(events, walks, origins, slack=30).filter("origin_id = 'o'").collect()}
    kernel = routing.journeys(events, walks, origins, slack=30).collect()
    assert {s: t for s, (t, _) in got.items()} == expected
    assert {r.stop_id: (r.arr_s, r.legs) for r in kernel if r.origin_id == "o"} == got
    assert [(r.stop_id, r.arr_s, r.legs) for r in kernel if r.origin_id == "far"] == [("nowhere", 7, 0)]


def test_steps_are_journeys():
    """Each step is a walk of the table or a ride that a trip makes, and the times add up."""
    events, walks = day()
    net = routing.Network(events, walks)
    best = net.earliest(net.stops.get_indexer(["s00", "s04"]), np.array([0, 500]), slack=30)
    trips = [v.sort_values("seq").to_dict("records") for _, v in events.groupby("trip_id")]
    hop = {(r.from_stop, r.to_stop): r.walk_s for r in walks.itertuples()}
    for column, (origin, start) in enumerate([("s00", 0), ("s04", 500)]):
        for stop in np.flatnonzero(best.arrival[:, column] < routing.NEVER):
            at, t, rides = origin, start, 0
            for how, a, b in net.steps(best, stop, column):
                assert a == at
                if how == "walk":
                    t += hop[a, b]
                else:
                    rides += 1
                    t = min(off["arr_s"] for rows in trips for i, on in enumerate(rows) if on["stop_id"] == a and on["dep_s"] >= t + 30 for off in rows[i + 1 :] if off["stop_id"] == b)
                at = b
            assert at == net.stops[stop] and t <= best.arrival[stop, column] and rides <= 5


def test_day_in_parts(spark, monkeypatch):
    """A worker that reads the day file by file, whole trips in each, finds the same arrivals and steps as from the whole day."""
    events, walks = day()
    trips = sorted(set(events.trip_id))
    parts = [events[events.trip_id.isin(trips[i::3])] for i in range(3)] + [events.iloc[:0]]
    one, many = routing.Network(events, walks), routing.Network(parts, walks)
    assert list(one.stops) == list(many.stops) and sum(len(t.stops) for t in many.trips) == len(trips)
    start, depart = one.stops.get_indexer(["s00", "s04"]), np.array([0, 500])
    for a, b in ((one, many), (one.mirrored(), many.mirrored())):
        x, y = (net.earliest(start, depart - (0 if net in (one, many) else 4000), slack=30) for net in (a, b))
        assert all((getattr(x, f) == getattr(y, f)).all() for f in ("arrival", "legs", "parent", "rode"))
    seen = []
    monkeypatch.setattr(routing.Network, "_of", lambda self, part: seen.append(set(part.trip_id)) or [])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = routing.new_path(spark, "parts")
        monkeypatch.setattr(routing, "new_path", lambda s, name: f"{at}/{name}")
        routing.journeys(spark.createDataFrame(events).repartition(5), spark.createDataFrame(walks), spark.createDataFrame([("o", "s00", 0)], "origin_id string, stop_id string, dep_s long"))
        routing.Network(routing.Files(f"{at}/day"), walks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([s for s in seen if s]) > 1 and sum(map(len, seen)) == len(trips)  # no trip in two files


def test_trips_that_overtake():
    events = pd.DataFrame([(1, "a", 0, 0, 10), (1, "b", 1, 900, 900), (2, "a", 0, 0, 20), (2, "b", 1, 100, 100)], columns=["trip_id", "stop_id", "seq", "arr_s", "dep_s"])
    net = routing.Network(events, pd.DataFrame({"from_stop": [], "to_stop": [], "walk_s": []}))
    best = net.earliest(net.stops.get_indexer(["a"]), np.array([0]), slack=0)
    assert best.arrival[net.stops.get_loc("b"), 0] == 100


def test_latest_departures(spark):
    """Leaving then, one is there in time; a second later, one isn't. Both forms agree."""
    events, walks, targets = day_frames(spark, "s03", 3600)
    late = {r.stop_id: r.dep_s for r in routing.latest(events, walks, targets, slack=30).filter("origin_id = 'o'").collect()}
    kernel = {r.stop_id: r.arr_s for r in routing.journeys(events, walks, targets, slack=30, backward=True).collect() if r.origin_id == "o"}
    assert kernel == late and len(late) > 5
    for s, t in late.items():
        assert brute(*day(), s, t - 30, 5, 30).get("s03", 10**9) <= 3600


def test_representative_points_lie_inside():
    assert kernels.representative([(0, 0), (4, 0), (4, 4), (0, 4)]) == (2, 2)
    u = [(0, 0), (9, 0), (9, 9), (7, 9), (7, 2), (2, 2), (2, 9), (0, 9)]  # the centroid falls into the gap
    x, y = kernels.representative(u)
    assert (0 < x < 2 or 7 < x < 9) and 2 < y < 9
    assert kernels.representative([(1, 1), (2, 2), (3, 3)]) == (1, 1)


def test_positions_along_a_line_never_go_back():
    line = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0), (100, 0)]  # a loop that passes its start again
    got = kernels.along(line, [(10, 1), (100, 50), (0, 50), (50, 0), (9000, 0)], 60)
    assert got[:4] == [10, 150, 350, 450] and got[4] is None
    assert kernels.along([(0, 0)], [(0, 0)], 5) == [0.0]


def crowded(spark):
    """The day with stops that share places: walks by stop, walks between places, and who stands where."""
    events, _ = day()
    at = {s: min(x for x in set(events.stop_id) if int(x[1:]) % 4 == int(s[1:]) % 4) for s in set(events.stop_id)}
    seconds = {(a, b): 0 if a == b else 40 + 30 * abs(int(a[1:]) - int(b[1:])) for a in set(at.values()) for b in set(at.values()) if a == b or (int(a[1:]) + int(b[1:])) % 4 != 3}
    by_stop = pd.DataFrame([(a, b, seconds[at[a], at[b]]) for a in at for b in at if a != b and (at[a], at[b]) in seconds], columns=["from_stop", "to_stop", "walk_s"])
    between = pd.DataFrame([(a, b, s) for (a, b), s in seconds.items()], columns=["from_stop", "to_stop", "walk_s"])
    return events, by_stop, between, pd.DataFrame(at.items(), columns=["stop_id", "place"])


def test_walks_between_places_hold_for_their_stops(spark):
    events, by_stop, between, places = crowded(spark)
    frame = spark.createDataFrame
    origins = frame([("o", "s00", 0), ("p", "s05", 300)], "origin_id string, stop_id string, dep_s long")
    plain = {tuple(r) for r in routing.journeys(frame(events), frame(by_stop), origins, slack=30).collect()}
    assert {(r[1], r[2]) for r in plain if r[0] == "o"} == set(brute(events, by_stop, "s00", 0, 5, 30).items())
    assert {tuple(r) for r in routing.journeys(frame(events), frame(between), origins, slack=30, places=frame(places)).collect()} == plain  # steps too
    assert {tuple(r) for r in routing.rounds(frame(events), frame(between), origins, slack=30, places=frame(places)).collect()} == {r[:4] for r in plain}
    back = {tuple(r)[:4] for r in routing.journeys(frame(events), frame(by_stop), origins.withColumn("dep_s", F.lit(4000)), slack=30, backward=True).collect()}
    assert {tuple(r)[:4] for r in routing.journeys(frame(events), frame(between), origins.withColumn("dep_s", F.lit(4000)), slack=30, backward=True, places=frame(places)).collect()} == back
    assert {tuple(r) for r in routing.latest(frame(events), frame(between), origins.withColumn("dep_s", F.lit(4000)), slack=30, places=frame(places)).collect()} == back


def test_boardings_of_rounds_dont_become_rows(spark):
    """Twenty origins board all of 300 trips at one stop: that is 6,000 boardings, and no stage hands on nearly as many rows."""
    n, trips = 20, 300
    events = spark.range(trips).selectExpr("id as trip_id", "explode(array(named_struct('s', 'hub', 'q', 1), named_struct('s', concat('e', id % 3), 'q', 2))) as c").selectExpr("trip_id", "c.s as stop_id", "c.q as seq", "1000 + trip_id + 60 * c.q as arr_s", "1000 + trip_id + 60 * c.q as dep_s")
    origins = spark.range(n).selectExpr("concat('o', id) as origin_id", "'hub' as stop_id", "0L as dep_s")
    walks = spark.createDataFrame([], "from_stop string, to_stop string, walk_s int")
    store = spark.sparkContext._jsc.sc().statusStore()
    last = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    first = last()
    rows = {tuple(r) for r in routing.rounds(events, walks, origins).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert rows == {(f"o{i}", "hub", 0, 0) for i in range(n)} | {(f"o{i}", f"e{j}", 1120 + j, 1) for i in range(n) for j in range(3)}
    made = []
    for k in range(first, last()):
        try:
            made.append(store.lastStageAttempt(k).shuffleWriteRecords())
        except Exception:  # never ran
            continue
    assert made and max(made) < n * trips / 4


def test_rounds_in_blocks_of_origins(spark, monkeypatch):
    """Labels of one origin at a time, and chunks of single trips, give the same; so do calls of equal seq and without times."""
    events, walks, origins = day_frames(spark, "s00", 0)
    origins = origins.unionByName(spark.createDataFrame([("o", "s03", 100), ("p", "s05", 300), ("q", "s07", 50)], origins.schema))
    odd = spark.createDataFrame([(900, "s00", 1, 10, 500), (900, "s90", 1, 20, 500), (900, "s91", 2, None, None), (900, "s92", 3, 700, 700)], "trip_id long, stop_id string, seq long, arr_s long, dep_s long")
    events = events.select("trip_id", "stop_id", "seq", "arr_s", "dep_s").union(odd.withColumn("trip_id", F.lit("odd")) if dict(events.dtypes)["trip_id"] == "string" else odd)
    whole = {tuple(r) for r in routing.rounds(events, walks, origins, slack=30).collect()}
    assert ("o", "s92", 700, 1) in whole and not any(r[1] in ("s90", "s91") for r in whole)
    monkeypatch.setattr(routing, "CELLS", 8)
    assert {tuple(r) for r in routing.rounds(events, walks, origins, slack=30).collect()} == whole


def test_walks_dont_grow_with_the_stops_of_a_place(spark, tmp_path):
    """Stops repeat their positions every 1,200, so 3,600 have the walks of 1,200 and those within the places."""
    from tramline.adapters import Tables
    from tramline.plans import journeys

    for n in (1200, 3600):
        spark.range(n).selectExpr("id as s_suppkey", "'x' as s_name").write.parquet(f"{tmp_path}/{n}/supplier.parquet")
    few, many = (Tables(spark, f"{tmp_path}/{n}") for n in (1200, 3600))
    assert journeys.walks(few).count() == journeys.walks(many).count()
    assert journeys.places(many).groupBy("place").count().select("count").distinct().collect() == [(3,)]
