"""What the rating reads of each stop's service days, against plain loops."""

import random
from statistics import median

from pyspark.sql import functions as F

from tramline.operators import headway as H
from tramline.plans import scoring


def test_medians_up_to_a_bound_by_counts(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([600, 899, 900, 901, 1200, None])) for g in range(300) for _ in range(g % 7)]
    got = spark.createDataFrame(rows, "g int, v int").groupBy("g").agg(*H.middle("v", 900), F.median("v").alias("m")).select("g", H.median_at_most(900).alias("low"), "m").collect()
    assert len(got) == len({g for g, _ in rows})
    assert all(r.low == (None if r.m is None else r.m <= 900) for r in got)
    assert {r.low for r in got} == {True, False, None}


class Few:
    """Tables of a few made-up trips."""

    def __init__(self, spark, rows):
        make = spark.createDataFrame
        self.trips = make(sorted({r[:4] for r in rows}, key=repr), "trip_id long, route_id string, direction_id int, service_id string")
        self.stop_times = make([(r[0], r[4], r[5], r[6], r[6]) for r in rows], "trip_id long, stop_id string, seq int, arr_s int, dep_s int")
        self.stops = make([(f"s{i}",) for i in range(4)], "stop_id string")
        self.calendar = make([("wd0",), ("wd1",)], "service_id string")


def test_stop_days(spark):
    rnd = random.Random(5)
    rows = []
    for trip in range(120):
        head = (trip, rnd.choice(["r1", "r2", None]), rnd.choice([0, 1]), rnd.choice(["wd0", "wd1", "off"]))
        rows += [(*head, f"s{rnd.randrange(5)}", i, rnd.choice([None, 300 * rnd.randrange(50, 290)])) for i in range(rnd.randrange(1, 6))]
    stops, trips = scoring.stop_days(Few(spark, rows))
    kept = [r for r in rows if r[3] != "off" and r[4] != "s4" and r[6] is not None]
    assert {(r.service_id, r.trips) for r in trips.collect()} == {(s, len({r[0] for r in kept if r[3] == s})) for s in ("wd0", "wd1")}

    def mid(times):
        times = sorted({x for x in times if 21600 <= x < 79200})
        return median([b - a for a, b in zip(times, times[1:])]) if len(times) > 1 else None

    expected = {}
    for key in {(r[3], r[4]) for r in kept}:
        own = [r for r in kept if (r[3], r[4]) == key]
        best = [mid([r[6] for r in own if r[1:3] == line]) for line in {r[1:3] for r in own}]
        named = {r[1] for r in own} - {None}
        expected[key] = (len(named), None in {r[1] for r in own}, min(r[6] for r in own), max(r[6] for r in own), any(b is not None and b <= 900 for b in best), mid([r[6] for r in own]))
    assert {(r.service_id, r.stop_id): (r.routes, r.unnamed, r.first_s, r.last_s, r.frequent, r.m) for r in stops.collect()} == expected
