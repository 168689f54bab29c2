import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.functions import text
from tramline.operators import etl, headway, timetable
from tramline.sources import gtfs, sinks
from tramline.streaming import monitor


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


STOPS = '﻿stop_id,stop_name,stop_lat,stop_lon,location_type\r\na,"A, ""main""\nstreet",1.5,2,\r\n\r\nb,B,x,2,0\r\nc,C,3,4,1\r\nd,D,5\r\ne,E,5,6,0,long,row\r\n'


def test_archives(spark, tmp_path):
    (tmp_path / "f.zip").write_bytes(packed({"feed/stops.txt": STOPS, "__MACOSX/stops.txt": "x", "notes.md": "x"}))
    got = gtfs.read_zips(spark, f"file://{tmp_path}", "stops", ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"])
    assert [r.stop_id for r in gtfs.stops(got).orderBy("stop_id").collect()] == ["a", "e"]
    assert got.filter("stop_id = 'a'").first().stop_name == 'A, "main"\nstreet'
    one = gtfs.read_zip(spark, f"file://{tmp_path}/f.zip", "stops", ["stop_id", "stop_name"])
    assert one.count() == 5


def test_bad_archives():
    with pytest.raises(ValueError):
        gtfs.members(b"no zip")
    with pytest.raises(ValueError):
        gtfs.checked({"stops": None})
    for bad in ([], [{"kind": "x"}], [{"kind": "url", "url": "javascript:1"}], [{"kind": "area", "ring": [1]}], [{"kind": "file"}] * 11):
        with pytest.raises(ValueError):
            gtfs.sources(bad)
    assert gtfs.sources([{"kind": "file"}])


def test_archives_are_byte_stable():
    tables = {"b": [["x"], ["1,2"]], "a": [["y"], ['"']]}
    data = sinks.archive(tables)
    assert data == sinks.archive(dict(reversed(tables.items())))
    assert dict(gtfs.members(data))["a"] == b'y\r\n""""\r\n'


def test_dates(spark):
    rows = spark.createDataFrame([("20240229",), ("20230229",), ("2024-1-1",), (None,), ("",)], "d string")
    got = rows.select(text.date8(F.col("d")).alias("d")).collect()
    assert str(got[0].d) == "2024-02-29" and all(r.d is None for r in got[1:])


TIMES = "trip_id long, stop_id string, seq int, arr_s int, dep_s int, dist double"


def filled(spark, rows, dist=True):
    frame = spark.createDataFrame(rows, TIMES)
    got = timetable.filled_times(frame if dist else frame.drop("dist")).collect()
    return {(r.trip_id, r.seq): (r.arr_s, r.dep_s, r.time_s) for r in got}


def test_times_are_filled_by_place_not_by_number(spark):
    """Worked by hand: places 0, 1, 2 with 0, blank, 900 give 450 in the middle, whatever the sequence numbers."""
    got = filled(spark, [(1, "a", 1, 0, 0, None), (1, "b", 2, None, None, None), (1, "c", 10, 900, 900, None)])
    assert [got[1, i][2] for i in (1, 2, 10)] == [0, 450, 900]
    assert got[1, 2] == (450, 450, 450)


def test_times_are_filled_by_distance(spark):
    far = [(1, "a", 1, 100, 100, 0.0), (1, "b", 2, None, None, 1.0), (1, "c", 3, 900, 900, 4.0)]
    assert filled(spark, far)[1, 2][2] == 300
    assert filled(spark, [(*r[:5], None if r[2] == 2 else r[5]) for r in far])[1, 2][2] == 500  # one distance is missing
    assert filled(spark, [(*r[:5], 7.0) for r in far])[1, 2][2] == 500  # it goes nowhere
    assert filled(spark, far, dist=False)[1, 2][2] == 500


def test_ends_zeros_and_one_sided_times(spark):
    rows = [(1, "a", 1, None, None, None), (1, "b", 2, 100, None, None), (1, "c", 3, None, None, None), (1, "d", 4, None, None, None), (1, "e", 5, 205, 210, None), (1, "f", 6, None, None, None)]
    rows += [(2, "a", 1, None, None, None), (3, "a", 1, 50, 0, None), (4, "a", 1, None, 0, None), (4, "b", 2, 60, 60, None), (5, "a", 1, 10, None, None), (5, "b", 2, 20, 25, None), (6, "a", 1, 0, None, None), (6, "b", 2, None, None, None), (6, "c", 3, 5, 5, None)]
    got = filled(spark, rows)
    assert [got[1, i][2] for i in range(1, 7)] == [100, 100, 137, 173, 210, 210]
    assert got[1, 2] == (100, 100, 100)  # one-sided, in a trip with blanks
    assert got[2, 1] == (None, None, None) and got[3, 1] == (50, 0, 50)
    assert got[4, 1] == (60, 0, 60)  # a departure of 0 alone counts as blank
    assert got[5, 1] == (10, None, 10)  # nothing is blank, so nothing is filled
    assert [got[6, i][2] for i in (1, 2, 3)] == [0, 2, 5]  # halves to even


def day_types(spark, trips_by_date):
    profiles = spark.createDataFrame([(d, n) for d, n in trips_by_date.items()], "d string, trips long").select(F.to_date("d").alias("date"), "trips")
    active = profiles.select("date", F.concat(F.lit("s"), F.weekday("date")).alias("service_id"))
    return {r.day_type: r for r in timetable.day_types(profiles, active).collect()}


def test_day_types(spark):
    """January 2024 begins on a Monday."""
    got = day_types(spark, {"2024-01-01": 10, "2024-01-08": 10})
    assert set(got) == {"dow0"}  # a weekday on its own stays one
    assert str(got["dow0"].representative) == "2024-01-08" and got["dow0"].label == "Monday"  # the later of two
    got = day_types(spark, {"2024-01-01": 10, "2024-01-02": 15, "2024-01-06": 4, "2024-01-07": 3, "2024-01-14": 3, "2024-01-21": 9})
    assert {k: (r.trips, str(r.representative), r.n_dates) for k, r in got.items()} == {"weekday": (10, "2024-01-01", 2), "saturday": (4, "2024-01-06", 1), "sunday": (3, "2024-01-14", 3)}
    assert got["weekday"].service_ids == ["s0"] and [str(d) for d in got["sunday"].dates] == ["2024-01-07", "2024-01-14", "2024-01-21"]
    assert set(day_types(spark, {"2024-01-01": 10, "2024-01-02": 16})) == {"dow0", "dow1"}


def test_frequencies(spark):
    times = spark.createDataFrame([(1, "a", 1, 100, 110), (1, "b", 2, 200, 210), (2, "a", 1, 5, 6), (3, "z", 1, 1, 1)], "trip_id long, stop_id string, seq int, arr_s int, dep_s int")
    freq = spark.createDataFrame([(1, 1000, 2200, 600), (2, 500, 400, 60)], "trip_id long, start_s int, end_s int, headway_s int")
    got = sorted((r.trip_id, r.stop_id, r.dep_s) for r in timetable.expanded(freq, times).collect())
    assert got == [("1#0000", "a", 1000), ("1#0000", "b", 1100), ("1#0001", "a", 1600), ("1#0001", "b", 1700), ("3", "z", 1)]


def test_many_slots_keep_their_ids(spark):
    times = spark.createDataFrame([(1, "a", 1, 0, 0)], "trip_id long, stop_id string, seq int, arr_s int, dep_s int")
    freq = spark.createDataFrame([(1, 0, 12_000, 1)], "trip_id long, start_s int, end_s int, headway_s int")
    ids = [r.trip_id for r in timetable.expanded(freq, times).collect()]
    assert len(set(ids)) == 12_000 and "1#11999" in ids and "1#0007" in ids


def test_services(spark):
    dates = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-14')) as date")
    cal = spark.sql("select 'w' as service_id, 0 as weekday, date'2024-01-01' as start_date, date'2024-01-31' as end_date union all select 'w', 5, date'2024-01-01', date'2024-01-10'")
    exc = spark.sql("select 'w' as service_id, date'2024-01-08' as date, 2 as exception_type union all select 'w', date'2024-01-09', 1 union all select 'x', date'2024-01-09', 1")
    got = sorted((str(r.date), r.service_id) for r in timetable.active_services(dates, cal, exc).collect())
    assert got == [("2024-01-01", "w"), ("2024-01-06", "w"), ("2024-01-09", "w"), ("2024-01-09", "x")]


def test_runs_on_a_circle(spark):
    rows = spark.createDataFrame([("a", i, i in (22, 23, 0, 1, 7)) for i in range(24)] + [("b", i, True) for i in range(24)] + [("c", 0, False)], "k string, hour int, on boolean")
    assert {r.k: r.longest_run for r in headway.longest_runs(rows, "k", "hour", "on", 24).collect()} == {"a": 4, "b": 24, "c": 0}
    assert {r.k: r.longest_run for r in headway.longest_runs(rows, "k", "hour", "on").collect()} == {"a": 2, "b": 24, "c": 0}


def test_layers_and_curses(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = etl.layer_states(frame([("a",), ("b",), ("c",)], "layer string"), frame([("a",), ("b",)], "layer string"), frame([("a", 3)], "layer string, n long"))
    assert {r.layer: (r.state, r.n) for r in got.collect()} == {"a": ("present", 3), "b": ("empty", 0), "c": ("absent", None)}
    terms = frame([("x", 0, 1, 5), ("x", 1, -1, None), ("y", 0, 1, None), ("y", 1, 1, 4)], "curse string, position int, sign int, n long")
    assert {r.curse: r.n for r in etl.signed_count(terms).collect()} == {"x": 5, "y": None}


def test_the_monitor(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = monitor.windows(monitor.departures(spark, f"{tmp_path}/in", events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), "1 day", "1 day")
    q = stream.writeStream.format("memory").queryName("headways").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) as n from headways").first().n == events.count()
