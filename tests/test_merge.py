"""Merged feeds, predicates over lacking columns, numbering, manifests: rows worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import etl, merge, order
from tramline.sources import gtfs, sinks


def feed(spark, sha, trips, agency=(("a", "A"),), fares=0, start="20240101", end="20240131", timezone="X", label=""):
    tables = {
        "trips": spark.createDataFrame([(f" t{i}", "r1", "s") for i in range(trips)], "trip_id string, route_id string, service_id string"),
        "routes": spark.createDataFrame([("r1", None), ("r2", "b")], "route_id string, agency_id string"),
        "agency": spark.createDataFrame(list(agency), "agency_id string, agency_name string"),
        "stops": spark.createDataFrame([("x", "", 1.0)], "stop_id string, parent_station string, stop_lat double"),
    }
    if fares:
        tables["fare_attributes"] = spark.createDataFrame([(str(fares), "USD")], "price string, currency_type string")
    return merge.Feed(tables, sha, label, timezone, start, end)


def test_ids_tags_and_blank_agencies(spark):
    whole = merge.merged(spark, [feed(spark, "bb", 1), feed(spark, "aa", 3, agency=((None, "B"),), timezone="Y"), feed(spark, "aa", 2, agency=(("p", "P"), ("q", "Q")), label="z")])
    assert whole.tags == ["f2", "f0", "f1"] and whole.primary == 1 and whole.fares is None
    trips = {(r.trip_id, r.route_id, r.service_id) for r in whole.tables["trips"].collect()}
    assert trips == {("f2:t0", "f2:r1", "f2:s")} | {(f"f0:t{i}", "f0:r1", "f0:s") for i in range(3)} | {(f"f1:t{i}", "f1:r1", "f1:s") for i in range(2)}
    routes = {(r.route_id, r.agency_id) for r in whole.tables["routes"].collect()}
    assert routes == {("f2:r1", "f2:a"), ("f2:r2", "f2:b"), ("f0:r1", "f0"), ("f0:r2", "f0:b"), ("f1:r1", None), ("f1:r2", "f1:b")}
    assert {(r.stop_id, r.parent_station) for r in whole.tables["stops"].collect()} == {("f0:x", ""), ("f1:x", ""), ("f2:x", "")}
    assert whole.notes == ["merge_mixed_tz"] and [tuple(r) for r in whole.tables["feed_info"].collect()] == [("20240101", "20240131")]


@pytest.mark.parametrize("a, b, expected, notes", [(("20240101", "20240110"), ("20240105", "20240131"), ("20240105", "20240110"), ["merge_short_overlap"]), (("20240101", "20240111"), ("20240105", "20240131"), ("20240105", "20240111"), []), (("20240101", "20240103"), ("20240105", "20240131"), ("20240101", "20240131"), ["merge_no_overlap"])])
def test_windows(spark, a, b, expected, notes):
    whole = merge.merged(spark, [feed(spark, "a", 1, start=a[0], end=a[1]), feed(spark, "b", 1, start=b[0], end=b[1])])
    assert (whole.start, whole.end) == expected and whole.notes == notes


def test_fares_and_looks(spark):
    whole = merge.merged(spark, [feed(spark, "a", 5), feed(spark, "b", 1, fares=2), feed(spark, "c", 2, fares=3)])
    assert whole.primary == 0 and whole.fares == 1 and whole.tables["fare_attributes"].first().price == "2"
    assert merge.merged(spark, [feed(spark, "a", 5, fares=7), feed(spark, "b", 1, fares=2)]).fares == 0
    odd = feed(spark, "b", 1)
    odd.tables["stops"] = spark.createDataFrame([("f0::x", "")], "stop_id string, parent_station string")
    whole = merge.merged(spark, [feed(spark, "a", 1), odd])
    assert {r.stop_id for r in whole.tables["stops"].collect()} == {"f0:::x", "f1:::f0::x"}
    one = feed(spark, "a", 1)
    assert merge.merged(spark, [one]).tables is one.tables


def test_feed_window(spark):
    day = lambda *rows: spark.createDataFrame(list(rows), "start_date string, end_date string").select(*[F.col(c).cast("date") for c in ("start_date", "end_date")])
    dates = spark.createDataFrame([("2024-03-01", 1), ("2024-01-01", 2)], "date string, exception_type int").withColumn("date", F.col("date").cast("date"))
    get = lambda i, c: tuple(map(str, merge.window(i, c, dates).first()))
    assert get(day(("2024-02-01", None)), day(("2024-01-01", "2024-12-31"))) == ("2024-02-01", "2024-12-31")
    assert get(day(), day(("2024-01-01", "2024-06-30"), ("2024-02-01", "2024-12-31"))) == ("2024-01-01", "2024-12-31")
    assert get(day(), day()) == ("2024-03-01", "2024-03-01")


def test_predicates_over_lacking_columns(spark):
    rows = spark.createDataFrame([(1, "park", "it's"), (2, None, "x AND y")], "id int, natural string, name string")
    ids = lambda p: [r.id for r in etl.where(rows, p).orderBy("id").collect()]
    assert ids("\"natural\" = 'park' OR \"leisure\" = 'pitch'") == [1]
    assert ids("leisure IS NULL") == [1, 2] and ids("leisure IS NOT NULL") == [] and ids("NOT (leisure = 'x')") == []
    assert ids("name IN ('x AND y', 'leisure')") == [2] and ids("name = 'it''s'") == [1]
    assert etl.where(rows, "\"name:en\" IS NULL").columns == rows.columns


def test_manifest_unions(spark):
    part = lambda layer, size=0.002: spark.createDataFrame([(layer, 3, size)], "layer string, features long, cell_deg double")
    assert etl.manifest_union([part("a"), part("b"), part("c", None)]).count() == 3
    with pytest.raises(ValueError, match="more than one shard"):
        etl.manifest_union([part("a"), part("a")])
    with pytest.raises(ValueError, match="differ"):
        etl.manifest_union([part("a"), part("b", 0.004)])


def test_manifests_tell_rows_apart(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 5)]
    made = lambda r: {x.layer: (x.n, x.digest) for x in sinks.manifest(spark.createDataFrame(r, "layer string, v int"), "layer").collect()}
    assert made(rows) == made(rows[::-1])
    assert made([("a", 1), ("a", 1), ("a", 1), ("a", 1)])["a"][1] != made([("a", 2)] * 4)["a"][1]  # equal rows don't cancel
    assert made(rows[:2])["a"] != made(rows[1:3])["a"]


def test_numbering_by_ranges(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 700)
    got = order.numbered(spark.createDataFrame([(k,) for k in keys], "k int").repartition(7), ["k"]).collect()
    assert {r.k: r.position for r in got} == {k: i for i, k in enumerate(sorted(keys))}
    down = order.numbered(spark.createDataFrame([(k,) for k in keys], "k int"), [F.desc("k")]).collect()
    assert {r.k: r.position for r in down} == {k: i for i, k in enumerate(sorted(keys, reverse=True))}


def test_archives_stored_deflated_and_wide(tmp_path):
    import io
    import zipfile

    data = b"stop_id\r\n" + b"x\r\n" * 4000
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z, z.open("deep/stops.txt", "w", force_zip64=True) as f:
            f.write(data)
        assert gtfs.members(out.getvalue()) == [("stops", data)]
        with pytest.raises(ValueError):
            gtfs.members(out.getvalue()[: len(out.getvalue()) // 2])  # a part of a split archive
