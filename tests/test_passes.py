"""How often, and in how many tasks, queries go over their tables."""

import re

from pyspark.sql import functions as F

from tramline import catalog
from tramline.adapters import Tables, stop_events
from tramline.plans import spatial


def test_evening_zones_number_the_stop_events_once(spark, sf):
    df = catalog.queries()["a23_evening_zones"](spark, sf)
    assert not [f for f in df.inputFiles() if "lineitem" in f]  # first and last events were written by one pass


def test_zone_views_are_not_ranked_in_one_task(spark, sf):
    df = catalog.queries()["d22_zone_views"](spark, sf)
    assert not re.search(r"windowspecdefinition\(stops#", df._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(r["rank"] for r in df.collect()) == list(range(1, df.count() + 1))


def test_signatures_list_routes_of_distinct_pairs(spark, sf):
    # the optimizer would drop a distinct below collect_set, which takes copies
    plan = catalog.queries()["d4_signatures"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(" in plan and "collect_set(" not in plan and re.search(r"Aggregate \[[^\[\]]*route_id#\d+\], \[", plan)


def test_the_cover_spells_ids_once_a_stop_and_not_once_an_event(spark, sf, monkeypatch):
    plans, whole = [], spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, name))
    df = catalog.queries()["i2_zone_cover"](spark, sf)
    assert re.search(r"Aggregate \[l_suppkey#\d+L?\], \[", plans[0])
    t = Tables(spark, sf)
    events = t.stop_times.groupBy("stop_id").agg(F.count("*").alias("events"))
    stops = spatial.S.projected(t.stops).join(events, "stop_id", "left").fillna(0, ["events"])
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, spatial.place_cover(stops, 150).collect()))


def test_events_of_stops_are_the_rows_of_their_stop_times(spark, tmp_path):
    # none, below zero, of six digits and beyond, where ids of different keys are the same
    keys = [None, None, -3, 0, 7, 7, 999999, 1234567, 1234568, 1234568, 12345678]
    rows = [(i // 3, 1, k, i % 3, 1.0, 1.0) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    got = {r.stop_id: r.events for r in stop_events(t).collect()}
    assert got == {r.stop_id: r["count"] for r in t.stop_times.groupBy("stop_id").count().collect()}
    assert got == {None: 2, "s0000-3": 1, "s000000": 1, "s000007": 2, "s999999": 1, "s123456": 4}
