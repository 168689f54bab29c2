"""Journeys over a service day and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import Tables
from ..catalog import query
from ..functions import numeric
from ..operators import headway as H
from ..operators import routing as R
from ..operators import spatial as S
from ..stage import staged
from .spatial import DIST, XY, place_cover

DEPART = 8 * 3600
ARRIVE = 18 * 3600
#: Every so many stops is an origin at least, and about fifty are, however many stops there are.
STRIDE, ORIGINS = 30, 50
#: Stops that an origin must reach to count, and the hiding period of a medium game.
REACHED, HIDING_MIN = 50, 60
EVENTS = "ev AS (SELECT s.trip_id, s.stop_id, s.seq, coalesce(arr_s, dep_s)::BIGINT AS arr_s, coalesce(dep_s, arr_s)::BIGINT AS dep_s FROM stop_times s JOIN trips t USING (trip_id) WHERE t.service_id = 'wd5' AND coalesce(dep_s, arr_s) IS NOT NULL)"
WALKS = f"walks AS (SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, floor({DIST} * 1.3::DOUBLE / 1.2::DOUBLE)::BIGINT AS walk_s FROM stops_xy a JOIN stops_xy b ON a.stop_id <> b.stop_id AND {DIST} <= 400)"
SERVED = "served AS (SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT stop_id FROM ev))"
ORIGINS_SQL = f"origins AS (SELECT stop_id AS origin_id, stop_id, {DEPART} AS dep_s FROM served WHERE p % greatest({STRIDE}, ceil(n / {ORIGINS}.0)::BIGINT) = 0)"
HUB = f"hub AS (SELECT s.stop_id FROM ev s JOIN trips t USING (trip_id) GROUP BY 1 ORDER BY count(DISTINCT t.route_id) DESC, count(*) DESC, 1 LIMIT 1), origins AS (SELECT stop_id AS origin_id, stop_id, {DEPART} AS dep_s FROM hub)"
BACK = f"ev0 AS (SELECT trip_id, stop_id, -seq AS seq, -dep_s AS arr_s, -arr_s AS dep_s FROM ev), walks0 AS (SELECT to_stop AS from_stop, from_stop AS to_stop, walk_s FROM walks), origins AS (SELECT stop_id AS origin_id, stop_id, -{ARRIVE} AS dep_s FROM served WHERE p % greatest({STRIDE}, ceil(n / {ORIGINS}.0)::BIGINT) = 0)"


def _rounds_sql(legs: int = R.LEGS, slack: int = R.SLACK_S, ev: str = "ev", walks: str = "walks") -> str:
    parts = [f"b0 AS (SELECT origin_id, stop_id, min(arr_s) AS arr_s, 0 AS legs FROM (SELECT origin_id, stop_id, dep_s::BIGINT AS arr_s FROM origins UNION ALL SELECT origin_id, to_stop, dep_s + walk_s FROM origins JOIN {walks} ON from_stop = stop_id) GROUP BY 1, 2)"]
    for k in range(1, legs + 1):
        p = k - 1
        parts.append(f"o{k} AS (SELECT origin_id, trip_id, min(seq) AS on_ FROM b{p} b JOIN {ev} e ON e.stop_id = b.stop_id AND e.dep_s >= b.arr_s + {slack} GROUP BY 1, 2)")
        parts.append(f"r{k} AS (SELECT o.origin_id, e.stop_id, min(e.arr_s) AS arr_s FROM o{k} o JOIN {ev} e ON e.trip_id = o.trip_id AND e.seq > on_ GROUP BY 1, 2)")
        parts.append(f"i{k} AS (SELECT r.* FROM r{k} r LEFT JOIN b{p} b ON b.origin_id = r.origin_id AND b.stop_id = r.stop_id WHERE b.arr_s IS NULL OR r.arr_s < b.arr_s)")
        parts.append(f"u{k} AS (SELECT * FROM b{p} UNION ALL SELECT *, {k} FROM i{k} UNION ALL SELECT origin_id, to_stop, arr_s + walk_s, {k} FROM i{k} JOIN {walks} ON from_stop = stop_id)")
        parts.append(f"b{k} AS (SELECT origin_id, stop_id, arr_s, min(legs) AS legs FROM u{k} JOIN (SELECT origin_id, stop_id, min(arr_s) AS arr_s FROM u{k} GROUP BY 1, 2) USING (origin_id, stop_id, arr_s) GROUP BY 1, 2, 3)")
    return ", ".join(parts)


ROUNDS = f"{XY['stops']}, {EVENTS}, {WALKS}, {SERVED}, {ORIGINS_SQL}, {_rounds_sql()}"
HUB_ROUNDS = f"{XY['stops']}, {EVENTS}, {WALKS}, {HUB}, {_rounds_sql()}"
VIEWS = ("stops", "trips", "stop_times")


def events(t: Tables) -> DataFrame:
    run = t.trips.filter("service_id = 'wd5'").select("trip_id")
    # the first join only takes rows out, so it goes below the numbering of the stops of all trips
    rows = t.stop_times.join(run, "trip_id", "left_semi").join(run, "trip_id")
    return rows.select("trip_id", "stop_id", "seq", F.coalesce("arr_s", "dep_s").alias("arr_s"), F.coalesce("dep_s", "arr_s").alias("dep_s")).filter("dep_s is not null")


def places(t: Tables) -> DataFrame:
    """(stop_id, place) of stops that have a position: those at the same one are a place, named after the smallest."""
    return S.projected(t.stops).filter("x is not null and y is not null").select("stop_id", F.min("stop_id").over(W.partitionBy("x", "y")).alias("place"))


def walks(t: Tables) -> DataFrame:
    """Walks between places(), and within each."""
    spots = S.projected(t.stops).filter("x is not null and y is not null").groupBy("x", "y").agg(F.min("stop_id").alias("stop_id"))
    both = S.pairs_within(spots, "stop_id", 400.0)
    every = both.select(F.col("a").alias("from_stop"), F.col("b").alias("to_stop"), "dist").union(both.select("b", "a", "dist")).union(spots.select("stop_id", "stop_id", F.lit(0.0)))
    return every.select("from_stop", "to_stop", F.floor(F.col("dist") * 1.3 / 1.2).cast("int").alias("walk_s"))


def day(t: Tables) -> DataFrame:
    """events(), written once for all that reads them."""
    return staged(events(t), "day")[0]


def origins(ev: DataFrame, time: int = DEPART) -> DataFrame:
    """Every STRIDE-th served stop of the day's events, or fewer: about ORIGINS of them."""
    served = ev.select("stop_id").distinct()
    stride = max(STRIDE, -(-served.count() // ORIGINS))
    rows = H.strided(served, ["stop_id"], stride)
    return rows.select(F.col("stop_id").alias("origin_id"), "stop_id", F.lit(time).alias("dep_s"))


def hub(t: Tables, ev: DataFrame | None = None) -> DataFrame:
    """The stop of the day with the most routes, then the most events."""
    rows = (events(t) if ev is None else ev).join(t.trips, "trip_id").groupBy("stop_id").agg(F.countDistinct("route_id").alias("routes"), F.count("*").alias("events"))
    first = rows.agg(F.min(F.struct((-F.col("routes")).alias("r"), (-F.col("events")).alias("e"), "stop_id")).alias("m")).filter("m is not null")
    return first.select(F.col("m.stop_id").alias("origin_id"), F.col("m.stop_id").alias("stop_id"), F.lit(DEPART).alias("dep_s"))


def arrivals(t: Tables, starts: DataFrame | None = None, ev: DataFrame | None = None, told: bool = False) -> DataFrame:
    ev = day(t) if ev is None else ev
    return R.journeys(ev, walks(t), origins(ev) if starts is None else starts, places=places(t), told=told)


def hub_arrivals(t: Tables, told: bool = False) -> DataFrame:
    ev = day(t)
    return arrivals(t, hub(t, ev), ev, told)


@query("i3_earliest_arrivals", views=VIEWS, sql=f"WITH {ROUNDS} SELECT origin_id, stop_id, arr_s, legs FROM b5")
def earliest_arrivals(t: Tables) -> DataFrame:
    ev = day(t)
    return R.rounds(ev, walks(t), origins(ev), places=places(t))


@query("i3_kernel_arrivals", views=VIEWS, sql=f"WITH {ROUNDS} SELECT origin_id, stop_id, arr_s, legs FROM b5")
def kernel_arrivals(t: Tables) -> DataFrame:
    return arrivals(t).select("origin_id", "stop_id", "arr_s", "legs")


LATEST = f"{XY['stops']}, {EVENTS}, {WALKS}, {SERVED}, {BACK}, {_rounds_sql(ev='ev0', walks='walks0')}"


@query("i4_latest_departures", views=VIEWS, sql=f"WITH {LATEST} SELECT origin_id, stop_id, -arr_s AS dep_s, legs FROM b5")
def latest_departures(t: Tables) -> DataFrame:
    ev = day(t)
    return R.latest(ev, walks(t), origins(ev, ARRIVE), places=places(t))


@query("i4_kernel_departures", views=VIEWS, sql=f"WITH {LATEST} SELECT origin_id, stop_id, -arr_s AS dep_s, legs FROM b5")
def kernel_departures(t: Tables) -> DataFrame:
    ev = day(t)
    back = R.journeys(ev, walks(t), origins(ev, ARRIVE), backward=True, places=places(t))
    return back.select("origin_id", "stop_id", F.col("arr_s").alias("dep_s"), "legs")


@query("i5_journey_steps", views=VIEWS)
def journey_steps(t: Tables) -> DataFrame:
    """The steps themselves: ride or walk and the stop it ends at, from the origin on."""
    return arrivals(t, told=True).select("origin_id", "stop_id", "legs", "steps")


@query("i6_hub_runs", views=VIEWS, sql=f"WITH {HUB_ROUNDS} SELECT origin_id, stop_id, arr_s, legs FROM b5")
def hub_runs(t: Tables) -> DataFrame:
    """The run from the hub that other measures share; it is staged, so they don't repeat it."""
    return staged(hub_arrivals(t).select("origin_id", "stop_id", "arr_s", "legs"), "hub")[0]


@query("a20_t90", views=VIEWS, sql=f"""
WITH {ROUNDS}, p AS (SELECT origin_id, quantile_disc(arr_s - {DEPART}, 0.9) AS p90 FROM b5 GROUP BY 1 HAVING count(*) >= {REACHED}) SELECT count(*) AS origins, (median(p90) * 2)::BIGINT AS t90_2s FROM p""")
def t90(t: Tables) -> DataFrame:
    """Median over origins that reach REACHED stops of the time within which they reach nine tenths of those."""
    per = arrivals(t).withColumn("d", F.col("arr_s") - DEPART).groupBy("origin_id").agg(F.expr("percentile_disc(0.9) within group (order by d)").alias("p90"), F.count("*").alias("n")).filter(F.col("n") >= REACHED)
    return per.agg(F.count("*").alias("origins"), (F.median("p90") * 2).cast("long").alias("t90_2s"))


@query("a21_reach_counts", views=(*VIEWS, "zones"), sql=f"""
WITH {HUB_ROUNDS}, z AS (SELECT count(*) AS n FROM zones), m(mins) AS (VALUES (30), (60), (180))
SELECT mins AS minutes, count(b5.stop_id) AS stops, count(zones.zone_id) AS zones, round(count(zones.zone_id) * 1e6 / any_value(z.n))::BIGINT AS share_e6
FROM m CROSS JOIN z LEFT JOIN b5 ON arr_s - {DEPART} <= mins * 60 LEFT JOIN zones ON zones.zone_id = 'z' || substr(b5.stop_id, 2) GROUP BY 1""")
def reach_counts(t: Tables) -> DataFrame:
    """Stops and zones that the hub reaches in half an hour, an hour and three, and the share of all zones."""
    d = F.col("arr_s") - DEPART
    run = hub_arrivals(t).withColumn("zone_id", F.concat(F.lit("z"), F.substr("stop_id", F.lit(2)))).join(t.zones.select("zone_id", F.lit(1).alias("z")), "zone_id", "left")
    times = (30, 60, 180)
    wide = run.agg(*[f for m in times for f in (F.count_if(d <= m * 60).alias(f"s{m}"), F.count_if((d <= m * 60) & F.col("z").isNotNull()).alias(f"z{m}"))])
    both = wide.crossJoin(t.zones.agg(F.count("*").alias("n")))  # one row each
    long = both.select("n", F.explode(F.array(*[F.struct(F.lit(m).alias("minutes"), F.col(f"s{m}").alias("stops"), F.col(f"z{m}").alias("zones")) for m in times])).alias("r"))
    return long.select("r.minutes", "r.stops", "r.zones", F.round(F.col("r.zones") * 1e6 / F.col("n")).cast("long").alias("share_e6"))


@query("a56_zone_reach", views=(*VIEWS, "zones"), sql=f"""
WITH {HUB_ROUNDS}, z AS (SELECT z.zone_id, round(((arr_s - {DEPART}) / 60.0::DOUBLE)::DECIMAL(38, 10), 1)::DOUBLE AS mins FROM zones z LEFT JOIN b5 ON b5.stop_id = 's' || substr(z.zone_id, 2))
SELECT string_agg(zone_id, ',' ORDER BY zone_id) FILTER (WHERE mins IS NULL OR mins > {HIDING_MIN}) AS unreachable, count(*) FILTER (WHERE mins <= {HIDING_MIN}) AS reachable,
  arg_min(zone_id, struct_pack(m := -mins, s := zone_id)) FILTER (WHERE mins IS NOT NULL) AS furthest, round(max(mins) * 10)::BIGINT AS furthest_tenths FROM z""")
def zone_reach(t: Tables) -> DataFrame:
    """Zones out of the hub's reach within the hiding period, and the furthest one (ties to the smaller id); minutes to a tenth."""
    run = hub_arrivals(t).select(F.concat(F.lit("z"), F.substr("stop_id", F.lit(2))).alias("zone_id"), numeric.half_up((F.col("arr_s") - DEPART) / 60.0, 1).alias("mins"))
    z = t.zones.select("zone_id").join(run, "zone_id", "left")
    out = F.col("mins").isNull() | (F.col("mins") > HIDING_MIN)
    far = F.min(F.when(F.col("mins").isNotNull(), F.struct((-F.col("mins")).alias("m"), "zone_id")))
    g = z.agg(F.array_join(F.array_sort(F.collect_list(F.when(out, F.col("zone_id")))), ",").alias("unreachable"), F.count_if(~out).alias("reachable"), far.alias("f"))
    return g.select(F.when(F.col("unreachable") != "", F.col("unreachable")).alias("unreachable"), "reachable", F.col("f.zone_id").alias("furthest"), F.round(-F.col("f.m") * 10).cast("long").alias("furthest_tenths"))


@query("j16_next_departure", views=["departures"], sql="""
WITH q AS (SELECT stop_id, unnest([25200, 43200, 61200]) AS ready_s FROM (SELECT DISTINCT stop_id FROM departures))
SELECT q.stop_id, q.ready_s, min(d.dep_s) FILTER (WHERE d.dep_s >= ready_s) AS next_s, max(d.dep_s) FILTER (WHERE d.dep_s <= ready_s) AS last_s FROM q LEFT JOIN departures d USING (stop_id) GROUP BY ALL""")
def next_departure(t: Tables) -> DataFrame:
    """The first departure at or after, and the last at or before, three times of the day."""
    times = (25200, 43200, 61200)
    d = t.departures.groupBy("stop_id").agg(*[F.min(F.when(F.col("dep_s") >= r, F.col("dep_s"))).alias(f"n{r}") for r in times], *[F.max(F.when(F.col("dep_s") <= r, F.col("dep_s"))).alias(f"l{r}") for r in times])
    return d.select("stop_id", F.explode(F.array(*[F.struct(F.lit(r).alias("ready_s"), F.col(f"n{r}").alias("next_s"), F.col(f"l{r}").alias("last_s")) for r in times])).alias("a")).select("stop_id", "a.*")


@query("a55_ride_sample", views=VIEWS)
def ride_sample(t: Tables, count: int = 14, radius: float = 402.336) -> DataFrame:
    """Rides from the hub to the busiest of a cover at three radii, topped up with the busiest zones: minutes to a tenth, legs."""
    ev = day(t)
    start = hub(t, ev)
    per = ev.groupBy("stop_id").agg(F.count("*").alias("events"))
    zones = S.projected(t.stops).join(per, "stop_id").select("stop_id", "events", "x", "y")
    spread = place_cover(zones, 3 * radius).select("stop_id", F.lit(0).alias("later"))
    ranked = zones.join(spread, "stop_id", "left").join(start.select("stop_id"), "stop_id", "left_anti").select("stop_id", "events", F.coalesce("later", F.lit(1)).alias("later"))
    picks = ranked.orderBy("later", F.desc("events"), "stop_id").limit(count)
    run = arrivals(t, start, ev, told=True).select("stop_id", numeric.half_up((F.col("arr_s") - DEPART) / 60.0, 1).alias("minutes"), "legs", "steps")
    return picks.join(run, "stop_id", "left").select("stop_id", "events", "minutes", "legs", "steps")
