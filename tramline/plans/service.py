"""Calendars, service days, headways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import Tables
from ..catalog import query
from ..operators import headway as H
from ..operators import timetable as T

ACTIVE = """d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders),
active AS (SELECT DISTINCT date, service_id FROM (
  SELECT d.date, c.service_id FROM d JOIN calendar c ON isodow(d.date) - 1 = c.weekday AND d.date BETWEEN c.start_date AND c.end_date
  UNION ALL SELECT e.date, e.service_id FROM calendar_dates e JOIN d USING (date) WHERE exception_type = 1) x
  WHERE NOT EXISTS (SELECT 1 FROM calendar_dates e WHERE e.exception_type = 2 AND e.date = x.date AND e.service_id = x.service_id))"""
PROFILES = ACTIVE + """, profiles AS (SELECT date, sum(n)::BIGINT AS trips FROM active JOIN (SELECT service_id, count(*) AS n FROM trips GROUP BY 1) USING (service_id) GROUP BY date)"""
CAL = ("trips", "calendar", "calendar_dates")


def _dates(t: Tables) -> DataFrame:
    return t("orders").select(F.to_date("o_orderdate").alias("date")).distinct()


def _active(t: Tables) -> DataFrame:
    return T.active_services(_dates(t), t.calendar, t.calendar_dates)


def _profiles(t: Tables) -> DataFrame:
    return T.date_profiles(_active(t), t.trips)


@query("a3_stop_headways", views=["departures"], sql="""
WITH g AS (SELECT stop_id, dep_s - lag(dep_s) OVER (PARTITION BY stop_id ORDER BY dep_s) AS gap FROM (SELECT DISTINCT stop_id, dep_s FROM departures)),
r AS (SELECT stop_id, route_dir, dep_s - lag(dep_s) OVER (PARTITION BY stop_id, route_dir ORDER BY dep_s) AS gap FROM (SELECT DISTINCT stop_id, route_dir, dep_s FROM departures WHERE dep_s >= 21600 AND dep_s < 79200)),
m AS (SELECT stop_id, route_dir, median(gap) AS h FROM r GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT stop_id, min(h) AS best FROM m GROUP BY 1)
SELECT d.stop_id, d.n_departures, d.departures, d.n_routes, d.routes, d.first_s, d.last_s, (g2.med * 2)::BIGINT AS median_gap_2s, g2.worst AS worst_gap_s, (best * 2)::BIGINT AS best_2s, coalesce(best <= 900, false) AS frequent
FROM (SELECT stop_id, count(*) AS n_departures, string_agg(dep_s, ',' ORDER BY dep_s) AS departures, (SELECT count(DISTINCT route_dir) FROM departures x WHERE x.stop_id = f.stop_id) AS n_routes, (SELECT string_agg(DISTINCT route_dir, ',' ORDER BY route_dir) FROM departures x WHERE x.stop_id = f.stop_id) AS routes, min(dep_s) AS first_s, (SELECT max(dep_s) FROM departures x WHERE x.stop_id = f.stop_id) AS last_s
  FROM (SELECT stop_id, trip_id, min(dep_s) AS dep_s FROM departures GROUP BY ALL) f GROUP BY 1) d
JOIN (SELECT stop_id, median(gap) AS med, max(gap) AS worst FROM g GROUP BY 1) g2 USING (stop_id) LEFT JOIN b USING (stop_id)""")
def stop_headways(t: Tables) -> DataFrame:
    facts = H.stop_facts(t.departures)
    return facts.select("stop_id", "n_departures", F.array_join("departures", ",").alias("departures"), "n_routes", F.array_join("routes", ",").alias("routes"), "first_s", "last_s", (F.col("median_gap_s") * 2).cast("long").alias("median_gap_2s"), "worst_gap_s", (F.col("best_s") * 2).cast("long").alias("best_2s"), "frequent")


@query("a4_first_departures", views=["stop_times"], sql="SELECT stop_id, trip_id, min(dep_s) AS dep_s FROM stop_times WHERE dep_s IS NOT NULL GROUP BY ALL")
def first_departures(t: Tables) -> DataFrame:
    return H.first_departures(t.stop_times.filter("dep_s is not null"))


@query("a5_best_headways", views=["departures"], sql="""
WITH r AS (SELECT stop_id, route_dir, dep_s - lag(dep_s) OVER (PARTITION BY stop_id, route_dir ORDER BY dep_s) AS gap FROM (SELECT DISTINCT stop_id, route_dir, dep_s FROM departures WHERE dep_s >= 21600 AND dep_s < 79200)),
m AS (SELECT stop_id, median(gap) AS h FROM r GROUP BY stop_id, route_dir HAVING count(*) >= 2)
SELECT stop_id, (min(h) * 2)::BIGINT AS best_2s FROM m GROUP BY 1""")
def best_headways(t: Tables) -> DataFrame:
    return H.best_headways(t.departures).select("stop_id", (F.col("best_s") * 2).cast("long").alias("best_2s"))


@query("w1_gaps", views=["departures"], sql="SELECT stop_id, dep_s, dep_s - lag(dep_s) OVER (PARTITION BY stop_id ORDER BY dep_s) AS gap FROM (SELECT DISTINCT stop_id, dep_s FROM departures)")
def gaps(t: Tables) -> DataFrame:
    return H.gaps(t.departures.select("stop_id", "dep_s").distinct(), ["stop_id"])


@query("p4_active_services", views=CAL, sql=f"WITH {ACTIVE} SELECT date, service_id FROM active")
def active(t: Tables) -> DataFrame:
    return _active(t)


@query("a1_date_profiles", views=CAL, sql=f"WITH {PROFILES} SELECT date, trips FROM profiles")
def profiles(t: Tables) -> DataFrame:
    return _profiles(t)


@query("a1_trips_by_service", views=["trips"], sql="SELECT service_id, count(*) AS trips FROM trips GROUP BY 1")
def trips_by_service(t: Tables) -> DataFrame:
    return t.trips.groupBy("service_id").agg(F.count("*").alias("trips"))


@query("a26_day_types", views=CAL, sql=f"""
WITH {PROFILES}, k AS (SELECT *, isodow(date) - 1 AS dow FROM profiles),
m AS (SELECT max(m) <= min(m) * 1.5 AND count(*) > 1 AS merge FROM (SELECT quantile_disc(trips, 0.5) AS m FROM k WHERE dow < 5 GROUP BY dow)),
t2 AS (SELECT k.*, CASE WHEN dow < 5 AND coalesce(merge, false) THEN 'weekday' WHEN dow = 5 THEN 'saturday' WHEN dow = 6 THEN 'sunday' ELSE 'dow' || dow END AS day_type FROM k, m),
q AS (SELECT day_type, quantile_disc(trips, 0.5) AS trips, count(*) AS n_dates, string_agg(strftime(date, '%Y%m%d'), ',' ORDER BY date) AS dates FROM t2 GROUP BY 1),
r AS (SELECT t2.day_type, t2.trips, n_dates, dates, date, row_number() OVER (PARTITION BY t2.day_type ORDER BY date) AS rn, count(*) OVER (PARTITION BY t2.day_type) AS n FROM t2 JOIN q ON q.day_type = t2.day_type AND q.trips = t2.trips)
SELECT day_type, CASE WHEN day_type = 'weekday' THEN 'Weekday' ELSE dayname(date) END AS label, trips, n_dates, date AS representative, sha256(dates) AS dates_sha, (SELECT string_agg(DISTINCT service_id, ',' ORDER BY service_id) FROM active a WHERE a.date = r.date) AS services FROM r WHERE rn = n // 2 + 1""")
def day_types(t: Tables) -> DataFrame:
    dates = F.array_join(F.transform("dates", lambda d: F.date_format(d, "yyyyMMdd")), ",")
    return T.day_types(_profiles(t), _active(t)).select("day_type", "label", "trips", "n_dates", "representative", F.sha2(dates, 256).alias("dates_sha"), F.array_join("service_ids", ",").alias("services"))


@query("a27_service_gaps", views=CAL, sql=f"""
WITH {PROFILES}, w AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM (SELECT min(date) AS a, max(date) AS b FROM profiles)),
u AS (SELECT isodow(date) AS dow, quantile_disc(trips, 0.5) AS usual FROM profiles GROUP BY 1)
SELECT date, kind, coalesce(trips, 0)::BIGINT AS trips FROM (SELECT w.date, trips, CASE WHEN trips IS NULL THEN 'none' WHEN trips < usual * 0.8::DOUBLE THEN 'reduced' END AS kind FROM w LEFT JOIN profiles USING (date) LEFT JOIN u ON u.dow = isodow(w.date)) WHERE kind IS NOT NULL""")
def service_gaps(t: Tables) -> DataFrame:
    return T.service_gaps(_profiles(t))


@query("t6_busiest_day", views=CAL, sql=f"WITH {PROFILES} SELECT date, trips FROM profiles ORDER BY trips DESC, date DESC LIMIT 1")
def busiest_day(t: Tables) -> DataFrame:
    return _profiles(t).agg(F.max(F.struct("trips", "date")).alias("m")).select("m.date", "m.trips")


@query("j1_trips_of_day", views=CAL, sql=f"WITH {ACTIVE} SELECT date, count(*) AS trips, count(DISTINCT route_id) AS routes FROM active JOIN trips USING (service_id) GROUP BY date")
def trips_of_day(t: Tables) -> DataFrame:
    per = t.trips.groupBy("service_id", "route_id").agg(F.count("*").alias("n"))
    return _active(t).join(per, "service_id").groupBy("date").agg(F.sum("n").alias("trips"), F.countDistinct("route_id").alias("routes"))


@query("j2_service_day", views=["trips", "stop_times", "stops"], sql="""
SELECT t.service_id, s.trip_id, t.route_id, t.direction_id, s.stop_id, s.seq, coalesce(arr_s, dep_s) AS arr_s, coalesce(dep_s, arr_s) AS dep_s
FROM stop_times s JOIN trips t USING (trip_id) JOIN stops USING (stop_id)""")
def service_day(t: Tables) -> DataFrame:
    return T.service_day(t.trips, t.stop_times, t.stops, t.calendar)


@query("a2_day_facts", views=["trips", "stop_times", "stops"], sql="""
SELECT t.service_id, count(DISTINCT s.stop_id) AS stops, count(DISTINCT t.route_id) AS routes, count(DISTINCT s.trip_id) AS trips, count(*) AS events, min(dep_s) AS first_s, max(dep_s) AS last_s
FROM stop_times s JOIN trips t USING (trip_id) JOIN stops USING (stop_id) GROUP BY 1""")
def day_facts(t: Tables) -> DataFrame:
    day = T.service_day(t.trips, t.stop_times, t.stops, t.calendar)
    return day.groupBy("service_id").agg(F.countDistinct("stop_id").alias("stops"), F.countDistinct("route_id").alias("routes"), F.countDistinct("trip_id").alias("trips"), F.count("*").alias("events"), F.min("dep_s").alias("first_s"), F.max("dep_s").alias("last_s"))


@query("w2_row_order", views=["stop_times"], sql="SELECT trip_id, stop_id, seq, (row_number() OVER (PARTITION BY trip_id ORDER BY seq) - 1)::INT AS at FROM stop_times")
def row_order(t: Tables) -> DataFrame:
    return t.stop_times.select("trip_id", "stop_id", "seq", (F.row_number().over(W.partitionBy("trip_id").orderBy("seq")) - 1).alias("at"))


#: After k (trip_id, seq, known, at): times filled by the place in the trip.
FILLED = """fw AS (SELECT *, CASE WHEN count(known) OVER (PARTITION BY trip_id) < count(*) OVER (PARTITION BY trip_id) THEN 1 ELSE 0 END AS blank,
             last_value(CASE WHEN known IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS sa, last_value(known IGNORE NULLS) OVER b AS ka,
             first_value(CASE WHEN known IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS sb, first_value(known IGNORE NULLS) OVER a AS kb FROM k
      WINDOW b AS (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT *, CASE WHEN known IS NOT NULL THEN known WHEN ka IS NULL THEN kb WHEN kb IS NULL THEN ka ELSE round_even(ka + (kb - ka) * ((pos - sa)::DOUBLE / (sb - sa)), 0)::BIGINT END AS time_s FROM fw)"""


@query("w3_filled_times", views=["stop_times"], sql=f"""
WITH k AS (SELECT *, coalesce(nullif(dep_s, 0), arr_s) AS known, row_number() OVER (PARTITION BY trip_id ORDER BY seq) AS pos FROM stop_times), {FILLED}
SELECT trip_id, stop_id, seq, CASE WHEN blank = 1 THEN coalesce(arr_s, time_s) ELSE arr_s END AS arr_s, CASE WHEN blank = 1 THEN coalesce(dep_s, time_s) ELSE dep_s END AS dep_s, time_s FROM h""")
def filled_times(t: Tables) -> DataFrame:
    return T.filled_times(t.stop_times)


@query("w4_monotone", views=["stop_times"], sql="""
WITH s AS (SELECT trip_id, seq * 2 + p AS pos, t FROM (SELECT trip_id, seq, 0 AS p, arr_s AS t FROM stop_times UNION ALL SELECT trip_id, seq, 1, dep_s FROM stop_times) WHERE t IS NOT NULL),
m AS (SELECT trip_id, t < max(t) OVER (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM s)
SELECT trip_id, count(*) AS n, count(*) FILTER (WHERE late) AS n_late FROM m GROUP BY 1""")
def monotone(t: Tables) -> DataFrame:
    both = t.stop_times.select("trip_id", "seq", F.posexplode(F.array("arr_s", "dep_s")).alias("p", "t")).filter("t is not null").withColumn("at", F.col("seq") * 2 + F.col("p"))
    return H.running_late(both, "trip_id", "at", "t").groupBy("trip_id").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


@query("w7_longest_runs", views=["departures"], sql="""
WITH h AS (SELECT stop_id, unnest(range(24)) AS hour FROM (SELECT DISTINCT stop_id FROM departures)),
f AS (SELECT h.stop_id, h.hour, d.stop_id IS NOT NULL AS on_ FROM h LEFT JOIN (SELECT DISTINCT stop_id, dep_s // 3600 AS hour FROM departures) d ON d.stop_id = h.stop_id AND d.hour = h.hour),
c AS (SELECT stop_id, hour FROM f WHERE on_ UNION ALL SELECT stop_id, hour + 24 FROM f WHERE on_),
i AS (SELECT stop_id, hour - row_number() OVER (PARTITION BY stop_id ORDER BY hour) AS g FROM c),
r AS (SELECT stop_id, max(n) AS n FROM (SELECT stop_id, g, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1)
SELECT stop_id, least(coalesce(n, 0), 24)::BIGINT AS longest_run FROM (SELECT DISTINCT stop_id FROM departures) LEFT JOIN r USING (stop_id)""")
def longest_runs(t: Tables) -> DataFrame:
    served = t.departures.select("stop_id", F.floor(F.col("dep_s") / 3600).alias("hour")).distinct().withColumn("on", F.lit(True))
    every = t.departures.select("stop_id").distinct().select("stop_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    flags = every.join(served, ["stop_id", "hour"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    return H.longest_runs(flags, "stop_id", "hour", "on", 24).withColumn("longest_run", F.col("longest_run").cast("long"))


@query("w8_collapsed", views=["stop_times"], sql="SELECT trip_id, seq, stop_id FROM (SELECT *, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM stop_times) WHERE p IS DISTINCT FROM stop_id")
def collapsed(t: Tables) -> DataFrame:
    return H.changes(t.stop_times.select("trip_id", "seq", "stop_id"), "trip_id", ["seq"], "stop_id")


@query("w10_strided_stops", views=["stops"], sql="SELECT stop_id, p::INT AS position FROM (SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS p FROM stops) WHERE p % 7 = 0")
def strided_stops(t: Tables) -> DataFrame:
    return H.strided(t.stops.select("stop_id"), ["stop_id"], 7).select("stop_id", F.col("position").cast("int").alias("position"))


FREQUENCIES = "SELECT trip_id, 21600 AS start_s, 21600 + (trip_id % 5)::INT * 1800 AS end_s, 600 + (trip_id % 4)::INT * 300 AS headway_s FROM trips WHERE direction_id = 1 AND service_id = 'wd6'"


@query("d1_frequencies", views=["trips", "stop_times"], sql=f"""
WITH f AS ({FREQUENCIES}),
a AS (SELECT trip_id, arg_min(coalesce(nullif(dep_s, 0), arr_s, 0), seq) AS anchor FROM stop_times GROUP BY 1),
s AS (SELECT trip_id, at_s, row_number() OVER (PARTITION BY trip_id ORDER BY at_s) - 1 AS slot FROM (SELECT trip_id, unnest(range(start_s, end_s, headway_s)) AS at_s FROM f WHERE end_s > start_s))
SELECT trip_id::VARCHAR AS trip_id, stop_id, seq, arr_s, dep_s FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM f)
UNION ALL SELECT s.trip_id || '#' || lpad(slot::VARCHAR, 4, '0'), stop_id, seq, arr_s + at_s - anchor, dep_s + at_s - anchor FROM s JOIN a USING (trip_id) JOIN stop_times USING (trip_id)""")
def frequencies(t: Tables) -> DataFrame:
    rows = t.trips.filter("direction_id = 1 and service_id = 'wd6'").selectExpr("trip_id", "21600 as start_s", "21600 + int(trip_id % 5) * 1800 as end_s", "600 + int(trip_id % 4) * 300 as headway_s")
    return T.expanded(rows, t.stop_times)


@query("d2_normalised_times", views=["trips", "stop_times"], sql=f"""
WITH f AS ({FREQUENCIES}),
a AS (SELECT trip_id, arg_min(coalesce(nullif(dep_s, 0), arr_s, 0), seq) AS anchor FROM stop_times GROUP BY 1),
s AS (SELECT trip_id, at_s, row_number() OVER (PARTITION BY trip_id ORDER BY at_s) - 1 AS slot FROM (SELECT trip_id, unnest(range(start_s, end_s, headway_s)) AS at_s FROM f WHERE end_s > start_s)),
x AS (SELECT trip_id::VARCHAR AS trip_id, seq, arr_s, dep_s FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM f)
  UNION ALL SELECT s.trip_id || '#' || lpad(slot::VARCHAR, 4, '0'), seq, arr_s + at_s - anchor, dep_s + at_s - anchor FROM s JOIN a USING (trip_id) JOIN stop_times USING (trip_id)),
k AS (SELECT *, coalesce(nullif(dep_s, 0), arr_s) AS known, row_number() OVER (PARTITION BY trip_id ORDER BY seq) AS pos FROM x), {FILLED},
m AS (SELECT trip_id, time_s < max(time_s) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM h)
SELECT trip_id, count(*) AS n, count(*) FILTER (WHERE late) AS n_late FROM m GROUP BY 1""")
def normalised(t: Tables) -> DataFrame:
    """Expand, fill, check: in that order."""
    rows = t.trips.filter("direction_id = 1 and service_id = 'wd6'").selectExpr("trip_id", "21600 as start_s", "21600 + int(trip_id % 5) * 1800 as end_s", "600 + int(trip_id % 4) * 300 as headway_s")
    full = T.filled_times(T.expanded(rows, t.stop_times))
    return H.running_late(full.select("trip_id", "seq", "time_s"), "trip_id", "seq", "time_s").groupBy("trip_id").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


@query("d3_patterns", views=["stop_times"], sql="""
WITH t AS (SELECT trip_id, stop_id, seq, coalesce(dep_s, arr_s) AS time_s FROM stop_times WHERE coalesce(dep_s, arr_s) IS NOT NULL),
p AS (SELECT trip_id, sha256(string_agg(stop_id, ',' ORDER BY seq)) AS pattern_id, arg_min(time_s, seq) AS start_s FROM t GROUP BY 1),
i AS (SELECT p.pattern_id, p.trip_id, start_s, time_s, row_number() OVER (PARTITION BY t.trip_id ORDER BY seq) - 1 AS i FROM t JOIN p USING (trip_id)),
o AS (SELECT *, time_s < lag(time_s) OVER (PARTITION BY pattern_id, i ORDER BY start_s, trip_id) AS over FROM i)
SELECT pattern_id, count(DISTINCT trip_id) AS n_trips, (max(i) + 1)::INT AS n_stops, bool_or(coalesce(over, false)) AS overtaking FROM o GROUP BY 1""")
def patterns(t: Tables) -> DataFrame:
    rows = t.stop_times.withColumn("time_s", F.coalesce("dep_s", "arr_s")).filter("time_s is not null")
    return T.patterns(rows.select("trip_id", "stop_id", "seq", "time_s"))


@query("a9_headway_histogram", views=["departures"], sql="""
WITH r AS (SELECT stop_id, dep_s - lag(dep_s) OVER (PARTITION BY stop_id ORDER BY dep_s) AS gap FROM (SELECT DISTINCT stop_id, dep_s FROM departures)),
m AS (SELECT stop_id, median(gap) / 60 AS h FROM r GROUP BY 1 HAVING count(gap) > 0)
SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN h < 5 THEN 0 WHEN h < 10 THEN 1 WHEN h < 15 THEN 2 WHEN h < 20 THEN 3 WHEN h < 30 THEN 4 WHEN h < 45 THEN 5 WHEN h < 60 THEN 6 WHEN h < 120 THEN 7 ELSE 8 END AS b FROM m) GROUP BY 1""")
def headway_histogram(t: Tables) -> DataFrame:
    h = H.gaps(t.departures.select("stop_id", "dep_s").distinct(), ["stop_id"]).groupBy("stop_id").agg(F.median("gap").alias("m")).filter("m is not null").withColumn("h", F.col("m") / 60)
    bucket = F.lit(8)
    for i, edge in reversed(list(enumerate((5, 10, 15, 20, 30, 45, 60, 120)))):
        bucket = F.when(F.col("h") < edge, F.lit(i)).otherwise(bucket)
    return h.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("a9_last_departures", views=["departures"], sql="""
SELECT quantile_disc(last_s, 0.1) AS p10, quantile_disc(last_s, 0.5) AS p50, quantile_disc(last_s, 0.9) AS p90 FROM (SELECT stop_id, max(dep_s) AS last_s FROM departures GROUP BY 1)""")
def last_departures(t: Tables) -> DataFrame:
    last = t.departures.groupBy("stop_id").agg(F.max("dep_s").alias("last_s"))
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by last_s)").cast("int")
    return last.agg(disc(0.1).alias("p10"), disc(0.5).alias("p50"), disc(0.9).alias("p90"))


@query("a11_route_headways", views=["departures"], sql="""
WITH w(lo, hi, k) AS (VALUES (25200, 32400, 0), (32400, 57600, 1), (21600, 79200, 2)),
r AS (SELECT k, stop_id, route_dir, dep_s - lag(dep_s) OVER (PARTITION BY k, stop_id, route_dir ORDER BY dep_s) AS gap FROM (SELECT DISTINCT k, stop_id, route_dir, dep_s FROM departures JOIN w ON dep_s >= lo AND dep_s < hi)),
m AS (SELECT k, route_dir, median(h) AS h FROM (SELECT k, stop_id, route_dir, median(gap) AS h FROM r GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL)
SELECT route_dir, k AS window_k, (h * 4)::BIGINT AS headway_4s FROM m QUALIFY row_number() OVER (PARTITION BY route_dir ORDER BY k) = 1""")
def route_headways(t: Tables) -> DataFrame:
    """The median over stops of their medians, in the first window that has any."""
    parts = []
    for k, (lo, hi) in enumerate(((25200, 32400), (32400, 57600), (21600, 79200))):
        m = H.median_headways(t.departures, ["stop_id", "route_dir"], lo, hi).groupBy("route_dir").agg(F.median("headway_s").alias("h"))
        parts.append(m.withColumn("window_k", F.lit(k)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return T.argmax(every, ["route_dir"], ["window_k"]).select("route_dir", "window_k", (F.col("h") * 4).cast("long").alias("headway_4s"))


@query("j28_turnaround_wait", views=["departures"], sql="""
WITH e AS (SELECT stop_id, route_dir, min(dep_s) AS dep_s, trip_id FROM departures GROUP BY ALL),
n AS (SELECT a.stop_id, a.trip_id, min(b.dep_s) AS next_s, any_value(a.dep_s) AS dep_s FROM e a JOIN e b ON a.stop_id = b.stop_id AND b.route_dir <> a.route_dir AND b.dep_s >= a.dep_s GROUP BY 1, 2)
SELECT stop_id, trip_id, next_s - dep_s AS wait_s FROM n""")
def turnaround(t: Tables) -> DataFrame:
    """Wait for the next departure of another route: per stop and route the nearest one at or after, by windows."""
    d = t.departures.groupBy("stop_id", "route_dir", "trip_id").agg(F.min("dep_s").alias("dep_s"))
    ahead = W.partitionBy("stop_id").orderBy("dep_s").rangeBetween(0, W.unboundedFollowing)
    # the first two distinct routes from here on, each with its first time: one of them differs
    soon = F.min(F.struct("dep_s", "route_dir")).over(ahead)
    step = d.withColumn("soon", soon)
    kinds = [r[0] for r in d.select("route_dir").distinct().orderBy("route_dir").collect()]  # route names: a short dimension
    per = [F.min(F.when(F.col("route_dir") == k, F.col("dep_s"))).over(ahead) for k in kinds]
    others = F.array_min(F.array(*[F.when(F.col("route_dir") != k, c) for k, c in zip(kinds, per, strict=True)]))
    return step.withColumn("next_s", others).filter("next_s is not null").select("stop_id", "trip_id", (F.col("next_s") - F.col("dep_s")).alias("wait_s"))
