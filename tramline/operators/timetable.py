"""Calendars, service days and stop times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def active_services(dates: DataFrame, calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(date, service_id): weekday and window hold, less removals (2), plus additions (1)."""
    day = dates.select("date").distinct()
    base = day.join(calendar, (F.weekday("date") == F.col("weekday")) & F.col("date").between(F.col("start_date"), F.col("end_date"))).select("date", "service_id")
    gone = exceptions.filter("exception_type = 2").select("date", "service_id")
    more = exceptions.filter("exception_type = 1").select("date", "service_id").join(day, "date", "left_semi")
    return base.unionByName(more).join(gone, ["date", "service_id"], "left_anti").distinct()


def date_profiles(active: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips of each date; dates without any are left out."""
    per = trips.groupBy("service_id").agg(F.count("*").alias("trips"))
    return active.join(per, "service_id").groupBy("date").agg(F.sum("trips").alias("trips")).filter("trips > 0")


def day_types(profiles: DataFrame, active: DataFrame, alike: float = 1.5) -> DataFrame:
    """Weekdays grouped to day types, in calendar order: day_type, label, trips, n_dates, representative, dates, service_ids.

    Monday to Friday are one type if two or more of them run and their lower median
    trips differ by ``alike`` times at most.  The representative date has the lower
    median of trips, and of several such dates it is the middle one, the later of two.
    Dates and services are lists of one calendar, so their length is bounded.
    """
    day = profiles.withColumn("dow", F.weekday("date"))
    medians = day.filter("dow < 5").groupBy("dow").agg(F.expr("percentile_disc(0.5) within group (order by trips)").alias("m"))
    merged = medians.agg(((F.max("m") <= F.min("m") * alike) & (F.count("*") > 1)).alias("merge"))
    weekday = (F.col("dow") < 5) & F.coalesce("merge", F.lit(False))
    key = F.when(weekday, "weekday").when(F.col("dow") == 5, "saturday").when(F.col("dow") == 6, "sunday").otherwise(F.concat(F.lit("dow"), F.col("dow")))
    keyed = day.crossJoin(F.broadcast(merged)).withColumn("day_type", key).withColumn("rank", F.when(weekday, 0).otherwise(F.col("dow")))  # one row
    middle = keyed.groupBy("day_type", "rank").agg(F.expr("percentile_disc(0.5) within group (order by trips)").alias("trips"), F.count("*").alias("n_dates"), F.array_sort(F.collect_list("date")).alias("dates"))
    tied = keyed.select("day_type", "trips", "date").join(middle, ["day_type", "trips"])
    place = W.partitionBy("day_type").orderBy("date")
    ranked = tied.withColumn("rn", F.row_number().over(place)).withColumn("n", F.count("*").over(W.partitionBy("day_type")))
    chosen = ranked.filter(F.col("rn") == F.floor(F.col("n") / 2) + 1)
    services = active.groupBy(F.col("date").alias("on")).agg(F.array_sort(F.collect_set("service_id")).alias("service_ids"))
    label = F.when(F.col("day_type") == "weekday", "Weekday").otherwise(F.date_format("date", "EEEE"))
    return chosen.join(services, F.col("date") == F.col("on")).select("day_type", label.alias("label"), "trips", "n_dates", F.col("date").alias("representative"), "dates", "service_ids", "rank")


def service_gaps(profiles: DataFrame, reduced: float = 0.8) -> DataFrame:
    """Dates of the window with no service, or with less than ``reduced`` of their weekday's median trips."""
    window = profiles.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    usual = profiles.groupBy(F.weekday("date").alias("dow")).agg(F.expr("percentile_disc(0.5) within group (order by trips)").alias("usual"))
    out = window.join(profiles, "date", "left").withColumn("dow", F.weekday("date")).join(usual, "dow", "left")
    kind = F.when(F.col("trips").isNull(), F.lit("none")).when(F.col("trips") < F.col("usual") * reduced, F.lit("reduced"))
    return out.withColumn("kind", kind).filter("kind is not null").select("date", "kind", F.coalesce("trips", F.lit(0)).cast("long").alias("trips"))


def filled_times(stop_times: DataFrame) -> DataFrame:
    """Blank times filled between the known ones around them, halves to even; beyond the first and last known one the nearest.

    A row's time is its departure, or its arrival where that is missing or 0.  The axis is the distance
    travelled where all rows of the trip have one and the trip goes anywhere, else the place in
    the trip.  In a trip with a blank, one-sided times are completed too.
    Returns the columns with arr_s and dep_s filled, and time_s.
    """
    rows = stop_times if "dist" in stop_times.columns else stop_times.withColumn("dist", F.lit(None).cast("double"))
    whole, trip = W.partitionBy("trip_id"), W.partitionBy("trip_id").orderBy("seq")
    rows = rows.withColumn("known", F.coalesce(F.nullif("dep_s", F.lit(0)), "arr_s")).withColumn("at", F.row_number().over(trip).cast("double"))
    every = (F.count("dist").over(whole) == F.count("*").over(whole)) & (F.last("dist").over(trip.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) != F.first("dist").over(trip.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = rows.withColumn("axis", F.when(every, F.col("dist")).otherwise(F.col("at"))).withColumn("blank", F.count("known").over(whole) < F.count("*").over(whole))
    mark = F.when(F.col("known").isNotNull(), F.struct("axis", "known"))
    rows = rows.withColumn("a", F.last(mark, True).over(trip.rowsBetween(W.unboundedPreceding, 0))).withColumn("b", F.first(mark, True).over(trip.rowsBetween(0, W.unboundedFollowing)))
    span = F.col("b.axis") - F.col("a.axis")
    share = F.when(span != 0, F.try_divide(F.col("axis") - F.col("a.axis"), span)).otherwise(F.lit(0.5))
    between = F.bround(F.col("a.known") + share * (F.col("b.known") - F.col("a.known"))).cast("long")
    time = F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("a").isNull(), F.col("b.known")).when(F.col("b").isNull(), F.col("a.known")).otherwise(between).cast("long")
    full = lambda c: F.when(F.col("blank"), F.coalesce(c, "time_s")).otherwise(F.col(c)).cast("long").alias(c)
    return rows.withColumn("time_s", time).select("trip_id", "stop_id", "seq", full("arr_s"), full("dep_s"), "time_s")


def expanded(frequencies: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stop times of the trips that headways stand for: one copy a slot in [start, end), shifted from the first row's time.

    The template's own rows go, also where its frequency row can't be used.
    """
    anchor = stop_times.groupBy("trip_id").agg(F.min_by(F.coalesce(F.nullif("dep_s", F.lit(0)), "arr_s", F.lit(0)), "seq").alias("anchor"))
    good = frequencies.filter("headway_s > 0 and end_s > start_s")
    slots = good.select("trip_id", F.posexplode(F.expr("sequence(start_s, end_s - 1, headway_s)")).alias("_p", "at_s"))
    order = W.partitionBy("trip_id").orderBy("at_s", "_p")
    slots = slots.withColumn("slot", F.row_number().over(order) - 1).drop("_p")
    made = slots.join(anchor, "trip_id").join(stop_times, "trip_id")
    shift = F.col("at_s") - F.col("anchor")
    copies = made.select(F.concat(F.col("trip_id").cast("string"), F.lit("#"), F.format_string("%04d", F.col("slot"))).alias("trip_id"), "stop_id", "seq", (F.col("arr_s") + shift).alias("arr_s"), (F.col("dep_s") + shift).alias("dep_s"))
    rest = stop_times.join(frequencies.select("trip_id").distinct(), "trip_id", "left_anti")
    return rest.select(F.col("trip_id").cast("string").alias("trip_id"), "stop_id", "seq", "arr_s", "dep_s").unionByName(copies)


def patterns(stop_times: DataFrame) -> DataFrame:
    """Trips' patterns: the digest of their stops in order, and whether a later trip arrives earlier somewhere."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "time_s"))), lambda x: F.struct(x["stop_id"], x["time_s"]))
    trip = stop_times.groupBy("trip_id").agg(ordered.alias("at")).withColumn("pattern_id", F.sha2(F.concat_ws(",", F.col("at.stop_id")), 256))
    rows = trip.select("trip_id", "pattern_id", F.col("at")[0]["time_s"].alias("start_s"), F.posexplode("at.time_s").alias("i", "t"))
    step = W.partitionBy("pattern_id", "i").orderBy("start_s", "trip_id")
    over = rows.withColumn("overtakes", F.coalesce(F.col("t") < F.lag("t").over(step), F.lit(False)))
    return over.groupBy("pattern_id").agg(F.countDistinct("trip_id").alias("n_trips"), (F.max("i") + 1).alias("n_stops"), F.bool_or("overtakes").alias("overtaking"))


def service_day(trips: DataFrame, stop_times: DataFrame, stops: DataFrame, services: DataFrame) -> DataFrame:
    """Stop events of the trips that run; rows at unknown stops drop, one-sided times are copied."""
    run = trips.join(services.select("service_id").distinct(), "service_id", "left_semi").select("trip_id", "route_id", "direction_id", "service_id")
    rows = stop_times.join(run, "trip_id").join(stops.select("stop_id"), "stop_id")
    return rows.select("service_id", "trip_id", "route_id", "direction_id", "stop_id", "seq", F.coalesce("arr_s", "dep_s").alias("arr_s"), F.coalesce("dep_s", "arr_s").alias("dep_s"))


def argmax(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in ``order``."""
    window = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")
