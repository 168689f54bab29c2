"""Departures, gaps and headways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import numbered


def first_departures(departures: DataFrame, keys: Sequence[str] = ("stop_id", "trip_id")) -> DataFrame:
    """One departure of a trip at a stop: its earliest."""
    return departures.groupBy(*keys).agg(F.min("dep_s").alias("dep_s"))


def gaps(times: DataFrame, by: Sequence[str], time: str = "dep_s") -> DataFrame:
    """Adds gap: seconds since the group's departure before; null for its first."""
    return times.withColumn("gap", F.col(time) - F.lag(time).over(W.partitionBy(*by).orderBy(time)))


def middle(value: str, bound: float) -> list[Column]:
    """The counts that median_at_most() reads: of values, of those up to ``bound``, and the two nearest to it."""
    low = F.when(F.col(value) <= bound, F.col(value))
    high = F.when(F.col(value) > bound, F.col(value))
    return [F.count(value).alias("mid_n"), F.count(low).alias("mid_low"), F.max(low).alias("mid_below"), F.min(high).alias("mid_above")]


def median_at_most(bound: float) -> Column:
    """Whether the median of middle()'s values is at most ``bound``: by counts, so no group is sorted; null without values."""
    twice = 2 * F.col("mid_low")
    even = F.col("mid_below") + F.col("mid_above") <= 2 * bound
    return F.when(F.col("mid_n") > 0, F.when(twice == F.col("mid_n"), even).otherwise(twice > F.col("mid_n")))


def median_headways(departures: DataFrame, by: Sequence[str], lo: int = 6 * 3600, hi: int = 22 * 3600) -> DataFrame:
    """Median gap between distinct departures in [lo, hi) of each group that has two or more."""
    times = departures.filter((F.col("dep_s") >= lo) & (F.col("dep_s") < hi)).select(*by, "dep_s").distinct()
    return gaps(times, by).groupBy(*by).agg(F.median("gap").alias("headway_s"), F.count("*").alias("n_departures")).filter("n_departures >= 2")


def best_headways(departures: DataFrame, stop: str = "stop_id", route_dir: str = "route_dir") -> DataFrame:
    """Each stop's best single route direction: the smallest of its median headways."""
    return median_headways(departures, [stop, route_dir]).groupBy(stop).agg(F.min("headway_s").alias("best_s"))


def stop_facts(departures: DataFrame, frequent_s: int = 900) -> DataFrame:
    """Departures (one a trip, in order) and routes as lists of a day's length, first and last, median and worst gap, best route direction of each stop."""
    first = first_departures(departures).groupBy("stop_id").agg(F.count("*").alias("n_departures"), F.array_sort(F.collect_list("dep_s")).alias("departures"))
    base = departures.groupBy("stop_id").agg(F.array_sort(F.collect_set("route_dir")).alias("routes"), F.min("dep_s").alias("first_s"), F.max("dep_s").alias("last_s")).join(first, "stop_id").withColumn("n_routes", F.size("routes").cast("long"))
    spread = gaps(departures.select("stop_id", "dep_s").distinct(), ["stop_id"]).groupBy("stop_id").agg(F.median("gap").alias("median_gap_s"), F.max("gap").alias("worst_gap_s"))
    out = base.join(spread, "stop_id").join(best_headways(departures), "stop_id", "left")
    return out.withColumn("frequent", F.coalesce(F.col("best_s") <= frequent_s, F.lit(False)))


def running_late(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adds late: whether the value is below the largest one before it in its group."""
    top = F.max(value).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("late", F.coalesce(F.col(value) < top, F.lit(False)))


def longest_runs(rows: DataFrame, by: str, at: str, flag: str, lap: int | None = None) -> DataFrame:
    """Longest run of consecutive true flags of each group; with ``lap`` positions form a circle of that length."""
    true = rows.filter(flag).select(by, at)
    if lap is not None:
        true = true.unionByName(true.withColumn(at, F.col(at) + lap))
    island = F.col(at) - F.row_number().over(W.partitionBy(by).orderBy(at))
    runs = true.withColumn("island", island).groupBy(by, "island").agg(F.count("*").alias("n")).groupBy(by).agg(F.max("n").alias("n"))
    longest = F.coalesce("n", F.lit(0))
    out = rows.select(by).distinct().join(runs, by, "left")
    return out.select(by, (longest if lap is None else F.least(longest, F.lit(lap))).alias("longest_run"))


def changes(rows: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before them in their group."""
    before = F.lag(value).over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("_before", before).filter(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def strided(rows: DataFrame, order: Sequence[str], stride: int, offset: int = 0) -> DataFrame:
    """Every ``stride``-th row in order, which must be total."""
    return numbered(rows, order).filter((F.col("position") % stride) == offset)
