"""Timetable and map-feature views over the driver's tables, as DataFrames and as DuckDB text.

Coordinates are integers over 10,000 and times integer seconds, so both engines
agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stage import importable

LAT0, LON0 = 42.8, -85.9


class Tables:
    """The tables of one data folder; views by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        importable(spark)
        # metres, days and clock times are compared with an engine in UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        return VIEWS[name](self)


def _at(key: str, lat_step: int, lon_step: int, lat_mod: int = 300, lon_mod: int = 400) -> tuple:
    k = F.col(key)
    return (F.lit(LAT0) + (k * lat_step) % lat_mod / F.lit(1e4)).alias("lat"), (F.lit(LON0) + (k * lon_step) % lon_mod / F.lit(1e4)).alias("lon")


def _stop_id(key: str) -> Column:
    return F.concat(F.lit("s"), F.lpad(F.col(key).cast("string"), 6, "0"))


def stops(t: Tables) -> DataFrame:
    return t("supplier").select(_stop_id("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"), *_at("s_suppkey", 7919, 104729), (F.col("s_suppkey") % 13 == 0).cast("int").alias("location_type"))


def routes(t: Tables) -> DataFrame:
    return t("orders").select((F.col("o_custkey") % 25).alias("k")).distinct().select(F.concat(F.lit("r"), F.col("k")).alias("route_id"), (F.col("k") % 8).cast("int").alias("route_type"), F.concat(F.lit("a"), F.col("k") % 3).alias("agency_id"))


def trips(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("trip_id"), F.concat(F.lit("r"), F.col("o_custkey") % 25).alias("route_id"), (F.col("o_custkey") % 2).cast("int").alias("direction_id"), F.concat(F.lit("wd"), F.weekday("o_orderdate")).alias("service_id"))


def stop_times(t: Tables) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t("lineitem").withColumn("seq", F.row_number().over(order))
    dep = F.lit(21600) + (F.col("l_orderkey") * 37) % 50400 + F.col("seq") * 180
    blank = (F.col("l_orderkey") * 7 + F.col("seq")) % 11 == 0
    return rows.select(F.col("l_orderkey").alias("trip_id"), _stop_id("l_suppkey").alias("stop_id"), "seq", F.when(~blank, dep - 30).alias("arr_s"), F.when(~blank, dep).alias("dep_s"))


def stop_events(t: Tables) -> DataFrame:
    """Rows of stop_times by stop: counted by key first, so an id is spelled once a key and not once a row."""
    keys = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return keys.groupBy(_stop_id("l_suppkey").alias("stop_id")).agg(F.sum("n").alias("events"))


def calendar(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t("orders").groupBy(F.concat(F.lit("wd"), F.weekday("o_orderdate")).alias("service_id"), F.weekday("o_orderdate").cast("int").alias("weekday")).agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"))


def calendar_dates(t: Tables) -> DataFrame:
    """Every 17th order day takes its service out; every 19th puts the Sunday service in."""
    day = t("orders").select(F.to_date("o_orderdate").alias("date")).distinct().withColumn("n", F.datediff("date", F.lit("1992-01-01").cast("date")))
    out = day.filter("n % 17 = 0").select(F.concat(F.lit("wd"), F.weekday("date")).alias("service_id"), "date", F.lit(2).alias("exception_type"))
    return out.unionByName(day.filter("n % 19 = 0").select(F.lit("wd6").alias("service_id"), "date", F.lit(1).alias("exception_type")))


def departures(t: Tables) -> DataFrame:
    """Departures from the event stream: stop, route direction, trip and seconds of the day."""
    ts = F.col("ts")
    return t("events").select(F.col("user_id").alias("stop_id"), F.col("event_type").alias("route_dir"), F.col("event_id").alias("trip_id"), (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("dep_s"))


def pois(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("poi_id"), F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), *_at("p_partkey", 7907, 104723))


def zones(t: Tables) -> DataFrame:
    """Every stop's place as a zone."""
    return t.stops.select(F.concat(F.lit("z"), F.substring("stop_id", 2, 6)).alias("zone_id"), "lat", "lon")


def cells(t: Tables) -> DataFrame:
    """Density cells: customers binned to 0.002 degrees."""
    lat, lon = _at("c_custkey", 7901, 104717)
    return t("customer").select(lat, lon, "c_mktsegment").select(F.floor(F.round(F.col("lat") * 10000) / 20).alias("row"), F.floor(F.round(F.col("lon") * 10000) / 20).alias("col"), "c_mktsegment")


VIEWS = {f.__name__: f for f in (stops, routes, trips, stop_times, calendar, calendar_dates, departures, pois, zones, cells)}


def _sql_at(key: str, lat_step: int, lon_step: int) -> str:
    return f"42.8::DOUBLE + (({key} * {lat_step}) % 300) / 1e4::DOUBLE AS lat, -85.9::DOUBLE + (({key} * {lon_step}) % 400) / 1e4::DOUBLE AS lon"


SQL = {
    "stops": f"SELECT 's' || lpad(s_suppkey::VARCHAR, 6, '0') AS stop_id, s_name AS stop_name, {_sql_at('s_suppkey', 7919, 104729)}, (s_suppkey % 13 = 0)::INT AS location_type FROM supplier",
    "routes": "SELECT 'r' || k AS route_id, (k % 8)::INT AS route_type, 'a' || (k % 3) AS agency_id FROM (SELECT DISTINCT o_custkey % 25 AS k FROM orders)",
    "trips": "SELECT o_orderkey AS trip_id, 'r' || (o_custkey % 25) AS route_id, (o_custkey % 2)::INT AS direction_id, 'wd' || (isodow(o_orderdate) - 1) AS service_id FROM orders",
    "stop_times": """SELECT trip_id, stop_id, seq, CASE WHEN (trip_id * 7 + seq) % 11 <> 0 THEN dep - 30 END AS arr_s, CASE WHEN (trip_id * 7 + seq) % 11 <> 0 THEN dep END AS dep_s
      FROM (SELECT l_orderkey AS trip_id, 's' || lpad(l_suppkey::VARCHAR, 6, '0') AS stop_id, seq, 21600 + (l_orderkey * 37) % 50400 + seq * 180 AS dep
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS seq FROM lineitem))""",
    "calendar": "SELECT 'wd' || (isodow(o_orderdate) - 1) AS service_id, (isodow(o_orderdate) - 1)::INT AS weekday, min(o_orderdate::DATE) AS start_date, max(o_orderdate::DATE) AS end_date FROM orders GROUP BY ALL",
    "calendar_dates": """SELECT 'wd' || (isodow(date) - 1) AS service_id, date, 2 AS exception_type FROM (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) WHERE (date - DATE '1992-01-01') % 17 = 0
      UNION ALL SELECT 'wd6', date, 1 FROM (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) WHERE (date - DATE '1992-01-01') % 19 = 0""",
    "departures": "SELECT user_id AS stop_id, event_type AS route_dir, event_id AS trip_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS dep_s FROM events",
    "pois": f"SELECT p_partkey AS poi_id, p_type AS category, p_name AS name, p_brand AS brand, p_size AS size, {_sql_at('p_partkey', 7907, 104723)} FROM part",
    "zones": f"SELECT 'z' || lpad(s_suppkey::VARCHAR, 6, '0') AS zone_id, {_sql_at('s_suppkey', 7919, 104729)} FROM supplier",
    "cells": "SELECT floor(round((42.8::DOUBLE + ((c_custkey * 7901) % 300) / 1e4::DOUBLE) * 10000) / 20)::BIGINT AS row, floor(round((-85.9::DOUBLE + ((c_custkey * 104717) % 400) / 1e4::DOUBLE) * 10000) / 20)::BIGINT AS col, c_mktsegment FROM customer",
}


def with_views(names: Sequence[str], sql: str) -> str:
    """``sql`` with the named views in front; ``sql`` may start with its own WITH."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    if not views:
        return sql
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"
