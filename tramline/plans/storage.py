"""Scans and sinks, each written to the shared folder and read again where it has a file format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..catalog import query
from ..sources import gtfs, sinks
from ..stage import new_path


@query("s2_csv_scan", sql="SELECT s_suppkey, s_name, round(s_acctbal * 100)::BIGINT AS cents, 'a, \"b\"' || chr(10) || s_suppkey AS note FROM supplier")
def csv_scan(t: Tables) -> DataFrame:
    """Suppliers through a CSV file with commas, quotes and line ends in fields."""
    rows = t("supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("string").alias("s_acctbal"), F.concat(F.lit('a, "b"\n'), "s_suppkey").alias("note"))
    path = new_path(t.spark, "csv")
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    back = gtfs.read_csv(t.spark, path, ["s_suppkey", "s_name", "s_acctbal", "note", "missing"])
    return back.filter("missing is null").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.round(F.col("s_acctbal").cast("double") * 100).cast("long").alias("cents"), "note")


@query("s4_stop_times", views=["stop_times"], sql="SELECT trip_id::VARCHAR AS trip_id, stop_id, seq::INT AS seq, arr_s::INT AS arr_s, dep_s::INT AS dep_s FROM stop_times")
def stop_times(t: Tables) -> DataFrame:
    """Clock texts to typed stop times."""
    clock = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%d:%02d:%02d", F.floor(F.col(c) / 3600), F.floor(F.col(c) / 60) % 60, F.col(c) % 60))
    raw = t.stop_times.select(F.col("trip_id").cast("string").alias("trip_id"), "stop_id", F.col("seq").cast("string").alias("stop_sequence"), clock("arr_s").alias("arrival_time"), clock("dep_s").alias("departure_time"), F.lit(None).cast("string").alias("shape_dist_traveled"))
    return gtfs.stop_times(raw).drop("dist")


@query("s5_stops", views=["stops"], sql="SELECT stop_id, stop_name, round(lat * 1e4)::BIGINT AS lat_e4 FROM stops WHERE location_type = 0")
def stops(t: Tables) -> DataFrame:
    raw = t.stops.select("stop_id", "stop_name", F.col("lat").cast("string").alias("stop_lat"), F.col("lon").cast("string").alias("stop_lon"), F.when(F.col("location_type") == 1, "1").alias("location_type"), F.lit(None).cast("string").alias("parent_station"))
    return gtfs.stops(raw).select("stop_id", "stop_name", F.round(F.col("lat") * 1e4).cast("long").alias("lat_e4"))


@query("s19_catalogue_load", sql="SELECT n_nationkey AS id, n_name AS name FROM nation")
def catalogue_load(t: Tables) -> DataFrame:
    """A catalogue through JSON lines, with a declared schema."""
    path = new_path(t.spark, "json")
    t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.json(path)
    return t.spark.read.schema("id int, name string").json(path)


@query("k1_sorted_json", sql="""SELECT '{"n":' || n_nationkey || ',"name":"' || n_name || '","r":' || n_regionkey || '}' AS line FROM nation""")
def sorted_json(t: Tables) -> DataFrame:
    return sinks.json_lines(t("nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("name")), ["n"])


@query("k2_csv_lines", sql="SELECT s_suppkey || ',' || chr(34) || s_name || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) || ',' || s_nationkey AS line FROM supplier")
def csv_lines(t: Tables) -> DataFrame:
    return sinks.csv_lines(t("supplier").select("s_suppkey", F.concat("s_name", F.lit(', "x"')).alias("name"), "s_nationkey"))


@query("k3_clustered_layer", views=["pois"], sql="SELECT poi_id, category FROM pois WHERE lat <= 42.81 AND lon <= -85.88")
def clustered_layer(t: Tables) -> DataFrame:
    """POIs written in cell order and read back by a box, which prunes row groups."""
    path = new_path(t.spark, "layer")
    sinks.clustered(t.pois.select("poi_id", "category", "lat", "lon"), path, "lon", "lat", 0.005, 8)
    return t.spark.read.parquet(path).filter("lat <= 42.81 and lon <= -85.88").select("poi_id", "category")


@query("k4_manifest", sql="""SELECT p_brand, count(*) AS n, sum(strlen('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey || '}'))::BIGINT AS bytes, count(DISTINCT p_partkey) = count(*) AS told_apart, false AS partial FROM part GROUP BY 1""")
def manifest(t: Tables) -> DataFrame:
    """Counts, bytes and digests of layers; told_apart: leaving a row out changes the digest."""
    rows = t("part").select("p_partkey", "p_name", "p_brand")
    whole = sinks.manifest(rows, "p_brand")
    first = rows.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    less = sinks.manifest(rows.join(first, ["p_brand", "p_partkey"], "left_anti").unionByName(rows.join(first, ["p_brand", "p_partkey"]).withColumn("p_name", F.lit("?"))), "p_brand").select("p_brand", F.col("digest").alias("other"))
    return whole.join(less, "p_brand").select("p_brand", "n", "bytes", (F.col("digest") != F.col("other")).alias("told_apart"), "partial")


@query("k7_public_columns", views=["routes"], sql="SELECT route_id, route_type FROM routes")
def public_columns(t: Tables) -> DataFrame:
    return t.routes.select("route_id", "route_type")


@query("s1_archive_tables", sql="SELECT n_nationkey::VARCHAR AS stop_id, n_name AS stop_name FROM nation")
def archive_tables(t: Tables) -> DataFrame:
    """A feed archive of the nations, written on the driver (25 rows) and read by the archive reader."""
    rows = [["stop_id", "stop_name"], *[[str(r.n_nationkey), r.n_name] for r in t("nation").collect()]]  # a fixed dimension
    path = new_path(t.spark, "feeds")
    data = sinks.archive({"stops": rows, "agency": [["agency_id"], ["a"]]})
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/nations.zip") as out:
        out.write(data)
    return gtfs.read_zips(t.spark, path, "stops", ["stop_id", "stop_name"]).select("stop_id", "stop_name")
