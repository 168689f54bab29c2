"""Merging feeds, the catalogue of feeds, snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import Tables
from ..catalog import query
from ..operators import merge as M

#: Three feeds cut from the orders by month: their trips, windows and order.
FEEDS = "tf AS (SELECT o_orderkey AS trip_id, o_custkey % 25 AS route, (month(o_orderdate) % 3)::INT AS feed, o_orderdate::DATE AS day FROM orders), fw AS (SELECT feed, count(*) AS trips, min(day) AS a, max(day) AS b FROM tf GROUP BY 1), ord AS (SELECT *, 'f' || (row_number() OVER (ORDER BY md5(feed::VARCHAR), feed) - 1) AS tag FROM fw)"


def feed_trips(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 25).alias("route"), (F.month("o_orderdate") % 3).alias("feed"), F.to_date("o_orderdate").alias("day"))


def merge_order(t: Tables) -> DataFrame:
    """Feeds in the order of their digest, with a tag each."""
    w = feed_trips(t).groupBy("feed").agg(F.count("*").alias("trips"), F.min("day").alias("a"), F.max("day").alias("b"))
    at = F.row_number().over(W.orderBy(F.md5(F.col("feed").cast("string")), "feed")) - 1
    return w.withColumn("tag", F.concat(F.lit("f"), at))


@query("u3_merge_order", sql=f"WITH {FEEDS} SELECT feed, tag, trips FROM ord")
def merged_order(t: Tables) -> DataFrame:
    return merge_order(t).select("feed", "tag", "trips")


@query("u1_merged_trips", sql=f"WITH {FEEDS} SELECT tag || ':' || trip_id AS trip_id, tag || ':r' || route AS route_id FROM tf JOIN ord USING (feed)")
def merged_trips(t: Tables) -> DataFrame:
    rows = feed_trips(t).join(F.broadcast(merge_order(t).select("feed", "tag")), "feed")  # a row a feed
    return rows.select(F.concat("tag", F.lit(":"), "trip_id").alias("trip_id"), F.concat("tag", F.lit(":r"), "route").alias("route_id"))


@query("u1_merged_tables", views=["stops", "stop_times", "calendar"], sql=f"""
WITH {FEEDS}, st AS (SELECT tag, s.trip_id, s.stop_id FROM stop_times s JOIN tf USING (trip_id) JOIN ord USING (feed))
SELECT 'trips' AS name, count(*) AS n, count(DISTINCT tag || ':' || trip_id) AS ids, min(tag || ':' || trip_id) AS first_id FROM tf JOIN ord USING (feed)
UNION ALL SELECT 'routes', count(*), count(*), min(id) FROM (SELECT DISTINCT tag || ':r' || route AS id FROM tf JOIN ord USING (feed))
UNION ALL SELECT 'stop_times', count(*), count(DISTINCT tag || ':' || trip_id), min(tag || ':' || trip_id) FROM st
UNION ALL SELECT 'stops', count(*), count(*), min(tag || ':' || stop_id) FROM stops, ord
UNION ALL SELECT 'calendar', count(*), count(*), min(tag || ':' || service_id) FROM calendar, ord
UNION ALL SELECT 'agency', count(*), count(*), min(tag || ':a') FROM ord""")
def merged_tables(t: Tables) -> DataFrame:
    """Three feeds' tables as one: rows, ids and the first id of each."""
    rows = feed_trips(t)
    dates = {r.feed: r for r in merge_order(t).collect()}  # a row a feed
    feeds = []
    for k, r in sorted(dates.items()):
        own = rows.filter(F.col("feed") == k)
        tables = {
            "agency": t.spark.createDataFrame([("a", f"agency {k}")], "agency_id string, agency_name string"), "trips": own.select("trip_id", F.concat(F.lit("r"), "route").alias("route_id")), "routes": own.select(F.concat(F.lit("r"), "route").alias("route_id")).distinct().withColumn("agency_id", F.lit("")),
            "stop_times": t.stop_times.join(own.select("trip_id"), "trip_id").select("trip_id", "stop_id", "seq"), "stops": t.stops.select("stop_id", "stop_name"), "calendar": t.calendar.select("service_id", "weekday"),
        }
        feeds.append(M.Feed(tables, hashlib.md5(str(k).encode()).hexdigest(), str(k), "", r.a.strftime("%Y%m%d"), r.b.strftime("%Y%m%d")))
    whole = M.merged(t.spark, feeds).tables
    keys = {"trips": "trip_id", "routes": "route_id", "stop_times": "trip_id", "stops": "stop_id", "calendar": "service_id", "agency": "agency_id"}
    parts = [whole[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.countDistinct(c).alias("ids"), F.min(c).alias("first_id")) for n, c in keys.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("u1_merged_window", sql=f"WITH {FEEDS}, m AS (SELECT max(a) AS a, min(b) AS b, min(a) AS ua, max(b) AS ub FROM ord) SELECT CASE WHEN a <= b THEN a ELSE ua END AS start_date, CASE WHEN a <= b THEN b ELSE ub END AS end_date, CASE WHEN a > b THEN 'merge_no_overlap' WHEN b - a < 6 THEN 'merge_short_overlap' END AS note FROM m")
def merged_window(t: Tables) -> DataFrame:
    """The days all feeds cover; all days, with a note, where there are none."""
    m = merge_order(t).agg(F.max("a").alias("a"), F.min("b").alias("b"), F.min("a").alias("ua"), F.max("b").alias("ub"))
    meet = F.col("a") <= F.col("b")
    note = F.when(~meet, "merge_no_overlap").when(F.datediff("b", "a") < 6, "merge_short_overlap")
    return m.select(F.when(meet, F.col("a")).otherwise(F.col("ua")).alias("start_date"), F.when(meet, F.col("b")).otherwise(F.col("ub")).alias("end_date"), note.alias("note"))


@query("a24_primary_feed", sql=f"WITH {FEEDS} SELECT feed, trips FROM ord ORDER BY trips DESC, tag LIMIT 1")
def primary_feed(t: Tables) -> DataFrame:
    return merge_order(t).orderBy(F.desc("trips"), "tag").limit(1).select("feed", "trips")


@query("u2_prefix_depth", sql="SELECT CASE WHEN count(*) FILTER (WHERE regexp_matches(id, '^f[0-9]+::')) > 0 THEN 3 WHEN count(*) FILTER (WHERE regexp_matches(id, '^f[0-9]+:')) > 0 THEN 2 ELSE 1 END AS depth FROM (SELECT CASE WHEN o_orderkey % 1000 = 7 THEN 'f0:' || o_orderkey ELSE o_orderkey::VARCHAR END AS id FROM orders)")
def prefix_depth(t: Tables) -> DataFrame:
    """One colon more than the ids that look prefixed already have."""
    ids = t("orders").select(F.when(F.col("o_orderkey") % 1000 == 7, F.concat(F.lit("f0:"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string")).alias("id"))
    return ids.agg(F.coalesce(F.max(F.length(F.regexp_extract("id", r"^f\d+(:+)", 1))), F.lit(0)).alias("d")).select((F.col("d") + 1).alias("depth"))


@query("u4_appended_times", views=["stop_times"], sql="SELECT 'f0:' || trip_id AS trip_id, seq, dep_s FROM stop_times UNION ALL SELECT 'f1:' || trip_id, seq, dep_s + 86400 FROM stop_times WHERE trip_id % 10 = 1")
def appended_times(t: Tables) -> DataFrame:
    st = t.stop_times.select("trip_id", "seq", "dep_s")
    tag = lambda k: F.concat(F.lit(f"f{k}:"), F.col("trip_id")).alias("trip_id")
    return st.select(tag(0), "seq", "dep_s").unionByName(st.filter("trip_id % 10 = 1").select(tag(1), "seq", (F.col("dep_s") + 86400).alias("dep_s")))


@query("u14_fare_table", sql=f"WITH {FEEDS}, o AS (SELECT feed, trips, tag, (feed <> 0) AS has FROM ord) SELECT feed FROM o WHERE has ORDER BY (trips = (SELECT max(trips) FROM o)) DESC, tag LIMIT 1")
def fare_table(t: Tables) -> DataFrame:
    """The one feed whose fares are quoted: the primary if it has any, else the first that has."""
    o = merge_order(t).withColumn("has", F.col("feed") != 0)
    top = o.agg(F.max("trips").alias("most"))
    return o.crossJoin(top).filter("has").orderBy(F.desc(F.col("trips") == F.col("most")), "tag").limit(1).select("feed")  # one row


CATALOGUE = """cat AS (SELECT 'feed-' || p_partkey AS id, p_name AS p, p_brand AS n, p_type AS m, p_size AS t, p_size % 9 = 0 AS regional, p_size % 11 = 0 AS inactive,
  CASE WHEN p_size % 17 = 0 THEN 0 ELSE 40 + p_size / 10.0::DOUBLE END AS s, -80 + p_size / 10.0::DOUBLE AS w, 40.5::DOUBLE + p_size / 5.0::DOUBLE AS nn, CASE WHEN p_size % 13 = 0 THEN -90 ELSE -79 + p_size / 5.0::DOUBLE END AS e, p_partkey FROM part)"""


def catalogue(t: Tables) -> DataFrame:
    z = F.col("p_size")
    return t("part").select(
        F.concat(F.lit("feed-"), "p_partkey").alias("id"), F.col("p_name").alias("p"), F.col("p_brand").alias("n"), F.col("p_type").alias("m"), z.alias("t"), (z % 9 == 0).alias("regional"), (z % 11 == 0).alias("inactive"),
        F.when(z % 17 == 0, 0.0).otherwise(40 + z / 10.0).alias("s"), (-80 + z / 10.0).alias("w"), (40.5 + z / 5.0).alias("nn"), F.when(z % 13 == 0, -90.0).otherwise(-79 + z / 5.0).alias("e"), "p_partkey",
    )


@query("p8_visible_rows", sql=f"WITH {CATALOGUE} SELECT id FROM cat WHERE NOT regional AND NOT inactive")
def visible_rows(t: Tables) -> DataFrame:
    return catalogue(t).filter("not regional and not inactive").select("id")


DROP = "CASE WHEN s = 0 OR w = 0 OR nn = 0 OR e = 0 THEN 'zero edge' WHEN abs(s) > 85 OR abs(nn) > 85 THEN 'beyond 85' WHEN NOT (s < nn AND w < e) THEN 'inverted' WHEN nn - s > 60 THEN 'too tall' WHEN e - w > 150 THEN 'too wide' WHEN nn - s < 0.001 AND e - w < 0.001 THEN 'degenerate' END"


def drop_reason():
    """Why a box can't be used, the first reason that holds; null if it can."""
    s, w, n, e = (F.col(c) for c in ("s", "w", "nn", "e"))
    return (
        F.when((s == 0) | (w == 0) | (n == 0) | (e == 0), "zero edge").when((F.abs(s) > 85) | (F.abs(n) > 85), "beyond 85").when(~((s < n) & (w < e)), "inverted")
        .when(n - s > 60, "too tall").when(e - w > 150, "too wide").when((n - s < 0.001) & (e - w < 0.001), "degenerate")
    )


@query("p12_drop_reasons", sql=f"WITH {CATALOGUE} SELECT coalesce({DROP}, 'kept') AS reason, count(*) AS n FROM cat GROUP BY 1")
def drop_reasons(t: Tables) -> DataFrame:
    return catalogue(t).groupBy(F.coalesce(drop_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("w6_first_per_box", sql=f"WITH {CATALOGUE} SELECT id FROM cat WHERE {DROP} IS NULL QUALIFY row_number() OVER (PARTITION BY n, s, w, nn, e ORDER BY id) = 1")
def first_per_box(t: Tables) -> DataFrame:
    """One row per provider and box: the smallest id."""
    return catalogue(t).filter(drop_reason().isNull()).groupBy("n", "s", "w", "nn", "e").agg(F.min("id").alias("id")).select("id")


@query("g16_box_spans", sql=f"WITH {CATALOGUE} SELECT id, round((s + nn) / 2 * 1e5)::BIGINT AS lat_e5, round((w + e) / 2 * 1e5)::BIGINT AS lon_e5, round(greatest((nn - s) * 110.574::DOUBLE, abs(e - w) * 111.320::DOUBLE * cos(radians((s + nn) / 2))) * 100)::BIGINT AS span_dam FROM cat WHERE {DROP} IS NULL")
def box_spans(t: Tables) -> DataFrame:
    mid = (F.col("s") + F.col("nn")) / 2
    span = F.greatest((F.col("nn") - F.col("s")) * 110.574, F.abs(F.col("e") - F.col("w")) * 111.320 * F.cos(F.radians(mid)))
    return catalogue(t).filter(drop_reason().isNull()).select("id", F.round(mid * 1e5).cast("long").alias("lat_e5"), F.round((F.col("w") + F.col("e")) / 2 * 1e5).cast("long").alias("lon_e5"), F.round(span * 100).cast("long").alias("span_dam"))


TERM = "brand#1"


@query("t3_catalogue_search", sql=f"""
WITH {CATALOGUE}, h AS (SELECT id, lower(p) AS p, lower(n) AS n, lower(m) AS m, regional OR inactive AS opt, t, strpos(lower(p) || ' — ' || lower(n), '{TERM}') AS pos FROM cat WHERE contains(lower(p) || chr(10) || lower(n) || chr(10) || lower(m), '{TERM}')),
k AS (SELECT *, CASE WHEN p = '{TERM}' OR p || ' — ' || n = '{TERM}' OR m = '{TERM}' THEN 0 WHEN starts_with(p, '{TERM}') OR starts_with(m, '{TERM}') THEN 1 WHEN regexp_matches(p, '(^|[^a-z0-9]){TERM}') OR regexp_matches(n, '(^|[^a-z0-9]){TERM}') OR regexp_matches(m, '(^|[^a-z0-9]){TERM}') THEN 2 ELSE 4 END AS tier FROM h)
SELECT id, tier, (SELECT count(*) FROM k) AS total FROM k ORDER BY tier, opt, pos, t DESC, p, id LIMIT 20""")
def catalogue_search(t: Tables, term: str = TERM, most: int = 20) -> DataFrame:
    """The best twenty matches by tier, opt-in, place of the match, size, name, id; and how many match at all."""
    p, n, m = F.lower("p"), F.lower("n"), F.lower("m")
    label = F.concat(p, F.lit(" — "), n)
    hits = catalogue(t).filter(F.concat_ws("\n", p, n, m).contains(term))
    word = rf"(^|[^a-z0-9])\Q{term}\E"
    tier = F.when((p == term) | (label == term) | (m == term), 0).when(p.startswith(term) | m.startswith(term), 1).when(p.rlike(word) | n.rlike(word) | m.rlike(word), 2).otherwise(4)
    ranked = hits.withColumn("tier", tier).withColumn("at", F.instr(label, term)).withColumn("opt", F.col("regional") | F.col("inactive"))
    total = hits.agg(F.count("*").alias("total"))
    return ranked.orderBy("tier", "opt", "at", F.desc("t"), p, "id").limit(most).crossJoin(total).select("id", "tier", "total")  # one row


SNAPSHOTS = "old AS (SELECT p_partkey AS id, p_size AS box, p_size % 7 AS t FROM part WHERE p_partkey % 11 <> 0), new AS (SELECT p_partkey AS id, p_size + (p_partkey % 13 = 0)::INT AS box, (p_size + (p_partkey % 17 = 0)::INT) % 7 AS t FROM part WHERE p_partkey % 19 <> 0)"


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, z = F.col("p_partkey"), F.col("p_size")
    old = t("part").filter(k % 11 != 0).select(k.alias("id"), z.alias("box"), (z % 7).alias("t"))
    new = t("part").filter(k % 19 != 0).select(k.alias("id"), (z + (k % 13 == 0).cast("int")).alias("box"), ((z + (k % 17 == 0).cast("int")) % 7).alias("t"))
    return old, new


@query("j22_carried_forward", sql=f"WITH {SNAPSHOTS} SELECT n.id, coalesce(CASE WHEN n.id % 5 <> 0 THEN n.box END, o.box) AS box, n.id % 5 = 0 AND o.box IS NOT NULL AS carried FROM new n LEFT JOIN old o USING (id)")
def carried_forward(t: Tables) -> DataFrame:
    """Rows whose own box is bad keep the last snapshot's."""
    old, new = snapshots(t)
    own = F.when(F.col("id") % 5 != 0, F.col("box"))
    return new.join(old.select("id", F.col("box").alias("before")), "id", "left").select("id", F.coalesce(own, "before").alias("box"), ((F.col("id") % 5 == 0) & F.col("before").isNotNull()).alias("carried"))


@query("j23_snapshot_diff", sql=f"WITH {SNAPSHOTS} SELECT count(*) FILTER (WHERE o.id IS NULL) AS added, count(*) FILTER (WHERE n.id IS NULL) AS removed, count(*) FILTER (WHERE o.box <> n.box) AS moved, count(*) FILTER (WHERE o.t <> 0 AND o.t <> n.t) AS resized FROM old o FULL JOIN new n ON o.id = n.id")
def snapshot_diff(t: Tables) -> DataFrame:
    old, new = snapshots(t)
    both = old.select("id", F.col("box").alias("ob"), F.col("t").alias("ot"), F.lit(1).alias("o")).join(new.select("id", F.col("box").alias("nb"), F.col("t").alias("nt"), F.lit(1).alias("n")), "id", "full")
    return both.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("ob") != F.col("nb")).alias("moved"), F.count_if((F.col("ot") != 0) & (F.col("ot") != F.col("nt"))).alias("resized"))


@query("j27_manifest_sets", sql=f"WITH {SNAPSHOTS} SELECT id, 'missing' AS fault FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, 'unexpected' FROM new WHERE id NOT IN (SELECT id FROM old)")
def manifest_sets(t: Tables) -> DataFrame:
    old, new = snapshots(t)
    lost = old.join(new, "id", "left_anti").select("id", F.lit("missing").alias("fault"))
    return lost.unionByName(new.join(old, "id", "left_anti").select("id", F.lit("unexpected").alias("fault")))


@query("d18_snapshot_checks", sql=f"WITH {CATALOGUE} SELECT 'duplicate id' AS fault, (count(*) - count(DISTINCT id))::BIGINT AS n FROM cat UNION ALL SELECT 'inverted box', count(*) FROM cat WHERE NOT (s < nn AND w < e) UNION ALL SELECT 'blank provider', count(*) FROM cat WHERE p IS NULL OR p = ''")
def snapshot_checks(t: Tables) -> DataFrame:
    c = catalogue(t).agg((F.count("*") - F.countDistinct("id")).alias("a"), F.count_if(~((F.col("s") < F.col("nn")) & (F.col("w") < F.col("e")))).alias("b"), F.count_if(F.col("p").isNull() | (F.col("p") == "")).alias("c"))
    return c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(v).alias("n")) for k, v in (("duplicate id", "a"), ("inverted box", "b"), ("blank provider", "c"))])).alias("f")).select("f.*")


@query("d21_example_faults", sql=f"WITH {SNAPSHOTS}, ex AS (SELECT n_nationkey AS example_id, (n_nationkey * 11 + 3)::BIGINT AS id FROM nation) SELECT example_id, id FROM ex WHERE id NOT IN (SELECT id FROM new)")
def example_faults(t: Tables) -> DataFrame:
    _, new = snapshots(t)
    ex = t("nation").select(F.col("n_nationkey").alias("example_id"), (F.col("n_nationkey") * 11 + 3).cast("long").alias("id"))
    return ex.join(new, "id", "left_anti").select("example_id", "id")


@query("d25_provenance", sql=f"WITH {FEEDS} SELECT tag, feed, trips, strftime(a, '%Y%m%d') AS first_day, strftime(b, '%Y%m%d') AS last_day FROM ord")
def provenance(t: Tables) -> DataFrame:
    return merge_order(t).select("tag", "feed", "trips", F.date_format("a", "yyyyMMdd").alias("first_day"), F.date_format("b", "yyyyMMdd").alias("last_day"))


@query("a59_provenance_list", sql=f"WITH {FEEDS} SELECT count(*) AS feeds, string_agg(tag || '=' || feed, ',' ORDER BY tag) AS tags FROM ord")
def provenance_list(t: Tables) -> DataFrame:
    return merge_order(t).agg(F.count("*").alias("feeds"), F.concat_ws(",", F.array_sort(F.collect_list(F.concat("tag", F.lit("="), "feed")))).alias("tags"))


@query("a54_count_stops", views=["stops"], sql="SELECT CASE WHEN count(*) FILTER (WHERE location_type = 1) > 0 THEN count(*) FILTER (WHERE location_type = 1) ELSE count(*) FILTER (WHERE location_type = 0) END AS places FROM stops")
def count_stops(t: Tables) -> DataFrame:
    """Stations if there are any, else stops."""
    c = t.stops.agg(F.count_if(F.col("location_type") == 1).alias("a"), F.count_if(F.col("location_type") == 0).alias("b"))
    return c.select(F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("places"))


@query("d17_measured_feeds", sql=f"WITH {SNAPSHOTS} SELECT n.id, coalesce(CASE WHEN n.id % 4 <> 0 THEN n.t END, o.t) AS t, CASE WHEN n.id % 4 <> 0 THEN 'measured' WHEN o.id IS NOT NULL THEN 'carried' ELSE 'unknown' END AS how FROM new n LEFT JOIN old o USING (id)")
def measured_feeds(t: Tables) -> DataFrame:
    old, new = snapshots(t)
    good = F.col("id") % 4 != 0
    both = new.join(old.select("id", F.col("t").alias("ot"), F.lit(1).alias("o")), "id", "left")
    return both.select("id", F.coalesce(F.when(good, F.col("t")), "ot").alias("t"), F.when(good, "measured").when(F.col("o").isNotNull(), "carried").otherwise("unknown").alias("how"))


@query("p17_table_page", sql="SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_mktsegment), 'auto') ORDER BY c_custkey LIMIT 50 OFFSET 25")
def table_page(t: Tables) -> DataFrame:
    """Rows 26 to 75 of a filtered table."""
    return t("customer").filter(F.lower("c_mktsegment").contains("auto")).orderBy("c_custkey").offset(25).limit(50).select("c_custkey", "c_name")


@query("i13_batches", sql="""
WITH RECURSIVE i AS (SELECT s_suppkey AS id, s_suppkey * 7 % 60 + 5 AS size, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier),
r(rn, id, n, held, batch) AS (SELECT rn, id, 1, size, 0 FROM i WHERE rn = 1 UNION ALL
  SELECT i.rn, i.id, CASE WHEN r.n >= 10 OR r.held + i.size > 250 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 10 OR r.held + i.size > 250 THEN i.size ELSE r.held + i.size END, CASE WHEN r.n >= 10 OR r.held + i.size > 250 THEN r.batch + 1 ELSE r.batch END FROM r JOIN i ON i.rn = r.rn + 1)
SELECT id, batch FROM r""")
def batches(t: Tables) -> DataFrame:
    """Greedy batches in id order, at most 10 items and 250 units each."""
    from ..operators import etl

    return etl.batches(t("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 60 + 5).alias("size")), 10, 250)
