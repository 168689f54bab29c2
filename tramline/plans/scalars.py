"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..catalog import query
from ..functions import numeric, text


@query("fn_base_name", sql="SELECT s_suppkey, trim(regexp_replace(n, '\\s*\\((NB|SB|EB|WB)\\)$', '')) AS base FROM (SELECT s_suppkey, s_name || CASE s_suppkey % 3 WHEN 0 THEN ' (NB)' WHEN 1 THEN '(WB) ' ELSE ' (XB)' END AS n FROM supplier)")
def base_names(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    name = F.concat("s_name", F.when(k == 0, " (NB)").when(k == 1, "(WB) ").otherwise(" (XB)"))
    return t("supplier").select("s_suppkey", text.base_name(name).alias("base"))


@query("fn_clock", views=["stop_times"], sql="""
WITH c AS (SELECT trip_id, seq, dep_s * 5 AS s FROM stop_times WHERE dep_s IS NOT NULL), x AS (SELECT *, (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') AS hhmm FROM c)
SELECT trip_id, seq, s, hhmm, hhmm || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS hhmmss FROM x""")
def clock(t: Tables) -> DataFrame:
    """Clock texts of seconds, some beyond a hundred hours, and back."""
    s = F.col("dep_s") * 5
    rows = t.stop_times.filter("dep_s is not null").select("trip_id", "seq", text.hhmm(s).alias("hhmm"), text.hhmmss(s).alias("hhmmss"))
    return rows.select("trip_id", "seq", text.seconds(F.col("hhmmss")).alias("s"), "hhmm", "hhmmss")


@query("fn_dates", sql="SELECT DISTINCT o_orderdate::DATE AS date, (isodow(o_orderdate) - 1)::INT AS dow, strftime(o_orderdate, '%Y%m%d') AS ymd, strftime(o_orderdate, '%a %-d %b %Y') AS pretty, (DATE '1998-12-31' - o_orderdate::DATE + 1)::INT AS left_days, (o_orderdate::DATE - (isodow(o_orderdate) - 1)::INT)::DATE AS monday, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day_count FROM orders")
def dates(t: Tables) -> DataFrame:
    d = t("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    back = text.date8(F.date_format("date", "yyyyMMdd"))
    return d.select("date", F.weekday("date").alias("dow"), F.date_format(back, "yyyyMMdd").alias("ymd"), text.pretty_date(back).alias("pretty"), text.day_count(F.date_format("date", "yyyyMMdd"), F.lit("19981231")).alias("left_days"), text.window_monday(F.date_format("date", "yyyy-MM-dd"), "19920101").alias("monday"), F.datediff("date", F.lit("1992-01-01").cast("date")).cast("long").alias("day_count"))


@query("fn_try_numbers", sql="""
WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN p_size || '.5' WHEN 2 THEN 'n/a' WHEN 3 THEN '-' || p_size ELSE p_size || 'e1' END AS v FROM part)
SELECT p_partkey, coalesce(CASE WHEN regexp_full_match(trim(v), '[+-]?\\d+') THEN trim(v)::BIGINT END, 0) AS i, round(CASE WHEN regexp_full_match(trim(v), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN trim(v)::DOUBLE END * 10)::BIGINT AS f10 FROM x""")
def try_numbers(t: Tables) -> DataFrame:
    k, z = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    v = F.when(k == 0, F.concat(F.lit(" "), z, F.lit(" "))).when(k == 1, F.concat(z, F.lit(".5"))).when(k == 2, "n/a").when(k == 3, F.concat(F.lit("-"), z)).otherwise(F.concat(z, F.lit("e1")))
    return t("part").select("p_partkey", v.alias("v")).select("p_partkey", numeric.try_int(F.col("v")).alias("i"), F.round(numeric.try_float(F.col("v")) * 10).cast("long").alias("f10"))


@query("fn_intervals", sql="""
WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '0:' || lpad((p_size % 60)::VARCHAR, 2, '0') WHEN 2 THEN '1:05:' || lpad((p_size % 60)::VARCHAR, 2, '0') ELSE 'often' END AS v FROM part),
s AS (SELECT p_partkey, CASE WHEN regexp_full_match(v, '\\d+') THEN v::INT * 60 WHEN regexp_full_match(v, '\\d+:\\d{2}') THEN split_part(v, ':', 1)::INT * 3600 + split_part(v, ':', 2)::INT * 60 WHEN regexp_full_match(v, '\\d+:\\d{2}:\\d{2}') THEN split_part(v, ':', 1)::INT * 3600 + split_part(v, ':', 2)::INT * 60 + split_part(v, ':', 3)::INT END AS s FROM x)
SELECT p_partkey, CASE WHEN s BETWEEN 120 AND 7200 THEN s END AS interval_s FROM s""")
def intervals(t: Tables) -> DataFrame:
    k, z = F.col("p_partkey") % 4, F.col("p_size")
    two = F.lpad((z % 60).cast("string"), 2, "0")
    v = F.when(k == 0, z.cast("string")).when(k == 1, F.concat(F.lit("0:"), two)).when(k == 2, F.concat(F.lit("1:05:"), two)).otherwise("often")
    return t("part").select("p_partkey", v.alias("v")).select("p_partkey", text.interval_s(F.col("v")).alias("interval_s"))


COLOURS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.CSS_COLOURS.items())


@query("fn_colours", sql=f"""
WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '#' || substr(md5(p_partkey::VARCHAR), 1, 6) WHEN 1 THEN substr(md5(p_partkey::VARCHAR), 1, 3) WHEN 2 THEN '#' || substr(md5(p_partkey::VARCHAR), 1, 3) WHEN 3 THEN 'Teal' ELSE 'reddish' END AS v FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(v, '#?[0-9a-fA-F]{{6}}') THEN upper(ltrim(v, '#')) WHEN regexp_full_match(v, '#[0-9a-fA-F]{{3}}') THEN regexp_replace(upper(ltrim(v, '#')), '(.)', '\\1\\1', 'g') ELSE CASE lower(v) {COLOURS_SQL} END END AS colour FROM x""")
def colours(t: Tables) -> DataFrame:
    h = F.md5(F.col("p_partkey").cast("string"))
    k = F.col("p_partkey") % 5
    v = F.when(k == 0, F.concat(F.lit("#"), F.substring(h, 1, 6))).when(k == 1, F.substring(h, 1, 3)).when(k == 2, F.concat(F.lit("#"), F.substring(h, 1, 3))).when(k == 3, "Teal").otherwise("reddish")
    return t("part").select("p_partkey", v.alias("v")).select("p_partkey", text.colour(F.col("v")).alias("colour"))


@query("fn_place_keys", sql="SELECT c_custkey, lower(strip_accents(n)) AS key, n AS composed FROM (SELECT c_custkey, c_name || ' Café' AS n FROM customer)")
def place_keys(t: Tables) -> DataFrame:
    """Names with a letter and a mark of its own, loose blanks around them: the key without marks, and the composed name."""
    name = F.concat(F.lit("  "), "c_name", F.lit("   Cafe\u0301 "))
    return t("customer").select("c_custkey", text.place_key(name).alias("key"), text.composed_name(name).alias("composed"))


@query("fn_stable_hash")
def stable_hashes(t: Tables) -> DataFrame:
    """Two 32-bit lanes over UTF-16 units; the tests hold it against a plain loop."""
    return t("documents").select("doc_id", text.stable_hash(F.col("text")).alias("hash"))


@query("fn_rounding", sql="SELECT p_partkey, round((p_retailprice * 3)::VARCHAR::DECIMAL(38, 17), 1)::DOUBLE AS away, round_even(p_retailprice * 3, 0)::BIGINT AS even, floor(p_partkey / 7.0::DOUBLE)::BIGINT AS down, ((p_partkey - 1000) % 7 + 7) % 7 AS modulo FROM part")
def rounding(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").select("p_partkey", numeric.half_up(F.col("p_retailprice") * 3, 1).alias("away"), F.bround(F.col("p_retailprice") * 3).cast("long").alias("even"), F.floor(k / 7.0).alias("down"), F.pmod(k - 1000, F.lit(7)).alias("modulo"))


@query("fn_modal", sql="SELECT l_suppkey, l_linestatus FROM (SELECT l_suppkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linestatus) = 1")
def modal(t: Tables) -> DataFrame:
    """The most frequent value, ties to the smaller."""
    c = t("lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"))
    return c.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("n")).alias("o"), "l_linestatus")).alias("m")).select("l_suppkey", "m.l_linestatus")


@query("fn_digests", sql="SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def digests(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


@query("fn_name_lengths", sql="SELECT doc_id, length(text)::BIGINT AS n, upper(substr(text, 1, 1)) || substr(text, 2, 20) AS cap FROM documents")
def name_lengths(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.char_length("text").cast("long").alias("n"), F.concat(text.capital(F.substring("text", 1, 1)), F.substring("text", 2, 20)).alias("cap"))


@query("fn_formats", sql="""
WITH x AS (SELECT c_custkey AS k, round((c_acctbal)::VARCHAR::DECIMAL(38, 17), 1)::DECIMAL(38, 1) AS d, c_acctbal AS v FROM customer)
SELECT k AS c_custkey, CASE WHEN v < 0 THEN '-' ELSE '' END || format('{:,}', abs(trunc(d))::BIGINT) || '.' || (abs(d) % 1 * 10)::INT AS number, printf('%.1f%%', k % 1000 / 10.0::DOUBLE) AS pct, (k % 7200 // 60) || ' min' AS mins, printf('%.1f km', k * 100 / 1000.0::DOUBLE) AS km,
  CASE k % 3 WHEN 0 THEN 'outbound' WHEN 1 THEN 'inbound' ELSE 'direction 2' END AS way, CASE k % 3 WHEN 0 THEN 'hub-and-spoke' WHEN 1 THEN 'multi-centred' ELSE 'grid like' END AS shape,
  CASE k % 3 WHEN 0 THEN 'libraries' WHEN 1 THEN 'dog park' ELSE 'dog parks' END AS noun, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A and B' ELSE 'A, B and C' END AS words,
  CASE k % 2 WHEN 0 THEN 'Yes.' ELSE 'No. Why' END AS told, (k % 50) || '.50 USD' AS fare FROM x""")
def formats(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    three = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    words = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit(1), (k % 3 + 1).cast("int"))
    return t("customer").select(
        "c_custkey",
        text.number(F.col("c_acctbal"), 1).alias("number"),
        text.percent((k % 1000) / 1000.0).alias("pct"),
        text.minutes(F.floor(k % 7200 / 60)).alias("mins"),
        text.kilometres(k * 100.0, comma=False).alias("km"),
        text.direction_word(k % 3).alias("way"),
        text.shape_word(three("radial-hub", "polycentric", "grid-like")).alias("shape"),
        text.noun(three("library", "dog_park", "dog_park"), three("Library", "Dog park", "Dog park"), three(3, 1, 0)).alias("noun"),
        text.joined_words(words).alias("words"),
        text.explain_text(F.when(k % 2 == 0, "Yes.").otherwise("No"), F.when(k % 2 == 1, "Why")).alias("told"),
        text.fare(F.concat((k % 50).cast("string"), F.lit(".5")), F.lit(" usd ")).alias("fare"),
    )


@query("fn_bisect", views=["departures"], sql="SELECT stop_id, count(*) FILTER (WHERE dep_s < 43200) AS before, count(*) FILTER (WHERE dep_s <= 43200) AS upto, sum(dep_s)::DOUBLE AS total FROM departures GROUP BY 1")
def bisected(t: Tables) -> DataFrame:
    """Places in a stop's sorted departures, and their sum in order."""
    d = t.departures.groupBy("stop_id").agg(F.array_sort(F.collect_list("dep_s")).alias("times"))  # a day's departures of a stop
    return d.select("stop_id", numeric.bisect_left(F.col("times"), F.lit(43200)).cast("long").alias("before"), numeric.bisect_right(F.col("times"), F.lit(43200)).cast("long").alias("upto"), numeric.sum_sorted(F.transform("times", lambda x: x.cast("double"))).alias("total"))


@query("fn_class_keys", sql="""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'null' ELSE 'n:' || p_size END AS n, CASE WHEN p_size > 25 THEN 'b:1' ELSE 'b:0' END AS b, 's:"' || p_type || '"' AS s, 'a:[s:"' || p_type || '",s:"' || p_brand || '"]' AS a FROM part""")
def class_keys(t: Tables) -> DataFrame:
    z = F.col("p_size")
    return t("part").select("p_partkey", text.class_key(F.when(z % 5 != 0, z), "number").alias("n"), text.class_key(z > 25, "boolean").alias("b"), text.class_key(F.col("p_type"), "text").alias("s"), text.class_key(F.array("p_type", "p_brand"), "texts").alias("a"))


@query("fn_guards", sql="""SELECT p_partkey, p_partkey % 3 = 0 AS web, CASE p_partkey % 4 WHEN 0 THEN 'way' WHEN 1 THEN 'node' END AS kind, CASE WHEN p_partkey % 4 < 2 THEN p_partkey END AS id FROM part""")
def guards(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    own = text.osm_identity(F.when(k % 4 == 0, "way").when(k % 4 == 2, "area"), F.when(k % 4 == 1, F.concat(F.lit("n"), k)).when(k % 4 != 3, k.cast("string")).otherwise(F.concat(F.lit("x"), k)))
    url = F.concat(F.when(k % 3 == 0, "https").otherwise("ftp"), F.lit("://x"))
    return t("part").select("p_partkey", text.is_http_url(url).alias("web"), own["kind"].alias("kind"), own["id"].alias("id"))


@query("t2_natural_order", sql="""
WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Stop ' ELSE 'stop ' END || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN 'b2' ELSE 'a' END AS name FROM customer)
SELECT c_custkey, name FROM n ORDER BY c_custkey, lower(name) LIMIT 100""")
def natural_order(t: Tables) -> DataFrame:
    """Digits compare as numbers, letters without case; the first hundred names."""
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 2 == 0, "Stop ").otherwise("stop "), k, F.when(k % 3 == 0, "b2").otherwise("a"))
    return t("customer").select("c_custkey", name.alias("name")).orderBy(text.natural_key(F.col("name"))).limit(100)


@query("t1_tuple_order", sql="SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_nationkey, c_custkey) AS place FROM customer QUALIFY place <= 100")
def tuple_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    top = t("customer").orderBy(F.desc("c_mktsegment"), "c_nationkey", "c_custkey").limit(100)
    return top.select("c_custkey", F.row_number().over(W.orderBy(F.desc("c_mktsegment"), "c_nationkey", "c_custkey")).cast("long").alias("place"))
