"""Answers of zones to questions, their quality, and how anonymous they leave a zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import Tables
from ..catalog import query
from ..functions import geo
from ..operators import audit as A
from ..operators import spatial as S
from ..operators import survival as V
from ..stage import staged
from .spatial import DIST, SEEKERS, XY, seekers

Z = XY["zones"] + ", " + SEEKERS
N = "nz AS (SELECT count(*) AS n FROM zones)"
CLASS = "answers AS (SELECT zone_id, CASE WHEN right(zone_id, 2)::INT % 7 = 6 THEN NULL ELSE right(zone_id, 2)::INT % 7 END AS class_key FROM zones)"
VALUES = f"vals AS (SELECT a.zone_id, round(min({DIST})) AS value FROM zones_xy a, pois_xy b WHERE b.size = 7 GROUP BY 1)"


def _answers(t: Tables) -> DataFrame:
    k = F.right("zone_id", F.lit(2)).cast("int") % 7
    return t.zones.select("zone_id", F.when(k != 6, k).alias("class_key"))


def _zones(t: Tables) -> DataFrame:
    return S.projected(t.zones).select("zone_id", "x", "y")


def _values(t: Tables) -> DataFrame:
    """Whole metres to the nearest POI of size 7."""
    pois = S.projected(t.pois.filter("size = 7")).select("poi_id", "x", "y")
    out = S.nearest(_zones(t), pois, ["zone_id"], "poi_id", 400.0)
    return out.select("zone_id", F.round("dist").alias("value"))


@query("a28_blocks", views=["zones"], sql=f"WITH {CLASS} SELECT class_key, count(*) AS zones FROM answers GROUP BY 1")
def blocks(t: Tables) -> DataFrame:
    return V.blocks(_answers(t))


@query("a35_photo_survival", views=["zones"], sql=f"WITH {CLASS} SELECT zone_id, count(*) OVER (PARTITION BY class_key) AS agree FROM answers")
def photo(t: Tables) -> DataFrame:
    return V.photo(_answers(t))


@query("a30_matching_survival", views=["zones"], sql=f"""
WITH {Z}, {CLASS} SELECT a.zone_id, sum(CASE WHEN a.class_key IS NOT DISTINCT FROM s.class_key THEN same ELSE n - same END)::BIGINT AS agree
FROM answers a, (SELECT class_key, count(*) OVER (PARTITION BY class_key) AS same, count(*) OVER () AS n, zone_id FROM answers) s WHERE s.zone_id IN (SELECT seeker_id FROM seekers) GROUP BY 1""")
def matching(t: Tables) -> DataFrame:
    return V.matching(_answers(t), seekers(t))


@query("a31_measuring_survival", views=["zones", "pois"], sql=f"""
WITH {Z}, {XY['pois']}, {VALUES}, s AS (SELECT zone_id AS seeker_id, value AS sv FROM vals WHERE zone_id IN (SELECT seeker_id FROM seekers)),
c AS (SELECT seeker_id, sv, count(*) FILTER (WHERE value > sv) AS g, count(*) FILTER (WHERE value = sv) AS e, count(*) FILTER (WHERE value < sv) AS l FROM vals, s GROUP BY ALL)
SELECT zone_id, sum(CASE WHEN value > sv THEN g WHEN value = sv THEN e ELSE l END)::BIGINT AS agree FROM vals, c GROUP BY 1""")
def measuring(t: Tables) -> DataFrame:
    return V.measuring(_values(t), seekers(t))


@query("a32_radar_survival", views=["zones"], sql=f"""
WITH {Z}, d AS (SELECT a.zone_id, b.seeker_id, {DIST} <= 800 AS inn FROM zones_xy a, seekers b), k AS (SELECT seeker_id, count(*) FILTER (WHERE inn) AS k, count(*) AS n FROM d GROUP BY 1)
SELECT zone_id, sum(CASE WHEN inn THEN k ELSE n - k END)::BIGINT AS agree FROM d JOIN k USING (seeker_id) GROUP BY 1""")
def radar(t: Tables) -> DataFrame:
    return V.radar(_zones(t), seekers(t), 800.0)


BEARINGS = ", ".join(f"({i}, {u!r}::DOUBLE, {v!r}::DOUBLE)" for i, (u, v) in enumerate(V.BEARINGS))


@query("a33_thermometer_survival", views=["zones"], sql=f"""
WITH {Z}, b(i, ux, uy) AS (VALUES {BEARINGS}), p AS (SELECT seeker_id, i, ux, uy, x * ux + y * uy + 400.0::DOUBLE AS lim FROM seekers, b),
d AS (SELECT zone_id, seeker_id, i, z.x * ux + z.y * uy < lim AS hot FROM zones_xy z, p), k AS (SELECT seeker_id, i, count(*) FILTER (WHERE hot) AS k, count(*) AS n FROM d GROUP BY ALL)
SELECT zone_id, sum(CASE WHEN hot THEN k ELSE n - k END)::BIGINT AS agree FROM d JOIN k USING (seeker_id, i) GROUP BY 1""")
def thermometer(t: Tables) -> DataFrame:
    return V.thermometer(_zones(t), seekers(t), 800.0)


FEATURES = "features AS (SELECT poi_id AS feature_id, x, y FROM pois_xy WHERE category = 'PROMO')"


def features(t: Tables, category: str = "PROMO") -> DataFrame:
    """Every POI of a category."""
    rows = S.projected(t.pois.filter(F.col("category") == category))
    return rows.select(F.col("poi_id").alias("feature_id"), F.col("x").alias("fx"), F.col("y").alias("fy"))


@query("d6_tentacle_features", views=["pois"], sql=f"WITH {XY['pois']}, {FEATURES} SELECT feature_id, round(x * 100)::BIGINT AS x_cm, round(y * 100)::BIGINT AS y_cm FROM features")
def tentacle_features(t: Tables) -> DataFrame:
    return features(t).select("feature_id", F.round(F.col("fx") * 100).cast("long").alias("x_cm"), F.round(F.col("fy") * 100).cast("long").alias("y_cm"))


@query("a34_tentacle_survival", views=["zones", "pois"], sql=f"""
WITH {Z}, {XY['pois']}, {FEATURES},
d AS (SELECT a.zone_id, b.seeker_id, CASE WHEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 810000 THEN -1 ELSE coalesce((SELECT arg_min(feature_id, struct_pack(d := (f.x - a.x) * (f.x - a.x) + (f.y - a.y) * (f.y - a.y), i := feature_id)) FROM features f WHERE (f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y) <= 810000), -2) END AS k FROM zones_xy a, seekers b)
SELECT zone_id, sum(c)::BIGINT AS agree FROM (SELECT zone_id, count(*) OVER (PARTITION BY seeker_id, k) AS c FROM d) GROUP BY 1""")
def tentacle(t: Tables) -> DataFrame:
    return V.tentacle(_zones(t), seekers(t), features(t), 900.0)


@query("a29_question_quality", views=["zones"], sql="""
WITH a AS (SELECT 'mod' || m AS question, right(zone_id, 4)::INT % m AS k FROM zones, (VALUES (2), (3), (5), (7)) v(m)), g AS (SELECT question, k, count(*) AS c FROM a GROUP BY question, k),
s AS (SELECT question, c, sum(c) OVER (PARTITION BY question) AS n, count(*) OVER (PARTITION BY question) AS kinds FROM g)
SELECT question, round(least(1.0::DOUBLE, sum(-c::DOUBLE / n * log2(c::DOUBLE / n)) / log2(max(kinds)::DOUBLE)) * 1e9)::BIGINT AS quality_e9 FROM s GROUP BY question""")
def question_quality(t: Tables) -> DataFrame:
    each = t.zones.select(F.explode(F.array(*[F.struct(F.lit(f"mod{m}").alias("question"), (F.right("zone_id", F.lit(4)).cast("int") % m).alias("k")) for m in (2, 3, 5, 7)])).alias("a")).select("a.*")
    sizes = each.groupBy("question", "k").agg(F.count("*").alias("zones"))
    return V.entropy_quality(sizes.select("question", "zones")).select("question", F.round(F.col("quality") * 1e9).cast("long").alias("quality_e9"))


@query("a29_binary_quality", views=["zones"], sql=f"""
WITH {Z} SELECT b.seeker_id, round(least(avg(CASE WHEN {DIST} <= 800 THEN 1.0::DOUBLE ELSE 0 END), 1 - avg(CASE WHEN {DIST} <= 800 THEN 1.0::DOUBLE ELSE 0 END)) / 0.5 * 1e6)::BIGINT AS quality_e6 FROM zones_xy a, seekers b GROUP BY 1""")
def binary_quality(t: Tables) -> DataFrame:
    inside = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2) <= 800
    share = _zones(t).crossJoin(F.broadcast(seekers(t))).groupBy("seeker_id").agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("p"))  # a bounded sample
    return share.select("seeker_id", F.round(V.binary_quality(F.col("p")) * 1e6).cast("long").alias("quality_e6"))


@query("w5_rank_sums", views=["zones", "pois"], sql=f"""
WITH {XY['zones']}, {XY['pois']}, {VALUES} SELECT zone_id, (count(*) OVER (ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY value))::BIGINT AS closer, (count(*) OVER (PARTITION BY value))::BIGINT AS level FROM vals""")
def rank_sums(t: Tables) -> DataFrame:
    """Zones with a smaller and with the same value: sums over the distinct values, a short table."""
    v = _values(t)
    sizes = v.groupBy("value").agg(F.count("*").alias("level"))
    below = sizes.withColumn("closer", F.sum("level").over(W.orderBy("value")) - F.col("level"))
    return v.join(below, "value").select("zone_id", "closer", "level")


@query("j29_same_answer", views=["zones"], sql=f"WITH {Z}, {CLASS} SELECT a.zone_id, count(*) FILTER (WHERE a.class_key IS NOT DISTINCT FROM s.class_key) AS same FROM answers a, (SELECT * FROM answers WHERE zone_id IN (SELECT seeker_id FROM seekers)) s GROUP BY 1")
def same_answer(t: Tables) -> DataFrame:
    a = _answers(t)
    asked = a.join(seekers(t).select(F.col("seeker_id").alias("zone_id")), "zone_id").groupBy(F.col("class_key").alias("k")).agg(F.count("*").alias("same"))
    return a.join(asked, F.col("class_key").eqNullSafe(F.col("k")), "left").select("zone_id", F.coalesce("same", F.lit(0)).alias("same"))


@query("a37_joint_blocks", views=["zones"], sql=f"""
WITH {CLASS}, j AS (SELECT zone_id, class_key, right(zone_id, 3)::INT % 3 AS k2 FROM answers) SELECT zone_id, count(*) OVER (PARTITION BY class_key, k2) AS block FROM j""")
def joint_blocks(t: Tables) -> DataFrame:
    j = _answers(t).withColumn("k2", F.right("zone_id", F.lit(3)).cast("int") % 3)
    return j.select("zone_id", F.count("*").over(W.partitionBy("class_key", "k2")).alias("block"))


@query("i7_question_order", views=["zones"], sql="""
WITH l AS (SELECT zone_id, 'q' || m AS q, right(zone_id, 4)::INT % m AS v FROM zones, (VALUES (2), (3), (4), (5), (7)) t(m)),
s1 AS (SELECT q, sum(c * c)::BIGINT AS s FROM (SELECT q, v, count(*) AS c FROM l GROUP BY 1, 2) GROUP BY 1), p1 AS (SELECT * FROM s1 ORDER BY s, q LIMIT 1), c1 AS (SELECT zone_id, v AS k1 FROM l WHERE q = (SELECT q FROM p1)),
s2 AS (SELECT q, sum(c * c)::BIGINT AS s FROM (SELECT q, k1, v, count(*) AS c FROM l JOIN c1 USING (zone_id) WHERE q <> (SELECT q FROM p1) GROUP BY 1, 2, 3) GROUP BY 1), p2 AS (SELECT * FROM s2 ORDER BY s, q LIMIT 1), c2 AS (SELECT zone_id, k1, v AS k2 FROM l JOIN c1 USING (zone_id) WHERE q = (SELECT q FROM p2)),
s3 AS (SELECT q, sum(c * c)::BIGINT AS s FROM (SELECT q, k1, k2, v, count(*) AS c FROM l JOIN c2 USING (zone_id) WHERE q <> (SELECT q FROM p1) AND q <> (SELECT q FROM p2) GROUP BY 1, 2, 3, 4) GROUP BY 1), p3 AS (SELECT * FROM s3 ORDER BY s, q LIMIT 1)
SELECT place, q AS question, s AS block_sum, (SELECT count(*) FROM zones) AS zones FROM (SELECT 0 AS place, * FROM p1 UNION ALL SELECT 1, * FROM p2 UNION ALL SELECT 2, * FROM p3)""")
def question_order(t: Tables) -> DataFrame:
    """The next question is the one that leaves the smallest mean block (ties by cost, then id), three times."""
    long = t.zones.select("zone_id", *[(F.right("zone_id", F.lit(4)).cast("int") % m).alias(f"q{m}") for m in (2, 3, 4, 5, 7)])
    left, picked = [f"q{m}" for m in (2, 3, 4, 5, 7)], []
    n = long.count()
    rows = []
    for place in range(3):
        sizes = [long.groupBy(*picked, q).count().agg(F.sum(F.col("count") * F.col("count")).alias("s")).select(F.lit(q).alias("q"), "s") for q in left]
        every = sizes[0]
        for s in sizes[1:]:
            every = every.unionByName(s)
        best = every.orderBy("s", "q").first()
        picked.append(best.q)
        left.remove(best.q)
        rows.append((place, best.q, int(best.s), n))
    return t.spark.createDataFrame(rows, "place int, question string, block_sum long, zones long")


@query("d5_photo_answers", views=["zones", "pois"], sql=f"""
WITH {XY['zones']}, {XY['pois']}, h AS (SELECT a.zone_id, count(*) FILTER (WHERE b.category = 'PROMO' AND size < 10) AS trees, count(*) FILTER (WHERE b.category = 'SMALL' AND size < 10) AS water FROM zones_xy a JOIN pois_xy b ON {DIST} <= 250 GROUP BY 1)
SELECT z.zone_id, CASE WHEN h.zone_id IS NULL THEN NULL ELSE trees > 0 END AS tree, CASE WHEN h.zone_id IS NULL THEN NULL WHEN water > 1 THEN TRUE WHEN water = 0 THEN FALSE END AS shore FROM zones z LEFT JOIN h USING (zone_id)""")
def photo_answers(t: Tables) -> DataFrame:
    """Yes, no or unknown: nothing mapped near a zone answers nothing, one water feature isn't enough to tell."""
    own = [F.count_if(F.expr(f"category = '{k}' and size < 10")).alias(c) for k, c in (("PROMO", "trees"), ("SMALL", "water"))]
    out = S.gathered(_zones(t), S.projected(t.pois).select("category", "size", "x", "y"), 250.0, own, [F.sum(c).alias(c) for c in ("trees", "water")], how="left")
    return out.select("zone_id", F.when(F.col("trees").isNotNull(), F.col("trees") > 0).alias("tree"), F.when(F.col("water") > 1, True).when(F.col("water") == 0, False).alias("shore"))


#: The audited map: a border, its margin, the categories asked for (one has no features) and the lengths.
BORDER = (42.805, -85.892, 42.822, -85.868)
MARGIN_M, REACH_M, RADIUS_M = 804.672, 900.0, 402.336
CATEGORIES = ("ECONOMY", "LARGE", "NONE", "PROMO", "SMALL", "STANDARD")
RADARS, LEGS = (200.0, 800.0, 100_000.0), (400.0, 3600.0, 100_000.0)
#: Question categories of the game's size.
GAME_CATEGORIES = 6
CATS_SQL = "(VALUES " + ", ".join(f"('{c}')" for c in CATEGORIES) + ") c(category)"
AUDIT_VIEWS = ("zones", "pois", "stops")
_S, _W, _N, _E = BORDER
_UP = f"{MARGIN_M} / {geo.DEGREE_M!r}"
AUDIT = f"""{Z}, {XY['pois']}, nz AS (SELECT count(*) AS n, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) AS diameter FROM zones_xy),
inb AS (SELECT * FROM pois_xy WHERE lat BETWEEN {_S} AND {_N} AND lon BETWEEN {_W} AND {_E}),
cnt AS (SELECT category, (SELECT count(*) FROM inb i WHERE i.category = c.category) AS instances, (SELECT count(*) FROM pois p WHERE p.category = c.category AND lat BETWEEN {_S} - {_UP} AND {_N} + {_UP} AND lon BETWEEN {_W} - {_UP} / cos(radians({_N}::DOUBLE)) AND {_E} + {_UP} / cos(radians({_N}::DOUBLE))) AS margin FROM {CATS_SQL}),
np AS (SELECT zone_id, category, poi_id, d FROM (SELECT a.zone_id, b.category, b.poi_id, {DIST} AS d, row_number() OVER (PARTITION BY a.zone_id, b.category ORDER BY {DIST}, b.poi_id) AS k FROM zones_xy a, inb b) WHERE k = 1),
ans AS (SELECT 'match_' || category AS question, zone_id, poi_id::VARCHAR AS class_key FROM np UNION ALL SELECT 'name_length', 'z' || substr(stop_id, 2), length(stop_name)::VARCHAR FROM stops),
bl AS (SELECT question, class_key, count(*) AS block FROM ans GROUP BY 1, 2),
pm AS (SELECT question, avg(block) / any_value(n) AS p FROM ans JOIN bl USING (question, class_key), nz WHERE zone_id IN (SELECT seeker_id FROM seekers) GROUP BY 1),
mq AS (SELECT question, least(p, 1 - p) / 0.5 AS quality, classes FROM pm JOIN (SELECT question, count(*) AS classes FROM bl GROUP BY 1) USING (question)),
vv AS (SELECT 'measure_' || category AS question, zone_id, round(d) AS value FROM np),
vc AS (SELECT question, s.zone_id, count(*) FILTER (WHERE v.value > s.value)::DOUBLE AS g, count(*) FILTER (WHERE v.value = s.value)::DOUBLE AS e, count(*) FILTER (WHERE v.value < s.value)::DOUBLE AS l FROM vv v JOIN vv s USING (question) WHERE s.zone_id IN (SELECT seeker_id FROM seekers) GROUP BY 1, 2),
vq AS (SELECT question, least(1, greatest(0, (1 - sum(g * g + e * e + l * l) / (count(*) * any_value(n)::DOUBLE * any_value(n))) / 0.5)) AS quality FROM vc, nz GROUP BY 1),
rq AS (SELECT r, avg(CASE WHEN {DIST} <= r THEN 1.0::DOUBLE ELSE 0 END) AS p FROM zones_xy a, seekers b, (VALUES ({'), ('.join(f'{r}::DOUBLE' for r in RADARS)})) v(r) GROUP BY 1),
tq AS (SELECT leg, avg(CASE WHEN a.x * ux + a.y * uy < b.x * ux + b.y * uy + leg / 2 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM zones_xy a, seekers b, (VALUES {BEARINGS}) w(i, ux, uy), (VALUES ({'), ('.join(f'{r}::DOUBLE' for r in LEGS)})) v(leg) GROUP BY 1),
ph AS (SELECT a.zone_id, count(*) FILTER (WHERE b.category = 'PROMO' AND size < 10) AS trees, count(*) FILTER (WHERE b.category = 'SMALL' AND size < 10) AS water FROM zones_xy a JOIN pois_xy b ON {DIST} <= 250 GROUP BY 1),
pa AS (SELECT 'photo_tree' AS question, trees > 0 AS yes FROM ph UNION ALL SELECT 'photo_shore', CASE WHEN water > 1 THEN TRUE WHEN water = 0 THEN FALSE END FROM ph),
pq AS (SELECT question, count(yes) AS evaluated, avg(yes::INT) AS coverage FROM pa GROUP BY 1),
arms AS (SELECT category, quantile_disc(k, 0.5) AS median_arms FROM (SELECT zone_id, category, (SELECT count(*) FROM inb b WHERE b.category = c.category AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {REACH_M * REACH_M}) AS k FROM zones_xy a, {CATS_SQL}) GROUP BY 1),
verdicts AS (
  SELECT 'match_' || category AS question_id, 'matching' AS category, instances, CASE WHEN instances = 0 THEN 'dead' WHEN instances = 1 THEN 'degenerate' WHEN quality < 0.12 THEN 'weak' ELSE 'functional' END AS status, CASE WHEN instances > 1 THEN quality ELSE 0 END AS quality, (instances = 0 AND margin >= 1) OR (instances = 1 AND margin >= 2) AS borderline FROM cnt LEFT JOIN mq ON question = 'match_' || category
  UNION ALL SELECT 'measure_' || category, 'measuring', instances, CASE WHEN instances = 0 THEN 'dead' WHEN quality < 0.30 THEN 'weak' ELSE 'functional' END, CASE WHEN instances > 0 THEN quality ELSE 0 END, instances = 0 AND margin >= 1 FROM cnt LEFT JOIN vq ON question = 'measure_' || category
  UNION ALL SELECT 'tentacle_' || category, 'tentacle', instances, CASE WHEN instances = 0 THEN 'dead' WHEN instances = 1 THEN 'degenerate' WHEN median_arms >= 2 THEN 'functional' ELSE 'weak' END, 0, (instances = 0 AND margin >= 1) OR (instances = 1 AND margin >= 2) FROM cnt JOIN arms USING (category)
  UNION ALL SELECT 'name_length', 'matching', classes, CASE WHEN classes < 2 THEN 'degenerate' WHEN quality < 0.12 THEN 'weak' ELSE 'functional' END, CASE WHEN classes < 2 THEN 0 ELSE quality END, false FROM mq WHERE question = 'name_length'
  UNION ALL SELECT 'radar_' || r::BIGINT, 'radar', NULL, CASE WHEN diameter > 0 AND r >= diameter THEN 'degenerate' WHEN r < {RADIUS_M} THEN 'weak' WHEN least(p, 1 - p) / 0.5 < 0.25 THEN 'weak' ELSE 'functional' END, least(p, 1 - p) / 0.5, false FROM rq, nz
  UNION ALL SELECT 'thermometer_' || leg::BIGINT, 'thermometer', NULL, CASE WHEN diameter > 0 AND leg > diameter THEN 'dead' WHEN diameter > 0 AND leg > 0.7 * diameter THEN 'degenerate' WHEN least(p, 1 - p) / 0.5 < 0.20 THEN 'weak' ELSE 'functional' END, least(p, 1 - p) / 0.5, false FROM tq, nz
  UNION ALL SELECT question, 'photo', NULL, CASE WHEN evaluated = 0 THEN 'unknown' WHEN coverage <= 0 THEN 'dead' WHEN coverage >= 1 THEN 'degenerate' WHEN coverage < 0.15 OR coverage > 0.85 THEN 'weak' ELSE 'functional' END, least(coverage, 1 - coverage) / 0.5, false FROM pq)"""
STATS = f"""st0 AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE status = 'functional') AS f, count(*) FILTER (WHERE status IN ('dead', 'degenerate')) AS d, count(*) FILTER (WHERE status = 'weak') AS w, sum(quality) FILTER (WHERE status = 'functional') AS q FROM verdicts WHERE status <> 'unknown' GROUP BY 1),
qs AS (SELECT sum(n)::BIGINT AS total, (sum(f) + 0.5::DOUBLE * sum(w)) / sum(n) AS live_share, count(*) FILTER (WHERE f >= 2) / {GAME_CATEGORIES}.0::DOUBLE AS category_depth, count(*) FILTER (WHERE f >= 1) AS live_categories, sum(q) / sum(f) AS mean_quality, sum(d)::DOUBLE / sum(n) AS randomize_risk FROM st0)"""


def question_facts(t: Tables, asked: DataFrame | None) -> DataFrame:
    """What the audit knows of each question on the map: a row a question, from the features inside the border; ``asked`` are the seekers, or every zone where there are none."""
    zones = _zones(t)
    inside = geo.in_box(F.col("lat"), F.col("lon"), *map(F.lit, BORDER))
    up = F.lit(MARGIN_M / geo.DEGREE_M)
    s, w, n, e = map(F.lit, BORDER)
    wide = up / F.cos(F.radians(n))
    around = geo.in_box(F.col("lat"), F.col("lon"), s - up, w - wide, n + up, e + wide)
    kinds = t.spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = t.pois.groupBy("category").agg(F.count_if(inside).alias("instances"), F.count_if(around).alias("margin"))
    counts = staged(kinds.join(counts, "category", "left").select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("instances", "margin")]), "counts")[0]
    pois, _ = staged(S.projected(t.pois.filter(inside)).select("poi_id", "category", "x", "y").join(F.broadcast(kinds), "category", "left_semi"), "inside")
    there = pois.select("category").distinct()
    near, _ = staged(S.nearest(zones.crossJoin(F.broadcast(there)), pois, ["zone_id", "category"], "poi_id", 400.0, on=["category"]), "nearest")  # a short dimension
    lengths = t.stops.select(F.lit("name_length").alias("question"), F.concat(F.lit("z"), F.substr("stop_id", F.lit(2))).alias("zone_id"), F.char_length("stop_name").cast("string").alias("class_key"))
    answers = near.select(F.concat(F.lit("match_"), "category").alias("question"), "zone_id", F.col("poi_id").cast("string").alias("class_key")).unionByName(lengths)
    match = A.matching_quality(answers, asked)
    measure = A.measuring_quality(near.select(F.concat(F.lit("measure_"), "category").alias("question"), "zone_id", F.round("dist").alias("value")), asked)
    every = zones.crossJoin(F.broadcast(kinds))  # a short dimension
    every = S.counted(every, pois, REACH_M, on=["category"], how="left").withColumnRenamed("n", "k")
    arms = every.groupBy("category").agg(F.expr("percentile_disc(0.5) within group (order by coalesce(k, 0))").cast("long").alias("median_arms"))
    row = lambda q, c, k, **more: [F.concat(F.lit(q), "category").alias("question_id"), F.lit(c).alias("cat"), F.lit(k).alias("kind"), F.lit(True).alias("queried"), "instances", "margin", *[v.alias(n) for n, v in more.items()]]
    parts = [
        counts.select(*row("match_", "matching", "nearest")).join(match.withColumnRenamed("question", "question_id"), "question_id", "left"),
        counts.select(*row("measure_", "measuring", "distance")).join(measure.withColumnRenamed("question", "question_id"), "question_id", "left"),
        counts.join(arms, "category").select(*row("tentacle_", "tentacle", "tentacle", median_arms=F.col("median_arms"))),
        match.filter("question = 'name_length'").select(F.col("question").alias("question_id"), F.lit("matching").alias("cat"), F.lit("name_length").alias("kind"), F.col("classes").alias("instances"), "classes", "quality"),
    ]
    spots, _ = staged(zones.groupBy("x", "y").agg(F.count("*").alias("n")), "spots")
    if asked is None:
        ask = spots.select(F.col("n").alias("m"), F.col("x").alias("sx"), F.col("y").alias("sy"))
        both = spots.crossJoin(ask).withColumn("n", F.col("n") * F.col("m"))  # places, not zones
    else:
        both = spots.crossJoin(F.broadcast(asked))  # at most V.FULL seekers
    both, _ = staged(both, "pairs")
    d = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    hot = lambda u, v, leg: F.col("x") * F.lit(u) + F.col("y") * F.lit(v) < F.col("sx") * F.lit(u) + F.col("sy") * F.lit(v) + F.lit(leg / 2)
    mean = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0)) / F.sum("n")
    shares = both.agg(*[mean(d <= r).alias(f"r{i}") for i, r in enumerate(RADARS)], *[(sum((mean(hot(u, v, leg)) for u, v in V.BEARINGS), F.lit(0.0)) / len(V.BEARINGS)).alias(f"t{i}") for i, leg in enumerate(LEGS)])
    size = zones.agg(F.sqrt((F.max("x") - F.min("x")) ** 2 + (F.max("y") - F.min("y")) ** 2).alias("diameter_m"))
    lines = [F.struct(F.lit(f"{kind}_{int(m)}").alias("question_id"), F.lit(kind).alias("cat"), F.lit(kind).alias("kind"), F.lit(m).alias("length_m"), V.binary_quality(F.col(f"{kind[0]}{i}")).alias("quality")) for kind, own in (("radar", RADARS), ("thermometer", LEGS)) for i, m in enumerate(own)]
    parts.append(shares.crossJoin(size).select("diameter_m", F.lit(RADIUS_M).alias("zone_radius_m"), F.explode(F.array(*lines)).alias("l")).select("l.*", "diameter_m", "zone_radius_m"))  # one row each
    photos = photo_answers(t).select(F.explode(F.array(F.struct(F.lit("photo_tree").alias("question_id"), F.col("tree").alias("yes")), F.struct(F.lit("photo_shore").alias("question_id"), F.col("shore").alias("yes")))).alias("p")).select("p.*")
    share = F.avg(F.col("yes").cast("int"))
    parts.append(photos.groupBy("question_id").agg(F.count("yes").alias("evaluated"), share.alias("coverage")).select("question_id", F.lit("photo").alias("cat"), F.lit("photo").alias("kind"), "evaluated", "coverage", V.binary_quality(F.col("coverage")).alias("quality")))
    whole = t.spark.createDataFrame([], A.FACTS.replace("category string", "cat string"))
    for part in parts:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.withColumnRenamed("cat", "category")


def questions(t: Tables) -> DataFrame:
    """The audit over the stated sample of seekers."""
    return A.judged(question_facts(t, staged(seekers(t), "seekers")[0]))


def questions_of_all(t: Tables) -> DataFrame:
    """The audit with every zone asking: what the rating reads."""
    return A.judged(question_facts(t, None))


@query("d8_question_audit", views=AUDIT_VIEWS, sql=f"WITH {AUDIT} SELECT question_id, category, instances, status, borderline, round(quality * 1e6)::BIGINT AS quality_e6 FROM verdicts")
def question_audit(t: Tables) -> DataFrame:
    q = questions(t)
    shown = F.when(F.col("kind") == "tentacle", F.lit(0.0)).otherwise(F.col("quality"))
    return q.select("question_id", "category", "instances", "status", "borderline", F.round(shown * 1e6).cast("long").alias("quality_e6"))


@query("a38_category_health", views=AUDIT_VIEWS, sql=f"WITH {AUDIT} SELECT category, count(*) AS n, count(*) FILTER (WHERE status = 'functional') AS functional, count(*) FILTER (WHERE status IN ('dead', 'degenerate')) AS wasted FROM verdicts GROUP BY 1")
def category_health(t: Tables) -> DataFrame:
    return questions(t).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.expr("status = 'functional'")).alias("functional"), F.count_if(F.expr("status in ('dead', 'degenerate')")).alias("wasted"))


@query("a39_question_stats", views=AUDIT_VIEWS, sql=f"WITH {AUDIT}, {STATS} SELECT total, round(live_share * 1e6)::BIGINT AS live_e6, round(category_depth * 1e6)::BIGINT AS depth_e6, live_categories AS live, round(mean_quality * 1e6)::BIGINT AS quality_e6, round(randomize_risk * 1e6)::BIGINT AS risk_e6 FROM qs")
def question_stats(t: Tables) -> DataFrame:
    """How much of the catalogue works on the map; mean quality is that of the functional questions."""
    q = questions(t).withColumn("quality", F.when(F.col("kind") == "tentacle", F.lit(0.0)).otherwise(F.col("quality")))
    e6 = lambda c, name: F.round(F.col(c) * 1e6).cast("long").alias(name)
    return A.stats(q, GAME_CATEGORIES).select("total", e6("live_share", "live_e6"), e6("category_depth", "depth_e6"), F.col("live_categories").alias("live"), e6("mean_quality", "quality_e6"), e6("randomize_risk", "risk_e6"))


@query("p16_question_catalogue", sql="SELECT n_nationkey AS question_id, size FROM nation, (VALUES ('small', 3), ('medium', 2), ('large', 1)) v(size, m) WHERE n_nationkey % m = 0")
def question_catalogue(t: Tables) -> DataFrame:
    sizes = F.array_compact(F.array(*[F.when(F.col("n_nationkey") % m == 0, s) for s, m in (("small", 3), ("medium", 2), ("large", 1))]))
    return t("nation").select(F.col("n_nationkey").alias("question_id"), F.explode(sizes).alias("size"))


@query("d7_concrete_answers", views=["zones"], sql=f"""
WITH {Z} SELECT a.zone_id, b.seeker_id, CASE WHEN {DIST} <= 800 THEN 'yes' ELSE 'no' END AS radar, CASE WHEN abs(a.y - b.y) < 1 THEN 'level' WHEN a.y > b.y THEN 'north' ELSE 'south' END AS side FROM zones_xy a, seekers b""")
def concrete_answers(t: Tables) -> DataFrame:
    d = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    both = _zones(t).crossJoin(F.broadcast(seekers(t)))  # a bounded sample
    return both.select("zone_id", "seeker_id", F.when(d <= 800, "yes").otherwise("no").alias("radar"), F.when(F.abs(F.col("y") - F.col("sy")) < 1, "level").when(F.col("y") > F.col("sy"), "north").otherwise("south").alias("side"))


@query("a58_split_groups", views=["zones"], sql=f"""
WITH {Z}, d AS (SELECT b.seeker_id, CASE WHEN abs({DIST} - 800) <= 50 THEN 'edge' WHEN {DIST} < 800 THEN 'yes' ELSE 'no' END AS side FROM zones_xy a, seekers b), c AS (SELECT seeker_id, count(*) FILTER (WHERE side = 'yes') AS yes, count(*) FILTER (WHERE side = 'no') AS no, count(*) FILTER (WHERE side = 'edge') AS edge FROM d GROUP BY 1)
SELECT *, CASE WHEN yes > no THEN 'yes' WHEN no > yes THEN 'no' ELSE 'even' END AS majority FROM c""")
def split_groups(t: Tables) -> DataFrame:
    d = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    side = F.when(F.abs(d - 800) <= 50, "edge").when(d < 800, "yes").otherwise("no")
    both = _zones(t).crossJoin(F.broadcast(seekers(t))).withColumn("side", side)  # a bounded sample
    c = both.groupBy("seeker_id").agg(*[F.count_if(F.col("side") == k).alias(k) for k in ("yes", "no", "edge")])
    return c.withColumn("majority", F.when(F.col("yes") > F.col("no"), "yes").when(F.col("no") > F.col("yes"), "no").otherwise("even"))


@query("d10_curse_audit", views=["pois"], sql="""
WITH c AS (SELECT brand, count(*) FILTER (WHERE category = 'PROMO') AS promo, count(*) FILTER (WHERE category = 'SMALL') AS small, count(*) AS n FROM pois GROUP BY 1)
SELECT brand, CASE WHEN promo = 0 THEN 'dead' WHEN promo * 10 < n THEN 'warn' ELSE 'keep' END AS verdict, CASE WHEN small > promo THEN 2 WHEN small = promo THEN 3 ELSE 1 END AS tier FROM c""")
def curse_audit(t: Tables) -> DataFrame:
    c = t.pois.groupBy("brand").agg(F.count_if(F.expr("category = 'PROMO'")).alias("promo"), F.count_if(F.expr("category = 'SMALL'")).alias("small"), F.count("*").alias("n"))
    return c.select("brand", F.when(F.col("promo") == 0, "dead").when(F.col("promo") * 10 < F.col("n"), "warn").otherwise("keep").alias("verdict"), F.when(F.col("small") > F.col("promo"), 2).when(F.col("small") == F.col("promo"), 3).otherwise(1).alias("tier"))
