"""Scores from tables of rules: metrics by ramps, sub-scores, caps, bands, zone axes, findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric

# Fixed values of the rating: (metric, measure, form, its arguments, points), by block of a city or axis of a zone.
FITNESS = {
    "A": [("A1", "zones", "ramp", (15, 60), 8), ("A2", "reachable_share", "ramp", (0.35, 0.85), 7), ("A3", "shared_share", "ramp", (0.30, 0.75), 5)],
    "B": [("B1", "live_share", "ramp", (0.35, 0.80), 10), ("B2", "category_depth", "ramp", (0.50, 1.00), 6), ("B3", "mean_quality", "ramp", (0.25, 0.65), 5), ("B4", "randomize_risk", "falling", (0.10, 0.40), 4)],
    "C": [("C1", "headway_min", "falling", (10, 45), 8), ("C2", "crossing_ratio", "plateau", (0.40, 0.80, 2.50, 4.50), 7), ("C3", "frequent_share", "ramp", (0.05, 0.50), 5)],
    "D": [("D1", "span_ratio", "ramp", (0.60, 1.00), 6), ("D2", "evening_share", "ramp", (0.30, 0.85), 5), ("D3", "full_dates_share", "ramp", (0.70, 1.00), 4)],
    "E": [("E1", "weekend_ratio", "ramp", (0.15, 0.60), 5), ("E2", "playable_share", "share", (), 5)],
    "F": [("F1", "hub_share", "falling", (0.25, 0.90), 5), ("F2", "isolated_share", "falling", (0.15, 0.50), 3), ("F3", "multi_route_share", "ramp", (0.10, 0.40), 2)],
}
#: What only an assumed timetable says isn't measured.
ASSUMED = ("C1", "C3", "D1", "D2", "D3", "E1", "E2")
LEAST_POINTS = 60
BANDS = ((80.0, "Excellent map"), (65.0, "Strong map"), (50.0, "Playable with house rules"), (35.0, "Marginal"), (0.0, "Not recommended as a transit game"))
#: id -> (cap, condition over the measures; null where it can't be judged)
CAPS = {
    "CAP_ZONES": (40.0, "case when zones > 0 then zones < 30 end"),
    "CAP_CATEGORIES": (45.0, "case when judged_questions >= 6 and judged_questions >= 0.5 * catalogue_size then live_categories < 3 end"),
    "CAP_SPAN": (25.0, "longest_span_h < 4.0"),
    "CAP_UNREACHABLE": (45.0, "reachable_share < 0.15"),
    "CAP_ONE_ROUTE": (50.0, "one_route_share >= 0.90"),
}
ZONE_AXES = {
    "IR": [("IR1", "joint_share", "floor", (0.10,), 12), ("IR2", "pin_worst", "falling", (0.50, 0.95), 10), ("IR3", "mean_survival", "ramp", (0.45, 0.78), 8)],
    "R": [("R1", "travel_ratio", "window", (0.10, 0.30, 0.85, 1.00), 9), ("R2", "transfers", "steps", ((1, 1.0), (2, 0.6)), 6)],
    "S": [("S1", "routes", "upsteps", ((1, 0.2), (2, 0.6)), 6), ("S2", "exit_margin_min", "ramp", (-60, 60), 5), ("S3", "headway_min", "falling", (10, 60), 4)],
    "E": [("E1", "spot_weight", "ramp", (0, 12), 8), ("E2", "spot_clusters", "ramp", (1, 5), 4), ("E3", "enclosed_share", "ramp", (0.10, 0.60), 3)],
    "A": [("A1", "toilet", "share", (), 6), ("A2", "food", "ramp", (0, 6), 5), ("A3", "shelter", "ramp", (0, 5), 4)],
    "X": [("X1", "edge_share", "falling", (0.0, 0.35), 4), ("X2", "neighbours", "ramp", (0, 8), 3), ("X3", "seeker_ratio", "ramp", (0.20, 0.80), 3)],
}
#: flag -> condition over a zone's measures
ZONE_FLAGS = {
    "edge_zone": "edge_share > 0.25",
    "no_legal_spot": "spot_weight <= 0",
    "no_service": "coalesce(routes, 0) = 0 or last_s is null",
    "no_toilet": "toilet <= 0",
    "osm_thin": "features < 10",
    "pinned": "cheap_pin >= 0.95",
    "strands_seekers": "last_s <= median_last_s - 3600",
    "unreachable": "travel_ratio is null or travel_ratio > 1",
}
ZONE_CAPS = (("pinned", 450), ("no_legal_spot", 400))
#: House rules in order: id -> (priority, when it holds, when it is required), over one row of facts.
HOUSE_RULES = {
    "play_day": (10, "true", "not assumed and weekend_ratio < 0.35"),
    "start_at_hub": (20, "has_hub", "false"),
    "use_borders": (30, "has_border", "true"),
    "consider_variant": (34, "score < 35.0", "true"),
    "resize_map": (35, "implied_size <> size", "false"),
    "brief_dead_questions": (40, "dead_questions > 0", "dead_questions > all_questions / 3.0"),
    "remove_curses": (45, "curses_to_remove > 0", "true"),
    "no_spending_toggle": (46, "spending_curses > 0", "false"),
    "end_timer": (50, "median_last_s > 0", "false"),
    "carry_fare": (55, "fares > 0", "false"),
    "answer_limits": (60, "true", "false"),
    "hand_limit": (61, "true", "false"),
    "check_timetable": (62, "not assumed and headway_min > 30", "false"),
    "reachability_brief": (64, "reachable_share < 0.85", "false"),
    "settle_borderline": (66, "borderline_questions > 0", "false"),
    "no_rail_note": (67, "dead_rail_questions >= 2", "false"),
    "rest_periods": (70, "size = 'large'", "false"),
    "safety_exclusions": (90, "true", "true"),
}
Table = dict[str, list[tuple]]


def fraction(raw: Column, form: str, args: Sequence, zones: Column | None = None) -> Column:
    """Share of a metric's points that a raw value earns."""
    if form == "ramp":
        return numeric.ramp(raw, *args)
    if form == "falling":
        return numeric.falling(raw, *args)
    if form == "plateau":
        return numeric.plateau(raw, *args)
    if form == "share":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw.cast("double")))
    if form == "window":  # nothing beyond 1
        return F.when(raw > 1, 0.0).otherwise(numeric.plateau(raw, *args))
    if form == "floor":  # from being the only zone
        lowest = 1.0 / zones
        return F.when(lowest == args[0], F.when(raw >= args[0], 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - lowest) / (args[0] - lowest))))
    if form == "steps":
        return reduce(lambda rest, step: F.when(raw <= step[0], step[1]).otherwise(rest), reversed(args), F.lit(0.2))
    return F.when(raw <= 0, F.lit(None)).otherwise(reduce(lambda rest, step: F.when(raw <= step[0], step[1]).otherwise(rest), reversed(args), F.lit(1.0)))


def metric_rows(measures: DataFrame, table: Table, subject: str, assumed: bool = False) -> DataFrame:
    """(subject, block, metric, raw, available, tenths, most) of every metric: a row each, from a row of measures a subject."""
    rows = []
    for block, metrics in table.items():
        for name, column, form, args, points in metrics:
            raw = F.col(column).cast("double")
            earned = F.when(raw.isNotNull(), fraction(raw, form, args, F.col("n_zones") if form == "floor" else None))
            there = F.lit(False) if assumed and name in ASSUMED else earned.isNotNull()
            tenths = F.when(there, numeric.tenths(earned, points)).otherwise(F.lit(0)).cast("long")
            rows.append(F.struct(F.lit(block).alias("block"), F.lit(name).alias("metric"), raw.alias("raw"), there.alias("available"), tenths.alias("tenths"), F.lit(points * 10).cast("long").alias("most")))
    return measures.select(subject, F.explode(F.array(*rows)).alias("m")).select(subject, "m.*")


def subscores(rows: DataFrame, subject: str) -> DataFrame:
    """(subject, block, earned, most, missing): what is available earns for the whole block; nothing available earns nothing and doesn't count."""
    full = F.sum("most")
    there, got = F.sum(F.when(F.col("available"), F.col("most"))), F.sum(F.when(F.col("available"), F.col("tenths")))
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("metric")))), ",")
    scaled = numeric.half_up(F.col("got") * F.col("full") / F.col("there"), 0).cast("long")
    b = rows.groupBy(subject, "block").agg(full.alias("full"), there.alias("there"), got.alias("got"), missing.alias("missing"))
    return b.select(subject, "block", F.coalesce(scaled, F.lit(0)).cast("long").alias("earned"), F.col("full").cast("long").alias("most"), F.coalesce(F.col("there") > 0, F.lit(False)).alias("counts"), "missing")


def caps(measures: DataFrame, subject: str) -> DataFrame:
    """(subject, cap_id, cap, judged, fired) of every cap, fired or not."""
    rows = [F.struct(F.lit(name).alias("cap_id"), F.lit(cap).alias("cap"), F.expr(when).alias("on")) for name, (cap, when) in sorted(CAPS.items())]
    return measures.select(subject, F.explode(F.array(*rows)).alias("c")).select(subject, "c.cap_id", "c.cap", F.col("c.on").isNotNull().alias("judged"), F.coalesce("c.on", F.lit(False)).alias("fired"))


def fitness(blocks: DataFrame, capped: DataFrame, subject: str) -> DataFrame:
    """(subject, raw_score, score, capped_by, band, available_points): the lowest cap that fires holds the score down; no score on too few points."""
    sums = blocks.filter("counts").groupBy(subject).agg(F.sum("earned").alias("earned"), F.sum("most").alias("most"))
    low = capped.filter("fired").groupBy(subject).agg(F.min(F.struct("cap", "cap_id")).alias("low"))
    both = blocks.select(subject).distinct().join(sums, subject, "left").join(low, subject, "left")
    raw = F.coalesce(numeric.half_up(F.col("earned") / 10.0 / (F.col("most") / 10.0) * 100.0, 1), F.lit(0.0))
    held = F.col("low.cap") < F.col("raw_score")
    enough = F.coalesce(F.col("most"), F.lit(0)) >= LEAST_POINTS * 10
    out = both.withColumn("raw_score", raw).withColumn("score", F.when(enough, F.when(held, F.col("low.cap")).otherwise(F.col("raw_score"))))
    band = F.when(F.col("score").isNull(), "insufficient data for an overall rating")
    for least, name in BANDS:
        band = band.when(F.col("score") >= least, name)
    return out.select(subject, "raw_score", "score", F.when(held, F.col("low.cap_id")).alias("capped_by"), band.alias("band"), (F.coalesce("most", F.lit(0)) / 10.0).alias("available_points"))


def zone_scores(measures: DataFrame, subject: str = "zone_id") -> DataFrame:
    """(zone, overall, capped_by, flags, excluded, earned and most of each axis): 17 metrics on six axes, in tenths of a per cent."""
    rows = metric_rows(measures, ZONE_AXES, subject)
    each = rows.filter("available").groupBy(subject).agg(*[f for x in ZONE_AXES for f in (F.sum(F.when(F.col("block") == x, F.col("tenths"))).alias(f"{x}_earned"), F.sum(F.when(F.col("block") == x, F.col("most"))).alias(f"{x}_most"))])
    flags = F.array_sort(F.array_compact(F.array(*[F.when(F.expr(when), name) for name, when in ZONE_FLAGS.items()])))
    told = measures.select(subject, flags.alias("flags")).join(each, subject, "left").fillna(0)
    earned, most = (reduce(lambda a, b: a + b, [F.col(f"{x}_{kind}") for x in ZONE_AXES]) for kind in ("earned", "most"))
    out = told.withColumn("overall", F.when(most > 0, numeric.half_up(1000.0 * earned / most, 0)).otherwise(F.lit(0.0)).cast("long")).withColumn("capped_by", F.lit(None).cast("string"))
    for flag, cap in ZONE_CAPS:
        held = F.array_contains("flags", flag) & (F.col("overall") > cap)
        out = out.withColumns({"overall": F.when(held, F.lit(cap).cast("long")).otherwise(F.col("overall")), "capped_by": F.when(held, F.lit(flag)).otherwise(F.col("capped_by"))})
    return out.withColumn("excluded", F.array_contains("flags", "unreachable") | F.array_contains("flags", "no_service"))


def house_rules(facts: DataFrame) -> DataFrame:
    """(rule_id, priority, required) of the rules that hold, from one row of facts; what isn't known holds no rule."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(p).alias("priority"), F.coalesce(F.expr(need), F.lit(False)).alias("required"), F.coalesce(F.expr(when), F.lit(False)).alias("on")) for r, (p, when, need) in HOUSE_RULES.items()])
    return facts.select(F.explode(F.filter(rules, lambda r: r["on"])).alias("r")).select("r.rule_id", "r.priority", "r.required")


def defined(spark: SparkSession, table: Table) -> DataFrame:
    """The metrics as a table."""
    return spark.createDataFrame([(block, name, column, form, points) for block, rows in table.items() for name, column, form, _, points in rows], "block string, metric string, measure string, form string, points int")
