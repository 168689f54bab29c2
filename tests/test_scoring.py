"""Rating and audit on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tramline.operators import audit, scoring

GOOD = {"zones": 60, "reachable_share": 0.6, "shared_share": 0.75, "live_share": 0.8, "category_depth": 1.0, "mean_quality": 0.65, "randomize_risk": 0.25, "headway_min": 27.5, "crossing_ratio": 1.0, "frequent_share": 0.5, "span_ratio": 1.0, "evening_share": 0.85, "full_dates_share": 1.0,
        "weekend_ratio": 0.6, "playable_share": 0.5, "hub_share": 0.25, "isolated_share": 0.15, "multi_route_share": 0.4, "judged_questions": 50, "catalogue_size": 71, "live_categories": 6, "longest_span_h": 16.0, "one_route_share": 0.4}


def frame(spark, **rows):
    cells = [[name, *[None if v is None else float(v) for v in (GOOD | own).values()]] for name, own in rows.items()]
    return spark.createDataFrame(cells, "city string, " + ", ".join(f"{c} double" for c in GOOD))


def rated(spark, **rows):
    m = frame(spark, **rows)
    blocks = scoring.subscores(scoring.metric_rows(m, scoring.FITNESS, "city"), "city")
    got = {r.city: r for r in scoring.fitness(blocks, scoring.caps(m, "city"), "city").collect()}
    return got, {(r.city, r.block): r for r in blocks.collect()}


def test_the_table_has_a_hundred_points():
    points = {block: sum(p for *_, p in rows) for block, rows in scoring.FITNESS.items()}
    assert points == {"A": 20, "B": 25, "C": 20, "D": 15, "E": 10, "F": 10} and sum(map(len, scoring.FITNESS.values())) == 18
    assert sum(map(len, scoring.ZONE_AXES.values())) == 17


def test_metrics_blocks_and_total(spark):
    """A2 is half way up its ramp (3.5 of 7), B4 half way down (2 of 4), C1 half way down (4 of 8), E2 is a half (2.5 of 5)."""
    got, blocks = rated(spark, one={})
    earned = {b: blocks["one", b].earned for b in "ABCDEF"}
    assert earned == {"A": 165, "B": 230, "C": 160, "D": 150, "E": 75, "F": 100}
    assert (got["one"].raw_score, got["one"].score, got["one"].capped_by, got["one"].band) == (88.0, 88.0, None, "Excellent map")


def test_what_is_missing_is_scaled_away(spark):
    got, blocks = rated(spark, part={"reachable_share": None}, none={c: None for c in ("live_share", "category_depth", "mean_quality", "randomize_risk")})
    assert (blocks["part", "A"].earned, blocks["part", "A"].missing) == (200, "A2")  # 130 of 130
    assert (blocks["none", "B"].earned, blocks["none", "B"].counts, blocks["none", "B"].missing) == (0, False, "B1,B2,B3,B4")
    assert got["none"].available_points == 75.0 and got["none"].raw_score == 86.7  # 650 of 750
    few, _ = rated(spark, few={m: None for b in "ABC" for _, m, *_ in scoring.FITNESS[b]} | {"zones": None})
    assert few["few"].score is None and few["few"].available_points == 35.0 and few["few"].band.startswith("insufficient")


@pytest.mark.parametrize("own, cap, name", [({"zones": 29}, 40.0, "CAP_ZONES"), ({"live_categories": 2}, 45.0, "CAP_CATEGORIES"), ({"longest_span_h": 3.9}, 25.0, "CAP_SPAN"), ({"reachable_share": 0.14}, 45.0, "CAP_UNREACHABLE"), ({"one_route_share": 0.9}, 50.0, "CAP_ONE_ROUTE"), ({"zones": 29, "longest_span_h": 1}, 25.0, "CAP_SPAN")])
def test_caps(spark, own, cap, name):
    got, _ = rated(spark, c=own)
    assert (got["c"].score, got["c"].capped_by) == (cap, name)


def test_caps_that_dont_fire(spark):
    got, _ = rated(spark, edge={"zones": 30, "live_categories": 3, "longest_span_h": 4.0, "reachable_share": 0.15, "one_route_share": 0.899}, few={"judged_questions": 5, "live_categories": 0}, half={"judged_questions": 35, "live_categories": 0})
    assert got["edge"].capped_by is None and got["few"].capped_by is None and got["half"].capped_by is None


def test_assumed_timetables_measure_nothing(spark):
    rows = scoring.metric_rows(frame(spark, a={}), scoring.FITNESS, "city", assumed=True).collect()
    assert {r.metric for r in rows if not r.available} == set(scoring.ASSUMED)
    assert sum(r.most for r in rows if r.available) == 620


ZONE = {"n_zones": 50, "joint_share": 0.10, "pin_worst": 0.5, "mean_survival": 0.78, "travel_ratio": 0.5, "transfers": 1, "routes": 3, "exit_margin_min": 60, "headway_min": 10, "spot_weight": 12, "spot_clusters": 5, "enclosed_share": 0.6, "toilet": 1, "food": 6, "shelter": 5, "edge_share": 0, "neighbours": 8, "seeker_ratio": 0.8, "cheap_pin": 0.2, "features": 30, "last_s": 80000, "median_last_s": 80000}


def zones(spark, **rows):
    cells = [[name, *[None if v is None else float(v) for v in (ZONE | own).values()]] for name, own in rows.items()]
    return {r.zone_id: r for r in scoring.zone_scores(spark.createDataFrame(cells, "zone_id string, " + ", ".join(f"{c} double" for c in ZONE))).collect()}


def test_zones(spark):
    got = zones(spark, best={}, pinned={"cheap_pin": 0.95, "pin_worst": 0.95}, bare={"spot_weight": 0}, far={"travel_ratio": 1.01}, cut={"travel_ratio": None}, dead={"routes": 0, "last_s": None}, early={"last_s": 76400}, edge={"edge_share": 0.26, "features": 9, "toilet": 0}, lone={"joint_share": 0.02}, two={"routes": 2, "transfers": 2}, three={"transfers": 3, "routes": 1})
    assert (got["best"].overall, got["best"].flags, got["best"].excluded) == (1000, [], False)
    assert (got["pinned"].overall, got["pinned"].capped_by, got["pinned"].flags) == (450, "pinned", ["pinned"])
    assert (got["bare"].overall, got["bare"].capped_by) == (400, "no_legal_spot")
    assert got["far"].flags == got["cut"].flags == ["unreachable"] and got["far"].excluded and got["far"].R_earned == 60 and got["far"].R_most == 150
    assert got["cut"].R_most == 60  # no travel time: the metric doesn't count
    assert got["dead"].flags == ["no_service"] and got["dead"].excluded and got["dead"].S_most == 90
    assert got["early"].flags == ["strands_seekers"] and not got["early"].excluded
    assert got["edge"].flags == ["edge_zone", "no_toilet", "osm_thin"] and got["edge"].X_earned == 30 + 30 + 10  # 0.26 of 0.35 leaves 1.03 of 4
    assert got["lone"].IR_earned == 300 - 120
    assert (got["two"].S_earned, got["two"].R_earned) == (36 + 90, 90 + 36) and (got["three"].S_earned, got["three"].R_earned) == (12 + 90, 90 + 12)


def facts(spark, **rows):
    names = [c.split(" ")[0] for c in audit.FACTS.split(", ")]
    cells = [tuple({"question_id": q, "category": "c", "queried": True, "diameter_m": 10_000.0, "zone_radius_m": 400.0}.get(c) if c not in own else own[c] for c in names) for q, own in rows.items()]
    return {r.question_id: (r.status, r.borderline) for r in audit.judged(spark.createDataFrame(cells, audit.FACTS)).collect()}


def test_verdicts(spark):
    near, dist, arms = ({"kind": k} for k in ("nearest", "distance", "tentacle"))
    got = facts(
        spark,
        unasked=near | {"queried": False, "instances": 3, "margin": 9}, none=near | {"instances": 0, "margin": 0}, almost=near | {"instances": 0, "margin": 1}, one=near | {"instances": 1, "margin": 1}, one_more=near | {"instances": 1, "margin": 2}, dull=near | {"instances": 2, "quality": 0.119}, fine=near | {"instances": 2, "quality": 0.12},
        d0=dist | {"instances": 0, "margin": 1}, d1=dist | {"instances": 1, "margin": 5, "quality": 0.3}, d2=dist | {"instances": 2, "quality": 0.29},
        t0=arms | {"instances": 0, "margin": 2}, t1=arms | {"instances": 1, "margin": 2}, t2=arms | {"instances": 5, "median_arms": 2}, t3=arms | {"instances": 5, "median_arms": 1},
        r0={"kind": "radar", "length_m": 10_000.0, "quality": 1.0}, r1={"kind": "radar", "length_m": 399.0, "quality": 1.0}, r2={"kind": "radar", "length_m": 800.0, "quality": 0.25}, r3={"kind": "radar", "length_m": 800.0, "quality": 0.24},
        h0={"kind": "thermometer", "length_m": 10_001.0}, h1={"kind": "thermometer", "length_m": 7_001.0}, h2={"kind": "thermometer", "length_m": 7_000.0, "quality": 0.2}, h3={"kind": "thermometer", "length_m": 100.0, "quality": 0.1},
        p0={"kind": "photo", "evaluated": 0}, p1={"kind": "photo", "evaluated": 5, "coverage": 0.0}, p2={"kind": "photo", "evaluated": 5, "coverage": 1.0}, p3={"kind": "photo", "evaluated": 5, "coverage": 0.14}, p4={"kind": "photo", "evaluated": 5, "coverage": 0.15}, p5={"kind": "photo", "evaluated": 5, "coverage": 0.86},
        n0={"kind": "name_length", "classes": 1}, n1={"kind": "name_length", "classes": 2, "quality": 0.5}, l0={"kind": "line", "instances": 0}, l1={"kind": "line", "instances": 1}, l2={"kind": "line", "instances": 2, "quality": 0.1},
        s0={"kind": "street", "instances": 0}, s1={"kind": "street", "instances": 7, "quality": 0.01}, m0={"kind": "landmass", "instances": 0}, m1={"kind": "landmass", "instances": 3, "derived": True}, m2={"kind": "landmass", "instances": 3}, m3={"kind": "landmass", "queried": False},
        a0={"kind": "division", "ordinal_known": False, "instances": 4}, a1={"kind": "division", "ordinal_known": True, "instances": 0}, a2={"kind": "division", "ordinal_known": True, "instances": 1}, a3={"kind": "division", "ordinal_known": True, "instances": 2, "quality": 0.5},
        b0={"kind": "border", "ordinal_known": True}, b1={"kind": "border", "ordinal_known": True, "crosses": False}, b2={"kind": "border", "ordinal_known": True, "crosses": True, "evaluated": 0}, b3={"kind": "border", "ordinal_known": True, "crosses": True, "evaluated": 9, "quality": 0.29}, dem={"kind": "dem"},
    )
    said = {k: v[0] for k, v in got.items()}
    assert said == {
        "unasked": "unknown", "none": "dead", "almost": "dead", "one": "degenerate", "one_more": "degenerate", "dull": "weak", "fine": "functional", "d0": "dead", "d1": "functional", "d2": "weak", "t0": "dead", "t1": "degenerate", "t2": "functional", "t3": "weak",
        "r0": "degenerate", "r1": "weak", "r2": "functional", "r3": "weak", "h0": "dead", "h1": "degenerate", "h2": "functional", "h3": "weak", "p0": "unknown", "p1": "dead", "p2": "degenerate", "p3": "weak", "p4": "functional", "p5": "weak", "n0": "degenerate", "n1": "functional",
        "l0": "dead", "l1": "degenerate", "l2": "weak", "s0": "dead", "s1": "weak", "m0": "degenerate", "m1": "degenerate", "m2": "unknown", "m3": "unknown", "a0": "unknown", "a1": "unknown", "a2": "degenerate", "a3": "functional", "b0": "unknown", "b1": "dead", "b2": "unknown", "b3": "weak", "dem": "unknown",
    }
    assert {k for k, v in got.items() if v[1]} == {"almost", "one_more", "d0", "t0", "t1"}


def test_qualities(spark):
    """Four zones in classes of 3 and 1, every zone a seeker: yes falls (9 + 1) / 16 of the time; values 1, 2, 2, 9."""
    ask = spark.createDataFrame([(z, 0.0, 0.0) for z in "abcd"], "seeker_id string, sx double, sy double")
    answers = spark.createDataFrame([("q", z, "x" if z != "d" else "y") for z in "abcd"] + [("h", z, None if z == "a" else "x") for z in "abcd"], "question string, zone_id string, class_key string")
    got = {r.question: (r.quality, r.classes) for r in audit.matching_quality(answers, ask).collect()}
    assert got == {"q": (0.75, 2), "h": (0.0, 1)}
    values = spark.createDataFrame([("v", z, float(x)) for z, x in zip("abcd", (1, 2, 2, 9), strict=True)] + [("w", z, None if z == "a" else 1.0) for z in "abcd"], "question string, zone_id string, value double")
    kept = (1 + 9) + 2 * (1 + 4 + 1) + (1 + 9)  # each seeker's side sizes, squared
    got = {r.question: r.quality for r in audit.measuring_quality(values, ask).collect()}
    assert got["w"] == 0.0 and abs(got["v"] - (1 - kept / 64) / 0.5) < 1e-12


def test_stats(spark):
    rows = [("a", "functional", 0.5), ("a", "functional", 0.7), ("a", "dead", 0.0), ("b", "weak", 0.1), ("b", "degenerate", 0.0), ("c", "functional", 0.3), ("c", "unknown", 0.0)]
    r = audit.stats(spark.createDataFrame(rows, "category string, status string, quality double"), 6).first()
    assert (r.total, r.live_share, r.live_categories) == (6, (3 + 0.5) / 6, 2) and abs(r.category_depth - 1 / 6) < 1e-12
    assert abs(r.mean_quality - 0.5) < 1e-12 and abs(r.randomize_risk - 2 / 6) < 1e-12 and F is not None


RULE_FACTS = {"assumed": False, "weekend_ratio": 0.9, "has_hub": True, "has_border": True, "score": 50.0, "implied_size": "medium", "size": "medium", "dead_questions": 0, "all_questions": 60, "curses_to_remove": 0, "spending_curses": 0, "median_last_s": 0, "fares": 0, "headway_min": 30.0, "reachable_share": 0.85, "borderline_questions": 0, "dead_rail_questions": 1}
ALWAYS = {"play_day": False, "start_at_hub": False, "use_borders": True, "answer_limits": False, "hand_limit": False, "safety_exclusions": True}


@pytest.mark.parametrize("own, more", [
    ({}, {}), ({"weekend_ratio": 0.34}, {"play_day": True}), ({"weekend_ratio": 0.34, "assumed": True}, {}), ({"score": 34.9}, {"consider_variant": True}), ({"implied_size": "large"}, {"resize_map": False}),
    ({"dead_questions": 20}, {"brief_dead_questions": False}), ({"dead_questions": 21}, {"brief_dead_questions": True}), ({"curses_to_remove": 1, "spending_curses": 2}, {"remove_curses": True, "no_spending_toggle": False}), ({"median_last_s": 80000, "fares": 1}, {"end_timer": False, "carry_fare": False}),
    ({"headway_min": 30.1, "reachable_share": 0.84}, {"check_timetable": False, "reachability_brief": False}), ({"headway_min": 31.0, "assumed": True}, {}), ({"borderline_questions": 1, "dead_rail_questions": 2}, {"settle_borderline": False, "no_rail_note": False}), ({"size": "large", "implied_size": "large"}, {"rest_periods": False}),
    ({"weekend_ratio": None, "score": None, "headway_min": None, "reachable_share": None, "median_last_s": None}, {}),
])
def test_house_rules(spark, own, more):
    kinds = {bool: "boolean", float: "double", int: "long", str: "string"}
    row = RULE_FACTS | own
    schema = ", ".join(f"{k} {kinds[type(RULE_FACTS[k])]}" for k in row)
    got = scoring.house_rules(spark.createDataFrame([tuple(row.values())], schema)).collect()
    assert {r.rule_id: r.required for r in got} == ALWAYS | more
    assert [r.priority for r in got] == sorted(r.priority for r in got)
