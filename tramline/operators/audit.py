"""Verdicts on questions from what is known of their subjects: dead, degenerate, weak, functional or unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import survival as V

# Qualities below which a live question barely helps, by kind; a thermometer's share of the map; a photo's shares.
WEAK = {"nearest": 0.12, "line": 0.12, "name_length": 0.12, "street": 0.12, "division": 0.12, "distance": 0.30, "border": 0.30, "radar": 0.25, "thermometer": 0.20}
THERMO_SHARE = 0.7
RARE, COMMON = 0.15, 0.85

#: Columns of the facts that judged() reads; those that a kind doesn't use are null.
FACTS = "question_id string, category string, kind string, queried boolean, instances long, margin long, classes long, quality double, coverage double, evaluated long, length_m double, diameter_m double, zone_radius_m double, median_arms long, crosses boolean, derived boolean, ordinal_known boolean"


def status() -> Column:
    """The verdict on a row of facts."""
    n, quality = F.col("instances"), F.coalesce("quality", F.lit(0.0))
    kind = F.col("kind")
    live = F.lit("functional")
    for name, least in WEAK.items():
        live = F.when((kind == name) & (quality < least), "weak").otherwise(live)
    counted = F.when(~F.coalesce("queried", F.lit(False)), "unknown").when(n == 0, "dead")
    several = counted.when(n == 1, "degenerate")
    wide, known = F.col("length_m") >= F.col("diameter_m"), F.col("diameter_m") > 0
    arms = F.when(F.col("median_arms") >= 2, "functional").otherwise("weak")
    photo = F.when(F.coalesce("evaluated", F.lit(0)) == 0, "unknown").when(F.col("coverage") <= 0, "dead").when(F.col("coverage") >= 1, "degenerate").when(~F.col("coverage").between(RARE, COMMON), "weak").otherwise("functional")
    shore = F.when(~F.coalesce("queried", F.lit(False)), "unknown").when((n == 0) | F.coalesce("derived", F.lit(False)), "degenerate").otherwise("unknown")
    division = F.when(~F.coalesce("queried", F.lit(False)) | ~F.coalesce("ordinal_known", F.lit(False)) | (F.coalesce(n, F.lit(0)) == 0), "unknown").when(n == 1, "degenerate").otherwise(live)
    border = F.when(~F.coalesce("queried", F.lit(False)) | ~F.coalesce("ordinal_known", F.lit(False)) | F.col("crosses").isNull(), "unknown").when(~F.col("crosses"), "dead").when(F.coalesce("evaluated", F.lit(0)) == 0, "unknown").otherwise(live)
    return (
        F.when(kind == "nearest", several.otherwise(live))
        .when(kind == "line", F.when(n == 0, "dead").when(n == 1, "degenerate").otherwise(live))
        .when(kind == "name_length", F.when(F.col("classes") < 2, "degenerate").otherwise(live))
        .when(kind.isin("street", "distance"), counted.otherwise(live))
        .when(kind == "landmass", shore)
        .when(kind == "division", division)
        .when(kind == "border", border)
        .when(kind == "radar", F.when(known & wide, "degenerate").when(F.col("length_m") < F.col("zone_radius_m"), "weak").otherwise(live))
        .when(kind == "thermometer", F.when(known & (F.col("length_m") > F.col("diameter_m")), "dead").when(known & (F.col("length_m") > THERMO_SHARE * F.col("diameter_m")), "degenerate").otherwise(live))
        .when(kind == "photo", photo)
        .when(kind == "tentacle", several.otherwise(arms))
        .otherwise("unknown")
    )


def borderline() -> Column:
    """Whether a border drawn a little wider would change the verdict: the first feature, or the second, lies just outside."""
    n, margin = F.col("instances"), F.col("margin")
    first = (n == 0) & (margin >= 1)
    second = (n == 1) & (margin >= 2) & F.col("kind").isin("nearest", "tentacle")
    return F.coalesce(F.col("kind").isin("nearest", "distance", "tentacle") & F.coalesce("queried", F.lit(False)) & (first | second), F.lit(False))


def judged(facts: DataFrame) -> DataFrame:
    """The facts with status, borderline, and quality cut to 0..1 (0 where the verdict doesn't rest on it)."""
    scored = F.col("status").isin("weak", "functional") | F.col("kind").isin("radar", "thermometer", "photo")
    kept = F.when(scored, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("quality", F.lit(0.0))))).otherwise(F.lit(0.0))
    return facts.withColumn("status", status()).withColumn("borderline", borderline()).withColumn("quality", kept)


def stats(questions: DataFrame, categories: int) -> DataFrame:
    """One row: total, live_share, category_depth, live_categories, mean_quality, randomize_risk of the questions that aren't unknown."""
    known = questions.filter("status <> 'unknown'")
    per = known.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.expr("status = 'functional'")).alias("f"), F.count_if(F.expr("status in ('dead', 'degenerate')")).alias("d"), F.count_if(F.expr("status = 'weak'")).alias("w"), F.sum(F.when(F.col("status") == "functional", F.col("quality"))).alias("q"))
    total = F.sum("n")
    return per.agg(
        F.coalesce(total, F.lit(0)).alias("total"),
        ((F.sum("f") + 0.5 * F.sum("w")) / total).alias("live_share"),
        (F.coalesce(F.count_if(F.col("f") >= 2), F.lit(0)) / F.lit(float(categories))).alias("category_depth"),
        F.count_if(F.col("f") >= 1).alias("live_categories"),
        F.try_divide(F.sum("q"), F.sum("f")).alias("mean_quality"),
        (F.sum("d") / total).alias("randomize_risk"),
    )


def matching_quality(answers: DataFrame, seekers: DataFrame | None = None) -> DataFrame:
    """(question, quality, classes) of (question, zone_id, class_key): how evenly yes and no fall, over the seekers or over all rows; 0 where a zone has no answer."""
    sizes = answers.groupBy("question", "class_key").agg(F.count("*").alias("block"))
    if seekers is None:
        known = F.when(F.col("class_key").isNotNull(), F.col("block") * F.col("block")).otherwise(F.lit(0))
        asked = sizes.groupBy("question").agg((F.sum(known) / F.sum("block")).alias("mean"))
    else:
        asked = answers.join(seekers.select(F.col("seeker_id").alias("zone_id")), "zone_id").join(sizes, ["question", "class_key"], "left").groupBy("question").agg(F.avg(F.coalesce("block", F.lit(0))).alias("mean"))
    whole = sizes.groupBy("question").agg(F.sum("block").alias("n"), F.count("class_key").alias("classes"), F.bool_or(F.col("class_key").isNull()).alias("holes"))
    return whole.join(asked, "question").select("question", F.when(F.col("holes"), 0.0).otherwise(V.binary_quality(F.col("mean") / F.col("n"))).alias("quality"), "classes")


def measuring_quality(values: DataFrame, seekers: DataFrame | None = None) -> DataFrame:
    """(question, quality) of (question, zone_id, value): 1 where a comparison halves the zones, over the seekers or over all rows; 0 where a zone has no value."""
    whole = values.groupBy("question").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("holes"))
    per = _sides(values) if seekers is None else _sampled_sides(values, seekers)
    mean = F.col("kept") / (F.col("s") * F.col("n") * F.col("n"))
    return whole.join(per, "question", "left").select("question", F.when(F.col("holes") > 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - mean) / 0.5))).alias("quality"))


#: A zone on a side survives with all on it, so a side's size counts as often as it has zones.
KEPT = "g * g + e * e + l * l"


def _sides(values: DataFrame) -> DataFrame:
    """(question, kept, s), each row asking: sums over the distinct values, a short table."""
    sizes = values.filter("value is not null").groupBy("question", "value").agg(F.count("*").cast("double").alias("e"))
    own = W.partitionBy("question")
    sides = sizes.withColumn("l", F.sum("e").over(own.orderBy("value")) - F.col("e")).withColumn("g", F.sum("e").over(own) - F.col("l") - F.col("e"))
    return sides.groupBy("question").agg(F.sum(F.expr(f"e * ({KEPT})")).alias("kept"), F.sum("e").alias("s"))


def _sampled_sides(values: DataFrame, seekers: DataFrame) -> DataFrame:
    at = values.join(seekers.select(F.col("seeker_id").alias("zone_id")), "zone_id").select("question", F.col("zone_id").alias("seeker_id"), F.col("value").alias("sv"))
    side = F.signum(F.col("value") - F.col("sv"))
    counts = values.groupBy("question", "value").agg(F.count("*").alias("n")).join(F.broadcast(at), "question").groupBy("question", "seeker_id").agg(*[F.sum(F.when(side == s, F.col("n")).otherwise(0)).cast("double").alias(c) for s, c in ((1, "g"), (0, "e"), (-1, "l"))])  # at most V.FULL seekers a question
    return counts.groupBy("question").agg(F.sum(F.expr(KEPT)).alias("kept"), F.count("*").alias("s"))
