"""Several feeds as one: ids with a tag in front, tables one after the other, one window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of each table that hold ids of the feed.
IDS = {
    "agency": ("agency_id",), "calendar": ("service_id",), "calendar_dates": ("service_id",), "fare_attributes": (), "feed_info": (), "frequencies": ("trip_id",), "routes": ("route_id", "agency_id"), "shapes": ("shape_id",),
    "stop_times": ("trip_id", "stop_id"), "stops": ("stop_id", "parent_station"), "transfers": ("from_stop_id", "to_stop_id", "from_trip_id", "to_trip_id", "from_route_id", "to_route_id"), "trips": ("trip_id", "route_id", "service_id", "shape_id", "block_id"),
}
#: Tables that aren't simply one after the other: one feed's fares are kept, and the window is made anew.
APART = ("fare_attributes", "feed_info")
SHORT_DAYS, MOST_COLONS = 7, 8


@dataclass
class Feed:
    """A feed's tables, the digest of its bytes, its label and time zone, and its window (dates in eight digits)."""

    tables: dict[str, DataFrame]
    sha256: str
    label: str = ""
    timezone: str = ""
    start: str = ""
    end: str = ""


@dataclass
class Merged:
    tables: dict[str, DataFrame]
    tags: list[str]
    primary: int
    fares: int | None
    start: str
    end: str
    notes: list[str] = field(default_factory=list)


def order(feeds: Sequence[Feed]) -> list[int]:
    """Places of the feeds in merge order: digest, label, place."""
    return sorted(range(len(feeds)), key=lambda i: (feeds[i].sha256, feeds[i].label, i))


def depth(feeds: Sequence[Feed]) -> int:
    """Colons after a tag: one more than any id that looks tagged already has, so no merged id meets another."""
    seen = []
    for feed in feeds:
        for name, df in feed.tables.items():
            for c in [c for c in IDS.get(name, ()) if c in df.columns]:
                colons = F.length(F.regexp_extract(F.trim(F.col(c).cast("string")), r"^f\d+(:+)", 1))
                seen.append(df.agg(F.max(colons).alias("d")))
    if not seen:
        return 1
    top = reduce(DataFrame.unionByName, seen).agg(F.max("d")).first()[0]
    return min(MOST_COLONS, (top or 0) + 1)


def named(df: DataFrame, table: str, prefix: str, agency: str = "") -> DataFrame:
    """A table with ``prefix`` before its ids, trimmed; blanks stay blank but for a route's agency, which is the feed's only one."""

    def tagged(c: str) -> Column:
        t = F.trim(F.col(c).cast("string"))
        full = F.coalesce(t, F.lit("")) != ""
        blank = F.lit(agency) if c == "agency_id" and agency else F.col(c).cast("string")
        return F.when(full, F.concat(F.lit(prefix), t)).otherwise(blank)

    return df.withColumns({c: tagged(c) for c in IDS[table] if c in df.columns})


def merged(spark: SparkSession, feeds: Sequence[Feed]) -> Merged:
    """All feeds as one; a single feed stays as it is.

    The primary feed has the most trips, ties in merge order.  Fares are the primary's, or those of the first feed that
    has any.  The window is what all feeds cover, or, with a note, all they cover together.
    Tables that a feed lacks, or columns, are blank there.
    """
    at = order(feeds)
    if len(feeds) == 1:
        f = feeds[0]
        return Merged(f.tables, [], 0, 0 if "fare_attributes" in f.tables else None, f.start, f.end)
    colons = ":" * depth(feeds)
    tags = {i: f"f{k}" for k, i in enumerate(at)}
    trips = {i: feeds[i].tables["trips"].count() if "trips" in feeds[i].tables else 0 for i in at}
    primary = max(at, key=lambda i: (trips[i], -at.index(i)))
    tables: dict[str, DataFrame] = {}
    for name in IDS:
        if name in APART:
            continue
        parts = []
        for i in at:
            if name in feeds[i].tables:
                parts.append(named(feeds[i].tables[name], name, tags[i] + colons, _agency(feeds[i], tags[i], colons)))
        if parts:
            tables[name] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    fares = next((i for i in [primary, *at] if "fare_attributes" in feeds[i].tables and not feeds[i].tables["fare_attributes"].isEmpty()), None)
    if fares is not None:
        tables["fare_attributes"] = feeds[fares].tables["fare_attributes"]
    start, end, notes = _window([feeds[i] for i in at])
    if len({f.timezone for f in feeds if f.timezone}) > 1:
        notes.append("merge_mixed_tz")
    tables["feed_info"] = spark.createDataFrame([(start, end)], "feed_start_date string, feed_end_date string")
    return Merged(tables, [tags[i] for i in range(len(feeds))], primary, fares, start, end, notes)


def _agency(feed: Feed, tag: str, colons: str) -> str:
    """What a blank agency means: the only one of the feed, or the feed itself where that has no id."""
    if "agency" not in feed.tables or "agency_id" not in feed.tables["agency"].columns:
        return ""
    rows = feed.tables["agency"].select(F.trim(F.coalesce(F.col("agency_id").cast("string"), F.lit("")))).limit(2).collect()
    return "" if len(rows) != 1 else tag + colons + rows[0][0] if rows[0][0] else tag


def _window(feeds: Sequence[Feed]) -> tuple[str, str, list[str]]:
    from datetime import date

    start, end = max(f.start for f in feeds), min(f.end for f in feeds)
    if start > end:
        return min(f.start for f in feeds), max(f.end for f in feeds), ["merge_no_overlap"]
    day = lambda d: date(int(d[:4]), int(d[4:6]), int(d[6:])) if len(d) == 8 and d.isdigit() else None
    a, b = day(start), day(end)
    days = (b - a).days + 1 if a and b else 0
    return start, end, ["merge_short_overlap"] if days < SHORT_DAYS else []


def window(info: DataFrame, calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """(start_date, end_date): from the feed's own note, else its calendar, else its dates; each end by itself, a row."""
    a = info.agg(F.min("start_date").alias("ia"), F.max("end_date").alias("ib"))
    b = calendar.agg(F.min("start_date").alias("ca"), F.max("end_date").alias("cb"))
    c = dates.filter("exception_type = 1").agg(F.min("date").alias("da"), F.max("date").alias("db"))
    both = a.crossJoin(b).crossJoin(c)  # one row each
    return both.select(F.coalesce("ia", "ca", "da").alias("start_date"), F.coalesce("ib", "cb", "db").alias("end_date"))
