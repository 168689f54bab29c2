"""Timetable feeds: zip archives and CSV tables as DataFrames."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

REQUIRED = ("stops", "routes", "trips", "stop_times")


def members(data: bytes) -> list[tuple[str, bytes]]:
    """(table, content) of each text file of an archive; folders don't matter, resource forks are left out.

    Raises ValueError for an encrypted member or something that is no archive.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError(f"no zip archive: {e}") from e
    out = []
    for info in archive.infolist():
        name = info.filename
        if info.is_dir() or "__MACOSX" in name or not name.lower().endswith(".txt"):
            continue
        if info.flag_bits & 1:
            raise ValueError(f"{name} is encrypted")
        out.append((name.rpartition("/")[2][:-4].lower(), archive.read(info)))
    return out


def rows(content: bytes) -> Iterator[dict[str, str]]:
    """Records of a CSV table: a byte-order mark goes, short rows are padded, long ones cut, blank lines skipped."""
    reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))
    header = [h.strip() for h in next(reader, [])]
    for row in reader:
        if row and any(row):
            yield dict(zip(header, [*row, *[""] * len(header)], strict=False))


class _Part(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options["table"].lower()

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.value)
        with store.open_input_file(path) as source:
            for name, content in members(source.read()):
                if name == self.table:
                    for i, row in enumerate(rows(content)):
                        yield (i, row)


class GtfsZip(DataSource):
    """spark.read.format("gtfs_zip").option("table", "stops").load(uri): (row, fields map) of one table of an archive."""

    @classmethod
    def name(cls) -> str:
        return "gtfs_zip"

    def schema(self) -> str:
        return "row long, fields map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_zip(spark: SparkSession, uri: str, table: str, columns: list[str]) -> DataFrame:
    """One table of an archive as text columns; blank fields and absent columns are null."""
    spark.dataSource.register(GtfsZip)
    raw = spark.read.format("gtfs_zip").option("table", table).load(uri)
    return raw.select("row", *[F.nullif(F.trim(F.element_at("fields", c)), F.lit("")).alias(c) for c in columns])


def read_zips(spark: SparkSession, folder: str, table: str, columns: list[str]) -> DataFrame:
    """One table of all archives of a folder, with the file and a digest of its bytes; an archive a row, so files spread over tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, digest, content in zip(*(batch.column(c).to_pylist() for c in ("path", "sha", "content")), strict=True):
                found = [r for name, data in members(content) if name == table for r in rows(data)]
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]] * len(found)), pa.array([digest] * len(found)), *[pa.array([(r.get(c) or "").strip() or None for r in found], pa.string()) for c in columns]], ["file", "sha256", *columns])

    text = ", ".join(f"`{c}` string" for c in columns)
    return files.select("path", F.sha2("content", 256).alias("sha"), "content").mapInArrow(run, f"file string, sha256 string, {text}")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table as text, quotes doubled inside quotes, lines inside quotes kept."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", inferSchema=False)
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def stop_times(raw: DataFrame) -> DataFrame:
    """Typed stop times; clock times may pass 24 hours."""
    from ..functions import text

    return raw.select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), text.seconds(F.col("arrival_time")).alias("arr_s"), text.seconds(F.col("departure_time")).alias("dep_s"), F.col("shape_dist_traveled").try_cast("double").alias("dist"))


def stops(raw: DataFrame) -> DataFrame:
    """Stops that can be boarded: type 0 or blank, with coordinates that parse."""
    lat, lon = F.col("stop_lat").try_cast("double"), F.col("stop_lon").try_cast("double")
    kept = raw.filter(F.coalesce(F.col("location_type"), F.lit("0")) == "0").withColumn("lat", lat).withColumn("lon", lon)
    return kept.filter("lat is not null and lon is not null").select("stop_id", "stop_name", "lat", "lon", "parent_station")


def checked(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    missing = [t for t in REQUIRED if t not in tables]
    if missing:
        raise ValueError(f"the feed lacks {', '.join(missing)}")
    return tables


def sources(given: list[dict]) -> list[dict]:
    """One to ten run sources, each a file, a url or a drawn area; anything else is refused."""
    if not 1 <= len(given) <= 10:
        raise ValueError("one to ten sources")
    for s in given:
        if s.get("kind") not in ("file", "url", "area"):
            raise ValueError(f"unknown kind {s.get('kind')}")
        if s["kind"] == "area" and len(s.get("ring", [])) < 3:
            raise ValueError("an area needs three corners")
        if s["kind"] == "url" and not str(s.get("url", "")).startswith(("http://", "https://")):
            raise ValueError("a url needs http or https")
    return given
