"""Text and JSON feeds: antenna patterns, stored cells, targets, roads, packet pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "struct<source_id:string,downlink_margin_db:double,uplink_margin_db:double,two_way_margin_db:double,valid_downlink:boolean,valid_uplink:boolean,valid_two_way:boolean,rejection:string,rejection_detail:string>"
CELL = (
    "array<struct<index:bigint,x:double,y:double,latitude:double,longitude:double,state:string,source_count:bigint,unknown_sources:bigint,unresolved_sources:bigint,"
    f"best_margin_db:double,best_source_id:string,sources:array<{SOURCE}>>>"
)


def antenna(spark: SparkSession, path: str) -> DataFrame:
    """(angle, gain) of a pattern file, columns found by name, a byte order mark allowed, sorted by angle; rows that
    aren't numbers are left out."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    named = {c.strip("﻿ ").lower(): c for c in raw.columns}
    get = lambda name: F.col(f"`{named[name]}`").try_cast("double")
    return raw.select(get("elevation_deg").alias("angle"), get("gain_dbi").alias("gain")).dropna().orderBy("angle")


def cells(spark: SparkSession, path: str, line_cap: int = 5_000_000) -> DataFrame:
    """Stored cells, one JSON array of cells a line; a line beyond the cap is an error, not cut."""
    lines = spark.read.text(path)
    text = F.when(F.length("value") > line_cap, F.raise_error(F.lit("a line of cells is beyond the cap"))).otherwise(F.col("value"))
    return lines.select(F.explode(F.from_json(text, CELL)).alias("c")).select("c.*")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """(id, geometry_type, coordinates JSON, name, minimum_margin_db, reference_id) of a feature collection; features
    of other geometry, and a negative margin, are left out."""
    f = spark.read.option("multiLine", True).schema("features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<name:string,minimum_margin_db:double,reference_id:string>>>").json(path)
    f = f.select(F.posexplode("features").alias("pos", "f")).filter(F.col("f.geometry.type").isin("Point", "LineString", "Polygon"))
    margin = F.coalesce("f.properties.minimum_margin_db", F.lit(0.0))
    return f.filter(margin >= 0).select(
        F.concat(F.lit("T"), (F.col("pos") + 1).cast("string")).alias("id"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"),
        F.coalesce("f.properties.name", F.lit("")).alias("name"), margin.alias("minimum_margin_db"), F.col("f.properties.reference_id").alias("reference_id"),
    )


def roads(spark: SparkSession, path: str) -> DataFrame:
    """(way, x1, y1, x2, y2) segments of a map extract's ways; coordinates may be text; a remark is an error;
    a way that comes twice counts once."""
    schema = "remark string, elements array<struct<type:string,id:bigint,geometry:array<struct<lat:string,lon:string>>>>"
    e = spark.read.option("multiLine", True).schema(schema).json(path)
    e = e.select(F.when(F.col("remark").isNotNull(), F.raise_error(F.concat(F.lit("road server: "), "remark"))).otherwise(F.col("elements")).alias("elements"))
    w = e.select(F.explode("elements").alias("e")).filter("e.type = 'way'").select(F.col("e.id").alias("way"), "e.geometry").dropDuplicates(["way"])
    p = w.select("way", F.posexplode("geometry").alias("i", "p"), "geometry")
    to = F.try_element_at("geometry", F.col("i") + 2)
    d = lambda c: c.try_cast("double")
    return p.select("way", d(F.col("p.lon")).alias("x1"), d(F.col("p.lat")).alias("y1"), d(to["lon"]).alias("x2"), d(to["lat"]).alias("y2")).dropna()


def near_roads(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """Points within reach of a segment, with the distance. Segments go to the squares of side `reach` that
    their widened boxes meet; a point looks in its own."""
    from airlattice.functions.geo import segment_distance

    key = lambda c: F.floor(c / F.lit(reach)).cast("bigint")
    span = lambda a, b: F.sequence(key(F.least(a, b) - reach), key(F.greatest(a, b) + reach))
    s = segments.withColumn("gx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("gy", F.explode(span(F.col("y1"), F.col("y2"))))
    p = points.withColumns({"gx": key(F.col("x")), "gy": key(F.col("y"))})
    d = segment_distance(F.col("x"), F.col("y"), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    return p.join(s, ["gx", "gy"]).groupBy(*points.columns).agg(F.min(d).alias("road_m")).filter(F.col("road_m") <= reach)


RECEPTION = "id bigint, hash string, timestamp string, first_seen string, observer_id string, observer_name string, rssi double, snr double, path_json string, resolved_path array<string>, route_type int, payload_type int, direction string, observation_count int, decoded_json string"


_INNER = ",".join(":".join(c.split(" ", 1)) for c in RECEPTION.split(", "))
PAGE = f"packets array<struct<{_INNER},observations:array<struct<{_INNER}>>>>, total bigint, offset bigint"


def packet_pages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Packets of page files; expanded receptions stand in `observations`. Descending ids are checked by page_faults."""
    reader = spark.readStream if streaming else spark.read
    return page_packets(reader.schema(PAGE).option("multiLine", True).json(path))


def page_packets(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("offset"), F.posexplode("packets").alias("pos", "p")).select("offset", "pos", "p.*")


def page_faults(packets: DataFrame) -> DataFrame:
    """Places in a page where an id doesn't fall below the one before."""
    from pyspark.sql import Window

    before = F.lag("id").over(Window.partitionBy("offset").orderBy("pos"))  # a page is bounded by the server
    return packets.withColumn("before", before).filter("before <= id").select("offset", "pos", "id", "before")
