"""Sinks: stored cells, route tables, GeoJSON, overlays, and thinned profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 20


def cell_lines(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """K1: (job_id, chunk, value): a JSON array of a chunk's cells in order. cells: job_id, index, other columns."""
    row = F.struct("index", *(c for c in cells.columns if c not in ("index", "job_id")))
    lines = cells.groupBy("job_id", F.expr(f"index div {chunk}").alias("chunk")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))
    return lines.select("job_id", "chunk", "value")


def write_cell_lines(cells: DataFrame, path: str) -> None:
    """Text files by run, chunks in order within each; a run's lines are bounded by the grid's limit."""
    lines = cell_lines(cells).repartition("job_id").sortWithinPartitions("job_id", "chunk")
    lines.select("job_id", "value").write.mode("overwrite").partitionBy("job_id").text(path)


def fixed(c: str, places: int):
    return F.format_string(f"%.{places}f", F.col(c))


# The columns of a route table.
ROUTE_FIELDS = ["hop", "from", "to", "distance_km", "fspl_db", "diffraction_loss_db", "total_path_loss_db", "rx_power_dbm", "sensitivity_dbm", "raw_margin_db", "fade_adjusted_margin_db", "reverse_margin_db", "worst_margin_db", "minimum_fresnel_clearance_percent", "los_clear", "valid"]
ROUTE_PLACES = {"distance_km": 3, "minimum_fresnel_clearance_percent": 1}


def route_csv(links: DataFrame) -> DataFrame:
    """K5: (hop, value): lines of a route table, the header as hop 0. links has ROUTE_FIELDS; numbers come in fixed decimals,
    flags as True and False, nulls empty, text quoted where it must be."""
    flag = lambda c: F.when(F.col(c), "True").when(~F.col(c), "False").otherwise("")
    text = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))

    def one(c: str):
        if c in ("los_clear", "valid"):
            return flag(c)
        if c in ("from", "to"):
            return text(c)
        return F.col(c).cast("string") if c == "hop" else F.when(F.col(c).isNull(), "").otherwise(fixed(c, ROUTE_PLACES.get(c, 2)))

    rows = links.select("hop", F.concat_ws(",", *(one(c) for c in ROUTE_FIELDS)).alias("value"))
    head = links.sparkSession.createDataFrame([(0, ",".join(ROUTE_FIELDS))], "hop int, value string")
    return head.unionByName(rows.withColumn("hop", F.col("hop").cast("int")))


def route_features(links: DataFrame, sites: DataFrame) -> DataFrame:
    """K6: (place, value): GeoJSON features of a route, its sites as points and its links as lines. sites: id, lon, lat, kind."""
    feature = lambda kind, at, props: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), at.alias("coordinates")).alias("geometry"), props.alias("properties")))
    points = sites.select(F.concat(F.lit("0/"), "id").alias("place"), feature("Point", F.array("lon", "lat"), F.struct("id", "kind")).alias("value"))
    end = lambda c: sites.select(F.col("id").alias(c), F.array("lon", "lat").alias(f"{c}_at"))
    lines = links.join(end("from"), "from").join(end("to"), "to")
    lines = lines.select(F.concat(F.lit("1/"), F.lpad(F.col("hop").cast("string"), 6, "0")).alias("place"), feature("LineString", F.array("from_at", "to_at"), F.struct("from", "to", "valid")).alias("value"))
    return points.unionByName(lines)


def write_route_csv(links: DataFrame, path: str) -> None:
    route_csv(links).coalesce(1).sortWithinPartitions("hop").select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def cell_features(cells: DataFrame, half: float) -> DataFrame:
    """K7: (index, value): a GeoJSON feature of each cell, without geometry outside the area. cells: index, x, y, state."""
    x, y = F.col("x"), F.col("y")
    ring = F.array(*(F.array(x + a * half, y + b * half) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    geometry = F.when(F.col("state") != "outside_area", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("index", "state").alias("properties"))
    return cells.select("index", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def overlay(cells: DataFrame, spacing: float, side: int = 384) -> DataFrame:
    """(job_id, px, py, state): each pixel of a run's picture with the state of the cell it lies in; at most side pixels
    a side. Pixels are made per cell, so no picture is compared with all cells."""
    b = cells.groupBy("job_id").agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s")) + spacing
    c = cells.join(b.withColumn("step", size / side), "job_id")
    pixel = lambda v, low: F.ceil((v - F.col(low) + spacing / 2) / F.col("step") - 0.5)
    span = lambda c_, low: F.sequence(pixel(F.col(c_) - spacing / 2, low), pixel(F.col(c_) + spacing / 2, low) - 1)
    grow = lambda d, o, c_, low: d.filter(pixel(F.col(c_) + spacing / 2, low) > pixel(F.col(c_) - spacing / 2, low)).withColumn(o, F.explode(span(c_, low)))
    return grow(grow(c, "px", "x", "w"), "py", "y", "s").select("job_id", "px", "py", "state")


def thin_profile(samples: DataFrame, most: int = 1000) -> DataFrame:
    """At most `most` samples of each link, its lowest and highest in every stride kept, and both ends. samples:
    link_id, i, n, h. The extremes carry their samples through one aggregation: nothing is joined back, so no list of what
    is kept goes to the driver, however few bytes the links took when they were read."""
    stride = F.greatest(F.ceil(F.col("n") * 2 / F.lit(most - 2)).cast("int"), F.lit(1))
    end = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    s = samples.select("link_id", "i", "n", "h")
    ext = s.groupBy("link_id", F.floor(F.col("i") / stride).alias("bin")).agg(F.min(F.struct("h", "i", "n")).alias("lo"), F.max(F.struct("h", F.negative("i").alias("j"), "n")).alias("hi"))
    lo, hi = F.struct("lo.i", "lo.n", "lo.h"), F.struct(F.negative("hi.j").alias("i"), "hi.n", "hi.h")
    inner = ext.select("link_id", F.explode(F.array_distinct(F.array(lo, hi))).alias("s")).select("link_id", "s.*").filter(~end)
    return inner.unionByName(s.filter(end))


def ordered_links(links: DataFrame, path: DataFrame) -> DataFrame:
    """A route's links, first those of the primary path in its order, then the others by id. path: pos, a, b."""
    key = lambda d: d.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    at = key(path).select("lo", "hi", "pos")
    return key(links).join(at, ["lo", "hi"], "left").withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("pos"), "lo", "hi"))).drop("lo", "hi", "pos")
