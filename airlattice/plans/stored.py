"""Sources and sinks as queries: what is written in a stored form, and read back, is what the tables hold.

Rasters are encoded and decoded, cells go through their lines of JSON, packets through pages, receptions through the merge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from airlattice.plans import coverage, mesh
from airlattice.plans.registry import Registry
from airlattice.sources import feeds, raster, sinks
from airlattice.streaming import ingest
from airlattice.tables import load, norm_id

query = Registry()
QUERIES, ORACLE = query.QUERIES, query.ORACLE
_C = coverage._CTE
EPSG = 25833


def run_rasters(spark, d):
    """A file a run: best margins, one pixel a cell, not a number where there is none; a mask leaves out what is no cell of the
    area. Runs take turns in being compressed. A run's cells are bounded by the grid's limit."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        h = float(t.h.iloc[0])
        west, north = float(t.w.iloc[0]), float(t.n.iloc[0])
        col, row = np.rint((t.x.to_numpy() - west) / (2 * h) - 0.5).astype(int), np.rint((north - t.y.to_numpy()) / (2 * h) - 0.5).astype(int)
        a = np.full((row.max() + 1, col.max() + 1), np.nan)
        mask = np.zeros(a.shape, bool)
        a[row, col], mask[row, col] = t.best_margin_db.to_numpy(float), t.state.to_numpy() != "outside_area"
        content = raster.encode(a, west, north, 2 * h, EPSG, compressed=len(t) % 2 == 0, mask=mask)
        return pd.DataFrame({"path": [key[0]], "priority": [0], "content": [content]})

    return coverage.footprints(spark, d).groupBy("job_id").applyInPandas(run, "path string, priority int, content binary")


def milli(c):
    return F.floor(c * 1000.0 + 0.5) / 1000.0


_MILLI = "floor({} * 1000e0 + 0.5e0) / 1000e0"


@query("s1_raster_cells", _C + f" SELECT job_id, {_MILLI.format('x')} AS x, {_MILLI.format('y')} AS y, best_margin_db AS z, {EPSG} AS epsg FROM cells WHERE state <> 'outside_area'")
def s1(spark, d):
    """The pixels that files of the runs hold, with their centres."""
    b = raster.decoded(run_rasters(spark, d))
    p = b.select("path", "west", "north", "dx", "dy", "row0", "col0", "cols", "epsg", F.posexplode(F.arrays_zip("z", "masked")).alias("at", "p")).filter("not p.masked")
    x = F.col("west") + (F.col("col0") + F.col("at") % F.col("cols") + 0.5) * F.col("dx")
    y = F.col("north") - (F.col("row0") + F.floor(F.col("at") / F.col("cols")) + 0.5) * F.col("dy")
    return p.select(F.col("path").alias("job_id"), milli(x).alias("x"), milli(y).alias("y"), F.col("p.z").alias("z"), "epsg")


@query("s10_mosaic_sample", _C + coverage._FOOT + """, pt AS (SELECT DISTINCT x + h / 2 AS px, y - h / 2 AS py FROM foot),
  hit AS (SELECT px, py, f.best_margin_db AS z, f.job_id FROM pt JOIN foot f ON px >= f.x - f.h AND px < f.x + f.h AND py <= f.y + f.h AND py > f.y - f.h AND f.state <> 'outside_area'),
  fi AS (SELECT px, py, arg_min(z, job_id) FILTER (WHERE z IS NOT NULL) AS zz, min(job_id) AS j, min(job_id) FILTER (WHERE z IS NOT NULL) AS jz FROM hit GROUP BY ALL)
  SELECT pt.px AS x, pt.py AS y, CASE WHEN fi.j = fi.jz THEN fi.zz END AS z FROM pt LEFT JOIN fi ON fi.px = pt.px AND fi.py = pt.py""")
def s10(spark, d):
    """Points beside the centres of all runs' cells, from the mosaic of all runs' files, the first by id before."""
    from pyspark.sql import Window

    files = run_rasters(spark, d).withColumn("priority", F.row_number().over(Window.orderBy("path")).cast("int"))  # a row a run
    f = coverage.footprints(spark, d)
    points = f.select((F.col("x") + F.col("h") / 2).alias("x"), (F.col("y") - F.col("h") / 2).alias("y")).distinct()
    return raster.sample(points, raster.decoded(files))


@query("s13_cell_lines", _C + """ SELECT job_id, cell, state, source_count, unknown_sources, unresolved_sources, best_margin_db, best_source_id, CAST(len(sources) AS INT) AS sources,
  CAST(len(list_filter(sources, lambda s: s.valid_two_way)) AS INT) AS valid FROM cells""")
def s13(spark, d):
    """Cells with their sources through lines of 20 as JSON."""
    stored = ["x", "y", "latitude", "longitude", "state", "source_count", "unknown_sources", "unresolved_sources", "best_margin_db", "best_source_id", "sources"]
    lines = sinks.cell_lines(coverage.cells(spark, d).withColumnRenamed("cell", "index").select("job_id", "index", *stored))
    c = lines.select("job_id", F.explode(F.from_json("value", feeds.CELL)).alias("c"))
    sources = F.col("c.sources")
    return c.select(
        "job_id", F.col("c.index").alias("cell"), "c.state", "c.source_count", "c.unknown_sources", "c.unresolved_sources", "c.best_margin_db", "c.best_source_id",
        F.when(sources.isNotNull(), F.size(sources)).alias("sources"), F.when(sources.isNotNull(), F.size(F.filter(sources, lambda s: s["valid_two_way"]))).alias("valid"),
    )


@query("s23_page_receptions", """WITH p AS (SELECT DISTINCT endpoint, id, observer_id, rssi, snr, observations FROM packets),
  r AS (SELECT endpoint, id, unnest(observations) AS o FROM p WHERE len(observations) > 0),
  a AS (SELECT endpoint, id, o.id AS oid, o.observer_id AS observer_id, o.rssi AS rssi, o.snr AS snr FROM r UNION ALL SELECT endpoint, id, NULL, observer_id, rssi, snr FROM p WHERE coalesce(len(observations), 0) = 0)
  SELECT endpoint, id AS packet_id, coalesce('id:' || oid, 'observer:' || observer_id) AS observation_key, rssi, snr FROM a WHERE oid IS NOT NULL OR observer_id IS NOT NULL""")
def s23(spark, d):
    """Receptions of packets that come as pages of JSON, descending in each; a page is a range of ids."""
    fields = [c.split(" ", 1)[0] for c in feeds.RECEPTION.split(", ")]
    p = load(spark, d, "packets")
    inner = F.transform("observations", lambda o: F.struct(*(o[c].alias(c) for c in ("id", "timestamp", "observer_id", "observer_name", "rssi", "snr", "path_json", "direction"))))
    p = p.select("endpoint", F.struct(*fields, inner.alias("observations")).alias("p")).distinct()
    pages = p.groupBy("endpoint", F.expr("p.id div 256").alias("page")).agg(F.sort_array(F.collect_list("p"), asc=False).alias("packets"))
    text = F.to_json(F.struct("packets", F.size("packets").cast("bigint").alias("total"), F.col("page").alias("offset")))
    read = pages.select("endpoint", F.from_json(text, feeds.PAGE).alias("j")).select("endpoint", "j.*")
    packets = read.select("endpoint", "offset", F.posexplode("packets").alias("pos", "p")).select("endpoint", "offset", "pos", "p.*")
    return ingest.receptions(packets, F.col("endpoint")).select("endpoint", "packet_id", "observation_key", "rssi", "snr")


@query("k14_merged_receptions", mesh._CTE + """, x AS (SELECT endpoint, packet_id, max(CASE WHEN observation_key LIKE 'id:%' THEN 1 ELSE 0 END) AS expanded FROM obs GROUP BY ALL)
  SELECT o.endpoint, o.packet_id, o.observation_key, o.rssi, o.observer_name FROM obs o JOIN x ON x.endpoint = o.endpoint AND x.packet_id = o.packet_id WHERE o.observation_key LIKE 'id:%' OR x.expanded = 0""")
def k14(spark, d):
    """A store that holds every other packet, a third of them without readings, meets all receptions: what is there
    stays, what is missing is filled in, and a packet's stand-in goes where its own receptions are."""
    o = mesh.observations(spark, d, "rssi", "observer_name")
    third = F.col("packet_id") % 3 == 0
    stored = o.filter("packet_id % 2 = 0").withColumns({c: F.when(~third, F.col(c)) for c in ("rssi", "observer_name")})
    merged = ingest.merge(stored, o.withColumn("arrival", F.col("packet_id")), ["rssi", "observer_name"])
    return merged.select("endpoint", "packet_id", "observation_key", "rssi", "observer_name")


@query("s24_observer_store", f"""SELECT endpoint, {mesh._ID.format('observer_id')} AS observer_id, count(*) AS receptions, count(DISTINCT packet_id) AS packets FROM (SELECT DISTINCT * FROM observations) WHERE observer_id <> '' GROUP BY ALL""")
def s24(spark, d):
    """What the store of receptions holds of each observer; a hot observer is counted by packet first."""
    o = load(spark, d, "observations").select("endpoint", "packet_id", "observation_key", norm_id("observer_id").alias("observer_id")).filter("observer_id is not null").distinct()
    by = o.groupBy("endpoint", "observer_id", "packet_id").agg(F.count("*").alias("n"))
    return by.groupBy("endpoint", "observer_id").agg(F.sum("n").alias("receptions"), F.count("*").alias("packets"))
