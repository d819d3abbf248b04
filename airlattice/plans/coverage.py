"""Analysis of stored coverage runs: counts, modes, failures, comparisons, targets, reconstruction, and graphs of sources.

A doubled cell is one; an entry without source id is left out. Runs of one endpoint are compared in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.operators import graph
from airlattice.plans.registry import Registry
from airlattice.tables import load

query = Registry()
QUERIES, ORACLE = query.QUERIES, query.ORACLE


def cells(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "coverage").withColumnRenamed("index", "cell")
    return c.dropDuplicates(["job_id", "cell"])


def entries(spark: SparkSession, d: str) -> DataFrame:
    """A row a cell and source, by its entry's place in the list."""
    e = load(spark, d, "coverage").select("job_id", "endpoint", F.col("index").alias("cell"), F.posexplode("sources").alias("pos", "s"))
    e = e.select("job_id", "endpoint", "cell", "pos", "s.*").filter("source_id is not null and source_id <> ''")
    return e.dropDuplicates(["job_id", "cell", "pos"])


_CTE = """WITH
  cells AS (SELECT DISTINCT ON (job_id, "index") *, "index" AS cell FROM coverage),
  e0 AS (SELECT job_id, endpoint, cell, unnest(sources) AS s, generate_subscripts(sources, 1) - 1 AS pos FROM cells),
  e AS (SELECT job_id, endpoint, cell, pos, s.source_id AS source_id, s.downlink_margin_db AS downlink_margin_db, s.uplink_margin_db AS uplink_margin_db,
        s.two_way_margin_db AS two_way_margin_db, s.valid_downlink AS valid_downlink, s.valid_uplink AS valid_uplink, s.valid_two_way AS valid_two_way, s.rejection AS rejection
        FROM e0 WHERE s.source_id <> '')"""


@query("a1_cell_rollup", _CTE + """, r AS (SELECT job_id, cell, count(*) FILTER (WHERE valid_two_way) AS usable, count(*) FILTER (WHERE rejection = 'missing terrain') AS unknown,
    count(*) FILTER (WHERE rejection = 'profile cap') AS unresolved, max(two_way_margin_db) FILTER (WHERE valid_two_way) + 0e0 AS best_db FROM e GROUP BY ALL),
  b AS (SELECT job_id, cell, source_id FROM e WHERE valid_two_way QUALIFY row_number() OVER (PARTITION BY job_id, cell ORDER BY two_way_margin_db DESC, pos) = 1)
  SELECT r.*, b.source_id AS best_source FROM r LEFT JOIN b USING (job_id, cell)""")
def a1(spark, d):
    """The best source is the first in the list among equals."""
    e, ok = entries(spark, d), F.col("valid_two_way")
    best = F.max(F.when(ok, F.struct("two_way_margin_db", -F.col("pos"), "source_id")))
    return e.groupBy("job_id", "cell").agg(
        F.count_if(ok).alias("usable"), F.count_if(F.col("rejection") == "missing terrain").alias("unknown"), F.count_if(F.col("rejection") == "profile cap").alias("unresolved"), best.alias("b")
    ).select("job_id", "cell", "usable", "unknown", "unresolved", (F.col("b.two_way_margin_db") + 0.0).alias("best_db"), F.col("b.source_id").alias("best_source"))


@query("a2_cell_state", _CTE + """, r AS (SELECT job_id, cell, count(*) FILTER (WHERE valid_two_way) AS n_u, count(*) FILTER (WHERE rejection = 'missing terrain') AS n_k, count(*) FILTER (WHERE rejection = 'profile cap') AS n_x FROM e GROUP BY ALL)
  SELECT c.job_id, c.cell, CASE WHEN c.state = 'outside_area' THEN 'outside_area' WHEN n_u > 0 THEN 'covered' WHEN n_x > 0 THEN 'unresolved' WHEN n_k > 0 THEN 'unknown_terrain' ELSE 'uncovered' END AS derived FROM cells c LEFT JOIN r USING (job_id, cell)""")
def a2(spark, d):
    r = a1(spark, d)
    s = F.when(F.col("state") == "outside_area", "outside_area").when(F.col("usable") > 0, "covered").when(F.col("unresolved") > 0, "unresolved").when(F.col("unknown") > 0, "unknown_terrain").otherwise("uncovered")
    return cells(spark, d).select("job_id", "cell", "state").join(r, ["job_id", "cell"], "left").select("job_id", "cell", s.alias("derived"))


_STATES = "covered uncovered unresolved unknown_terrain not_evaluated outside_area".split()


@query("a5_state_counts", _CTE + " SELECT job_id, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in _STATES) + " FROM cells GROUP BY job_id")
def a5(spark, d):
    return cells(spark, d).groupBy("job_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in _STATES))


@query("pp11_usable_by_mode", _CTE + """ SELECT job_id, cell, max(downlink_margin_db) FILTER (WHERE valid_downlink) + 0e0 AS downlink, max(uplink_margin_db) FILTER (WHERE valid_uplink) + 0e0 AS uplink,
  max(two_way_margin_db) FILTER (WHERE valid_two_way) + 0e0 AS two_way, count(*) FILTER (WHERE valid_two_way) AS overlap FROM e GROUP BY ALL""")
def pp11(spark, d):
    m = lambda x: (F.max(F.when(F.col(f"valid_{x}"), F.col(f"{x}_margin_db"))) + 0.0).alias(x)
    return entries(spark, d).groupBy("job_id", "cell").agg(m("downlink"), m("uplink"), m("two_way"), F.count_if("valid_two_way").alias("overlap"))


@query("f38_colour_classes", _CTE + """, m AS (SELECT job_id, cell, unnest(['downlink', 'uplink', 'two_way', 'overlap']) AS mode FROM cells), x AS (SELECT m.job_id, m.cell, m.mode,
    max(CASE m.mode WHEN 'downlink' THEN CASE WHEN valid_downlink THEN downlink_margin_db END WHEN 'uplink' THEN CASE WHEN valid_uplink THEN uplink_margin_db END ELSE CASE WHEN valid_two_way THEN two_way_margin_db END END) AS best,
    count(*) FILTER (WHERE valid_two_way) AS n FROM m LEFT JOIN e ON e.job_id = m.job_id AND e.cell = m.cell GROUP BY ALL)
  SELECT job_id, mode, CASE WHEN mode = 'overlap' THEN CASE n WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END WHEN best >= 10 THEN 1 WHEN best >= 5 THEN 2 WHEN best >= 0 THEN 3 ELSE 4 END AS colour, count(*) AS n_cells FROM x GROUP BY ALL""")
def f38(spark, d):
    """A cell's colour class in each mode: by the best usable margin, in overlap by the number of usable sources."""
    m = pp11(spark, d)
    c = cells(spark, d).select("job_id", "cell").join(m, ["job_id", "cell"], "left")
    by = lambda v: F.when(v >= 10, 1).when(v >= 5, 2).when(v >= 0, 3).otherwise(4)
    over = F.greatest(F.lit(4) - F.coalesce("overlap", F.lit(0)), F.lit(1)).cast("int")
    modes = F.array(*(F.struct(F.lit(x).alias("mode"), by(F.col(x)).alias("colour")) for x in ("downlink", "uplink", "two_way")), F.struct(F.lit("overlap").alias("mode"), over.alias("colour")))
    return c.select("job_id", F.explode(modes).alias("m")).groupBy("job_id", "m.mode", "m.colour").agg(F.count("*").alias("n_cells"))


@query("pp20_grid_reconstruction", _CTE + """, g AS (SELECT job_id, unnest(range(max(cell) + 1)) AS cell FROM cells GROUP BY job_id)
  SELECT g.job_id, g.cell, coalesce(c.state, 'not_evaluated') AS state FROM g LEFT JOIN cells c USING (job_id, cell)""")
def p20(spark, d):
    c = cells(spark, d).select("job_id", "cell", "state")
    g = c.groupBy("job_id").agg(F.max("cell").alias("m")).select("job_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("cell"))
    return g.join(c, ["job_id", "cell"], "left").select("job_id", "cell", F.coalesce("state", F.lit("not_evaluated")).alias("state"))


@query("w9_gaps", _CTE + """, m AS (SELECT job_id, cell, latitude IS NULL OR longitude IS NULL AS gap FROM cells), r AS (SELECT *, cell - row_number() OVER (PARTITION BY job_id, gap ORDER BY cell) AS island FROM m)
  SELECT job_id, min(cell) AS first_cell, max(cell) AS last_cell, count(*) AS n FROM r WHERE gap GROUP BY job_id, island""")
def w9(spark, d):
    """C11: runs of consecutive cells without a centre. A job's cells are bounded by the grid's limit."""
    m = cells(spark, d).filter("latitude is null or longitude is null").select("job_id", "cell")
    m = m.withColumn("island", F.col("cell") - F.row_number().over(Window.partitionBy("job_id").orderBy("cell")))
    return m.groupBy("job_id", "island").agg(F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"), F.count("*").alias("n")).drop("island")


def run_steps(spark, d) -> DataFrame:
    j = load(spark, d, "coverage").select("endpoint", "job_id").distinct()
    return j.select("endpoint", F.col("job_id").alias("scenario"), F.lag("job_id").over(Window.partitionBy("endpoint").orderBy("job_id")).alias("baseline")).filter("baseline is not null")


_STEPS = """, steps AS (SELECT endpoint, job_id AS scenario, lag(job_id) OVER (PARTITION BY endpoint ORDER BY job_id) AS baseline FROM (SELECT DISTINCT endpoint, job_id FROM coverage)),
  both_ AS (SELECT coalesce(b.scenario, s.scenario) AS scenario, coalesce(b.cell, s.cell) AS cell, b.state AS old, s.state AS new, b.best AS old_db, s.best AS new_db FROM
    (SELECT t.scenario, c.cell, c.state, c.best_margin_db AS best FROM steps t JOIN cells c ON c.job_id = t.baseline) b
    FULL JOIN (SELECT t.scenario, c.cell, c.state, c.best_margin_db AS best FROM steps t JOIN cells c ON c.job_id = t.scenario WHERE t.baseline IS NOT NULL) s ON b.scenario = s.scenario AND b.cell = s.cell),
  k AS (SELECT *, CASE WHEN 'outside_area' IN (coalesce(old, 'outside_area'), coalesce(new, 'outside_area')) THEN 'outside' WHEN 'unresolved' IN (old, new) THEN 'unresolved'
    WHEN 'unknown_terrain' IN (old, new) OR 'not_evaluated' IN (old, new) THEN 'unknown' WHEN old = 'covered' AND new = 'covered' THEN 'retained' WHEN old = 'covered' THEN 'lost' WHEN new = 'covered' THEN 'gained' ELSE 'none' END AS change FROM both_)"""


def compared(spark, d) -> DataFrame:
    """Cells of consecutive runs side by side; precedence outside, unresolved, unknown, then gained, lost, retained, none."""
    s, c = run_steps(spark, d), cells(spark, d).select("job_id", "cell", "state", F.col("best_margin_db").alias("best"))
    b = s.join(c, s.baseline == c.job_id).select("scenario", "cell", F.col("state").alias("old"), F.col("best").alias("old_db"))
    n = s.join(c, s.scenario == c.job_id).select("scenario", "cell", F.col("state").alias("new"), F.col("best").alias("new_db"))
    both = b.join(n, ["scenario", "cell"], "full")
    out = lambda x: F.coalesce(x, F.lit("outside_area")) == "outside_area"
    either = lambda *v: F.coalesce(F.col("old").isin(*v), F.lit(False)) | F.coalesce(F.col("new").isin(*v), F.lit(False))
    was, now = F.col("old") == "covered", F.col("new") == "covered"
    change = F.when(out("old") | out("new"), "outside").when(either("unresolved"), "unresolved").when(either("unknown_terrain", "not_evaluated"), "unknown")
    return both.withColumn("change", change.when(was & now, "retained").when(was, "lost").when(now, "gained").otherwise("none"))


@query("c7_run_comparison", _CTE + _STEPS + " SELECT scenario, cell, change FROM k")
def c7(spark, d):
    return compared(spark, d).select("scenario", "cell", "change")


@query("a18_comparison_counts", _CTE + _STEPS + " SELECT scenario, change, count(*) AS n, count(*) FILTER (WHERE isfinite(old_db) AND isfinite(new_db)) AS with_delta FROM k GROUP BY ALL")
def a18(spark, d):
    return compared(spark, d).groupBy("scenario", "change").agg(F.count("*").alias("n"), F.count_if(F.col("old_db").isNotNull() & F.col("new_db").isNotNull()).alias("with_delta"))


@query("c9_report_changes", _CTE + _STEPS + """ SELECT scenario, CASE WHEN old_db IS NULL OR new_db IS NULL THEN 'uncertain' WHEN new_db > old_db THEN 'improved' WHEN new_db < old_db THEN 'regressed' ELSE 'unchanged' END AS outcome, count(*) AS n FROM k WHERE old IS NOT NULL AND new IS NOT NULL GROUP BY ALL""")
def c9(spark, d):
    """Rows of two runs by id, improved, regressed, unchanged, or uncertain without a margin on both sides."""
    o = F.when(F.col("old_db").isNull() | F.col("new_db").isNull(), "uncertain").when(F.col("new_db") > F.col("old_db"), "improved").when(F.col("new_db") < F.col("old_db"), "regressed").otherwise("unchanged")
    return compared(spark, d).filter("old is not null and new is not null").groupBy("scenario", o.alias("outcome")).agg(F.count("*").alias("n"))


_EDGES = """, ed AS (SELECT a.source_id AS a, b.source_id AS b, max(least(a.two_way_margin_db, b.two_way_margin_db)) + 0e0 AS w FROM e a JOIN e b ON a.job_id = b.job_id AND a.cell = b.cell AND a.source_id < b.source_id
  WHERE a.valid_two_way AND b.valid_two_way GROUP BY ALL), nd AS (SELECT DISTINCT source_id AS id FROM e)"""


def shared_cell_edges(spark, d) -> DataFrame:
    """Sources that serve a common cell, with the best of the lesser margins. A cell has at most a grid's sources."""
    s = entries(spark, d).filter("valid_two_way").groupBy("job_id", "cell").agg(F.collect_set(F.struct("source_id", "two_way_margin_db")).alias("l"))
    s = s.filter(F.size("l") > 1).select(F.explode("l").alias("x"), "l").select("x", F.explode("l").alias("y")).filter("x.source_id < y.source_id")
    return graph.best_edges(s.select(F.col("x.source_id").alias("a"), F.col("y.source_id").alias("b"), (F.least("x.two_way_margin_db", "y.two_way_margin_db") + 0.0).alias("w")))


@query("j17_best_edges", _CTE + _EDGES + " SELECT a, b, w FROM ed")
def j17(spark, d):
    return shared_cell_edges(spark, d)


@query("g9_components", f"""{_CTE.replace("WITH", "WITH RECURSIVE", 1)}{_EDGES}, r AS (SELECT id AS a, id AS b FROM nd UNION SELECT r.a, CASE WHEN ed.a = r.b THEN ed.b ELSE ed.a END FROM r JOIN ed ON ed.a = r.b OR ed.b = r.b)
  SELECT a AS id, min(b) AS root FROM r GROUP BY a""")
def g9(spark, d):
    nodes = entries(spark, d).select(F.col("source_id").alias("id")).distinct()
    return graph.components(nodes, shared_cell_edges(spark, d))


@query("g1_hop_distance", f"""{_CTE.replace("WITH", "WITH RECURSIVE", 1)}{_EDGES}, r AS (SELECT min(id) AS id, 0 AS hops FROM nd UNION SELECT CASE WHEN ed.a = r.id THEN ed.b ELSE ed.a END, hops + 1 FROM r JOIN ed ON ed.a = r.id OR ed.b = r.id WHERE hops < (SELECT count(*) FROM nd))
  SELECT id, min(hops) AS hops FROM r GROUP BY id""")
def g1(spark, d):
    first = entries(spark, d).agg(F.min("source_id").alias("id"))
    return graph.hop_distance(shared_cell_edges(spark, d), first)


@query("g2_widest_margin", f"""{_CTE.replace("WITH", "WITH RECURSIVE", 1)}{_EDGES}, em AS MATERIALIZED (SELECT a, b, w FROM ed UNION ALL SELECT b, a, w FROM ed), r AS (SELECT min(id) AS id, CAST('inf' AS DOUBLE) AS margin FROM nd
  UNION SELECT em.b, least(r.margin, em.w) FROM r JOIN em ON em.a = r.id) SELECT id, max(margin) AS margin FROM r WHERE id <> (SELECT min(id) FROM nd) GROUP BY id""")
def g2(spark, d):
    first = entries(spark, d).agg(F.min("source_id").alias("id"))
    return graph.widest(shared_cell_edges(spark, d), first).filter("margin < double('inf')")


_FAIL = """, busiest AS (SELECT job_id, source_id AS failed FROM e WHERE valid_two_way GROUP BY job_id, source_id QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, source_id) = 1),
  u AS (SELECT e.job_id, e.cell, count(DISTINCT source_id) AS before_, count(DISTINCT source_id) FILTER (WHERE source_id <> failed) AS after_ FROM e JOIN busiest b ON b.job_id = e.job_id WHERE valid_two_way GROUP BY ALL),
  sv AS (SELECT job_id, count(*) AS served, count(*) FILTER (WHERE after_ = 0) AS lost_cells, count(*) FILTER (WHERE after_ = 1) AS single_source FROM u GROUP BY job_id),
  jn AS (SELECT DISTINCT job_id, source_id AS id FROM e WHERE job_id IN (SELECT job_id FROM busiest)),
  je AS MATERIALIZED (SELECT DISTINCT a.job_id, a.source_id AS a, b.source_id AS b FROM e a JOIN e b ON a.job_id = b.job_id AND a.cell = b.cell AND a.source_id <> b.source_id WHERE a.valid_two_way AND b.valid_two_way),
  r0 AS (SELECT job_id, id AS a, id AS b FROM jn UNION SELECT r0.job_id, r0.a, je.b FROM r0 JOIN je ON je.job_id = r0.job_id AND je.a = r0.b),
  jf AS (SELECT jn.* FROM jn JOIN busiest USING (job_id) WHERE id <> failed),
  r1 AS (SELECT job_id, id AS a, id AS b FROM jf UNION SELECT r1.job_id, r1.a, je.b FROM r1 JOIN je ON je.job_id = r1.job_id AND je.a = r1.b JOIN busiest f ON f.job_id = je.job_id AND f.failed <> je.b),
  n0 AS (SELECT job_id, count(*) FILTER (WHERE a = m) AS n FROM (SELECT job_id, a, min(b) AS m FROM r0 GROUP BY ALL) GROUP BY job_id),
  n1 AS (SELECT job_id, count(*) FILTER (WHERE a = m) AS n FROM (SELECT job_id, a, min(b) AS m FROM r1 GROUP BY ALL) GROUP BY job_id)"""


@query("c5_node_failure", _CTE.replace("WITH", "WITH RECURSIVE", 1) + _FAIL + """ SELECT sv.job_id, failed, served, lost_cells, single_source, n0.n AS parts_before, coalesce(n1.n, 0) AS parts_after
  FROM sv JOIN busiest USING (job_id) JOIN n0 USING (job_id) LEFT JOIN n1 USING (job_id)""")
def c5(spark, d):
    """With each run's busiest source failed, cells that lose all service, those left with one source, and the parts
    that the run's sources fall into before and after. Sources are joined where they serve a common cell."""
    ok = entries(spark, d).filter("valid_two_way").select("job_id", "cell", "source_id").distinct()
    counts = ok.groupBy("job_id", "source_id").agg(F.count("*").alias("n"))
    busiest = counts.groupBy("job_id").agg(F.min(F.struct(-F.col("n"), F.col("source_id").alias("failed")))["failed"].alias("failed"))
    per_cell = ok.groupBy("job_id", "cell").agg(F.collect_set("source_id").alias("usable"))
    u = per_cell.join(busiest, "job_id")
    left = F.size(F.array_except("usable", F.array("failed")))
    served = u.groupBy("job_id").agg(F.count("*").alias("served"), F.count_if(left == 0).alias("lost_cells"), F.count_if(left == 1).alias("single_source"))
    # A cell's sources hang together: joining each to the least of them keeps the parts, with one edge a source.
    name = lambda c: F.concat_ws("\t", F.col("job_id"), c)
    nodes = entries(spark, d).select("job_id", "source_id").distinct().join(busiest, "job_id")

    def parts(cells_: DataFrame, sites: DataFrame, n: str) -> DataFrame:
        least = cells_.select("job_id", F.array_min("l").alias("m"), F.explode("l").alias("o")).filter("m <> o").distinct()
        roots = graph.components(sites.select(name(F.col("source_id")).alias("id")), least.select(name(F.col("m")).alias("a"), name(F.col("o")).alias("b")))
        return roots.select("root").distinct().groupBy(F.split_part("root", F.lit("\t"), F.lit(1)).alias("job_id")).agg(F.count("*").alias(n))

    before = parts(u.select("job_id", F.col("usable").alias("l")), nodes, "parts_before")
    after = parts(u.select("job_id", F.array_except("usable", F.array("failed")).alias("l")), nodes.filter("source_id <> failed"), "parts_after")
    got = served.join(busiest, "job_id").join(before, "job_id").join(after, "job_id", "left")
    return got.select("job_id", "failed", "served", "lost_cells", "single_source", "parts_before", F.coalesce("parts_after", F.lit(0)).alias("parts_after"))


@query("j18_induced_subgraph", _CTE + _EDGES + ", keep AS (SELECT source_id AS id FROM e GROUP BY source_id HAVING count(*) FILTER (WHERE valid_two_way) >= 3) SELECT a, b, w FROM ed WHERE a IN (SELECT id FROM keep) AND b IN (SELECT id FROM keep)")
def j18(spark, d):
    keep = entries(spark, d).groupBy(F.col("source_id").alias("id")).agg(F.count_if("valid_two_way").alias("n")).filter("n >= 3").select("id")
    return graph.best_edges(shared_cell_edges(spark, d), keep)


@query("k1_cell_chunks", _CTE + """, t AS (SELECT job_id, cell // 20 AS chunk, cell, '{"index":' || cell || ',"state":"' || state || '","source_count":' || coalesce(source_count, 0) || '}' AS one FROM cells)
  SELECT job_id, chunk, '[' || string_agg(one, ',' ORDER BY cell) || ']' AS line FROM t GROUP BY ALL""")
def k1(spark, d):
    """The lines of a stored run, each a JSON array of at most 20 cells in order."""
    one = F.struct(F.col("cell").alias("index"), "state", F.coalesce("source_count", F.lit(0)).alias("source_count"))
    return cells(spark, d).groupBy("job_id", F.expr("cell div 20").alias("chunk")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("line"))


@query("k8_coverage_json", _CTE + """ SELECT job_id, '{"job_id":"' || job_id || '","cells":' || count(*) || ',"counts":{' || """ + " || ',' || ".join(f"""'"{x}":' || count(*) FILTER (WHERE state = '{x}')""" for x in _STATES) + """ || '}}' AS document FROM cells GROUP BY job_id""")
def k8(spark, d):
    c = cells(spark, d).groupBy("job_id").agg(F.count("*").alias("cells"), F.struct(*(F.count_if(F.col("state") == x).alias(x) for x in _STATES)).alias("counts"))
    return c.select("job_id", F.to_json(F.struct("job_id", "cells", "counts")).alias("document"))


@query("s15_page", _CTE + " SELECT job_id, cell, state FROM cells WHERE cell >= 10 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY cell) <= 256")
def s15(spark, d):
    """A page of each run: from a cursor on, at most 256 cells in order."""
    w = Window.partitionBy("job_id").orderBy("cell")  # a run's cells, bounded by the grid's limit
    return cells(spark, d).filter("cell >= 10").withColumn("r", F.row_number().over(w)).filter("r <= 256").select("job_id", "cell", "state")


@query("w11_strict_index_order", """SELECT job_id, count(*) AS cells, count(*) FILTER (WHERE len(list_filter(range(1, len(l)), lambda i: l[i] >= l[i + 1])) > 0) AS out_of_order
  FROM (SELECT DISTINCT job_id, "index" AS cell, list_transform(sources, lambda s: s.source_id) AS l FROM coverage WHERE sources IS NOT NULL) GROUP BY job_id""")
def w11(spark, d):
    """Cells whose list of sources, as it stands, isn't in strictly rising order of ids. Entries without id are not compared."""
    c = load(spark, d, "coverage").filter("sources is not null").select("job_id", F.col("index").alias("cell"), F.transform("sources", lambda s: s["source_id"]).alias("l")).distinct()
    n = F.greatest(F.size("l") - 1, F.lit(0))
    wrong = F.exists(F.zip_with(F.slice("l", F.lit(1), n), F.slice("l", F.lit(2), n), lambda a, b: F.coalesce(a >= b, F.lit(False))), lambda x: x)
    return c.groupBy("job_id").agg(F.count("*").alias("cells"), F.count_if(wrong).alias("out_of_order"))


# A concave polygon in the runs' metres, tested by edges.
POLYGON = [(-3000.0, -2500.0), (3200.0, -2700.0), (900.0, 300.0), (2800.0, 2600.0), (-2600.0, 2400.0), (-900.0, 0.0)]


def inside_polygon(x, y, ring=POLYGON):
    """Even-odd membership, the boundary counted in, as one expression over the ring's edges."""
    odd, on = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on = on | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            odd = odd + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return on | (odd % 2 == 1)


_RING = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True))


@query("j7_cells_in_polygon", _CTE + f""", ring AS (SELECT * FROM (VALUES {_RING}) v(x1, y1, x2, y2)),
  t AS (SELECT job_id, cell, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) AS odd,
    count(*) FILTER (WHERE (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge FROM cells, ring GROUP BY ALL)
  SELECT job_id, count(*) AS inside FROM t WHERE odd % 2 = 1 OR edge > 0 GROUP BY job_id""")
def j7(spark, d):
    return cells(spark, d).filter(inside_polygon(F.col("x"), F.col("y"))).groupBy("job_id").agg(F.count("*").alias("inside"))


# Targets in the runs' metres: points, and a road as a polyline that is sampled every ROAD_STEP metres and at its end.
POINTS = [("mast", 0.0, 0.0), ("hut", -1310.0, 870.0), ("farm", 1740.0, -620.0), ("ferry", 2260.0, 1980.0), ("abroad", 90_000.0, 0.0)]
ROAD, ROAD_STEP = [(-2400.0, -1600.0), (-300.0, 500.0), (1500.0, -400.0), (2300.0, 2200.0)], 175.0


def road_samples() -> list[tuple[int, float, float, float]]:
    """(place, x, y, weight): each sample stands for the road from half way to the one before to half way to the next."""
    ends = [0.0]
    for (x1, y1), (x2, y2) in zip(ROAD, ROAD[1:]):
        ends.append(ends[-1] + ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5)
    marks = [i * ROAD_STEP for i in range(int(ends[-1] // ROAD_STEP) + 1)]
    marks += [ends[-1]] if marks[-1] < ends[-1] else []
    out = []
    for i, m in enumerate(marks):
        k = max(j for j in range(len(ROAD) - 1) if ends[j] <= m)
        t = (m - ends[k]) / (ends[k + 1] - ends[k])
        weight = (marks[min(i + 1, len(marks) - 1)] - marks[max(i - 1, 0)]) / 2
        out.append((i, ROAD[k][0] + t * (ROAD[k + 1][0] - ROAD[k][0]), ROAD[k][1] + t * (ROAD[k + 1][1] - ROAD[k][1]), weight))
    return out


def footprints(spark, d) -> DataFrame:
    """Cells with their run's half cell (h) and bounds (w, e, s, n): half the least step between its columns or rows, 250 m for a
    lone cell; the bounds lie half a cell beyond the outermost centres."""
    c = cells(spark, d)
    places = lambda v: F.array_sort(F.collect_set(v))
    step = lambda l: F.array_min(F.zip_with(F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0))), l, lambda b, a: b - a))  # noqa: E731, E741
    own = c.groupBy("job_id").agg(places("x").alias("xs"), places("y").alias("ys"))
    own = own.withColumn("h", F.coalesce(F.least(step("xs"), step("ys")) / 2, F.lit(250.0)))
    own = own.select("job_id", "h", *((F.array_min(v) - F.col("h")).alias(n) for v, n in (("xs", "w"), ("ys", "s"))), *((F.array_max(v) + F.col("h")).alias(n) for v, n in (("xs", "e"), ("ys", "n"))))
    return c.join(own, "job_id")


_FOOT = """, dx AS (SELECT job_id, min(d) AS d FROM (SELECT job_id, lead(x) OVER (PARTITION BY job_id ORDER BY x) - x AS d FROM (SELECT DISTINCT job_id, x FROM cells)) GROUP BY job_id),
  dy AS (SELECT job_id, min(d) AS d FROM (SELECT job_id, lead(y) OVER (PARTITION BY job_id ORDER BY y) - y AS d FROM (SELECT DISTINCT job_id, y FROM cells)) GROUP BY job_id),
  hf AS (SELECT job_id, coalesce(least(dx.d, dy.d) / 2, 250e0) AS h FROM dx JOIN dy USING (job_id)),
  foot AS (SELECT c.*, h, min(x) OVER w - h AS w_, max(x) OVER w + h AS e_, min(y) OVER w - h AS s_, max(y) OVER w + h AS n_ FROM cells c JOIN hf USING (job_id) WINDOW w AS (PARTITION BY job_id))"""


def in_cells(spark, d, targets: DataFrame) -> DataFrame:
    """targets (x, y and others) by run, with the cell each lies in: the one whose square, its lower edges counted in, holds it;
    none outside the run's cells. Runs are small beside the cells: the squares are met by an equi-join on their numbers."""
    f = footprints(spark, d)
    at = lambda v, low: F.floor((F.col(v) - F.col(low)) / (2 * F.col("h"))).cast("bigint")
    grid = f.withColumns({"gx": at("x", "w"), "gy": at("y", "s")}).groupBy("job_id", "gx", "gy").agg(F.min_by(F.struct("cell", "state", "best_margin_db"), "cell").alias("c"))
    runs = f.select("job_id", "w", "s", "h").distinct()
    t = runs.join(F.broadcast(targets))  # a few targets, fixed above
    t = t.withColumns({"gx": at("x", "w"), "gy": at("y", "s")}).join(grid, ["job_id", "gx", "gy"], "left")
    return t.select("job_id", *targets.columns, "c.cell", "c.state", "c.best_margin_db")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else f"{v!r}e0" for v in r) + ")" for r in rows)


def _in_cells_sql(rows, names: str) -> str:
    return f"""{_FOOT}, tg AS (SELECT * FROM (VALUES {_values(rows)}) v({names})), ru AS (SELECT DISTINCT job_id FROM foot),
  hit AS (SELECT ru.job_id, tg.*, f.cell, f.state, f.best_margin_db FROM ru CROSS JOIN tg LEFT JOIN foot f ON f.job_id = ru.job_id
    AND floor((f.x - f.w_) / (2 * f.h)) = floor((tg.x - f.w_) / (2 * f.h)) AND floor((f.y - f.s_) / (2 * f.h)) = floor((tg.y - f.s_) / (2 * f.h)) QUALIFY row_number() OVER (PARTITION BY ru.job_id, tg.target ORDER BY f.cell) = 1)"""


_POINT_STATE = """CASE WHEN h.cell IS NULL OR h.state = 'outside_area' THEN 'not_assessed' WHEN count(*) FILTER (WHERE valid_two_way AND two_way_margin_db >= 3) > 0 THEN 'pass'
  WHEN count(*) FILTER (WHERE rejection = 'profile cap') > 0 THEN 'unresolved' WHEN count(*) FILTER (WHERE rejection = 'missing terrain') > 0 THEN 'unknown' ELSE 'fail' END"""
_POINTS = _in_cells_sql(POINTS, "target, x, y") + f""", pt AS (SELECT h.job_id, h.target, h.cell, count(*) FILTER (WHERE valid_two_way) AS passing, max(two_way_margin_db) FILTER (WHERE valid_two_way) + 0e0 AS best_db, {_POINT_STATE} AS outcome
  FROM hit h LEFT JOIN e ON e.job_id = h.job_id AND e.cell = h.cell GROUP BY h.job_id, h.target, h.cell, h.state)"""


@query("a22_point_targets", _CTE + _POINTS + " SELECT job_id, target, cell, passing, best_db, outcome FROM pt")
def a22(spark, d):
    """Each point target of each run in its cell: the sources that pass, the best margin, and the outcome."""
    near = in_cells(spark, d, spark.createDataFrame(POINTS, "target string, x double, y double"))
    ok = F.col("valid_two_way")
    g = near.join(entries(spark, d).drop("endpoint"), ["job_id", "cell"], "left").groupBy("job_id", "target", "cell", "state").agg(
        F.count_if(ok).alias("passing"), (F.max(F.when(ok, F.col("two_way_margin_db"))) + 0.0).alias("best_db"), F.count_if(ok & (F.col("two_way_margin_db") >= 3)).alias("p"),
        F.count_if(F.col("rejection") == "profile cap").alias("q"), F.count_if(F.col("rejection") == "missing terrain").alias("u"),
    )
    none = F.col("cell").isNull() | (F.col("state") == "outside_area")
    outcome = F.when(none, "not_assessed").when(F.col("p") > 0, "pass").when(F.col("q") > 0, "unresolved").when(F.col("u") > 0, "unknown").otherwise("fail")
    return g.select("job_id", "target", "cell", "passing", "best_db", outcome.alias("outcome"))


@query("a23_report_summary", _CTE + _POINTS + " SELECT job_id, count(*) FILTER (WHERE outcome = 'pass') AS passed, count(*) FILTER (WHERE outcome = 'fail') AS failed, count(*) FILTER (WHERE outcome = 'unresolved') AS unresolved, count(*) FILTER (WHERE outcome NOT IN ('pass', 'fail', 'unresolved')) AS unknown FROM pt GROUP BY job_id")
def a23(spark, d):
    """A report's targets by outcome; whatever else there is counts as unknown."""
    o = F.col("outcome")
    return a22(spark, d).groupBy("job_id").agg(F.count_if(o == "pass").alias("passed"), F.count_if(o == "fail").alias("failed"), F.count_if(o == "unresolved").alias("unresolved"), F.count_if(~o.isin("pass", "fail", "unresolved")).alias("unknown"))


@query("a20_road_target", _CTE + _in_cells_sql(road_samples(), "target, x, y, weight") + """ SELECT job_id, coalesce(state, 'outside_area') AS state, count(*) AS samples, floor(sum(weight) * 100e0 + 0.5e0) / 100e0 AS metres,
  min(best_margin_db) FILTER (WHERE state = 'covered') + 0e0 AS worst_db FROM hit GROUP BY ALL""")
def a20(spark, d):
    """The road's metres by the state of the cells it runs through, and the worst margin where it is covered."""
    t = in_cells(spark, d, spark.createDataFrame(road_samples(), "target int, x double, y double, weight double"))
    return t.groupBy("job_id", F.coalesce("state", F.lit("outside_area")).alias("state")).agg(
        F.count("*").alias("samples"), (F.floor(F.sum("weight") * 100.0 + 0.5) / 100.0).alias("metres"), (F.min(F.when(F.col("state") == "covered", F.col("best_margin_db"))) + 0.0).alias("worst_db")
    )


@query("k7_geojson_bounds", _CTE + _FOOT + " SELECT job_id, cell, greatest(x - h, w_) AS west, least(x + h, e_) AS east, greatest(y - h, s_) AS south, least(y + h, n_) AS north FROM foot")
def k7(spark, d):
    """Footprints of all cells, clipped to their run's own bounds."""
    c = footprints(spark, d)
    return c.select("job_id", "cell", F.greatest(F.col("x") - F.col("h"), "w").alias("west"), F.least(F.col("x") + F.col("h"), "e").alias("east"), F.greatest(F.col("y") - F.col("h"), "s").alias("south"), F.least(F.col("y") + F.col("h"), "n").alias("north"))


@query("k7_geojson_features", _CTE + _FOOT + """ SELECT job_id, cell, '{"type":"Feature","geometry":' || CASE WHEN state = 'outside_area' THEN 'null' ELSE '{"type":"Polygon","coordinates":[[' ||
  '[' || x - h || ',' || y - h || '],[' || x + h || ',' || y - h || '],[' || x + h || ',' || y + h || '],[' || x - h || ',' || y + h || '],[' || x - h || ',' || y - h || ']]]}' END || ',"properties":{"index":' || cell || ',"state":"' || state || '"}}' AS feature FROM foot""")
def k7_features(spark, d):
    """A run's cells as GeoJSON features, in its own metres; a cell outside the area has no geometry."""
    x, y, h = F.col("x"), F.col("y"), F.col("h")
    corner = lambda a, b: F.array(x + a * h, y + b * h)
    ring = F.array(corner(F.lit(-1), F.lit(-1)), corner(F.lit(1), F.lit(-1)), corner(F.lit(1), F.lit(1)), corner(F.lit(-1), F.lit(1)), corner(F.lit(-1), F.lit(-1)))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    shape = F.when(F.col("state") == "outside_area", "null").otherwise(shape)
    properties = F.to_json(F.struct(F.col("cell").alias("index"), "state"))
    return footprints(spark, d).select("job_id", "cell", F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


_PRINT = """, fp AS (SELECT job_id, min(endpoint) AS endpoint, count(*) AS n, sha256('coverage-run' || chr(0) || '{"cells":' || count(*) || ',"endpoint":"' || min(endpoint) || '","outside":' || count(*) FILTER (WHERE state = 'outside_area')
  || ',"rows":' || count(DISTINCT y) || '}') AS fingerprint, count(*) FILTER (WHERE state = 'not_evaluated') AS open_, count(*) FILTER (WHERE state = 'unresolved') AS unresolved FROM cells GROUP BY job_id)"""


def fingerprints(spark, d) -> DataFrame:
    """SHA-256 of a domain tag, a zero byte, and the canonical text of what a run was asked for, its keys sorted."""
    s = F.col("state")
    c = cells(spark, d).groupBy("job_id").agg(
        F.min("endpoint").alias("endpoint"), F.count("*").alias("cells"), F.count_if(s == "outside_area").alias("outside"), F.countDistinct("y").alias("rows"), F.count_if(s == "not_evaluated").alias("open_"), F.count_if(s == "unresolved").alias("unresolved")
    )
    text = F.to_json(F.struct("cells", "endpoint", "outside", "rows"))
    return c.withColumn("fingerprint", F.sha2(F.concat(F.lit("coverage-run\0"), text), 256))


@query("f35_run_fingerprint", _CTE + _PRINT + " SELECT job_id, fingerprint FROM fp")
def f35(spark, d):
    return fingerprints(spark, d).select("job_id", "fingerprint")


@query("c10_reusable_runs", _CTE + _PRINT + """ SELECT job_id, fingerprint, CASE WHEN open_ > 0 THEN 'incomplete' WHEN unresolved > 0 THEN 'unresolved' END AS stale,
  min(CASE WHEN open_ = 0 AND unresolved = 0 THEN job_id END) OVER (PARTITION BY endpoint, fingerprint) AS reuse FROM fp""")
def c10(spark, d):
    """The run that answers for each fingerprint again, the first complete one of it, and the first reason why a run can't."""
    stale = F.when(F.col("open_") > 0, "incomplete").when(F.col("unresolved") > 0, "unresolved")
    f = fingerprints(spark, d).withColumn("stale", stale)
    reuse = f.filter("stale is null").groupBy("fingerprint").agg(F.min("job_id").alias("reuse"))
    return f.join(reuse, "fingerprint", "left").select("job_id", "fingerprint", "stale", "reuse")
