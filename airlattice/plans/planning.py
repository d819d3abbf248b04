"""Planning fragments over the evaluated links and stored runs: selections, products, frontiers, path quality, order."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from airlattice.functions import rf
from airlattice.operators import links, routes
from airlattice.operators.graph import Graph
from airlattice.operators.planner import alternative_id, canonical_json, scrub
from airlattice.plans import coverage, radio
from airlattice.plans.registry import Registry
from airlattice.tables import load

query = Registry()
QUERIES, ORACLE = query.QUERIES, query.ORACLE
_C, _E = coverage._CTE, coverage._EDGES
_R = f"WITH {radio._EVALUATED}"
q4 = radio.q4


def job_sources(spark, d):
    s = coverage.entries(spark, d).select("job_id", "source_id").distinct()
    return s.withColumn("num", F.substring("source_id", -5, 5).cast("bigint"))


_SRC = ", src AS (SELECT DISTINCT job_id, source_id, CAST(right(source_id, 5) AS BIGINT) AS num FROM e)"


@query("j1_cell_source_cross", _C + _SRC + " SELECT c.job_id, c.cell, s.source_id FROM cells c JOIN src s USING (job_id) WHERE c.state <> 'outside_area'")
def j1(spark, d):
    """A run's cells by its sources, at most 64 a run: its list of sources goes to the cells, and is unrolled there."""
    s = job_sources(spark, d).groupBy("job_id").agg(F.collect_set("source_id").alias("l"))
    return coverage.cells(spark, d).filter("state <> 'outside_area'").join(s, "job_id").select("job_id", "cell", F.explode("l").alias("source_id"))


@query("a4_estimate", _C + _SRC + """, s AS (SELECT job_id, count(*) AS n_src FROM src GROUP BY job_id) SELECT c.job_id, count(*) AS cells, count(*) FILTER (WHERE state <> 'outside_area') AS inside,
  count(*) FILTER (WHERE state <> 'outside_area') * any_value(coalesce(n_src, 0)) AS evaluations FROM cells c LEFT JOIN s USING (job_id) GROUP BY c.job_id""")
def a4(spark, d):
    s = job_sources(spark, d).groupBy("job_id").agg(F.count("*").alias("sources"))
    c = coverage.cells(spark, d).groupBy("job_id").agg(F.count("*").alias("cells"), F.count_if(F.col("state") != "outside_area").alias("inside"))
    return c.join(s, "job_id", "left").select("job_id", "cells", "inside", (F.col("inside") * F.coalesce("sources", F.lit(0))).alias("evaluations"))


@query("pp9_source_selection", _C + _SRC + """, k AS (SELECT *, CASE WHEN num = min(num) OVER w THEN 'A' WHEN num = max(num) OVER w THEN 'B' WHEN num % 2 = 0 THEN 'Client' ELSE 'Router' END AS kind FROM src WINDOW w AS (PARTITION BY job_id))
  SELECT job_id, source_id, kind, CAST(row_number() OVER (PARTITION BY job_id ORDER BY num, source_id) AS INT) AS place FROM k WHERE kind NOT IN ('A', 'B', 'Client')""")
def pp9(spark, d):
    """Sources in route order, without the ends; clients count as ends."""
    w = Window.partitionBy("job_id")  # a run's sources
    lo, hi = F.min("num").over(w), F.max("num").over(w)
    kind = F.when(F.col("num") == lo, "A").when(F.col("num") == hi, "B").when(F.col("num") % 2 == 0, "Client").otherwise("Router")
    k = job_sources(spark, d).withColumn("kind", kind).filter(~F.col("kind").isin("A", "B", "Client"))
    return k.select("job_id", "source_id", "kind", F.row_number().over(w.orderBy("num", "source_id")).cast("int").alias("place"))


@query("pp10_height_overrides", _C + _SRC + """, o AS (SELECT DISTINCT num, CAST((num * 131) % 700 AS DOUBLE) AS h FROM src WHERE num % 2 = 0)
  SELECT s.job_id, s.source_id, CASE WHEN s.num % 3 = 0 THEN 1.5e0 ELSE coalesce(greatest(0.1e0, least(500e0, o.h)), CAST(3 + (s.num % 5) * 4 AS DOUBLE)) END AS height_m FROM src s LEFT JOIN o USING (num)""")
def pp10(spark, d):
    """Heights of sources: a router's override where there is one, kept within 0.1 to 500 m, else its own; a client's stays."""
    s = job_sources(spark, d)
    o = s.filter("num % 2 = 0").select("num", ((F.col("num") * 131) % 700).cast("double").alias("h")).distinct()
    own = (F.lit(3) + (F.col("num") % 5) * 4).cast("double")
    h = F.when(F.col("num") % 3 == 0, 1.5).otherwise(F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(500.0), "h")), own))
    return s.join(o, "num", "left").select("job_id", "source_id", h.alias("height_m"))


@query("pp12_plausible_pairs", f"WITH {radio._LINKS} SELECT link_id, d > 0 AND d <= 8000 AND 22.0e0 + 2.15e0 - 1.0e0 - {radio._FSPL.format('greatest(d, 1e-3)')} + 2.15e0 - 1.0e0 + 130.0e0 - 10.0e0 >= 35 AS plausible FROM n")
def pp12(spark, d):
    e = radio.with_length(spark, d)
    m = rf.optimistic_margin_db(F.greatest("d", F.lit(1e-3)), rf.Radio())
    return e.select("link_id", ((F.col("d") > 0) & (F.col("d") <= 8000) & (m >= 35)).alias("plausible"))


@query("pp22_missing_ground", f"WITH {radio._LINKS}, g AS ({radio._ground('n', 'bx', 'by', 'z')}) SELECT job_id, CASE WHEN abs(bx) > 4000 OR abs(by) > 4000 THEN 'outside_coverage' ELSE 'no_data' END AS why, count(*) AS n FROM g WHERE z IS NULL GROUP BY ALL")
def pp22(spark, d):
    """C11: cells whose ground is missing, and whether they lie outside the readied bounds."""
    rows = radio.cell_links(spark, d)
    g = radio.links.with_ground(rows, radio.links.tile_lattice(radio.lattice(spark, rows)), "bx", "by", "z", radio.RES).filter("z is null")
    why = F.when((F.abs("bx") > 4000) | (F.abs("by") > 4000), "outside_coverage").otherwise("no_data")
    return g.groupBy("job_id", why.alias("why")).agg(F.count("*").alias("n"))


@query("f12_sensitivity_by_kind", _C + _SRC + " SELECT job_id, source_id, CASE num % 3 WHEN 0 THEN -130e0 WHEN 1 THEN -127.5e0 ELSE -137.03e0 END AS sensitivity_dbm, CASE WHEN num % 3 = 0 THEN 2.15e0 ELSE 5e0 END AS gain_dbi FROM src")
def f12(spark, d):
    n = F.col("num") % 3
    return job_sources(spark, d).select("job_id", "source_id", F.when(n == 0, -130.0).when(n == 1, -127.5).otherwise(-137.03).alias("sensitivity_dbm"), F.when(n == 0, 2.15).otherwise(5.0).alias("gain_dbi"))


@query("f13_antenna_elevation", f"WITH {radio._LINKS}, g AS ({radio._ground('n', 'ax', 'ay', 'z')}) SELECT link_id, {radio._Q4.format('z + ah')} AS elevation_m FROM g WHERE z IS NOT NULL")
def f13(spark, d):
    rows = radio.cell_links(spark, d)
    g = radio.links.with_ground(rows, radio.links.tile_lattice(radio.lattice(spark, rows)), "ax", "ay", "z", radio.RES).filter("z is not null")
    return g.select("link_id", q4(F.col("z") + F.col("ah")).alias("elevation_m"))


@query("f17_sample_points", f"WITH {radio._LINKS}, s AS (SELECT *, unnest(range(n)) AS i FROM n WHERE n <= 4096 AND d > 0), t AS (SELECT *, CASE WHEN i = n - 1 THEN d ELSE i * (d / (n - 1)) END AS di FROM s) SELECT link_id, CAST(i AS INT) AS i, {radio._Q4.format('ax + di / d * (bx - ax)')} AS px, {radio._Q4.format('ay + di / d * (by - ay)')} AS py FROM t")
def f17(spark, d):
    s = radio.links.profile_samples(radio.with_length(spark, d).filter((F.col("n") <= radio.RADIO.max_samples) & (F.col("d") > 0)), radio.RADIO, radio.RES)
    return s.select("link_id", "i", q4(F.col("px")).alias("px"), q4(F.col("py")).alias("py"))


@query("a6_clearance", _R + f", w AS (SELECT link_id, arg_min(di, (ratio, i)) FILTER (WHERE inner_) AS at FROM s5 GROUP BY link_id) SELECT link_id, {radio._Q4.format('m6.ratio')} AS fresnel_ratio, {radio._Q4.format('w.at')} AS ratio_at_m FROM m6 JOIN w USING (link_id)")
def a6(spark, d):
    return radio.evaluated(spark, d).filter("state is null").select("link_id", q4(F.col("fresnel_ratio")).alias("fresnel_ratio"), q4(F.col("ratio_at_m")).alias("ratio_at_m"))


@query("l6_strict_validity", _R + " SELECT l.link_id, CASE WHEN state IS NOT NULL THEN state WHEN clearance < 0 OR ratio < 0.6e0 THEN 'LOS/Fresnel validation' WHEN NOT valid THEN 'radio margin' ELSE 'none' END AS rejection FROM ev l")
def l6(spark, d):
    """Why a link is no use in strict mode, sight before margin."""
    e = radio.evaluated(spark, d)
    why = F.when(F.col("state").isNotNull(), F.col("state")).when(~F.col("los_clear") | ~F.col("fresnel_clear"), "LOS/Fresnel validation").when(~F.col("valid"), "radio margin").otherwise("none")
    return e.select("link_id", why.alias("rejection"))


@query("a11_path_quality", _R + f" SELECT job_id, source_id, count(*) FILTER (WHERE clearance < 0) AS blocked, count(*) FILTER (WHERE ratio < 0.6e0) AS impeded, {radio._Q4.format('min(two_way)')} AS worst_db FROM ev WHERE state IS NULL GROUP BY ALL")
def a11(spark, d):
    e = radio.evaluated(spark, d).filter("state is null")
    return e.groupBy("job_id", "source_id").agg(F.count_if(~F.col("los_clear")).alias("blocked"), F.count_if(~F.col("fresnel_clear")).alias("impeded"), q4(F.min("two_way_db")).alias("worst_db"))


@query("a12_solution_summary", _R + " SELECT job_id, count(DISTINCT source_id) AS routers, count(*) AS links, floor(sum(d) * 100e0 + 0.5e0) / 100e0 AS metres FROM ev WHERE state IS NULL AND valid GROUP BY job_id")
def a12(spark, d):
    e = radio.evaluated(spark, d).filter("state is null and valid")
    by = e.groupBy("job_id", "source_id").agg(F.count("*").alias("n"), F.sum("distance_m").alias("m"))
    return by.groupBy("job_id").agg(F.count("*").alias("routers"), F.sum("n").alias("links"), (F.floor(F.sum("m") * 100.0 + 0.5) / 100.0).alias("metres"))


def frontier(spark, d, k: int = 8):
    """T5: each run's best sources by usable cells, margin, id. A run's sources are at most 64."""
    e = coverage.entries(spark, d).groupBy("job_id", "source_id").agg(F.count_if("valid_two_way").alias("n"), F.max(F.when(F.col("valid_two_way"), F.col("two_way_margin_db"))).alias("m"))
    w = Window.partitionBy("job_id").orderBy(F.desc("n"), F.desc_nulls_last("m"), "source_id")
    return e.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("job_id", "source_id", F.col("place").cast("int").alias("place"))


_FRONT = """, fr AS (SELECT job_id, source_id, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, m DESC NULLS LAST, source_id) AS place FROM
  (SELECT job_id, source_id, count(*) FILTER (WHERE valid_two_way) AS n, max(two_way_margin_db) FILTER (WHERE valid_two_way) AS m FROM e GROUP BY ALL) QUALIFY place <= 8)"""


@query("t5_frontier", _C + _FRONT + " SELECT job_id, source_id, CAST(place AS INT) AS place FROM fr")
def t5(spark, d):
    return frontier(spark, d)


@query("j5_frontier_pairs", _C + _E + _FRONT + " SELECT a.job_id, a.source_id AS a, b.source_id AS b FROM fr a JOIN fr b ON a.job_id = b.job_id AND a.source_id < b.source_id WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.a = a.source_id AND ed.b = b.source_id)")
def j5(spark, d):
    """Pairs of a run's eight best sources that no edge joins yet."""
    l = frontier(spark, d).groupBy("job_id").agg(F.collect_list("source_id").alias("l"))  # noqa: E741
    p = l.select("job_id", "l", F.explode("l").alias("a")).select("job_id", "a", F.explode("l").alias("b")).filter("a < b")
    return p.join(coverage.shared_cell_edges(spark, d), ["a", "b"], "left_anti").select("job_id", "a", "b")


@query("j4_backbone_pairs", _C + _SRC + " SELECT a.job_id, a.source_id AS a, b.source_id AS b FROM src a JOIN src b ON a.job_id = b.job_id AND a.source_id < b.source_id")
def j4(spark, d):
    """All pairs of a run's backbone, which has at most 64 sites."""
    l = job_sources(spark, d).groupBy("job_id").agg(F.collect_set("source_id").alias("l"))  # noqa: E741
    return l.select("job_id", "l", F.explode("l").alias("a")).select("job_id", "a", F.explode("l").alias("b")).filter("a < b")


@query("j19_affected_edges", _C + _E + ", o AS (SELECT source_id FROM e GROUP BY source_id HAVING count(*) FILTER (WHERE rejection = 'missing terrain') > 0) SELECT a, b, w FROM ed WHERE a IN (SELECT source_id FROM o) OR b IN (SELECT source_id FROM o)")
def j19(spark, d):
    """C4: edges to evaluate again: those with an end whose terrain has been amended."""
    o = coverage.entries(spark, d).filter("rejection = 'missing terrain'").select(F.col("source_id").alias("id")).distinct()
    e = coverage.shared_cell_edges(spark, d)
    a = e.join(o.withColumnRenamed("id", "a"), "a", "left_semi").unionByName(e.join(o.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "w"))
    return a.distinct()


@query("g12_three_hop_routes", _C + _E + """, u AS (SELECT a, b, w FROM ed UNION ALL SELECT b, a, w FROM ed), t AS (SELECT min(id) AS s, max(id) AS t FROM nd),
  r AS (SELECT x.b AS via1, y.b AS via2, least(x.w, y.w, z.w) AS margin FROM t JOIN u x ON x.a = t.s JOIN u y ON y.a = x.b AND y.b <> t.s JOIN u z ON z.a = y.b AND z.b = t.t WHERE x.b <> t.t AND y.b <> t.t)
  SELECT via1, via2, margin FROM r ORDER BY margin DESC, via1, via2 LIMIT 32""")
def g12(spark, d):
    """T4: three-hop routes between the first and last source, the best 32."""
    from airlattice.operators.graph import both_ways

    u = both_ways(coverage.shared_cell_edges(spark, d))
    s, t = coverage.entries(spark, d).agg(F.min("source_id"), F.max("source_id")).first()
    x = u.filter((F.col("a") == s) & (F.col("b") != t)).select(F.col("b").alias("via1"), F.col("w").alias("w1"))
    z = u.filter((F.col("b") == t) & (F.col("a") != s)).select(F.col("a").alias("via2"), F.col("w").alias("w3"))
    y = u.select(F.col("a").alias("via1"), F.col("b").alias("via2"), "w")
    r = x.join(y, "via1").join(z, "via2").select("via1", "via2", F.least("w1", "w", "w3").alias("margin"))
    return r.orderBy(F.desc("margin"), "via1", "via2").limit(32)


@query("t7_latest_runs", "SELECT id, endpoint, mode, ended_at FROM (SELECT DISTINCT * FROM capture_runs) WHERE ended_at IS NOT NULL ORDER BY ended_at DESC, id DESC LIMIT 100")
def t7(spark, d):
    return load(spark, d, "capture_runs").distinct().filter("ended_at is not null").orderBy(F.desc("ended_at"), F.desc("id")).limit(100).select("id", "endpoint", "mode", "ended_at")


@query("f45_run_summary", "SELECT DISTINCT id, endpoint, coalesce(server_version, 'unknown') AS version, coalesce(capped, false) AS capped, coalesce(json_array_length(errors_json), 0) AS errors FROM capture_runs")
def f45(spark, d):
    return load(spark, d, "capture_runs").select("id", "endpoint", F.coalesce("server_version", F.lit("unknown")).alias("version"), F.coalesce("capped", F.lit(False)).alias("capped"), F.coalesce(F.json_array_length("errors_json"), F.lit(0)).alias("errors")).distinct()


@query("f40_grouped_numbers", "SELECT DISTINCT id, format('{:,}', requests * 12345) AS shown FROM capture_runs WHERE requests IS NOT NULL")
def f40(spark, d):
    return load(spark, d, "capture_runs").filter("requests is not null").select("id", F.format_number(F.col("requests") * 12345, 0).alias("shown")).distinct()


@query("f37_alternative_ids", _C + """, l AS (SELECT job_id, list_sort(list(DISTINCT source_id)) AS s FROM e GROUP BY job_id), q AS (SELECT job_id, '"' || array_to_string(s, '","') || '"' AS path, CASE WHEN len(s) > 2 THEN '"' || array_to_string(s[2:len(s) - 1], '","') || '"' ELSE '' END AS routers FROM l)
  SELECT job_id, left(sha256('alternative' || chr(0) || '{"paths":[[' || path || ']],"routers":[' || routers || ']}'), 16) AS alternative FROM q""")
def f37(spark, d):
    """The id of a run's sources taken as one path, the inner ones its routers: the fingerprint's first 16 digits."""
    ids = job_sources(spark, d).groupBy("job_id").agg(F.array_sort(F.collect_set("source_id")).alias("s"))
    text = F.to_json(F.struct(F.array("s").alias("paths"), F.slice("s", F.lit(2), F.greatest(F.size("s") - 2, F.lit(0))).alias("routers")))
    return ids.select("job_id", F.substring(F.sha2(F.concat(F.lit("alternative\0"), text), 256), 1, 16).alias("alternative"))


@query("f31_path_prefixes", """SELECT packet_id, observation_key, CAST(json_array_length(path_prefixes) AS INT) AS hops, regexp_full_match(path_prefixes, '\\[(\\s*(null|"([0-9a-fA-F]{2}){1,3}")\\s*,?)*\\]') AS well_formed
  FROM (SELECT DISTINCT packet_id, observation_key, path_prefixes FROM observations WHERE path_prefixes IS NOT NULL AND json_valid(path_prefixes))""")
def f31(spark, d):
    o = load(spark, d, "observations").filter("path_prefixes is not null").select("packet_id", "observation_key", "path_prefixes").distinct()
    o = o.filter(F.json_array_length("path_prefixes").isNotNull())
    ok = F.forall(F.from_json("path_prefixes", "array<string>"), lambda x: x.isNull() | x.rlike("^([0-9a-fA-F]{2}){1,3}$"))
    return o.select("packet_id", "observation_key", F.json_array_length("path_prefixes").alias("hops"), ok.alias("well_formed"))


@query("w10_hop_pairs", """WITH p AS (SELECT DISTINCT packet_id, observation_key, path_prefixes FROM observations WHERE path_prefixes IS NOT NULL AND json_valid(path_prefixes)), x AS (SELECT packet_id, observation_key, lower(unnest(CAST(path_prefixes AS VARCHAR[]))) AS hop, generate_subscripts(CAST(path_prefixes AS VARCHAR[]), 1) AS i FROM p), y AS (SELECT *, lead(hop) OVER (PARTITION BY packet_id, observation_key ORDER BY i) AS following FROM x)
  SELECT hop, following, count(*) AS n FROM y WHERE following IS NOT NULL AND hop IS NOT NULL GROUP BY ALL""")
def w10(spark, d):
    """Neighbouring hops of the paths, by the place after each in its list: no window is needed."""
    o = load(spark, d, "observations").filter("path_prefixes is not null").select("packet_id", "observation_key", "path_prefixes").distinct()
    o = o.select(F.from_json("path_prefixes", "array<string>").alias("l")).filter(F.size("l") > 1)
    p = o.select(F.explode(F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("hop"), F.slice("l", F.lit(2), F.size("l") - 1).alias("following"))).alias("p"))
    p = p.select(F.lower("p.hop").alias("hop"), F.lower("p.following").alias("following")).dropna()
    return p.groupBy("hop", "following").agg(F.count("*").alias("n"))


@query("u3_source_sets", _C + coverage._STEPS + """, l AS (SELECT job_id, list(DISTINCT source_id) AS s FROM e GROUP BY job_id)
  SELECT t.scenario, CAST(len(list_intersect(n.s, o.s)) AS INT) AS kept, CAST(len(n.s) - len(list_intersect(n.s, o.s)) AS INT) AS fresh, CAST(len(o.s) - len(list_intersect(n.s, o.s)) AS INT) AS dropped FROM steps t JOIN l n ON n.job_id = t.scenario JOIN l o ON o.job_id = t.baseline""")
def u3(spark, d):
    l = job_sources(spark, d).groupBy("job_id").agg(F.collect_set("source_id").alias("s"))  # noqa: E741
    side = lambda c, o: l.select(F.col("job_id").alias(c), F.col("s").alias(o))
    t = coverage.run_steps(spark, d).join(side("scenario", "n"), "scenario").join(side("baseline", "o"), "baseline")
    return t.select("scenario", F.size(F.array_intersect("n", "o")).alias("kept"), F.size(F.array_except("n", "o")).alias("fresh"), F.size(F.array_except("o", "n")).alias("dropped"))


@query("c6_run_compatibility", _C + coverage._STEPS + coverage._FOOT + """, g AS (SELECT job_id, count(*) AS n, any_value(w_) AS w, any_value(e_) AS e_, any_value(s_) AS s, any_value(n_) AS n_, any_value(h) AS h, count(*) FILTER (WHERE state = 'not_evaluated') AS open_ FROM foot GROUP BY job_id)
  SELECT t.scenario, CASE WHEN a.open_ > 0 OR b.open_ > 0 THEN 'incomplete' WHEN a.h <> b.h THEN 'cell size' WHEN a.w <> b.w OR a.e_ <> b.e_ OR a.s <> b.s OR a.n_ <> b.n_ THEN 'bounds' WHEN a.n <> b.n THEN 'cells' ELSE 'none' END AS mismatch
  FROM steps t JOIN g a ON a.job_id = t.baseline JOIN g b ON b.job_id = t.scenario""")
def c6(spark, d):
    """Why two runs can't be compared cell by cell: the first reason that holds."""
    f = coverage.footprints(spark, d)
    g = f.groupBy("job_id").agg(F.struct(F.count_if(F.col("state") == "not_evaluated").alias("open"), F.first("h").alias("h"), F.struct(*(F.first(c).alias(c) for c in "wesn")).alias("b"), F.count("*").alias("n")).alias("g"))
    side = lambda c, p: g.select(F.col("job_id").alias(c), F.col("g").alias(p))
    t = coverage.run_steps(spark, d).join(side("baseline", "o"), "baseline").join(side("scenario", "s"), "scenario")
    other = lambda c: F.col(f"o.{c}") != F.col(f"s.{c}")
    why = F.when((F.col("o.open") > 0) | (F.col("s.open") > 0), "incomplete").when(other("h"), "cell size").when(other("b"), "bounds").when(other("n"), "cells").otherwise("none")
    return t.select("scenario", why.alias("mismatch"))


@query("w12_cell_quota", _C + ", g AS (SELECT job_id, cell, CAST(floor(x / 2000e0) AS BIGINT) AS gx, CAST(floor(y / 2000e0) AS BIGINT) AS gy, row_number() OVER (PARTITION BY job_id, floor(x / 2000e0), floor(y / 2000e0) ORDER BY best_margin_db DESC NULLS LAST, cell) AS r FROM cells) SELECT job_id, gx, gy, cell FROM g WHERE r <= 4")
def w12(spark, d):
    key = lambda c: F.floor(F.col(c) / 2000.0).cast("bigint")
    c = coverage.cells(spark, d).select("job_id", "cell", key("x").alias("gx"), key("y").alias("gy"), "best_margin_db")
    w = Window.partitionBy("job_id", "gx", "gy").orderBy(F.desc_nulls_last("best_margin_db"), "cell")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 4").select("job_id", "gx", "gy", "cell")


@query("w8_segment_lookup", _C + """, o AS (SELECT job_id, cell, row_number() OVER (PARTITION BY job_id ORDER BY cell) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS n FROM cells),
  m AS (SELECT job_id, unnest(range((n - 1) * 500 // 1200 + 1)) AS mark FROM (SELECT DISTINCT job_id, n FROM o))
  SELECT m.job_id, m.mark, CAST(o.cell AS BIGINT) AS cell FROM m JOIN o ON o.job_id = m.job_id AND o.i = m.mark * 1200 // 500""")
def w8(spark, d):
    """The cell of a run's line that each mark, every 1.2 km from its start to its end, lies on: W7's running length, then
    the last start before. A mark is looked up by the one cell whose start and the next one's enclose it."""
    w = Window.partitionBy("job_id").orderBy("cell")
    p = coverage.cells(spark, d).withColumn("at", (F.row_number().over(w) - 1) * 500.0).withColumn("next", F.lead("at").over(w))
    mark = F.ceil(F.col("at") / 1200.0).cast("bigint")  # a cell is shorter than the spacing: one mark at most
    m = p.select("job_id", mark.alias("mark"), F.col("cell").cast("bigint").alias("cell"), "at", "next")
    return m.filter(F.coalesce(F.col("mark") * 1200.0 < F.col("next"), F.col("mark") * 1200.0 == F.col("at"))).select("job_id", "mark", "cell")


@query("k5_route_table")
def k5(spark, d):
    """The lines of a route table of all valid links, in the order of their ids within each run."""
    from airlattice.sources import sinks

    e = radio.evaluated(spark, d).filter("valid and state is null")
    w = Window.partitionBy("job_id").orderBy("link_id")
    total = rf.fspl_db(F.col("distance_m"), 869.5)
    rows = e.select(
        F.row_number().over(w).alias("hop"), F.col("source_id").alias("from"), F.concat_ws("/", "job_id", F.col("cell").cast("string")).alias("to"), (F.col("distance_m") / 1000).alias("distance_km"), total.alias("fspl_db"),
        F.col("diffraction_db").alias("diffraction_loss_db"), (total + F.col("diffraction_db")).alias("total_path_loss_db"), F.col("forward.received_dbm").alias("rx_power_dbm"), F.lit(-130.0).alias("sensitivity_dbm"),
        (F.col("forward.margin_db") + 10).alias("raw_margin_db"), F.col("forward.margin_db").alias("fade_adjusted_margin_db"), F.col("reverse.margin_db").alias("reverse_margin_db"), F.col("two_way_db").alias("worst_margin_db"),
        (F.col("fresnel_ratio") * 100).alias("minimum_fresnel_clearance_percent"), "los_clear", "valid",
    )
    return sinks.route_csv(rows)


@query("f20_slope", f"WITH {radio._LINKS}, p AS (SELECT DISTINCT job_id, source_id, ax, ay, ax + 150e0 AS xe, ax - 150e0 AS xw, ay + 150e0 AS yn, ay - 150e0 AS ys FROM n), g1 AS ({radio._ground('p', 'xe', 'ay', 'ze')}), g2 AS ({radio._ground('g1', 'xw', 'ay', 'zw')}), g3 AS ({radio._ground('g2', 'ax', 'yn', 'zn')}), g4 AS ({radio._ground('g3', 'ax', 'ys', 'zs')}) SELECT job_id, source_id, {radio._Q4.format('coalesce(sqrt((ze - zw) / 300e0 * ((ze - zw) / 300e0) + (zn - zs) / 300e0 * ((zn - zs) / 300e0)), 1e0)')} AS slope FROM g4")
def f20(spark, d):
    """Slope at each source by central differences; 1 where the ground about it is missing."""
    rows = radio.cell_links(spark, d)
    tiles = radio.cut(radio.links.tile_lattice(radio.lattice(spark, rows, 3)))
    p = rows.select("job_id", "source_id", "ax", "ay").distinct()
    p = p.withColumns({"xe": F.col("ax") + 150.0, "xw": F.col("ax") - 150.0, "yn": F.col("ay") + 150.0, "ys": F.col("ay") - 150.0})
    for x, y, z in (("xe", "ay", "ze"), ("xw", "ay", "zw"), ("ax", "yn", "zn"), ("ax", "ys", "zs")):
        p = radio.links.with_ground(p, tiles, x, y, z, radio.RES)
    gx, gy = (F.col("ze") - F.col("zw")) / 300.0, (F.col("zn") - F.col("zs")) / 300.0
    return p.select("job_id", "source_id", q4(F.coalesce(F.sqrt(gx * gx + gy * gy), F.lit(1.0))).alias("slope"))


@query("c2_mesh_area", f"""WITH {radio._LINKS}, s AS (SELECT DISTINCT job_id, source_id, route_order, ax, ay FROM n), c AS (SELECT DISTINCT ON (job_id, \"index\") job_id, \"index\" AS cell, x, y FROM coverage),
  g AS (SELECT job_id, ax, ay, ax AS ex, ay AS ey, 1500e0 AS reach FROM s UNION ALL SELECT job_id, ax, ay, lead(ax) OVER w, lead(ay) OVER w, 600e0 FROM s WINDOW w AS (PARTITION BY job_id ORDER BY route_order, source_id)),
  p AS (SELECT c.job_id, c.cell, c.x, c.y, g.*, greatest(0e0, least(1e0, CASE WHEN ex = ax AND ey = ay THEN 0e0 ELSE ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) END)) AS t FROM c JOIN g ON g.job_id = c.job_id AND g.ex IS NOT NULL),
  v AS (SELECT job_id, min(ax) - 1500e0 AS w, max(ax) + 1500e0 AS e, min(ay) - 1500e0 AS s, max(ay) + 1500e0 AS n FROM s GROUP BY job_id)
  SELECT p.job_id, p.cell, bool_or(sqrt((x - (ax + t * (ex - ax))) * (x - (ax + t * (ex - ax))) + (y - (ay + t * (ey - ay))) * (y - (ay + t * (ey - ay)))) <= reach) AS in_mesh, any_value(x BETWEEN v.w AND v.e AND y BETWEEN v.s AND v.n) AS in_view
  FROM p JOIN v ON v.job_id = p.job_id GROUP BY p.job_id, p.cell""")
def c2(spark, d):
    """The areas of a run that its cells lie in: the mesh's, buffers about its sources and a corridor along them in route order (at
    most 64 sources: membership in any part), and the view, the box about all buffers."""
    s = radio.cell_links(spark, d).select("job_id", "source_id", "route_order", "ax", "ay").distinct()
    w = Window.partitionBy("job_id").orderBy("route_order", "source_id")  # a run's sources
    s = s.withColumns({"ex": F.lead("ax").over(w), "ey": F.lead("ay").over(w)})
    part = lambda ex, ey, r: F.struct("ax", "ay", F.col(ex).alias("ex"), F.col(ey).alias("ey"), F.lit(r).alias("reach"))
    parts = F.flatten(F.collect_list(F.array(part("ax", "ay", 1500.0), F.when(F.col("ex").isNotNull(), part("ex", "ey", 600.0)))))
    g = s.groupBy("job_id").agg(parts.alias("l"), *((f(c) + m).alias(n) for n, f, c, m in (("w", F.min, "ax", -1500.0), ("e", F.max, "ax", 1500.0), ("s", F.min, "ay", -1500.0), ("n", F.max, "ay", 1500.0))))
    c = coverage.cells(spark, d).select("job_id", "cell", "x", "y").join(g, "job_id")

    def within(p):
        x, y, dx, dy = F.col("x"), F.col("y"), p["ex"] - p["ax"], p["ey"] - p["ay"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((dx == 0) & (dy == 0), 0.0).otherwise(((x - p["ax"]) * dx + (y - p["ay"]) * dy) / (dx * dx + dy * dy))))
        ox, oy = x - (p["ax"] + t * dx), y - (p["ay"] + t * dy)
        return F.coalesce(F.sqrt(ox * ox + oy * oy) <= p["reach"], F.lit(False))

    return c.select("job_id", "cell", F.exists("l", within).alias("in_mesh"), (F.col("x").between(F.col("w"), F.col("e")) & F.col("y").between(F.col("s"), F.col("n"))).alias("in_view"))


@query("pp8_bounds_union", _C + " SELECT endpoint, min(x - 250e0) AS west, min(y - 250e0) AS south, max(x + 250e0) AS east, max(y + 250e0) AS north FROM cells GROUP BY endpoint")
def pp8(spark, d):
    c = coverage.cells(spark, d)
    return c.groupBy("endpoint").agg(F.min(F.col("x") - 250.0).alias("west"), F.min(F.col("y") - 250.0).alias("south"), F.max(F.col("x") + 250.0).alias("east"), F.max(F.col("y") + 250.0).alias("north"))


@query("pp21_recent_routers", """SELECT DISTINCT run_id, lower(pubkey) AS pubkey FROM nodes_snapshot WHERE coalesce(raw_json ->> '$.role', raw_json ->> '$.stats.role') = 'repeater'
  AND epoch_ms(CAST(captured_at AS TIMESTAMP)) - epoch_ms(CAST(raw_json ->> '$.last_heard' AS TIMESTAMP)) <= 604800000""")
def pp21(spark, d):
    """Routers heard in the week before they were captured."""
    at = lambda p: F.get_json_object("raw_json", p)
    n = load(spark, d, "nodes_snapshot").filter(F.coalesce(at("$.role"), at("$.stats.role")) == "repeater")
    age = F.unix_millis(F.try_to_timestamp("captured_at")) - F.unix_millis(F.try_to_timestamp(at("$.last_heard")))
    return n.filter(age <= 604_800_000).select("run_id", F.lower("pubkey").alias("pubkey")).distinct()


@query("pp18_scrubbed_snapshots")
def pp18(spark, d):
    """Snapshot objects without content keys, scrubbed in Arrow batches."""
    def one(t):
        try:
            return canonical_json(scrub(json.loads(t)))
        except (TypeError, ValueError):
            return None

    @pandas_udf("string")
    def scrubbed(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return load(spark, d, "nodes_snapshot").select("run_id", F.lower("pubkey").alias("pubkey"), scrubbed("raw_json").alias("raw_json")).distinct()


@query("a17_thin_profiles", f"""WITH {radio._LINKS}, s AS (SELECT *, unnest(range(n)) AS i FROM n WHERE n <= 4096 AND d > 0), t AS (SELECT *, CASE WHEN i = n - 1 THEN d ELSE i * (d / (n - 1)) END AS di FROM s),
  h AS (SELECT link_id, CAST(i AS INT) AS i, n, (CAST(floor(ax + di / d * (bx - ax)) AS BIGINT) * 7 + CAST(floor(ay + di / d * (by - ay)) AS BIGINT) * 13) AS k FROM t),
  g AS (SELECT link_id, i, n, CAST((k % 200 + 200) % 200 AS DOUBLE) AS h, CAST(floor(i / greatest(ceil(n * 2 / 18e0), 1)) AS BIGINT) AS bin FROM h),
  w AS (SELECT *, row_number() OVER (PARTITION BY link_id, bin ORDER BY h, i) AS lo, row_number() OVER (PARTITION BY link_id, bin ORDER BY h DESC, i) AS hi FROM g)
  SELECT link_id, i, n, h FROM w WHERE lo = 1 OR hi = 1 OR i = 0 OR i = n - 1""")
def a17(spark, d):
    """Profiles of the links with their extremes kept, at most 20 samples each."""
    from airlattice.sources import sinks

    s = radio.links.profile_samples(radio.with_length(spark, d).filter((F.col("n") <= radio.RADIO.max_samples) & (F.col("d") > 0)), radio.RADIO, radio.RES)
    s = s.select("link_id", "i", "n", (F.pmod(F.floor("px") * 7 + F.floor("py") * 13, F.lit(200))).cast("double").alias("h"))
    return sinks.thin_profile(s, 20)


# Routes: the sources of each endpoint are the sites of one network, at positions and heights by their numbers; the first and
# the last by id are its ends, to be joined through the others.
ROUTE_NEIGHBOURS, ROUTE_MAX_M = 16, 8_000.0


def route_sites(spark, d):
    s = coverage.entries(spark, d).select(F.col("endpoint").alias("net"), F.col("source_id").alias("id")).distinct()
    n, k = F.substring("id", -5, 5).cast("bigint"), F.ascii(F.substring("id", 5, 1))
    s = s.select(
        "net", "id", ((n * 7919) % 10000 - 5000).cast("double").alias("x"), ((n * 104729) % 10000 - 5000).cast("double").alias("y"), (F.lit(60) + ((n * 2 + 3 + k) % 5) * 20).cast("double").alias("h"),
        ((n * 37) % 8).cast("double").alias("quality"), ((n + k) % 3 == 0).alias("existing"),
    )
    ends = s.groupBy("net").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return s.join(ends, "net").withColumn("terminal", F.col("id").isin(F.col("first"), F.col("last"))).drop("first", "last")


def route_links(spark, d):
    """Sites and certified links of all networks."""
    from airlattice.plans import siting

    sites = radio.cut(route_sites(spark, d))
    near = siting.nearest(sites.withColumnRenamed("net", "endpoint"), ROUTE_NEIGHBOURS).withColumnRenamed("endpoint", "net")
    pairs = radio.cut(routes.screened_pairs(sites, near, radio.RADIO, ROUTE_MAX_M))
    return sites, radio.cut(routes.certified_links(pairs, links.tile_lattice(radio.lattice(spark, pairs)), radio.RADIO, radio.RES))


_PAIRS = """
  e0 AS (SELECT DISTINCT endpoint AS net, s.source_id AS id FROM (SELECT endpoint, unnest(sources) AS s FROM coverage) WHERE s.source_id <> ''),
  e1 AS (SELECT *, CAST(right(id, 5) AS BIGINT) AS num, ascii(substr(id, 5, 1)) AS k FROM e0),
  si AS (SELECT net, id, CAST((num * 7919) % 10000 - 5000 AS DOUBLE) AS x, CAST((num * 104729) % 10000 - 5000 AS DOUBLE) AS y, CAST(60 + ((num * 2 + 3 + k) % 5) * 20 AS DOUBLE) AS h, CAST((num * 37) % 8 AS DOUBLE) AS quality,
         (num + k) % 3 = 0 AS existing, id IN (min(id) OVER (PARTITION BY net), max(id) OVER (PARTITION BY net)) AS terminal FROM e1),
  kn AS (SELECT a.net, a.id AS a, b.id AS b, a.terminal FROM si a JOIN si b ON a.net = b.net AND a.id <> b.id
         QUALIFY a.terminal OR row_number() OVER (PARTITION BY a.net, a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) <= 16),
  pq AS (SELECT DISTINCT net, least(a, b) AS a, greatest(a, b) AS b FROM kn),
  l AS (SELECT pq.net AS job_id, pq.b AS cell, pq.a AS source_id, pq.net || chr(9) || pq.a || chr(9) || pq.b AS link_id, p.x AS ax, p.y AS ay, p.h AS ah, q.x AS bx, q.y AS by, q.h AS bh, 0 AS route_order
        FROM pq JOIN si p ON p.net = pq.net AND p.id = pq.a JOIN si q ON q.net = pq.net AND q.id = pq.b),
  d AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) AS d FROM l),
  n AS (SELECT *, greatest(CAST(ceil(d / 200e0) AS INT) + 1, 3) AS n FROM d WHERE d > 0 AND d <= 8000 AND 22.0e0 + 2.15e0 - 1.0e0 - """ + radio._FSPL.format("d") + """ + 2.15e0 - 1.0e0 + 130.0e0 - 10.0e0 >= 0)"""
_NET = f"""WITH RECURSIVE {radio.evaluated_sql(_PAIRS, 22.0, 22.0)},
  ok AS MATERIALIZED (SELECT job_id AS net, source_id AS a, cell AS b, two_way AS w, clearance >= 0 AND ratio >= 0.6e0 AS clear, ratio AS fresnel, d AS metres FROM ev WHERE state IS NULL AND valid),
  u AS MATERIALIZED (SELECT * FROM ok UNION ALL SELECT net, b, a, w, clear, fresnel, metres FROM ok)"""
# Every path without a loop, of networks of a few sites: the searches' results are the first ones in their order.
_PATHS = """,
  ts AS (SELECT net, min(id) AS s, max(id) AS t FROM si GROUP BY net HAVING count(*) > 1),
  pa AS (SELECT net, [s] AS p, s AS here, t, 0 AS hops, true AS clear, CAST('inf' AS DOUBLE) AS margin, CAST('inf' AS DOUBLE) AS fresnel, 0e0 AS height, 0e0 AS quality, 0e0 AS metres, 0 AS fresh, 0 AS routers, 0 AS blocked, 0e0 AS cost FROM ts
    UNION ALL SELECT pa.net, list_append(p, u.b), u.b, t, hops + 1, pa.clear AND u.clear, least(margin, u.w), least(pa.fresnel, u.fresnel), height + CASE WHEN u.b = t THEN 0 ELSE h END, pa.quality + si.quality, pa.metres + u.metres,
      fresh + CASE WHEN u.b = t OR existing THEN 0 ELSE 1 END, routers + CASE WHEN u.b = t THEN 0 ELSE 1 END, blocked + CASE WHEN u.clear THEN 0 ELSE 1 END, cost + CASE WHEN u.b = t THEN 0 ELSE 100 + h END + u.metres / 1e6
      FROM pa JOIN u ON u.net = pa.net AND u.a = pa.here JOIN si ON si.net = u.net AND si.id = u.b WHERE here <> t AND NOT list_contains(p, u.b)),
  fu AS (SELECT * FROM pa WHERE here = t)"""
_FINE = "clear DESC, margin DESC, fresnel DESC, height, quality DESC, metres, p"
_ORDERS = {
    "hops": f"hops, {_FINE}", "reliability": f"clear DESC, margin DESC, hops, {_FINE}", "installations": f"fresh, routers, hops, {_FINE}", "infrastructure": "cost, p",
}
_SEARCHES = {"hops": Graph.hop_path, "reliability": Graph.reliability_path, "installations": Graph.installation_path, "infrastructure": Graph.infrastructure_path}


def _places(paths):
    return [[k, i, n] for k, p in enumerate(paths) for i, n in enumerate(p)]


for _name, _priority in {"g3_hop_path": "hops", "g4_reliability_path": "reliability", "g5_installation_path": "installations", "g6_infrastructure_path": "infrastructure"}.items():

    @query(_name, f"{_NET}{_PATHS}, be AS (SELECT net, p FROM fu QUALIFY row_number() OVER (PARTITION BY net ORDER BY {_ORDERS[_priority]}) = 1) SELECT net, 0 AS path, CAST(generate_subscripts(p, 1) - 1 AS INT) AS place, unnest(p) AS id FROM be")
    def _(spark, d, find=_SEARCHES[_priority]):
        return routes.searched(*route_links(spark, d), lambda g, s, t: _places([p] if (p := find(g, s, t)) else []), "path int, place int, id string")


@query("g8_k_shortest", f"{_NET}{_PATHS}, be AS (SELECT net, p, row_number() OVER (PARTITION BY net ORDER BY hops, p) - 1 AS k FROM fu QUALIFY k < 8) SELECT net, CAST(k AS INT) AS path, CAST(generate_subscripts(p, 1) - 1 AS INT) AS place, unnest(p) AS id FROM be")
def g8(spark, d):
    return routes.searched(*route_links(spark, d), lambda g, s, t: _places(g.k_shortest(s, t, 8)), "path int, place int, id string")


@query("t8_representative_paths", f"{_NET}{_PATHS}, be AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY net ORDER BY hops, p) <= 8) SELECT net, CAST(row_number() OVER (PARTITION BY net ORDER BY clear DESC, margin DESC, hops, p) AS INT) AS place, array_to_string(p, '>') AS route FROM be")
def t8(spark, d):
    """A network's shortest paths in the order in which they stand for it: clear ones, the best bottleneck, fewest hops, ids."""

    def search(g, s, t):
        found = sorted(g.k_shortest(s, t, 8), key=lambda p: (not g.is_clear(p), -g.bottleneck(p), len(p), p))
        return [[i, ">".join(p)] for i, p in enumerate(found, 1)]

    return routes.searched(*route_links(spark, d), search, "place int, route string")


@query("g7_disjoint_paths")
def g7(spark, d):
    return routes.searched(*route_links(spark, d), lambda g, s, t: _places(g.disjoint_paths(s, t)), "path int, place int, id string")


@query("g7_disjoint_count", f"""{_NET}, ts AS (SELECT net, min(id) AS s, max(id) AS t FROM si GROUP BY net HAVING count(*) > 1),
  inn AS (SELECT si.net, id, row_number() OVER (PARTITION BY si.net ORDER BY id) - 1 AS i FROM si JOIN ts ON ts.net = si.net AND id NOT IN (s, t)),
  ms AS (SELECT ts.net, unnest(range(CAST(1 AS BIGINT) << (SELECT count(*) FROM inn WHERE inn.net = ts.net))) AS mask FROM ts),
  r AS (SELECT ms.net, mask, s AS id FROM ms JOIN ts ON ts.net = ms.net UNION SELECT r.net, r.mask, u.b FROM r JOIN ts ON ts.net = r.net JOIN u ON u.net = r.net AND u.a = r.id LEFT JOIN inn ON inn.net = u.net AND inn.id = u.b
    WHERE NOT (u.a = ts.s AND u.b = ts.t) AND (inn.i IS NULL OR (r.mask >> inn.i) & 1 = 0)),
  cu AS (SELECT ms.net, min(bit_count(ms.mask)) AS cut FROM ms JOIN ts ON ts.net = ms.net WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.net = ms.net AND r.mask = ms.mask AND r.id = ts.t) GROUP BY ms.net)
  SELECT cu.net, CAST(cut + CASE WHEN EXISTS (SELECT 1 FROM u JOIN ts ON ts.net = u.net AND u.a = ts.s AND u.b = ts.t WHERE u.net = cu.net) THEN 1 ELSE 0 END AS INT) AS paths FROM cu""")
def g7_count(spark, d):
    """How many routes without a common site a network has: as many as the fewest sites whose loss parts its ends, which is what
    the SQL looks for, and one for a link between the ends."""
    return routes.searched(*route_links(spark, d), lambda g, s, t: [[len(g.disjoint_paths(s, t))]], "paths int")


@query("g11_bounded_margin", f"{_NET}{_PATHS}, b AS (SELECT net, unnest([1, 2, 3, 4]) AS most FROM ts) SELECT b.net, b.most AS max_hops, {radio._Q4.format('max(margin)')} AS margin_db FROM b JOIN fu ON fu.net = b.net AND fu.hops <= b.most GROUP BY b.net, b.most")
def g11(spark, d):
    """The widest margin of a path of so many hops at most."""

    def search(g, s, t):
        best = {}
        for p in g.bounded_margin_paths(s, t, 4):
            for k in range(len(p) - 1, 5):
                best[k] = max(best.get(k, float("-inf")), g.bottleneck(p))
        return [[k, m] for k, m in sorted(best.items())]

    return routes.searched(*route_links(spark, d), search, "max_hops int, margin_db double").withColumn("margin_db", q4(F.col("margin_db")))


@query("g13_steiner")
def g13(spark, d):
    return routes.searched(*route_links(spark, d), lambda g, s, t: [[n] for n in sorted(g.steiner([s, t]))] if g.hop_path(s, t) else [], "id string")


@query("a24_route_solutions", f"""{_NET}{_PATHS}, pr AS (""" + " UNION ALL ".join(
    f"(SELECT '{k}' AS priority, * FROM fu QUALIFY row_number() OVER (PARTITION BY net ORDER BY {v}) = 1)" for k, v in _ORDERS.items()) + f""")
  SELECT net, priority, hops, fresh, blocked, {radio._Q4.format('margin')} AS margin_db, {radio._Q4.format('fresnel')} AS fresnel_ratio, {radio._Q4.format('metres')} AS metres,
    left(sha256('alternative' || chr(0) || '{{"paths":[["' || array_to_string(p, '","') || '"]],"routers":[' || CASE WHEN len(p) > 2 THEN '"' || array_to_string(list_sort(p[2:len(p) - 1]), '","') || '"' ELSE '' END || ']}}'), 16) AS alternative FROM pr""")
def a24(spark, d):
    """C3's route job as rows: of each network and priority the certified route, with its counts, bottlenecks, length (A10, A11,
    A12, A24) and the alternative's id over its paths and routers (F35, F36, F37)."""

    def search(g, s, t):
        out = []
        for priority, find in _SEARCHES.items():
            if p := find(g, s, t):
                steps = list(zip(p, p[1:]))
                out.append([priority, len(steps), sum(not g.fact(n, "existing", False) for n in p[1:-1]), sum(not g.clear[x] for x in steps), g.bottleneck(p), min(g.fresnel[x] for x in steps), sum(g.length[x] for x in steps), alternative_id([p], p[1:-1])])
        return out

    got = routes.searched(*route_links(spark, d), search, "priority string, hops int, fresh int, blocked int, margin_db double, fresnel_ratio double, metres double, alternative string")
    return got.withColumns({c: q4(F.col(c)) for c in ("margin_db", "fresnel_ratio", "metres")})


@query("g18_no_route", f"""{_NET}, ts AS (SELECT net, min(id) AS s, max(id) AS t FROM si GROUP BY net HAVING count(*) > 1),
  r AS (SELECT net, s AS id FROM ts UNION SELECT r.net, u.b FROM r JOIN u ON u.net = r.net AND u.a = r.id)
  SELECT ts.net, (SELECT count(*) FROM pq WHERE pq.net = ts.net) AS pairs, (SELECT count(*) FROM l LEFT JOIN n USING (link_id) WHERE l.job_id = ts.net AND n.link_id IS NULL) AS out_of_reach,
    (SELECT count(*) FROM ev WHERE job_id = ts.net AND NOT (state IS NULL AND valid)) AS refused, (SELECT count(*) FROM r WHERE r.net = ts.net) AS reached, EXISTS (SELECT 1 FROM r WHERE r.net = ts.net AND r.id = ts.t) AS joined FROM ts""")
def g18(spark, d):
    """Why a network's ends are not joined: pairs looked at, pairs out of reach in free space, pairs that terrain refused, and
    the sites that its first end reaches."""
    from airlattice.plans import siting

    sites = radio.cut(route_sites(spark, d))
    near = siting.nearest(sites.withColumnRenamed("net", "endpoint"), ROUTE_NEIGHBOURS).withColumnRenamed("endpoint", "net")
    ends = sites.filter("terminal").select("net", F.col("id").alias("a")).join(sites.select("net", F.col("id").alias("b")), "net").filter("a <> b")
    all_ = near.select("net", "a", "b").unionByName(ends).select("net", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().groupBy("net").agg(F.count("*").alias("pairs"))
    pairs = radio.cut(routes.screened_pairs(sites, near, radio.RADIO, ROUTE_MAX_M))
    held = radio.cut(routes.certified_links(pairs, links.tile_lattice(radio.lattice(spark, pairs)), radio.RADIO, radio.RES))
    n = lambda t, c: t.groupBy("net").agg(F.count("*").alias(c))
    got = routes.searched(sites, held, lambda g, s, t: [[len(r := g.reached(s)), t in r]], "reached bigint, joined boolean")
    got = got.join(all_, "net", "left").join(n(pairs, "screened"), "net", "left").join(n(held, "held"), "net", "left").na.fill(0, ["pairs", "screened", "held"])
    return got.select("net", "pairs", (F.col("pairs") - F.col("screened")).alias("out_of_reach"), (F.col("screened") - F.col("held")).alias("refused"), "reached", "joined")


# "by" is a keyword to some parsers.
for _name in list(ORACLE):
    ORACLE[_name] = radio.re.sub(r'(?<!")\bby\b(?!")', '"by"', ORACLE[_name])
