"""Links, profiles and radio formulas over the coverage table's cells and sources, with SQL twins.

The sites of sources are not in the tables: they stand at positions drawn from their numbers, over a terrain of integer
hashes with missing nodes, both exact in any engine. Every cell and every source entry with an id is used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.functions import rf
from airlattice.operators import links
from airlattice.plans.registry import Registry
from airlattice.tables import cut, load

query = Registry()
QUERIES, ORACLE = query.QUERIES, query.ORACLE

RES = 100.0
RADIO = rf.Radio()
GATE_SAMPLES = 60  #: the cap that l5 and f16 show, which leave no link out


def q4(c):
    """Four places, halves upwards: engines differ in the last bits of logarithms, and in how they round."""
    return F.floor(c * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


def cell_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link a cell and source: the source's mast, of height by its number, and a client in the cell's centre."""
    e = load(spark, sf_dir, "coverage").select("job_id", F.col("index").alias("cell"), "x", "y", F.explode("sources").alias("s"))
    e = e.select("job_id", "cell", "x", "y", F.col("s.source_id").alias("source_id")).filter("source_id is not null and source_id <> ''").distinct()
    n = F.substring("source_id", -5, 5).cast("bigint")
    return e.select(
        "job_id", "cell", "source_id", F.concat_ws("/", "job_id", F.col("cell").cast("string"), "source_id").alias("link_id"),
        ((n * 7919) % 10000 - 5000).cast("double").alias("ax"), ((n * 104729) % 10000 - 5000).cast("double").alias("ay"),
        (F.lit(3) + (n % 5) * 4).cast("double").alias("ah"), F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(1.5).alias("bh"), n.alias("route_order"),
    )


def lattice(spark: SparkSession, link_rows: DataFrame, margin: int = 1) -> DataFrame:
    """Terrain nodes, every RES metres, of the tiles that the links' boxes meet with margin nodes about them; some are missing.
    The tiles are as many as links touch, however far apart these lie."""
    tile = lambda c, m: F.floor((c / F.lit(RES) + m) / links.TILE).cast("int")
    span = lambda a, b: F.sequence(tile(F.least(a, b), -margin), tile(F.greatest(a, b), margin + 1))
    t = link_rows.select(F.explode(span("ax", "bx")).alias("tx"), "ay", "by").select("tx", F.explode(span("ay", "by")).alias("ty")).distinct()
    within = F.explode(F.sequence(F.lit(0), F.lit(links.TILE - 1)))
    n = t.withColumn("i", within).withColumn("j", within).select((F.col("tx") * links.TILE + F.col("i")).alias("ix"), (F.col("ty") * links.TILE + F.col("j")).alias("iy"))
    ix, iy = F.col("ix"), F.col("iy")
    z = F.pmod(ix * 7919 + iy * 104729, F.lit(200)).cast("double")
    return n.select("ix", "iy", F.when(F.pmod(ix * 31 + iy * 17, F.lit(997)) != 0, z).alias("z"))


_LINKS = """
  e AS (SELECT DISTINCT job_id, cell, x, y, s.source_id AS source_id
        FROM (SELECT job_id, "index" AS cell, x, y, unnest(sources) AS s FROM coverage) WHERE s.source_id <> ''),
  l0 AS (SELECT *, CAST(right(source_id, 5) AS BIGINT) AS num FROM e),
  l AS (SELECT job_id, cell, source_id, job_id || '/' || cell || '/' || source_id AS link_id, CAST((num * 7919) % 10000 - 5000 AS DOUBLE) AS ax,
        CAST((num * 104729) % 10000 - 5000 AS DOUBLE) AS ay, CAST(3 + (num % 5) * 4 AS DOUBLE) AS ah, x AS bx, y AS by, 1.5e0 AS bh, num AS route_order FROM l0),
  d AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) AS d FROM l),
  n AS (SELECT *, greatest(CAST(ceil(d / 200e0) AS INT) + 1, 3) AS n FROM d)"""
_Q4 = "floor(({}) * 10000.0e0 + 0.5e0) / 10000.0e0"
_WL = "(299792458.0e0 / 869500000.0e0)"
_FSPL = "(32.44e0 + 20.0e0 * log10({0} / 1000.0e0) + 20.0e0 * log10(869.5e0))"


def _z(ix: str, iy: str) -> str:
    return f"CASE WHEN ((({ix}) * 31 + ({iy}) * 17) % 997 + 997) % 997 <> 0 THEN CAST(((({ix}) * 7919 + ({iy}) * 104729) % 200 + 200) % 200 AS DOUBLE) END"


def _ground(table: str, x: str, y: str, out: str) -> str:
    """SQL for a table with the bilinear height at (x, y)."""
    ix, iy = f"CAST(floor({x} / 100e0) AS BIGINT)", f"CAST(floor({y} / 100e0) AS BIGINT)"
    dx, dy = f"({x} / 100e0 - floor({x} / 100e0))", f"({y} / 100e0 - floor({y} / 100e0))"
    corner = lambda a, b: "(" + _z(f"{ix} + CASE WHEN {dx} = 0 THEN 0 ELSE {a} END", f"{iy} + CASE WHEN {dy} = 0 THEN 0 ELSE {b} END") + ")"
    return (
        f"SELECT *, {corner(0, 0)} * (1e0 - {dx}) * (1e0 - {dy}) + {corner(1, 0)} * {dx} * (1e0 - {dy})"
        f" + {corner(0, 1)} * (1e0 - {dx}) * {dy} + {corner(1, 1)} * {dx} * {dy} AS {out} FROM {table}"
    )


def evaluated_sql(pairs: str, tx_dbm: float = 22.0, back_dbm: float = 20.0) -> str:
    """CTEs that end in ev: the links of n, which the CTEs of `pairs` end in, with their two-way evaluation."""
    return f"""{pairs},
  ga AS ({_ground("(SELECT * FROM n WHERE n <= 4096 AND d > 0)", "ax", "ay", "za")}),
  gb AS ({_ground("ga", "bx", "by", "zb")}),
  t AS (SELECT *, za + ah AS ta, zb + bh AS tb FROM gb),
  s0 AS (SELECT *, unnest(range(n)) AS i FROM t),
  s1 AS (SELECT *, CASE WHEN i = n - 1 THEN d ELSE i * (d / (n - 1)) END AS di FROM s0),
  s2 AS (SELECT *, ax + di / d * (bx - ax) AS px, ay + di / d * (by - ay) AS py FROM s1),
  s3 AS ({_ground("s2", "px", "py", "z")}),
  s4 AS (SELECT *, z + di * (d - di) / (2.0e0 * 6371000.0e0) AS h, ta + di / d * (tb - ta) AS los, sqrt({_WL} * di * (d - di) / d) AS r, (tb - ta) / d AS slope,
         i > 0 AND i < n - 1 AS inner_ FROM s3),
  s5 AS (SELECT *, los - h AS clear, CASE WHEN r <= 1e-9 THEN CAST('inf' AS DOUBLE) ELSE (los - h) / r END AS ratio FROM s4),
  m0 AS (SELECT link_id, count(*) FILTER (WHERE z IS NULL) AS missing, min(clear) FILTER (WHERE inner_) AS clearance, min(ratio) FILTER (WHERE inner_) AS ratio,
         max(r) AS radius, max((h - ta) / di) FILTER (WHERE inner_) AS s_tx, max((h - tb) / (d - di)) FILTER (WHERE inner_) AS s_rx,
         max((h - (ta + slope * di)) * sqrt(2.0e0 * d / ({_WL} * di * (d - di)))) FILTER (WHERE inner_) AS v_los,
         any_value(ta) AS ta, any_value(tb) AS tb, any_value(d) AS d, any_value(n) AS n FROM s5 GROUP BY link_id),
  m1 AS (SELECT *, (tb - ta) / d AS s_d, s_tx + s_rx AS den, d / (n - 1) AS sp FROM m0),
  m2 AS (SELECT *, least(greatest(CASE WHEN den > 0 THEN (tb - ta + s_rx * d) / den ELSE d / 2 END, sp), sp * (n - 2)) AS p FROM m1),
  m3 AS (SELECT *, CASE WHEN s_tx < s_d THEN v_los ELSE (ta + s_tx * p - (ta + s_d * p)) * sqrt(2.0e0 * d / ({_WL} * p * (d - p))) END AS v FROM m2),
  m4 AS (SELECT *, CASE WHEN v <= -0.78e0 THEN 0.0e0 ELSE 6.9e0 + 20.0e0 * log10(sqrt((v - 0.1e0) * (v - 0.1e0) + 1) + v - 0.1e0) END AS j FROM m3),
  m5 AS (SELECT *, j + (1 - exp(-j / 6.0e0)) * (10.0e0 + 0.02e0 * d / 1000.0e0) AS diff FROM m4),
  m6 AS (SELECT *, {tx_dbm}e0 + 2.15e0 - 1.0e0 - ({_FSPL.format("d")} + diff) + 2.15e0 - 1.0e0 + 130.0e0 - 10.0e0 AS fwd,
         {back_dbm}e0 + 2.15e0 - 1.0e0 - ({_FSPL.format("d")} + diff) + 2.15e0 - 1.0e0 + 130.0e0 - 10.0e0 AS rev FROM m5 WHERE missing = 0),
  ev AS (SELECT l.job_id, l.cell, l.source_id, l.link_id, l.route_order, l.d, l.n, CASE WHEN l.n > 4096 THEN 'profile cap' WHEN l.d = 0 THEN 'coincident' WHEN m6.link_id IS NULL THEN 'missing terrain' END AS state,
         m6.clearance, m6.ratio, m6.radius, m6.diff, m6.fwd, m6.rev, least(m6.fwd, m6.rev) AS two_way, m6.fwd >= 0 AND m6.rev >= 0 AS valid FROM n l LEFT JOIN m6 USING (link_id))"""


_EVALUATED = evaluated_sql(_LINKS)


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cell_links(spark, sf_dir)
    return links.evaluate(rows, links.tile_lattice(lattice(spark, rows)), RADIO, RES)


@query("l2_link_evaluation", f"""WITH {_EVALUATED} SELECT link_id, n AS n_samples, state, {_Q4.format("clearance")} AS clearance_m, {_Q4.format("ratio")} AS fresnel_ratio,
  {_Q4.format("radius")} AS fresnel_radius_m, {_Q4.format("diff")} AS diffraction_db, {_Q4.format("fwd")} AS forward_db, {_Q4.format("rev")} AS reverse_db, coalesce(valid, false) AS valid FROM ev""")
def l2(spark, d):
    e = evaluated(spark, d)
    return e.select("link_id", "n_samples", "state", *(q4(F.col(c)).alias(c) for c in ("clearance_m", "fresnel_ratio", "fresnel_radius_m", "diffraction_db")),
                    q4(F.col("forward.margin_db")).alias("forward_db"), q4(F.col("reverse.margin_db")).alias("reverse_db"), F.coalesce("valid", F.lit(False)).alias("valid"))


def rolled_up(e: DataFrame) -> DataFrame:
    """Cells from their evaluated links: counts, best margin, and its source, the first in route order on ties (A1, A2)."""
    ok = F.col("valid") & F.col("state").isNull()
    best = F.max(F.when(ok, F.struct(F.col("two_way_db"), -F.col("route_order"), F.col("source_id"))))
    c = e.groupBy("job_id", "cell").agg(
        F.count_if(ok).alias("source_count"), F.count_if(F.col("state").isin("missing terrain", "coincident")).alias("unknown_sources"),
        F.count_if(F.col("state") == "profile cap").alias("unresolved_sources"), best.alias("best"),
    )
    state = F.when(F.col("source_count") > 0, "covered").when(F.col("unresolved_sources") > 0, "unresolved").when(F.col("unknown_sources") > 0, "unknown_terrain").otherwise("uncovered")
    return c.select("job_id", "cell", state.alias("state"), "source_count", "unknown_sources", "unresolved_sources", F.col("best.two_way_db").alias("best_db"), F.col("best.source_id").alias("best_source_id"))


_CELLS = f"""{_EVALUATED},
  c0 AS (SELECT job_id, cell, count(*) FILTER (WHERE valid AND state IS NULL) AS source_count, count(*) FILTER (WHERE state IN ('missing terrain', 'coincident')) AS unknown_sources,
         count(*) FILTER (WHERE state = 'profile cap') AS unresolved_sources FROM ev GROUP BY ALL),
  b AS (SELECT job_id, cell, source_id, two_way FROM ev WHERE valid AND state IS NULL
        QUALIFY row_number() OVER (PARTITION BY job_id, cell ORDER BY two_way DESC, route_order, source_id DESC) = 1),
  c AS (SELECT c0.*, b.source_id AS best_source_id, b.two_way AS best, CASE WHEN source_count > 0 THEN 'covered' WHEN unresolved_sources > 0 THEN 'unresolved'
        WHEN unknown_sources > 0 THEN 'unknown_terrain' ELSE 'uncovered' END AS state FROM c0 LEFT JOIN b USING (job_id, cell))"""


@query("c3_coverage_run", f"WITH {_CELLS} SELECT job_id, cell, state, source_count, unknown_sources, unresolved_sources, {_Q4.format('best')} AS best_db, best_source_id FROM c")
def c3(spark, d):
    return rolled_up(evaluated(spark, d)).withColumn("best_db", q4(F.col("best_db")))


@query("a3_run_counters", f"WITH {_CELLS} SELECT job_id, state, count(*) AS cells FROM c GROUP BY ALL")
def a3(spark, d):
    return rolled_up(evaluated(spark, d)).groupBy("job_id", "state").agg(F.count("*").alias("cells"))


@query("l5_gate_before_sampling", f"WITH {_LINKS} SELECT CASE WHEN n > 60 THEN 'profile cap' WHEN d = 0 THEN 'coincident' ELSE 'sampled' END AS gate, count(*) AS links, CAST(sum(n) AS BIGINT) AS samples FROM n GROUP BY ALL")
def l5(spark, d):
    e = with_length(spark, d)
    gate = F.when(F.col("n") > GATE_SAMPLES, "profile cap").when(F.col("d") == 0, "coincident").otherwise("sampled")
    return e.groupBy(gate.alias("gate")).agg(F.count("*").alias("links"), F.sum("n").cast("bigint").alias("samples"))


def with_length(spark, d):
    e = cell_links(spark, d).withColumn("d", rf.planar_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return e.withColumn("n", rf.sample_count(F.col("d"), RADIO.sample_step_m, RES))


_SCALAR = {
    # name: (column, SQL) over a link's length d, its ends' heights ah, bh, and a point a third of the way
    "f1_fspl": (lambda: rf.fspl_db(F.col("d"), 869.5), _FSPL.format("d")),
    "f2_received_power": (lambda: rf.received_dbm(22.0, 2.15, 1.0, rf.fspl_db(F.col("d"), 869.5), 2.15, 1.0, 0.5), f"22.0e0 + 2.15e0 - 1.0e0 - {_FSPL.format('d')} + 2.15e0 - 1.0e0 - 0.5e0"),
    "f3_earth_bulge": (lambda: rf.earth_bulge_m(F.col("d") / 3, F.col("d"), 1.33), "d / 3 * (d - d / 3) / (2.0e0 * 6371000.0e0 * 1.33e0)"),
    "f4_fresnel_radius": (lambda: rf.fresnel_radius_m(F.col("d") / 3, F.col("d") - F.col("d") / 3, 869.5), f"CASE WHEN d / 3 + (d - d / 3) = 0 THEN 0e0 ELSE sqrt({_WL} * (d / 3) * (d - d / 3) / (d / 3 + (d - d / 3))) END"),
    "f5_knife_edge_loss": (lambda: rf.knife_edge_db((F.col("ah") - 8) / 4), "CASE WHEN (ah - 8) / 4 <= -0.78e0 THEN 0.0e0 ELSE 6.9e0 + 20.0e0 * log10(sqrt(((ah - 8) / 4 - 0.1e0) * ((ah - 8) / 4 - 0.1e0) + 1.0e0) + (ah - 8) / 4 - 0.1e0) END"),
    "f6_knife_edge_v": (lambda: rf.knife_edge_v(F.col("ah"), F.col("d") / 3, F.col("d") - F.col("d") / 3, 869.5), f"ah * sqrt(2.0e0 * (d / 3 + (d - d / 3)) / ({_WL} * (d / 3) * (d - d / 3)))"),
    "f7_bullington_extra": (lambda: rf.bullington_db(F.col("ah"), F.col("d")), "ah + (1 - exp(-ah / 6.0e0)) * (10.0e0 + 0.02e0 * d / 1000.0e0)"),
    "f8_elevation_angle": (lambda: rf.elevation_deg(F.col("d"), F.col("bh"), F.col("ah")), "degrees(atan2(ah - bh, d))"),
    "f14_planar_distance": (lambda: F.col("d"), "d"),
    "l1_optimistic_margin": (lambda: rf.optimistic_margin_db(F.col("d"), rf.Radio()), f"22.0e0 + 2.15e0 - 1.0e0 - {_FSPL.format('d')} + 2.15e0 - 1.0e0 - 0.0e0 + 130.0e0 - 10.0e0"),
}
for _name, (_column, _sql) in _SCALAR.items():

    @query(_name, f"WITH {_LINKS} SELECT link_id, {_Q4.format(_sql)} AS v FROM n WHERE d > 0")
    def _(spark, d, column=_column):
        return with_length(spark, d).filter("d > 0").select("link_id", q4(column()).alias("v"))


_ANT = "(-30e0, -12e0), (-10e0, -1e0), (0e0, 2.15e0), (12e0, 0.5e0), (45e0, -20e0)"


@query("f9_antenna_gain", f"""WITH {_LINKS}, a AS (SELECT * FROM (VALUES {_ANT}) v(angle, gain)), seg AS (SELECT angle AS a0, gain AS g0, lead(angle) OVER (ORDER BY angle) AS a1, lead(gain) OVER (ORDER BY angle) AS g1 FROM a),
  x AS (SELECT link_id, degrees(atan2((ah - bh) * 60, d)) - 20e0 AS w FROM n WHERE d > 0)
  SELECT link_id, {_Q4.format("CASE WHEN w < -30e0 THEN -12e0 WHEN a1 IS NULL THEN g0 ELSE g0 + (w - a0) / (a1 - a0) * (g1 - g0) END")} AS gain_dbi FROM x LEFT JOIN seg ON w >= a0 AND (w < a1 OR a1 IS NULL)""")
def f9(spark, d):
    pattern = F.array(*(F.struct(F.lit(a).alias("angle"), F.lit(g).alias("gain")) for a, g in ((-30.0, -12.0), (-10.0, -1.0), (0.0, 2.15), (12.0, 0.5), (45.0, -20.0))))
    angle = rf.elevation_deg(F.col("d"), F.lit(0.0), (F.col("ah") - F.col("bh")) * 60) - 20.0
    return with_length(spark, d).filter("d > 0").select("link_id", q4(rf.gain_at(pattern, angle)).alias("gain_dbi"))


@query("f11_lora_sensitivity", """SELECT packet_id, observation_key, floor((-174e0 + 10e0 * log10(125000e0) + 6e0 + CASE 7 + payload_type % 6 WHEN 7 THEN -7.5e0 WHEN 8 THEN -10e0 WHEN 9 THEN -12.5e0
  WHEN 10 THEN -15e0 WHEN 11 THEN -17.5e0 ELSE -20e0 END) * 10000e0 + 0.5e0) / 10000e0 AS sensitivity_dbm FROM (SELECT DISTINCT packet_id, observation_key, payload_type FROM observations)""")
def f11(spark, d):
    o = load(spark, d, "observations").select("packet_id", "observation_key", "payload_type").distinct()
    return o.select("packet_id", "observation_key", q4(rf.lora_sensitivity_dbm(F.lit(125000.0), F.lit(6.0), F.lit(7) + F.col("payload_type") % 6)).alias("sensitivity_dbm"))


@query("f16_profile_sampling", f"WITH {_LINKS} SELECT link_id, n AS n_samples, {_Q4.format('d / (n - 1)')} AS spacing_m, n <= 60 AS fits FROM n")
def f16(spark, d):
    return with_length(spark, d).select("link_id", F.col("n").alias("n_samples"), q4(F.col("d") / (F.col("n") - 1)).alias("spacing_m"), (F.col("n") <= GATE_SAMPLES).alias("fits"))


@query("j20_profile_explode", f"WITH {_LINKS}, s AS (SELECT link_id, d, n, unnest(range(n)) AS i FROM n WHERE n <= 4096 AND d > 0) SELECT link_id, CAST(count(*) AS BIGINT) AS samples, {_Q4.format('max(CASE WHEN i = n - 1 THEN d ELSE i * (d / (n - 1)) END)')} AS last_m FROM s GROUP BY link_id")
def j20(spark, d):
    s = links.profile_samples(with_length(spark, d).filter((F.col("n") <= RADIO.max_samples) & (F.col("d") > 0)), RADIO, RES)
    return s.groupBy("link_id").agg(F.count("*").alias("samples"), q4(F.max("di")).alias("last_m"))


@query("s11_bilinear_ground", f"WITH {_LINKS}, g AS ({_ground('n', 'bx', 'by', 'z')}) SELECT link_id, {_Q4.format('z')} AS ground_m FROM g")
def s11(spark, d):
    rows = cell_links(spark, d)
    return links.with_ground(rows, links.tile_lattice(lattice(spark, rows)), "bx", "by", "z", RES).select("link_id", q4(F.col("z")).alias("ground_m"))


@query("j2_pixel_ground", f"WITH {_LINKS} SELECT link_id, {_z('CAST(floor(bx / 100e0) AS BIGINT)', 'CAST(floor(by / 100e0) AS BIGINT)')} AS pixel_m FROM n")
def j2(spark, d):
    """A sample is the pixel that the inverse affine falls in; an equi-join on (column, row)."""
    rows = cell_links(spark, d).withColumns({"ix": F.floor(F.col("bx") / RES).cast("int"), "iy": F.floor(F.col("by") / RES).cast("int")})
    return rows.join(lattice(spark, rows), ["ix", "iy"], "left").select("link_id", F.col("z").alias("pixel_m"))


@query("a10_path_bottleneck", f"WITH {_EVALUATED} SELECT job_id, source_id, {_Q4.format('min(two_way)')} AS bottleneck_db, bool_and(valid) AS all_valid FROM ev WHERE state IS NULL GROUP BY ALL")
def a10(spark, d):
    e = evaluated(spark, d).filter("state is null")
    return e.groupBy("job_id", "source_id").agg(q4(F.min("two_way_db")).alias("bottleneck_db"), F.bool_and("valid").alias("all_valid"))


@query("t6_weakest_links", f"WITH {_EVALUATED} SELECT link_id, {_Q4.format('two_way')} AS two_way_db FROM ev ORDER BY floor(two_way * 10000e0 + 0.5e0) ASC NULLS LAST, link_id LIMIT 10")
def t6(spark, d):
    e = evaluated(spark, d).select("link_id", q4(F.col("two_way_db")).alias("two_way_db"))
    return e.orderBy(F.asc_nulls_last("two_way_db"), "link_id").limit(10)


@query("t1_exact_point_sources", f"""WITH {_EVALUATED} SELECT job_id, cell, source_id, row_number() OVER (PARTITION BY job_id, cell ORDER BY coalesce(valid, false) DESC, floor(two_way * 10000e0 + 0.5e0) DESC NULLS LAST, source_id) AS place,
  CASE WHEN state = 'profile cap' THEN state WHEN state IS NOT NULL THEN 'missing terrain' WHEN NOT valid THEN 'radio margin' END AS rejection FROM ev""")
def t1(spark, d):
    """Every source of a point with its rejection, the usable first, then by margin and id."""
    from pyspark.sql import Window

    e = evaluated(spark, d).withColumn("m", q4(F.col("two_way_db")))
    w = Window.partitionBy("job_id", "cell").orderBy(F.coalesce("valid", F.lit(False)).desc(), F.desc_nulls_last("m"), "source_id")  # a cell's sources
    why = F.when(F.col("state") == "profile cap", F.col("state")).when(F.col("state").isNotNull(), "missing terrain").when(~F.col("valid"), "radio margin")
    return e.select("job_id", "cell", "source_id", F.row_number().over(w).alias("place"), why.alias("rejection"))

# "by" is a keyword to some parsers; the words of GROUP BY and ORDER BY are in capitals here.
for _name, _sql in ORACLE.items():
    ORACLE[_name] = re.sub(r'(?<!")\bby\b(?!")', '"by"', _sql)
