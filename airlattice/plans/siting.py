"""Candidate sites and screening over the nodes of the latest runs: corridors, grids, quality, thinning, neighbours.

Every located node of each endpoint's latest complete run is a site, in the local metres of its endpoint's mean position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.functions import geo
from airlattice.plans import mesh
from airlattice.plans.registry import Registry
from airlattice.tables import cut, load

query = Registry()
QUERIES, ORACLE = query.QUERIES, query.ORACLE


def q3(c):
    return F.floor(c * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def sites(spark: SparkSession, d: str) -> DataFrame:
    """endpoint, id, x, y, z, slope: metres from whole reference degrees, heights and slopes by integers of the position."""
    n = mesh.nodes(spark, d).filter(mesh.valid_location("lat", "lon")).groupBy("endpoint", F.col("pubkey").alias("id")).agg(F.min(F.struct("lat", "lon")).alias("p"))
    x, y = F.floor(F.col("p.lon") * 60000.0 + 0.5), F.floor(F.col("p.lat") * 111320.0 + 0.5)
    n = n.select("endpoint", "id", x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return n.withColumns({"z": F.pmod(F.col("x") * 7 + F.col("y") * 13, F.lit(500)), "slope": F.pmod(F.col("x") + F.col("y"), F.lit(100)) / 50.0})


_S = mesh._CTE + f""", p AS (SELECT endpoint, pubkey AS id, lat, lon FROM nodes WHERE {mesh._OK.format("lat", "lon")} QUALIFY row_number() OVER (PARTITION BY endpoint, pubkey ORDER BY lat, lon) = 1),
  s0 AS (SELECT endpoint, id, CAST(floor(lon * 60000e0 + 0.5e0) AS BIGINT) AS x, CAST(floor(lat * 111320e0 + 0.5e0) AS BIGINT) AS y FROM p),
  s AS (SELECT *, ((x * 7 + y * 13) % 500 + 500) % 500 AS z, ((x + y) % 100 + 100) % 100 / 50e0 AS slope FROM s0)"""

NEIGHBOURS = 4
CELL = 20_000  #: metres of a bucket in the neighbour search


def nearest(points: DataFrame, k: int = NEIGHBOURS, cell: int = CELL, rings: int = 16) -> DataFrame:
    """(endpoint, a, b, d2) the k nearest others of each point, ties by id.

    Buckets are searched ring by ring: a point is done once its k-th neighbour is nearer than the ring reaches, so most
    points end with the first ring, and the search goes on with the rest alone. The few that lie farther from k others
    than the last ring reaches are measured against all points of their endpoint.
    """
    b = cut(points.select("endpoint", "id", "x", "y", F.expr(f"floor(x / {cell})").alias("cx"), F.expr(f"floor(y / {cell})").alias("cy")))

    def best(pairs: DataFrame) -> DataFrame:
        d2 = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
        near = pairs.filter("a <> id").select("endpoint", "a", F.col("id").alias("b"), d2.alias("d2"))
        place = F.row_number().over(Window.partitionBy("endpoint", "a").orderBy("d2", "b"))  # those beyond k fall out before the shuffle
        top = near.withColumn("place", place).filter(F.col("place") <= k)
        return top.groupBy("endpoint", "a").agg(F.array_sort(F.collect_list(F.struct("d2", "b"))).alias("l"))

    left, done, reach = b, None, 1
    while reach <= rings and left.take(1):
        ring = F.sequence(F.lit(-reach), F.lit(reach))
        near = left.select("endpoint", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.transform(ring, lambda i: F.col("cx") + i)).alias("cx"), "cy")
        near = near.select("endpoint", "a", "ax", "ay", "cx", F.explode(F.transform(ring, lambda i: F.col("cy") + i)).alias("cy"))
        ranked = cut(best(near.join(b, ["endpoint", "cx", "cy"])).filter((F.size("l") == k) & (F.element_at("l", -1)["d2"] <= (reach * cell) ** 2)))
        done = ranked if done is None else done.unionByName(ranked)
        left = cut(left.join(ranked.select("endpoint", F.col("a").alias("id")), ["endpoint", "id"], "left_anti"))
        reach *= 4
    rest = best(left.select("endpoint", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")).join(b, "endpoint"))
    done = rest if done is None else done.unionByName(rest)
    return done.select("endpoint", "a", F.explode("l").alias("n")).select("endpoint", "a", "n.b", "n.d2")


@query("j3_nearest_neighbours", _S + f""" SELECT a.endpoint, a.id AS a, b.id AS b, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2 FROM s a JOIN s b ON a.endpoint = b.endpoint AND a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.endpoint, a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) <= {NEIGHBOURS}""")
def j3(spark, d):
    return nearest(sites(spark, d))


@query("j3_screened_pairs", _S + f""", k AS (SELECT a.endpoint, a.id AS a, b.id AS b FROM s a JOIN s b ON a.endpoint = b.endpoint AND a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.endpoint, a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) <= {NEIGHBOURS}) SELECT DISTINCT endpoint, least(a, b) AS a, greatest(a, b) AS b FROM k""")
def j3b(spark, d):
    return nearest(sites(spark, d)).select("endpoint", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().select("endpoint", F.col("x").alias("a"), F.col("y").alias("b"))


@query("pp1_corridor_sites", _S + """, c AS (SELECT endpoint, min(x) AS ax, min(y) AS ay, max(x) AS bx, max(y) AS "by" FROM s GROUP BY endpoint), l AS (SELECT s.*, c.ax, c.ay, CAST(c.bx - c.ax AS DOUBLE) AS dx, CAST(c."by" - c.ay AS DOUBLE) AS dy FROM s JOIN c USING (endpoint)),
  m AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM l) SELECT endpoint, id FROM m WHERE len > 0 AND ((x - ax) * dx + (y - ay) * dy) / len >= -15000e0 AND ((x - ax) * dx + (y - ay) * dy) / len <= len + 15000e0 AND abs(((x - ax) * dy - (y - ay) * dx) / len) <= 15000e0""")
def corridor(spark, d):
    s = sites(spark, d)
    c = s.groupBy("endpoint").agg(F.min("x").alias("ax"), F.min("y").alias("ay"), F.max("x").alias("bx"), F.max("y").alias("by"))
    f = lambda c_: F.col(c_).cast("double")
    return s.join(c, "endpoint").filter(geo.inside_corridor(f("x"), f("y"), (f("ax"), f("ay")), (f("bx"), f("by")), 15000.0)).select("endpoint", "id")


@query("pp3_segment_distance", _S + """, c AS (SELECT endpoint, min(x) AS ax, min(y) AS ay, max(x) AS bx, max(y) AS "by" FROM s GROUP BY endpoint), l AS (SELECT s.*, CAST(c.ax AS DOUBLE) AS ax, CAST(c.ay AS DOUBLE) AS ay, CAST(c.bx - c.ax AS DOUBLE) AS dx, CAST(c."by" - c.ay AS DOUBLE) AS dy FROM s JOIN c USING (endpoint)),
  t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM l)
  SELECT endpoint, id, floor(sqrt((x - (ax + t * dx)) * (x - (ax + t * dx)) + (y - (ay + t * dy)) * (y - (ay + t * dy))) * 1000e0 + 0.5e0) / 1000e0 AS metres FROM t""")
def p3(spark, d):
    s = sites(spark, d)
    c = s.groupBy("endpoint").agg(F.min("x").alias("ax"), F.min("y").alias("ay"), F.max("x").alias("bx"), F.max("y").alias("by"))
    f = lambda c_: F.col(c_).cast("double")
    return s.join(c, "endpoint").select("endpoint", "id", q3(geo.segment_distance(f("x"), f("y"), (f("ax"), f("ay")), (f("bx"), f("by")))).alias("metres"))


_QUALITY = _S + """, r AS (SELECT endpoint, min(z) AS lo, greatest(max(z) - min(z), 1) AS span FROM s GROUP BY endpoint),
  c AS (SELECT s.*, CAST(floor(x / 2000e0) AS BIGINT) AS cx, CAST(floor(y / 2000e0) AS BIGINT) AS cy, CAST(z - lo AS DOUBLE) / span - 0.35e0 * least(slope, 1e0) AS quality FROM s JOIN r USING (endpoint))"""


def scored(spark, d) -> DataFrame:
    """Quality by height over the endpoint's range and slope, with the site's grid cell."""
    s = sites(spark, d)
    r = s.groupBy("endpoint").agg(F.min("z").alias("lo"), F.greatest(F.max("z") - F.min("z"), F.lit(1)).alias("span"))
    quality = (F.col("z") - F.col("lo")).cast("double") / F.col("span") - F.lit(0.35) * F.least("slope", F.lit(1.0))
    key = lambda c: F.floor(F.col(c) / 2000.0).cast("bigint")
    return s.join(r, "endpoint").select("endpoint", "id", "x", "y", "z", quality.alias("quality"), key("x").alias("cx"), key("y").alias("cy"))


@query("f19_site_quality", _QUALITY + " SELECT endpoint, id, floor(quality * 1000e0 + 0.5e0) / 1000e0 AS quality, cx, cy FROM c")
def f19(spark, d):
    return scored(spark, d).select("endpoint", "id", q3(F.col("quality")).alias("quality"), "cx", "cy")


def thinned(spark, d, keep: int = 3) -> DataFrame:
    """The best so many sites of each cell, by quality, height, id. A bounded best list a cell, combined before the shuffle."""
    order = F.struct((-F.col("quality")).alias("q"), (-F.col("z")).alias("h"), "id", "x", "y")
    best = scored(spark, d).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    top = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, keep)
    part = best.groupBy("endpoint", "cx", "cy", "salt").agg(top(order).alias("l"))
    whole = part.select("endpoint", "cx", "cy", F.explode("l").alias("o")).groupBy("endpoint", "cx", "cy").agg(top(F.col("o")).alias("l"))
    return whole.select("endpoint", "cx", "cy", F.posexplode("l").alias("rank", "o")).select("endpoint", "cx", "cy", (F.col("rank") + 1).alias("rank"), "o.id", "o.x", "o.y")


_THIN = _QUALITY + ", t AS (SELECT *, row_number() OVER (PARTITION BY endpoint, cx, cy ORDER BY quality DESC, z DESC, id) AS rank FROM c QUALIFY rank <= 3)"


@query("w2_best_per_cell", _THIN + " SELECT endpoint, cx, cy, CAST(rank AS INT) AS rank, id FROM t")
def w2(spark, d):
    return thinned(spark, d).select("endpoint", "cx", "cy", F.col("rank").cast("int").alias("rank"), "id")


@query("w3_round_robin_bands", _THIN + """, b AS (SELECT *, CAST(floor(y / 50000e0) AS BIGINT) AS band FROM t), turns AS (SELECT *, row_number() OVER (PARTITION BY endpoint, band ORDER BY rank, id) AS turn FROM b)
  SELECT endpoint, band, CAST(turn AS INT) AS turn, id FROM turns WHERE turn <= 20""")
def w3(spark, d):
    """The thinned sites taken in turn from bands along the route, twenty turns of each."""
    b = thinned(spark, d).withColumn("band", F.floor(F.col("y") / 50000.0).cast("bigint"))
    w = Window.partitionBy("endpoint", "band").orderBy("rank", "id")
    return b.withColumn("turn", F.row_number().over(w)).filter("turn <= 20").select("endpoint", "band", F.col("turn").cast("int").alias("turn"), "id")


@query("a26_principal_axis", _S + """, m AS (SELECT endpoint, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS mx, CAST(sum(y) AS DOUBLE) / count(*) AS my, CAST(sum(CAST(x AS HUGEINT) * x) AS DOUBLE) AS xx, CAST(sum(CAST(y AS HUGEINT) * y) AS DOUBLE) AS yy, CAST(sum(CAST(x AS HUGEINT) * y) AS DOUBLE) AS xy FROM s GROUP BY endpoint)
  SELECT endpoint, n, floor(0.5e0 * atan2(2 * (xy / n - mx * my), (xx / n - mx * mx) - (yy / n - my * my)) * 1000e0 + 0.5e0) / 1000e0 AS angle_rad FROM m""")
def a26(spark, d):
    """Direction of the sites' principal axis, from exact integer sums."""
    dec = lambda c: c.cast("decimal(38,0)")
    x, y = F.col("x").cast("decimal(18,0)"), F.col("y").cast("decimal(18,0)")
    m = sites(spark, d).groupBy("endpoint").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(dec(x * x)).cast("double").alias("xx"), F.sum(dec(y * y)).cast("double").alias("yy"), F.sum(dec(x * y)).cast("double").alias("xy"))
    mx, my, n = F.col("sx").cast("double") / F.col("n"), F.col("sy").cast("double") / F.col("n"), F.col("n")
    angle = F.lit(0.5) * F.atan2(2 * (F.col("xy") / n - mx * my), (F.col("xx") / n - mx * mx) - (F.col("yy") / n - my * my))
    return m.select("endpoint", "n", q3(angle).alias("angle_rad"))


_POLICY = """, po AS (SELECT endpoint, id, z % 5 <> 0 AS enabled, CASE z % 3 WHEN 0 THEN 'optional' WHEN 1 THEN 'required' ELSE 'excluded' END AS policy, z % 2 = 0 AS known FROM s)"""


@query("pp13_site_policy", _S + _POLICY + """, m AS (SELECT *, unnest(['all', 'proposed_only', 'existing_only']) AS mode FROM po WHERE enabled AND policy <> 'excluded')
  SELECT endpoint, mode, id, policy = 'required' AS required FROM m WHERE mode = 'all' OR (mode = 'existing_only') = known""")
def p13(spark, d):
    """The sites that each mode of a search may use: enabled and not excluded; all, proposed ones only, or existing ones only.
    What is enabled, excluded, required and known is drawn from a site's height."""
    policy = F.when(F.col("z") % 3 == 0, "optional").when(F.col("z") % 3 == 1, "required").otherwise("excluded")
    s = sites(spark, d).select("endpoint", "id", policy.alias("policy"), (F.col("z") % 5 != 0).alias("enabled"), (F.col("z") % 2 == 0).alias("known"))
    s = s.filter("enabled and policy <> 'excluded'").withColumn("mode", F.explode(F.array(*map(F.lit, ("all", "proposed_only", "existing_only")))))
    return s.filter("mode = 'all' or (mode = 'existing_only') = known").select("endpoint", "mode", "id", (F.col("policy") == "required").alias("required"))


BACKBONE = 12  #: sites of a network's backbone; a quarter of them may be ones that are known


@query("w4_backbone_sites", _S + _POLICY + f""", inc AS (SELECT s.endpoint, s.id, s.x, s.y, s.z, s.z / 500e0 - 0.35e0 * least(s.slope, 1e0) AS q, po.known FROM s JOIN po ON po.endpoint = s.endpoint AND po.id = s.id WHERE enabled AND policy <> 'excluded'),
  big AS (SELECT *, count(*) OVER (PARTITION BY endpoint) AS n FROM inc),
  kn AS (SELECT * FROM big WHERE known AND n > {BACKBONE} QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY q DESC, z DESC, id) <= {BACKBONE // 4}),
  pool AS (SELECT * FROM big WHERE n > {BACKBONE} AND NOT known UNION ALL SELECT * FROM kn),
  m AS (SELECT endpoint, count(*) AS c, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * x) AS DOUBLE) AS xx, CAST(sum(y * y) AS DOUBLE) AS yy, CAST(sum(x * y) AS DOUBLE) AS xy FROM pool GROUP BY endpoint),
  an AS (SELECT endpoint, sx / c AS mx, sy / c AS my, 0.5e0 * atan2(2e0 * (xy / c - sx / c * (sy / c)), (xx / c - sx / c * (sx / c)) - (yy / c - sy / c * (sy / c))) AS angle FROM m),
  ro AS (SELECT pool.*, (x - mx) * cos(angle) + (y - my) * sin(angle) AS u, (y - my) * cos(angle) - (x - mx) * sin(angle) AS v FROM pool JOIN an USING (endpoint)),
  bo AS (SELECT endpoint, min(u) AS lu, min(v) AS lv, greatest(sqrt((max(u) - min(u)) * (max(v) - min(v)) / {BACKBONE}e0), greatest(max(u) - min(u), max(v) - min(v)) / {BACKBONE}e0) AS size FROM ro GROUP BY endpoint),
  sp AS (SELECT ro.* FROM ro JOIN bo USING (endpoint) WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY endpoint, floor((u - lu) / size), floor((v - lv) / size) ORDER BY q DESC, z DESC, id) = 1),
  al AS (SELECT endpoint, id, q, z, 0 AS tier FROM kn UNION ALL SELECT endpoint, id, q, z, 1 FROM sp UNION ALL SELECT endpoint, id, q, z, 2 FROM pool),
  fi AS (SELECT endpoint, id, min(tier) AS tier, any_value(q) AS q, any_value(z) AS z FROM al GROUP BY endpoint, id QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY min(tier), any_value(q) DESC, any_value(z) DESC, id) <= {BACKBONE})
  SELECT endpoint, id FROM fi UNION ALL SELECT endpoint, id FROM big WHERE n <= {BACKBONE}""")
def w4(spark, d):
    """The sites of each network's backbone. Of its known sites the best few; then the best of each square of a grid
    along the principal axis, as many squares as the backbone has sites; then the best that are left. A network of no more
    sites than that keeps all."""
    policy = F.when(F.col("z") % 3 == 0, "optional").when(F.col("z") % 3 == 1, "required").otherwise("excluded")
    inc = cut(
        sites(spark, d).filter((F.col("z") % 5 != 0) & (policy != "excluded"))
        .select("endpoint", "id", "x", "y", "z", (F.col("z") / 500.0 - 0.35 * F.least("slope", F.lit(1.0))).alias("q"), (F.col("z") % 2 == 0).alias("known"))
    )
    inc = inc.join(inc.groupBy("endpoint").agg(F.count("*").alias("n")), "endpoint")
    large, order = inc.filter(F.col("n") > BACKBONE), [F.desc("q"), F.desc("z"), "id"]
    first = lambda t, k, *by: t.withColumn("r", F.row_number().over(Window.partitionBy("endpoint", *by).orderBy(*order))).filter(F.col("r") <= k).drop("r")
    known = first(large.filter("known"), BACKBONE // 4)
    pool = cut(large.filter("not known").unionByName(known))
    dec = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    x, y = F.col("x"), F.col("y")
    m = pool.groupBy("endpoint").agg(F.count("*").alias("c"), dec(x).alias("sx"), dec(y).alias("sy"), dec(x * x).alias("xx"), dec(y * y).alias("yy"), dec(x * y).alias("xy"))
    c, mx, my = F.col("c"), F.col("sx") / F.col("c"), F.col("sy") / F.col("c")
    angle = F.lit(0.5) * F.atan2(F.lit(2.0) * (F.col("xy") / c - mx * my), (F.col("xx") / c - mx * mx) - (F.col("yy") / c - my * my))
    t = pool.join(m.select("endpoint", mx.alias("mx"), my.alias("my"), angle.alias("angle")), "endpoint")
    dx, dy, cos, sin = x - F.col("mx"), y - F.col("my"), F.cos("angle"), F.sin("angle")
    t = t.withColumns({"u": dx * cos + dy * sin, "v": dy * cos - dx * sin})
    b = t.groupBy("endpoint").agg(F.min("u").alias("lu"), F.min("v").alias("lv"), (F.max("u") - F.min("u")).alias("w"), (F.max("v") - F.min("v")).alias("h"))
    size = F.greatest(F.sqrt(F.col("w") * F.col("h") / float(BACKBONE)), F.greatest("w", "h") / float(BACKBONE))
    t = t.join(b.withColumn("size", size), "endpoint").filter("size > 0")
    t = t.withColumns({"gu": F.floor((F.col("u") - F.col("lu")) / F.col("size")), "gv": F.floor((F.col("v") - F.col("lv")) / F.col("size"))})
    tier = lambda r, k: r.select("endpoint", "id", "q", "z", F.lit(k).alias("tier"))
    ranked = tier(known, 0).unionByName(tier(first(t, 1, "gu", "gv"), 1)).unionByName(tier(pool, 2))
    ranked = ranked.groupBy("endpoint", "id").agg(F.min("tier").alias("tier"), F.first("q").alias("q"), F.first("z").alias("z"))
    place = F.row_number().over(Window.partitionBy("endpoint").orderBy("tier", *order))  # the first few: rows beyond fall out before the sort ends
    best = ranked.withColumn("r", place).filter(F.col("r") <= BACKBONE)
    return best.select("endpoint", "id").unionByName(inc.filter(F.col("n") <= BACKBONE).select("endpoint", "id"))


@query("f23_utm_zone", mesh._CTE + " SELECT endpoint, pubkey, lat, lon, CASE WHEN z = 34 THEN 33 ELSE z END AS zone FROM (SELECT *, CAST(least(greatest(floor((lon + 180) / 6) + 1, 31), 36) AS INT) AS z FROM nodes WHERE lon IS NOT NULL)")
def f23(spark, d):
    return mesh.nodes(spark, d).filter("lon is not null").select("endpoint", "pubkey", "lat", "lon", geo.norwegian_zone(F.col("lon")).alias("zone"))


@query("f24_utm_projection")
def f24(spark, d):
    s = f23(spark, d).filter(mesh.valid_location("lat", "lon"))
    return s.select("endpoint", "pubkey", geo.utm("lon", "lat", "zone").alias("p")).select("endpoint", "pubkey", q3(F.col("p.east")).alias("east"), q3(F.col("p.north")).alias("north"))


@query("f25_web_mercator", mesh._CTE + f""" SELECT DISTINCT endpoint, pubkey, lat, lon, floor(radians(lon) * 6378137e0 * 1000e0 + 0.5e0) / 1000e0 AS mx, floor(ln(tan(radians(lat)) + sqrt(tan(radians(lat)) * tan(radians(lat)) + 1)) * 6378137e0 * 100e0 + 0.5e0) / 100e0 AS my FROM nodes WHERE {mesh._OK.format("lat", "lon")}""")
def f25(spark, d):
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return mesh.nodes(spark, d).filter(mesh.valid_location("lat", "lon")).select("endpoint", "pubkey", "lat", "lon", q3(x).alias("mx"), (F.floor(y * 100.0 + 0.5) / 100.0).alias("my")).distinct()


@query("j8_polygon_overlap")
def j8(spark, d):
    """Area of the planner's polygon over each cell, by state."""
    from airlattice.plans import coverage

    area = geo.overlap_udf(coverage.POLYGON)
    c = coverage.cells(spark, d).withColumn("a", area(F.col("x") - 250.0, F.col("y") - 250.0, F.col("x") + 250.0, F.col("y") + 250.0))
    return c.filter("a > 0").groupBy("job_id", "state").agg(q3(F.sum("a")).alias("square_metres"), F.count("*").alias("n"))


@query("pp2_corridor_latlon", mesh._CTE + f""", p AS (SELECT DISTINCT endpoint, pubkey, lat, lon FROM nodes WHERE {mesh._OK.format("lat", "lon")}), c AS (SELECT endpoint, min(lat) AS lat0, min(lon) AS lon0, max(lat) AS lat1, max(lon) AS lon1 FROM p GROUP BY endpoint),
  k AS (SELECT *, greatest(cos(radians((lat0 + lat1) / 2)), 0.1e0) * 111320e0 AS sx FROM c), m AS (SELECT p.endpoint, pubkey, (lon - lon0) * sx AS x, (lat - lat0) * 111320e0 AS y, (lon1 - lon0) * sx AS dx, (lat1 - lat0) * 111320e0 AS dy FROM p JOIN k USING (endpoint)),
  l AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM m), t AS (SELECT *, greatest(0e0, least(1e0, (x * dx + y * dy) / (len * len))) AS t FROM l WHERE len > 0)
  SELECT endpoint, pubkey, CAST(round_even(sqrt((x - t * dx) * (x - t * dx) + (y - t * dy) * (y - t * dy)) / 1000, 0) AS BIGINT) AS km FROM t
  WHERE (x * dx + y * dy) / len BETWEEN -15000 AND len + 15000 AND abs((x * dy - y * dx) / len) <= 15000""")
def pp2(spark, d):
    """Nodes in a band between the corners of their endpoint, in the local metric of its mean latitude, with their
    distance in whole kilometres, halves to even."""
    n = mesh.nodes(spark, d).filter(mesh.valid_location("lat", "lon")).select("endpoint", "pubkey", "lat", "lon").distinct()
    c = n.groupBy("endpoint").agg(F.min("lat").alias("lat0"), F.min("lon").alias("lon0"), F.max("lat").alias("lat1"), F.max("lon").alias("lon1"))
    sx = F.greatest(F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2)), F.lit(0.1)) * geo.DEGREE_M
    m = n.join(c.withColumn("sx", sx), "endpoint").select(
        "endpoint", "pubkey", ((F.col("lon") - F.col("lon0")) * F.col("sx")).alias("x"), ((F.col("lat") - F.col("lat0")) * geo.DEGREE_M).alias("y"),
        ((F.col("lon1") - F.col("lon0")) * F.col("sx")).alias("dx"), ((F.col("lat1") - F.col("lat0")) * geo.DEGREE_M).alias("dy"),
    ).filter("dx <> 0 or dy <> 0")
    zero, end = (F.lit(0.0), F.lit(0.0)), (F.col("dx"), F.col("dy"))
    km = F.rint(geo.segment_distance(F.col("x"), F.col("y"), zero, end) / 1000).cast("bigint")
    return m.filter(geo.inside_corridor(F.col("x"), F.col("y"), zero, end, 15000.0)).select("endpoint", "pubkey", km.alias("km"))
