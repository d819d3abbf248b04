"""The capture map: inventory, measured hops, pairs, totals and windows, over the capture tables, for every endpoint at once.

Doubled rows are one record: each table is read distinct. Ids are compared as norm_id does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.functions import rf
from airlattice.plans.registry import Registry
from airlattice.tables import TOPOLOGY_MODES, load, norm_id

query = Registry()
QUERIES, ORACLE = query.QUERIES, query.ORACLE


def valid_location(lat: str, lon: str):
    return F.coalesce(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ((F.col(lat) != 0) | (F.col(lon) != 0)), F.lit(False))


def name_of(c: str):
    return F.nullif(F.get_json_object(c, "$.name"), F.lit(""))


def observations(spark, d, *columns: str) -> DataFrame:
    """Receptions once each, with these columns beside their key: a row that comes twice is alike in all, so the rest is not read."""
    o = load(spark, d, "observations").withColumns({"observer_id": norm_id("observer_id"), "sender_pubkey": norm_id("sender_pubkey")})
    return o.select("endpoint", "packet_id", "observation_key", *columns).distinct()


def latest_runs(spark, d) -> DataFrame:
    """Each endpoint's latest complete topology run, by id."""
    r = load(spark, d, "capture_runs").filter((F.col("status") == "complete") & F.col("mode").isin(*TOPOLOGY_MODES))
    return r.groupBy("endpoint").agg(F.max("id").alias("run_id"))


def nodes(spark, d) -> DataFrame:
    n = load(spark, d, "nodes_snapshot").join(latest_runs(spark, d), "run_id")
    return n.select("endpoint", norm_id("pubkey").alias("pubkey"), "lat", "lon", name_of("raw_json").alias("name")).distinct()


def adverts(spark, d) -> DataFrame:
    """The latest valid advert of each sender, by time in the store's reading, then packet."""
    o = observations(spark, d, "sender_pubkey", "advert_lat", "advert_lon", "advert_name").filter(F.col("sender_pubkey").isNotNull() & valid_location("advert_lat", "advert_lon"))
    w = Window.partitionBy("endpoint", "sender_pubkey").orderBy(F.desc("packet_id"), F.desc("observation_key"))
    o = o.withColumn("priority", F.row_number().over(w)).filter("priority = 1")
    return o.select("endpoint", F.col("sender_pubkey").alias("pubkey"), F.col("advert_lat").alias("lat"), F.col("advert_lon").alias("lon"), F.nullif("advert_name", F.lit("")).alias("name"))


def observers(spark, d) -> DataFrame:
    o = load(spark, d, "observers_snapshot").join(latest_runs(spark, d), "run_id")
    return o.select("endpoint", norm_id("observer_id").alias("observer_id"), "lat", "lon", name_of("raw_json").alias("name")).distinct()


def observed(spark, d) -> DataFrame:
    """U2 with J13's name pick: observers seen in receptions, and the least of their names, so that it is always the same."""
    o = load(spark, d, "observations").select("endpoint", norm_id("observer_id").alias("observer_id"), "observer_name").filter("observer_id is not null")
    return o.groupBy("endpoint", "observer_id").agg(F.min(F.nullif("observer_name", F.lit(""))).alias("name"))


def hops(spark, d) -> DataFrame:
    m = load(spark, d, "measured_hops")
    return m.withColumns({"last_hop": norm_id("last_hop"), "observer_id": norm_id("observer_id")}).distinct()


_ID = "CASE WHEN regexp_full_match({0}, '[0-9A-Fa-f]{{64}}') THEN lower({0}) WHEN {0} <> '' THEN {0} END"
_OK = "coalesce({0} BETWEEN -90 AND 90 AND {1} BETWEEN -180 AND 180 AND ({0} <> 0 OR {1} <> 0), false)"
_CTE = f"""WITH
  obs AS (SELECT DISTINCT * REPLACE ({_ID.format("observer_id")} AS observer_id, {_ID.format("sender_pubkey")} AS sender_pubkey) FROM observations),
  latest AS (SELECT endpoint, max(id) AS run_id FROM capture_runs WHERE status = 'complete' AND mode IN ('watch-topology', 'snapshot', 'run') GROUP BY endpoint),
  nodes AS (SELECT DISTINCT endpoint, {_ID.format("pubkey")} AS pubkey, lat, lon, nullif(raw_json ->> '$.name', '') AS name FROM nodes_snapshot JOIN latest USING (run_id)),
  adverts AS (SELECT endpoint, sender_pubkey AS pubkey, advert_lat AS lat, advert_lon AS lon, nullif(advert_name, '') AS name FROM obs
    WHERE sender_pubkey IS NOT NULL AND {_OK.format("advert_lat", "advert_lon")}
    QUALIFY row_number() OVER (PARTITION BY endpoint, sender_pubkey ORDER BY packet_id DESC, observation_key DESC) = 1),
  observers AS (SELECT DISTINCT endpoint, {_ID.format("observer_id")} AS observer_id, lat, lon, nullif(raw_json ->> '$.name', '') AS name FROM observers_snapshot JOIN latest USING (run_id)),
  observed AS (SELECT endpoint, observer_id, min(nullif(observer_name, '')) AS name FROM obs WHERE observer_id IS NOT NULL GROUP BY ALL),
  hops AS (SELECT DISTINCT * REPLACE ({_ID.format("last_hop")} AS last_hop, {_ID.format("observer_id")} AS observer_id) FROM measured_hops)
"""


@query("j13_latest_run", _CTE + "SELECT * FROM latest")
def j13(spark, d):
    return latest_runs(spark, d)


@query("w1_latest_advert", _CTE + "SELECT * FROM adverts")
def w1(spark, d):
    return adverts(spark, d)


@query("u2_distinct_observers", _CTE + "SELECT DISTINCT endpoint, observer_id FROM obs WHERE observer_id IS NOT NULL")
def u2(spark, d):
    return observed(spark, d).select("endpoint", "observer_id")


@query("pp17_valid_locations", f"SELECT run_id, count(*) AS rows_, count(*) FILTER (WHERE {_OK.format('lat', 'lon')}) AS located FROM nodes_snapshot GROUP BY run_id")
def p17(spark, d):
    return load(spark, d, "nodes_snapshot").groupBy("run_id").agg(F.count("*").alias("rows_"), F.count_if(valid_location("lat", "lon")).alias("located"))


@query("j11_nodes_with_adverts", _CTE + f"""SELECT n.endpoint, n.pubkey, coalesce(n.name, a.name) AS name, CASE WHEN {_OK.format("n.lat", "n.lon")} THEN n.lat ELSE a.lat END AS lat,
  CASE WHEN {_OK.format("n.lat", "n.lon")} THEN n.lon ELSE a.lon END AS lon FROM nodes n LEFT JOIN adverts a ON a.endpoint = n.endpoint AND a.pubkey = n.pubkey""")
def j11(spark, d):
    a = adverts(spark, d).select("endpoint", "pubkey", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.col("name").alias("aname"))
    n = nodes(spark, d).join(a, ["endpoint", "pubkey"], "left")
    ok = valid_location("lat", "lon")
    return n.select("endpoint", "pubkey", F.coalesce("name", "aname").alias("name"), F.when(ok, F.col("lat")).otherwise(F.col("alat")).alias("lat"), F.when(ok, F.col("lon")).otherwise(F.col("alon")).alias("lon"))


@query("j12_unlisted_adverts", _CTE + "SELECT a.* FROM adverts a WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.endpoint = a.endpoint AND n.pubkey = a.pubkey)")
def j12(spark, d):
    return adverts(spark, d).join(nodes(spark, d), ["endpoint", "pubkey"], "left_anti")


@query("j12_unlisted_observers", _CTE + "SELECT o.* FROM observed o WHERE NOT EXISTS (SELECT 1 FROM observers s WHERE s.endpoint = o.endpoint AND s.observer_id = o.observer_id)")
def j12b(spark, d):
    return observed(spark, d).join(observers(spark, d), ["endpoint", "observer_id"], "left_anti")


def inventory(spark, d) -> DataFrame:
    """Nodes, adverts of unlisted senders, observers and unlisted observers as one list."""
    col = lambda df, flag, key: df.select("endpoint", F.lit(flag).alias("is_observer"), F.col(key).alias("id"), "name", "lat", "lon")
    none = F.lit(None).cast("double")
    return (
        col(j11(spark, d), 0, "pubkey").unionByName(col(j12(spark, d), 0, "pubkey")).unionByName(col(observers(spark, d), 1, "observer_id"))
        .unionByName(col(j12b(spark, d).withColumns({"lat": none, "lon": none}), 1, "observer_id"))
    )


_INVENTORY = f"""{_CTE}, inv AS (
  SELECT n.endpoint, 0 AS is_observer, n.pubkey AS id, coalesce(n.name, a.name) AS name, CASE WHEN {_OK.format("n.lat", "n.lon")} THEN n.lat ELSE a.lat END AS lat,
    CASE WHEN {_OK.format("n.lat", "n.lon")} THEN n.lon ELSE a.lon END AS lon FROM nodes n LEFT JOIN adverts a ON a.endpoint = n.endpoint AND a.pubkey = n.pubkey
  UNION ALL SELECT endpoint, 0, pubkey, name, lat, lon FROM adverts a WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.endpoint = a.endpoint AND n.pubkey = a.pubkey)
  UNION ALL SELECT endpoint, 1, observer_id, name, lat, lon FROM observers
  UNION ALL SELECT endpoint, 1, observer_id, name, NULL, NULL FROM observed o WHERE NOT EXISTS (SELECT 1 FROM observers s WHERE s.endpoint = o.endpoint AND s.observer_id = o.observer_id))"""


@query("u1_inventory", _INVENTORY + " SELECT * FROM inv")
def u1(spark, d):
    return inventory(spark, d)


@query("t2_inventory_order", _INVENTORY + " SELECT endpoint, id, CAST(row_number() OVER (PARTITION BY endpoint ORDER BY is_observer, id) AS BIGINT) AS place FROM (SELECT DISTINCT endpoint, is_observer, id FROM inv)")
def t2(spark, d):
    # An endpoint may hold a third of all rows: places are counted from its least ids of each bucket, not in one window.
    rows = inventory(spark, d).select("endpoint", "is_observer", "id").distinct()
    bucket = F.concat(F.col("is_observer").cast("string"), F.substring("id", 1, 2))
    rows = rows.withColumn("b", bucket)
    per = rows.groupBy("endpoint", "b").agg(F.count("*").alias("n"))
    before = per.select("endpoint", "b", (F.sum("n").over(Window.partitionBy("endpoint").orderBy("b")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("endpoint", "b").orderBy("is_observer", "id"))
    return rows.withColumn("own", own).join(before, ["endpoint", "b"]).select("endpoint", "id", (F.col("own") + F.col("before")).cast("bigint").alias("place"))


def finite(c: str):
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))


def pairs(h: DataFrame, least: int = 1) -> DataFrame:
    """Directed pairs with count, medians of finite readings, and the last time seen; at least `least` receptions."""
    return h.groupBy("endpoint", "last_hop", "observer_id").agg(
        F.count("*").alias("n"), (F.median(finite("snr")) + 0.0).alias("median_snr"), (F.median(finite("rssi")) + 0.0).alias("median_rssi"), F.max("seen_unix").cast("double").alias("last_seen")
    ).filter(F.col("n") >= least)


_PAIRS = """pairs AS (SELECT endpoint, last_hop, observer_id, count(*) AS n, median(snr) FILTER (WHERE isfinite(snr)) + 0e0 AS median_snr, median(rssi) FILTER (WHERE isfinite(rssi)) + 0e0 AS median_rssi,
  CAST(max(seen_unix) AS DOUBLE) AS last_seen FROM hops GROUP BY ALL)"""


@query("a14_pair_medians", f"{_CTE}, {_PAIRS} SELECT * FROM pairs WHERE n >= 2")
def a14(spark, d):
    return pairs(hops(spark, d), 2)


@query("a13_median_per_observer", _CTE + "SELECT endpoint, observer_id, median(snr) FILTER (WHERE isfinite(snr)) + 0e0 AS median_snr, median(rssi) FILTER (WHERE isfinite(rssi)) + 0e0 AS median_rssi FROM obs GROUP BY ALL")
def a13(spark, d):
    return observations(spark, d, "observer_id", "snr", "rssi").groupBy("endpoint", "observer_id").agg((F.median(finite("snr")) + 0.0).alias("median_snr"), (F.median(finite("rssi")) + 0.0).alias("median_rssi"))


@query("a15_reception_totals", _CTE + "SELECT endpoint, count(*) AS receptions, count(DISTINCT packet_id) AS packets FROM obs GROUP BY endpoint")
def a15(spark, d):
    # Counted by packet first: an endpoint that holds a third of the rows is summed from partial counts.
    by_packet = observations(spark, d).groupBy("endpoint", "packet_id").agg(F.count("*").alias("n"))
    return by_packet.groupBy("endpoint").agg(F.sum("n").alias("receptions"), F.count("packet_id").alias("packets"))


@query("a16_pair_count", _CTE + "SELECT endpoint, count(*) AS pairs FROM (SELECT DISTINCT endpoint, last_hop, observer_id FROM hops) GROUP BY endpoint")
def a16(spark, d):
    return hops(spark, d).select("endpoint", "last_hop", "observer_id").distinct().groupBy("endpoint").agg(F.count("*").alias("pairs"))


def located(spark, d) -> DataFrame:
    """Places of ids: an observer's own, else that of the node of the same key."""
    n = j11(spark, d).unionByName(j12(spark, d).select("endpoint", "pubkey", "name", "lat", "lon")).filter("lat is not null and lon is not null")
    n = n.groupBy("endpoint", "pubkey").agg(F.min(F.struct("lat", "lon")).alias("p")).select("endpoint", F.col("pubkey").alias("id"), "p")
    o = observers(spark, d).groupBy("endpoint", "observer_id").agg(F.min(F.when(valid_location("lat", "lon"), F.struct("lat", "lon"))).alias("own"))
    o = o.unionByName(observed(spark, d).select("endpoint", "observer_id").join(o, ["endpoint", "observer_id"], "left_anti").withColumn("own", F.lit(None).cast("struct<lat:double,lon:double>")))
    o = o.select("endpoint", F.col("observer_id").alias("id"), "own").join(n, ["endpoint", "id"], "left").select("endpoint", "id", F.coalesce("own", "p").alias("p"))
    return n.withColumn("is_observer", F.lit(0)).unionByName(o.filter("p is not null").withColumn("is_observer", F.lit(1)))


def pair_ends(spark, d) -> DataFrame:
    """Pairs with both ends located; `from` is a node, else an observer, `to` an observer."""
    at = located(spark, d)
    f = at.groupBy("endpoint", "id").agg(F.min(F.struct("is_observer", "p")).alias("f")).select("endpoint", F.col("id").alias("last_hop"), F.col("f.p").alias("f"))
    t = at.filter("is_observer = 1").select("endpoint", F.col("id").alias("observer_id"), F.col("p").alias("t"))
    return pairs(hops(spark, d)).join(f, ["endpoint", "last_hop"]).join(t, ["endpoint", "observer_id"])


_ENDS = f"""{_CTE}, {_PAIRS},
  n0 AS (SELECT n.endpoint, n.pubkey AS id, CASE WHEN {_OK.format("n.lat", "n.lon")} THEN n.lat ELSE a.lat END AS lat, CASE WHEN {_OK.format("n.lat", "n.lon")} THEN n.lon ELSE a.lon END AS lon
    FROM nodes n LEFT JOIN adverts a ON a.endpoint = n.endpoint AND a.pubkey = n.pubkey
    UNION ALL SELECT endpoint, pubkey, lat, lon FROM adverts a WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.endpoint = a.endpoint AND n.pubkey = a.pubkey)),
  n1 AS (SELECT endpoint, id, lat, lon FROM n0 WHERE lat IS NOT NULL AND lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY endpoint, id ORDER BY lat, lon) = 1),
  o0 AS (SELECT endpoint, observer_id AS id, lat, lon FROM observers WHERE {_OK.format("lat", "lon")} QUALIFY row_number() OVER (PARTITION BY endpoint, observer_id ORDER BY lat, lon) = 1),
  o1 AS (SELECT endpoint, observer_id AS id FROM observers UNION SELECT endpoint, observer_id FROM observed),
  o2 AS (SELECT o1.endpoint, o1.id, coalesce(o0.lat, n1.lat) AS lat, coalesce(o0.lon, n1.lon) AS lon FROM o1 LEFT JOIN o0 USING (endpoint, id) LEFT JOIN n1 USING (endpoint, id)),
  f AS (SELECT coalesce(n1.endpoint, o2.endpoint) AS endpoint, coalesce(n1.id, o2.id) AS last_hop, coalesce(n1.lat, o2.lat) AS flat, coalesce(n1.lon, o2.lon) AS flon
    FROM n1 FULL JOIN (SELECT * FROM o2 WHERE lat IS NOT NULL) o2 ON n1.endpoint = o2.endpoint AND n1.id = o2.id),
  ends AS (SELECT p.*, flat, flon, t.lat AS tlat, t.lon AS tlon FROM pairs p JOIN f USING (endpoint, last_hop) JOIN o2 t ON t.endpoint = p.endpoint AND t.id = p.observer_id WHERE t.lat IS NOT NULL)"""
_KM = "floor(2 * 6371.0088e0 * asin(least(1.0e0, sqrt(sin(radians(tlat - flat) / 2) * sin(radians(tlat - flat) / 2) + cos(radians(flat)) * cos(radians(tlat)) * sin(radians(tlon - flon) / 2) * sin(radians(tlon - flon) / 2)))) * 100 + 0.5e0) / 100"


@query("j14_located_pairs", f"{_ENDS} SELECT endpoint, last_hop, observer_id, n, median_snr, median_rssi, {_KM} AS distance_km FROM ends")
def j14(spark, d):
    km = rf.haversine_km(F.col("f.lat"), F.col("f.lon"), F.col("t.lat"), F.col("t.lon"))  # F15
    return pair_ends(spark, d).select("endpoint", "last_hop", "observer_id", "n", "median_snr", "median_rssi", km.alias("distance_km"))


@query("a29_map_totals", f"""{_ENDS} SELECT p.endpoint, p.pairs, coalesce(e.located, 0) AS located_pairs, coalesce(e.inside, 0) AS bbox_pairs FROM (SELECT endpoint, count(*) AS pairs FROM pairs GROUP BY endpoint) p
  LEFT JOIN (SELECT endpoint, count(*) AS located, count(*) FILTER (WHERE flat BETWEEN 59 AND 61 AND flon BETWEEN 9 AND 12 AND tlat BETWEEN 59 AND 61 AND tlon BETWEEN 9 AND 12) AS inside FROM ends GROUP BY endpoint) e USING (endpoint)""")
def a29(spark, d):
    inside = lambda p: F.col(p + ".lat").between(59, 61) & F.col(p + ".lon").between(9, 12)
    e = pair_ends(spark, d).groupBy("endpoint").agg(F.count("*").alias("l"), F.count_if(inside("f") & inside("t")).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return a16(spark, d).join(e, "endpoint", "left").select("endpoint", "pairs", zero("l").alias("located_pairs"), zero("b").alias("bbox_pairs"))


@query("r5_week_window", _CTE + """, c AS (SELECT endpoint, (max(seen_unix) - 604800) // 60 * 60 AS cutoff FROM hops GROUP BY endpoint)
  SELECT endpoint, last_hop, observer_id, zero_hop, count(*) AS n FROM hops JOIN c USING (endpoint) WHERE seen_unix >= cutoff GROUP BY ALL""")
def r5(spark, d):
    """A look-back of a week before each endpoint's last reception, its start floored to the minute."""
    h = hops(spark, d)
    c = h.groupBy("endpoint").agg(F.expr("(max(seen_unix) - 604800) div 60 * 60").alias("cutoff"))
    return h.join(c, "endpoint").filter("seen_unix >= cutoff").groupBy("endpoint", "last_hop", "observer_id", "zero_hop").agg(F.count("*").alias("n"))


@query("a28_rolling_requests", "SELECT endpoint, count(*) AS day_requests FROM (SELECT DISTINCT * FROM request_log) r JOIN (SELECT endpoint, max(sent_ms) AS now FROM request_log WHERE sent_ms < 100000000000000 GROUP BY endpoint) m USING (endpoint) WHERE sent_ms > now - 86400000 AND sent_ms <= now GROUP BY endpoint")
def a28(spark, d):
    r = load(spark, d, "request_log").distinct()
    now = r.filter("sent_ms < 100000000000000").groupBy("endpoint").agg(F.max("sent_ms").alias("now"))
    return r.join(now, "endpoint").filter("sent_ms > now - 86400000 and sent_ms <= now").groupBy("endpoint").agg(F.count("*").alias("day_requests"))


@query("pp15_neighbor_batch", _CTE + f""", used AS (SELECT endpoint, max(sent_ms) AS now FROM request_log WHERE sent_ms < 100000000000000 GROUP BY endpoint),
  asked AS (SELECT endpoint, neighbor, max(sent_ms) AS last FROM request_log WHERE sent_ms < 100000000000000 AND neighbor IS NOT NULL GROUP BY ALL)
  SELECT endpoint, pubkey, CAST(refreshed AS BIGINT) AS refreshed, CAST(place AS INT) AS place FROM (
    SELECT n.endpoint, n.pubkey, coalesce(a.last, 0) AS refreshed, row_number() OVER (PARTITION BY n.endpoint ORDER BY coalesce(a.last, 0), n.pubkey) AS place
    FROM (SELECT DISTINCT endpoint, pubkey FROM nodes WHERE {_OK.format("lat", "lon")}) n JOIN used u USING (endpoint)
    LEFT JOIN asked a ON a.endpoint = n.endpoint AND a.neighbor = n.pubkey WHERE coalesce(a.last, 0) <= u.now - 86400000) WHERE place <= 300""")
def p15(spark, d):
    """The batch of neighbours to ask next: oldest refreshed first, at most 300 for an endpoint (a fixed daily limit)."""
    log = load(spark, d, "request_log").filter("sent_ms < 100000000000000")
    now = log.groupBy("endpoint").agg(F.max("sent_ms").alias("now"))
    asked = log.filter("neighbor is not null").groupBy("endpoint", F.col("neighbor").alias("pubkey")).agg(F.max("sent_ms").alias("last"))
    n = nodes(spark, d).filter(valid_location("lat", "lon")).select("endpoint", "pubkey").distinct()
    n = n.join(now, "endpoint").join(asked, ["endpoint", "pubkey"], "left").withColumn("refreshed", F.coalesce("last", F.lit(0)))
    n = n.filter(F.col("refreshed") <= F.col("now") - 86400000)
    place = F.row_number().over(Window.partitionBy("endpoint").orderBy("refreshed", "pubkey"))  # a top 300: rows beyond fall out before the sort ends
    return n.withColumn("place", place).filter("place <= 300").select("endpoint", "pubkey", "refreshed", "place")


@query("pp16_measured_hops", _CTE + """, g AS (SELECT *, CASE WHEN json_array_length(path_prefixes) = 0 THEN sender_pubkey ELSE resolved_path ->> '$[#-1]' END AS last_hop, CASE WHEN json_array_length(path_prefixes) = 0 THEN 1 ELSE 0 END AS zero_hop FROM obs
    WHERE path_prefixes IS NULL OR json_valid(path_prefixes)), h AS (SELECT *, lower(last_hop) AS lh FROM g WHERE direction = 'rx' AND last_hop IS NOT NULL AND observer_id IS NOT NULL)
  SELECT endpoint, packet_id, observation_key, lh AS last_hop, observer_id, zero_hop, CASE WHEN rssi < 0 THEN rssi END AS rssi FROM h WHERE lh <> observer_id""")
def p16(spark, d):
    """The store's view of receptions: last hop, zero hop, and rssi where below 0."""
    o = observations(spark, d, "observer_id", "sender_pubkey", "path_prefixes", "resolved_path", "direction", "rssi")
    prefixes = F.json_array_length("path_prefixes")
    path = F.from_json("resolved_path", "array<string>")
    last = F.when(prefixes == 0, F.col("sender_pubkey")).otherwise(F.try_element_at(path, F.lit(-1)))
    o = o.filter(F.col("path_prefixes").isNull() | prefixes.isNotNull())
    o = o.withColumns({"last_hop": F.lower(last), "zero_hop": F.when(prefixes == 0, 1).otherwise(0)})
    o = o.filter("direction = 'rx' and last_hop is not null and observer_id is not null and last_hop <> observer_id")
    return o.select("endpoint", "packet_id", "observation_key", "last_hop", "observer_id", "zero_hop", F.when((F.col("rssi") < 0) & ~F.isnan("rssi"), F.col("rssi")).alias("rssi"))


@query("j15_superseded_representatives", """SELECT DISTINCT endpoint, packet_id, observation_key FROM observations r WHERE observation_id IS NULL
  AND EXISTS (SELECT 1 FROM observations o WHERE o.endpoint = r.endpoint AND o.packet_id = r.packet_id AND o.observation_id IS NOT NULL)""")
def j15(spark, d):
    """Receptions that stand for a packet, where its expanded receptions have arrived as well."""
    o = load(spark, d, "observations")
    expanded = o.filter("observation_id is not null").select("endpoint", "packet_id")
    return o.filter("observation_id is null").join(expanded, ["endpoint", "packet_id"], "left_semi").select("endpoint", "packet_id", "observation_key").distinct()


@query("j16_snapshot_runs", "SELECT r.endpoint, r.mode, count(*) AS rows_, count(DISTINCT n.run_id) AS runs FROM nodes_snapshot n JOIN capture_runs r ON r.id = n.run_id GROUP BY ALL")
def j16(spark, d):
    n = load(spark, d, "nodes_snapshot").groupBy("run_id").agg(F.count("*").alias("n"))
    r = load(spark, d, "capture_runs").select(F.col("id").alias("run_id"), "endpoint", "mode")
    return n.join(r, "run_id").groupBy("endpoint", "mode").agg(F.sum("n").alias("rows_"), F.count("*").alias("runs"))


@query("f32_public_keys", f"SELECT run_id, observer_id AS written, {_ID.format('observer_id')} AS key FROM observers_snapshot GROUP BY ALL")
def f32(spark, d):
    return load(spark, d, "observers_snapshot").select("run_id", F.col("observer_id").alias("written"), norm_id("observer_id").alias("key")).distinct()


@query("f33_advert_fields", """SELECT id, decoded_json ->> '$.name' AS name, TRY_CAST(decoded_json ->> '$.lat' AS DOUBLE) AS lat, TRY_CAST(coalesce(decoded_json ->> '$.flags.raw', decoded_json ->> '$.flags') AS DOUBLE) AS flags
  FROM (SELECT DISTINCT id, decoded_json FROM packets WHERE payload_type = 4 AND json_valid(decoded_json) AND left(ltrim(decoded_json), 1) = '{')""")
def f33(spark, d):
    """advert fields of payload type 4, numbers also where written as text, flags as a byte or an object's raw byte."""
    p = load(spark, d, "packets").filter("payload_type = 4").select("id", "decoded_json").distinct()
    p = p.filter(F.try_parse_json("decoded_json").isNotNull() & F.ltrim("decoded_json").startswith("{"))
    at = lambda path: F.get_json_object("decoded_json", path)
    return p.select("id", at("$.name").alias("name"), at("$.lat").try_cast("double").alias("lat"), F.coalesce(at("$.flags.raw"), at("$.flags")).try_cast("double").alias("flags"))


@query("w11_descending_pages", """SELECT endpoint, count(*) AS packets, count(*) FILTER (WHERE coalesce(len(list_filter(range(1, len(ids)), lambda i: ids[i] >= ids[i + 1])), 0) = 0) AS in_order
  FROM (SELECT DISTINCT endpoint, id, list_transform(observations, lambda o: o.id) AS ids FROM packets) GROUP BY endpoint""")
def w11(spark, d):
    """Whether a packet's receptions come in strictly rising ids, as the list stands; without ids there is nothing amiss."""
    p = load(spark, d, "packets").select("endpoint", "id", F.transform("observations", lambda o: o["id"]).alias("ids")).distinct()
    later = F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 1, F.lit(0)))
    wrong = F.exists(F.zip_with(F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0))), later, lambda a, b: F.coalesce(a >= b, F.lit(False))), lambda x: x)
    return p.groupBy("endpoint").agg(F.count("*").alias("packets"), F.count_if(~F.coalesce(wrong, F.lit(False))).alias("in_order"))


@query("f28_freshness", """SELECT run_id, k, CASE WHEN h < 48 THEN h || ' h' ELSE h // 24 || ' d' END AS freshness FROM (
  SELECT DISTINCT run_id, lower(pubkey) AS k, CAST(floor((epoch_ms(CAST(captured_at AS TIMESTAMP)) - epoch_ms(CAST(raw_json ->> '$.last_heard' AS TIMESTAMP))) / 3600000e0) AS BIGINT) AS h
  FROM nodes_snapshot WHERE (raw_json ->> '$.last_heard') IS NOT NULL)""")
def f28(spark, d):
    """how long ago a node was heard when it was captured, in whole hours, beyond two days in whole days."""
    n = load(spark, d, "nodes_snapshot").withColumn("heard", F.try_to_timestamp(F.get_json_object("raw_json", "$.last_heard"))).filter("heard is not null")
    h = F.floor((F.unix_millis(F.try_to_timestamp("captured_at")) - F.unix_millis("heard")) / 3600000.0).cast("bigint")
    n = n.select("run_id", F.lower("pubkey").alias("k"), h.alias("h")).distinct()
    return n.select("run_id", "k", F.when(F.col("h") < 48, F.concat(F.col("h").cast("string"), F.lit(" h"))).otherwise(F.concat(F.expr("h div 24").cast("string"), F.lit(" d"))).alias("freshness"))


@query("s21_node_inventory", """SELECT DISTINCT run_id, lower(pubkey) AS pubkey, raw_json ->> '$.name' AS name FROM nodes_snapshot WHERE (raw_json ->> '$.role') = 'repeater' AND (raw_json ->> '$.name') <> '' AND lat BETWEEN 54 AND 72 AND lon BETWEEN 4 AND 32""")
def s21(spark, d):
    """Repeaters with a name within the planner's area, one row a run and key."""
    n = load(spark, d, "nodes_snapshot").filter("lat between 54 and 72 and lon between 4 and 32")
    n = n.select("run_id", F.lower("pubkey").alias("pubkey"), F.get_json_object("raw_json", "$.name").alias("name"), F.get_json_object("raw_json", "$.role").alias("role"))
    return n.filter("role = 'repeater' and name <> ''").select("run_id", "pubkey", "name").distinct()


@query("u4_duplicate_ids", "SELECT run_id, lower(pubkey) AS pubkey, count(*) AS n FROM nodes_snapshot GROUP BY ALL HAVING count(*) > 1")
def u4(spark, d):
    return load(spark, d, "nodes_snapshot").groupBy("run_id", F.lower("pubkey").alias("pubkey")).agg(F.count("*").alias("n")).filter("n > 1")


@query("t3_oldest_requests", "SELECT endpoint, neighbor, max(sent_ms) AS last_ms FROM request_log WHERE neighbor IS NOT NULL AND sent_ms IS NOT NULL GROUP BY ALL ORDER BY last_ms, endpoint, neighbor LIMIT 100")
def t3(spark, d):
    r = load(spark, d, "request_log").filter("neighbor is not null and sent_ms is not null")
    return r.groupBy("endpoint", "neighbor").agg(F.max("sent_ms").alias("last_ms")).orderBy("last_ms", "endpoint", "neighbor").limit(100)
