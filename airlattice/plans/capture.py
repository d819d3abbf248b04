"""Queries over the capture tables, and the SQL that gives the same rows where SQL can say it on whole tables."""

from __future__ import annotations

from airlattice.operators import flatten, orphans, proximity, snapdiff, spikes, timestamps
from airlattice.plans import capture_sql

QUERIES = {
    "p1_found": proximity.found,
    "p2_found": flatten.found,
    "p3_found": spikes.found,
    "p3_impossible": spikes.impossible_found,
    "p3_stuck": spikes.stuck_found,
    "p4_found": snapdiff.found,
    "p5_found": timestamps.found,
    "p6_found": orphans.found,
    "p6_report": orphans.report,
}

_RUNS = """
  runs AS (
    SELECT r.id AS run_id, r.endpoint, min(n.captured_at) AS seen
    FROM capture_runs r JOIN nodes_snapshot n ON n.run_id = r.id
    WHERE r.status = 'complete' AND r.mode IN ('watch-topology', 'snapshot', 'run') GROUP BY ALL)"""
_ID = "CASE WHEN regexp_full_match({0}, '[0-9A-Fa-f]{{64}}') THEN lower({0}) WHEN {0} <> '' THEN {0} END"
_READINGS = f"""WITH
      o AS (SELECT DISTINCT endpoint, {_ID.format("observer_id")} AS source, packet_id, observation_key, rssi, snr FROM observations
            WHERE endpoint IS NOT NULL AND observer_id <> '' AND packet_id IS NOT NULL),
      r AS (SELECT endpoint, source, packet_id, observation_key, 'rssi' AS quantity, rssi AS v FROM o WHERE rssi IS NOT NULL
            UNION ALL SELECT endpoint, source, packet_id, observation_key, 'snr', snr FROM o WHERE snr IS NOT NULL)"""
_NEAR = (
    "2 * 6371.0088 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2)"
    " + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 0.2"
)

ORACLE = {
    "p1_found": f"""WITH {_RUNS},
      last AS (SELECT endpoint, arg_max(run_id, (seen, run_id)) AS run_id FROM runs GROUP BY endpoint),
      n AS (SELECT DISTINCT endpoint, lower(pubkey) AS k, lat, lon FROM nodes_snapshot JOIN last USING (run_id)
            WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
      c AS (SELECT DISTINCT endpoint, job_id || '/' || "index" AS k, latitude AS lat, longitude AS lon FROM coverage
            WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
      SELECT 'node' AS near_kind, a.k AS key_a, b.k AS key_b FROM n a JOIN n b
        ON a.endpoint = b.endpoint AND a.k < b.k AND b.lat BETWEEN a.lat - 0.002 AND a.lat + 0.002 AND {_NEAR}
      UNION SELECT 'cell', a.k, b.k FROM n a JOIN c b
        ON a.endpoint = b.endpoint AND b.lat BETWEEN a.lat - 0.002 AND a.lat + 0.002 AND {_NEAR}""",
    "p4_found": f"""WITH {_RUNS},
      steps AS (SELECT run_id, lag(run_id) OVER (PARTITION BY endpoint ORDER BY seen, run_id) AS earlier FROM runs),
      n AS (SELECT DISTINCT run_id, lower(pubkey) AS pubkey, lat, lon FROM nodes_snapshot),
      a AS (SELECT s.run_id, n.pubkey, n.lat, n.lon FROM steps s JOIN n ON n.run_id = s.run_id WHERE s.earlier IS NOT NULL),
      b AS (SELECT s.run_id, n.pubkey, n.lat, n.lon FROM steps s JOIN n ON n.run_id = s.earlier)
      SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.pubkey, b.pubkey) AS pubkey,
        CASE WHEN b.pubkey IS NULL THEN 'added' WHEN a.pubkey IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
      FROM a FULL JOIN b ON a.run_id = b.run_id AND a.pubkey = b.pubkey
      WHERE a.pubkey IS NULL OR b.pubkey IS NULL OR (a.lat IS NULL) <> (b.lat IS NULL) OR (a.lon IS NULL) <> (b.lon IS NULL)
        OR abs(a.lat - b.lat) > 0.00002 OR abs(a.lon - b.lon) > 0.00002""",
    "p2_found": capture_sql.P2,
    "p3_impossible": f"""{_READINGS} SELECT packet_id, observation_key, quantity, 'impossible' AS fault FROM r
      WHERE isnan(v) OR CASE quantity WHEN 'rssi' THEN v < -150 OR v >= 0 ELSE abs(v) > 40 END""",
    "p3_stuck": f"""{_READINGS},
      m AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS moved FROM r WINDOW w AS (PARTITION BY endpoint, source, quantity ORDER BY packet_id, observation_key)),
      i AS (SELECT *, sum(moved) OVER (PARTITION BY endpoint, source, quantity ORDER BY packet_id, observation_key) AS island FROM m),
      n AS (SELECT *, count(*) OVER (PARTITION BY endpoint, source, quantity, island) AS same FROM i)
      SELECT packet_id, observation_key, quantity, 'stuck' AS fault FROM n WHERE same >= 10""",
    "p5_found": capture_sql.P5,
    "p6_found": capture_sql.P6,
    "p6_report": capture_sql.P6_REPORT,
}
