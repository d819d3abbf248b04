"""SQL of the timestamp, orphan and flattening problems, written apart from the operators' code."""

from __future__ import annotations

_ID = "CASE WHEN regexp_full_match({0}, '[0-9A-Fa-f]{{64}}') THEN lower({0}) WHEN {0} <> '' THEN {0} END"
_CANONICAL = r"regexp_full_match({0}, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{{3}}Z')"
# Hours east of UTC of the zone abbreviations in the tables.
_HOURS = "CASE suffix WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'Z' THEN 0 WHEN 'BST' THEN 1 WHEN 'CET' THEN 1 WHEN 'CEST' THEN 2 WHEN 'AEST' THEN 10 WHEN 'AEDT' THEN 11 WHEN 'NZST' THEN 12 WHEN 'NZDT' THEN 13 WHEN 'EST' THEN -5 WHEN 'EDT' THEN -4 END"


def _parsed(source: str, name: str) -> str:
    """CTEs from rows (k, v, zone, ord, hint) to `name` (k, v, ms): the instant that v writes."""
    n = name
    return rf"""
  {n}0 AS (SELECT *, regexp_full_match(v, '\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)? ?(Z|[+-]\d\d:?\d\d|[A-Z]{{1,5}}|\[[^\]]+\])?') AS iso,
      regexp_full_match(v, '[A-Z][a-z]{{2}}, \d\d [A-Z][a-z]{{2}} \d{{4}} \d\d:\d\d:\d\d [+-]\d{{4}}') AS rfc, regexp_full_match(v, '\d{{9,19}}(\.\d+)?') AS num FROM ({source})),
  {n}1 AS (SELECT *, CASE WHEN iso THEN try_strptime(replace(left(v, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S') WHEN rfc THEN try_strptime(substr(v, 6, 20), '%d %b %Y %H:%M:%S') WHEN num THEN NULL
      WHEN v LIKE '%Z' THEN try_strptime(v, '%Y%m%dT%H%M%SZ') WHEN v LIKE '%/%' AND ord = 'dmy' THEN try_strptime(v, '%d/%m/%Y %H:%M:%S') WHEN v LIKE '%/%' THEN CASE WHEN ord = 'mdy' THEN try_strptime(v, '%m/%d/%Y %H:%M:%S') END
      ELSE try_strptime(v, '%b %d, %Y %I:%M %p') END AS wall,
      CASE WHEN iso THEN regexp_extract(v, ' ?(Z|[+-]\d\d:?\d\d|[A-Z]{{1,5}}|\[[^\]]+\])$', 1) WHEN rfc THEN right(v, 5) WHEN v LIKE '%Z' THEN 'Z' ELSE '' END AS suffix,
      CASE WHEN iso OR num THEN CAST(rpad(left(coalesce(nullif(regexp_extract(v, '\.(\d+)', 1), ''), '0'), 3), 3, '0') AS BIGINT) ELSE 0 END AS frac FROM {n}0),
  {n}2 AS (SELECT *, CAST(epoch(wall) AS BIGINT) AS w, CASE WHEN left(suffix, 1) IN ('+', '-') THEN (CASE left(suffix, 1) WHEN '-' THEN -1 ELSE 1 END) * (CAST(substr(suffix, 2, 2) AS INT) * 60 + CAST(right(suffix, 2) AS INT))
      WHEN left(suffix, 1) <> '[' AND suffix <> '' THEN 60 * {_HOURS} END AS minutes, CASE WHEN left(suffix, 1) = '[' THEN trim(suffix, '[]') WHEN suffix = '' THEN zone END AS z,
      CASE WHEN num THEN TRY_CAST(regexp_extract(v, '^\d+') AS BIGINT) END AS e FROM {n}1 WHERE v IS NOT NULL),
  {n}3 AS (SELECT *, CAST(epoch(timezone(z, to_timestamp(w - 86400))) AS BIGINT) - (w - 86400) AS o1, CAST(epoch(timezone(z, to_timestamp(w + 86400))) AS BIGINT) - (w + 86400) AS o2 FROM {n}2),
  {n}4 AS (SELECT *, CAST(epoch(timezone(z, to_timestamp(w - o1))) AS BIGINT) - (w - o1) = o1 AS v1, CAST(epoch(timezone(z, to_timestamp(w - o2))) AS BIGINT) - (w - o2) = o2 AS v2 FROM {n}3),
  {n} AS (SELECT k, v, CASE WHEN num THEN CASE WHEN e <= 0 THEN NULL WHEN e < 100000000000 THEN e * 1000 + frac WHEN e < 100000000000000 THEN e WHEN e < 100000000000000000 THEN e // 1000 ELSE e // 1000000 END
      WHEN suffix <> '' AND left(suffix, 1) <> '[' THEN w * 1000 + frac - minutes * 60000
      WHEN o1 = o2 OR (v1 AND NOT v2) THEN (w - o1) * 1000 + frac WHEN v2 AND NOT v1 THEN (w - o2) * 1000 + frac
      WHEN abs((w - o2) * 1000 + frac - hint) < abs((w - o1) * 1000 + frac - hint) THEN (w - o2) * 1000 + frac ELSE (w - o1) * 1000 + frac END AS ms FROM {n}4)"""


_TIMES = f"""
  ob AS (SELECT DISTINCT endpoint, packet_id, observation_key, packet_id || '/' || observation_key AS k, {_ID.format("observer_id")} AS observer_id, timestamp, first_seen FROM observations),
  ck AS (SELECT endpoint, {_ID.format("observer_id")} AS observer_id, min(zone_name) AS zone, min(date_order) AS ord FROM observer_clocks GROUP BY ALL),{_parsed("SELECT DISTINCT k, first_seen AS v, 'UTC' AS zone, NULL AS ord, CAST(NULL AS BIGINT) AS hint FROM ob", "fs")},{_parsed('''SELECT DISTINCT ob.k, timestamp AS v, ck.zone, ck.ord, fs.ms AS hint FROM ob LEFT JOIN ck ON ck.endpoint = ob.endpoint AND ck.observer_id = ob.observer_id LEFT JOIN fs ON fs.k = ob.k AND fs.v = ob.first_seen''', "ts")}"""

P5 = f"""WITH {_TIMES.strip()},{_parsed("SELECT DISTINCT CAST(id AS VARCHAR) AS k, started_at AS v, 'UTC' AS zone, NULL AS ord, CAST(NULL AS BIGINT) AS hint FROM capture_runs", "st")},
  al AS (SELECT 'observations' AS rec_table, k, 'first_seen' AS fld, v, ms FROM fs UNION ALL SELECT 'observations', k, 'timestamp', v, ms FROM ts UNION ALL SELECT 'capture_runs', k, 'started_at', v, ms FROM st)
  SELECT DISTINCT rec_table, k AS rec_key, fld, ms AS utc_ms FROM al WHERE ms IS NOT NULL AND NOT {_CANONICAL.format("v")}
  UNION SELECT 'request_log', CAST(req_id AS VARCHAR), 'sent_ms', CASE WHEN sent_ms < 100000000000 THEN sent_ms * 1000 WHEN sent_ms < 100000000000000000 THEN sent_ms // 1000 ELSE sent_ms // 1000000 END
  FROM request_log WHERE sent_ms > 0 AND NOT sent_ms BETWEEN 100000000000 AND 99999999999999"""

P6 = f"""WITH {_TIMES.strip()},
  seen AS (SELECT run_id, min(captured_at) AS at_ FROM (SELECT run_id, captured_at FROM nodes_snapshot UNION ALL SELECT run_id, captured_at FROM observers_snapshot) GROUP BY run_id),
  runs AS (SELECT r.id AS run_id, r.endpoint, epoch_ms(CAST(at_ AS TIMESTAMP)) AS at_ms FROM capture_runs r JOIN seen ON run_id = id WHERE status = 'complete' AND mode IN ('watch-topology', 'snapshot', 'run')),
  refs AS (SELECT DISTINCT 'observations' AS ref_table, ob.endpoint, ob.k, ob.observer_id AS key_, ts.ms FROM ob JOIN ts ON ts.k = ob.k AND ts.v = ob.timestamp
    UNION SELECT 'measured_hops', m.endpoint, ts.k, {_ID.format("m.last_hop")}, ts.ms FROM measured_hops m JOIN ts ON ts.k = m.packet_id || '/' || m.observation_key),
  r AS (SELECT refs.*, runs.at_ms AS slot FROM refs ASOF JOIN runs ON refs.endpoint = runs.endpoint AND refs.ms >= runs.at_ms WHERE key_ IS NOT NULL AND ms IS NOT NULL),
  here AS (SELECT DISTINCT 'measured_hops' AS ref_table, endpoint, {_ID.format("pubkey")} AS key_, at_ms FROM nodes_snapshot JOIN runs USING (run_id)
    UNION SELECT DISTINCT 'observations', endpoint, {_ID.format("observer_id")}, at_ms FROM observers_snapshot JOIN runs USING (run_id)),
  span AS (SELECT ref_table, endpoint, key_, min(at_ms) AS first_ FROM here GROUP BY ALL)
  SELECT r.ref_table, r.k AS rec_key, strftime(make_timestamp(r.ms * 1000), '%Y-%m-%d') AS utc_day, CASE WHEN s.first_ IS NULL THEN 'missing' WHEN s.first_ < r.slot THEN 'deleted' ELSE 'late' END AS orphan_kind
  FROM r LEFT JOIN span s ON s.ref_table = r.ref_table AND s.endpoint = r.endpoint AND s.key_ = r.key_
  WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.ref_table = r.ref_table AND h.endpoint = r.endpoint AND h.key_ = r.key_ AND h.at_ms = r.slot)"""

P6_REPORT = f"SELECT ref_table, utc_day, orphan_kind, count(*) AS n FROM ({P6}) GROUP BY ALL"


def _js(c: str) -> str:
    """A text's JSON, taken out of a JSON string where it stands in one; null if it can't be read."""
    return f"CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'VARCHAR' THEN CASE WHEN json_valid({c} ->> '$') THEN {c} ->> '$' END ELSE {c} END END"


P2 = f"""WITH
  p AS (SELECT DISTINCT id, observer_id, path_json, parsed_path, payload_type, {_js("decoded_json")} AS j, observations FROM packets),
  r AS (SELECT id, unnest(observations) AS o, generate_subscripts(observations, 1) - 1 AS pos FROM p WHERE len(observations) > 0),
  rec AS (SELECT id, pos, o.observer_id AS observer_id, o.parsed_path AS parsed_path, o.path_json AS path_json FROM r UNION ALL SELECT id, 0, observer_id, parsed_path, path_json FROM p WHERE coalesce(len(observations), 0) = 0),
  pj AS (SELECT id, pos, parsed_path, {_js("path_json")} AS pjs FROM rec),
  l AS (SELECT id, pos, CASE WHEN parsed_path IS NOT NULL THEN parsed_path WHEN json_type(pjs) = 'ARRAY' THEN CAST(CAST(pjs AS JSON) AS VARCHAR[]) END AS path FROM pj),
  h AS (SELECT id, pos, unnest(path) AS hop, generate_subscripts(path, 1) - 1 AS at_ FROM l),
  lg AS (SELECT id, coalesce(CAST(j AS JSON) -> '$.legs', CAST(j AS JSON) -> '$.trace.legs') AS g FROM p WHERE json_type(j) = 'OBJECT'),
  le AS (SELECT id, CASE json_type(g) WHEN 'ARRAY' THEN CAST(g AS JSON[]) WHEN 'OBJECT' THEN [g] END AS legs FROM lg),
  lu AS (SELECT id, unnest(legs) AS leg, generate_subscripts(legs, 1) - 1 AS at_ FROM le),
  c AS (SELECT job_id, "index" AS cell, unnest(sources) AS s, generate_subscripts(sources, 1) - 1 AS at_ FROM coverage)
  SELECT 'reception' AS link_kind, CAST(id AS VARCHAR) AS parent_key, CAST(pos AS BIGINT) AS child_pos, {_ID.format("observer_id")} AS child_key FROM rec WHERE observer_id <> ''
  UNION SELECT 'hop', id || '/' || pos, CAST(at_ AS BIGINT), lower(hop) FROM h WHERE regexp_full_match(hop, '([0-9A-Fa-f]{{2}}){{1,3}}')
  UNION SELECT 'advert', CAST(id AS VARCHAR), 0, lower(j ->> '$.pubKey') FROM p WHERE payload_type = 4 AND json_type(j) = 'OBJECT' AND regexp_full_match(j ->> '$.pubKey', '[0-9A-Fa-f]{{64}}')
  UNION SELECT 'leg', CAST(id AS VARCHAR), CAST(at_ AS BIGINT), leg ->> '$.hop' FROM lu WHERE (leg ->> '$.hop') <> ''
  UNION SELECT 'cell_source', job_id || '/' || cell, CAST(at_ AS BIGINT), s.source_id FROM c WHERE s.source_id <> ''"""
