"""The operators over capture tables: defined results on small tables, and brute force on random ones."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from airlattice.operators import flatten, orphans, proximity, snapdiff, spikes, timestamps
from airlattice.plans import capture

RUN = [("id", pa.int64()), ("endpoint", pa.string()), ("mode", pa.string()), ("started_at", pa.string()), ("status", pa.string())]
NODE = [("run_id", pa.int64()), ("captured_at", pa.string()), ("pubkey", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("raw_json", pa.string())]
OBSERVER = [("run_id", pa.int64()), ("captured_at", pa.string()), ("observer_id", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("raw_json", pa.string())]
OBSERVATION = [("endpoint", pa.string()), ("packet_id", pa.int64()), ("observation_key", pa.string()), ("observer_id", pa.string()), ("timestamp", pa.string()), ("first_seen", pa.string()), ("rssi", pa.float64()), ("snr", pa.float64())]
HOP = [("endpoint", pa.string()), ("packet_id", pa.int64()), ("observation_key", pa.string()), ("last_hop", pa.string()), ("observer_id", pa.string())]
CLOCK = [("endpoint", pa.string()), ("observer_id", pa.string()), ("zone_name", pa.string()), ("date_order", pa.string())]
LOG = [("req_id", pa.int64()), ("endpoint", pa.string()), ("sent_ms", pa.int64()), ("neighbor", pa.string())]
COVERAGE = [("job_id", pa.string()), ("endpoint", pa.string()), ("index", pa.int64()), ("latitude", pa.float64()), ("longitude", pa.float64()), ("sources", pa.list_(pa.struct([("source_id", pa.string())])))]
INNER = pa.struct([("id", pa.int64()), ("observer_id", pa.string()), ("path_json", pa.string()), ("parsed_path", pa.list_(pa.string()))])
PACKET = [("endpoint", pa.string()), ("id", pa.int64()), ("observer_id", pa.string()), ("path_json", pa.string()), ("parsed_path", pa.list_(pa.string())), ("payload_type", pa.int32()), ("decoded_json", pa.string()), ("observations", pa.list_(INNER))]
TABLES = {"capture_runs": RUN, "nodes_snapshot": NODE, "observers_snapshot": OBSERVER, "observations": OBSERVATION, "measured_hops": HOP, "observer_clocks": CLOCK, "request_log": LOG, "coverage": COVERAGE, "packets": PACKET}
#: Columns that a table may carry besides, named like those that the operators make for themselves.
CLASHING = ["grp", "id", "key", "slot", "blk", "pair", "bucket", "salt", "leaf", "source", "n", "k", "d", "e", "table", "starts", "at_ms", "utc_ms", "__v", "zone", "rec_key", "endpoint", "run_id"]


def write(path, clash=False, **tables):
    for name, schema in TABLES.items():
        rows = tables.get(name, [])
        columns = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(schema)}
        if clash:
            columns |= {c: pa.array(["x"] * len(rows)) for c in CLASHING if c not in columns}
        pq.write_table(pa.table(columns), path / f"{name}.parquet")
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


A, B, C = "aa" * 32, "bb" * 32, "cc" * 32
T0, T1, T2 = "2026-10-01T00:00:00.000Z", "2026-10-02T00:00:00.000Z", "2026-10-03T00:00:00.000Z"
RUNS = [(i, "ep", "snapshot", None, "complete") for i in (1, 2, 3)]


@pytest.mark.parametrize("name", list(capture.QUERIES))
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_empty_and_null_tables(spark, tmp_path, name, kind):
    """Empty tables give no rows; rows of nulls, beside columns of clashing names, give none either."""
    nulls = {t: [(None,) * len(s)] * 2 for t, s in TABLES.items()} if kind == "nulls" else {}
    got = rows(capture.QUERIES[name](spark, write(tmp_path, kind == "nulls", **nulls)))
    assert got == []


def test_clashing_columns_change_nothing(spark, tmp_path):
    tables = {
        "capture_runs": RUNS, "nodes_snapshot": [(1, T0, A, 60.0, 10.0, "{}"), (2, T1, A, 60.1, 10.0, "{}"), (2, T1, B, 60.1, 10.0, "{}")],
        "observers_snapshot": [(1, T0, A, None, None, "{}")], "coverage": [("j", "ep", 0, 60.1, 10.0, [{"source_id": "s"}])],
        "observations": [("ep", 5, "k", B, "2026-10-02T05:00:00Z", T1, -300.0, 5.0), *[("ep", 10 + i, "k", B, "2026-10-02T05:00:00Z", T1, -90.0, 5.0) for i in range(10)]], "measured_hops": [("ep", 5, "k", C, B)],
        "packets": [("ep", 9, A, '["aa"]', None, 2, None, None)], "request_log": [(1, "ep", 1_790_036_229, None)], "observer_clocks": [("ep", B, "Europe/Oslo", "dmy")],
    }
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    plain, clash = write(tmp_path / "a", **tables), write(tmp_path / "b", True, **tables)
    for name, q in capture.QUERIES.items():
        got = rows(q(spark, plain))
        assert got and got == rows(q(spark, clash)), name


def test_near_pairs_against_brute_force(spark):
    """Dense spots, the antimeridian, poles, ties at one position, repeated rows."""
    r = random.Random(5)
    pts = []
    for i in range(400):
        lat, lon = r.choice([(60.0, 10.0), (-17.0, 180.0), (89.9995, 0.0), (-17.0, -180.0), (0.0, 0.001)])
        spread = 360 if lat > 89 else 0.006
        pts.append((r.choice("ab"), r.random() < 0.6, f"p{i:03}", min(lat + r.uniform(-0.004, 0.004), 90.0), lon + r.uniform(-spread, spread)))
    pts += [("a", True, f"t{i}", 60.0, 10.0) for i in range(30)] + pts[:20]
    pts += [("a", True, "n1", None, 10.0), ("a", True, "n2", 60.0, float("nan")), (None, True, "n3", 60.0, 10.0), ("a", False, "far", 60.0, 370.0)]
    df = spark.createDataFrame(pts, "grp string, probes boolean, id string, lat double, lon double")
    want, good = set(), {p for p in pts if p[0] and p[3] is not None and not math.isnan(p[4])}
    for g, p, i, la, lo in good:
        for h, q, j, lb, mo in good:
            if g == h and i != j and p and (not q or i < j) and proximity.great_circle_km(la, lo, lb, mo) <= 0.2:
                want.add((g, "node" if q else "cell", i, j))
    assert len(want) > 500
    for leaf_rows in (4000, 20, 3):
        got = rows(proximity.near_pairs(df, 0.2, leaf_rows))
        assert got == sorted(want)


def test_flatten(spark, tmp_path):
    upper = A.upper()
    packets = [
        ("ep", 1, upper, '["AA", "zz", null, "bbcc"]', None, 2, None, None), ("ep", 1, upper, '["AA", "zz", null, "bbcc"]', None, 2, None, None),
        ("ep", 2, "gw", None, None, 4, json.dumps(json.dumps({"pubKey": upper})), [{"id": 1, "observer_id": None, "path_json": None, "parsed_path": ["aa", "", None, "abcdef"]}, {"id": 2, "observer_id": "Gw", "path_json": '["aa"', "parsed_path": None}]),
        ("ep", 3, None, json.dumps(json.dumps(["cc"])), None, 9, '{"trace": {"legs": {"hop": "1F"}}}', []),
        ("ep", 4, "", "{}", [], 9, '{"legs": [{"snr": 1}, {"hop": "02"}, 5, null]}', None), ("ep", 5, "x", "", None, 4, '{"pubKey": "short"}', None),
    ]
    coverage = [("j", "ep", 7, 1.0, 1.0, [{"source_id": None}, {"source_id": ""}, {"source_id": "s"}, {"source_id": "s"}]), ("j", "ep", 8, 1.0, 1.0, None), ("j", "ep", 9, 1.0, 1.0, [])]
    got = rows(flatten.found(spark, write(tmp_path, packets=packets, coverage=coverage)))
    assert got == sorted([
        ("reception", "1", 0, A), ("hop", "1/0", 0, "aa"), ("hop", "1/0", 3, "bbcc"), ("reception", "2", 1, "Gw"), ("hop", "2/0", 0, "aa"), ("hop", "2/0", 3, "abcdef"),
        ("advert", "2", 0, A), ("hop", "3/0", 0, "cc"), ("leg", "3", 0, "1F"), ("leg", "4", 1, "02"), ("reception", "5", 0, "x"),
        ("cell_source", "j/7", 2, "s"), ("cell_source", "j/7", 3, "s"),
    ])


def series(seed, n, levels, spread, shift=None):
    g = np.random.default_rng(seed)
    base = np.array(levels)[g.integers(0, len(levels), n)].astype(float)
    if shift:
        base[int(n * shift[0]) :] += shift[1]
    return np.rint(np.clip(base + np.clip(g.normal(0, spread, n), -3.9 * spread, 3.9 * spread), -149, -1))


@pytest.mark.parametrize("levels,shift", [([-90], None), ([-75, -99], None), ([-80], (0.6, 12)), ([-110, -85], None), ([-95], (0.3, -9))])
def test_spikes(spark, levels, shift):
    spread, n = 2.5, 1500
    v = series(len(levels) * 7 + bool(shift), n, levels, spread, shift)
    centers = sorted({*levels, *([x + shift[1] for x in levels] if shift else [])})
    g = np.random.default_rng(1)
    at = g.choice(np.arange(50, n - 50), 12, replace=False)
    v[at] = np.where(np.arange(12) % 2, centers[0] - 25, centers[-1] + 25)
    v[700:715], v[20], v[30], v[40] = -77.0, 0.0, -151.0, np.nan
    free = [int(i) for i in at if not 700 <= i < 715]
    data = [("e", "s", i, "k", None if i == 10 else float(x), None) for i, x in enumerate(v)]
    df = spark.createDataFrame(data + data[:5] + [("e", None, 1, "k", -500.0, 1.0)], "endpoint string, source string, packet_id bigint, observation_key string, rssi double, snr double")
    for block in (20_000, 400):
        got = {(r.packet_id, r.fault) for r in spikes.faults(df, block).collect()}
        assert {p for p, f in got if f == "spike"} == set(free)
        assert {p for p, f in got if f == "stuck"} == set(range(700, 715))
        assert {p for p, f in got if f == "impossible"} == {20, 30, 40}


def autoregressive(phi, seed, n=4000, step=2.0):
    g = np.random.default_rng(seed)
    e, x = g.normal(0, step, n), np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + e[t]
    at = g.choice(np.arange(5, n - 5), 50, replace=False)
    x[at] += 10 * step * g.choice([-1, 1], 50)
    return np.clip(np.rint(x - 90), -149, -1), at


@pytest.mark.parametrize("phi", [0.0, 0.6, 0.95])
def test_spikes_leap_out_of_the_autoregression(spark, phi):
    """Spikes of ten innovation spreads, which at 0.95 lie within the series' own swing about its level."""
    v, at = autoregressive(phi, 1)
    df = spark.createDataFrame([("e", "s", i, "k", float(x), None) for i, x in enumerate(v)], "endpoint string, source string, packet_id bigint, observation_key string, rssi double, snr double")
    for block in (20_000, 1500):
        got = {r.packet_id for r in spikes.faults(df, block).filter("fault = 'spike'").collect()}
        assert got >= set(at.tolist()) and len(got) <= 51
    if phi > 0.9:  # the marginal alone sees next to none of them
        assert spikes.outliers(v, np.array([-90.0]), np.array([6.5]), 0.0).sum() < 10


def test_spikes_of_few_readings(spark):
    """Three readings tell a level that two of them share; two readings tell none."""
    rows_ = [("e", "many", i, "k", -90.0 + i % 5, None) for i in range(200)] + [("e", "three", i, "k", v, None) for i, v in enumerate([-90.0, -91.0, -20.0])]
    rows_ += [("e", "two", i, "k", v, None) for i, v in enumerate([-90.0, -20.0])]
    df = spark.createDataFrame([(e, s, p + 1000 * len(s), k, v, w) for e, s, p, k, v, w in rows_], "endpoint string, source string, packet_id bigint, observation_key string, rssi double, snr double")
    assert rows(spikes.faults(df)) == [(5002, "k", "rssi", "spike")]


def test_blocks_are_even_by_rank(spark):
    """A burst and a stray packet id leave no block larger than asked; repeated rows over task edges are one."""
    ids = [*range(3000), 10**15]
    df = spark.createDataFrame([("e", "s", i, "k", float(i % 7), None) for i in ids] * 3 + [("e", "t", 5, "k", 1.0, None)], "endpoint string, source string, packet_id bigint, observation_key string, rssi double, snr double")
    got = spikes.blocks(df.repartition(6), 100).groupBy("source", "blk").agg(F.count("*").alias("n"), F.min("packet_id").alias("lo"), F.max("packet_id").alias("hi")).orderBy("source", "lo").collect()
    assert sum(r.n for r in got) == 3002 and max(r.n for r in got) <= 100 and min(r.n for r in got if r.source == "s") >= 90
    assert [r.blk for r in got if r.source == "s"] == list(range(31)) and all(a.hi < b.lo for a, b in zip(got, got[1:]) if a.source == b.source)


def test_stuck_over_block_edges(spark):
    """Runs that begin and end in other blocks, or fill several, are one; null readings are skipped."""
    v = [float(-80 - i % 3) for i in range(100)]
    v[30:55] = [-90.0] * 25
    v[70:79] = [-91.0] * 9
    data = [("e", "s", i, "k", None if i in (35, 36) else x, 1.0) for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "endpoint string, source string, packet_id bigint, observation_key string, rssi double, snr double")
    for block in (1000, 7, 3):
        got = {r.packet_id for r in spikes.faults(df, block).filter("fault = 'stuck' and quantity = 'rssi'").collect()}
        assert got == set(range(30, 55)) - {35, 36}
        assert spikes.faults(df, block).filter("fault = 'stuck' and quantity = 'snr'").count() == 100


def test_changes_against_brute_force(spark):
    r = random.Random(3)
    state, recs = {}, []
    for run in range(1, 5):
        for k in range(3000):
            if r.random() < 0.03:
                state.pop(k, None)
            elif k not in state or r.random() < 0.05:
                state[k] = (r.uniform(50, 70), r.choice([None, r.uniform(5, 20)]))
            elif r.random() < 0.3:
                la, lo = state[k]
                state[k] = (la + r.choice([1e-6, -1e-6, 1.5e-5]), lo)
        recs += [(run, f"k{k}", la, lo) for k, (la, lo) in state.items()]
    by = {}
    for run, k, la, lo in recs:
        by.setdefault(run, {})[k] = (la, lo)
    far = lambda a, b: (a is None) != (b is None) or (a is not None and abs(a - b) > 0.00002)
    want = set()
    for run in (2, 3, 4):
        new, old = by[run], by[run - 1]
        want |= {(run, k, "added") for k in new.keys() - old.keys()} | {(run, k, "removed") for k in old.keys() - new.keys()}
        want |= {(run, k, "changed") for k in new.keys() & old.keys() if far(new[k][0], old[k][0]) or far(new[k][1], old[k][1])}
    df = spark.createDataFrame(recs, "run_id bigint, pubkey string, lat double, lon double")
    runs = spark.createDataFrame([(i, "e", i) for i in range(1, 5)], "run_id bigint, endpoint string, at_ms bigint")
    assert {tuple(x) for x in snapdiff.changes(df, runs).collect()} == want
    for third in (1, 6):  # tables far too small: enlarged ones and the comparison row by row take over
        old = snapdiff.differing_keys.__defaults__
        snapdiff.differing_keys.__defaults__ = (third,)
        try:
            assert {tuple(x) for x in snapdiff.changes(df, runs).collect()} == want
        finally:
            snapdiff.differing_keys.__defaults__ = old


def test_element_hash_is_the_engines(spark):
    g = np.random.default_rng(0)
    k, d = g.integers(-(2**63), 2**63 - 1, (2, 50))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(k, d)], "k bigint, d bigint").select(F.xxhash64("k", "d").alias("h"))
    assert [x.h for x in df.collect()] == snapdiff.element_hash(k, d).view(np.int64).tolist()


def test_snapshot_positions_and_case(spark, tmp_path):
    nodes = [(1, T0, A.upper(), 60.0, 10.0, ""), (1, T0, A.upper(), 60.0, 10.0, ""), (1, T0, B, None, None, ""), (2, T1, A, 60.00002, 10.0, ""), (2, T1, B, 60.0, None, ""), (3, T2, C, 1.0, 1.0, ""), (9, T1, C, 1.0, 1.0, "")]
    d = write(tmp_path, capture_runs=[*RUNS, (9, "ep", "snapshot", None, "failed")], nodes_snapshot=nodes)
    assert rows(snapdiff.found(spark, d)) == sorted([(2, B, "changed"), (3, A, "removed"), (3, B, "removed"), (3, C, "added")])


CASES = [
    # text, first_seen, zone, order, UTC
    ("2026-10-20T22:18:52Z", None, None, None, "2026-10-20T22:18:52.000"), ("2026-10-20T22:18:52.123456789+0530", None, None, None, "2026-10-20T16:48:52.123"),
    ("20261020T221852Z", None, None, None, "2026-10-20T22:18:52.000"), ("1790039655", None, None, None, "2026-09-22T01:14:15.000"), ("1790071813.046", None, None, None, "2026-09-22T10:10:13.046"),
    ("1790040536304", None, None, None, "2026-09-22T01:28:56.304"), ("Fri, 02 Oct 2026 00:31:54 +1000", None, None, None, "2026-10-01T14:31:54.000"),
    ("2026-09-22 04:44:36 CEST", None, None, None, "2026-09-22T02:44:36.000"), ("2026-09-22T06:53:38.381 [Europe/Oslo]", None, None, None, "2026-09-22T04:53:38.381"),
    ("01/10/2026 01:26:51", None, "UTC", "dmy", "2026-10-01T01:26:51.000"), ("01/10/2026 01:26:51", None, "UTC", "mdy", "2026-01-10T01:26:51.000"), ("13/10/2026 01:26:51", None, "UTC", "mdy", None),
    ("Oct 1, 2026 12:05 AM", None, "America/New_York", "mdy", "2026-10-01T04:05:00.000"), ("Nov 9, 2026 12:05 PM", None, "America/New_York", "mdy", "2026-11-09T17:05:00.000"),
    # clocks put back on 2026-10-25 at 03:00 in Oslo: 02:30 is read twice
    ("2026-10-25T02:30:00", "2026-10-25T00:29:00.000Z", "Europe/Oslo", None, "2026-10-25T00:30:00.000"), ("2026-10-25T02:30:00", "2026-10-25T01:29:00.000Z", "Europe/Oslo", None, "2026-10-25T01:30:00.000"),
    ("2026-10-25T02:30:00", None, "Europe/Oslo", None, "2026-10-25T00:30:00.000"),
    # and put forward on 2026-10-04 at 02:00 in Sydney: 02:30 is skipped
    ("2026-10-04T02:30:00", "2026-10-03T16:31:00.000Z", "Australia/Sydney", None, "2026-10-03T16:30:00.000"), ("2026-10-04T02:30:00", "2026-10-03T15:31:00.000Z", "Australia/Sydney", None, "2026-10-03T15:30:00.000"),
    ("2026-10-04T12:30:00", None, "Australia/Sydney", None, "2026-10-04T01:30:00.000"),
    ("2026-02-29T00:00:00Z", None, None, None, None), ("2024-02-29T00:00:00Z", None, None, None, "2024-02-29T00:00:00.000"), ("2026-13-40T25:61:00Z", None, None, None, None),
    ("0000-00-00 00:00:00", None, "UTC", None, None), ("", None, "UTC", None, None), ("pending", None, "UTC", None, None), (None, None, "UTC", None, None), ("2026-10-20 10:00:00", None, None, None, None),
    ("2026-10-20 10:00:00 XYZ", None, None, None, None), ("2026-10-20 10:00:00 [Mars/Base]", None, None, None, None), ("x" * 100_000, None, "UTC", None, None),
]


def test_timestamps(spark):
    data = [(i, *c[:4]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(data, "i int, t string, fs string, z string, o string")
    df = timestamps.with_instants(df, {"fs": "seen", "t": "at"}, zone={"t": "z"}, order={"t": "o"}, hint={"t": "seen"})
    got = {r.i: r.at for r in df.select("i", F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("at")).collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}


def test_timestamp_rows(spark, tmp_path):
    obs = [("ep", 1, "k", A.upper(), "2026-10-01T10:00:00", T0, None, None)] * 2 + [("ep", 2, "k", None, "2026-10-01T10:00:00", T0, None, None), ("ep", 3, "k", None, T0, "2026-10-01T00:00:00", None, None)]
    log = [(1, "ep", 1_790_036_229, None), (2, "ep", 1_790_036_229_502, None), (3, "ep", 0, None), (4, "ep", -5, None), (5, "ep", None, None), (6, "ep", 1_790_037_222_506_067, None), (7, "ep", 1_790_065_424_523_028_706, None)]
    runs = [(4, "ep", "run", "2026-10-01T00:00:00+02:00", "failed")]
    got = rows(timestamps.found(spark, write(tmp_path, observations=obs, request_log=log, capture_runs=runs, observer_clocks=[("ep", A, "Europe/Oslo", "dmy")])))
    assert got == sorted([
        ("observations", "1/k", "timestamp", 1790841600000), ("observations", "3/k", "first_seen", 1790812800000), ("capture_runs", "4", "started_at", 1790805600000),
        ("request_log", "1", "sent_ms", 1790036229000), ("request_log", "6", "sent_ms", 1790037222506), ("request_log", "7", "sent_ms", 1790065424523),
    ])


def test_orphans(spark, tmp_path):
    """Deleted, late, missing; before the first run; a key that comes back; ids of either case; repeated rows."""
    nodes = [(1, T0, A, 1.0, 1.0, ""), (1, T0, C, 1.0, 1.0, ""), (2, T1, B, 1.0, 1.0, ""), (2, T1, C, 1.0, 1.0, ""), (3, T2, A.upper(), 1.0, 1.0, "")]
    at = {0: "2026-09-30T12:00:00Z", 1: "2026-10-01T12:00:00.000Z", 2: "2026-10-02T00:00:00Z", 3: "2026-10-03T12:00:00+02:00"}
    obs = [("ep", i, "k", "gw", t, None, None, None) for i, t in at.items()] + [("ep", 9, "k", "gw", "pending", None, None, None)]
    hops = [("ep", i, "k", x, "o") for i, x in ((0, A), (1, B), (2, A.upper()), (2, A.upper()), (3, B), (9, B))]
    d = write(tmp_path, capture_runs=RUNS, nodes_snapshot=nodes, observers_snapshot=[(2, T1, "gw", None, None, "")], observations=obs, measured_hops=hops)
    assert rows(orphans.found(spark, d)) == sorted([
        ("measured_hops", "1/k", "2026-10-01", "late"), ("measured_hops", "2/k", "2026-10-02", "deleted"), ("measured_hops", "3/k", "2026-10-03", "deleted"),
        ("observations", "1/k", "2026-10-01", "late"), ("observations", "3/k", "2026-10-03", "deleted"),
    ])
