"""The route search over a ridge, and the driver-side helpers."""

import pytest
from pyspark.sql import functions as F

from airlattice.functions import rf
from airlattice.operators import links, planner


@pytest.fixture
def tiles(spark):
    ix, iy = (F.col("id") % 101).cast("int"), F.floor(F.col("id") / 101).cast("int")
    return links.tile_lattice(spark.range(101 * 41).select(ix.alias("ix"), iy.alias("iy"), F.when(ix == 50, 300.0).otherwise(0.0).alias("z")))


def test_route_over_a_ridge(spark, tiles):
    """Two ends that a ridge parts are joined over the mast on it, not over the one behind."""
    site = lambda i, x, y, h, **k: {"id": i, "x": x, "y": y, "h": h, **k}
    sites = [site("a", 500.0, 2000.0, 5.0), site("b", 9500.0, 2000.0, 5.0), site("low", 3000.0, 2200.0, 5.0), site("top", 5000.0, 2000.0, 20.0)]
    radio = rf.Radio(strict=True, sample_step_m=100.0, fresnel_clearance=0.0)
    s = planner.RouteSearch(spark, sites, tiles, radio, 100.0, coarse=400.0, final=100.0)
    got = s.search("a", "b")
    assert got["path"] == ["a", "top", "b"] and got["quality"].margin > 0 and not got["resilient"] and len(got["id"]) == 16
    assert got["distance_m"] == pytest.approx(9000)
    assert s.reduced_heights(got["path"], [1.0, 10.0, 20.0]) == {"top": 1.0}
    again = s.refined("a", "top", "b", 100.0, 100.0)
    assert again["x"] == 5000.0
    alone = planner.RouteSearch(spark, sites[:3], tiles, radio, 100.0, coarse=400.0, final=100.0).search("a", "b")
    assert alone["path"] is None and alone["rejected"]["terrain"] > 0
    assert planner.RouteSearch(spark, sites, tiles, radio, 100.0, stopped=lambda: True).search("a", "b")["path"] is None
    with pytest.raises(ValueError, match="unique"):
        planner.RouteSearch(spark, sites + sites[:1], tiles, radio, 100.0)


def linked(valid):
    """A link model by the pair's ids and the step alone."""
    def evaluate(df, tiles, radio, res, ends):
        rows = [(r.a, r.b, None, 5.0, bool(valid(r.a, r.b, radio.sample_step_m)), True, True) for r in df.collect()]
        return df.sparkSession.createDataFrame(rows, "a string, b string, state string, two_way_db double, valid boolean, los_clear boolean, fresnel_clear boolean")

    return evaluate


def clusters(*places):
    """Five sites 100 m apart at each place (name, x); the first cluster's end a and the last one's end b."""
    at = [(f"{n}{i}", x + 100.0 * i) for n, x in places for i in range(5)]
    return [{"id": n, "x": x, "y": 0.0, "h": 5.0} for n, x in [("a", places[0][1] - 100.0), ("b", places[-1][1] + 500.0), *at]]


def test_route_beyond_the_nearest(spark):
    """All nearest sites lie in the own cluster: the one long hop is found, straight or by a cluster between; if there is
    none, every pair that leads out of an end's part has been evaluated."""
    group = lambda n: {"a": "p", "b": "q"}.get(n, n[0])
    for places, hops in (((("p", 0.0), ("q", 20e3)), {("p4", "q0")}), ((("p", 0.0), ("m", 10e3), ("q", 20e3)), {("m2", "p3"), ("m4", "q1")}), ((("p", 0.0), ("q", 20e3)), set())):
        s = planner.RouteSearch(spark, clusters(*places), None, rf.Radio(), 100.0, neighbours=3, evaluate=linked(lambda x, y, _: group(x) == group(y) or (x, y) in hops))
        got = s.search("a", "b")
        if not hops:
            assert got["path"] is None and {(s.final, *sorted((f"p{i}", f"q{j}"))) for i in range(5) for j in range(5)} <= s.done.keys()
        else:
            assert {p for p in map(tuple, map(sorted, zip(got["path"], got["path"][1:]))) if group(p[0]) != group(p[1])} == hops


def test_bridges_in_many_jobs(spark, monkeypatch):
    """A job's number of pairs bounds nothing else."""
    monkeypatch.setattr(planner, "BRIDGE_BATCH", 3)
    far = {("p0", "q4")}
    s = planner.RouteSearch(spark, clusters(("p", 0.0), ("q", 20e3)), None, rf.Radio(), 100.0, neighbours=3, evaluate=linked(lambda x, y, _: {x[0], y[0]} in ({"a", "p"}, {"b", "q"}, {"p"}, {"q"}) or (x, y) in far))
    assert s.search("a", "b")["path"] == ["a", "p0", "q4", "b"]


def test_certified_beyond_twenty_rounds(spark):
    """25 routers hold at the coarse step only; the last is found."""
    sites = [{"id": n, "x": x, "y": y, "h": 5.0} for n, x, y in [("a", 0.0, 0.0), ("b", 9000.0, 0.0), *((f"r{i:02}", 4500.0, 10.0 * i) for i in range(26))]]
    s = planner.RouteSearch(spark, sites, None, rf.Radio(), 100.0, coarse=200.0, final=50.0, evaluate=linked(lambda x, y, step: {x, y} != {"a", "b"} and (step == 200.0 or "r25" in (x, y))))
    assert s.search("a", "b")["path"] == ["a", "r25", "b"]


def test_helpers(spark):
    assert planner.grid_size(0, 0, 1000, 500, 100, 1000) == (10, 5, 100)
    columns, rows, cell = planner.grid_size(0, 0, 1000, 1000, 1, 100)
    assert columns * rows <= 100 and cell > 99
    cells = planner.grid_cells(spark, 0.0, 0.0, 30.0, 20.0, 10.0).collect()
    assert [(c["index"], c.x, c.y) for c in cells][:4] == [(0, 5.0, 15.0), (1, 15.0, 15.0), (2, 25.0, 15.0), (3, 5.0, 5.0)]
    assert planner.scrub({"a": [{"Message": "x", "b": 1}], "raw_hex": 2}) == {"a": [{"b": 1}]}
    assert planner.canonical_json({"b": 1.0, "a": "é"}) == '{"a":"\\u00e9","b":1.0}'
    assert planner.fingerprint("x", {"a": 1}) != planner.fingerprint("y", {"a": 1})
    base = {"rf": {"mhz": 869.5, "snr_thresholds_db": {"7": -7.5}}, "strict": False}
    assert planner.merge_settings(base, {"rf": {"snr_thresholds_db": {"8": -10}}})["rf"] == {"mhz": 869.5, "snr_thresholds_db": {"8": -10}}
    for bad in ({"x": 1}, {"rf": 1}, {"strict": 1}):
        with pytest.raises(ValueError):
            planner.merge_settings(base, bad)
    g = planner.Graph([("a", "r", 5.0), ("r", "b", 4.0)], facts={"r": {"existing": True}})
    assert planner.topology_score(g, ["a", "b"], ["r"], "hops") == (False, 2, 0, -4.0)
    assert planner.active_alternative([(1, 2), (0, 5), (0, 5)]) == 1 and planner.active_alternative([]) is None
