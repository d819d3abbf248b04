"""Routes of several networks in one job: screening, searches against the graph's own, networks of one site, the bound."""

import pytest
from pyspark.sql import functions as F

from airlattice.functions import rf
from airlattice.operators import routes
from airlattice.operators.graph import Graph

SITE = "net string, id string, x double, y double, h double, quality double, existing boolean, terminal boolean"
LINK = "net string, a string, b string, margin_db double, clear boolean, fresnel double, metres double"


def site(net, name, x, terminal=False, existing=False):
    return (net, name, float(x), 0.0, 10.0, 1.0, existing, terminal)


def test_screening(spark):
    """Neighbours and pairs with an end, once each, by free space and span; sites at one place are no pair."""
    sites = spark.createDataFrame([site("n", "a", 0, True), site("n", "b", 1000), site("n", "c", 2000), site("n", "d", 2000), site("n", "e", 9000, True), site("m", "z", 0, True)], SITE)
    near = spark.createDataFrame([("n", "b", "c"), ("n", "c", "b"), ("n", "c", "d"), ("n", "a", "b")], "net string, a string, b string")
    got = sorted((r.a, r.b) for r in routes.screened_pairs(sites, near, rf.Radio(), 8_000.0).collect())
    assert got == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "e"), ("c", "e"), ("d", "e")]
    assert routes.screened_pairs(sites, near, rf.Radio(sensitivity_dbm=0.0)).count() == 0


def test_searches_by_network(spark, monkeypatch):
    """Each network is searched by itself, with or without links; one without two ends gives no rows; one too large is an error."""
    names = [site("n", "a", 0, True), site("n", "b", 1000, existing=True), site("n", "c", 2000), site("n", "e", 3000, True), site("m", "a", 0, True), site("m", "e", 3000, True), site("k", "a", 0, True)]
    held = [("n", "a", "b", 5.0, True, 1.0, 1000.0), ("n", "a", "c", 9.0, True, 1.0, 2000.0), ("n", "b", "e", 5.0, True, 1.0, 2000.0), ("n", "c", "e", 9.0, True, 1.0, 1000.0)]
    sites, links = spark.createDataFrame(names, SITE), spark.createDataFrame(held, LINK)
    path = lambda find: lambda g, s, t: [[">".join(p)]] if (p := find(g, s, t)) else []
    run = lambda find: [(r.net, r.route) for r in routes.searched(sites, links, path(find), "route string").collect()]
    assert run(Graph.hop_path) == run(Graph.reliability_path) == [("n", "a>c>e")]
    assert run(Graph.installation_path) == [("n", "a>b>e")]
    assert routes.searched(sites.limit(0), links, path(Graph.hop_path), "route string").collect() == []
    monkeypatch.setattr(routes, "MOST_SITES", 3)
    with pytest.raises(Exception, match="more than 3 sites"):
        routes.searched(sites.filter(F.col("net") == "n"), links, path(Graph.hop_path), "route string").collect()
