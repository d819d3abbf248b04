"""Graph searches against enumeration on seeded random graphs; distributed ones against the driver's."""

import random
from itertools import permutations

import pytest

from airlattice.operators import graph as G


def random_graph(seed):
    r = random.Random(seed)
    names = "abcdef"
    edges = [(a, b, float(r.randint(1, 9))) for a in names for b in names if a < b and r.random() < 0.5]
    clear = {(a, b): r.random() < 0.6 for a, b, _ in edges}
    facts = {n: {"height": float(r.randint(1, 5)), "existing": r.random() < 0.4, "quality": float(r.randint(0, 3)), "client": r.random() < 0.2} for n in names}
    facts["a"]["client"] = facts["f"]["client"] = True
    return G.Graph(edges, clear, facts, {e[:2]: float(r.randint(1, 3)) for e in edges}, {e[:2]: float(r.randint(1, 4)) for e in edges}), edges


def simple_paths(g, s, t):
    inner = [n for n in "abcdef" if n not in (s, t)]
    for k in range(len(inner) + 1):
        for mid in permutations(inner, k):
            p = [s, *mid, t]
            if all(b in g.near[a] for a, b in zip(p, p[1:])):
                yield p


@pytest.mark.parametrize("seed", range(40))
def test_paths_against_all_simple_paths(seed):
    g, _ = random_graph(seed)
    paths = list(simple_paths(g, "a", "f"))
    if not paths:
        assert g.hop_path("a", "f") is None and g.disjoint_paths("a", "f") == [] and g.k_shortest("a", "f", 3) == []
        return
    along = lambda f, p: [f[x] for x in zip(p, p[1:])]
    total = lambda name, nodes: sum(g.fact(n, name) for n in nodes)

    def fine(p):
        """How paths of as many hops compare."""
        return (not g.is_clear(p), -g.bottleneck(p), -min(along(g.fresnel, p)), total("height", p[1:-1]), -total("quality", p[1:]), sum(along(g.length, p)), p)

    routers = lambda p: [n for n in p[1:] if not g.fact(n, "client", False)]
    assert g.hop_path("a", "f") == min(paths, key=lambda p: (len(p), fine(p)))
    assert g.reliability_path("a", "f") == min(paths, key=lambda p: (not g.is_clear(p), -g.bottleneck(p), len(p), fine(p)))
    new = lambda p: (sum(not g.fact(n, "existing", False) for n in routers(p)), len(routers(p)))
    assert g.installation_path("a", "f") == min(paths, key=lambda p: (new(p), len(p), fine(p)))
    cost = lambda p: sum(100 + g.fact(n, "height") for n in p[1:-1]) + sum(along(g.length, p)) / 1e6
    assert abs(cost(g.infrastructure_path("a", "f")) - min(map(cost, paths))) < 1e-9
    assert g.k_shortest("a", "f", 4) == sorted(paths, key=lambda p: (len(p), p))[:4]
    inner = [set(p[1:-1]) for p in paths]

    def most(i, used):
        return max([0] + [1 + most(j + 1, used | inner[j]) for j in range(i, len(inner)) if not inner[j] & used])

    found = g.disjoint_paths("a", "f")
    assert len(found) == most(0, set())
    assert all(p in paths for p in found) and sum(len(p) - 2 for p in found) == len(set().union(*(p[1:-1] for p in found)))
    for n in (1, 2, 3):
        short = [g.bottleneck(p) for p in paths if len(p) - 1 <= n]
        got = [p for p in g.bounded_margin_paths("a", "f", n) if len(p) - 1 <= n]
        assert max(map(g.bottleneck, got), default=None) == max(short, default=None)
    three = [p for p in paths if len(p) == 4]
    assert sorted(map(tuple, g.paired_routes("a", "f"))) == sorted(map(tuple, three))
    assert {"a", "f"} <= g.steiner(["a", "f"])
    chosen = g.best_subset(["a", "f"], list("bcde"), 4)
    assert chosen is not None


def test_chain_longer_than_any_count_of_rounds(spark):
    """A chain of ninety edges: hops, margins and the root come from its far end."""
    names = [f"n{i:03}" for i in range(91)]
    e = spark.createDataFrame([(a, b, 100.0 - i) for i, (a, b) in enumerate(zip(names, names[1:]))], "a string, b string, w double")
    start = spark.createDataFrame([(names[0],)], "id string")
    assert {r.id: r.hops for r in G.hop_distance(e, start).collect()} == {n: i for i, n in enumerate(names)}
    assert {r.id: r.margin for r in G.widest(e, start).collect() if r.id != names[0]} == {n: 101.0 - i for i, n in enumerate(names) if i}
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    assert {r.root for r in G.components(nodes, e).collect()} == {names[0]}


def test_distributed(spark):
    for seed in (1, 2, 3):
        g, edges = random_graph(seed)
        e = G.best_edges(spark.createDataFrame(edges + edges[:1] + [("a", "a", 1.0), (None, "b", 1.0)], "a string, b string, w double"))
        nodes = spark.createDataFrame([(n,) for n in "abcdefz"], "id string")
        roots = {r.id: r.root for r in G.components(nodes, e).collect()}
        reach = {n: {n} | {m for m in "abcdef" if m != n and g.hop_path(n, m)} for n in "abcdef"} | {"z": {"z"}}
        assert roots == {n: min(reach[n]) for n in reach}
        start = spark.createDataFrame([("a",)], "id string")
        assert {r.id: r.hops for r in G.hop_distance(e, start).collect()} == {m: 0 if m == "a" else len(g.hop_path("a", m)) - 1 for m in reach["a"]}
        assert {r.id: r.margin for r in G.widest(e, start).collect() if r.id != "a"} == {m: g.widest_margin("a", m) for m in reach["a"] if m != "a"}
