"""Graph operators. Components, hop distances and widest paths run as joins over edge tables of any size; searches over one
planner's graph, which is bounded (at most a few thousand sites), run on the driver with every tie broken by id.

Edge tables: a, b, w (worst margin of the two directions). Null ends and self loops are left out; of repeated pairs the
best edge counts, the first on ties.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.tables import cut


def best_edges(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Unordered pairs with their best margin; with nodes (id), only edges whose both ends are there."""
    e = links.filter("a is not null and b is not null and a <> b and w is not null")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.max("w").alias("w"))
    if nodes is not None:
        for end in ("a", "b"):
            e = e.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return e.select("a", "b", "w")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) with the least id of each component; isolated nodes are their own root.

    Alternates large-star and small-star steps until nothing moves; the rounds grow with the logarithm of a component's size.
    """
    e = cut(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b <= a")
        m = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = both.join(m, "a")
        moved = j.filter("b > a") if large else j.unionByName(m.select("a", F.col("a").alias("b"), "m"))
        return moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    same = False
    while not same:
        fresh = cut(star(star(e, True), False))
        same = fresh.count() == e.count() and not fresh.exceptAll(e).take(1)
        e = fresh
    roots = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return nodes.select("id").dropna().distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def hop_distance(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """G1: (id, hops) of every node that a source reaches, step by step until none is new."""
    e = cut(both_ways(edges).select("a", "b").distinct())
    seen = cut(sources.select("id", F.lit(0).alias("hops")).distinct())
    front, hop = seen, 0
    while front.take(1):
        hop += 1
        front = cut(front.join(e, front.id == e.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front) if hop % 16 else cut(seen.unionByName(front))
    return seen


def widest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, margin) of the path whose least margin is greatest; a source's margin is infinite. Only what a round has bettered
    is carried on, until nothing is."""
    e = cut(both_ways(edges))
    best = cut(sources.select("id", F.lit(float("inf")).alias("margin")).distinct())
    front = best
    while front.take(1):
        step = front.join(e, front.id == e.a).select(F.col("b").alias("id"), F.least("margin", "w").alias("margin")).groupBy("id").agg(F.max("margin").alias("margin"))
        front = cut(step.join(best.withColumnRenamed("margin", "had"), "id", "left").filter("had is null or margin > had").select("id", "margin"))
        best = cut(best.unionByName(front).groupBy("id").agg(F.max("margin").alias("margin")))
    return best


class Graph:
    """One planner's graph: sites by id, the best edge of each pair, with its margin, whether it is clear, its Fresnel clearance
    and its length. Node facts: height, quality, existing (an installation that is there), client (no installation at all)."""

    def __init__(self, edges: list[tuple[str, str, float]], clear: dict[tuple[str, str], bool] | None = None, facts: dict[str, dict] | None = None,
                 fresnel: dict[tuple[str, str], float] | None = None, length: dict[tuple[str, str], float] | None = None):
        self.near: dict[str, dict[str, float]] = defaultdict(dict)
        self.clear, self.fresnel, self.length, self.facts = {}, {}, {}, facts or {}
        for a, b, w in edges:
            if a != b and w > self.near[a].get(b, float("-inf")):
                self.near[a][b] = self.near[b][a] = w
                for to, given, usual in ((self.clear, clear, True), (self.fresnel, fresnel, float("inf")), (self.length, length, 0.0)):
                    to[a, b] = to[b, a] = (given or {}).get((a, b), (given or {}).get((b, a), usual))

    def fact(self, node: str, name: str, usual=0.0):
        return self.facts.get(node, {}).get(name, usual)

    def bottleneck(self, path: list[str]) -> float:
        """A10: least margin of a path's edges."""
        return min((self.near[a][b] for a, b in zip(path, path[1:])), default=float("inf"))

    def reached(self, source: str) -> set[str]:
        """The nodes of a source's part, itself among them."""
        seen, queue = {source}, [source]
        for a in queue:
            fresh = self.near.get(a, {}).keys() - seen
            seen |= fresh
            queue += fresh
        return seen

    def is_clear(self, path: list[str]) -> bool:
        return all(self.clear[a, b] for a, b in zip(path, path[1:]))

    def _best_first(self, source: str, target: str, start: tuple, extend) -> list[str] | None:
        """Path of the least cost, ties by the ids along it; extend gives a longer path's cost from its prefix's."""
        heap, done = [(start, (source,))], set()
        while heap:
            cost, path = heapq.heappop(heap)
            at = path[-1]
            if at == target:
                return list(path)
            if at in done:
                continue
            done.add(at)
            for b in sorted(self.near[at]):
                if b not in done:
                    heapq.heappush(heap, (extend(cost, at, b), (*path, b)))
        return None

    def _away(self, start: str, allowed) -> dict[str, int]:
        """Hops from each node to start, over steps (a, b) towards it that are allowed."""
        hops, queue = {start: 0}, [start]
        for b in queue:
            for a in self.near[b]:
                if a not in hops and allowed(a, b):
                    hops[a] = hops[b] + 1
                    queue.append(a)
        return hops

    def _finest(self, source: str, target: str, allowed) -> list[str] | None:
        """Of the paths of fewest hops over allowed steps (a, b), the best in turn by: being clear all along, least margin,
        least Fresnel clearance, height of its inner masts, quality of its sites, length, and the ids along it. Each measure
        leaves the steps that a best path can be made of, and is not traded for an earlier one."""
        hops = self._away(target, allowed)
        if source not in hops:
            return None
        layers, level = [], {source}
        while target not in level:
            layers.append([(a, b) for a in sorted(level) for b in sorted(self.near[a]) if hops.get(b, -1) == hops[a] - 1 and allowed(a, b)])
            level = {b for _, b in layers[-1]}

        def bottleneck(measure) -> float:
            best = {source: float("inf")}
            for steps in layers:
                fresh: dict[str, float] = {}
                for a, b in steps:
                    if a in best:
                        fresh[b] = max(fresh.get(b, float("-inf")), min(best[a], measure[a, b]))
                best = fresh
            return best[target]

        margin = {(a, b): self.near[a][b] for steps in layers for a, b in steps}
        for measure in (self.clear, margin, self.fresnel):
            least = bottleneck(measure)
            layers = [[s for s in steps if measure[s] >= least] for steps in layers]
        best: dict[str, tuple] = {source: (0.0, 0.0, 0.0, (source,))}
        for steps in layers:
            fresh: dict[str, tuple] = {}
            for a, b in steps:
                if a in best:
                    h, q, d, path = best[a]
                    cost = (h + (0.0 if b == target else self.fact(b, "height")), q - self.fact(b, "quality"), d + self.length[a, b], (*path, b))
                    fresh[b] = min(fresh.get(b, cost), cost)
            best = fresh
        return list(best[target][3])

    def hop_path(self, source: str, target: str) -> list[str] | None:
        """The finest of the paths of fewest hops."""
        return self._finest(source, target, lambda a, b: True)

    def widest_margin(self, source: str, target: str, clear_only: bool = False) -> float | None:
        """The greatest least margin of a path, over clear edges alone or all; None where there is no path."""
        heap, done = [(float("-inf"), source)], set()
        while heap:
            worst, a = heapq.heappop(heap)
            if a == target:
                return -worst
            if a in done:
                continue
            done.add(a)
            for b, w in self.near[a].items():
                if b not in done and (self.clear[a, b] or not clear_only):
                    heapq.heappush(heap, (max(worst, -w), b))
        return None

    def reliability_path(self, source: str, target: str) -> list[str] | None:
        """The finest of the paths over edges of the widest margin, clear ones where clear ones lead there at all."""
        least, clear = self.widest_margin(source, target, True), True
        if least is None:
            least, clear = self.widest_margin(source, target), False
        return None if least is None else self._finest(source, target, lambda a, b: self.near[a][b] >= least and (self.clear[a, b] or not clear))

    def _installed(self, start: str, entering) -> dict[str, tuple[int, int]]:
        """(new installations, routers) on the cheapest way from start to each node; entering: the node that a step a, b pays for."""
        best, heap = {}, [((0, 0), start)]
        while heap:
            cost, a = heapq.heappop(heap)
            if a in best:
                continue
            best[a] = cost
            for b in self.near[a]:
                paid = entering(a, b)
                own = (0, 0) if self.fact(paid, "client", False) else (int(not self.fact(paid, "existing", False)), 1)
                heapq.heappush(heap, ((cost[0] + own[0], cost[1] + own[1]), b))
        return best

    def installation_path(self, source: str, target: str) -> list[str] | None:
        """Fewest new installations, then fewest routers, then the finest of these."""
        there, back = self._installed(source, lambda a, b: b), self._installed(target, lambda a, b: a)
        if target not in there:
            return None

        def cheapest(a: str, b: str) -> bool:
            own = (0, 0) if self.fact(b, "client", False) else (int(not self.fact(b, "existing", False)), 1)
            return tuple(x + y + z for x, y, z in zip(there[a], own, back[b], strict=True)) == there[target]

        return self._finest(source, target, cheapest)

    def infrastructure_path(self, source: str, target: str) -> list[str] | None:
        """Least sum of 100 and the mast's height for each inner site, and a millionth of the metres; then ids."""
        mast = lambda b: 100.0 + self.fact(b, "height")
        return self._best_first(source, target, (0.0,), lambda c, a, b: (c[0] + (mast(b) if b != target else 0.0) + self.length[a, b] / 1e6,))

    def disjoint_paths(self, source: str, target: str, most: int | None = None) -> list[list[str]]:
        """As many paths without common inner nodes as there are, or `most`, by augmenting unit flows through split nodes."""
        flow: set[tuple[str, str]] = set()

        def residual(node: tuple[str, str]):
            name, side = node
            if side == "out":
                for b in sorted(self.near[name]):
                    if (name, b) not in flow and b != source:
                        yield (b, "in")
                if name != source and any(x[1] == name for x in flow):
                    yield (name, "in")
            else:
                if name == target or not any(x[1] == name for x in flow):
                    yield (name, "out")
                for a in sorted(self.near[name]):
                    if (a, name) in flow:
                        yield (a, "out")

        for _ in range(len(self.near[source]) if most is None else most):  # no more than the source's edges
            came, queue = {(source, "out"): None}, [(source, "out")]
            for node in queue:
                if node[0] == target:
                    break
                for b in residual(node):
                    if b not in came:
                        came[b] = node
                        queue.append(b)
            end = next((n for n in ((target, "in"), (target, "out")) if n in came), None)
            if end is None:
                break
            while came[end] is not None:
                before = came[end]
                if before[1] == "out" and end[1] == "in" and before[0] != end[0]:
                    flow.add((before[0], end[0]))
                elif before[1] == "in" and end[1] == "out" and before[0] != end[0]:
                    flow.discard((end[0], before[0]))
                end = before
        after = dict(flow_from for flow_from in sorted(flow) if flow_from[0] != source)
        paths = []
        for _, first in sorted(x for x in flow if x[0] == source):
            path = [source, first]
            while path[-1] != target:
                path.append(after[path[-1]])
            paths.append(path)
        return sorted(paths, key=lambda p: (len(p), p))

    def _shortest(self, source: str, target: str, without: set[str], barred: set[tuple[str, str]]) -> tuple[str, ...] | None:
        """The path of fewest hops, then of least ids, that avoids nodes and first steps."""
        hops = self._away(target, lambda a, b: a not in without and (a, b) not in barred)
        if source not in hops:
            return None
        path = [source]
        while path[-1] != target:
            path.append(min(b for b in self.near[path[-1]] if hops.get(b, -1) == hops[path[-1]] - 1 and (path[-1], b) not in barred))
        return tuple(path)

    def k_shortest(self, source: str, target: str, k: int) -> list[list[str]]:
        """The k loopless paths of fewest hops, ties by ids: each path found is left at each of its nodes once, by the
        shortest way on that no path with the same beginning has taken."""
        first = self._shortest(source, target, set(), set())
        out, heap, known = [], [(len(first), first)] if first else [], {first}
        while heap and len(out) < k:
            _, path = heapq.heappop(heap)
            out.append(path)
            for i in range(len(path) - 1):
                barred = {(p[i], p[i + 1]) for p in out if p[: i + 1] == path[: i + 1]}
                rest = self._shortest(path[i], target, set(path[:i]), barred)
                if rest and (found := path[:i] + rest) not in known:
                    known.add(found)
                    heapq.heappush(heap, (len(found), found))
        return [list(p) for p in out]

    def bounded_margin_paths(self, source: str, target: str, max_hops: int) -> list[list[str]]:
        """For each number of hops up to max_hops, the widest path of so many hops at most."""
        best: dict[str, tuple[float, tuple[str, ...]]] = {source: (float("inf"), (source,))}
        out = []
        for _ in range(max_hops):
            fresh = dict(best)
            for a, (m, path) in sorted(best.items()):
                for b, w in sorted(self.near[a].items()):
                    if b not in path and (min(m, w), tuple(-ord(c) for c in "".join(path))) > (fresh.get(b, (float("-inf"),))[0], ()) and min(m, w) > fresh.get(b, (float("-inf"),))[0]:
                        fresh[b] = (min(m, w), (*path, b))
            best = fresh
            if target in best and (not out or list(best[target][1]) != out[-1]):
                out.append(list(best[target][1]))
        return out

    def paired_routes(self, source: str, target: str, top: int = 32) -> list[list[str]]:
        """Three-hop routes by margin, the best `top`."""
        routes = [(-min(w, self.near[a][b], self.near[b][target]), [source, a, b, target]) for a, w in self.near[source].items() if a != target
                  for b in self.near[a] if b not in (source, target) and target in self.near[b]]
        return [r for _, r in heapq.nsmallest(top, routes)]

    def steiner(self, terminals: list[str]) -> set[str]:
        """Nodes of a minimum spanning tree over the terminals' shortest paths."""
        joined, nodes = {min(terminals)}, {min(terminals)}
        while len(joined) < len(set(terminals)):
            paths = [p for a in sorted(joined) for b in sorted(set(terminals) - joined) if (p := self.hop_path(a, b))]
            if not paths:
                break
            path = min(paths, key=lambda p: (len(p), p))
            joined.add(path[-1])
            nodes |= set(path)
        return nodes

    def best_subset(self, clients: list[str], optional: list[str], size: int, limit: int = 100_000, beam: int = 64) -> tuple[str, ...] | None:
        """The routers, at most `size`, that connect all clients with the best worst margin: every subset where
        there are at most `limit`, else a beam of the `beam` best at each size."""
        def score(chosen: tuple[str, ...]):
            """(clients joined, worst margin of the best tree, fewest, ids): all nodes joined by widest edges first."""
            inside, parent = {*clients, *chosen}, {}
            find = lambda x: x if parent.get(x, x) == x else find(parent[x])
            worst, edges = float("inf"), sorted(((w, a, b) for a in inside for b, w in self.near[a].items() if b in inside and a < b), key=lambda t: (-t[0], t[1], t[2]))
            for w, a, b in edges:
                if find(a) != find(b):
                    parent[find(b)] = find(a)
                    groups = defaultdict(int)
                    for c in clients:
                        groups[find(c)] += 1
                    worst = w
                    if max(groups.values()) == len(clients):
                        break
            groups = defaultdict(int)
            for c in clients:
                groups[find(c)] += 1
            return (max(groups.values()), worst if len(groups) == 1 else float("-inf"), -len(chosen))

        pool, count, best = sorted(optional), 1, None
        for n in range(0, size + 1):
            count = count * (len(pool) - n + 1) // n if n else 1
            if count <= limit:
                layer = list(combinations(pool, n))
            else:
                kept = sorted(layer, key=lambda c: tuple(-x if x != float("-inf") else float("inf") for x in score(c)) + (c,))[:beam]
                layer = sorted({tuple(sorted({*c, x})) for c in kept for x in pool if x not in c})
            for c in layer:
                s = score(c)
                if s[0] == len(clients) and (best is None or s[1:] > best[0]):
                    best = (s[1:], c)
        return best[1] if best else None
